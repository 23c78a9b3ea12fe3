"""A corpus pipeline: each stage takes the documents that the stage before it left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import langid, line_dedup, mixture, near_dedup, pieces
from quern.llm.common import WORD, materialise, read_table, small_batches

#: A prediction below this score is no decision, and rejects its document.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: text without a letter, null text and undecided predictions go.

    The model learns from the labelled documents themselves, whose null ids, languages and texts teach nothing. What stays follows from the text
    alone, so repeated rows and null ids stay or go together; without any labelled document none stays.
    """
    small_batches(spark)
    scored = langid.predict_languages(docs.withColumn("__row", F.struct("*")), langid.train(docs))
    return scored.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("__row.*")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut; a document of which no word is left goes, and so does one without any before.

    The first place is that of the least id, null before all others; rows that repeat id and text stand at one place and are cut alike.
    ``n_chars``, if there is such a column, follows the cut text.
    """
    cut = line_dedup.dedup_lines(docs).where(F.col("text").rlike(WORD))
    columns = [F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return cut.select(*columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity .80 or more) stays: that of the least id.

    Rows that repeat its id and text stay with it; a row of null id stays only where its group has no id. Documents without words
    are in no group and stay.
    """
    small_batches(spark)
    return near_dedup.keep_one(docs, percent=80)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target weights.

    A null source is one of its own; null ids and repeated rows are documents like others; those without words follow their source's rate.
    """
    return mixture.mix_sources(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mixture: none for an empty text, null ids and no number for a null one; repeated rows give a row each."""
    small_batches(spark)
    coded = pieces.encode_pieces(docs, keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")).alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("lines", repeated_lines),
    ("near_copies", near_copies),
    ("mixture", source_mixture),
    ("pieces", encoded),
]

#: The language model is learnt, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. An empty table gives no rows."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
