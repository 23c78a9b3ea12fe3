"""The corpus operators as queries over the tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, divergence, html_blocks, langid, line_dedup, media, mixture, near_dedup, perplexity, pieces, sharding, toxicity, url_templates
from .common import held_out, read_table

N_SHARDS = 24
#: The rules of op11, as (host, path, block).
URL_RULES = [("com", "/", False), ("example.com", "/en/", True), ("www.example.com", "/en/", False), ("net", "/es/", True), ("net", "/fr/", True)]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines cut from all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document, by its least id."""
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = read_table(spark, sf_dir, "pages")
    return html_blocks.extract_main_text(pages, html_blocks.train(pages)).select("page_id", "url", "text", "n_chars")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from labelled rows that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a seeded random order over ``N_SHARDS`` shards, counts at most one apart."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.external_shuffle(docs, N_SHARDS).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an image, read back, with its tile and difference hash."""
    found = media.text_media(read_table(spark, sf_dir, "documents"), keep_media=False)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "format", "width", "height", "tile_npy")


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the capped mixture of sources takes of every document."""
    return mixture.mixed_sizes(read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from labelled rows that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs)
    return langid.predict_languages(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as piece ids and back."""
    return pieces.round_trip(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and perplexity bands over all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = perplexity.quality_rules(docs)
    return found.select("doc_id", *perplexity.BASE, "base_failed", "kept", "log_ppl", "low", "high")


def op11_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by the fixed rules, and by the templates of its host where none fits."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, block boolean")
    found = url_templates.judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight exact centroids of ten rounds over all vectors."""
    return centroids.centroid_clusters(read_table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of each language against each other, and the terms that stand out in them, over all documents."""
    return divergence.divergence_audit(read_table(spark, sf_dir, "documents"))


_ALL = (
    op1_line_dedup, op2_near_dedup, op3_html_text, op4_toxicity, op5_sharding, op6_media, op7_mixture, op8_language_id, op9_pieces, op10_quality_rules, op11_url_templates,
    op12_centroids, op13_divergence,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op1_line_dedup": "WITH " + line_dedup.LINE_SQL.format(docs="documents") + "SELECT doc_id, n_lines, n_removed, text FROM deduped",
    "op2_near_dedup": "WITH RECURSIVE " + near_dedup.NEAR_SQL.format(docs="documents") + "SELECT doc_id, n_shingles, component_id, kept FROM classed",
    "op7_mixture": mixture.MIX_SQL.format(docs="documents", seed=7) + "SELECT doc_id, size, source_size, target, (repeats * size)::BIGINT AS taken, source, repeats::BIGINT AS repeats FROM mixed",
    "op12_centroids": centroids.cluster_sql(),
    "op13_divergence": divergence.AUDIT_SQL.format(docs="documents", least=10, top=10),
}
