"""Keyword search: BM25 over weighted fields with prefix terms, phrases and the additive rewrite of multi-word queries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stem import porter
from ..sources.scratch import settled, small_batches

#: Effective weights of name, aliases, tags, summary, body.
FIELD_WEIGHTS = {"name": 5.0, "aliases": 3.0, "tags": 2.0, "summary": 1.0, "body": 1.0}
K1, B = 1.2, 0.75


def plain_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def fold(token: str) -> str:
    """Without diacritics, lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c))


#: Stems that a worker keeps over its batches.
MOST_STEMS = 1 << 18
_stems: dict[str, str] = {}


def _stemmed(tokens: list[str]) -> list[str]:
    if len(_stems) > MOST_STEMS:
        _stems.clear()
    out = []
    for t in tokens:
        if (s := _stems.get(t)) is None:
            s = _stems[t] = porter(fold(t))
        out.append(s)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(tokens: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else _stemmed(x) for x in tokens])


def tokenized(docs: DataFrame, key: str, fields: list[str], stem: bool = False) -> DataFrame:
    """(key, a token array for each field)."""
    columns = [plain_tokens(F.concat_ws(" ", F.col(f)) if dict(docs.dtypes)[f].startswith("array") else F.col(f)).alias(f) for f in fields]
    tokens = docs.select(key, *columns)
    if stem:
        small_batches(docs.sparkSession)
    return tokens.select(key, *[stemmed(F.col(f)).alias(f) for f in fields]) if stem else tokens


def postings(tokens: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The inverted index (key, field, term, positions), one row for each term of a field; write it sorted by term, so that a search reads its terms only.

    A row's terms are all in the row, so they are grouped where it stands and nothing is shuffled; rows of one key have postings of their own each.
    """
    small_batches(tokens.sparkSession)
    schema = T.StructType([tokens.schema[key], *(T.StructField(n, t) for n, t in (("field", T.StringType()), ("term", T.StringType()), ("positions", T.ArrayType(T.IntegerType()))))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in fields:
                column = batch.column(f)
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = pc.dictionary_encode(column.flatten(), null_encoding="encode")
                if not len(coded):
                    continue
                row = np.repeat(np.arange(len(sizes)), sizes)
                code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                pos = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
                of = row * len(coded.dictionary) + code
                order = np.argsort(of, kind="stable")
                starts = np.flatnonzero(np.diff(of[order], prepend=-1))
                first = order[starts]
                places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(pos[order]))
                found = [batch.column(key).take(pa.array(row[first])), pa.array([f] * len(first), pa.string()), coded.dictionary.take(pa.array(code[first])), places]
                yield pa.RecordBatch.from_arrays(found, names=[key, "field", "term", "positions"])

    return tokens.select(key, *fields).mapInArrow(rows, schema)


def lengths(tokens: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, length): the tokens of each row, over all fields."""
    return tokens.select(key, sum((F.size(F.col(f)) for f in fields), F.lit(0)).cast("long").alias("length"))


def query_words(query: str) -> list[str]:
    """The words of a query, each without its other characters."""
    words = ("".join(c for c in w if c.isalnum() or c == "_") for w in query.split())
    return [w.lower() for w in words if w]


def _phrase_hits(tokens: Column, words: list[str], prefix: bool) -> Column:
    """How often the words stand one after the other; the last may be a prefix."""

    def same(token: Column, k: int) -> Column:
        return F.startswith(token, F.lit(words[k])) if prefix and k == len(words) - 1 else token == words[k]

    if len(words) == 1:
        return F.size(F.filter(tokens, lambda t: same(t, 0)))
    places = F.sequence(F.lit(1), F.size(tokens) - len(words) + 1)

    def here(i: Column) -> Column:
        ok = same(F.element_at(tokens, i), 0)
        for k in range(1, len(words)):
            ok = ok & same(F.element_at(tokens, i + k), k)
        return ok

    return F.when(F.size(tokens) >= len(words), F.size(F.filter(places, here))).otherwise(F.lit(0))


def _phrases(words: list[str]) -> list[tuple[list[str], bool]]:
    """What a query counts: each word as a prefix, and of several words the exact phrase besides."""
    return [([w], True) for w in words] + ([(words, False)] if len(words) > 1 else [])


def _scored(rows: DataFrame, stats: DataFrame, key: str, n_words: int) -> DataFrame:
    """(key, score) of rows (key, length, f0, f1, ...: weighted counts of the phrases) beside their statistics (rows, mean, n0, n1, ...)."""
    n = n_words + (n_words > 1)
    any_term = F.greatest(*[F.col(f"f{i}") for i in range(n_words)], F.lit(0.0)) > 0
    scored = rows.where(any_term).join(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        idf = F.log((F.col("rows") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        f = F.col(f"f{i}")
        return F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))).otherwise(F.lit(0.0))

    terms = sum((part(i) for i in range(1, n_words)), part(0))
    if n == n_words:
        return scored.select(key, terms.alias("score"))
    every = F.least(*[F.col(f"f{i}") for i in range(n_words)]) > 0
    return scored.select(key, (part(n_words) + terms + F.when(every, terms).otherwise(F.lit(0.0))).alias("score"))


def _statistics(rows: DataFrame, n: int) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(n)])


def bm25(tokens: DataFrame, key: str, query: str, weights: dict[str, float], stem: bool = False) -> DataFrame:
    """(key, score) of the rows that hold any prefix term; higher is better. A scan of tokens that are at hand.

    A term is a prefix phrase; a row's score sums, for each phrase of the query's expression that it matches,
    idf * f * (k1 + 1) / (f + k1 * (1 - b + b * length / mean length)), f the weighted count. The expression of several
    words is the exact phrase, or all terms, or any term: a row with all terms counts each twice. An idf that is not positive is 1e-6.
    The counts are written once, for the statistics and for the scores; nothing is shuffled but partial sums.
    """
    words = [porter(fold(w)) if stem else w for w in query_words(query)]
    if not words:
        return tokens.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    phrases = _phrases(words)
    hits = [sum((_phrase_hits(F.col(f), p, prefix) * F.lit(w) for f, w in weights.items()), F.lit(0.0)).alias(f"f{i}") for i, (p, prefix) in enumerate(phrases)]
    length = sum((F.size(F.col(f)) for f in weights), F.lit(0)).alias("length")
    rows = settled(tokens.select(key, length, *hits), "keyword-counts")
    return _scored(rows, _statistics(rows, len(phrases)), key, len(words))


def scan_bm25(docs: DataFrame, key: str, query: str, weights: dict[str, float]) -> DataFrame:
    """``bm25`` of plain tokens straight from the texts: patterns count the phrases and the tokens, so no token is ever made."""
    words = query_words(query)
    if not words:
        return docs.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    phrases, types = _phrases(words), dict(docs.dtypes)
    inside, between = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]+"

    def count(field: str, pattern: str) -> Column:
        return F.regexp_count(F.col(f"low_{field}"), F.lit(pattern))

    def pattern(p: list[str]) -> str:
        """A phrase from its first word on; what follows is looked at only, so that phrases may overlap."""
        quoted = [re.escape(w) for w in p]
        return rf"(?<!{inside}){quoted[0]}" + (f"(?={between}{between.join(quoted[1:])}(?!{inside}))" if len(p) > 1 else "")

    low = docs.select(key, *[F.lower(F.coalesce(F.concat_ws(" ", F.col(f)) if types[f].startswith("array") else F.col(f), F.lit(""))).alias(f"low_{f}") for f in weights])
    hits = [sum((count(f, pattern(p)) * F.lit(w) for f, w in weights.items()), F.lit(0.0)).alias(f"f{i}") for i, (p, _) in enumerate(phrases)]
    length = sum((count(f, f"{inside}+") for f in weights), F.lit(0)).alias("length")
    rows = settled(low.select(key, length, *hits), "keyword-counts")
    return _scored(rows, _statistics(rows, len(phrases)), key, len(words))


def indexed_bm25(index: DataFrame, lengths: DataFrame, key: str, query: str, weights: dict[str, float], stem: bool = False) -> DataFrame:
    """``bm25`` from an index of ``postings`` and the rows' ``lengths``: only the postings of the query's terms are read."""
    words = [porter(fold(w)) if stem else w for w in query_words(query)]
    if not words:
        return lengths.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    weight = F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w)))])
    starts = reduce(lambda a, b: a | b, [F.col("term").startswith(w) for w in words])
    near = settled(index.where(starts & F.col("field").isin(*weights)).select(key, "field", "term", "positions", weight[F.col("field")].alias("weight")), "query-postings")
    found = near.groupBy(key).agg(*[F.sum(F.when(F.col("term").startswith(w), F.size("positions") * F.col("weight")).otherwise(0.0)).alias(f"f{i}") for i, w in enumerate(words)])
    if len(words) > 1:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(w).alias("word")) for i, w in enumerate(words)]))
        spots = near.select(key, "field", "term", "weight", "positions", each.alias("x")).where("term = x.word")
        spots = spots.select(key, "field", "weight", F.explode("positions").alias("pos"), "x.nth").groupBy(key, "field", "weight", (F.col("pos") - F.col("nth")).alias("start")).agg(F.count("*").alias("n"))
        whole = spots.where(F.col("n") == len(words)).groupBy(key).agg(F.sum("weight").alias(f"f{len(words)}"))
        found = found.join(whole, key, "left").fillna(0.0, [f"f{len(words)}"])
    n = len(_phrases(words))
    found = settled(found, "query-counts")
    stats = lengths.agg(F.count("*").alias("rows"), F.avg("length").alias("mean")).join(F.broadcast(found.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(n)])))  # one row each
    return _scored(found.join(lengths, key), stats, key, len(words))


def reported_score(score: Column) -> Column:
    """A positive score as it is reported: at least 0.01, rounded; what is not positive counts as 0.5."""
    return F.round(F.when(score > 0, F.greatest(score, F.lit(0.01))).otherwise(F.lit(0.5)), 4)


def like_search(concepts: DataFrame, query: str) -> DataFrame:
    """The fallback where the index finds nothing: name, summary or id holds the query in any case; all score 1."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower("name"), q) | F.contains(F.lower("summary"), q) | F.contains(F.lower("id"), q)
    return concepts.where(hit).withColumn("score", F.lit(1.0))
