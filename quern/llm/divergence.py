"""How the sources of a language differ in their words: shares of kept terms, divergences, and the terms that stand out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import transducer
from .common import materialise

#: Characters between terms; terms are the longest runs of ASCII letters and of characters outside ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Capital and small letters, the only ones that are folded.
CAPITAL, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the terms of one transducer, built in one task.
CHUNK_BYTES = 1 << 20
#: Cells (eight bytes each) of the transducers that tasks hold at a time; a larger vocabulary takes more passes over the texts.
CELLS = 1 << 23
#: Shares are parts of this.
WHOLE = 1_000_000_000


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    raw = F.array_distinct(F.split(text, BETWEEN))
    return F.filter(F.array_distinct(F.transform(raw, lambda t: F.translate(t, CAPITAL, LOWER))), lambda t: t != "")


def kept_terms(docs: DataFrame, least: int = 10, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, term, chunk, ordinal): the terms in at least ``least`` documents of a language, numbered from 0 in UTF-8 order, in chunks of neighbours.

    Counts are combined before the shuffle. Terms are dealt by ranges; a range numbers its own, and the sizes of the ranges before,
    a row for each range and language, make the numbers whole, so no language stands in one task.
    """
    counted = docs.select("lang", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    counted = materialise(counted.select("lang", "term"), "kept-counted")
    ranges = max(1, -(-counted.count() // 50_000))
    dealt = materialise(counted.repartitionByRange(ranges, "lang", "term").select("*", F.spark_partition_id().alias("range")), "kept-ranges")
    here = Window.partitionBy("lang", "range").orderBy("term")
    size = F.sum(F.octet_length("term").cast("long")).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = dealt.select("*", (F.row_number().over(here) - 1).cast("long").alias("at"), F.floor((size - 1) / chunk_bytes).cast("int").alias("part"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy("lang", "range").agg(F.count("*").alias("n")).select("lang", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    chunk = F.concat_ws("-", "range", "part")
    return materialise(local.join(ahead, ["lang", "range"]).select("lang", "term", chunk.alias("chunk"), (F.col("ahead") + F.col("at")).alias("ordinal")), "kept-terms")


def transducers(kept: DataFrame) -> DataFrame:
    """(lang, chunk, first, cells, packed): a minimal transducer for each chunk of neighbouring terms, ``first`` being its least ordinal."""

    def made(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ordinal")
        packed = transducer.pack(t.encode() for t in group["term"])
        return pd.DataFrame([(group["lang"].iloc[0], group["chunk"].iloc[0], int(group["ordinal"].iloc[0]), transducer.cells_of(packed), packed)], columns=["lang", "chunk", "first", "cells", "packed"])

    return materialise(kept.groupBy("lang", "chunk").applyInPandas(made, "lang string, chunk string, first long, cells long, packed binary"), "transducers")


def portions(sizes: list[tuple], most: int = CELLS) -> list[list[tuple]]:
    """(lang, chunk, cells) in portions of up to ``most`` cells; one larger than that is a portion of its own."""
    out: list[list[tuple]] = []
    room = 0
    for item in sorted(sizes):
        if not out or room + item[2] > most:
            out.append([])
            room = 0
        out[-1].append(item)
        room += item[2]
    return out


def recounted(docs: DataFrame, machines: DataFrame, most: int = CELLS) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of kept terms, by whole texts that run through the transducers.

    A portion of the vocabulary whose tables have ``most`` cells at most is broadcast at a time, and every portion is a pass over the texts.
    """
    spark, schema = docs.sparkSession, pa.schema([("lang", pa.string()), ("source", pa.string()), ("ordinal", pa.int64()), ("n", pa.int64())])
    sizes = [tuple(r) for r in machines.select("lang", "chunk", "cells").collect()]  # a row for each MB of terms
    counts = None
    for portion in portions(sizes, most):
        names = spark.createDataFrame([p[:2] for p in portion], "lang string, chunk string")
        held = spark.sparkContext.broadcast([(r["lang"], r["first"], bytes(r["packed"])) for r in machines.join(F.broadcast(names), ["lang", "chunk"]).collect()])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            by_lang: dict[str, list] = {}
            for lang, first, packed in held.value:
                by_lang.setdefault(lang, []).append((first, transducer.unpack(packed)))
            for b in batches:
                texts = b.column("text").cast(pa.large_string()).cast(pa.large_binary())
                _, offsets, data = texts.buffers()
                if data is None or not len(texts):
                    continue
                offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
                data = np.frombuffer(data, np.uint8)
                langs, lang_names = pd.factorize(np.asarray(b.column("lang").to_pandas(), object))
                sources, source_names = pd.factorize(np.asarray(b.column("source").to_pandas(), object))
                keys, ns = [], []  # source and ordinal as one number, by language
                for small, starts, lengths, doc in transducer.tokens(data, offsets):
                    for code, lang in enumerate(lang_names):
                        for first, machine in by_lang.get(lang, ()):
                            mine = np.flatnonzero(langs[doc] == code)
                            which, place = machine.places(small, starts[mine], lengths[mine])
                            got, n = np.unique(sources[doc[mine[which]]] << 40 | (place + first), return_counts=True)
                            keys.append((code, got))
                            ns.append(n)
                if keys:
                    key, code = np.concatenate([k for _, k in keys]), np.repeat([c for c, _ in keys], [len(k) for _, k in keys])
                    columns = [pa.array(lang_names[code], pa.string()), pa.array(source_names[key >> 40], pa.string()), pa.array(key & ((1 << 40) - 1)), pa.array(np.concatenate(ns).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

        part = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, ordinal long, n long").groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))
        part = materialise(part, "recounted")
        held.destroy()
        counts = part if counts is None else counts.unionByName(part)
    return spark.createDataFrame([], "lang string, source string, ordinal long, n long") if counts is None else counts


def share(n: Column, whole: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (n + 2) / (whole + 2 * terms)), exact for any counts."""
    up = (n + 2).cast("decimal(20,0)") * F.lit(WHOLE).cast("decimal(10,0)")
    return (F.call_function("div", up, (whole + 2 * terms).cast("decimal(20,0)")) + 1).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most WHOLE + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


#: Sources and ordinals of a block when sources are compared.
BLOCK_SOURCES, BLOCK_TERMS = 64, 1 << 12


def pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, both ways. ``groups``: lang, source, whole, terms, place (from 0 in its language).

    Shares of up to ``BLOCK_SOURCES`` sources of either side and ``BLOCK_TERMS`` terms meet in a task, terms that a source lacks included; the value is the
    same both ways, so only blocks on and above the diagonal are made. A group has one more row a block, without a term, so that it is there.
    """
    n_blocks = F.floor((F.max("place").over(Window.partitionBy("lang"))) / BLOCK_SOURCES).cast("int")
    placed = groups.select("*", F.floor(F.col("place") / BLOCK_SOURCES).cast("int").alias("block"), n_blocks.alias("last"))
    chunks = F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS).cast("int") - 1, F.lit(0))
    there = placed.select("*", F.explode(F.sequence(F.lit(0), chunks)).alias("chunk"), F.lit(-1).cast("long").alias("ordinal"), F.lit(0).cast("long").alias("n"))
    used = counts.join(placed, ["lang", "source"]).select(*placed.columns, F.floor(F.col("ordinal") / BLOCK_TERMS).cast("int").alias("chunk"), "ordinal", "n")
    rows = there.unionByName(used).select("lang", "source", "whole", "terms", "block", "last", "chunk", "ordinal", "n")
    left = rows.select("*", F.explode(F.sequence("block", "last")).alias("other"))
    right = rows.where("block > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("other"))

    def shares(rows: pd.DataFrame, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        rows = rows.sort_values("source", kind="stable")
        codes, names = pd.factorize(rows["source"])
        first = rows.groupby(codes)[["whole", "terms"]].first()
        terms = int(first["terms"].iloc[0])
        width = max(0, min(BLOCK_TERMS, terms - chunk * BLOCK_TERMS))
        n = np.zeros((len(names), width), np.int64)
        real = (rows["ordinal"] >= 0).to_numpy()
        n[codes[real], rows["ordinal"].to_numpy()[real] - chunk * BLOCK_TERMS] = rows["n"].to_numpy()[real]
        under = first["whole"].to_numpy()[:, None] + 2 * terms
        if width and int(n.max()) < 9_000_000_000:
            return np.asarray(names, object), 1 + WHOLE * (n + 2) // np.maximum(under, 1)
        return np.asarray(names, object), (1 + WHOLE * (n.astype(object) + 2) // np.maximum(under, 1)).astype(np.int64)

    def compared(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        lang, i, j, chunk = key
        out: list[tuple] = []
        if len(a) and (i == j or len(b)):
            names, p = shares(a, chunk)
            others, q = (names, p) if i == j else shares(b, chunk)
            for k, name in enumerate(names):
                from_ = k + 1 if i == j else 0
                up = p[k] - q[from_:]
                values = (up * up // (p[k] + q[from_:])).sum(axis=1)
                out += [(lang, name, other, int(v)) for other, v in zip(others[from_:], values, strict=True)]
        return pd.DataFrame(out, columns=["lang", "source", "item", "value"])

    keyed_left = left.select("*", F.col("block").alias("i"), F.col("other").alias("j"))
    keyed_right = right.select(*[F.col(c).alias(c) for c in rows.columns], F.col("other").alias("i"), F.col("block").alias("j"))
    keys = ["lang", "i", "j", "chunk"]
    half = keyed_left.groupBy(*keys).cogroup(keyed_right.groupBy(*keys)).applyInPandas(compared, "lang string, source string, item string, value long")
    half = half.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    return half.select("lang", both, "value").select("lang", "x.source", "x.item", "value")


def divergence_audit(docs: DataFrame, *, least: int = 10, top: int = 10, chunk_bytes: int = CHUNK_BYTES, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others of its language (``pair``), and its ``top`` terms above the language's share (``term``).

    ``docs`` has text, lang and source; nulls are read as ''. Repeated rows and documents without terms count as documents; a source without kept terms has
    the least shares, and a language that keeps none gives pairs of value 0. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = kept_terms(docs, least, chunk_bytes)
    counts = recounted(docs, transducers(kept), cells)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = materialise(groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "divergence-groups")

    pairs = pair_values(counts, groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    of_lang = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_n"))
    lang_whole = groups.groupBy("lang").agg(F.sum("whole").alias("lang_whole"))
    rows = counts.join(of_lang, ["lang", "ordinal"]).join(groups.drop("place"), ["lang", "source"]).join(lang_whole, "lang").where("n > 0")
    rows = rows.select("lang", "source", "ordinal", share(F.col("n"), F.col("whole"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_whole"), F.col("terms")).alias("q")).where("p > q")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")  # ordinals are in the order of the terms
    best = rows.select("lang", "source", "ordinal", gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    terms = best.join(kept.select("lang", "ordinal", "term"), ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)


#: DuckDB: the same audit in one statement. ``{docs}`` is a relation with text, lang, source.
AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM {docs}),
o AS MATERIALIZED (SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term FROM o GROUP BY lang, term HAVING count(*) >= {least}),
c AS MATERIALIZED (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT d.lang, d.source, coalesce(max(t.n), 0)::HUGEINT AS n, coalesce(max(v.v), 0)::HUGEINT AS v
  FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) t USING (lang, source) LEFT JOIN v USING (lang) GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.n + 2 * g.v) AS p
  FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 2) // (any_value(w) + 2 * any_value(v)) AS q
  FROM c JOIN (SELECT lang, sum(n) AS w, max(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY lang, term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q.q) * (p.p - q.q) // (p.p + q.q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}
"""
