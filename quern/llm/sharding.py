"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, without

#: Equal rows from which on, or the part of a bucket's bytes from which on, they are counted and dealt out by their number, and how many of them are dealt out in a piece.
MANY, PART = 1000, 8
#: A bucket's number is that of its range, times this; records larger than half a bucket have numbers of their own behind it.
OWN = 1 << 20
#: Buckets whose offsets one task sums up, and bytes of buckets that one task shuffles.
SPAN, TASK_BYTES = 10_000, 64 << 20


def fisher_yates(n: int, seed: int, bucket: int) -> list[int]:
    """A permutation of 0..n-1: swap each place, from the last, with a seeded draw at or before it."""
    places = list(range(n))
    draws = np.random.Generator(np.random.PCG64([seed, bucket])).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        places[i], places[j] = places[j], places[i]
    return places


def _numbered(docs: DataFrame, size: Column, bucket_bytes: int) -> DataFrame:
    """With ``__row``, a hash of the whole row, and ``__copy``, which is 0 but for rows that are equal to very many others, or to so many that together they are large: those are numbered.

    Equal rows are counted where they stand, so that no task sees all of a large group; its number is dealt out again in pieces.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*columns, F.xxhash64(*columns).alias("__row"))
    groups = rows.groupBy("__row").agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("bytes"))
    many = materialise(groups.where((F.col("n") > MANY) | ((F.col("n") > 1) & (F.col("bytes") > bucket_bytes // PART))).select("__row"), "shard-many")
    if many.isEmpty():
        return rows.withColumn("__copy", F.lit(0).cast("long"))
    counted = rows.join(many, "__row", "left_semi").groupBy(*columns, "__row").agg(F.count("*").alias("__n"))
    pieces = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(MANY).cast("long"))).alias("__from"))
    pieces = pieces.repartition(F.xxhash64("__row", "__from"))
    copies = pieces.select(*columns, "__row", F.explode(F.sequence(F.col("__from"), F.least(F.col("__n"), F.col("__from") + MANY) - 1)).alias("__copy"))
    return rows.join(many, "__row", "left_anti").select(*columns, "__row", F.lit(0).cast("long").alias("__copy")).union(copies)


def scattered(docs: DataFrame, *, text: str, bucket_bytes: int, seed: int) -> tuple[DataFrame, int, int]:
    """Pass 1: the records with ``__row``, ``__copy`` and ``__bucket``, how many ranges of buckets there are, and the bytes of all records."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 8
    total = int(docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])
    n_buckets = max(1, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "__row", "__copy"), F.lit(n_buckets)).cast("long") * OWN
    own = F.pmod(F.xxhash64("__row", "__copy", F.lit(seed)), F.lit(OWN - 1)).cast("long") + 1
    placed = _numbered(docs, size, bucket_bytes).withColumn("__bucket", bucket + F.when(size > bucket_bytes // 2, own).otherwise(0))
    return placed, n_buckets, total


def external_shuffle(docs: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text", bucket_bytes: int = 8 << 20, seed: int = 11) -> DataFrame:
    """Put every record into a shard and a slot, in one seeded random order of the whole table.

    Pass 1 scatters the records uniformly into buckets of about ``bucket_bytes`` by a seeded hash of the whole row and, for
    rows whose equals are more than ``MANY`` or fill more than a part of a bucket, their number among these, so neither a frequent key nor a frequent
    text fills a bucket. A record larger than half a bucket is one of its own.
    Pass 2 puts each bucket into canonical order (key, text, rest, so that retries agree) and Fisher-Yates
    shuffles it. Buckets follow each other, so a record's place is its bucket's offset plus its place inside;
    place modulo ``n_shards`` is its shard and the quotient its slot: shards differ by one record at most.

    Adds ``shard`` int and ``slot`` long, replacing columns of those names. Null texts and keys are records like
    others, and so is each of repeated rows. An empty table gives no rows. Columns of type map are not supported.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    docs = without(docs, "shard", "slot")
    placed, n_buckets, total = scattered(docs, text=text, bucket_bytes=bucket_bytes, seed=seed)
    counts = materialise(placed.groupBy("__bucket").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("__bucket") / (SPAN * OWN))), "shard-counts")
    spans = counts.groupBy("span").agg(F.sum("n").alias("all"))
    spans = spans.select("span", (F.sum("all").over(Window.orderBy("span")) - F.col("all")).alias("before"))  # a row for SPAN buckets
    inside = F.sum("n").over(Window.partitionBy("span").orderBy("__bucket")) - F.col("n")
    offsets = counts.join(spans, "span").select("__bucket", (F.col("before") + inside).alias("__offset"))
    tasks = max(1, -(-total // TASK_BYTES), min(n_buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    records = placed.join(offsets, "__bucket").repartition(tasks, "__bucket")
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    names = docs.columns

    def shuffled(bucket: pa.Table) -> pa.Table:
        at = pc.sort_indices(bucket, sort_keys=[(c, "ascending") for c in (key, text, "__row", "__copy") if c in bucket.column_names])
        order = np.asarray(at)[fisher_yates(len(bucket), seed, bucket.column("__bucket")[0].as_py())]
        place = bucket.column("__offset")[0].as_py() + np.arange(len(bucket))
        out = bucket.select(names).take(pa.array(order))
        return out.append_column("shard", pa.array((place % n_shards).astype(np.int32))).append_column("slot", pa.array(place // n_shards))

    return records.groupBy("__bucket").applyInArrow(shuffled, schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder a shard. Each task writes the buckets that it has shuffled, without another shuffle: a shard's files
    hold runs of its slots, each file in slot order, and ``slot`` says where a record belongs."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
