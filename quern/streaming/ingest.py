"""Incremental ingestion with Structured Streaming: pages in, archive and concepts out, events and an audit log beside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..plans.ingest import ingest_pages
from ..schema import QUERY_LOG
from ..sources import ndjson
from ..sources.scratch import settled

PAGE_STREAM = "title string, text string, source string"
EVENT = "event string, source string, name string, count long, at timestamp"


def page_stream(spark: SparkSession, path: str, per_batch: int = 64) -> DataFrame:
    """A stream of JSON pages from a folder."""
    return spark.readStream.schema(PAGE_STREAM).option("maxFilesPerTrigger", per_batch).json(path)


def start_ingest(pages: DataFrame, engine: Engine, events_path: str, checkpoint: str, *, name: str = "ingest", workspace: str = "default", generate: Callable[[str], str] | None = None) -> StreamingQuery:
    """Take each micro-batch of pages into the store: archived, distilled, deduplicated against what is known, with vectors, edges, index entries and centroids.

    Known concepts are merged, so they keep their sources, tags and relations, and what a batch brings can be found by all searches once it is done. The number of a
    finished batch is kept under the stream's ``name``: a batch that comes again after that is skipped, and one that broke off before is repeated, which gives
    the same store, since every step is an upsert, a union of lists or an addition of what is absent. Its events are NDJSON files of the batch's own.
    """

    def batch(df: DataFrame, number: int) -> None:
        done = engine.batches.read().where((F.col("stream") == name) & (F.col("number") == number))
        if not done.isEmpty():
            return
        given = settled(df.where(F.col("source").isNotNull()), "stream-pages")
        actions = settled(ingest_pages(engine, given, workspace, generate), "stream-actions")
        crawled = given.select(F.lit("page_crawled").alias("event"), "source", F.col("title").alias("name"), F.lit(1).cast("long").alias("count"))
        made = F.when(F.col("target").isNull(), F.lit("concept_created")).otherwise(F.lit("concept_merged"))
        changed = actions.select(made.alias("event"), F.lit(None).cast("string").alias("source"), F.coalesce("target", "id").alias("name"), F.lit(1).cast("long").alias("count"))
        finished = given.agg(F.count("*").alias("count")).select(F.lit("completed").alias("event"), F.lit(None).cast("string").alias("source"), F.lit(f"batch {number}").alias("name"), "count")
        events = crawled.unionByName(changed).unionByName(finished).withColumn("at", F.current_timestamp())
        events.write.mode("overwrite").json(f"{events_path}/batch={number}")
        engine.batches.append(engine.spark.createDataFrame([(name, number)], "stream string, number long"))

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The audit log as an append-only stream of QUERY_LOG rows."""
    return stream.select(*[F.col(f.name).cast(f.dataType) for f in QUERY_LOG.fields]).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The events of NDJSON logs as they grow: a line that is cut off waits for its rest (see ``GrowingLines`` for the options)."""
    ndjson.register(spark)
    return salvaged_events(spark.readStream.format(ndjson.GrowingLines.name()).options(**options).load(path))


def read_events(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The events that stand in NDJSON logs now; with ``closed`` the last line needs no end."""
    ndjson.register(spark)
    return salvaged_events(spark.read.format(ndjson.GrowingLines.name()).options(**options).load(path))


def salvaged_events(lines: DataFrame) -> DataFrame:
    """Events of a column ``value`` of NDJSON lines, with the chatter before and after each object cut off; lines without one go."""
    body = F.regexp_substr("value", F.lit(r"\{.*\}"))
    return lines.select(F.from_json(body, EVENT).alias("e")).where("e.event IS NOT NULL").select("e.*")
