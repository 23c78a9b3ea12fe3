"""Substring search in the archive of raw documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import occurrences, snippet


def raw_matches(raw: DataFrame, query: str) -> DataFrame:
    """Documents whose title (5 points) or content (a point a hit) holds the query in any case, with count and snippet."""
    q = F.lit(query.lower())
    title, content = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("content", F.lit("")))
    count = F.when(F.contains(title, q), 5).otherwise(0) + F.when(F.contains(content, q), occurrences(content, q)).otherwise(F.lit(0))
    found = raw.withColumn("match_count", count.cast("long")).where("match_count > 0")
    around = snippet(F.col("content"), q)
    return found.withColumn("snippet", F.when(around == "", F.coalesce("title", F.lit(""))).otherwise(around))


def raw_search(raw: DataFrame, query: str, limit: int = 5) -> DataFrame:
    return raw_matches(raw, query).orderBy(F.desc("match_count"), "id").limit(limit)


def as_hits(matches: DataFrame) -> DataFrame:
    """Raw matches in the form of search results."""
    score = F.round(F.least(F.col("match_count") * 0.02, F.lit(0.35)) + 0.55, 4)
    return matches.select(
        F.concat(F.lit("raw:"), F.col("id")).alias("concept_id"), F.col("title").alias("name"), F.lit("raw_archive").alias("type"), F.col("snippet").alias("summary"),
        F.array(F.lit("raw_source"), F.concat(F.lit("matches:"), F.col("match_count"))).alias("tags"), score.alias("score"), F.lit("raw").alias("matched_by"), F.col("workspace_id").alias("workspace"),
    )
