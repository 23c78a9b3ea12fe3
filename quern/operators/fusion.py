"""Fusion of ranked lists. A list is (concept_id, score) and bounded by its own limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidate_count(top_k: int) -> int:
    return max(3 * top_k, 20)


def ranked(hits: DataFrame, key: str = "concept_id") -> DataFrame:
    """With ``rank`` 1..n by score, ties by key. For lists of bounded length: one window sees them whole."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def reciprocal_rank(keyword: DataFrame, vector: DataFrame, alpha: float = 0.5, k: int = 60, key: str = "concept_id") -> DataFrame:
    """(key, score): the weighted sum of 1 / (k + rank) over both lists, times 100, rounded."""
    parts = [ranked(hits, key).select(key, (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("part")) for hits, w in ((keyword, (1 - alpha) * 2), (vector, alpha * 2))]
    return parts[0].unionByName(parts[1]).groupBy(key).agg(F.round(F.sum("part") * 100, 4).alias("score"))


def min_max(hits: DataFrame, key: str = "concept_id") -> DataFrame:
    """Scores moved to 0..1; if all are equal the range counts as 1, so they become 0."""
    bounds = hits.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    width = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(F.lit(1.0))
    return hits.join(F.broadcast(bounds)).select(key, ((F.col("score") - F.col("low")) / width).alias("score"))  # one row


def linear(keyword: DataFrame, vector: DataFrame, alpha: float = 0.5, key: str = "concept_id") -> DataFrame:
    """(key, score): (1 - alpha) of the keyword score plus alpha of the vector score, each moved to 0..1; a missing one is 0."""
    a, b = min_max(keyword, key).withColumnRenamed("score", "f"), min_max(vector, key).withColumnRenamed("score", "v")
    score = F.coalesce("f", F.lit(0.0)) * (1 - alpha) + F.coalesce("v", F.lit(0.0)) * alpha
    return a.join(b, key, "full_outer").select(key, F.round(score, 4).alias("score"))


def graph_score(seed: Column, rank: Column, top: Column) -> Column:
    """0.6 of the seed's own score plus 0.4 of its personalised rank as a percentage of the highest."""
    return F.round(seed * 0.6 + F.coalesce(F.try_divide(rank, top), F.lit(0.0)) * 100 * 0.4, 4)
