"""Relevance-ordered crawl as a level-by-level join of a frontier with fetched pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.web import canonical_url, is_crawlable, link_score
from ..sources.scratch import settled


def level_quotas(depth: int, max_pages: int, greedy: bool = False) -> list[int]:
    """Pages of each level from 1 on: an even share, the rest to the first levels; all of them each, if greedy."""
    if greedy or max_pages <= 0:
        return [9_999] * max(1, min(depth or 10, 50))
    depth, left = max(0, min(depth, 20)), max(1, min(max_pages, 2000)) - 1
    return [left // depth + (level < left % depth) for level in range(depth)] if depth else []


def candidates(pages: DataFrame, visited: DataFrame, root: str) -> DataFrame:
    """(url, score, parent_url, anchor_text): each new crawlable target with its best link, ties by parent."""
    links = pages.select("source", F.explode("links").alias("l")).select(F.col("l.url").alias("url"), F.col("source").alias("parent_url"), F.col("l.text").alias("anchor_text"))
    links = links.where(is_crawlable(F.lit(root), F.col("url"))).join(visited, "url", "left_anti")
    links = links.withColumn("score", link_score(F.lit(root), F.col("parent_url"), F.col("url"), F.col("anchor_text")))
    best = F.min(F.struct((-F.col("score")).alias("s"), "parent_url", "anchor_text"))
    return links.groupBy("url").agg(best.alias("x")).select("url", (-F.col("x.s")).alias("score"), "x.parent_url", "x.anchor_text")


def crawl(pages_of: Callable[[DataFrame], DataFrame], start_url: str, root: DataFrame, depth: int = 1, max_pages: int = 8, greedy: bool = False) -> DataFrame:
    """PAGE rows with crawl_depth, parent_url and anchor_text.

    ``root`` holds the start page as fetched; ``pages_of`` gives the pages of a table of URLs, by a join with an
    archive or by fetching. URLs without a page cost no quota but count as visited. The frontier of a level is ordered by
    score and cut at its quota; pages, links and visited URLs stay distributed.
    """
    spark = root.sparkSession
    found = settled(root.select("*", F.lit(0).alias("crawl_depth"), F.lit(None).cast("string").alias("parent_url"), F.lit("").alias("anchor_text")), "crawl")
    start = spark.createDataFrame([(start_url,)], "url string").select(canonical_url(F.col("url")).alias("url")).first()[0]
    visited = settled(found.select(F.col("source").alias("url")).union(spark.createDataFrame([(start,)], "url string")).distinct(), "visited")
    total, level_pages = found, found
    for level, quota in enumerate(level_quotas(depth, max_pages, greedy), 1):
        if quota <= 0:
            break
        frontier = settled(candidates(level_pages, visited, start), "frontier")
        got = pages_of(frontier.select("url")).join(frontier.withColumnRenamed("url", "source"), "source")
        level_pages = settled(got.orderBy(F.desc("score"), "source").limit(quota).drop("score").withColumn("crawl_depth", F.lit(level)), "crawl")
        if level_pages.isEmpty():
            break
        total = total.unionByName(level_pages)
        visited = settled(visited.union(level_pages.select(F.col("source").alias("url"))).distinct(), "visited")
    return total


def archive_crawl(pages: DataFrame, start_url: str, **kwargs: object) -> DataFrame:
    """A crawl inside a table of parsed pages."""
    start = pages.sparkSession.createDataFrame([(start_url,)], "url string").select(canonical_url(F.col("url")).alias("source"))
    return crawl(lambda urls: pages.join(urls.withColumnRenamed("url", "source"), "source", "left_semi"), start_url, pages.join(start, "source", "left_semi"), **kwargs)
