"""The store's tables as views of the given ones, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Line numbers repeat within an order, so ties go by part and price.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_linestatus")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("doc_"), "doc_id").alias("id"), F.left("text", F.lit(40)).alias("title"), F.col("source").alias("source_uri"), F.col("text").alias("content"),
        F.char_length("text").cast("long").alias("char_count"), F.col("lang").alias("workspace_id"), F.col("doc_id").alias("seq"),
    )


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("c"), "doc_id").alias("id"), F.left("text", F.lit(40)).alias("name"), F.lit("concept").alias("type"), F.array("lang", "source").alias("tags"),
        F.left("text", F.lit(300)).alias("summary"), F.col("text").alias("body"), F.col("lang").alias("workspace"), F.col("doc_id").alias("seq"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("concept_id"), F.col("embedding").alias("vector"), F.col("label").alias("workspace_id"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as concepts of a graph."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("workspace"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between the parts of an order's neighbouring lines: type by return flag, in the order of the lines."""
    line = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    rows = line.select("l_orderkey", F.row_number().over(order).alias("nth"), "l_partkey", "l_returnflag", "l_linestatus", F.lead("l_partkey").over(order).alias("next"))
    return rows.where("next IS NOT NULL").select(
        F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.col("l_returnflag").alias("relation_type"), F.concat(F.lit("p"), "next").alias("target_id"), F.col("l_linestatus").alias("reason"),
        (F.col("l_orderkey") * 100 + F.col("nth")).alias("seq"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the ends of ``edges``: of lines with one number and part it doesn't matter which comes first, so no more than these is sorted."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lead("l_partkey").over(order).alias("next")).where("next IS NOT NULL")
    return rows.select(F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("p"), "next").alias("target_id"))


def bulk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between the parts of an order's neighbouring lines that are both of 45 pieces or more: a sparse graph."""
    line = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    rows = line.select("l_orderkey", F.row_number().over(order).alias("nth"), "l_partkey", "l_quantity", "l_returnflag", "l_linestatus", F.lead("l_partkey").over(order).alias("next"), F.lead("l_quantity").over(order).alias("q"))
    return rows.where("l_quantity >= 45 AND q >= 45").select(
        F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.col("l_returnflag").alias("relation_type"), F.concat(F.lit("p"), "next").alias("target_id"), F.col("l_linestatus").alias("reason"),
        (F.col("l_orderkey") * 100 + F.col("nth")).alias("seq"),
    )


RAW = "raw AS (SELECT 'doc_' || doc_id AS id, left(text, 40) AS title, source AS source_uri, text AS content, length(text) AS char_count, lang AS workspace_id, doc_id AS seq FROM documents)"
CONCEPTS = "concepts AS (SELECT 'c' || doc_id AS id, left(text, 40) AS name, 'concept' AS type, [lang, source] AS tags, left(text, 300) AS summary, text AS body, lang AS workspace, doc_id AS seq FROM documents)"
VECTORS = "vectors AS (SELECT vec_id AS concept_id, embedding::DOUBLE[] AS vector, label AS workspace_id FROM embeddings)"
NODES = "nodes AS (SELECT 'p' || p_partkey AS id, p_name AS name, p_type AS type, p_brand AS workspace FROM part)"
EDGES = """edges AS (SELECT 'p' || l_partkey AS source_id, l_returnflag AS relation_type, 'p' || nxt AS target_id, l_linestatus AS reason, l_orderkey * 100 + nth AS seq
  FROM (SELECT *, lead(l_partkey) OVER o AS nxt, row_number() OVER o AS nth FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_returnflag, l_linestatus)) WHERE nxt IS NOT NULL)"""
BULK = """edges AS (SELECT 'p' || l_partkey AS source_id, l_returnflag AS relation_type, 'p' || nxt AS target_id, l_linestatus AS reason, l_orderkey * 100 + nth AS seq
  FROM (SELECT *, lead(l_partkey) OVER o AS nxt, lead(l_quantity) OVER o AS q, row_number() OVER o AS nth FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_returnflag, l_linestatus)) WHERE l_quantity >= 45 AND q >= 45)"""
