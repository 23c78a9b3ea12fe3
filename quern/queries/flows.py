"""Links between documents and vectors, deduplication, crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import crawl, distill, vector, vector_index
from ..sources.readers import parse_pages
from ..sources.scratch import settled
from .model import VECTORS, concepts, table, vectors
from .registry import query


@query(f"""WITH {VECTORS}, s AS (SELECT a.concept_id, b.concept_id AS neighbour, round(list_cosine_similarity(a.vector, b.vector), 6) AS score FROM vectors a JOIN vectors b ON a.concept_id <> b.concept_id WHERE a.concept_id % 100 = 0)
SELECT concept_id, neighbour, score, row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, neighbour)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, neighbour) <= 3""")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of all vectors for every vector whose id is divisible by 100."""
    v = vectors(spark, sf_dir)
    found = vector.most_similar(v.where("concept_id % 100 = 0"), v, 3, key="concept_id")
    return found.select("concept_id", F.col("other").alias("neighbour"), "score", F.col("rank").cast("int").alias("rank"))


@query()
def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``knn_edges`` from an index over all vectors: cells, codes and exact re-ranking. The tests hold its recall against the exact way."""
    v = vectors(spark, sf_dir)
    index = vector_index.build_index(v, 64, key="concept_id")
    found = vector_index.search_index(index, v.where("concept_id % 100 = 0"), 3)
    return found.select("concept_id", F.col("other").alias("neighbour"), "score", F.col("rank").cast("int").alias("rank"))


@query(r"""WITH p AS (SELECT regexp_extract(url, '://([^/:]+)', 1) AS host, page_id, regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS words FROM pages),
w AS (SELECT DISTINCT host, page_id, unnest(words) AS word FROM p), f AS (SELECT host, word, min(page_id) AS first FROM w GROUP BY host, word)
SELECT w.page_id AS source_id, f.first AS target_id, min(w.word) AS reason, 'references' AS relation_type FROM w JOIN f ON f.host = w.host AND f.word = w.word WHERE w.page_id <> f.first GROUP BY w.page_id, f.first""")
def cross_page_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a site refer to the first page that has the same menu entry: a link to that entry stands for its page."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/:]+)", 1).alias("host"), "page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">'), 1)).alias("word")).distinct()
    place = F.concat_ws("/", "host", "word")
    links = p.select(F.col("page_id").alias("source"), F.array(F.struct(place.alias("url"), F.col("word").alias("text"))).alias("links"))
    own = p.groupBy("host", "word").agg(F.min("page_id").alias("concept")).select(place.alias("url"), "concept")
    every = p.select(F.col("page_id").alias("url"), F.col("page_id").alias("concept")).distinct()
    ids = every.select(F.col("url").cast("string").alias("url"), "concept").union(own)
    return distill.page_references(links.withColumn("source", F.col("source").cast("string")), ids)


#: Similar pairs, then a fold over the new concepts in the order of their ids, which carries those created so far and the decisions.
_DEDUP = """v AS (SELECT vec_id::VARCHAR AS id, 'concept' || label AS name, embedding::DOUBLE[] AS vector, embedding[1] > 0 AS fresh FROM embeddings),
pairs AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.vector, b.vector), 6) AS score, b.fresh AS fresh, contains(a.name, b.name) OR contains(b.name, a.name) AS fits
  FROM v a JOIN v b ON a.fresh AND (NOT b.fresh OR b.id < a.id) WHERE round(list_cosine_similarity(a.vector, b.vector), 6) >= 0.55),
turns AS (SELECT v.id, list({'other': other, 'score': score, 'fresh': pairs.fresh, 'fits': fits} ORDER BY score DESC, other) FILTER (other IS NOT NULL) AS near FROM v LEFT JOIN pairs ON pairs.id = v.id WHERE v.fresh GROUP BY v.id),
steps AS (SELECT list({'id': id, 'near': coalesce(near, []), 'made': []::VARCHAR[], 'done': []::STRUCT(id VARCHAR, action VARCHAR, target VARCHAR, links VARCHAR)[]} ORDER BY id) AS s FROM turns),
blank AS (SELECT list_concat([{'id': '', 'near': s[1].near[:0], 'made': []::VARCHAR[], 'done': []::STRUCT(id VARCHAR, action VARCHAR, target VARCHAR, links VARCHAR)[]}], s) AS s FROM steps),
seen AS (SELECT list_reduce(s, lambda a, x: {'id': x.id, 'near': list_filter(x.near, lambda n: NOT n.fresh OR list_contains(a.made, n.other))[:3],
  'made': CASE WHEN len(list_filter(list_filter(x.near, lambda n: NOT n.fresh OR list_contains(a.made, n.other))[:1], lambda n: n.score >= 0.95 OR (n.score >= 0.9 AND n.fits))) = 0 THEN a.made || [x.id] ELSE a.made END,
  'done': a.done || [{'id': x.id, 'action': CASE WHEN len(list_filter(list_filter(x.near, lambda n: NOT n.fresh OR list_contains(a.made, n.other))[:1], lambda n: n.score >= 0.95 OR (n.score >= 0.9 AND n.fits))) = 1 THEN 'merge_similar'
      WHEN len(list_filter(x.near, lambda n: NOT n.fresh OR list_contains(a.made, n.other))) > 0 THEN 'create_linked' ELSE 'create' END,
    'target': list_transform(list_filter(x.near, lambda n: NOT n.fresh OR list_contains(a.made, n.other))[:1], lambda n: n.other)[1],
    'links': array_to_string(list_transform(list_filter(x.near, lambda n: NOT n.fresh OR list_contains(a.made, n.other))[:3], lambda n: n.other), ',')}]}) AS last FROM blank)"""


@query(f"WITH {_DEDUP} SELECT d.id, d.action, CASE WHEN d.action = 'merge_similar' THEN d.target END AS target, CASE WHEN d.action = 'merge_similar' THEN '' ELSE d.links END AS links FROM (SELECT unnest(last.done) AS d FROM seen)")
def dedup_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the concepts whose vector points one way in its first place, beside those of the other way and those created before them."""
    v = vectors(spark, sf_dir).select(F.col("concept_id").cast("string").alias("id"), F.concat(F.lit("concept "), "workspace_id").alias("name"), F.col("vector").cast("array<double>").alias("vector"))
    found = distill.dedup_actions(v.where("vector[0] > 0"), v.where("NOT vector[0] > 0"))
    return found.select("id", "action", "target", F.array_join("links", ",").alias("links"))


@query()
def crawl_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A greedy crawl inside the archive of pages, where each menu entry leads to the next page of its site."""
    pages = parse_pages(table(spark, sf_dir, "pages"))
    site = F.regexp_extract("source", "^([a-zA-Z]+://[^/?#]+)", 1)
    places = pages.select(site.alias("site"), "source").distinct()
    order = Window.partitionBy("site").orderBy("source")
    following = F.filter(F.array(*[F.struct(F.lead("source", k).over(order).alias("url"), F.lit("next").alias("text")) for k in (1, 2, 3)]), lambda x: x["url"].isNotNull())
    graph = pages.drop("links").join(places.select("source", following.alias("links")), "source").select("title", "text", "source", "source_type", "links")
    graph = settled(graph, "archive")  # read at every level
    start = places.groupBy("site").agg(F.count("*").alias("n"), F.min("source").alias("first")).orderBy(F.desc("n"), "site").first()["first"]
    found = crawl.archive_crawl(graph, start, depth=8, max_pages=60)
    return found.select("source", "crawl_depth", "parent_url")


@query("SELECT lang AS workspace, count(*) AS concepts, count(*) FILTER (length(text) > 7000) AS long_ones, max(length(text)) AS longest FROM documents GROUP BY lang")
def chunk_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("body").cast("long")
    return concepts(spark, sf_dir).groupBy("workspace").agg(F.count("*").alias("concepts"), F.count_if(n > 7000).alias("long_ones"), F.max(n).alias("longest"))
