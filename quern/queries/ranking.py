"""Ranked search: BM25, cosine, fusion, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import embed, web
from ..operators import crawl, fusion, keyword, rawsearch, vector
from ..plans.engine import tiered
from ..sources.scratch import settled
from .model import CONCEPTS, RAW, VECTORS, concepts, raw_documents, table, vectors
from .registry import query

FIELDS = {"name": 5.0, "tags": 2.0, "summary": 1.0, "body": 1.0}


def _tf(words: list[str]) -> str:
    """SQL of the weighted counts f0.. of prefix terms and, for several words, of their exact phrase."""
    out = []
    for k, w in enumerate(words):
        out.append(" + ".join(f"{wt}::DOUBLE * len(list_filter(t_{f}, lambda x: starts_with(x, '{w}')))" for f, wt in FIELDS.items()) + f" AS f{k}")
    if len(words) > 1:
        same = " AND ".join(f"t_{{f}}[i + {k}] = '{w}'" for k, w in enumerate(words))
        out.append(" + ".join(f"{wt}::DOUBLE * len(list_filter(range(1, len(t_{f}) - {len(words) - 2}), lambda i: {same.replace('{f}', f)}))" for f, wt in FIELDS.items()) + f" AS f{len(words)}")
    return ", ".join(out)


def bm25_ctes(words: list[str], name: str = "bm") -> str:
    """CTEs that end in ``name`` (id, score), the keyword score of concepts."""
    n = len(words) + (len(words) > 1)
    tok = ", ".join(f"regexp_extract_all(lower({'array_to_string(tags, chr(32))' if f == 'tags' else f}), '[\\p{{L}}\\p{{N}}]+') AS t_{f}" for f in FIELDS)
    length = " + ".join(f"len(t_{f})" for f in FIELDS)
    parts = [f"CASE WHEN f{k} > 0 THEN greatest_idf{k} * f{k} * 2.2::DOUBLE / (f{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)) ELSE 0 END" for k in range(n)]
    idf = ", ".join(f"CASE WHEN ln((rows - n{k} + 0.5::DOUBLE) / (n{k} + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((rows - n{k} + 0.5::DOUBLE) / (n{k} + 0.5::DOUBLE)) END AS greatest_idf{k}" for k in range(n))
    terms = " + ".join(parts[: len(words)])
    every = " AND ".join(f"f{k} > 0" for k in range(len(words)))
    score = terms if len(words) == 1 else f"{parts[-1]} + {terms} + CASE WHEN {every} THEN {terms} ELSE 0 END"
    any_ = " OR ".join(f"f{k} > 0" for k in range(len(words)))
    return f"""{CONCEPTS}, tok AS (SELECT id, {tok} FROM concepts), tf AS (SELECT id, {length} AS length, {_tf(words)} FROM tok),
st AS (SELECT count(*) AS rows, avg(length) AS mean, {", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(n))} FROM tf), idf AS (SELECT *, {idf} FROM st),
{name} AS (SELECT id, {score} AS score FROM tf, idf WHERE {any_})"""


def _bm25(spark: SparkSession, sf_dir: str, words: str) -> DataFrame:
    return keyword.scan_bm25(concepts(spark, sf_dir), "id", words, FIELDS)


@query(f"WITH {bm25_ctes(['ing'])} SELECT id, round(score, 6) AS score FROM bm")
def bm25_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, "ing").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {bm25_ctes(['was', 'the'])} SELECT id, round(score, 6) AS score FROM bm")
def bm25_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, "was the").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {bm25_ctes(['was', 'the'])} SELECT c.id, c.workspace, round(greatest(0.01, b.score), 4) AS score FROM bm b JOIN concepts c ON c.id = b.id ORDER BY round(greatest(0.01, b.score), 4) DESC, c.id LIMIT 50")
def fts_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _bm25(spark, sf_dir, "was the").select("id", keyword.reported_score(F.col("score")).alias("score")).orderBy(F.desc("score"), "id").limit(50)
    return hits.join(concepts(spark, sf_dir).select("id", "workspace"), "id").select("id", "workspace", "score")


@query(f"WITH {CONCEPTS}, t AS (SELECT workspace, id, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS t FROM concepts) SELECT workspace, count(*) AS rows, count(*) FILTER (list_contains(t, 'and')) AS holders, round(avg(len(t)), 6) AS mean_length FROM t GROUP BY workspace")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = concepts(spark, sf_dir).select("workspace", keyword.plain_tokens(F.col("body")).alias("t"))
    return t.groupBy("workspace").agg(F.count("*").alias("rows"), F.count_if(F.array_contains("t", "and")).alias("holders"), F.round(F.avg(F.size("t")), 6).alias("mean_length"))


@query(f"WITH {CONCEPTS}, t AS (SELECT id, unnest(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+')) AS term, unnest(range(len(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+')))) AS pos FROM concepts) SELECT id, 'name' AS field, term, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM t GROUP BY id, term")
def name_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keyword.postings(keyword.tokenized(concepts(spark, sf_dir), "id", ["name"]), "id", ["name"])
    found = found.groupBy("id", "field", "term").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))  # ids may repeat
    return found.select("id", "field", "term", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query(f"WITH {bm25_ctes(['was', 'the'])} SELECT id, round(score, 6) AS score FROM bm")
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the whole store, and a search of it that reads the query's terms only: each task sorts the postings of its documents, so none is shuffled."""
    tokens = keyword.tokenized(concepts(spark, sf_dir), "id", list(FIELDS))
    index = settled(keyword.postings(tokens, "id", list(FIELDS)).sortWithinPartitions("term"), "postings")
    lengths = settled(keyword.lengths(tokens, "id", list(FIELDS)), "lengths")
    return keyword.indexed_bm25(index, lengths, "id", "was the", FIELDS).select("id", F.round("score", 6).alias("score"))


_SIM = "list_cosine_similarity(v.vector, q.vector)"
_Q0 = "(SELECT vector, workspace_id FROM vectors ORDER BY concept_id LIMIT 1) q"


def _q0(v: DataFrame) -> DataFrame:
    return v.orderBy("concept_id").limit(1).select(F.col("vector").alias("q"))


@query(f"WITH {VECTORS} SELECT v.concept_id, round({_SIM}, 4) AS score FROM vectors v, {_Q0} ORDER BY {_SIM} DESC, v.concept_id LIMIT 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return vector.nearest(v, _q0(v), 20).select("concept_id", F.round("score", 4).alias("score"))


@query(f"WITH {VECTORS} SELECT v.concept_id, round({_SIM}, 4) AS score FROM vectors v, {_Q0} WHERE v.workspace_id = 3 ORDER BY {_SIM} DESC, v.concept_id LIMIT 20")
def cosine_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return vector.nearest(v, _q0(v), 20, scope=F.col("workspace_id") == 3).select("concept_id", F.round("score", 4).alias("score"))


@query(f"WITH {VECTORS} SELECT v.concept_id, round({_SIM}, 4) AS score FROM vectors v, {_Q0} WHERE v.concept_id NOT IN (SELECT concept_id FROM vectors WHERE workspace_id IN (0, 1)) ORDER BY {_SIM} DESC, v.concept_id LIMIT 20")
def cosine_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return vector.nearest(v, _q0(v), 20, exclude=v.where("workspace_id IN (0, 1)").select("concept_id")).select("concept_id", F.round("score", 4).alias("score"))


_CENTRE = """m AS (SELECT workspace_id, pos, avg(x) AS x FROM (SELECT workspace_id, unnest(vector) AS x, unnest(range(len(vector))) AS pos FROM vectors) GROUP BY workspace_id, pos),
centre AS (SELECT workspace_id, pos, x / sqrt(sum(x * x) OVER (PARTITION BY workspace_id)) AS x FROM m), cv AS (SELECT workspace_id, list(x ORDER BY pos) AS vector FROM centre GROUP BY workspace_id)"""


@query(f"WITH {VECTORS}, {_CENTRE} SELECT workspace_id, pos, round(x, 6) AS x FROM centre")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vector.centroids(vectors(spark, sf_dir))
    return c.select("workspace_id", F.posexplode("vector").alias("p", "x")).select("workspace_id", F.col("p").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"WITH {VECTORS}, {_CENTRE} SELECT v.concept_id, round(round({_SIM.replace('q.', 'cv.')}, 6), 4) AS score, cv.workspace_id FROM vectors v, cv QUALIFY row_number() OVER (PARTITION BY v.concept_id ORDER BY round({_SIM.replace('q.', 'cv.')}, 6) DESC, cv.workspace_id) = 1")
def route_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector routed to its nearest workspace, by blocks of both, so workspaces may be as many as they like."""
    v = vectors(spark, sf_dir).select("concept_id", "vector", F.col("workspace_id").cast("long").alias("workspace_id"))
    centres = vector.centroids(v).select(F.col("workspace_id").alias("concept_id"), "vector")
    best = vector.most_similar(v, centres, 1, key="concept_id", same_id=True)
    return best.select("concept_id", F.round("score", 4).alias("score"), F.col("other").cast("int").alias("workspace_id"))


@query(f"""WITH {VECTORS}, {_CENTRE}, d AS (SELECT workspace_id, arg_min(vector, concept_id) AS vector FROM vectors GROUP BY workspace_id),
mixed AS (SELECT d.workspace_id, list_transform(range(1, len(d.vector) + 1), lambda i: 0.5::DOUBLE * d.vector[i] + 0.5::DOUBLE * cv.vector[i]) AS v FROM d JOIN cv ON cv.workspace_id = d.workspace_id)
SELECT workspace_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY workspace_id)), 6) AS x FROM (SELECT workspace_id, unnest(v) AS x, unnest(range(len(v))) AS pos FROM mixed)""")
def centroid_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    described = v.groupBy("workspace_id").agg(F.min_by("vector", "concept_id").alias("described"))
    c = vector.synced_centroids(v, described)
    return c.select("workspace_id", F.posexplode("vector").alias("p", "x")).select("workspace_id", F.col("p").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"WITH {VECTORS} SELECT concept_id, round(list_sum(list_transform(vector, lambda x: x * x)), 6) AS square, round(vector[1] / sqrt(list_sum(list_transform(vector, lambda x: x * x))), 6) AS first FROM vectors")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.select("concept_id", F.round(embed.dot(F.col("vector"), F.col("vector")), 6).alias("square"), F.round(embed.l2_normalize(F.col("vector"))[0], 6).alias("first"))


@query(f"WITH {VECTORS}, q AS (SELECT workspace_id AS label, arg_min(vector, concept_id) AS vector FROM vectors GROUP BY workspace_id) SELECT v.concept_id, q.label, round(list_inner_product(v.vector, q.vector), 4) AS score FROM vectors v JOIN q ON q.label = v.workspace_id")
def cross_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    q = v.groupBy(F.col("workspace_id").alias("label")).agg(F.min_by("vector", "concept_id").alias("q"))
    return v.join(q, v["workspace_id"] == q["label"]).select("concept_id", "label", F.round(embed.dot(F.col("vector"), F.col("q")), 4).alias("score"))


_LISTS = f"""{bm25_ctes(['was', 'the'])}, k AS (SELECT id AS concept_id, round(greatest(0.01, score), 4) AS score FROM bm ORDER BY 2 DESC, 1 LIMIT 60),
v AS (SELECT id AS concept_id, round(length(body) / 1000.0::DOUBLE, 4) AS score FROM concepts ORDER BY 2 DESC, 1 LIMIT 60)"""


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A keyword list and a list by another score, each cut at the fusion's candidate count for 20 results."""
    n = fusion.candidate_count(20)
    k = _bm25(spark, sf_dir, "was the").select(F.col("id").alias("concept_id"), keyword.reported_score(F.col("score")).alias("score")).orderBy(F.desc("score"), "concept_id").limit(n)
    v = concepts(spark, sf_dir).select(F.col("id").alias("concept_id"), F.round(F.char_length("body") / 1000.0, 4).alias("score")).orderBy(F.desc("score"), "concept_id").limit(n)
    return settled(k, "keyword-list"), v  # n rows, which several steps read


_RANKS = "kr AS (SELECT concept_id, row_number() OVER (ORDER BY score DESC, concept_id) AS r FROM k), vr AS (SELECT concept_id, row_number() OVER (ORDER BY score DESC, concept_id) AS r FROM v)"


@query(f"WITH {_LISTS}, {_RANKS} SELECT concept_id, round(sum(p) * 100, 4) AS score FROM (SELECT concept_id, 1.0::DOUBLE / (60 + r) AS p FROM kr UNION ALL SELECT concept_id, 1.0::DOUBLE / (60 + r) FROM vr) GROUP BY concept_id")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank(*_lists(spark, sf_dir))


_MM = """km AS (SELECT concept_id, (score - min(score) OVER ()) / CASE WHEN max(score) OVER () > min(score) OVER () THEN max(score) OVER () - min(score) OVER () ELSE 1 END AS f FROM k),
vm AS (SELECT concept_id, (score - min(score) OVER ()) / CASE WHEN max(score) OVER () > min(score) OVER () THEN max(score) OVER () - min(score) OVER () ELSE 1 END AS s FROM v)"""


@query(f"WITH {_LISTS}, {_MM} SELECT coalesce(a.concept_id, b.concept_id) AS concept_id, round(0.5::DOUBLE * coalesce(f, 0) + 0.5::DOUBLE * coalesce(s, 0), 4) AS score FROM km a FULL JOIN vm b ON a.concept_id = b.concept_id")
def linear_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.linear(*_lists(spark, sf_dir))


@query(f"WITH {_LISTS} SELECT coalesce(k.concept_id, v.concept_id) AS concept_id, k.score AS keyword_score, v.score AS vector_score FROM k FULL JOIN v ON k.concept_id = v.concept_id")
def fusion_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = _lists(spark, sf_dir)
    return k.withColumnRenamed("score", "keyword_score").join(v.withColumnRenamed("score", "vector_score"), "concept_id", "full_outer")


@query("SELECT event_id AS id, round((value - min(value) OVER ()) / CASE WHEN max(value) OVER () > min(value) OVER () THEN max(value) OVER () - min(value) OVER () ELSE 1 END, 6) AS score FROM events")
def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score"))
    return fusion.min_max(e, "id").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_LISTS}, {_RANKS} SELECT 'keyword' AS list, concept_id, r AS rank FROM kr UNION ALL SELECT 'vector', concept_id, r FROM vr")
def rank_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = (fusion.ranked(x).withColumn("list", F.lit(n)) for x, n in zip(_lists(spark, sf_dir), ("keyword", "vector"), strict=True))
    return k.unionByName(v).select("list", "concept_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_LISTS}, {_RANKS}, f AS (SELECT concept_id, round(sum(p) * 100, 4) AS score FROM (SELECT concept_id, 1.0::DOUBLE / (60 + r) AS p FROM kr UNION ALL SELECT concept_id, 1.0::DOUBLE / (60 + r) FROM vr) GROUP BY concept_id) SELECT concept_id, score FROM f ORDER BY score DESC, concept_id LIMIT 20")
def two_stage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank(*_lists(spark, sf_dir)).orderBy(F.desc("score"), "concept_id").limit(20)


@query(f"WITH {bm25_ctes(['was', 'the'])} SELECT id, round(CASE WHEN score > 0 THEN greatest(0.01, score) ELSE 0.5 END, 4) AS score FROM bm")
def score_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, "was the").select("id", keyword.reported_score(F.col("score")).alias("score"))


@query("""WITH d AS (SELECT l_partkey AS id, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey), t AS (SELECT max(q) AS top FROM d)
SELECT id, round(0.6::DOUBLE * greatest(0.1::DOUBLE, n / 10.0::DOUBLE) + 0.4::DOUBLE * 100 * (q / top), 4) AS score FROM d, t""")
def graph_mode_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    top = d.agg(F.max("q").alias("top"))
    return d.join(F.broadcast(top)).select("id", fusion.graph_score(F.greatest(F.lit(0.1), F.col("n") / 10.0), F.col("q"), F.col("top")).alias("score"))


_HITS = f"""{_LISTS}, {RAW}, h AS (SELECT concept_id, score FROM k ORDER BY score DESC, concept_id LIMIT 10),
r AS (SELECT 'raw:' || id AS concept_id, round(0.55::DOUBLE + least(0.35::DOUBLE, 0.02::DOUBLE * n), 4) AS score FROM (SELECT id, 5 * contains(lower(title), 'was the')::INT + (length(content) - length(replace(lower(content), 'was the', ''))) // 7 AS n FROM raw) WHERE n > 0 ORDER BY n DESC, id LIMIT 30)"""


def _tiers(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    k, _ = _lists(spark, sf_dir)
    hits = k.orderBy(F.desc("score"), "concept_id").limit(10)
    raw = rawsearch.as_hits(rawsearch.raw_search(raw_documents(spark, sf_dir), "was the", 30)).select("concept_id", "score")
    return tiered(hits, raw, limit)


@query(f"WITH {_HITS} SELECT concept_id, score FROM (SELECT 0 AS tier, * FROM h UNION ALL SELECT 1, * FROM r WHERE concept_id NOT IN (SELECT concept_id FROM h)) ORDER BY tier, score DESC, concept_id LIMIT 25")
def tiered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir, 25)


@query(f"WITH {_HITS} SELECT concept_id, score FROM r WHERE concept_id NOT IN (SELECT 'raw:doc_' || substring(concept_id, 2) FROM h)")
def raw_not_in_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, _ = _lists(spark, sf_dir)
    hits = k.orderBy(F.desc("score"), "concept_id").limit(10).select(F.concat(F.lit("raw:doc_"), F.expr("substring(concept_id, 2)")).alias("concept_id"))
    raw = rawsearch.as_hits(rawsearch.raw_search(raw_documents(spark, sf_dir), "was the", 30)).select("concept_id", "score")
    return raw.join(hits, "concept_id", "left_anti")


@query(f"""WITH {_HITS}, f AS (SELECT concept_id, round(sum(p) * 100, 4) AS score FROM (SELECT concept_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, concept_id)) AS p FROM k UNION ALL SELECT concept_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, concept_id)) FROM v) GROUP BY concept_id),
t AS (SELECT * FROM f ORDER BY score DESC, concept_id LIMIT 15) SELECT concept_id, score, matched_by FROM (SELECT 0 AS tier, *, 'hybrid_rrf' AS matched_by FROM t UNION ALL SELECT 1, *, 'raw' FROM r) ORDER BY tier, score DESC, concept_id LIMIT 30""")
def unified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fusion.reciprocal_rank(*_lists(spark, sf_dir)).orderBy(F.desc("score"), "concept_id").limit(15).withColumn("matched_by", F.lit("hybrid_rrf"))
    raw = rawsearch.as_hits(rawsearch.raw_search(raw_documents(spark, sf_dir), "was the", 30)).select("concept_id", "score", "matched_by")
    return tiered(hits, raw, 30)


def _says(terms: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(lower(anchor), '{t}') OR contains(lower(leads), '{t}')" for t in terms)


_LINKS = rf"""l AS (SELECT url AS parent, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS o, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+/([^?#]*)', 1) AS above, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
  trim(unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2))) AS anchor FROM pages),
t AS (SELECT *, split_part(above, '/', 1) AS start, trim(href, '/') AS leads, o || '/' || split_part(above, '/', 1) AS root FROM l),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(start), '[^0-9a-z가-힣]+'), lambda x: length(x) >= 2)[1:6] AS words FROM t),
s AS (SELECT parent, o || href AS url, anchor, (CASE WHEN starts_with(leads, start || '/') THEN 45 WHEN start <> '' AND contains(lower(leads), lower(start)) THEN 70 ELSE 0 END
  + CASE WHEN above <> '' AND starts_with(leads, above || '/') THEN 15 ELSE 0 END + 18 * len(list_filter(words, lambda x: contains(lower(anchor), x))) + 12 * len(list_filter(words, lambda x: contains(lower(leads), x)))
  + CASE WHEN {_says(web.CENTRAL_TERMS)} THEN 24 ELSE 0 END - CASE WHEN {_says(web.PERIPHERAL_TERMS)} THEN 120 ELSE 0 END + least(length(anchor), 40) / 8.0::DOUBLE
  - CASE WHEN anchor IN ({", ".join(f"'{x}'" for x in web.GENERIC_ANCHORS)}) THEN 25 ELSE 0 END - CASE WHEN o || href = root THEN 1000 ELSE 0 END)::DOUBLE AS score FROM w)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page, scored for a crawl that starts from the page's language folder on its own site."""
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    both = F.arrays_zip(F.regexp_extract_all("html", pattern, 1).alias("h"), F.regexp_extract_all("html", pattern, 2).alias("t"))
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("parent"), F.explode(both).alias("x"))
    rows = rows.select("parent", F.regexp_extract("parent", "^[a-zA-Z]+://[^/?#]+/[^/?#]*", 0).alias("root"), web.resolve_link(F.col("parent"), F.col("x")["h"]).alias("url"), F.trim(F.col("x")["t"]).alias("anchor"))
    return rows.withColumn("score", web.link_score(F.col("root"), F.col("parent"), F.col("url"), F.col("anchor")))


@query(f"WITH {_LINKS} SELECT DISTINCT parent, url, anchor, score FROM s")
def link_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("parent", "url", "anchor", "score").distinct()


@query(f"WITH {_LINKS} SELECT url, max(score) AS score, count(DISTINCT parent) AS parents FROM s GROUP BY url")
def frontier_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).groupBy("url").agg(F.max("score").alias("score"), F.count_distinct("parent").alias("parents"))


@query("""WITH p AS (SELECT regexp_extract(url, '://([^/:]+)', 1) AS host, page_id, length(html) AS n FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, page_id) AS place FROM p)
SELECT host, page_id, CASE WHEN place <= 9 THEN 1 WHEN place <= 17 THEN 2 WHEN place <= 25 THEN 3 ELSE 0 END AS level FROM r""")
def level_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's pages dealt to crawl levels by the quotas of a crawl of depth 3 and 26 pages."""
    quotas = crawl.level_quotas(3, 26)
    order = Window.partitionBy("host").orderBy(F.desc("n"), "page_id")
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/:]+)", 1).alias("host"), "page_id", F.char_length("html").alias("n")).withColumn("place", F.row_number().over(order))
    upto = [sum(quotas[: k + 1]) for k in range(len(quotas))]
    level = F.lit(0)
    for k in range(len(upto), 0, -1):
        level = F.when(F.col("place") <= upto[k - 1], k).otherwise(level)
    return p.select("host", "page_id", level.alias("level"))
