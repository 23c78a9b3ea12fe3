"""Graph queries over the parts' relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.scratch import settled
from .model import BULK, EDGES, NODES, bulk_edges, edges, links, nodes, table
from .registry import query

_PAIRS = "pairs AS (SELECT source_id AS a, target_id AS b FROM edges WHERE source_id <> target_id UNION SELECT target_id, source_id FROM edges WHERE source_id <> target_id)"


@query(f"WITH {EDGES} SELECT source_id AS id, 'out' AS direction, relation_type, target_id AS other, seq FROM edges UNION ALL SELECT target_id, 'in', relation_type, source_id, seq FROM edges")
def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.incident_edges(e.withColumn("reason", F.col("seq"))).withColumnRenamed("reason", "seq")


@query(f"WITH {EDGES} SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id")
def edges_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.incident_edges(edges(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES}, {_PAIRS} SELECT a, b FROM pairs")
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.undirected(edges(spark, sf_dir))


_NEIGHBOURS = """c AS (SELECT source_id, target_id, arg_max(relation_type, seq) AS relation_type FROM edges GROUP BY source_id, target_id),
i AS (SELECT source_id AS id, 'out' AS direction, relation_type, target_id AS other FROM c UNION ALL SELECT target_id, 'in', relation_type, source_id FROM c)"""


@query(f"WITH {EDGES}, {_NEIGHBOURS} SELECT id, direction, relation_type, other FROM i")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(edges(spark, sf_dir), nodes(spark, sf_dir)).select("id", "direction", "relation_type", "other")


@query(f"WITH {NODES}, {EDGES}, {_NEIGHBOURS} SELECT i.id, i.direction, i.other, coalesce(n.name, i.other) AS name FROM i LEFT JOIN (SELECT * FROM nodes WHERE type <> (SELECT max(type) FROM nodes)) n ON n.id = i.other")
def neighbor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    known = n.join(n.agg(F.max("type").alias("type")), "type", "left_anti")
    return graph.neighbours(edges(spark, sf_dir), known.select("id", "name", "type")).select("id", "direction", "other", "name")


_DEGREE = """d AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM (SELECT DISTINCT source_id, target_id FROM edges) UNION ALL SELECT target_id, 1, 0 FROM (SELECT DISTINCT source_id, target_id FROM edges)) GROUP BY id)"""


@query(f"WITH {EDGES}, {_DEGREE} SELECT id, in_degree, out_degree, degree FROM d")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(edges(spark, sf_dir))


@query(f"WITH {NODES}, {EDGES}, {_DEGREE} SELECT n.id, n.name, n.type, d.degree FROM d JOIN nodes n ON n.id = d.id ORDER BY d.degree DESC, n.id LIMIT 25")
def hubs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = graph.degrees(edges(spark, sf_dir)).select("id", "degree")
    return d.join(nodes(spark, sf_dir).select("id", "name", "type"), "id").orderBy(F.desc("degree"), "id").limit(25).select("id", "name", "type", "degree")


@query(f"WITH {NODES}, {BULK} SELECT id, name FROM nodes WHERE id NOT IN (SELECT source_id FROM edges) AND id NOT IN (SELECT target_id FROM edges)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphans(nodes(spark, sf_dir), bulk_edges(spark, sf_dir)).select("id", "name")


def _components(rounds: int = 12) -> str:
    """Labels that pass along the pairs: the least of each node's reach, by more rounds of minima than the graph has levels."""
    out = [f"{_PAIRS}, c0 AS MATERIALIZED (SELECT a AS id, least(a, min(b)) AS component FROM pairs GROUP BY a)"]
    for k in range(1, rounds + 1):
        out.append(f"c{k} AS MATERIALIZED (SELECT o.id, least(o.component, n.near) AS component FROM c{k - 1} o JOIN (SELECT p.a, min(c.component) AS near FROM pairs p JOIN c{k - 1} c ON c.id = p.b GROUP BY p.a) n ON n.a = o.id)")
    return ", ".join(out) + f", parts AS (SELECT id, component FROM c{rounds})"


@query(f"WITH {EDGES}, {_components()} SELECT id, component FROM parts")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(edges(spark, sf_dir))


@query(f"""WITH {NODES}, {EDGES}, {_components()}, v AS (SELECT id FROM nodes UNION SELECT source_id FROM edges UNION SELECT target_id FROM edges),
m AS (SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT source_id, target_id FROM edges)) AS edges, (SELECT count(DISTINCT component) FROM parts) + (SELECT count(*) FROM v WHERE id NOT IN (SELECT id FROM parts)) AS components)
SELECT nodes, edges, round(edges / (nodes * (nodes - 1.0::DOUBLE)), 4) AS density, components, round(2.0::DOUBLE * edges / nodes, 2) AS average_degree FROM m""")
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.metrics(nodes(spark, sf_dir), settled(links(spark, sf_dir), "edges"))


_ROOTS = "roots AS (SELECT id FROM nodes WHERE workspace = (SELECT min(workspace) FROM nodes))"


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return n.join(n.agg(F.min("workspace").alias("workspace")), "workspace", "left_semi").select("id")


_REACH = f"""{_PAIRS}, r1 AS (SELECT DISTINCT b AS id FROM pairs WHERE a IN (SELECT id FROM roots)), r2 AS (SELECT DISTINCT b AS id FROM pairs WHERE a IN (SELECT id FROM r1)),
seen AS (SELECT id, min(distance) AS distance FROM (SELECT id, 0 AS distance FROM roots UNION ALL SELECT id, 1 FROM r1 UNION ALL SELECT id, 2 FROM r2) GROUP BY id)"""


@query(f"WITH {NODES}, {EDGES}, {_ROOTS}, {_REACH} SELECT id, distance FROM seen")
def khop_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(edges(spark, sf_dir), _roots(spark, sf_dir), 2).select("id", "distance")


@query(f"WITH {NODES}, {EDGES}, {_ROOTS}, {_REACH} SELECT source_id, target_id, arg_max(relation_type, seq) AS relation_type FROM edges WHERE source_id IN (SELECT id FROM seen) AND target_id IN (SELECT id FROM seen) GROUP BY source_id, target_id")
def khop_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subgraph(settled(edges(spark, sf_dir), "edges"), _roots(spark, sf_dir), 2).select("source_id", "target_id", "relation_type")


@query(f"""WITH RECURSIVE {EDGES}, {_PAIRS}, hub AS (SELECT a AS id FROM pairs GROUP BY a ORDER BY count(*) DESC, a LIMIT 1),
walk AS (SELECT id, 0 AS distance FROM hub UNION SELECT p.b, w.distance + 1 FROM walk w JOIN pairs p ON p.a = w.id WHERE w.distance < 30) SELECT id, min(distance) AS distance FROM walk GROUP BY id""")
def shortest_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every node from the one of most neighbours (the SQL walks 30 steps, more than the graph has levels)."""
    e = edges(spark, sf_dir)
    pairs = settled(graph.undirected(e), "pairs")
    hub = pairs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")
    return graph.reached(pairs, hub).select("id", "distance")


def _rank_sql(rounds: int, restart: str = "1.0::DOUBLE / n") -> str:
    """PageRank unrolled: ``restart`` is the share of a node v of the n nodes, which takes the mass of nodes without neighbours as well."""
    out = [f"{NODES}, {EDGES}, {_ROOTS}, {_PAIRS}, g AS (SELECT a AS id, count(*) AS degree FROM pairs GROUP BY a), v AS (SELECT id FROM nodes UNION SELECT a FROM pairs), n AS (SELECT count(*)::DOUBLE AS n FROM v)"]
    out.append(f"r0 AS MATERIALIZED (SELECT v.id, g.degree, 1.0::DOUBLE / n AS rank, {restart} AS p FROM v LEFT JOIN g ON g.id = v.id, n)")
    for k in range(1, rounds + 1):
        out.append(
            f"r{k} AS MATERIALIZED (SELECT r.id, r.degree, 0.85::DOUBLE * coalesce(i.x, 0) + (0.15::DOUBLE + 0.85::DOUBLE * s.d) * r.p AS rank, r.p FROM r{k - 1} r LEFT JOIN (SELECT p.a AS id, sum(q.rank / q.degree) AS x FROM pairs p JOIN r{k - 1} q ON q.id = p.b GROUP BY p.a) i ON i.id = r.id,"
            f" (SELECT coalesce(sum(rank) FILTER (degree IS NULL), 0) AS d FROM r{k - 1}) s)"
        )
    return "WITH " + ", ".join(out) + f" SELECT id, round(rank / sum(rank) OVER (), 10) AS rank FROM r{rounds}"


@query(_rank_sql(20))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = settled(links(spark, sf_dir), "edges"), nodes(spark, sf_dir)
    return graph.pagerank(graph.vertices_of(n, e), e, rounds=20).select("id", F.round("rank", 10).alias("rank"))


@query(_rank_sql(20, "CASE WHEN v.id IN (SELECT id FROM roots) THEN 1.0::DOUBLE / (SELECT count(*) FROM roots) ELSE 0 END"))
def ppr_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personalised ranks around the nodes of the first workspace."""
    e, n = settled(links(spark, sf_dir), "edges"), nodes(spark, sf_dir)
    seeds = _roots(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return graph.pagerank(graph.vertices_of(n, e), e, seeds, rounds=20).select("id", F.round("rank", 10).alias("rank"))


@query()
def pagerank_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks until they settle."""
    return graph.hubs(nodes(spark, sf_dir), settled(links(spark, sf_dir), "edges"), 20)


@query()
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sparse graph of bulk orders: exact betweenness searches from every node, so a dense graph costs nodes times links."""
    e, n = settled(bulk_edges(spark, sf_dir), "edges"), nodes(spark, sf_dir)
    return graph.betweenness(graph.vertices_of(n, e), e).select("id", F.round("score", 8).alias("score"))


@query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = settled(links(spark, sf_dir), "edges"), nodes(spark, sf_dir)
    v = graph.vertices_of(n, e)
    return graph.numbered_communities(v, e, graph.communities(v, e))


_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(name || ' ' || type), '[a-z0-9]{3,}'), lambda x: x NOT IN ('the', 'and', 'for', 'with', 'from', 'that', 'this', 'into', 'via', 'concept', 'using', 'used', 'based', 'their', 'which', 'are', 'all', 'auto_extracted')))"
_SETS = f"""{NODES}, {BULK}, own AS (SELECT 'p' || p_partkey AS id, p_partkey AS key, p_name || ' ' || p_type AS name, p_brand || ' size' || p_size AS type FROM part), sets AS (SELECT id, key, {_TOKENS} AS t FROM own),
sim AS (SELECT a.id, b.id AS other, round(len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t))::DOUBLE, 6) AS score FROM seeking s JOIN sets a ON a.id = s.id JOIN sets b ON a.id <> b.id),
best AS (SELECT id, other, score FROM sim WHERE score >= 0.04 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) = 1)"""


def _part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand", F.concat(F.lit("size"), "p_size")).alias("text"))


@query(f"WITH {_SETS.replace('sim AS', 'seeking AS (SELECT id FROM sets WHERE key % 100 = 0), sim AS')} SELECT id, other, score FROM best")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar of all parts for every part whose key is divisible by 100."""
    texts = _part_texts(spark, sf_dir)
    return graph.similar_pairs(texts, seeking=texts.where(F.expr("CAST(substring(id, 2) AS bigint) % 100 = 0"))).select("id", "other", "score")


@query(f"""WITH {_SETS.replace('sim AS', 'seeking AS (SELECT id FROM sets WHERE id NOT IN (SELECT source_id FROM edges) AND id NOT IN (SELECT target_id FROM edges)), sim AS')},
turns AS (SELECT list_reduce(list({{'stands': [id], 'taken': [other]}} ORDER BY id), lambda done, x: CASE WHEN list_contains(done.taken, x.stands[1]) THEN done ELSE {{'stands': done.stands || x.stands, 'taken': done.taken || x.taken}} END) AS done FROM best)
SELECT id AS source_id, 'similar' AS relation_type, other AS target_id, score FROM best WHERE list_contains((SELECT done.stands FROM turns), id)""")
def inferred_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts without any relation in bulk orders, one after the other tied to the most similar of all parts (the SQL folds over the list of them)."""
    return graph.inferred_edges(_part_texts(spark, sf_dir), bulk_edges(spark, sf_dir))
