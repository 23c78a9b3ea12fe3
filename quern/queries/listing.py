"""Listing, counting, looking up and changing the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, keyword
from ..plans.engine import ALIASES, resolve_workspaces, workspace_list
from ..schema import CONCEPT
from ..sources import snapshots
from .model import CONCEPTS, EDGES, NODES, RAW, VECTORS, concepts, edges, nodes, raw_documents, table, vectors
from .registry import query


@query("""SELECT (SELECT count(*) FROM documents) AS concepts, (SELECT count(*) FROM lineitem) AS relations, (SELECT count(*) FROM pages) AS pages,
  (SELECT count(*) FROM events) AS logs, (SELECT count(*) FROM embeddings) AS vectors""")
def stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [table(spark, sf_dir, t).agg(F.count("*").alias(n)) for t, n in (("documents", "concepts"), ("lineitem", "relations"), ("pages", "pages"), ("events", "logs"), ("embeddings", "vectors"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(c)  # one row each
    return out


@query("SELECT lang AS workspace, count(*) AS concept_count, count(DISTINCT source) AS sources, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def workspace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("workspace")).agg(F.count("*").alias("concept_count"), F.count_distinct("source").alias("sources"), F.sum(F.char_length("text")).alias("chars"))


@query("SELECT lang AS workspace, 'c' || doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents")
def concepts_by_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = concepts(spark, sf_dir)
    return c.select("workspace", "id", F.row_number().over(Window.partitionBy("workspace").orderBy("seq")).alias("place"))


@query(f"""WITH {RAW}, sources AS (SELECT 'c' || doc_id AS concept_id, CASE WHEN n_chars % 2 = 0 THEN 'raw:doc_' || doc_id ELSE source END AS source_uri FROM documents)
SELECT s.concept_id, s.source_uri, r.title, r.char_count FROM sources s LEFT JOIN raw r ON s.source_uri = 'raw:' || r.id""")
def sources_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    s = d.select(F.concat(F.lit("c"), "doc_id").alias("concept_id"), F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("raw:doc_"), "doc_id")).otherwise(F.col("source")).alias("source_uri"))
    r = raw_documents(spark, sf_dir).select(F.concat(F.lit("raw:"), "id").alias("source_uri"), "title", "char_count")
    return s.join(r, "source_uri", "left").select("concept_id", "source_uri", "title", "char_count")


@query("SELECT 's' || s.s_suppkey AS id, s.s_name AS name, greatest(count(l.l_orderkey), 1) AS sources_count FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'R' GROUP BY ALL")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "supplier").join(back, "s_suppkey", "left").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("sources_count"))


@query(f"WITH {RAW} SELECT id, title, source_uri, char_count FROM raw ORDER BY seq DESC LIMIT 50")
def recent_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_documents(spark, sf_dir).orderBy(F.desc("seq")).limit(50).select("id", "title", "source_uri", "char_count")


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, user_id AS caller, event_type AS action FROM events ORDER BY event_id DESC LIMIT 50")
def recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(50)
    return e.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("user_id").alias("caller"), F.col("event_type").alias("action"))


@query("SELECT event_id AS id, (props::JSON ->> 'k')::BIGINT AS k, to_json({'action': event_type, 'k': (props::JSON ->> 'k')::BIGINT})::VARCHAR AS details FROM events")
def log_details_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("action"), k.alias("k"))).alias("details"))


@query("SELECT event_type AS action, count(*) AS n, count(DISTINCT user_id) AS callers, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def logs_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("callers"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH asked AS (SELECT DISTINCT s.name FROM (SELECT n_name AS name FROM nation UNION SELECT lower(n_name) FROM nation UNION SELECT n_nationkey::VARCHAR FROM nation UNION SELECT 'all' UNION SELECT 'typemoon') s)
SELECT a.name, CASE WHEN a.name = 'all' THEN NULL ELSE coalesce((SELECT min(n_nationkey)::VARCHAR FROM nation n WHERE n.n_nationkey::VARCHAR = a.name OR lower(n.n_name) = lower(a.name)), a.name) END AS workspace_id FROM asked a""")
def resolve_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    asked = n.select("name").union(n.select(F.lower("name"))).union(n.select("id")).union(spark.createDataFrame([("all",), ("typemoon",)], "name string")).distinct()
    return resolve_workspaces(asked, n, spark.createDataFrame(list(ALIASES.items()), "alias string, other string"))


@query("""SELECT c.lang AS id, c.n AS concept_count, coalesce(r.n, 0) AS raw_count FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) c
LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) r ON r.lang = c.lang""")
def workspace_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = concepts(spark, sf_dir)
    return workspace_list(c.select(F.col("workspace").alias("id")).distinct(), c, raw_documents(spark, sf_dir))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def stale_left_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(back, "id", "left_anti")


@query(f"""WITH {EDGES} SELECT DISTINCT a.source_id, a.target_id, a.relation_type, EXISTS (SELECT 1 FROM edges b WHERE b.source_id = a.target_id AND b.target_id = a.source_id AND b.relation_type = a.relation_type) AS has_reverse
FROM edges a""")
def edge_exists_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).select("source_id", "target_id", "relation_type").distinct()
    back = e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relation_type", F.lit(True).alias("b"))
    return e.join(back, ["source_id", "target_id", "relation_type"], "left").select("source_id", "target_id", "relation_type", F.col("b").isNotNull().alias("has_reverse"))


@query(f"WITH {RAW} SELECT id, title FROM raw WHERE contains(lower(concat_ws(' ', title, id, source_uri)), 'src1')")
def raw_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_documents(spark, sf_dir).where(F.contains(F.lower(F.concat_ws(" ", "title", "id", "source_uri")), F.lit("src1"))).select("id", "title")


@query(f"WITH {CONCEPTS} SELECT id, workspace, 1.0::DOUBLE AS score FROM concepts WHERE contains(lower(name), 'the') OR contains(lower(summary), 'the') OR contains(lower(id), 'the')")
def like_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.like_search(concepts(spark, sf_dir), "the").select("id", "workspace", "score")


@query(f"""WITH {VECTORS}, named AS (SELECT p_partkey AS concept_id, p_name AS name, p_type AS type FROM part)
SELECT v.concept_id, v.workspace_id, len(v.vector) AS dim, n.name, n.type FROM vectors v JOIN named n ON n.concept_id = v.concept_id""")
def vector_meta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    v = vectors(spark, sf_dir).select("concept_id", "workspace_id", F.size("vector").cast("long").alias("dim"))
    return v.join(named, "concept_id")


@query(f"WITH {NODES}, {EDGES} SELECT n.workspace, count(*) AS relations FROM edges e JOIN nodes n ON n.id = e.source_id GROUP BY n.workspace")
def relations_in_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).select(F.col("id").alias("source_id"), "workspace")
    return edges(spark, sf_dir).join(n, "source_id").groupBy("workspace").agg(F.count("*").alias("relations"))


@query(f"""WITH {NODES}, {EDGES}, chosen AS (SELECT id FROM nodes WHERE type IN (SELECT min(type) FROM nodes UNION SELECT max(type) FROM nodes))
SELECT source_id, relation_type, target_id, seq FROM edges WHERE source_id IN (SELECT id FROM chosen) AND target_id IN (SELECT id FROM chosen)""")
def edges_in_nodeset(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    ends = n.agg(F.array(F.min("type"), F.max("type")).alias("t")).select(F.explode("t").alias("type")).distinct()
    chosen = n.join(ends, "type", "left_semi").select("id")
    e = edges(spark, sf_dir).join(chosen.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(chosen.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return e.select("source_id", "relation_type", "target_id", "seq")


@query(f"""WITH {RAW}, cited AS (SELECT 'c' || doc_id AS id, unnest(['raw:doc_' || doc_id, source]) AS s FROM documents)
SELECT c.id, left(r.content, 2000) AS excerpt FROM cited c JOIN raw r ON c.s = 'raw:' || r.id""")
def raw_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    cited = d.select(F.concat(F.lit("c"), "doc_id").alias("id"), F.explode(F.array(F.concat(F.lit("raw:doc_"), "doc_id"), F.col("source"))).alias("s")).where(F.startswith("s", F.lit("raw:")))
    r = raw_documents(spark, sf_dir).select(F.concat(F.lit("raw:"), "id").alias("s"), F.left("content", F.lit(2000)).alias("excerpt"))
    return cited.join(r, "s").select("id", "excerpt")


@query("SELECT host, count(*) AS pages, sum(length(html))::BIGINT AS chars FROM (SELECT regexp_extract(url, '://([^/:]+)', 1) AS host, html FROM pages) GROUP BY host")
def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/:]+)", 1).alias("host"), "html")
    return p.groupBy("host").agg(F.count("*").alias("pages"), F.sum(F.char_length("html")).alias("chars"))


@query("SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def stale_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    ids = {f: line.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("id")) for f in "RA"}
    return ids["R"].distinct().join(ids["A"], "id", "left_anti")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS workspace FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def prune_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("workspace"))
    return snapshots.only_ids(c, table(spark, sf_dir, "orders").select("o_custkey"), "id")


@query("""WITH base AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders),
new AS (SELECT l_orderkey AS id, 'X' AS status, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT * FROM base WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.lit("X").alias("status"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return snapshots.upsert(base, new, "id")


@query(f"""WITH {EDGES}, base AS (SELECT * FROM edges WHERE relation_type <> 'R'), new AS (SELECT *, least(source_id, target_id) AS low, greatest(source_id, target_id) AS high FROM edges WHERE relation_type = 'R' AND source_id <> target_id),
asked AS (SELECT 'A' AS relation_type, low, high, arg_min(source_id, seq) AS source_id, arg_min(target_id, seq) AS target_id, min(seq) AS seq FROM new GROUP BY low, high)
SELECT a.source_id, a.relation_type, a.target_id, a.seq FROM asked a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.relation_type = a.relation_type AND least(b.source_id, b.target_id) = a.low AND greatest(b.source_id, b.target_id) = a.high)""")
def add_edge_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    new = e.where("relation_type = 'R'").withColumn("relation_type", F.lit("A"))
    return snapshots.add_edges_if_absent(e.where("relation_type != 'R'"), new).select("source_id", "relation_type", "target_id", "seq")


@query("SELECT 'c' || doc_id AS id, CASE WHEN lang = 'es' THEN 'default' ELSE lang END AS workspace FROM documents")
def workspace_delete_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.moved_to_default(concepts(spark, sf_dir), "es", "workspace").select("id", "workspace")


@query("""WITH a AS (SELECT l_orderkey AS id, list(l_returnflag ORDER BY l_linenumber, l_returnflag, l_linestatus) AS x, list(l_linestatus || l_returnflag ORDER BY l_linenumber, l_returnflag, l_linestatus) AS y FROM lineitem GROUP BY l_orderkey),
u AS (SELECT id, v, min(i) AS i FROM (SELECT id, unnest(list_concat(x, y)) AS v, unnest(range(len(x) + len(y))) AS i FROM a) GROUP BY id, v)
SELECT id, string_agg(v, ',' ORDER BY i) AS merged FROM u GROUP BY id""")
def merge_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", F.concat("l_linestatus", "l_returnflag").alias("y"))))
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(rows.alias("r"))
    return a.select("id", F.array_join(snapshots.merged_lists(F.transform("r", lambda r: r["l_returnflag"]), F.transform("r", lambda r: r["y"])), ",").alias("merged"))


@query("""WITH a AS (SELECT l_orderkey AS id, list(DISTINCT l_returnflag) AS have, list(DISTINCT l_linestatus) AS new FROM lineitem GROUP BY l_orderkey)
SELECT id::VARCHAR AS id, len(have) AS n_have, len(list_distinct(have || new)) AS n_merged FROM a""")
def append_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's return flags as a concept's tags, its line states merged in."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.collect_set("l_returnflag").alias("have"), F.collect_set("l_linestatus").alias("new"))
    blank = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in CONCEPT.fields} | {"id": F.col("id")}
    empty = F.array().cast(CONCEPT["relations"].dataType).alias("relations")
    base, new = (a.select(*[(blank | {"tags": F.col(c).alias("tags"), "relations": empty, "workspace": F.lit("w").alias("workspace")})[f.name] for f in CONCEPT.fields]) for c in ("have", "new"))
    merged = snapshots.merge_concepts(base, new).select("id", F.size("tags").cast("long").alias("n_merged"))
    return merged.join(a.select("id", F.size("have").cast("long").alias("n_have")), "id")


@query(f"""WITH {EDGES}, changed AS (SELECT DISTINCT source_id AS id FROM edges WHERE relation_type = 'R'), kept AS (SELECT source_id, relation_type, target_id, seq FROM edges WHERE source_id NOT IN (SELECT id FROM changed)),
own AS (SELECT source_id, 'new' AS relation_type, target_id, max(seq) AS seq FROM edges WHERE relation_type = 'R' AND source_id <> target_id GROUP BY source_id, target_id)
SELECT * FROM kept UNION ALL SELECT * FROM own""")
def upsert_concept_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).select("source_id", "relation_type", "target_id", "seq")
    changed = e.where("relation_type = 'R'")
    own = changed.where("source_id != target_id").groupBy("source_id", "target_id").agg(F.max("seq").alias("seq")).withColumn("relation_type", F.lit("new"))
    return snapshots.replace_children(e, own.select(*e.columns), "source_id", changed.select("source_id"))


@query(f"""WITH {NODES}, {EDGES}, gone AS (SELECT id FROM nodes WHERE workspace IN (SELECT max(workspace) FROM nodes))
SELECT source_id, relation_type, target_id, seq FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)""")
def delete_concept_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    gone = n.join(n.agg(F.max("workspace").alias("workspace")), "workspace", "left_semi").select("id")
    e = edges(spark, sf_dir)
    return snapshots.without_ids(snapshots.without_ids(e, gone, "source_id"), gone, "target_id").select("source_id", "relation_type", "target_id", "seq")


@query("""WITH gone AS (SELECT 'raw:doc_' || doc_id AS s FROM documents WHERE lang = 'fr'), cited AS (SELECT 'c' || doc_id AS id, ['raw:doc_' || doc_id, source] AS s FROM documents)
SELECT id, array_to_string(CASE WHEN s[1] IN (SELECT s FROM gone) THEN s[2:] ELSE s END, ',') AS sources FROM cited""")
def delete_raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    cited = d.select(F.concat(F.lit("c"), "doc_id").alias("id"), F.array(F.concat(F.lit("raw:doc_"), "doc_id"), F.col("source")).alias("sources"))
    gone = d.where("lang = 'fr'").select(F.concat(F.lit("raw:doc_"), "doc_id").alias("s"))
    return snapshots.without_members(cited, gone, "sources").select("id", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {EDGES} SELECT source_id, target_id, arg_max(relation_type, seq) AS relation_type, arg_max(reason, seq) AS reason FROM edges GROUP BY source_id, target_id")
def collapsed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.collapsed_edges(edges(spark, sf_dir))


@query("""SELECT source, concept_count, rank() OVER (ORDER BY concept_count DESC, source) AS place FROM (SELECT source, count(*) AS concept_count FROM documents GROUP BY source)""")
def source_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("concept_count"))
    return n.withColumn("place", F.rank().over(Window.orderBy(F.desc("concept_count"), "source")))  # a row for each source


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2")
def logs_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the audit log rolled up by hour."""
    return table(spark, sf_dir, "events").groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"), F.col("event_type").alias("action")).agg(F.count("*").alias("n"))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role")
def dialogue_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.char_length("text")).alias("chars"))
