"""The store's interface: search, ingest, graph, listing and maintenance over versioned tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import embeddings
from ..functions.text import file_key, workspace_slug
from ..operators import fusion, graph, keyword, rawsearch, vector
from ..schema import BATCH, CONCEPT, EDGE, LENGTH, LINK, POSTING, QUERY_LOG, RAW_DOCUMENT, SEARCH_RESULT, VECTOR, WORKSPACE
from ..sources import readers, snapshots
from ..sources.scratch import settled
from ..sources.snapshots import Table

#: Other names by which workspaces are asked for.
ALIASES = {"typemoon": "타입문", "타입문": "typemoon", "type_moon": "타입문"}


def resolve_workspaces(names: DataFrame, workspaces: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, workspace_id): null for all, else the workspace of that id, of that id or name in any case, of its alias, or the name itself."""
    asked = names.select("name", F.trim("name").alias("q"))
    exact = workspaces.select(F.col("id").alias("q"), "id", F.lit(1).alias("rank"))
    either = workspaces.select(F.lower("id").alias("low"), "id").union(workspaces.select(F.lower("name"), "id"))
    meant = asked.select("name", F.lower("q").alias("alias")).join(aliases, "alias").select("name", F.lower("other").alias("low"))
    hits = asked.join(exact, "q").select("name", "id", "rank")
    hits = hits.union(asked.select("name", F.lower("q").alias("low")).join(either, "low").select("name", "id", F.lit(2).alias("rank")))
    hits = hits.union(meant.join(either, "low").select("name", "id", F.lit(3).alias("rank")))
    hits = hits.groupBy("name").agg(F.min(F.struct("rank", "id"))["id"].alias("found"))
    every = F.col("name").isNull() | F.trim(F.coalesce("name", F.lit(""))).isin("", "all", "*")
    return names.join(hits, "name", "left").select("name", F.when(~every, F.coalesce("found", "name")).alias("workspace_id"))


def workspace_list(workspaces: DataFrame, concepts: DataFrame, raw: DataFrame) -> DataFrame:
    """Workspaces by id with their numbers of concepts and raw documents."""
    c = concepts.groupBy(F.col("workspace").alias("id")).agg(F.count("*").alias("concept_count"))
    r = raw.groupBy(F.col("workspace_id").alias("id")).agg(F.count("*").alias("raw_count"))
    out = workspaces.join(c, "id", "left").join(r, "id", "left")
    return out.withColumn("concept_count", F.coalesce("concept_count", F.lit(0))).withColumn("raw_count", F.coalesce("raw_count", F.lit(0))).orderBy("id")


def tiered(hits: DataFrame, raw_hits: DataFrame, limit: int) -> DataFrame:
    """Concept hits in their order, then raw hits whose id is not there yet, cut at ``limit``."""
    rest = raw_hits.join(hits.select("concept_id"), "concept_id", "left_anti")
    both = hits.withColumn("tier", F.lit(0)).unionByName(rest.withColumn("tier", F.lit(1)))
    return both.orderBy("tier", F.desc("score"), "concept_id").limit(limit).drop("tier")


def card_text() -> Column:
    """What of a concept is embedded for search."""
    return F.concat_ws(" ", "name", F.concat_ws(" ", "aliases"), F.concat_ws(" ", "tags"), "summary", F.concat_ws(" ", "mechanisms"))


def searched_fields(concepts: DataFrame) -> DataFrame:
    """Concepts with the body that keyword search reads."""
    return concepts.withColumn("body", F.concat_ws(" ", F.concat_ws(" ", "mechanisms"), F.concat_ws(" ", "formulas_or_code")))


class Engine:
    """Tables under one folder: concepts, edges, raw documents, workspaces, vectors, the keyword index and the log. Results are DataFrames.

    ``embed`` is an embedder of texts, called in the tasks; the hashing one stands in where it fails or none is given. The large tables are dealt into ``parts``
    by their ids, the index by its documents', and a change rewrites the parts of what it changes.
    """

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[list[str]], list[list[float]]] | None = None, *, parts: int = 16) -> None:
        self.spark, self.embed = spark, embed
        made = {"concepts": CONCEPT, "edges": EDGE, "raw_documents": RAW_DOCUMENT, "workspaces": WORKSPACE, "query_logs": QUERY_LOG}
        keys = {"concepts": "id", "edges": "source_id", "raw_documents": "id"}
        self.tables = {name: Table(spark, f"{path}/{name}", schema, key=keys.get(name), parts=parts) for name, schema in made.items()}
        self.vectors = Table(spark, f"{path}/vectors", VECTOR, key="concept_id", parts=parts)
        self.postings = Table(spark, f"{path}/postings", POSTING, sorted_by="term", key="id", parts=parts)
        self.lengths = Table(spark, f"{path}/lengths", LENGTH, key="id", parts=parts)
        self.links, self.batches = Table(spark, f"{path}/links", LINK, sorted_by="a"), Table(spark, f"{path}/batches", BATCH)

    def concepts(self, workspace: str | None = None) -> DataFrame:
        rows, ws = self.tables["concepts"].read(), self.resolve(workspace)
        return rows if ws is None else rows.where(F.col("workspace") == ws)

    def concept(self, concept_id: str) -> DataFrame:
        """The concept of that id, if there is one; ids are compared as card files are named."""
        return self.tables["concepts"].read().where(file_key(F.col("id")) == file_key(F.lit(concept_id)))

    def markdown(self, concept_id: str) -> DataFrame:
        """(id, markdown): its card."""
        return readers.cards(self.concept(concept_id))

    def edges(self) -> DataFrame:
        return self.tables["edges"].read()

    def linked(self) -> DataFrame:
        """The undirected links with their degrees, sorted by their first end: made by the first search after a change of the edges, and kept."""
        stamp = self.tables["edges"].stamp()
        kept = self.links.read()
        if kept.where(F.col("stamp") == stamp).isEmpty():
            self.links.write(graph.linked(self.edges()).withColumn("stamp", F.lit(stamp)))
            kept = self.links.read()
        return kept.drop("stamp")

    def raw(self, workspace: str | None = None) -> DataFrame:
        rows, ws = self.tables["raw_documents"].read(), self.resolve(workspace)
        return rows if ws is None else rows.where(F.col("workspace_id") == ws)

    def raw_text(self, doc_id: str) -> str:
        """A raw document's content; empty if there is none of that id."""
        row = self.tables["raw_documents"].read().where(F.col("id") == doc_id).select("content").first()
        return (row["content"] or "") if row else ""

    def resolve(self, workspace: str | None) -> str | None:
        asked = self.spark.createDataFrame([(workspace,)], "name string")
        aliases = self.spark.createDataFrame(list(ALIASES.items()), "alias string, other string")
        row = resolve_workspaces(asked, self.tables["workspaces"].read(), aliases).first()
        return row["workspace_id"] if workspace else None

    def create_workspace(self, ws_id: str, name: str, description: str = "", tags: list[str] | None = None) -> str:
        row = self.spark.createDataFrame([(ws_id or name, name)], "raw string, name string").select(workspace_slug(F.col("raw")).alias("id"), F.trim("name").alias("name"))
        row = row.select("id", F.when(F.col("name") == "", F.col("id")).otherwise(F.col("name")).alias("name"), F.lit(description.strip()).alias("description"), F.lit(tags or []).cast("array<string>").alias("tags"), F.lit(None).cast("array<double>").alias("vector"), F.current_timestamp().cast("string").alias("updated_at"))
        old = self.tables["workspaces"].read()
        row = row.join(old.select("id", "created_at"), "id", "left").withColumn("created_at", F.coalesce("created_at", "updated_at"))
        found = row.first()["id"]
        if not found:
            raise ValueError("a workspace needs a name with a word character")
        self.tables["workspaces"].write(snapshots.upsert(old, row, "id"))
        self.sync_centroids(self.spark.createDataFrame([(found,)], "id string"))
        return found

    def delete_workspace(self, ws_id: str) -> bool:
        """Its concepts, vectors and raw documents go to the default workspace; False for the default itself."""
        if ws_id == "default":
            return False
        self.tables["workspaces"].write(self.tables["workspaces"].read().where(F.col("id") != ws_id))
        for t, column in ((self.tables["concepts"], "workspace"), (self.tables["raw_documents"], "workspace_id"), (self.vectors, "workspace_id")):
            t.change(t.read().where(F.col(column) == ws_id).select(t.key), lambda old, column=column: snapshots.moved_to_default(old, ws_id, column))
        self.sync_centroids(self.spark.createDataFrame([("default",)], "id string"))
        return True

    def sync_centroids(self, only: DataFrame | None = None) -> None:
        """Store the centroids of the workspaces in ``only`` (id), or of all: half their description, half the mean of their members' vectors."""
        spaces = self.tables["workspaces"].read()
        stale = spaces if only is None else snapshots.only_ids(spaces, only, "id")
        text = F.concat_ws("\n", "name", "description", F.concat_ws(" ", "tags"))
        described = embeddings(stale.select("id", text.alias("text")), "id", "text", self.embed).select(F.col("id").alias("workspace_id"), F.col("vector").alias("described"))
        dims = described.select("workspace_id", F.size("described").alias("dim"))
        members = self.vectors.read().drop("dim").join(dims, "workspace_id").where(F.size("vector") == F.col("dim"))
        made = vector.synced_centroids(members, described).select(F.col("workspace_id").alias("id"), F.col("vector").alias("centroid"))
        self.tables["workspaces"].write(spaces.join(made, "id", "left").withColumn("vector", F.coalesce("centroid", "vector")).drop("centroid"))

    def _next(self, rows: DataFrame, column: str) -> int:
        return rows.agg(F.coalesce(F.max(column), F.lit(-1))).first()[0] + 1

    def _save_number(self) -> int:
        """The first seq of the next save: each has 2**32 of them, so that the last relation is that of the last save."""
        return (self._next(self.edges(), "seq") + (1 << 32) - 1) >> 32 << 32

    def save_concepts(self, new: DataFrame) -> None:
        """Replace concepts by id, with their own edges, vectors and index entries, and sync their workspaces' centroids; edges that the engine added stay."""
        ids, first = settled(new.select("id").distinct(), "saved-ids"), self._save_number()
        own = new.select(F.col("id").alias("source_id"), F.posexplode("relations").alias("nth", "r")).select("source_id", F.col("r.type").alias("relation_type"), F.col("r.target").alias("target_id"), F.col("r.reason").alias("reason"), "nth")
        own = own.where((F.col("target_id") != "") & (F.col("target_id") != F.col("source_id"))).select("*", F.lit("card").alias("origin"), (F.lit(first) + F.col("nth")).alias("seq")).drop("nth")
        indexed = embeddings(new.select("id", card_text().alias("text")), "id", "text", self.embed)
        rows = indexed.join(new.select("id", "workspace", "updated_at"), "id").select(F.col("id").alias("concept_id"), "model_name", F.size("vector").alias("dim"), "vector", F.col("workspace").alias("workspace_id"), "updated_at")
        fields = list(keyword.FIELD_WEIGHTS)
        tokens = settled(keyword.tokenized(searched_fields(new), "id", fields, stem=True), "tokens")
        self.postings.change(ids, lambda old: snapshots.replace_children(old, keyword.postings(tokens, "id", fields), "id", ids))
        self.lengths.change(ids, lambda old: snapshots.upsert(old, keyword.lengths(tokens, "id", fields), "id"))
        self.vectors.change(ids, lambda old: snapshots.upsert(old, rows, "concept_id"))
        self.tables["edges"].change(ids, lambda old: old.where("origin = 'auto'").unionByName(snapshots.without_ids(old.where("origin = 'card'"), ids, "source_id")).unionByName(own))
        self.tables["concepts"].change(ids, lambda old: snapshots.upsert(old, new, "id"))
        self.sync_centroids(new.select(F.col("workspace").alias("id")).distinct())

    def delete_concepts(self, ids: DataFrame) -> None:
        """Without the concepts, their edges, vectors and index entries, and without others' relations to them."""
        ids = settled(ids.select(F.col(ids.columns[0]).alias("id")), "deleted")
        into = snapshots.only_ids(self.edges(), ids, "target_id").select(F.col("source_id").alias("id"))
        self.tables["edges"].change(settled(ids.union(into).distinct(), "edge-ids"), lambda old: snapshots.without_ids(snapshots.without_ids(old, ids, "source_id"), ids, "target_id"))
        self.vectors.change(ids, lambda old: snapshots.without_ids(old, ids, "concept_id"))
        for t in (self.postings, self.lengths):
            t.change(ids, lambda old: snapshots.without_ids(old, ids, "id"))
        related = self.tables["concepts"].read().select("id", F.explode("relations").alias("r")).select("id", F.col("r.target").alias("target"))
        changed = settled(ids.union(snapshots.only_ids(related, ids, "target").select("id")).distinct(), "changed-ids")
        self.tables["concepts"].change(changed, lambda old: snapshots.without_members(snapshots.without_ids(old, ids, "id"), ids, "relations", "target"))

    def prune(self, valid: DataFrame) -> None:
        stale = self.tables["concepts"].read().select("id").join(valid.select(F.col(valid.columns[0]).alias("id")), "id", "left_anti")
        self.delete_concepts(stale)

    def add_edges(self, new: DataFrame) -> None:
        """Edges (source_id, relation_type, target_id, reason) that stand in neither direction yet; of equal ones the first by its ends and reason."""
        first = self._save_number()
        made = new.select("source_id", "relation_type", "target_id", "reason", F.lit("auto").alias("origin"), (F.lit(first) + F.pmod(F.xxhash64("source_id", "target_id", "reason"), F.lit(1 << 31))).alias("seq"))
        self.tables["edges"].append(settled(snapshots.add_edges_if_absent(self.edges(), made), "new-edges"))

    def save_raw(self, docs: DataFrame) -> None:
        self.tables["raw_documents"].change(docs.select("id"), lambda old: snapshots.upsert(old, docs, "id"))

    def delete_raw(self, ids: DataFrame) -> None:
        """Without the documents, and without concepts' references to them."""
        ids = settled(ids.select(F.col(ids.columns[0]).alias("id")), "deleted")
        self.tables["raw_documents"].change(ids, lambda old: snapshots.without_ids(old, ids, "id"))
        gone = ids.select(F.concat(F.lit("raw:"), "id").alias("source"))
        cited = self.tables["concepts"].read().select("id", F.explode("sources").alias("source"))
        changed = settled(snapshots.only_ids(cited, gone, "source").select("id").distinct(), "changed-ids")
        self.tables["concepts"].change(changed, lambda old: snapshots.without_members(old, gone, "sources"))

    def export_graph(self, path: str, workspace: str | None = None) -> None:
        """Nodes and edges of a workspace (all without one) as JSON lines, a folder each: what a display of the graph reads.

        Nodes have the number of their sources, at least 1. Those without any edge there are tied to their most similar node, one after the other in the
        order of ids; such edges are marked as inferred and shown only.
        """
        summary = F.coalesce("summary", F.lit(""))
        nodes = self.concepts(workspace).select("id", "name", "type", summary.alias("summary"), "tags", "workspace", F.greatest(F.size(F.coalesce("sources", F.array())), F.lit(1)).alias("sources_count"))
        nodes = settled(nodes, "shown-nodes")
        ids = nodes.select("id")
        links = settled(snapshots.only_ids(snapshots.only_ids(graph.collapsed_edges(self.edges()), ids, "source_id"), ids, "target_id"), "shown-edges")
        texts = nodes.select("id", F.concat_ws(" ", "name", "summary", F.concat_ws(" ", "tags")).alias("text"))
        inferred = graph.inferred_edges(texts, links).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation_type").alias("type"), F.lit("similar content").alias("reason"), F.lit(True).alias("inferred"))
        nodes.write.mode("overwrite").json(f"{path}/nodes")
        shown = links.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation_type").alias("type"), "reason", F.lit(False).alias("inferred"))
        shown.unionByName(inferred).write.mode("overwrite").json(f"{path}/edges")

    def _query_vector(self, query: str) -> DataFrame:
        asked = self.spark.createDataFrame([("q", query.strip())], "id string, text string")
        return embeddings(asked, "id", "text", self.embed).select(F.col("vector").alias("q"))

    def route(self, query: str, k: int = 3) -> DataFrame:
        """(workspace_id, score): the workspaces whose stored centroid is nearest; the default one for a blank query or without any."""
        default = self.spark.createDataFrame([("default", 1.0)], "workspace_id string, score double")
        if not query.strip():
            return default
        spaces = self.tables["workspaces"].read()
        if spaces.where("vector IS NOT NULL").isEmpty():
            self.sync_centroids()
            spaces = self.tables["workspaces"].read()
        found = vector.route(spaces.where("vector IS NOT NULL").select(F.col("id").alias("workspace_id"), "vector"), self._query_vector(query), k)
        found = settled(found, "routed")  # k rows
        return default if found.isEmpty() else found

    def search(self, query: str, mode: str = "hybrid", limit: int = 5, workspace: str = "all") -> DataFrame:
        """SEARCH_RESULT rows: keyword, vector, graph or hybrid, then raw documents if there is room."""
        scope = workspace
        if workspace == "auto":
            spaces = self.tables["workspaces"].read().limit(2).count()
            scope = self.route(query, 1).first()["workspace_id"] if spaces > 1 else "all"
        scope = self.resolve(scope)
        concepts = self.concepts(scope)
        vectors = self.vectors.read() if scope is None else self.vectors.read().where(F.col("workspace_id") == scope)
        n = fusion.candidate_count(max(2 * limit, 8) if mode in ("graph", "hipporag", "network") else limit)
        n = limit if mode in ("keyword", "fts", "vector", "semantic") else n

        def by_words() -> DataFrame:
            found = keyword.indexed_bm25(self.postings.read(), self.lengths.read(), "id", query, keyword.FIELD_WEIGHTS, stem=True).join(concepts.select("id"), "id", "left_semi")
            top = found.select(F.col("id").alias("concept_id"), keyword.reported_score(F.col("score")).alias("score")).orderBy(F.desc("score"), "concept_id").limit(n)
            top = settled(top, "keyword-hits")  # n rows
            if top.isEmpty() and query.strip():
                top = keyword.like_search(concepts, query.strip()).select(F.col("id").alias("concept_id"), "score").orderBy("concept_id").limit(n)
            return top

        def by_vector() -> DataFrame:
            return vector.nearest(vectors, self._query_vector(query), n).select("concept_id", F.round("score", 4).alias("score"))

        if mode in ("keyword", "fts"):
            hits, how = by_words(), "fts"
        elif mode in ("vector", "semantic"):
            hits, how = by_vector(), "vector"
        else:
            hits, how = fusion.reciprocal_rank(by_words(), by_vector()), "hybrid_rrf"
            if mode in ("graph", "hipporag", "network"):
                how = "hipporag"
                seeds = hits.orderBy(F.desc("score"), "concept_id").limit(max(2 * limit, 8)).select(F.col("concept_id").alias("id"), F.greatest("score", F.lit(0.1)).alias("weight"))
                seeds = settled(seeds, "seeds")
                ranks = graph.push_ranks(self.linked(), seeds)
                top = ranks.agg(F.max("rank").alias("top"))
                scored = ranks.join(F.broadcast(top)).join(seeds, "id", "left").select(F.col("id").alias("concept_id"), fusion.graph_score(F.coalesce("weight", F.lit(0.0)), F.col("rank"), F.col("top")).alias("score"))
                hits = scored.where("score > 0")
        named = hits.join(concepts.select(F.col("id").alias("concept_id"), "name", "type", "summary", "tags", "workspace"), "concept_id")
        shown = named.select("concept_id", "name", "type", F.coalesce("summary", F.lit("")).alias("summary"), "tags", "score", F.lit(how).alias("matched_by"), "workspace").orderBy(F.desc("score"), "concept_id").limit(limit)
        raw_hits = rawsearch.as_hits(rawsearch.raw_search(self.raw(scope), query, limit)) if query.strip() else self.spark.createDataFrame([], SEARCH_RESULT)
        return tiered(shown, raw_hits, limit)

    def log(self, caller: str, action: str, query: str, details: str = "{}", count: int = 0, workspace: str = "default") -> None:
        """One row, appended; only the ids of the log are read. Of writers at one time two may give the same id, but no row is lost."""
        row = self.spark.createDataFrame([(caller, action, query, details, count, workspace)], "caller string, action string, query string, details_json string, result_count int, workspace_id string")
        number = max(1, self._next(self.tables["query_logs"].read(), "id"))
        self.tables["query_logs"].append(row.select(F.lit(number).cast("long").alias("id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "*"))

    def logs(self, limit: int = 50) -> DataFrame:
        return self.tables["query_logs"].read().orderBy(F.desc("id")).limit(limit)

    def forget(self) -> int:
        """Delete what no table needs any more, and say how many versions went; nobody may be searching or writing meanwhile."""
        return sum(t.forget() for t in (*self.tables.values(), self.vectors, self.postings, self.lengths, self.links, self.batches))

    def workspaces(self) -> DataFrame:
        return workspace_list(self.tables["workspaces"].read(), self.tables["concepts"].read(), self.tables["raw_documents"].read())

    def stats(self, workspace: str | None = None) -> DataFrame:
        """One row: concepts, edges from them, raw documents."""
        c = self.concepts(workspace)
        e = self.edges().join(c.select(F.col("id").alias("source_id")), "source_id", "left_semi")
        one = c.agg(F.count("*").alias("concepts")).join(e.agg(F.count("*").alias("relations"))).join(self.raw(workspace).agg(F.count("*").alias("raw_documents")))
        return one.select("concepts", "relations", "raw_documents")
