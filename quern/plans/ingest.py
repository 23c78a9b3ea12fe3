"""Ingestion into the store: archive, distil, deduplicate, link; deep dives and rebuilds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embed import hash_embeddings
from ..functions.text import document_id, strip_web_noise
from ..functions.web import seed_urls
from ..operators import crawl, distill
from ..schema import CONCEPT
from ..sources import readers, snapshots
from ..sources.scratch import settled
from .engine import Engine

#: Places where a concept's own article may stand, with {} for its name.
ENCYCLOPAEDIAS = ("https://en.wikipedia.org/wiki/{}", "https://ko.wikipedia.org/wiki/{}")


def concept_vectors(concepts: DataFrame) -> DataFrame:
    """(id, name, vector) by the text that deduplication compares: name, tags, summary and mechanisms."""
    text = F.concat_ws(" ", "name", F.concat_ws(" ", "tags"), "summary", F.concat_ws(" ", "mechanisms"))
    return hash_embeddings(concepts.select("id", text.alias("text")), "id", "text").join(concepts.select("id", "name"), "id")


def one_for_each_id(concepts: DataFrame) -> DataFrame:
    """Rows of the same id as one: the first by name, with all sources, tags and mechanisms."""
    first = F.min_by(F.struct(*concepts.columns), F.struct("name", "summary"))
    lists = [F.array_distinct(F.flatten(F.sort_array(F.collect_set(c)))).alias(f"all_{c}") for c in ("sources", "tags", "mechanisms")]
    grouped = concepts.groupBy("id").agg(first.alias("row"), *lists)
    return grouped.select(*[F.col(f"all_{c}").alias(c) if c in ("sources", "tags", "mechanisms") else F.col(f"row.{c}").alias(c) for c in concepts.columns])


def save_with_dedup(engine: Engine, new: DataFrame) -> DataFrame:
    """Save concepts (CONCEPT rows): merge those the store has, create the rest with links to what is similar.

    Rows of the batch go one after the other in the order of ids: those like one that is created before them merge into it or are linked to it.
    Returns (id, action, target, links).
    """
    new = settled(one_for_each_id(new), "new-concepts")
    known = settled(engine.concepts(), "known-concepts")
    actions = settled(distill.dedup_actions(concept_vectors(new), concept_vectors(known)), "actions")
    chosen = new.join(actions, "id")
    merging = chosen.where("target IS NOT NULL").withColumn("id", F.col("target")).select(*[f.name for f in CONCEPT.fields])
    created = chosen.where("target IS NULL").select(*[f.name for f in CONCEPT.fields])
    base = known.join(merging.select("id").distinct(), "id", "left_semi").unionByName(created)
    engine.save_concepts(settled(snapshots.merge_concepts(base, one_for_each_id(merging)), "saved-concepts"))
    links = actions.select(F.col("id").alias("source_id"), F.explode("links").alias("target_id")).select("source_id", F.lit("related_to").alias("relation_type"), "target_id", F.lit("similar content").alias("reason"))
    engine.add_edges(links)
    return actions


def ingest_pages(engine: Engine, pages: DataFrame, workspace: str = "default", generate: Callable[[str], str] | None = None) -> DataFrame:
    """Archive pages (title, text, source[, links]), distil them, save the concepts and link pages' concepts as their pages link.

    With ``generate``, a language model's concepts are used where it gives any, with their mechanisms and relations; it is told of concepts that the store has, and where it
    fails or gives none the rules stand in. Returns the actions.
    """
    docs = pages.select(document_id(F.col("source"), F.coalesce("text", F.lit(""))).alias("id"), "title", F.col("source").alias("source_uri"), F.coalesce("text", F.lit("")).alias("content"))
    docs = docs.dropDuplicates(["id"]).select("*", F.char_length("content").cast("long").alias("char_count"), F.lit(workspace).alias("workspace_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    docs = settled(docs, "archived")
    engine.save_raw(docs)
    made = distill.heuristic_concepts(docs)
    if generate is not None:
        known = [r["id"] for r in engine.concepts().select("id").orderBy("id").limit(distill.MOST_KNOWN).collect()]
        named = settled(distill.model_concepts(docs.withColumn("content", strip_web_noise(F.col("content"))), generate, known=known), "model-concepts")
        by_rule = distill.heuristic_concepts(docs.join(named.select(F.col("doc").alias("id")).distinct(), "id", "left_anti"))
        own = named.join(docs.select(F.col("id").alias("doc"), "source_uri", "created_at"), "doc")
        given = {"sources": F.array(F.concat(F.lit("raw:"), F.col("doc")), F.col("source_uri")), "workspace": F.lit(workspace), "created_at": F.col("created_at"), "updated_at": F.col("created_at")}
        made = by_rule.unionByName(own.select(*[given.get(f.name, F.col(f.name)).alias(f.name) for f in CONCEPT.fields]))
    actions = save_with_dedup(engine, made)
    if "links" in pages.columns:
        primary = distill.primary_concepts(docs).join(docs.select(F.col("id").alias("doc"), F.col("source_uri").alias("url")), "doc").select("url", F.col("id").alias("concept"))
        final = primary.join(actions.select(F.col("id").alias("concept"), "target"), "concept", "left").select("url", F.coalesce("target", "concept").alias("concept"))
        engine.add_edges(distill.page_references(pages, final))
    return actions


def redistill(engine: Engine, workspace: str | None = None) -> DataFrame:
    """Distil the archive again without a language model."""
    return save_with_dedup(engine, distill.heuristic_concepts(engine.raw(workspace)))


def deep_dive(engine: Engine, concept_id: str, fetch: Callable[[str], str | None], *, extra: str = "", depth: int = 1, max_pages: int = 5, seeds: int = 3) -> dict:
    """Crawl from a concept's own articles, distil the pages, and tie what is new to the concept.

    Returns the number of pages and of new concepts, and the sources.
    """
    spark = engine.spark
    origin = engine.concepts().where(F.col("id") == concept_id)
    row = origin.first()
    if row is None:
        raise KeyError(concept_id)
    word = extra or next((t for t in row["tags"] if t not in ("atomic_extracted", "core_doc", "entity")), "")
    query = f"{row['name']} {word}".strip()
    urls = [r["u"] for r in spark.createDataFrame([(row["name"],), (query,)], "q string").select(F.explode(seed_urls(F.col("q"), ENCYCLOPAEDIAS)).alias("u")).distinct().orderBy("u").limit(2 * seeds).collect()]

    def pages_of(frontier: DataFrame) -> DataFrame:
        return readers.parse_pages(readers.fetch_pages(frontier, fetch).where("html IS NOT NULL"))

    found = None
    for url in urls:
        root = pages_of(spark.createDataFrame([(url,)], "url string"))
        got = crawl.crawl(pages_of, url, settled(root, "root"), depth=depth, max_pages=max_pages)
        found = got if found is None else found.unionByName(got)
    pages = settled(found.dropDuplicates(["source"]), "dive")
    actions = settled(ingest_pages(engine, pages.select("title", "text", "source", "links"), row["workspace"]), "dive-actions")
    new = actions.where("target IS NULL").where(F.col("id") != concept_id)
    tie = new.select(F.lit(concept_id).alias("source_id"), F.lit("expands").alias("relation_type"), F.col("id").alias("target_id"), F.lit("found by a deep dive").alias("reason"))
    engine.add_edges(tie)
    sources = [r["source"] for r in pages.select("source").orderBy("source").limit(max_pages * len(urls)).collect()]
    updated = engine.concepts().where(F.col("id") == concept_id).withColumn("sources", snapshots.merged_lists(F.col("sources"), F.lit(sources).cast("array<string>")))
    engine.save_concepts(settled(updated, "origin"))
    return {"crawled_pages": pages.count(), "new_concepts": new.count(), "sources": sources}


def reindex(engine: Engine, cards_path: str) -> int:
    """Rebuild the tables from a folder of cards: they are the truth, and concepts without a card go."""
    cards = settled(readers.read_cards(engine.spark, cards_path), "cards")
    engine.save_concepts(one_for_each_id(cards))
    engine.prune(cards.select("id"))
    return cards.count()
