"""Mixing sources to target weights by capped water-filling (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

#: Hexadecimal digits of the hash by which the histograms bracket a source's cut-off, one after the other: 256 cells each.
LEVELS = (2, 4, 6)
#: A cell after all others.
BEYOND = "g"


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1..cycle in turn over the sources in code point order, null last. One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.select("source", ((F.row_number().over(order) - 1) % cycle + 1).cast("double").alias("weight"))


def water_level(sources: DataFrame) -> tuple[float, float]:
    """The (numerator, denominator) of the level at which ``min(cap, weight * level)`` adds up to all sizes.

    Clamping a source frees words for the others, so the level only rises from round to round;
    a source is clamped exactly when ``weight * level`` exceeds its cap. Each round is one small aggregate.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, seen = (0.0, 1.0), None
    while level != seen:
        seen = level
        over = F.col("weight") * F.lit(seen[0]) / F.lit(seen[1]) > F.col("cap")
        fixed, free = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))
        ).first()
        if free == 0:
            break
        level = (float(total - fixed), float(free))
    return level


def order_hash(key: Column, text: Column, seed: int) -> Column:
    """The place of a row within its source: a seeded hash of id and text, so that rows that share an id (or have none) stand apart."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def cut_off_cells(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, cell, before): the cell of the hash in which a source's running size passes ``rest``, and the size before it.

    Each level splits the cell of the level before in 256, so a task sums up 256 rows a source, however large it is.
    Sources whose whole size is not more than ``rest`` have no row.
    """
    at = sources.select("source", "rest", F.lit("").alias("cell"), F.lit(0).cast("long").alias("before"))
    for level, digits in enumerate(LEVELS):
        width = LEVELS[level - 1] if level else 0
        same = F.col("d.source").eqNullSafe(F.col("a.source"))
        inside = sized.alias("d").join(at.alias("a"), same & (F.substring("order_hash", 1, width) == F.col("a.cell")) if width else same)
        cells = inside.groupBy("d.source", "rest", "before", F.substring("order_hash", 1, digits).alias("cell")).agg(F.sum("size").alias("size"))
        upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("cell"))
        passed = cells.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        first = F.min(F.struct("cell", (F.col("upto") - F.col("size")).alias("before"), "rest"))
        at = materialise(passed.groupBy("source").agg(first.alias("x")).select("source", "x.rest", "x.cell", "x.before"), "mix-cells")
    return at.drop("rest")


def mixing_plan(sized: DataFrame, weights: DataFrame | None = None, max_epochs: int = 3) -> DataFrame:
    """Per source: source_size, target, whole repetitions, and the cut-off of the fractional one.

    ``sized`` has ``source, size, order_hash``. Within a source, documents stand in the order of their
    seeded hash; the fractional repetition takes each document whose midpoint in that order lies within the
    wanted share, so a source misses its target by half a document at most. Histograms over more and more
    digits of the hash find the cell that holds the cut-off, and only that cell is sorted. Rows of one hash (equal id and text) are one
    entry there, however many they are; if the cut-off falls among them, ``part`` of them are taken, of the hash ``edge``.
    """
    sources = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    weights = cyclic_weights(sources) if weights is None else weights
    sources = (
        sources.alias("s")
        .join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left")
        .select("s.source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    )
    sources = materialise(sources, "mix-weights")
    up, down = water_level(sources)
    level = F.col("weight") * F.lit(up) / F.lit(down)
    target = F.when(level > F.col("cap"), F.col("cap").cast("double")).otherwise(level)
    sources = sources.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = sources.withColumn("whole", rate.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    crossing = cut_off_cells(sized, sources)
    inside = (
        sized.alias("d")
        .join(crossing.alias("x"), F.col("d.source").eqNullSafe(F.col("x.source")) & (F.substring("order_hash", 1, LEVELS[-1]) == F.col("x.cell")))
        .groupBy("d.source", "order_hash", "size", "before")
        .agg(F.count("*").alias("n"))
    )
    ahead = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("source").orderBy("order_hash").rowsBetween(Window.unboundedPreceding, -1))
    inside = inside.withColumn("ahead", F.coalesce(ahead, F.lit(0)) + F.col("before"))
    room = 2 * F.col("rest") - 2 * F.col("ahead") - F.col("size")
    fit = F.when(room < 0, 0).when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.floor(room / (2 * F.col("size"))) + 1, F.col("n"))).cast("long")
    entries = inside.alias("i").join(sources.alias("s"), F.col("i.source").eqNullSafe(F.col("s.source"))).select("s.source", "order_hash", "n", fit.alias("fit"))
    cut = entries.groupBy("source").agg(
        F.max(F.when(F.col("fit") == F.col("n"), F.col("order_hash"))).alias("cut"), F.max(F.when((F.col("fit") > 0) & (F.col("fit") < F.col("n")), F.struct("order_hash", "fit"))).alias("partial")
    )
    plan = (
        sources.alias("s")
        .join(crossing.alias("x"), F.col("s.source").eqNullSafe(F.col("x.source")), "left")
        .join(cut.alias("k"), F.col("s.source").eqNullSafe(F.col("k.source")), "left")
        .select("s.source", "source_size", "weight", "target", "whole", F.coalesce("cell", F.lit(BEYOND)).alias("cell"), "cut", F.col("partial.order_hash").alias("edge"), F.col("partial.fit").alias("part"))
    )
    return materialise(plan, "mix-plan")


#: Equal rows that one task writes.
COPIES = 10_000


def repeats(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target and repeats to ``docs`` (which has source and order_hash); the plan has a row per source, which Spark broadcasts if it is small.

    Of a source's equal rows among which the cut-off falls, some are taken once more than others. They are counted, and the counted
    rows dealt out again, ``COPIES`` in a piece, so that no task holds or numbers them all.
    """
    cell = F.substring("order_hash", 1, LEVELS[-1])
    within = (cell < F.col("p.cell")) | ((cell == F.col("p.cell")) & F.coalesce(F.col("d.order_hash") <= F.col("cut"), F.lit(False)))
    edge = F.coalesce(F.col("d.order_hash") == F.col("edge"), F.lit(False))
    joined = docs.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "source_size", "target", "whole", "part", within.alias("within"), edge.alias("edge"))
    plain = joined.where("NOT edge").select(*[F.col(f"`{c}`") for c in docs.columns], "source_size", "target", (F.col("whole") + F.col("within").cast("long")).alias("repeats"))
    names = [F.col(f"`{c}`") for c in (*docs.columns, "source_size", "target", "whole", "part")]
    counted = joined.where("edge").groupBy(*names).agg(F.count("*").alias("__n"))
    pieces = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES).cast("long"))).alias("__from"))
    pieces = pieces.repartition(F.xxhash64("order_hash", "__from"))
    copies = pieces.select("*", F.explode(F.sequence(F.col("__from"), F.least(F.col("__n"), F.col("__from") + COPIES) - 1)).alias("__place"))
    return plain.union(copies.select(*[F.col(f"`{c}`") for c in docs.columns], "source_size", "target", (F.col("whole") + (F.col("__place") < F.col("part")).cast("long")).alias("repeats")))


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, *, text: str = "text", source: str = "source", key: str = "doc_id", max_epochs: int = 3, seed: int = 7
) -> DataFrame:
    """Repeat documents so that each source comes near its target number of words.

    Returns the columns of ``docs``, a row for each repetition. Sizes are word counts. A null source is a source
    of its own; null or wordless texts have size 0 and follow their source's rate (sources without words: kept
    once). An empty table gives an empty result. Rows that share an id, null or not, but have other texts are documents like others;
    rows that repeat id and text are dealt with by their number, so a source misses its target by half a document in any case.
    Columns may have any names; those of type map are not supported.
    """
    hashed = order_hash(F.col(key), F.col(text), seed).alias("order_hash")
    sized = materialise(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), hashed), "mix-sizes")
    plan = mixing_plan(sized, weights, max_epochs)
    rows = repeats(docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), hashed), plan)
    return rows.where("repeats > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("n")).select("row.*")


def mixed_sizes(docs: DataFrame, *, max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): size, source_size, target and the words that the mix takes.

    Nulls, repeated rows and empty tables as in ``mix_sources``; a row of size 0 takes no word.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_hash(F.col("doc_id"), F.col("text"), seed).alias("order_hash"))
    sized = materialise(sized, "mix-sizes")
    plan = mixing_plan(sized, None, max_epochs)
    return repeats(sized, plan).select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"), "source", "repeats")


#: DuckDB: the same mix in one statement. ``{docs}`` is a relation with doc_id, text, source.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM {docs}),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3 AS cap FROM src),
o AS (SELECT *, coalesce(sum(cap) OVER q, 0) AS fixed, sum(weight) OVER () - coalesce(sum(weight) OVER q, 0) AS free,
             sum(source_size) OVER () AS total
      FROM w WINDOW q AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT first(total - fixed ORDER BY cap / weight, source NULLS LAST)::DOUBLE AS up, first(free ORDER BY cap / weight, source NULLS LAST)::DOUBLE AS down
       FROM o WHERE weight * (total - fixed)::DOUBLE / free <= cap),
t AS (SELECT source, source_size, CASE WHEN weight * up / down > cap THEN cap::DOUBLE ELSE weight * up / down END AS target FROM w, lv),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
d AS (SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, s.source,
             coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
             p.target - p.whole * p.source_size AS rest
      FROM sized s JOIN p ON s.source IS NOT DISTINCT FROM p.source),
mixed AS (SELECT *, whole + CASE WHEN 2 * ahead + size <= 2 * rest THEN 1 ELSE 0 END AS repeats FROM d)
"""
