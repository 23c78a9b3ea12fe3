"""Line dedup: winnowed line fingerprints, joined at their places and extended both ways, find repeated runs of lines; later ones are deleted (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, without


def _lines(text: Column) -> Column:
    """The lines that hold a word, in order: place among all lines (at) and among these (k), two hashes (h, g) and words (w)."""
    split = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda l, i: F.struct(
            i.alias("at"), F.xxhash64(l).alias("h"), F.xxhash64(F.lit(1), l).alias("g"), F.size(F.filter(F.split(l, r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w")
        ),
    )
    return F.transform(F.filter(split, lambda x: x["w"] > 0), lambda x, k: F.struct(x["at"].alias("at"), k.alias("k"), x["h"].alias("h"), x["g"].alias("g"), x["w"].alias("w")))


def _taken(near: Column, min_words: int) -> Column:
    """How many lines from the start of ``near`` on hold ``min_words`` words (all, if there are fewer), and how many words those are: (n, w)."""
    return F.aggregate(
        near,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("w")),
        lambda a, x: F.when(a["w"] >= min_words, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["w"] + x["w"]).alias("w"))),
    )


def _window(near: Column, min_words: int) -> Column:
    """The shortest run from the start of ``near`` with ``min_words`` words; null if there are too few."""
    return F.transform(F.array(_taken(near, min_words)), lambda t: F.when(t["w"] >= min_words, F.slice(near, F.lit(1), t["n"])))[0]


def _context(near: Column, min_words: int) -> Column:
    """The lines from the start of ``near`` on, up to the one with which they have ``min_words`` words."""
    return F.slice(near, F.lit(1), _taken(near, min_words)["n"])


def _least(window: Column) -> Column:
    """The place of a window's least line hash, the first of equal ones."""
    return F.array_min(F.transform(window, lambda x: F.struct(x["h"], x["k"])))["k"]


def _ahead(lines: Column, k: Column, most: int) -> Column:
    return F.slice(lines, k + 1, F.lit(most))


def _behind(lines: Column, k: Column, most: int) -> Column:
    """Up to ``most`` lines before place ``k``, the nearest first."""
    return F.reverse(F.slice(lines, F.greatest(k - most, F.lit(0)) + 1, F.least(k, F.lit(most))))


def winnowed(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, tag, h, line, behind, ahead): the lines that winnowing selects in ``docs`` (id, tag, text), and what stands around them.

    A window is the shortest run of lines with ``min_words`` words from a line on, forwards or backwards; a line with a word adds
    one at least, so it spans ``min_words`` lines at most. Each window selects the line of its least hash, neighbouring
    windows mostly the same one. ``behind`` and ``ahead`` reach as far as a window that selects the line can.
    """
    lines = F.col("lines")
    places = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    forwards = F.transform(places, lambda k: _least(_window(_ahead(lines, k, min_words), min_words)))
    backwards = F.transform(places, lambda k: _least(_window(_behind(lines, k + 1, min_words), min_words)))
    chosen = F.filter(F.array_distinct(F.concat(forwards, backwards)), lambda k: k.isNotNull())
    seeds = F.transform(
        "chosen",
        lambda k: F.struct(
            F.element_at(lines, k + 1).alias("line"),
            _context(_behind(lines, k, min_words), min_words).alias("behind"),
            _context(_ahead(lines, k + 1, min_words), min_words).alias("ahead"),
        ),
    )
    rows = docs.select("id", "tag", _lines(F.col("text")).alias("lines")).withColumn("chosen", chosen)
    return rows.select("id", "tag", F.explode(seeds).alias("s")).select("id", "tag", F.col("s.line.h").alias("h"), "s.*")


def _contexts(min_words: int) -> Column:
    """Digests of the windows that select the line of a row of ``winnowed``: with what it is compared."""

    def side(near: str, far: str, turned: bool) -> Column:
        def window(n: Column) -> Column:
            run = _window(F.concat(F.reverse(F.slice(F.col(near), F.lit(1), n)), F.array("line"), F.col(far)), min_words)
            run = F.transform(F.array(run), lambda r: F.when((F.size(r) > n) & (_least(r) == F.col("line.k")), F.reverse(r) if turned else r))[0]
            return F.when(run.isNotNull(), F.struct(F.xxhash64(F.transform(run, lambda x: x["h"])).alias("x"), F.xxhash64(F.lit(1), F.transform(run, lambda x: x["g"])).alias("y")))

        return F.transform(F.sequence(F.lit(0), F.size(near)), window)

    both = F.concat(side("behind", "ahead", False), side("ahead", "behind", True))
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull()))


def _shared(mine: Column, theirs: Column) -> Column:
    """The lines of ``mine``, from its start on, that ``theirs`` has as well."""
    same = F.transform(F.zip_with(mine, theirs, lambda a, b: (a["h"] == b["h"]) & (a["g"] == b["g"])), lambda x: F.coalesce(x, F.lit(False)))
    end = F.array_position(same, False)
    return F.when(end == 0, mine).otherwise(F.slice(mine, F.lit(1), (end - 1).cast("int")))


def later_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(id, tag, gone): for each document with repeated runs, the places (from 0) of the lines to delete.

    A line goes if it lies in a run of consecutive lines (blank ones left out) with ``min_words`` words or more
    that also stands, line for line, at an earlier place: in a document of smaller id, or further up. Such a run holds a whole window
    at both places, and equal windows select the same line (winnowing's guarantee), so only selected lines
    meet, those whose hash occurs at two places. A hash may stand at very many (a common line), so that a
    place isn't joined with all others: for each window that selects it, it is joined with the first place that
    has the same window. From there a match is extended line by line both ways, and the matches' union, over
    all selected lines of a document, is each repeated run to its ends.
    """
    seeds = materialise(winnowed(docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("tag"), F.col(text).alias("text")), min_words), "seeds")
    place = F.struct(F.col("id").isNotNull().alias("known"), F.col("id"), F.col("tag"), F.col("line.k"))
    # Aggregates are combined in tasks before they meet. In the joins a hot key stands once on one side, and Spark splits the
    # other; they are merge joins at every size, since none of the tables is bounded.
    again = seeds.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a != z").select("h")
    met = seeds.join(materialise(again, "fingerprints").hint("merge"), "h")
    met = materialise(met.select("id", "tag", "line", "behind", "ahead", F.explode(_contexts(min_words)).alias("window")), "candidates")
    first = met.groupBy("window").agg(F.min(F.struct(place.alias("place"), "behind", "ahead")).alias("o"), F.max(place).alias("end")).where("o.place != end").select("window", "o")
    later = met.join(materialise(first, "origins").hint("merge"), "window").where(place != F.col("o.place"))
    run = F.concat(_shared(F.col("behind"), F.col("o.behind")), F.array("line"), _shared(F.col("ahead"), F.col("o.ahead")))
    matches = later.select("id", "tag", F.transform(run, lambda x: x["at"]).alias("run"))
    return matches.groupBy("id", "tag").agg(F.array_distinct(F.flatten(F.collect_set("run"))).alias("gone"))


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """All rows and columns of ``docs`` with later repeated runs cut out of the text, plus ``n_lines`` and ``n_removed``.

    Null and empty texts stay as they are (no lines); a text all of whose lines are repeats becomes empty; blank
    lines stay. Rows that repeat both id and text stand at one place and so are never each other's repeats; rows that
    repeat an id with other texts are places of their own. Null ids come before all others. Columns named ``n_lines``
    or ``n_removed`` are replaced. An empty table gives no rows.
    """
    gone = materialise(later_runs(docs, key=key, text=text, min_words=min_words), "gone")
    rest = without(docs, "n_lines", "n_removed")
    rows = rest.select(F.struct("*").alias("row"), F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("tag")).alias("d")
    rows = rows.join(gone.alias("g").hint("merge"), F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.tag") == F.col("g.tag")), "left").select("row", "gone", F.split(F.col(f"row.`{text}`"), "\n").alias("split"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda i: F.element_at("split", i + 1)), "\n")
    columns = [F.when(F.col("gone").isNull(), F.col(f"row.`{c}`")).otherwise(kept).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in rest.columns]
    return rows.select(*columns, F.when(F.col("split").isNull(), 0).otherwise(F.size("split")).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


#: DuckDB: CTEs that end in ``deduped`` (doc_id, text, n_lines, n_removed). ``{docs}`` is a relation with unique ids.
LINE_SQL = """
lines AS (
  SELECT doc_id, pos, l, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS w
  FROM (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM {docs}))),
seq AS (
  SELECT doc_id, pos, l, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto
  FROM lines WHERE w > 0),
ends AS (
  SELECT a.doc_id, a.i AS first, min(b.i) AS last FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49 AND b.upto - a.upto + a.w >= 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.i) AS first, b.i AS last FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND a.i BETWEEN b.i - 49 AND b.i AND b.upto - a.upto + a.w >= 50 GROUP BY b.doc_id, b.i),
runs AS (
  SELECT e.doc_id, e.first, e.last, md5(string_agg(s.l, chr(10) ORDER BY s.i)) AS run
  FROM ends e JOIN seq s ON s.doc_id = e.doc_id AND s.i BETWEEN e.first AND e.last GROUP BY ALL),
again AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS nth FROM runs) WHERE nth > 1),
gone AS (SELECT DISTINCT s.doc_id, s.pos FROM again g JOIN seq s ON s.doc_id = g.doc_id AND s.i BETWEEN g.first AND g.last),
left_over AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(l.l, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id),
deduped AS (SELECT d.* REPLACE (o.text AS text), coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_removed, 0) AS n_removed FROM {docs} d LEFT JOIN left_over o ON o.doc_id = d.doc_id)
"""
