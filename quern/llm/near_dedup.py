"""MinHash near-duplicate classes, with odd sketches between the bands and the exact check."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, materialise

_WORD = re.compile(WORD)
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Minima of a band. Of a bound of .85 there are 20 bands: sets that reach it share none with a chance of (1 - .85**4)**20 = 4e-7.
ROWS, MISSED = 4, 4e-7
#: A sketch folds one minimum of each of SAMPLES hash ranges into SKETCH_BITS parity bits.
SAMPLES, SKETCH_BITS = 1024, 2048
#: Sets up to this size are sketched whole: a sample of so few loses shared shingles, and links with them.
WHOLE = 512
#: Slack of a sketch's estimate, over five standard errors for sampled sets; whole ones err by less. The exact check follows.
SLACK = 0.12
#: Rows of one block when members of a large band bucket are compared, and bytes of their full sets.
BLOCK, BLOCK_BYTES = 512, 32 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def bands_for(percent: int) -> int:
    """The number of bands with which sets at the bound share none with a chance of about MISSED."""
    return max(1, round(np.log(MISSED) / np.log1p(-min(percent / 100, 0.999) ** ROWS)))


@lru_cache
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``n`` linear hashes."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base, inverse = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
    up = np.full(n, base, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Shingler:
    """Hashed shingle sets, by prefix sums of a polynomial over the text's bytes."""

    def __init__(self, size: int) -> None:
        self.size, self.up, self.down = size, *_powers(1 << 17)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the word n-grams (of all words, if they are fewer); empty without words."""
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64)
        while len(self.up) <= len(raw):
            self.up, self.down = _powers(2 * len(self.up))
        low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint64)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((low + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        words = _mixed((sums[ends] - sums[starts]) * self.down[starts] ^ (ends - starts).astype(np.uint64) * _P)
        n = min(self.size, len(words))
        grams = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            grams = _mixed(grams * _P + words[k : k + len(grams)])
        return np.unique(grams)


def minima(shingles: np.ndarray, bands: int = 20) -> np.ndarray:
    """The least of each of bands * ROWS linear hashes (upper halves)."""
    factors, summands = _hashes(bands * ROWS)
    out = np.full(bands * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 1024):
        np.minimum(out, (shingles[at : at + 1024, None] * factors + summands).min(axis=0), out=out)
    return out >> np.uint64(20)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(-1, ROWS)
    key = np.arange(len(rows), dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        key = _mixed(key * _P + rows[:, k])
    return key.view(np.int64)


def odd_sketch(shingles: np.ndarray) -> tuple[bytes, int]:
    """Parity bitmap of the set, if it has at most WHOLE hashes, else of a sample: of each of SAMPLES ranges its least. Also the number of hashes taken.

    The sketches' exclusive or is the sketch of the samples' symmetric difference."""
    sample = shingles
    if len(shingles) > WHOLE:
        ranges = shingles >> np.uint64(54)  # SAMPLES = 2**10; the hashes are sorted
        sample = shingles[np.concatenate([[True], ranges[1:] != ranges[:-1]])]
    bits = np.bincount((_mixed(sample) & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes(), len(sample)


def similar(a: np.ndarray, na: np.ndarray, ka: np.ndarray, b: np.ndarray, nb: np.ndarray, kb: np.ndarray, least: float, bound: float = 0.85) -> np.ndarray:
    """Estimated similarity (rows of ``a`` by rows of ``b``) above ``least``, else 0.

    ``a`` and ``b`` are unpacked to bytes. The population count gives the samples' symmetric difference; what the
    samples share, over the ranges that the union of sets at ``bound`` fills, is the similarity. Of two whole sets the union is known; a whole
    and a sampled one can't be compared and count as equal, so that the exact check decides."""
    out = np.zeros((len(a), len(b)), np.float32)
    for i in range(len(a)):
        odd = _POP[a[i] ^ b].sum(axis=1, dtype=np.int64)
        difference = -SKETCH_BITS / 2 * np.log(np.maximum(1 - 2 * odd / SKETCH_BITS, 1e-3))
        filled = SAMPLES * -np.expm1(-(na[i] + nb) / ((1 + bound) * SAMPLES))
        both, one = (na[i] <= WHOLE) & (nb <= WHOLE), (na[i] <= WHOLE) != (nb <= WHOLE)
        filled = np.where(both, (ka[i] + kb + difference) / 2, filled)
        out[i] = np.where(one, 1, np.minimum((ka[i] + kb - difference) / 2 / np.maximum(filled, 1e-9), 1))
    out[out < least] = 0
    return out


def _digest(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """Per row: doc_id as it is, a hash of the text, set size, a digest of the set (its class), band keys and sketch; the last three are null for empty sets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                s = shingle(text)
                out.append((len(s), _digest(s), band_keys(minima(s, bands)), *odd_sketch(s)) if len(s) else (0, None, None, None, 0))
            n, kind, keys, sketch, sampled = zip(*out, strict=True) if out else ([],) * 5
            columns = [pa.array(n, pa.int64()), pa.array(kind, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(sampled, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "tag", "n_shingles", "class", "bands", "sketch", "sampled"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("tag long, n_shingles long, class binary, bands array<long>, sketch binary, sampled int").fields])
    return docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(rows, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles): the full sets of the ``wanted`` classes (node, class, doc_id), from the rows of one of their ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for batch in batches:
            sets = [shingle(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "shingles"])

    ids = wanted.select("doc_id").distinct()
    texts = docs.select("doc_id", "text").alias("d").join(ids.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi").select("text")
    # An id may stand on several texts, and equal rows on one: a set for each class.
    found = texts.mapInArrow(rows, "class binary, shingles binary").join(wanted.select("node", "class"), "class")
    return found.groupBy("node").agg(F.any_value("shingles").alias("shingles"))


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two full sets, as sorted distinct hashes, meet the bound."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the bound."""

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            out.append(_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
        return pd.Series(out, dtype=bool)

    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(linked("x", "y")).select("a", "b")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that links reach, for each end of a link.

    Each round a node takes the least label among its neighbours, then that label's own label, so paths halve.
    """
    edges = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    for _ in range(max_rounds):
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        pulled = labels.join(around, labels["node"] == around["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        pulled = materialise(pulled, "pulled")
        jump = pulled.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = pulled.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component"))
        new = materialise(new, "labels")
        labels = new.select("node", "component")
        if new.where("component != old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def _unpacked(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), SKETCH_BITS // 8), frame["n_shingles"].to_numpy(float), frame["sampled"].to_numpy(float)


def star_pairs(members: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Each member of a band bucket with the bucket's least member, if their sketches are similar: (a, b), a < b."""
    heads = materialise(buckets.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").select("band", "a"), "heads")
    pairs = buckets.join(heads, "band").where("node != a").select("a", F.col("node").alias("b")).distinct()
    return sketch_filter(materialise(pairs, "pairs"), members, percent)


def sketch_filter(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    least = percent / 100 - SLACK

    @F.pandas_udf("boolean")
    def close(x: pd.Series, nx: pd.Series, kx: pd.Series, y: pd.Series, ny: pd.Series, ky: pd.Series) -> pd.Series:
        out = []
        for a, na, ka, b, nb, kb in zip(x, nx, kx, y, ny, ky, strict=True):
            a, b = np.frombuffer(a, np.uint8)[None], np.frombuffer(b, np.uint8)[None]
            out.append(bool(similar(a, np.array([na]), np.array([ka]), b, np.array([nb]), np.array([kb]), least, percent / 100)[0, 0]))
        return pd.Series(out, dtype=bool)

    left = members.select(F.col("node").alias("a"), F.col("sketch").alias("x"), F.col("n_shingles").alias("nx"), F.col("sampled").alias("kx"))
    right = members.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n_shingles").alias("ny"), F.col("sampled").alias("ky"))
    both = pairs.join(left, "a").join(right, "b").where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    return both.where(close("x", "nx", "kx", "y", "ny", "ky")).select("a", "b")


def _blocks(members: DataFrame, buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, s, t, node, component, seeks): who meets whom in the buckets that still hold several components.

    In each bucket the largest component's members stay in their own block t and every other member meets all blocks, a strip s
    at a time. Their numbers follow from the members and from the bytes of their sets, so neither fills a task.
    """
    sizes = members.select("node", (F.col("n_shingles") * 8).alias("bytes"))
    own = buckets.join(labels, "node", "left").join(sizes, "node")
    own = materialise(own.select("band", "node", "bytes", F.coalesce("component", "node").alias("component")), "bucket-labels")
    parts = own.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    total = parts.groupBy("band").agg(F.max(F.struct("n", "bytes", "component")).alias("top"), F.sum("n").alias("all"), F.sum("bytes").alias("bytes"), F.count("*").alias("kinds"))
    total = total.where("kinds > 1 AND all > 2")

    def pieces(rows: Column, size: Column) -> Column:
        return F.ceil(F.greatest(rows / BLOCK, size / BLOCK_BYTES)).cast("int")

    total = total.select("band", F.col("top.component").alias("main"), pieces(F.col("all"), F.col("bytes")).alias("blocks"), pieces(F.col("all") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("strips"))
    block, strip = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("strips")).cast("int")
    placed = own.join(materialise(total, "bucket-sizes"), "band").select("band", "node", "component", "main", "blocks", "strips", block.alias("block"), strip.alias("strip"))
    placed = materialise(placed, "bucket-places")
    whole = placed.select("band", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("s"), F.col("block").alias("t"), "node", "component", F.lit(False).alias("seeks"))
    seeking = placed.where("component != main").select("band", F.col("strip").alias("s"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("t"), "node", "component", F.lit(True).alias("seeks"))
    return whole.union(seeking)


def cross_links(docs: DataFrame, size: int, classes: DataFrame, members: DataFrame, buckets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one bucket but of different components: the work that the stars leave.

    First the members of each pair of blocks are compared by sketch, which leaves those that are similar to any of another component.
    Only their full sets are fetched, and decide, the most similar first; a link joins two components for the rest of its task, so a
    task gives fewer links than it has components, whatever the number of similar pairs.
    """
    least = percent / 100 - SLACK
    about = members.select("node", "n_shingles", "sketch", "sampled")

    def estimates(seek: pd.DataFrame, there: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """For each row of ``seek`` the estimated similarity with those of ``there``, 0 for its own component."""
        a, na, ka = _unpacked(seek)
        b, nb, kb = _unpacked(there)
        kinds, own = there["component"].to_numpy(), seek["component"].to_numpy()
        for i in range(len(seek)):
            found = similar(a[i : i + 1], na[i : i + 1], ka[i : i + 1], b, nb, kb, least, percent / 100)[0]
            found[(kinds == own[i]) | (100 * np.minimum(na[i], nb) < percent * np.maximum(na[i], nb))] = 0
            yield i, found

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        seek, there = pdf[pdf["seeks"]], pdf[~pdf["seeks"]]
        seekers, others = np.zeros(len(seek), bool), np.zeros(len(there), bool)
        if len(seek) and len(there):
            for i, found in estimates(seek, there):
                others |= found > 0
                seekers[i] = bool((found > 0).any())
        return pd.concat([seek[seekers], there[others]])[["band", "s", "t", "node", "component", "seeks"]]

    places = _blocks(members, buckets, labels)
    left = places.join(about, "node").groupBy("band", "s", "t").applyInPandas(met, "band long, s int, t int, node long, component long, seeks boolean")
    left = materialise(left, "similar-members")
    wanted = materialise(classes.join(left.select("node").distinct(), "node", "left_semi").select("node", "class", "doc_id"), "wanted")
    sets = materialise(shingle_sets(docs, wanted, size), "sets")

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        seek, there = (part.sort_values("node") for part in (pdf[pdf["seeks"]], pdf[~pdf["seeks"]]))
        out: list[tuple[int, int]] = []
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                c = up
            return c

        if len(seek) and len(there):
            ids, kinds, full = there["node"].to_numpy(), there["component"].to_numpy(), list(there["shingles"])
            nodes, own, mine = seek["node"].to_numpy(), seek["component"].to_numpy(), list(seek["shingles"])
            for i, found in estimates(seek, there):
                at = np.flatnonzero(found)
                x = np.frombuffer(mine[i], np.uint64)
                for j in at[np.lexsort((ids[at], -found[at]))]:
                    if (p := find(own[i])) != (q := find(kinds[j])) and _linked(x, np.frombuffer(full[j], np.uint64), percent):
                        root[max(p, q)] = min(p, q)
                        out.append((min(nodes[i], ids[j]), max(nodes[i], ids[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = left.join(about, "node").join(sets, "node")
    return rows.groupBy("band", "s", "t").applyInPandas(compared, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, percent: int = 85, size: int = 5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) and a document's set is its distinct ``size``-word shingles (all words, if fewer).
    Equal sets form a class, and from there on classes are compared, once each, whatever their ids. Classes that share a band are compared by
    sketch with one of their bucket, then with members of other components of it, and every candidate is confirmed
    on full sets. A component's id is the least id of its classes' rows.

    No link is made for empty sets (null or wordless text): such rows are their own component and kept. Repeated rows, and rows that
    repeat an id with other texts, give a row each; the set of each text counts. A row without id belongs to its component, but is
    kept only if no row of it has an id. Other columns of ``docs`` don't matter, whatever their names. An empty table gives no rows.
    """
    return classified(docs, percent, size).drop("tag")


def classified(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """``near_duplicates`` with ``tag``, a hash of the row's text."""
    all_rows = materialise(signatures(docs, size, bands_for(percent)), "signatures")
    same = [F.any_value(c).alias(c) for c in ("n_shingles", "bands", "sketch", "sampled")]
    classes = all_rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), *same)
    members = materialise(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "members")  # written, so the numbers stay
    classes = members.select("node", "class", "doc_id")
    buckets = members.select(F.explode("bands").alias("band"), "node")
    busy = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    buckets = materialise(buckets.join(materialise(busy, "busy"), "band"), "buckets")
    pairs = materialise(star_pairs(members, buckets, percent), "candidates")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialise(classes.join(ends, "node", "left_semi"), "wanted")
    links = materialise(confirmed(pairs, materialise(shingle_sets(docs, wanted, size), "sets"), percent), "links")
    labels = components(links)
    more = materialise(cross_links(docs, size, classes, members, buckets, labels, percent), "more-links")
    if not more.isEmpty():
        labels = components(links.union(more))
    labelled = classes.join(labels, "node", "left").select("class", "doc_id", F.coalesce("component", "node").alias("component"))
    labelled = materialise(labelled, "labelled")
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    roots = materialise(labelled.join(least, "component").select("class", "component_id"), "roots")
    rows = all_rows.select("doc_id", "tag", "n_shingles", "class").join(roots, "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "tag")


def keep_one(docs: DataFrame, *, percent: int = 85, size: int = 5) -> DataFrame:
    """The rows of ``docs`` that are their component's least id; others go.

    Of rows that repeat an id, those with a kept text stay, whatever their number; rows without id stay only in components
    without any id. Columns may have any names, and an empty table gives no rows.
    """
    found = classified(docs, percent, size).where("NOT kept").select(F.col("doc_id").alias("id"), "tag").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tag"))
    gone = materialise(found, "dropped").alias("g")
    return rows.alias("r").join(gone, F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.tag") == F.col("g.tag")), "left_anti").select("row.*")


#: DuckDB: CTEs that end in ``classed`` (doc_id, n_shingles, component_id, kept). ``{docs}`` is a relation with unique ids.
NEAR_SQL = """
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reached AS (SELECT doc_id AS node, doc_id AS root FROM words UNION SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.root),
classed AS (
  SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.root) AS component_id, w.doc_id = min(r.root) AS kept
  FROM words w JOIN reached r ON r.node = w.doc_id LEFT JOIN sizes s ON s.doc_id = w.doc_id GROUP BY w.doc_id, s.n)
"""
