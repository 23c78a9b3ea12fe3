"""Approximate search over many vectors: inverted lists under k-means cells with product codes, and exact re-ranking. ``vector.most_similar`` is the exact way."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embed import cosine
from ..sources.scratch import settled

#: Vectors that the index is fitted on at most, the least by a seeded hash of their keys; every vector is indexed.
SAMPLE = 20_000
#: Components of a vector that share a code, and codes of each.
PART, CODES = 4, 256
#: Sample vectors whose nearest ten tell how many cells a search must probe, and the share of these that it is to reach.
TRIED, REACHED = 256, 0.97
#: Codes and queries of a cell that meet in a task.
BLOCK = 8192


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """At most ``k`` centres of a sample; a centre without vectors stays where it is."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Coder:
    """Centres of the cells, and for each part of what a vector differs from its centre by the values that codes stand for."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, seed: int) -> Coder:
        rng, x = np.random.default_rng(seed), _unit(x)
        centres = k_means(x, cells, rng)
        cell = _nearest(x, centres)
        rest = x - centres[cell]
        tried = x[:TRIED]
        like = tried @ x.T
        like[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
        ten = np.argsort(-like, axis=1, kind="stable")[:, : min(10, len(x) - 1)]
        place = np.argsort(np.argsort(-tried @ centres.T, axis=1, kind="stable"), axis=1)
        places = np.take_along_axis(place, cell[ten], axis=1)
        probes = int(np.quantile(places, REACHED)) + 1 if places.size else len(centres)
        return cls(centres, [k_means(rest[:, at : at + PART], CODES, rng) for at in range(0, x.shape[1], PART)], probes)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = _unit(x)
        cell = _nearest(x, self.centres)
        rest = x - self.centres[cell]
        return cell, np.stack([_nearest(rest[:, k * PART : (k + 1) * PART], book) for k, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """The dot products of unit queries with what the codes of a cell stand for: a look into a table for each part."""
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1)
        for k, book in enumerate(self.books):
            out += (q[:, k * PART : (k + 1) * PART] @ book.T)[:, codes[:, k]]
        return out


@dataclass
class VectorIndex:
    """``lists`` has cell, key, code and vector, dealt and sorted by cell, so that a search reads the cells that it probes."""

    coder: Coder | None
    lists: DataFrame
    key: str
    dim: int


def _valid(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Vectors of the index's length, without nulls, that have a direction; others are similar to none."""
    good = (F.size(vector) == dim) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v)) & F.exists(vector, lambda v: v != 0)
    return df.where(F.col(key).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))


def build_index(vectors: DataFrame, dim: int, *, key: str = "id", vector: str = "vector", cells: int | None = None, sample: int = SAMPLE, seed: int = 5) -> VectorIndex:
    """Index every vector of ``dim`` components. ``cells`` is by default the root of their number, and at most ``sample`` / 32.

    The fit runs in one task over at most ``sample`` vectors; centres and codes, some hundred KB, are all that the driver gets. An empty table gives an index without entries.
    """
    rows = settled(_valid(vectors, key, vector, dim), "index-vectors")
    n = rows.count()
    cells = max(1, min(cells or int(n**0.5), sample // 32))
    picked = rows.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(sample)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = [v for b in batches for v in b["vector"]]
        if x:
            yield pd.DataFrame({"coder": [pickle.dumps(Coder.fit(np.array(x), cells, seed))]})

    row = picked.repartition(1).sortWithinPartitions("key").mapInPandas(fitted, "coder binary").first()
    coder = pickle.loads(row["coder"]) if row else None
    kind = rows.schema["key"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(coder)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cell, codes = held.value.encode(np.array(list(b["vector"])))
                yield b.assign(cell=cell.astype(np.int32), code=[c.tobytes() for c in codes])[["cell", "key", "code", "vector"]]

    lists = rows.mapInPandas(coded, f"cell int, key {kind}, code binary, vector array<double>")
    return VectorIndex(coder, settled(lists.repartitionByRange("cell", "key").sortWithinPartitions("cell"), "index-lists"), key, dim)


def search_index(index: VectorIndex, queries: DataFrame, k: int, *, vector: str = "vector", probes: int | None = None, refine: int = 16, same_id: bool = False) -> DataFrame:
    """(key, other, score, rank) as ``vector.most_similar`` gives it, of what the ``probes`` cells nearest to a query hold: the best ``k * refine`` by their
    codes, ranked by exact cosine, ties by id. Without ``probes``, as many cells as the index's sample needed: few where vectors stand in groups, most where they have none.

    Queries meet the codes of a cell in blocks of ``BLOCK`` rows on either side, so a cell that holds a third of all vectors is many tasks. A query that has fewer
    than ``k`` vectors in its cells gets fewer.
    """
    key = index.key
    asked = _valid(queries, key, vector, index.dim)
    kind = asked.schema["key"].dataType.simpleString()
    if index.coder is None:
        return asked.select(F.col("key").alias(key), F.col("key").alias("other"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where(F.lit(False))
    probes = probes or index.coder.probes
    held, wanted = asked.sparkSession.sparkContext.broadcast(index.coder), k * refine + (0 if same_id else 1)

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = np.argsort(-_unit(np.array(list(b["vector"]))) @ held.value.centres.T, axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(len(b)), near.shape[1])
                yield pd.DataFrame({"q": b["key"].to_numpy()[at], "v": b["vector"].to_numpy()[at], "cell": near.reshape(-1).astype(np.int32)})

    seeking = settled(asked.mapInPandas(probed, f"q {kind}, v array<double>, cell int"), "probes")
    sizes = index.lists.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("across"))
    downs = seeking.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("down"))
    blocks = settled(sizes.join(downs, "cell"), "probe-blocks")  # a row for each cell that is probed
    left = seeking.join(blocks, "cell").select("q", "v", "cell", F.pmod(F.xxhash64("q"), "down").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"))
    right = index.lists.select("cell", F.col("key").alias("other"), "code").join(blocks, "cell")
    right = right.select("cell", "other", "code", F.pmod(F.xxhash64("other"), "across").cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"))

    def scored(group: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            codes, others = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1), b["other"].to_numpy()
            for lo in range(0, len(a), 64):
                part = a.iloc[lo : lo + 64]
                for q, row in zip(part["q"], held.value.scores(_unit(np.array(list(part["v"]))), group[0], codes), strict=True):
                    best = np.argpartition(-row, wanted - 1)[:wanted] if len(row) > wanted else np.arange(len(row))
                    out += [(q, others[x], float(row[x])) for x in best]
        return pd.DataFrame(out, columns=["q", "other", "near"])

    near = left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInPandas(scored, f"q {kind}, other {kind}, near double")
    near = near if same_id else near.where("q != other")
    order = Window.partitionBy("q").orderBy(F.desc("near"), "other")
    near = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k * refine).select("q", "other")
    pairs = near.join(asked.select(F.col("key").alias("q"), F.col("vector").alias("v")), "q").join(index.lists.select(F.col("key").alias("other"), "vector"), "other")
    exact = pairs.select("q", "other", F.round(cosine(F.col("v"), F.col("vector")), 6).alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "other")
    return exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("q").alias(key), "other", "score", "rank")
