"""Semantic search over vectors: exact top-k of one query or of many, centroids, routing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embed import cosine, l2_normalize


def nearest(vectors: DataFrame, query: DataFrame, k: int, *, key: str = "concept_id", vector: str = "vector", scope: Column | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(key, score) of the ``k`` most similar vectors to the one row ``query`` (q), ties by key.

    Other dimensions than the query's are left out before the product; ``exclude`` lists keys. The query is one row, so
    the join is a broadcast of one vector; each task keeps its own top k.
    """
    rows = vectors if scope is None else vectors.where(scope)
    if exclude is not None:
        rows = rows.join(exclude, key, "left_anti")
    scored = rows.select(key, vector).join(F.broadcast(query.select("q").limit(1)))
    scored = scored.where(F.size(vector) == F.size("q")).select(key, cosine(F.col(vector), F.col("q")).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def centroids(vectors: DataFrame, *, group: str = "workspace_id", vector: str = "vector") -> DataFrame:
    """(group, vector): the mean of each group's vectors, at unit length. Sums are combined by place before the shuffle."""
    places = vectors.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = places.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return listed.select(group, l2_normalize(F.transform("v", lambda s: s["x"])).alias("vector"))


def synced_centroids(vectors: DataFrame, descriptions: DataFrame, *, group: str = "workspace_id", vector: str = "vector") -> DataFrame:
    """(group, vector): half the description's vector and half the members' mean, at unit length; the description's alone without members."""
    means = centroids(vectors, group=group, vector=vector).withColumnRenamed("vector", "mean")
    both = F.transform(F.arrays_zip("described", "mean"), lambda s: s["described"].cast("double") * 0.5 + s["mean"] * 0.5)
    mixed = F.when(F.col("mean").isNull() | (F.size("mean") != F.size("described")), F.col("described").cast("array<double>")).otherwise(l2_normalize(both))
    return descriptions.join(means, group, "left").select(group, mixed.alias("vector"))


def route(groups: DataFrame, query: DataFrame, k: int = 3, *, group: str = "workspace_id") -> DataFrame:
    """(group, score) of the ``k`` centroids nearest to the query, best first."""
    return nearest(groups, query, k, key=group)


#: Vectors of a block when vectors are compared: a side is cut into ``GRID`` blocks, but none of fewer than the first or more than the second. Every vector is sent to each block
#: of the other side, so a grid of fixed size moves data in proportion to the vectors. Scores are made for ``STRIP`` of them at once.
BLOCK, MOST_BLOCK, GRID, STRIP = 1024, 16384, 12, 256


def _blocks(rows: int) -> int:
    return max(1, -(-rows // min(MOST_BLOCK, max(BLOCK, -(-rows // GRID)))))


def most_similar(queries: DataFrame, vectors: DataFrame, k: int, *, key: str = "id", vector: str = "vector", least: float = -1.0, same_id: bool = False, before: bool = False) -> DataFrame:
    """(key, other, score, rank): the ``k`` vectors of the highest cosine of ``least`` or more for each query, ties by id.

    Exact: every query meets every vector, a block of each in a task, which keeps k rows a query; of those the best are taken. Pairs of the same id count only
    with ``same_id``, and with ``before`` those of smaller ids only. Vectors of other dimensions, without length or null are similar to none.
    """
    queries, vectors = (df.where(F.col(key).isNotNull()) for df in (queries, vectors))  # so that pandas keeps integer keys as they are
    down, across = (_blocks(df.count()) for df in (queries, vectors))

    def place(blocks: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")

    left = queries.select(F.col(key).alias("q"), F.col(vector).alias("v"), place(down).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("j"))
    right = vectors.select(F.col(key).alias("q"), F.col(vector).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("i"), place(across).alias("j"))

    def unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        x = np.array(list(vectors), float)
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.maximum(length, 1e-300), length[:, 0] > 0

    def compared(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = (df[df["v"].notna() & df["q"].notna()].sort_values("q") for df in (a, b))
        out: list[tuple[object, object, float]] = []
        sizes = b["v"].map(len)
        for size, own in a.groupby(a["v"].map(len)):
            there = b[sizes == size]
            if size and len(there):
                others = there["q"].to_numpy()
                (x, x_long), (y, y_long) = unit(own["v"]), unit(there["v"])
                for n, q in enumerate(own["q"]):
                    if n % STRIP == 0:
                        scores = np.round(x[n : n + STRIP] @ y.T, 6)
                        scores[~x_long[n : n + STRIP]] = scores[:, ~y_long] = -np.inf
                    row = scores[n % STRIP]
                    row = np.where(others >= q, -np.inf, row) if before else row if same_id else np.where(others == q, -np.inf, row)
                    at = np.flatnonzero(row >= least)
                    if len(at) > k:  # all that reach the k-th highest, ties included
                        at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k]]
                    out += [(q, others[i], float(row[i])) for i in at[np.lexsort((at, -row[at]))][:k]]
        return pd.DataFrame(out, columns=["q", "other", "score"])

    kind = queries.schema[key].dataType.simpleString()
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(compared, f"q {kind}, other {kind}, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("q").alias(key), "other", "score", "rank")
