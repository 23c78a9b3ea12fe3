"""Exact k-means over integers; a PCA rotation tells which centroids can't be the nearest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Largest absolute integer of a component: squared distances of 64 of them fit in a long.
LARGEST = 1 << 27
#: Rotated coordinates that are stored; the rest of a vector is its residual norm.
LEADING = 12


def whole_vectors(vectors: DataFrame, dim: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, x array<int>): the vectors of ``dim`` finite components, each times ``scale`` and rounded down.

    Null vectors, those of other lengths and those with a null, infinite or undefined component are left out. A component
    beyond ``LARGEST`` is an error, since distances would no longer fit in a long.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.where((F.size("embedding") == dim) & F.coalesce(finite, F.lit(False)))

    def whole(v: Column) -> Column:
        up = F.floor(v.cast("double") * scale)
        return F.when(F.abs(v.cast("double") * scale) <= LARGEST, up.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))

    return kept.select("vec_id", F.transform("embedding", whole).alias("x"))


def rotation(whole: DataFrame, dim: int, leading: int) -> np.ndarray:
    """(dim, leading): the first principal axes of all vectors; Spark sums up the covariance in a tree.

    Any orthonormal columns give valid bounds, so axes of equal spread, which may come in any turn, change no result.
    """
    if len(whole.take(2)) < 2:
        return np.eye(dim)[:, :leading]
    fitted = PCA(k=dim, inputCol="v", outputCol="r").fit(whole.select(array_to_vector(F.col("x").cast("array<double>")).alias("v")))
    axes = np.linalg.qr(np.nan_to_num(fitted.pc.toArray()))[0]  # orthonormal to the last digit
    return np.ascontiguousarray(axes[:, :leading])


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(values.reshape(-1)))


def project(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates, and the norm of what they leave."""
    x = x.astype(float)
    lead = x @ axes
    return lead, np.sqrt(np.maximum((x * x).sum(axis=1) - (lead * lead).sum(axis=1), 0))


def rotated(whole: DataFrame, axes: np.ndarray) -> DataFrame:
    """``whole`` with ``lead`` (leading coordinates) and ``rest`` (residual norm)."""
    dim, kind = axes.shape[0], pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lead, rest = project(_matrix(b.column("x"), dim, np.int64), axes)
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(lead).cast(kind), pa.array(rest)], names=[*b.schema.names, "lead", "rest"])

    return whole.mapInArrow(run, f"vec_id {whole.schema['vec_id'].dataType.simpleString()}, x array<int>, lead array<double>, rest double")


def nearest_centroid(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of each vector's nearest centroid, the smaller number on ties, and how many distances were needed.

    The squared distance of the leading coordinates and that of the residual norms add up to no more than the whole one. The centroid of
    the least bound is measured in integers; the others only where their bound, less the rounding of doubles, isn't above that.
    """
    c_lead, c_rest = project(centroids, axes)
    bound = ((lead[:, None, :] - c_lead[None]) ** 2).sum(axis=2) + (rest[:, None] - c_rest[None]) ** 2
    size = (lead * lead).sum(axis=1) + rest * rest
    slack = 1e-9 * (size[:, None] + (c_lead * c_lead).sum(axis=1) + c_rest * c_rest) + 1e-6

    def exact(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        gap = x[rows] - centroids[at]
        return (gap * gap).sum(axis=1)

    every = np.arange(len(x))
    first = bound.argmin(axis=1)
    least = exact(every, first)
    open_ = bound - slack <= least[:, None]
    open_[every, first] = False
    rows, at = np.nonzero(open_)
    best = np.full((len(x), len(centroids)), np.iinfo(np.int64).max)
    best[every, first] = least
    best[rows, at] = exact(rows, at)
    number = best.argmin(axis=1)  # the first of equal ones
    return number, best[every, number], len(x) + len(rows)


def assigned(stored: DataFrame, centroids: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each stored vector."""
    dim, leading = axes.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, distance, _ = nearest_centroid(_matrix(b.column("x"), dim, np.int64), _matrix(b.column("lead"), leading, float), np.asarray(b.column("rest")), centroids, axes)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return stored.mapInArrow(run, f"vec_id {stored.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster_sums(stored: DataFrame, centroids: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(cluster, n, sums): how many vectors each centroid gets and their componentwise sum; a task sends a row for each centroid."""
    dim, leading = axes.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
        for b in batches:
            x = _matrix(b.column("x"), dim, np.int64)
            number, _, _ = nearest_centroid(x, _matrix(b.column("lead"), leading, float), np.asarray(b.column("rest")), centroids, axes)
            counts += np.bincount(number, minlength=len(centroids))
            order = np.argsort(number, kind="stable")
            there, starts = np.unique(number[order], return_index=True)
            if len(there):
                sums[there] += np.add.reduceat(x[order], starts, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centroids), dtype=np.int32)), pa.array(counts), _lists(sums).cast(pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = stored.select("x", "lead", "rest").mapInArrow(run, "cluster int, n long, sums array<long>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(dim)]).alias("sums"))


def first_centroids(stored: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of the least sha256 of ``seed:vec_id``, in that order; of rows that share an id, null or not, the least by components first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = stored.select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def centroid_clusters(vectors: DataFrame, *, dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3, leading: int = LEADING) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector (vec_id, embedding) that ``whole_vectors`` keeps.

    ``rounds`` times, vectors go to the nearest centroid by squared distance (the smaller number on ties) and centroids to the rounded-down
    mean of their vectors; one without vectors stays. All in integers, so any order of tasks gives the same rows. The driver holds the ``k`` centroids
    and the axes only. Repeated rows count each; with fewer than ``k`` vectors each is a centroid; without any the result is empty. Other
    columns of ``vectors`` are ignored.
    """
    whole = materialise(whole_vectors(vectors, dim, scale), "whole-vectors")
    axes = rotation(whole, dim, min(leading, dim))
    stored = materialise(rotated(whole, axes), "rotated-vectors")
    centroids = first_centroids(stored, k, seed)
    if len(centroids):
        for _ in range(rounds):
            moved = centroids.copy()
            for r in cluster_sums(stored, centroids, axes).where("n > 0").collect():  # k rows
                moved[r["cluster"]] = [s // r["n"] for s in r["sums"]]
            if (moved == centroids).all():
                break
            centroids = moved
    found = assigned(stored, centroids, axes) if len(centroids) else stored.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where(F.lit(False))
    found = materialise(found, "assigned-vectors")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = vectors.sparkSession.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole_sum = found.agg(F.sum("distance").alias("inertia"))
    figures = F.broadcast(sums.join(named, "cluster").join(F.broadcast(whole_sum)))  # k rows and one row
    return found.join(figures, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(rounds: int = 10, k: int = 8, seed: int = 3, dim: int = 64, scale: int = 1024) -> str:
    """DuckDB: the same clusters in one statement, over ``embeddings``."""
    near = "SELECT v.vec_id, v.row, v.x, arg_min(c.cluster, struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT, c := c.cluster)) AS cluster FROM v, c{0} c GROUP BY ALL"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), x) - 1)::INT AS cluster, x FROM v QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), x) <= {k})",
    ]
    for r in range(rounds):
        steps += [
            f"n{r} AS MATERIALIZED ({near.format(r)})",
            f"s{r} AS (SELECT cluster, place, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS place FROM n{r}) GROUP BY cluster, place)",
            f"m{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS x FROM s{r} GROUP BY cluster)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster)",
        ]
    last = f"""e AS (SELECT n.vec_id, n.cluster, list_sum(list_transform(list_zip(n.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance, sha256(array_to_string(c.x, ',')) AS centroid_sha256
  FROM ({near.format(rounds)}) n JOIN c{rounds} c ON c.cluster = n.cluster)"""
    return "WITH " + ",\n".join([*steps, last]) + "\nSELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256 FROM e"
