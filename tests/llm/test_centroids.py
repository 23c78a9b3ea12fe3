import hashlib
import math
import random

import numpy as np
import pytest

from quern.llm import centroids

VECTORS = "vec_id long, embedding array<float>, cluster string"


def plain(rows, dim=64, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(x) for _, x in first]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        at = [near(x)[1] for _, x in kept]
        for j in range(len(centres)):
            mine = [x for (_, x), a in zip(kept, at, strict=True) if a == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [(i, *near(x)) for i, x in kept]
    total = sum(d for _, d, _ in last)
    return sorted(
        ((i, j, d, sum(e for _, e, h in last if h == j), total, hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in last), key=repr
    )


def found(spark, rows, **kwargs):
    df = centroids.centroid_clusters(spark.createDataFrame([(i, v, "mine") for i, v in rows], VECTORS), **kwargs)
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def vectors(rng, n, spread=1.0):
    return [[rng.gauss(rng.randint(-2, 2), spread) for _ in range(64)] for _ in range(n)]


@pytest.mark.parametrize(("n", "spread"), [(120, 1.0), (3, 1.0), (60, 0.001), (40, 25_000.0)])
def test_equals_the_plain_version(spark, n, spread):
    rows = list(enumerate(vectors(random.Random(n), n, spread)))
    assert found(spark, rows) == plain(rows)


def test_ties_repeats_nulls_and_rows_that_are_left_out(spark):
    rng = random.Random(5)
    same = vectors(rng, 1)[0]
    rows = [(k, same) for k in range(12)] + [(2**53 + 1, [0.0] * 64), (None, [0.0] * 64), (None, same), (7, same)] + list(enumerate(vectors(rng, 20), 50))
    odd = [(90, None), (91, []), (92, [1.0] * 63), (93, [1.0] * 65), (94, [float("nan")] * 64), (95, [float("inf")] + [0.0] * 63), (96, [None] + [0.0] * 63)]
    assert found(spark, rows + odd) == plain(rows)
    assert found(spark, odd) == []
    assert found(spark, []) == []


def test_components_beyond_the_bound_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, [1e9] * 64), (2, [0.0] * 64)])


def test_bounds_never_lose_the_nearest_and_spare_distances():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (8, 64))
    x = centres[rng.integers(0, 8, 3000)] + rng.integers(-300, 300, (3000, 64))
    x[:8] = centres
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0][:, :12]
    number, distance, needed = centroids.nearest_centroid(x, *centroids.project(x, axes), centres, axes)
    every = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert needed < 2 * len(x)  # of 8 for each vector
