import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import fusion, keyword, rawsearch, vector, vector_index
from quern.plans.engine import tiered

TOY = [
    ("d1", "gpu memory", "", "", "fast memory io", "body text memory"), ("d2", "kernel", "gpu", "x", "gpu thing", "none"), ("d3", "alpha", "", "", "beta", "gamma"),
    ("d4", "delta", "", "", "eps", "zeta words here"), ("d5", "mem", "", "", "y", "z memories"), *[(f"d{i}", "q", "", "", "w", "e") for i in range(6, 10)],
]


def toy(spark, query, stem=True):
    df = spark.createDataFrame(TOY, "id string, name string, aliases string, tags string, summary string, body string")
    tokens = keyword.tokenized(df, "id", list(keyword.FIELD_WEIGHTS), stem=stem)
    return {r["id"]: r["score"] for r in keyword.bm25(tokens, "id", query, keyword.FIELD_WEIGHTS, stem=stem).collect()}


def test_bm25_goldens(spark):
    assert toy(spark, "gpu") == pytest.approx({"d2": 1.7329054213708301, "d1": 1.725093676420999})
    assert toy(spark, "memory") == pytest.approx({"d1": 1.8787490103114493, "d5": 1.1227871312060387})
    assert toy(spark, "gpu memory") == pytest.approx({"d1": 9.931439096801592, "d2": 1.7329054213708301, "d5": 1.1227871312060387})


def test_bm25_edges(spark):
    assert toy(spark, "!!") == {} and toy(spark, "absent") == {} and set(toy(spark, "memor", stem=False)) == {"d1", "d5"}


def test_folding():
    assert keyword.fold("Café") == "cafe"


def test_rrf(spark):
    k = spark.createDataFrame([("a", 3.0), ("b", 2.0)], "concept_id string, score double")
    v = spark.createDataFrame([("a", 0.9), ("c", 0.8), ("b", 0.7)], "concept_id string, score double")
    assert {r["concept_id"]: r["score"] for r in fusion.reciprocal_rank(k, v).collect()} == {"a": 3.2787, "b": pytest.approx(100 / 62 + 100 / 63, abs=1e-4), "c": 1.6129}
    assert {r["concept_id"]: r["score"] for r in fusion.linear(k, v).collect()} == {"a": 1.0, "c": 0.25, "b": 0.0}


def test_fusion_of_empty_lists(spark):
    none = spark.createDataFrame([], "concept_id string, score double")
    assert fusion.reciprocal_rank(none, none).count() == 0 and fusion.linear(none, none).count() == 0


def test_nearest(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [1.0, 0.0], "y"), ("c", [0.0, 2.0], "x"), ("d", [1.0], "x"), ("e", [0.0, 0.0], "x")], "concept_id string, vector array<double>, workspace_id string")
    q = spark.createDataFrame([([3.0, 0.0],)], "q array<double>")
    assert [tuple(r) for r in vector.nearest(v, q, 3).collect()] == [("a", 1.0), ("b", 1.0), ("c", 0.0)]
    assert [r["concept_id"] for r in vector.nearest(v, q, 3, scope=F.col("workspace_id") == "x", exclude=v.where("concept_id = 'a'")).collect()] == ["c", "e"]
    centre = {r["workspace_id"]: r["vector"] for r in vector.centroids(v.where("size(vector) = 2")).collect()}
    assert centre["y"] == [1.0, 0.0] and sum(x * x for x in centre["x"]) == pytest.approx(1)
    described = spark.createDataFrame([("x", [0.0, 1.0]), ("none", [1.0, 0.0])], "workspace_id string, described array<double>")
    synced = {r["workspace_id"]: r["vector"] for r in vector.synced_centroids(v.where("size(vector) = 2"), described).collect()}
    assert synced["none"] == [1.0, 0.0] and sum(x * x for x in synced["x"]) == pytest.approx(1)


def test_raw_search(spark):
    raw = spark.createDataFrame([("1", "The title", "the end, The", "w"), ("2", "none", "zzz", "w"), ("3", None, "bathe", "w")], "id string, title string, content string, workspace_id string")
    got = [(r["id"], r["match_count"]) for r in rawsearch.raw_search(raw, "the").collect()]
    assert got == [("1", 7), ("3", 1)]
    hits = rawsearch.as_hits(rawsearch.raw_matches(raw, "the")).collect()
    assert {(r["concept_id"], r["score"]) for r in hits} == {("raw:1", 0.69), ("raw:3", 0.57)}


def test_tiers(spark):
    a = spark.createDataFrame([("x", 0.1)], "concept_id string, score double")
    b = spark.createDataFrame([("raw:1", 0.9), ("x", 0.8), ("raw:2", 0.7)], "concept_id string, score double")
    assert [r["concept_id"] for r in tiered(a, b, 2).collect()] == ["x", "raw:1"]


@pytest.mark.parametrize("kind", ["groups", "none"])
def test_index_reaches_nine_tenths_of_the_nearest(spark, monkeypatch, kind):
    """Against the exact way, with odd rows among the vectors and blocks smaller than cells; scores are exact, and grouped vectors need few cells."""
    monkeypatch.setattr(vector_index, "BLOCK", 100)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 16)) * (0.3 if kind == "groups" else 1)
    if kind == "groups":
        x += 3 * rng.normal(size=(40, 16))[rng.integers(0, 40, len(x))]
    rows = [(2**53 + k, v.tolist()) for k, v in enumerate(x)] + [(1, None), (2, [1.0]), (3, [0.0] * 16), (4, [None] * 16), (None, [1.0] * 16)] + [(k, x[0].tolist()) for k in range(10, 15)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    q = v.where("id % 20 = 0")
    exact, index = {}, vector_index.build_index(v, 16)
    for r in vector.most_similar(q, v, 5).collect():
        exact[r["id"], r["other"]] = r["score"]
    got = {(r["id"], r["other"]): r["score"] for r in vector_index.search_index(index, q, 5).collect()}
    assert index.lists.count() == 1205 and len(got) == len(exact)
    assert sum(p in got for p in exact) >= 0.9 * len(exact)
    assert all(got[p] == pytest.approx(exact[p], abs=1e-6) for p in exact if p in got)
    assert index.coder.probes <= (3 if kind == "groups" else len(index.coder.centres))
    if kind == "none":
        nothing = vector_index.build_index(v.where("false"), 16)
        assert vector_index.search_index(nothing, q, 5).count() == 0


def test_blocks_of_vectors_grow_with_them(spark, monkeypatch):
    """A side of 170,000 vectors is 12 blocks (167 before), and one block of several strips gives the same pairs as small blocks."""
    import numpy as np

    from quern.operators import vector

    assert vector._blocks(170_000) == vector.GRID and vector._blocks(900) == 1
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    np.fill_diagonal(scores, -2)
    want = {(i, int(j), k) for i, row in enumerate(scores) for k, j in enumerate(np.lexsort((np.arange(300), -row))[:2], 1)}
    for block in (1024, 20):
        monkeypatch.setattr(vector, "BLOCK", block)
        assert {(r["id"], r["other"], r["rank"]) for r in vector.most_similar(v, v, 2).collect()} == want


def test_postings_are_made_without_a_shuffle(spark):
    """The terms of a row are grouped where it stands (a shuffle of every word's place before), with nulls, empty and repeated words."""
    from pyspark.sql import functions as F

    rows = [(k, " ".join(f"w{(k * j) % 7}" for j in range(k % 40)), None if k % 3 else "Zoë x-x x") for k in range(700)]
    tokens = keyword.tokenized(spark.createDataFrame(rows, "id int, name string, body string"), "id", ["name", "body"])
    made = keyword.postings(tokens, "id", ["name", "body"])
    assert "Exchange" not in made._jdf.queryExecution().toString()
    want = {}
    for r in tokens.collect():
        for f in ("name", "body"):
            for pos, t in enumerate(r[f]):
                want.setdefault((r["id"], f, t), []).append(pos)
    got = {(r["id"], r["field"], r["term"]): r["positions"] for r in made.collect()}
    assert got == want and made.select(F.sum(F.size("positions"))).first()[0] == sum(map(len, want.values()))
