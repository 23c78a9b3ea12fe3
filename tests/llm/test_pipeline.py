import importlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_near_dedup", "op7_mixture"])
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    got = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=repr)
    assert rows(entry.queries()[name](spark, SMALL)) == want


def test_every_operator_has_its_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).persist()
        if name != "pieces":
            assert docs.columns == columns, name
        if name in ("language", "lines", "near_copies"):
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.where(F.col("n_tokens") != F.size("ids")).isEmpty() and docs.count() > 0


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_the_rest_imports_without_the_operators(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "quern.llm", None)
    monkeypatch.setattr("importlib.util.find_spec", lambda *_: None)
    fresh = importlib.util.module_from_spec(importlib.machinery.PathFinder.find_spec("__spark_entry__"))
    importlib.machinery.PathFinder.find_spec("__spark_entry__").loader.exec_module(fresh)
    assert not any(n.startswith("op") for n in fresh.queries())


def test_near_copies_of_over_80_percent_go(spark):
    """Of texts of 100 shingles and those with 19 to 24 more (similarity .81 to .84) one stays; one with 30 more (.77) does too."""
    words = [[f"w{k}x{i}" for i in range(150)] for k in range(12)]
    rows = []
    for k, w in enumerate(words):
        rows += [(2 * k, " ".join(w[:104])), (2 * k + 1, " ".join(w[: 104 + 19 + k % 6]))]
    rows += [(100, " ".join(words[0][:104] + [f"y{i}" for i in range(30)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect())
    assert got == [*range(0, 24, 2), 100]


EDGE_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, band string, gone string, score string, row string, tag long, ids string"


def edge_table(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns whose names the operators use."""
    en = "the and of that with this from have which there their would about could other than them these some into".split()
    de = "der die und das nicht mit ist auf eine auch werden nach bei noch über zum können wenn oder durch".split()
    rng = random.Random(7)

    def prose(words, n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows = [(d, prose(en if d % 2 else de, 60), "en" if d % 2 else "de", "s") for d in range(80)]
    run = prose(en, 55)
    rows += [(100, run + "\nown end one", "en", "t"), (101, "other start\n" + run, "en", "t"), (101, "other start\n" + run, "en", "t"), (102, run, "en", "t")]
    rows += [(200, None, None, None), (None, None, None, None), (None, prose(en, 80), None, None), (201, "", "en", "t"), (202, " \n ", "en", "t"), (203, "12 !? 34", "en", "t")]
    rows += [(None, prose(de, 70), "de", None)] * 2 + [(300, prose(en, 40_000), "en", "u"), (2**53 + 1, prose(en, 90), None, "u"), (2**53 + 2, prose(de, 90), None, None)]
    rows += [(400, rows[5][1] + " end", "en", "s"), (400, "quite " + rows[7][1], "en", "s")]
    full = [(*r, len(r[1]) if r[1] else None, "b", None, "x", "y", 5, None) for r in rows]
    return spark.createDataFrame(full, EDGE_COLUMNS)


def test_stages_take_edge_cases(spark):
    docs = edge_table(spark)
    columns = docs.columns
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).persist()
        rows = docs.collect()
        counts[name] = len(rows)
        if name != "pieces":
            assert docs.columns == columns
        ids = [r["doc_id"] for r in rows]
        if name == "language":
            assert not {200, 201, 202, 203} & set(ids) and all(r["text"] for r in rows)
            assert {100, 101, 102, 300, 400, 2**53 + 1, 2**53 + 2} <= set(ids) and ids.count(None) == 3 and ids.count(101) == 2
        if name == "lines":
            text = {r["doc_id"]: r["text"] for r in rows}
            assert text[100].endswith("own end one") and text[101] == "other start" and 102 not in text and ids.count(101) == 2
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["doc_id"] in (100, 101))
        if name == "near_copies":
            assert 400 not in ids and {5, 7, 2**53 + 1} <= set(ids) and ids.count(None) == 3
    assert counts["language"] >= counts["lines"] >= counts["near_copies"] > 80 and counts["mixture"] == counts["pieces"] > 0


def test_stages_agree_with_plain_python(spark):
    """Line dedup, near copies, mixture and pieces of the edge table against the brute-force versions of their tests."""
    from collections import Counter

    from . import test_line_dedup, test_near_dedup

    table = edge_table(spark).where("doc_id IS NOT NULL AND doc_id NOT IN (101, 400)")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    stages = dict(corpus_pipeline.STAGES)
    cut = {d: t for d, t in test_line_dedup.brute(rows).items() if t and test_line_dedup.WORD.search(t)}
    lines = stages["lines"](spark, table, SMALL).persist()
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == cut
    near = stages["near_copies"](spark, lines, SMALL).persist()
    classes = test_near_dedup.brute(list(cut.items()), 80)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(d for d, (_, c) in classes.items() if c == d)
    mixed = stages["mixture"](spark, near, SMALL).persist()
    assert {r["doc_id"]: r["text"] for r in mixed.collect()}.items() <= cut.items()
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    import sentencepiece

    from quern.llm import pieces

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    want = Counter((r["doc_id"], tuple(sp.encode(r["text"]))) for r in mixed.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in stages["pieces"](spark, mixed, SMALL).collect()) == want
