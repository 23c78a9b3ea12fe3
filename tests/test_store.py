import json
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.operators import crawl, distill
from quern.plans.engine import Engine
from quern.schema import CONCEPT, EDGE, LENGTH, POSTING, RAW_DOCUMENT
from quern.sources import readers, snapshots
from quern.sources.snapshots import Table
from quern.streaming import ingest


def concept(id, name, workspace="default", tags=(), relations=(), summary="", mechanisms=(), sources=()):
    return (id, name, [], "algorithm", list(tags), [tuple(r) for r in relations], summary, list(mechanisms), ([], []), [], list(sources), workspace, "2026-01-01", "2026-01-01")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    e.create_workspace("AI Systems", "AI")
    e.create_workspace("bio", "Bio Med", "biology", ["b"])
    rows = [
        concept("flash_attention", "Flash Attention", "ai_systems", ["gpu"], [("improves", "attention", "fast")], "attention with less GPU memory traffic", ["tiling of attention in memory"], ["raw:r1"]),
        concept("paged_attention", "Paged Attention", "ai_systems", ["gpu"], [("variant_of", "attention", "")], "attention with paged memory", ["blocks of memory"]),
        concept("crispr", "CRISPR", "bio", ["gene"], [], "editing of genes with proteins", ["guide sequences cut genes"]),
        concept("attention", "Attention", "ai_systems", [], [], "weights over tokens"),
    ]
    e.save_concepts(spark.createDataFrame(rows, CONCEPT))
    e.save_raw(spark.createDataFrame([("r1", "Paper", "u", "the attention paper", 19, "ai_systems", "2026-01-01")], RAW_DOCUMENT))
    return e


def ids(df):
    return [r["concept_id"] for r in df.collect()]


def test_search_modes(engine):
    assert set(ids(engine.search("attention memory", "keyword", 3))) == {"flash_attention", "paged_attention", "attention"}
    hybrid = engine.search("attention memory", limit=3).collect()
    assert hybrid[0]["concept_id"] in ("flash_attention", "paged_attention") and hybrid[0]["matched_by"] == "hybrid_rrf"
    assert ids(engine.search("genes", "vector", 1)) == ["crispr"]
    assert engine.search("attention memory", "graph", 3).first()["matched_by"] == "hipporag"
    assert ids(engine.search("attention", "keyword", 5, "bio")) == []
    assert "raw:r1" in ids(engine.search("attention", "keyword", 5))


def test_routing(engine):
    assert engine.route("editing genes proteins").first()["workspace_id"] == "bio"
    assert engine.route(" ").collect()[0][:] == ("default", 1.0)
    assert ids(engine.search("editing genes", "keyword", 5, "auto")) == ["crispr"]


def test_workspaces(engine):
    got = {r["id"]: (r["name"], r["concept_count"], r["raw_count"]) for r in engine.workspaces().collect()}
    assert got == {"ai_systems": ("AI", 3, 1), "bio": ("Bio Med", 1, 0)}
    assert engine.resolve("BIO med") == "bio" and engine.resolve("all") is None and engine.resolve("other") == "other"
    assert engine.delete_workspace("default") is False


def test_edges_and_deletion(engine, spark):
    new = spark.createDataFrame([("crispr", "related_to", "attention", ""), ("attention", "related_to", "crispr", ""), ("crispr", "related_to", "crispr", "")], "source_id string, relation_type string, target_id string, reason string")
    engine.add_edges(new)
    engine.add_edges(new)
    assert engine.edges().where("origin = 'auto'").count() == 1
    engine.save_concepts(spark.createDataFrame([concept("crispr", "CRISPR", "bio", summary="genes")], CONCEPT))
    assert engine.edges().where("origin = 'auto'").count() == 1  # it survives a save of its source
    engine.delete_concepts(spark.createDataFrame([("paged_attention",)], "id string"))
    assert engine.edges().where("source_id = 'paged_attention' OR target_id = 'paged_attention'").count() == 0
    engine.delete_raw(spark.createDataFrame([("r1",)], "id string"))
    assert engine.concepts().where("array_contains(sources, 'raw:r1')").count() == 0
    engine.prune(spark.createDataFrame([("attention",), ("crispr",)], "id string"))
    assert {r["id"] for r in engine.concepts().collect()} == {"attention", "crispr"}
    engine.log("cli", "search", "q", '{"a": 1}', 2, "bio")
    engine.log("cli", "search", "q2")
    assert [r["id"] for r in engine.logs().collect()] == [2, 1]
    assert engine.stats().first()["concepts"] == 2
    assert engine.delete_workspace("bio") and engine.concepts("default").count() == 1


def test_index_export_and_lookups(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    rows = [concept("a_b", "Alpha Beta", tags=["t"], relations=[("r", "c", "why")], summary="about memory"), concept("c", "Gamma", summary="memories of gpu memory")]
    e.save_concepts(spark.createDataFrame(rows, CONCEPT))
    from quern.operators import keyword
    from quern.plans.engine import searched_fields

    fields = list(keyword.FIELD_WEIGHTS)
    tokens = keyword.tokenized(searched_fields(e.concepts()), "id", fields, stem=True)
    for q in ("memory", "gpu memory", "alpha", "memory gpu memory"):
        scan = {r["id"]: round(r["score"], 9) for r in keyword.bm25(tokens, "id", q, keyword.FIELD_WEIGHTS, stem=True).collect()}
        index = {r["id"]: round(r["score"], 9) for r in keyword.indexed_bm25(e.postings.read(), e.lengths.read(), "id", q, keyword.FIELD_WEIGHTS, stem=True).collect()}
        assert scan == index and scan, q
    assert ids(e.search("lpha", "keyword", 5)) == ["a_b"]  # no term starts so: found by substring
    e.save_concepts(spark.createDataFrame([concept("a_b", "Alpha Beta", relations=[("later", "c", "")], summary="changed")], CONCEPT))
    e.add_edges(spark.createDataFrame([("a_b", "last", "c", "")], "source_id string, relation_type string, target_id string, reason string"))
    from quern.operators import graph

    assert [r["relation_type"] for r in graph.collapsed_edges(e.edges()).collect()] == ["last"]
    assert e.postings.read().where("id = 'a_b' AND term LIKE 'memor%'").count() == 0
    assert e.concept("A b").first()["name"] == "Alpha Beta" and "Alpha Beta" in e.markdown("a_b").first()["markdown"] and e.raw_text("none") == ""
    e.export_graph(f"file://{tmp_path}/graph")
    assert spark.read.json(f"file://{tmp_path}/graph/nodes").count() == 2 and spark.read.json(f"file://{tmp_path}/graph/edges").first()["type"] == "last"
    e.save_concepts(spark.createDataFrame([concept("d", "Gamma rays", summary="gpu memory", sources=["x", "y"])], CONCEPT))
    e.export_graph(f"file://{tmp_path}/graph")
    shown = {(r["source"], r["target"], r["inferred"]) for r in spark.read.json(f"file://{tmp_path}/graph/edges").collect()}
    assert shown == {("a_b", "c", False), ("d", "c", True)}
    assert {r["id"]: r["sources_count"] for r in spark.read.json(f"file://{tmp_path}/graph/nodes").collect()} == {"a_b": 1, "c": 1, "d": 2}


def test_nearest_of_many_queries_is_exact(spark, monkeypatch):
    """Recall 1 against brute force, in small blocks, with ties, nulls, other dimensions and vectors without length."""
    from quern.operators import vector

    monkeypatch.setattr(vector, "BLOCK", 16)
    rng = random.Random(5)
    rows = [(k, [float(rng.randint(-3, 3)) for _ in range(4)]) for k in range(120)] + [(200, None), (201, [0.0] * 4), (202, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {}
    for r in vector.most_similar(df.where("id % 5 = 0"), df, 3).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["other"], r["score"])
    size = lambda v: sum(x * x for x in v) ** 0.5
    for q, v in rows:
        if q % 5 == 0 and v and size(v):
            others = [(o, round(sum(x * y for x, y in zip(v, w, strict=True)) / size(v) / size(w), 6)) for o, w in rows if o != q and w and len(w) == len(v) and size(w)]
            want = sorted(others, key=lambda x: (-x[1], x[0]))[:3]
            assert [got[q][k][0] for k in (1, 2, 3)] == [o for o, _ in want] and [got[q][k][1] for k in (1, 2, 3)] == pytest.approx([x for _, x in want], abs=2e-6)
    assert not {200} & set(got)


def test_similar_sets_are_exact(spark, monkeypatch):
    from quern.operators import graph

    monkeypatch.setattr(graph, "BLOCK", 8)
    rng = random.Random(6)
    words = ["common"] + [f"word{i}" for i in range(12)]
    rows = [(f"n{k:02}", " ".join(rng.sample(words, rng.randint(0, 5)) + ["common"] * (k % 2))) for k in range(60)]
    got = {r["id"]: (r["other"], r["score"]) for r in graph.similar_pairs(spark.createDataFrame(rows, "id string, text string")).collect()}
    sets = {i: set(t.split()) for i, t in rows}
    for i, s in sets.items():
        scored = [(round(len(s & o) / len(s | o), 6), j) for j, o in sets.items() if j != i and s | o and s]
        best = max((x for x, _ in scored), default=0)
        assert got.get(i) == ((min(j for x, j in scored if x == best), best) if best >= 0.04 else None), i


def test_tables_keep_versions(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), EDGE)
    assert t.read().count() == 0
    row = spark.createDataFrame([("a", "r", "b", "", "auto", 1)], EDGE)
    t.write(row)
    t.write(t.read().unionByName(row))
    (tmp_path / "t" / "v9").mkdir()  # a write that never ended
    assert t.read().count() == 2
    assert t.forget() == 1 and t.read().count() == 2


def test_two_writers_lose_no_rows(spark, tmp_path):
    """Of two that read the same version the later one is refused, also after rows were added or while the other still writes."""
    a, b = (Table(spark, f"file://{tmp_path}/t", EDGE) for _ in range(2))
    rows = spark.createDataFrame([("x", "r", "y", "", "card", 1)], EDGE)
    a.write(rows)
    mine, other = a.read(), b.read()
    a.write(mine.union(rows))
    with pytest.raises(snapshots.ChangedTableError):
        b.write(other)
    assert b.read().count() == 2
    a.append(rows)
    with pytest.raises(snapshots.ChangedTableError):
        b.write(other)
    again = b.read()
    (tmp_path / "t" / "claim-v3").touch()
    with pytest.raises(snapshots.ChangedTableError):
        b.write(again)
    (tmp_path / "t" / "claim-v3").unlink()
    b.write(again)
    assert a.read().count() == 3


def held(t):
    return sorted(map(tuple, t.read().collect()))


def marks(path, version):
    return sorted(x.name for x in (path / f"v{version}").iterdir() if "=" in x.name)


def test_parts_change_alone(spark, tmp_path):
    """Random changes, deletions and additions give the rows of a dict, and write the parts of their keys only."""
    rng, want, path = random.Random(3), {}, tmp_path / "t"
    t = Table(spark, f"file://{path}", LENGTH, key="id", parts=8, merge_after=12)

    def rows(keys, n):
        return spark.createDataFrame([(k, n) for k in keys], LENGTH)

    part = {r["id"]: r["p"] for r in spark.range(60).select(F.concat(F.lit("k"), "id").alias("id")).withColumn("p", F.pmod(F.xxhash64("id"), F.lit(8))).collect()}
    t.change(rows(["k0"], 0), lambda old: snapshots.upsert(old, rows(["k0"], 0), "id"))
    want["k0"] = 0
    assert len([m for m in marks(path, 1) if m.startswith("gone")]) == 8
    for n in range(1, 16):
        keys = rng.sample(sorted(part), rng.choice([1, 2, 20]))
        if n % 4 == 0:  # also a part that is emptied
            keys = [k for k in part if part[k] == n % 8]
            t.change(rows(keys, n), lambda old, keys=keys: snapshots.without_ids(old, rows(keys, 0), "id"))
            want = {k: v for k, v in want.items() if k not in keys}
        elif n % 4 == 3:
            keys = [f"k{60 + n}", *(k for k in keys if k not in want)]
            t.append(rows(keys, n))
            want |= dict.fromkeys(keys, n)
        else:
            t.change(rows(keys, n), lambda old, keys=keys, n=n: snapshots.upsert(old, rows(keys, n), "id"))
            want |= dict.fromkeys(keys, n)
        assert held(t) == sorted(want.items()), n
        gone = {int(m.split("=")[1]) for m in marks(path, t._newest()) if m.startswith("gone8=")}
        assert gone == (set() if n % 4 == 3 else {part[k] for k in keys}) or (n > 11 and len(gone) == 8), n
    before = t.stamp()
    t.change(rows([], 0), lambda old: old.where("false"))
    t.append(rows([], 0))
    assert t.stamp() == before
    (path / "v99" / "gone8=0").mkdir(parents=True)  # a change that never ended
    assert held(t) == sorted(want.items())
    assert t.forget() > 0 and held(t) == sorted(want.items()) and t.forget() == 0


def test_parts_of_another_number_and_of_older_tables(spark, tmp_path):
    def rows(n, v=0):
        return spark.createDataFrame([(f"k{i}", v) for i in range(n)], LENGTH)

    path = f"file://{tmp_path}/t"
    Table(spark, path, LENGTH).write(rows(5))  # not dealt into parts
    t = Table(spark, path, LENGTH, key="id", parts=4)
    t.append(spark.createDataFrame([("more", 1)], LENGTH))
    assert t.read().count() == 6
    t.change(rows(1), lambda old: snapshots.upsert(old, rows(1, 7), "id"))
    assert t.read().count() == 6 and len([m for m in marks(tmp_path / "t", 3) if m.startswith("gone4=")]) == 4
    other = Table(spark, path, LENGTH, key="id", parts=3)
    assert held(other) == held(t)
    other.change(rows(1), lambda old: snapshots.upsert(old, rows(1, 8), "id"))
    assert held(other) == sorted([("k0", 8), *((f"k{i}", 0) for i in range(1, 5)), ("more", 1)])
    assert len([m for m in marks(tmp_path / "t", 4) if m.startswith("gone3=")]) == 3


def test_a_large_part_is_written_by_several_tasks(spark, tmp_path):
    """Each of its files is sorted, and a search for terms is pushed to them."""
    t = Table(spark, str(tmp_path / "t"), POSTING, sorted_by="term", key="id", parts=2)
    rows = spark.range(60000).select(F.concat(F.lit("d"), F.col("id") % 50).alias("id"), F.lit("name").alias("field"), F.md5(F.col("id").cast("string")).alias("term"), F.array(F.lit(1)).alias("positions"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        t.write(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    for part in range(2):
        files = list((tmp_path / "t" / "v1" / f"of2={part}").glob("*.parquet"))
        assert len(files) > 1
        for f in files:
            terms = pq.read_table(f, partitioning=None)["term"].to_pylist()
            assert terms == sorted(terms)
    found = t.read().where(F.col("term").startswith("ab"))
    assert found.count() == rows.where(F.col("term").startswith("ab")).count() and "StringStartsWith(term,ab)" in found._jdf.queryExecution().toString()


def test_two_writers_of_parts(spark, tmp_path):
    """The later of two is refused, whether it changes or adds; a change starts from what is there."""
    a, b = (Table(spark, f"file://{tmp_path}/t", LENGTH, key="id", parts=4) for _ in range(2))

    def row(k, n=0):
        return spark.createDataFrame([(k, n)], LENGTH)

    a.write(row("x"))
    b.read()
    a.append(row("y"))
    with pytest.raises(snapshots.ChangedTableError):
        b.append(row("z"))
    with pytest.raises(snapshots.ChangedTableError):
        b.write(row("z"))

    def meanwhile(old):
        a.append(row("w"))
        return old

    with pytest.raises(snapshots.ChangedTableError):
        b.change(row("x"), meanwhile)
    b.change(row("x"), lambda old: snapshots.upsert(old, row("x", 5), "id"))
    assert held(a) == [("w", 0), ("x", 5), ("y", 0)]


def test_a_save_rewrites_one_part_of_each_table(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), parts=8)
    many = [concept(f"c{i}", f"Name {i}", relations=[("uses", f"c{(i + 1) % 40}", "r")], summary=f"word{i} common", sources=[f"raw:r{i}"]) for i in range(40)]
    e.save_concepts(spark.createDataFrame(many, CONCEPT))
    e.save_raw(spark.createDataFrame([(f"r{i}", "t", "u", "x", 1, "default", "now") for i in range(40)], RAW_DOCUMENT))
    tables = {"concepts": e.tables["concepts"], "edges": e.tables["edges"], "vectors": e.vectors, "postings": e.postings, "lengths": e.lengths}

    def touched(name):
        t = tables[name]
        return [m for m in marks(tmp_path / "s" / name, t._newest()) if m.startswith("gone8=")]

    e.save_concepts(spark.createDataFrame([concept("c3", "Renamed", relations=[("uses", "c9", "r")], summary="zebra")], CONCEPT))
    assert {n: len(touched(n)) for n in tables} == dict.fromkeys(tables, 1)
    assert e.concepts().count() == 40 and e.lengths.read().count() == 40 and e.vectors.read().count() == 40 and e.edges().count() == 40
    assert ids(e.search("zebra", mode="keyword", limit=3)) == ["c3"] and ids(e.search("word3", mode="keyword", limit=50))[0] != "c3"
    e.delete_concepts(spark.createDataFrame([("c9",)], "id string"))
    assert e.concepts().count() == 39 and e.edges().where("target_id = 'c9' OR source_id = 'c9'").isEmpty() and e.edges().count() == 37
    assert len(touched("lengths")) == 1 and len(touched("concepts")) <= 3 and len(touched("edges")) <= 3
    assert e.concept("c3").first()["relations"] == [] and e.concept("c8").first()["relations"] == []
    e.delete_raw(spark.createDataFrame([("r5",)], "id string"))
    assert e.raw().count() == 39 and e.concept("c5").first()["sources"] == [] and e.concept("c6").first()["sources"] == ["raw:r6"] and len(touched("concepts")) == 1


def test_migration(spark):
    old = spark.createDataFrame([("a",)], "id string")
    assert snapshots.with_defaults(old, RAW_DOCUMENT).first()["workspace_id"] == "default"


def test_merge(spark):
    base = spark.createDataFrame([concept("a", "A", sources=["s1"], relations=[("r", "b", "")]), concept("z", "Z")], CONCEPT)
    new = spark.createDataFrame([concept("a", "Other", "ws", ["t"], [("r", "b", "again"), ("r", "c", ""), ("r", "a", "")], "filled", ["m"], ["s2", "s1"])], CONCEPT)
    got = {r["id"]: r for r in snapshots.merge_concepts(base, new).collect()}
    a = got["a"]
    assert (a["name"], a["workspace"], a["summary"], a["sources"], a["tags"]) == ("A", "ws", "filled", ["s1", "s2"], ["t"])
    assert [r["target"] for r in a["relations"]] == ["b", "c"] and got["z"]["workspace"] == "default"


def test_cards(spark):
    rows = [concept("a", "A: x", tags=["t"], relations=[("r", "b", "why")], summary="Sum.", mechanisms=["one", "two"], sources=["raw:1"])]
    back = readers.parse_cards(readers.cards(spark.createDataFrame(rows, CONCEPT))).first()
    assert (back["name"], back["summary"], back["mechanisms"], back["relations"][0]["target"], back["sources"]) == ("A: x", "Sum.", ["one", "two"], "b", ["raw:1"])
    with pytest.raises(ValueError):
        readers.from_markdown("no card")


def test_files(spark, tmp_path):
    (tmp_path / "my_note.md").write_text("x\n# The Title\nbody")
    (tmp_path / "other_note.txt").write_text("body only")
    got = {r["title"] for r in readers.read_texts(spark, f"file://{tmp_path}").collect()}
    assert got == {"The Title", "Other Note"}
    import zlib

    stream = zlib.compress(b"BT (A Study of Many Things) Tj ET BT [(x) (yz)] TJ ET")
    (tmp_path / "p.pdf").write_bytes(b"%PDF\nstream\n" + stream + b"\nendstream")
    assert readers.read_source(spark, str(tmp_path / "p.pdf")).first()["title"] == "A Study of Many Things"
    assert readers.read_source(spark, "just some text").first()["source"] == "raw_input"
    with pytest.raises(ValueError):
        readers.read_source(spark, "http://x.org/")


PAGE = "<title>T {n}</title><body><nav>skip</nav><h2>Head</h2><p>Body {n}<ul><li>item</ul>{links}</body>"


def test_readers_take_any_page(spark):
    for odd in ("<![x]>", "<![foo[bar]]>", "<![", "&#" + "9" * 5000 + ";"):
        title, text, links = readers.readable(f"<title>T</title><h2>H</h2><p>one{odd}<p>two <a href=' /x '>go <b>on</b></a><ul><li>i</ul><script>no</script><nav>no</nav>last")
        assert title == "T" and text.startswith("## H\none") and ("last" in text or odd == "<![")
    assert readers.readable("<a href='/1'>a<a href='/2'>b</a><a>c</a><br>d")[1:] == ("ab c\nd".replace("ab", "a b"), [("/1", "a"), ("/2", "b")])
    assert readers.readable(None) == ("", "", [])


def test_pdf_pages(spark):
    pdf = b"%PDF\n1 0 obj <</Type /Page /Contents 3 0 R>> endobj\n2 0 obj <</Type /Page /Contents [4 0 R 5 0 R]>> endobj\n9 0 obj <</Type /Pages /Kids [1 0 R]>> endobj\n"
    for n, t in ((3, b"first page"), (4, b"second page"), (5, b"goes on")):
        pdf += b"%d 0 obj <<>> stream\nBT (%s) Tj ET\nendstream endobj\n" % (n, t)
    assert readers.pdf_text(pdf) == "--- Page 1 ---\nfirst page\n\n--- Page 2 ---\nsecond page\ngoes on"


def test_chunks_hold_the_whole_text():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["\n# H\n", "\n\n", "word ", "x" * rng.randint(1, 60), "\n"]) for _ in range(rng.randint(0, 60)))
        found = distill.chunk_text(text, 100, most=None)
        assert "".join("".join(found).split()) == "".join(text.split())
        assert all(len(c) <= 100 or "\n\n" not in c for c in found)
        assert found[:6] == distill.chunk_text(text, 100) or len(text) <= 100


def test_pages_and_crawl(spark):
    link = lambda *ns: " ".join(f'<a href="/p/{n}">to {n}</a>' for n in ns)
    rows = [("https://x.org/p", PAGE.format(n=0, links=link(1, 2, 404))), ("https://x.org/p/1", PAGE.format(n=1, links=link(3))), ("https://x.org/p/2", PAGE.format(n=2, links=link(1, 3, 4))), ("https://x.org/p/3", PAGE.format(n=3, links="")), ("https://x.org/p/4", PAGE.format(n=4, links=""))]
    pages = readers.parse_pages(spark.createDataFrame(rows, "url string, html string"))
    first = pages.where("source = 'https://x.org/p'").first()
    assert first["title"] == "T 0" and "## Head" in first["text"] and "- item" in first["text"] and "skip" not in first["text"] and len(first["links"]) == 3
    got = {r["source"][-1]: (r["crawl_depth"], r["parent_url"]) for r in crawl.archive_crawl(pages, "https://x.org/p/", depth=2, max_pages=5).collect()}
    assert got == {"p": (0, None), "1": (1, "https://x.org/p"), "2": (1, "https://x.org/p"), "3": (2, "https://x.org/p/1"), "4": (2, "https://x.org/p/2")}
    assert crawl.level_quotas(3, 9) == [3, 3, 2] and crawl.level_quotas(0, 9) == [] and len(crawl.level_quotas(2, 0)) == 2
    fetched = readers.fetch_pages(spark.createDataFrame([("a",), ("b",)], "url string"), lambda u: "<p>x" if u == "a" else 1 / 0)
    assert {r["url"]: r["html"] for r in fetched.collect()} == {"a": "<p>x", "b": None}


def test_distill(spark):
    docs = spark.createDataFrame([("d1", "My Topic - Wikipedia", "First long line here.\nSecond long line.\n**Alpha Beta** helps. \"Gamma\" too.\nfourth line of text\nfifth line of text", "u", "w", "2026-01-01"), ("d2", "Plain", "", "u", "w", "2026-01-01")], "id string, title string, content string, source_uri string, workspace_id string, created_at string")
    got = {r["id"]: r for r in distill.heuristic_concepts(docs).collect()}
    assert set(got) == {"my_topic", "alpha_beta", "gamma", "plain"}
    assert got["my_topic"]["type"] == "architecture" and got["plain"]["type"] == "concept"
    assert {r["target"] for r in got["my_topic"]["relations"]} == {"alpha_beta", "gamma"} and got["gamma"]["relations"][0]["target"] == "my_topic"
    assert got["my_topic"]["summary"].startswith("First long line here. Second")
    made = distill.model_concepts(docs, lambda chunk: '```json\n{"concepts": [{"id": "A b-c", "name": "N"}]}\n```' if "First" in chunk else "no").collect()
    assert [(r["doc"], r["id"]) for r in made] == [("d1", "a_b_c")]
    text = "\n# A\n" + "x" * 50 + "\n# B\n" + "y" * 120 + "\n\n" + "z" * 40
    assert all(len(c) <= 130 for c in distill.chunk_text(text, 100)) and distill.chunk_text("s", 100) == ["s"]


def test_dedup_finds_planted_neighbours(spark):
    """Of vectors of random direction, those planted at a cosine of .6 are linked and those at .97 merged, all of them."""
    rng = random.Random(3)

    def unit():
        v = [rng.gauss(0, 1) for _ in range(64)]
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    def beside(v, cos):
        w = unit()
        d = sum(x * y for x, y in zip(v, w, strict=True))
        w = [y - d * x for x, y in zip(v, w, strict=True)]
        n = sum(x * x for x in w) ** 0.5
        return [cos * x + (1 - cos * cos) ** 0.5 * y / n for x, y in zip(v, w, strict=True)]

    base = [unit() for _ in range(1500)]
    schema = "id string, name string, vector array<double>"
    known = spark.createDataFrame([(f"k{i}", f"known {i}", v) for i, v in enumerate(base)], schema)
    new = spark.createDataFrame([(f"n{i}", f"fresh {i}", beside(base[i], 0.97 if i % 2 else 0.6)) for i in range(100)], schema)
    got = {r["id"]: r for r in distill.dedup_actions(new, known).collect()}
    assert all(got[f"n{i}"]["target"] == f"k{i}" for i in range(1, 100, 2))
    assert all(f"k{i}" in got[f"n{i}"]["links"] for i in range(0, 100, 2))


def test_dedup_actions(spark):
    e = [1.0] + [0.0] * 50
    near = [1.0, 0.3] + [0.0] * 49
    far = [0.0] * 50 + [1.0]
    known = spark.createDataFrame([("k", "Known thing", e), ("same", "Same", far)], "id string, name string, vector array<double>")
    new = spark.createDataFrame([("n1", "other", e), ("n2", "known thing!", near), ("n3", "else", near), ("same", "Same", far)], "id string, name string, vector array<double>")
    got = {r["id"]: (r["action"], r["target"]) for r in distill.dedup_actions(new, known).collect()}
    assert got["n1"] == ("merge_similar", "k") and got["same"] == ("merge_same_id", "same")
    assert got["n2"][0] == "merge_similar"


def folded(new, known, merge=0.90, sure=0.95, link=0.55, top=3):
    """Concepts (id, name, vector) one after the other, beside the known ones and those created so far."""

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 6)

    store, out = {i: (n, v) for i, n, v in known}, {}
    for i, name, v in sorted(new):
        if any(i == k for k, _, _ in known):
            out[i] = ("merge_same_id", i, [])
            continue
        best = sorted((-s, o) for o, (_, w) in store.items() if (s := cosine(v, w)) >= link)[:top]
        bare = [re.sub(r"\W+", "", n.lower()) for n in (name, store[best[0][1]][0])] if best else ["", ""]
        if best and (-best[0][0] >= sure or (-best[0][0] >= merge and all(bare) and (bare[0] in bare[1] or bare[1] in bare[0]))):
            out[i] = ("merge_similar", best[0][1], [])
        else:
            out[i] = ("create_linked" if best else "create", None, [o for _, o in best])
            store[i] = (name, v)
    return out


@pytest.mark.parametrize("seed", [1])
def test_a_batch_is_deduplicated_in_order(spark, seed):
    """Groups of near copies, chains whose ends differ, equal rows and known concepts: as one after the other would go."""
    rng = random.Random(seed)

    def moved(v, by):
        return [x + rng.gauss(0, by) for x in v]

    rows = []
    for g in range(6):
        v = [rng.gauss(0, 1) for _ in range(12)]
        rows += [(f"{rng.randint(0, 99):02}g{g}{k}", f"group {g}", moved(v, 0.13)) for k in range(8)]
        for k in range(12):  # each is like the one before it
            v = moved(v, 0.25)
            rows.append((f"c{g}{k:02}", f"chain {g}", v))
        rows += [(f"e{g}{k}", "equal", [*v]) for k in range(5)]
    known = [(i.replace("g", "k"), n, moved(v, 0.1)) for i, n, v in rows[::9]] + [("same", "same", [1.0] * 12)]
    rows.append(("same", "other", [0.5] + [0.0] * 11))
    schema = "id string, name string, vector array<double>"
    got = distill.dedup_actions(spark.createDataFrame(rows, schema), spark.createDataFrame(known, schema)).collect()
    assert len(got) == len(rows) and {r["id"]: (r["action"], r["target"], r["links"]) for r in got} == folded(rows, known)


def test_equal_new_concepts_of_a_batch_become_one(spark, tmp_path):
    from quern.plans import ingest as plan

    e = Engine(spark, str(tmp_path / "store"))
    batch = [concept(i, "Paged attention", tags=["gpu"], summary="memory pages for attention", sources=[f"s{i}"]) for i in ("a", "b", "c")]
    got = {r["id"]: r["target"] for r in plan.save_with_dedup(e, spark.createDataFrame(batch, CONCEPT)).collect()}
    assert got == {"a": None, "b": "a", "c": "a"}
    assert [(r["id"], sorted(r["sources"])) for r in e.concepts().collect()] == [("a", ["sa", "sb", "sc"])]


def test_streaming(spark, tmp_path):
    """Streamed concepts are found by all searches, known ones keep what they had, and batches that come again change nothing."""
    e = Engine(spark, str(tmp_path / "store"))
    e.save_concepts(spark.createDataFrame([concept("topic_0", "Topic 0", tags=["kept"], relations=[("uses", "alpha_beta", "r")], summary="known before", sources=["old"])], CONCEPT))
    (tmp_path / "in").mkdir()
    lines = [{"title": f"Topic {i}", "text": f"A long enough line about zebra number {i}.\n**Alpha Beta** is here.", "source": f"http://x/{i}"} for i in range(3)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))

    def run(checkpoint):
        ingest.start_ingest(ingest.page_stream(spark, str(tmp_path / "in")), e, str(tmp_path / "ev"), str(tmp_path / checkpoint)).awaitTermination()

    def state():
        tables = {**e.tables, "vectors": e.vectors, "postings": e.postings, "lengths": e.lengths}
        return {n: sorted(map(str, t.read().drop("created_at", "updated_at", "seq").collect())) for n, t in tables.items()}

    run("cp")
    first = state()
    assert e.raw().count() == 3 and {r["id"] for r in e.concepts().collect()} == {"topic_0", "topic_1", "topic_2", "alpha_beta"}
    kept = e.concept("topic_0").first()
    assert "kept" in kept["tags"] and kept["summary"] == "known before" and kept["sources"][0] == "old" and len(kept["sources"]) == 3
    for mode in ("keyword", "vector", "graph", "hybrid"):
        assert "topic_1" in {r["concept_id"] for r in e.search("topic zebra number 1", mode=mode, limit=4).collect()}, mode
    run("another")  # the same batch number of the same stream again, as after a failure behind its end
    e.batches.write(e.batches.read().where("false"))
    run("third")  # a batch that broke off before its end
    assert state() == first
    events = spark.read.json(str(tmp_path / "ev"))
    assert events.where("event = 'page_crawled'").count() == 3 and events.where("event = 'completed'").first()["count"] == 3
    noise = spark.createDataFrame([('noise {"event": "error", "source": "s"} tail',), ("none",)], "value string")
    assert [r["event"] for r in ingest.salvaged_events(noise).collect()] == ["error"]


def test_pdf_pages_follow_the_page_tree():
    """Objects in any order, nested and circular trees, pages in compressed object streams, and objects that were written again."""

    def content(text):
        return b"<< >>\nstream\nBT (" + text + b") Tj ET\nendstream"

    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [7 0 R 3 0 R 2 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 4: content(b"last page"),
        5: b"<< /Type /Page /Contents [6 0 R] >>", 6: content(b"first page"), 7: b"<< /Type /Pages /Kids [5 0 R 8 0 R] >>", 8: b"<< /Type /Page /Contents 9 0 R >>", 9: content(b"middle page"),
    }
    want = "--- Page 1 ---\nfirst page\n\n--- Page 2 ---\nmiddle page\n\n--- Page 3 ---\nlast page"

    def written(numbers, more=b""):
        return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%b\nendobj\n" % (n, objects[n]) for n in numbers) + more + b"trailer << /Root 1 0 R >>"

    rng = random.Random(1)
    for _ in range(5):
        assert readers.pdf_text(written(rng.sample(sorted(objects), 9))) == want
    packed, head, body = [1, 2, 3, 5, 7, 8], b"", b""
    for n in packed:
        head += b"%d %d " % (n, len(body))
        body += objects[n] + b" "
    stream = zlib.compress(head + body)
    inside = b"20 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%b\nendstream\nendobj\n" % (len(packed), len(head), len(stream), stream)
    assert readers.pdf_text(written([9, 4, 6], inside)) == want
    again = b"4 0 obj\n" + content(b"changed page") + b"\nendobj\n"
    assert readers.pdf_text(written(sorted(objects), again)) == want.replace("last page", "changed page")
    assert readers.pdf_text(b"nothing") == "" and "first page" in readers.pdf_text(written([6, 4]))


def test_pdf_titles():
    good = ["Attention Is All You Need", "주의 메커니즘의 이해와 응용", "GPU memory paging for large language model serving"]
    bad = ["Vol 12 2019 pp. 112-118 a b c d E", "a b c d Examples here", "PROCEEDINGS OF ICML", "arXiv 1234 something", "12 34 56 78 90", "Word", "Journal 2021 article 123456"]
    assert [readers.looks_like_title(x) for x in good + bad] == [True] * 3 + [False] * 7


def test_links_keep_their_longest_anchor(spark):
    """Links in the order of their first place, each with its longest text, the first of equally long ones; thousands of them cost no more than sorting."""
    anchors = [("/b", "x"), ("/a", "first"), ("/b", "longer"), ("/a", "other"), ("/c", ""), ("/b", "length")]
    page = "".join(f'<a href="{h}">{t}</a>' for h, t in anchors) + "".join(f'<a href="/n{k % 3000}">{"w" * (k % 7)}</a>' for k in range(9000))
    links = readers.parse_pages(spark.createDataFrame([("https://x.org/p", page)], "url string, html string")).first()["links"]
    want = {}
    for h, t in [*anchors, *[(f"/n{k % 3000}", "w" * (k % 7)) for k in range(9000)]]:
        if h not in want or len(t) > len(want[h]):
            want[h] = t
    assert [(x["url"].removeprefix("https://x.org"), x["text"]) for x in links] == list(want.items())


def test_a_language_model_is_told_of_known_concepts_and_may_fail(spark, tmp_path):
    """Its mechanisms and relations are kept, a failure is tried again, and documents for which it gives nothing go by the rules."""
    from quern.plans import ingest as plan

    e = Engine(spark, str(tmp_path / "store"))
    e.save_concepts(spark.createDataFrame([concept("attention", "Attention")], CONCEPT))
    answer = {"concepts": [{"id": "Flash-X", "name": "Flash X", "mechanisms": ["tiles"], "tradeoffs": {"pros": ["fast"]}, "relations": [{"type": "improves", "target": "Attention", "reason": "io"}, "no", {"type": "x"}]}, {"name": "none"}, {"id": "odd", "tags": "one", "relations": "none", "mechanisms": [None, 3]}]}
    failed = tmp_path / "failed"

    def generate(prompt):
        if "Bad page" in prompt:
            raise OSError("down")
        if not failed.exists():
            failed.touch()
            raise OSError("once")
        assert "Known concepts: attention" in prompt and "Source: http://x.org/1" in prompt
        return "Sure:\n" + json.dumps(answer)

    monkey = pytest.MonkeyPatch()
    pages = spark.createDataFrame([("Good page", "Some text about tiles.", "http://x.org/1"), ("Bad page", "Another line of the text here.", "http://x.org/2")], "title string, text string, source string")
    original = distill.model_concepts
    monkey.setattr(distill, "model_concepts", lambda *a, **k: original(*a, **k, wait=0.01))
    try:
        plan.ingest_pages(e, pages, generate=generate)
    finally:
        monkey.undo()
    got = {r["id"]: r for r in e.concepts().collect()}
    assert set(got) == {"attention", "flash_x", "odd", "bad_page"}
    assert got["flash_x"]["mechanisms"] == ["tiles"] and got["flash_x"]["tradeoffs"]["pros"] == ["fast"] and got["odd"]["mechanisms"] == ["3"] and got["odd"]["tags"] == ["one"]
    assert got["flash_x"]["sources"][1] == "http://x.org/1" and e.edges().where("source_id = 'flash_x' AND relation_type = 'improves' AND target_id = 'attention'").count() == 1


def test_ingest_dedup_dive(spark, tmp_path):
    from quern.plans import ingest as plan

    e = Engine(spark, str(tmp_path / "store"))
    e.save_concepts(spark.createDataFrame([concept("transformer", "Transformer", tags=["nlp"], summary="a model of attention")], CONCEPT))
    pages = spark.createDataFrame([("Topic One", "A line that is long enough.\n**Alpha Beta** helps.", "http://x.org/1"), ("Topic Two", "Another line of the text here.", "http://x.org/2")], "title string, text string, source string")
    pages = pages.withColumn("links", F.array(F.struct(F.lit("http://x.org/2").alias("url"), F.lit("two").alias("text"))))
    first = {r["id"]: r["action"] for r in plan.ingest_pages(e, pages).collect()}
    assert set(first) == {"topic_one", "alpha_beta", "topic_two"} and e.raw().count() == 2
    assert e.edges().where("relation_type = 'references' AND source_id = 'topic_one' AND target_id = 'topic_two'").count() == 1
    again = {r["action"] for r in plan.ingest_pages(e, pages).collect()}
    assert again == {"merge_same_id"} and e.concepts().count() == 4
    html = "<title>Transformer details</title><p>Paragraph about transformers and more.</p>"
    got = plan.deep_dive(e, "transformer", lambda u: html if u.endswith("en.wikipedia.org/wiki/Transformer") else None, max_pages=2)
    assert got["crawled_pages"] == 1 and got["new_concepts"] == 1
    assert e.edges().where("relation_type = 'expands' AND source_id = 'transformer'").count() == 1
    assert got["sources"][0] in e.concepts().where("id = 'transformer'").first()["sources"]
    (tmp_path / "cards").mkdir()
    (tmp_path / "cards" / "a.md").write_text(readers.to_markdown({"id": "a", "name": "A", "type": "t", "tags": [], "aliases": [], "relations": [], "sources": [], "workspace": "default", "created_at": "", "updated_at": ""}))
    assert plan.reindex(e, f"file://{tmp_path}/cards") == 1 and [r["id"] for r in e.concepts().collect()] == ["a"]
    assert plan.redistill(e).count() > 0
