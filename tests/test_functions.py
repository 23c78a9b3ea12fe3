import math

import pytest
from pyspark.sql import functions as F

from quern.functions import embed, text, web
from quern.functions.stem import porter


def one(spark, column, **values):
    names = list(values) or ["x"]
    row = tuple(values.values()) or ("",)
    return spark.createDataFrame([row], ", ".join(f"{n} string" for n in names)).select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(("word", "value"), [("attention", 3828505273), ("transformer", 4051123192), ("gpu", 1195110677), ("flash_attention", 454277264), ("été", 4290086935), ("", 2166136261)])
def test_fnv(spark, word, value):
    assert one(spark, embed.fnv1a(F.col("x")), x=word) == value


def plain_embedding(t):
    import re

    out, words = [0.0] * 384, re.findall(r"\w+", t.lower())

    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h % 384

    for i, w in enumerate(words):
        weight = 1 + 0.5 * max(0, (10 - i) / 10)
        out[fnv(w)] += weight
        if i + 1 < len(words):
            out[fnv(f"{w}_{words[i + 1]}")] += 1.2 * weight
        for k in range(len(w) - 2):
            out[fnv(w[k : k + 3])] += 0.4
    n = math.sqrt(sum(x * x for x in out))
    return [x / n for x in out] if n else out


def test_embedder(spark):
    texts = ["GPU attention memory", "Flash attention saves GPU memory traffic", "A recipe for été soup with onions and more than ten words in one line, so weights end", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["vector"] for r in embed.hash_embeddings(df, "id", "text").collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_embedding(t))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    assert dot(got[0], got[1]) > dot(got[0], got[2])


def test_document_id(spark):
    assert one(spark, text.document_id(F.col("u"), F.col("c")), u="https://example.com/docs/Guide-1.html", c="hello") == "guide_1_5b8c887f"


def test_slugs(spark):
    assert one(spark, text.concept_slug(F.col("x")), x="--Flash Attention 2!") == "flash_attention_2"
    assert one(spark, text.workspace_slug(F.col("x")), x=" Bio Med/1 ") == "bio_med_1"
    assert one(spark, text.file_key(F.col("x")), x=" A b/C ") == "a_b_c"


def test_snippet(spark):
    long = "x" * 100 + " Needle\nhere " + "y" * 200
    got = one(spark, text.snippet(F.col("x"), F.lit("needle")), x=long)
    assert got.startswith("...x") and got.endswith("y...") and "Needle here" in got and len(got) == 60 + 6 + 90 + 6
    assert one(spark, text.snippet(F.col("x"), F.lit("none")), x=long) == ""


def test_cleaning(spark):
    assert one(spark, text.strip_web_noise(F.col("x")), x="a[1] {{t}}b\nCopyright\ncookie\n" + "cookie " * 9) == "a b\nCopyright\n" + "cookie " * 9
    assert one(spark, text.strip_title_suffix(F.col("x")), x="Graph - Wikipedia, more") == "Graph"
    assert one(spark, text.names_compatible(F.col("a"), F.col("b")), a="Flash-Attention", b="flash attention 2") is True
    assert one(spark, F.to_json(text.sanitize_query(F.col("x"))), x="a-b  c_d !! é") == '["ab","c_d","é"]'


def test_entities_and_sentences(spark):
    t = 'Intro. **Alpha Beta** is here. "Gamma" too\n## 2.1. Delta\nThe **Alpha Beta** ends.'
    got = one(spark, F.to_json(text.entity_hits(F.col("x"))), x=t)
    assert got.count("Alpha Beta") == 2 and '"name":"Gamma","score":3' in got and '"name":"Delta","score":5' in got
    assert one(spark, text.representative_sentence(F.col("x"), F.lit("Gamma")), x=t) == '"Gamma" too'


def test_json_salvage(spark):
    for raw, want in (('```json\n{"a": 1}\n```', '[{"a": 1}]'), ('so {"concepts": [1, 2]} x', "[1, 2]"), ("nothing", "nothing")):
        assert one(spark, text.json_salvage(F.col("x")), x=raw) == want


@pytest.mark.parametrize(("url", "want"), [("HTTP://Ex.COM:80/a/b/?q=1#f", "http://ex.com/a/b?q=1"), ("https://x.org:8443", "https://x.org:8443/"), ("https://x.org/", "https://x.org/"), ("nothing", "nothing")])
def test_canonical_url(spark, url, want):
    assert one(spark, web.canonical_url(F.col("x")), x=url) == want


def test_links(spark):
    b = "https://x.org/a/b.html"
    for href, want in (("/c", "https://x.org/c"), ("d", "https://x.org/a/d"), ("#e", None), ("mailto:f", None), ("//y.org/g", "https://y.org/g"), ("http://z.org", "http://z.org")):
        assert one(spark, web.resolve_link(F.lit(b), F.col("x")), x=href) == want
    score = lambda u, a: one(spark, web.link_score(F.lit("https://x.org/w/Topic"), F.lit("https://x.org/w/Topic"), F.col("u"), F.col("a")), u=u, a=a)
    assert score("https://x.org/w/Topic/Sub", "") == 45 + 15 + 12
    assert score("https://x.org/w/Other", "abcdefgh") == 1.0
    assert score("https://x.org/w/Topic", "") < -800
    assert one(spark, web.is_crawlable(F.lit(b), F.col("x")), x="https://x.org/a.png") is False
    assert one(spark, web.is_crawlable(F.lit(b), F.col("x")), x="https://y.org/a") is False
    assert one(spark, F.to_json(web.seed_urls(F.col("x"), ("https://e.org/wiki/{}",))), x="Flash Attention") == '["https://e.org/wiki/Flash%20Attention"]'


@pytest.mark.parametrize(
    ("word", "stem"),
    [("memory", "memori"), ("memories", "memori"), ("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("relational", "relat"), ("formalize", "formal"), ("adjustment", "adjust"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"), ("gpu", "gpu")],
)
def test_porter(word, stem):
    assert porter(word) == stem


def test_jaccard_and_tokens(spark):
    a, b = text.graph_tokens(F.col("a")), text.graph_tokens(F.col("b"))
    assert one(spark, text.jaccard(a, b), a="The GPU memory of it", b="gpu Memory cache") == pytest.approx(2 / 3)
    assert one(spark, text.jaccard(a, b), a="", b="") == 0


def test_links_resolve_like_the_standard_library(spark):
    """Relative links, dot segments and queries against RFC 3986 as the standard library has it."""
    from urllib.parse import urljoin

    bases = ["http://x.org/a/b/c", "http://x.org/a/b/", "http://x.org", "https://y.net:8080/d/e.html?q=1#f"]
    hrefs = ["g", "./g", "../g", "../../g", "../../../g", "/g/./h/../i", "?y=2", "g?y=./x", "g/", ".", "..", "//z.org/p", "http://w.org/k", "a/./b/../c", "../"]
    rows = [(b, h) for b in bases for h in hrefs]
    got = spark.createDataFrame(rows, "base string, href string").select("base", "href", web.resolve_link(F.col("base"), F.col("href")).alias("u")).collect()
    for r in got:
        assert r["u"].rstrip("/") == urljoin(r["base"], r["href"]).rstrip("/"), r
    assert one(spark, web.resolve_link(F.col("b"), F.col("h")), b="http://x.org/", h="#top") is None


def test_wiki_pages(spark):
    page = "# 제목\n목차\n[편집]\n1.2.\n본문 [편집] 하나  둘\n\n\n\n분류: 무엇\n[1] [2]\n끝\n"
    assert one(spark, text.strip_wiki_lines(F.col("x")), x=page) == "# 제목\n\n본문 하나 둘\n\n끝" or one(spark, text.strip_wiki_lines(F.col("x")), x=page) == "# 제목\n본문 하나 둘\n\n끝"
    assert one(spark, text.wiki_title(F.col("x")), x="어떤 것 - 나무위키") == "어떤 것"
    crawlable = lambda u: one(spark, web.is_crawlable(F.lit("https://namu.wiki/w/a"), F.col("u")), u=u)
    assert crawlable("https://namu.wiki/w/b") and not crawlable("https://namu.wiki/w/") and not crawlable("https://namu.wiki/x/b")
    assert not crawlable("https://namu.wiki/w/%EB%B6%84%EB%A5%98:b") and not crawlable("https://namu.wiki/w/a.png")


def test_representative_sentences_equal_the_pattern(spark):
    """Random texts of words and marks against the plain pattern, and a long text without marks in linear time."""
    import random
    import re
    import time

    rng = random.Random(3)
    rows = [("".join(rng.choice(["ab", "name", " ", ". ", "?", "\n", "x", ";", "na"]) for _ in range(rng.randint(0, 14))), "name") for _ in range(400)]
    got = spark.createDataFrame(rows, "t string, n string").select("t", text.sentence_with(F.col("t"), F.col("n")).alias("s")).collect()
    for r in got:
        m = re.search(r"[^.?!;\n]*?name[^.?!;\n]*[.?!;\n]", r["t"])
        assert r["s"] == (m[0] if m else None), r
    began = time.time()
    assert one(spark, text.sentence_with(F.col("t"), F.lit("needle")), t="word " * 300_000 + "needle") is None
    assert time.time() - began < 20


def test_words_after_the_cut_are_not_embedded(spark):
    df = spark.createDataFrame([(1, "word " * 600), (2, "word " * 600 + "other " * 50), (3, None)], "id int, text string")
    got = {r["id"]: r["vector"] for r in embed.hash_embeddings(df, "id", "text").collect()}
    assert got[1] == got[2] and set(got[3]) == {0.0}
    given = {r["id"]: (r["model_name"], len(r["vector"])) for r in embed.embeddings(df, "id", "text", lambda texts: [[1.0, 0.0] for _ in texts]).collect()}
    assert given[1] == ("given", 2)
    failing = embed.embeddings(df, "id", "text", lambda texts: 1 / 0).collect()
    assert {r["model_name"] for r in failing} == {"hash"} and len(failing[0]["vector"]) == embed.DIM


@pytest.mark.parametrize("kind", ["html_text", "html_links", "chunks", "bm25_stemmed", "markdown_roundtrip"])
def test_long_texts_go_to_workers_in_small_batches(spark, kind):
    """A worker's memory is that of a few hundred texts (10,000 before), however many there are."""
    from quern.queries import QUERIES

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    try:
        QUERIES[kind](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(name)) <= 256
    finally:
        spark.conf.unset(name)


def test_cards_are_written_and_read_by_libyaml(monkeypatch):
    """The front matter is the Python library's to the byte, whatever the strings hold, but of plain strings libyaml writes it and it reads all (Python code did both before)."""
    import yaml

    from quern.sources import readers

    def made(name):
        return {"id": name, "name": name, "aliases": [], "type": "concept", "tags": ["x", name], "workspace": "no", "relations": [{"type": "part_of", "target": "1e5", "reason": name * 9}], "created_at": "2026-01-01", "updated_at": "", "sources": ["raw:doc_1"]}

    names = ["plain name", "a: b # c", "가나다", "é, d'un\nline", "smile \U0001f600", "", "x\x85y", "tab\tx"]
    order = ("id", "name", "aliases", "type", "tags", "workspace", "relations", "created_at", "updated_at", "sources")
    want = [yaml.safe_dump({k: made(n)[k] for k in order}, sort_keys=False, allow_unicode=True).strip() for n in names]
    cards = [readers.to_markdown(made(n)) for n in names]
    assert [c.split("---\n")[1].strip() for c in cards] == want
    back = [yaml.safe_load(w)["relations"][0]["reason"] for w in want]
    if yaml.__with_libyaml__:
        monkeypatch.setattr(yaml.SafeLoader, "get_single_data", lambda self: 1 / 0)
        monkeypatch.setattr(yaml.SafeDumper, "represent", lambda self, data: 1 / 0)
        assert [readers.from_markdown(c)["relations"][0]["reason"] for c in cards] == back
        assert readers.to_markdown(made("plain name")) == cards[0]
