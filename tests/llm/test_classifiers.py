import random
import time

from pyspark.sql import functions as F

from quern.llm import langid, toxicity
from quern.llm.common import held_out
from quern.llm.html_blocks import extract_main_text, fit, leaf_blocks, train

EN = "the and of that with this from have which there their would about could other than them these some into"
DE = "der die und das nicht mit ist auf eine auch werden nach bei noch über zum können wenn oder durch"
FR = "les des est une dans pour que qui sur avec plus par être mais nous cette aussi même été leurs"
ES = "los las una para que con por más pero como este también muy sobre desde hasta porque cuando donde ellos"


def prose(rng, words, n=60):
    return " ".join(rng.choice(words.split()) for _ in range(n))


def corpus(rng, n=40):
    rows = []
    for k in range(4 * n):
        lang, words = (("en", EN), ("de", DE), ("fr", FR), ("es", ES))[k % 4]
        rows.append((k, prose(rng, words), lang))
    return rows


def test_languages_of_held_out_texts(documents):
    rng = random.Random(3)
    rows = corpus(rng)
    edge = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", None), (1003, prose(rng, DE, 30000), None)]
    docs = documents(rows + edge, extra="score")
    model = langid.train(docs, max_per_lang=30)
    got = {r["doc_id"]: r for r in langid.predict_languages(docs, model).collect()}
    held = {r["doc_id"] for r in docs.where(held_out(F.col("doc_id"))).collect()}
    right = [got[d]["lang_pred"] == lang for d, _, lang in rows if d in held]
    assert sum(right) / len(right) > 0.95
    assert [got[d]["lang_pred"] for d in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_never_comes_from_held_out_rows(documents):
    rows = [(d, prose(random.Random(d), EN), "en") for d in range(40)]
    docs = documents(rows)
    secret = [r["doc_id"] for r in docs.where(held_out(F.col("doc_id"))).collect()]
    changed = documents([(d, t, "zz" if d in secret else lang) for d, t, lang in rows])
    model = langid.train(changed)
    assert [m for _, m in model.families] == [["en"]]


def test_no_training_rows(documents):
    docs = documents([])
    assert langid.predict_languages(docs, langid.train(docs)).count() == 0
    only = documents([(1, "some text", None)])
    assert langid.predict_languages(only, langid.train(only)).first()["lang_pred"] == "und"


def test_toxicity(documents, spark):
    rng = random.Random(4)
    rows, labels = [], []
    for d in range(300):
        bad = d % 5 == 0
        words = prose(rng, EN, rng.randint(20, 200)).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(("idiot", "moron", "scum")))
        rows.append((d, " ".join(words)))
        labels.append((d, int(bad)))
    docs = documents([*rows, (900, None), (901, ""), (902, prose(rng, EN, 20000))], extra="predicted")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = {r["doc_id"] for r in docs.where(held_out(F.col("doc_id"))).collect()}
    right = [got[d]["predicted"] == t for d, t in labels if d in held]
    assert sum(right) / len(right) > 0.95
    assert [got[d]["predicted"] for d in (900, 901, 902)] == [0, 0, 0]
    nothing = toxicity.train(documents([]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(docs, nothing).count() == len(got)


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href="/a">Home</a><li><a href="/b">More</a></ul></nav>
<{tag}><h1>The {n} story</h1><p>First   paragraph of the story number {n}, with words &amp; more.<p>Second one; it has &eacute; too.<div class="ad">Buy it now</div></{end}>
<div class="comments"><p>I liked the story a lot, thanks to all of you.</p></div><footer>&copy; site</footer></body></html>"""


def test_html(spark):
    pages = [PAGE.format(tag="article", end="article", n=n) for n in range(60)]
    rows = [(n, f"http://x/{n}", h) for n, h in enumerate(pages)] + [(100, "u", None), (101, "u", ""), (102, "u", PAGE.format(tag='div class="content"', end="div", n=7)), (103, "u", "<p>" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = {r["page_id"]: r for r in extract_main_text(df, train(df)).collect()}
    want = "The {n} story\nFirst paragraph of the story number {n}, with words & more.\nSecond one; it has é too."
    assert all(got[n]["text"] == want.format(n=n) for n in range(60))
    assert got[102]["text"] == want.format(n=7)
    assert [got[k]["text"] for k in (100, 101, 103)] == ["", "", ""] and got[0]["n_chars"] == len(got[0]["text"])


def test_no_page_teaches():
    assert fit([]) is None and fit([None, "plain"]) is None
    assert [b.text for b in leaf_blocks("<ul><li>a<li>b</ul>c<br>d <b>e</b><script>x</script>")] == ["a", "b", "c d e"]


def test_unknown_marked_sections_do_not_end_a_page():
    for odd in ("<![foo]>", "<![if !IE]>", "<![ ]>", "<![foo[x]]>"):
        assert [b.text for b in leaf_blocks(f"<p>one</p>{odd}<p>two</p><p>three</p>")][-2:] == ["two", "three"], odd
    assert leaf_blocks("<p>one</p><![foo")[0].text == "one"


def texts(html):
    return [b.text for b in leaf_blocks(html)]


def test_nothing_but_silent_elements_is_dropped():
    assert texts("<p>Let <math>x</math> be <object>what</object> it is</p>") == ["Let x be what it is"]
    assert texts("<p>a <button>no</button> b <svg><text>no</text></svg> c <select><option>no<option>no</select> d</p>") == ["a b c d"]
    assert texts("<article><p>one <button>two<p>three</p><p>four</p></article><p>five</p>") == ["one two", "three", "four", "five"]
    assert texts("<div><select><option>x</div><p>y</p>") == ["x", "y"] and texts("<p>a<svg>b</p><p>c</p>") == ["ab", "c"]
    assert texts("<p>a <button>b<div>c</div>d</button> e</p>") == ["a", "e"]
    assert texts("<noscript>no</noscript><p>a</p><script>b<p>c</p>") == ["a"]
    assert texts("&#" + "9" * 5000 + ";<p>b &#233; &amp;</p>") == ["\ufffd", "b é &"]


def test_end_tags_may_be_left_out():
    """Options, rows and cells end where the next one starts, and what they hold is as deep as if they were ended."""
    assert texts("<p>a <select>" + "<option>no" * 5000 + "</select> b</p>") == ["a b"]
    assert texts("<select><optgroup><option>x<optgroup><option>y</select><p>z") == ["z"]
    rows = leaf_blocks("<table><tbody>" + "<tr><td>one<p>two<td>three" * 500 + "<tbody><tr><td><table><tr><td>inner<tr><td>more</table>after</table>last")
    assert [b.text for b in rows[-4:]] == ["inner", "more", "after", "last"] and len(rows) == 1504
    assert {b.path.depth for b in rows[:1500]} == {4, 5} and rows[-1].path is None
    items = leaf_blocks("<ul>" + "<li><p>one" * 100 + "</ul>")
    assert len(items) == 100 and {b.path.depth for b in items} == {3}


def test_what_is_left_open_costs_time_and_memory_in_proportion(spark):
    """Valid and faulty pages of a hundred thousand open elements, beside normal ones, on Spark; and telling names count however far out they stand."""
    deep = '<div class="footer">' + "<div>" * 200 + "away</div>"
    odd = ["<select>" + "<option>x" * 100_000, "<div>x" * 30_000, "<table>" + "<tr><td>a<td>b" * 20_000, "<button>x" * 50_000, "<p><div>" + "<b>" * 30_000 + "<hr>x" * 5_000, "<span>" * 100_000]
    assert leaf_blocks(deep)[0].path.label == 0
    began = time.time()
    blocks = [leaf_blocks(h) for h in odd]
    assert time.time() - began < 60 and [len(b) for b in blocks] == [1, 30_000, 40_000, 1, 5_000, 0]
    pages = [PAGE.format(tag="article", end="article", n=n) for n in range(30)]
    df = spark.createDataFrame(list(enumerate([*pages, *odd])), "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in extract_main_text(df, fit(pages, rounds=5)).collect()}
    assert len(got) == 36 and all(got[n].startswith(f"The {n} story") for n in range(30))


def test_any_bytes_are_read_to_their_end():
    rng = random.Random(5)
    bits = ["<", ">", "</", "<!", "<![", "]]>", "<!--", "-->", "<p", "<p>", "</p>", "<button>", "</button>", "<svg>", "</svg>", "<a href='", "'", '"', "&", "&#", "&#x", ";", "text", " ", "<?", "<!doctype ", "/", "=", "\x00", "[", "é", "<title>", "</div>", "<li>"]
    for _ in range(3000):
        odd = "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))
        leaf_blocks(odd)
        assert texts(f"<p>first</p>{odd if '<' not in odd and '&' not in odd else ''}<p>last</p>")[-1] == "last"


def test_long_pages(spark):
    """Blocks of any number and length: time and memory in proportion, the same labels for pages read in spans and at once."""
    page = "<article>" + "".join(f"<p>Sentence {k} of a long story, which goes on and on.</p>" for k in range(3000)) + "<p>" + "<b>x</b> " * 20000 + "</p></article>"
    blocks = leaf_blocks(page)
    assert len(blocks) == 3001 and len(blocks[-1].text) == 39999
    model = fit([PAGE.format(tag="article", end="article", n=n) for n in range(30)], rounds=3)
    once, spans = model.probabilities([blocks, blocks[:100]]), model.probabilities([blocks, blocks[:100]], span=64)
    assert all(abs(a - b).max() < 1e-5 for a, b in zip(once, spans, strict=True))


def test_spans_equal_the_training_network():
    """Inference is the network that training steps through, by its plain recurrence."""
    import numpy as np

    from quern.llm import html_blocks as hb

    pages = [leaf_blocks(PAGE.format(tag="article", end="article", n=n)) for n in range(12)]
    model = fit([PAGE.format(tag="article", end="article", n=n) for n in range(30)], rounds=3)
    x, mask = hb._padded([hb.block_vectors(p) for p in pages])
    both = np.concatenate([model.run(x, mask, "f")[0], model.run(x, mask, "b")[0]], axis=2)
    want = 1 / (1 + np.exp(-(both @ model.weights["o"] + model.weights["d"])))
    for k, p in enumerate(model.probabilities(pages)):
        assert abs(p - want[: len(p), k]).max() < 1e-4


def test_pages_without_telling_names_lose_nothing(spark):
    rows = [(1, "u", "<div>short</div><div>other words here</div>"), (2, "u", None), (None, "u", "<div>short</div>"), (None, "u", "<div>short</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r["text"] for r in extract_main_text(df, train(df)).collect()) == ["", "short", "short", "short\nother words here"]
    none = df.where("false")
    assert extract_main_text(none, train(none)).count() == 0
