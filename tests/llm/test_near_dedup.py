import random
import re
import string

import numpy as np

from quern.llm import near_dedup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return set()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, percent=85):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


def copies(rng, base, n, edits):
    words = base.split()
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(documents):
    rng = random.Random(5)
    docs = []
    for length, edits, n in ((60, 2, 25), (200, 6, 40), (200, 5, 30), (400, 3, 10), (5, 1, 4), (2, 0, 3)):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(length))
        docs += copies(rng, base, n, edits)
    docs += ["", None, "  \n ", "Word", "wORD", *[" ".join(f"q{rng.randrange(10**5)}" for _ in range(120)) for _ in range(30)]]
    docs = list(enumerate(docs))
    rng.shuffle(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(documents(docs)).collect()}
    assert got == brute(docs)


def test_edges(documents):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(None, "a b c"), (1, None), (2, long), (3, long), (3, long)]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in nd.near_duplicates(documents(rows, extra="band")).collect()]
    assert got.count((3, 2, False)) == 2 and (2, 2, True) in got and (1, 1, True) in got and len(got) == 5
    assert nd.near_duplicates(documents([])).count() == 0
    kept = nd.keep_one(documents(rows, extra="tag"))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "None"] and kept.columns[-1] == "tag"


def test_ids_that_are_null_large_or_repeated(documents):
    """An id on two texts keeps the links of both; null ids belong to their component; ids don't go through floats."""
    big = 2**53 + 1
    one, two = (" ".join(f"{c}{i}" for i in range(80)) for c in "xy")
    rows = [(7, one), (7, two), (big, one + " end"), (big + 2, two + " end"), (None, one), (None, "all alone here"), (None, "all alone here"), (8, "other words")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in nd.near_duplicates(documents(rows)).collect()), key=repr)
    want = [(7, 7, True), (7, 7, True), (big, 7, False), (big + 2, 7, False), (None, 7, False), (None, None, True), (None, None, True), (8, 8, True)]
    assert got == sorted(want, key=repr)
    stay = sorted(((r["doc_id"], r["text"]) for r in nd.keep_one(documents(rows)).collect()), key=repr)
    assert stay == sorted([(7, one), (7, two), (None, "all alone here"), (None, "all alone here"), (8, "other words")], key=repr)
    split = nd.near_duplicates(documents([(5, one), (5, "quite other words"), (3, "quite other words"), (6, one)])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in split} == {(5, 5, True), (5, 3, False), (3, 3, True), (6, 5, False)}


def test_small_blocks_lose_no_link(documents, monkeypatch):
    """Blocks of four rows, or of few bytes: the components of many chained texts in common buckets are those of brute force."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    docs = [(k, " ".join(words[: 200 + 7 * (k % 25)] + [f"z{k}"] * (k % 3))) for k in range(75)]
    rng.shuffle(docs)
    want = {d: c for d, (_, c) in brute(docs).items()}
    for rows, size in ((4, 1 << 30), (512, 4000)):
        monkeypatch.setattr(nd, "BLOCK", rows)
        monkeypatch.setattr(nd, "BLOCK_BYTES", size)
        assert {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(documents(docs)).collect()} == want


def test_cross_pairs_join_what_stars_miss(documents, spark):
    """A chain: each text is near the next one only, so the least of a bucket does not reach the rest."""
    words = [f"w{i}" for i in range(300)]
    docs = [(k, " ".join(words[: 200 + 8 * k])) for k in range(13)]
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(documents(docs)).collect()}
    assert got == {d: c for d, (_, c) in brute(docs).items()}


def test_sketch_estimates_high_similarities():
    rng = np.random.default_rng(2)
    for n in (50, 800, 6000):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        other = np.unique(np.concatenate([base[: int(0.92 * n)], rng.integers(0, 2**63, int(0.08 * n), dtype=np.uint64)]))
        truth = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        (x, kx), (y, ky) = nd.odd_sketch(base), nd.odd_sketch(other)
        a, b = np.frombuffer(x, np.uint8)[None], np.frombuffer(y, np.uint8)[None]
        found = nd.similar(a, np.array([len(base)]), np.array([kx]), b, np.array([len(other)]), np.array([ky]), 0.5)[0, 0]
        assert abs(found - truth) < 0.05


def test_short_pairs_at_the_bound_pass_the_sketch():
    """Thousands of nested pairs just over .85: none may be lost before the exact check."""
    rng = np.random.default_rng(4)
    for n, shared, pairs in ((7, 6, 6000), (14, 12, 6000), (20, 17, 6000), (100, 85, 500), (512, 436, 200), (560, 500, 200)):
        for _ in range(pairs):
            x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            y = np.sort(rng.permutation(x)[:shared])
            (s, ks), (t, kt) = nd.odd_sketch(x), nd.odd_sketch(y)
            a, b = np.frombuffer(s, np.uint8)[None], np.frombuffer(t, np.uint8)[None]
            assert nd.similar(a, np.array([n]), np.array([ks]), b, np.array([shared]), np.array([kt]), 0.85 - nd.SLACK)[0, 0] > 0, n


def test_shingles_are_words_whatever_the_bytes():
    s = nd.Shingler(5)
    assert len(s("a b\tc\nd e f")) == 2
    assert (s("É a b c d e") == s("É A B C D E")).all() and (s("É a b c d") != s("é a b c d")).all()
    assert len(s("a")) == 1 and len(s(None)) == 0
