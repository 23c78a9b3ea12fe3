import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quern.llm import divergence, transducer

PATTERN = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs = [(lang, source, PATTERN.findall(small(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, ts in mine for t in set(ts))
        kept = sorted((t for t, n in df.items() if n >= least), key=str.encode)
        counts = {s: Counter(t for _, s2, ts in mine if s2 == s for t in ts if t in set(kept)) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        for s, c in counts.items():
            pairs = [(-sum(gap(share(c, t), share(o, t)) for t in kept), x.encode(), x) for x, o in counts.items() if x != s]
            terms = [(-gap(share(c, t), share(whole, t)), t.encode(), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            out += [(lang, s, "pair", x, -v, k) for k, (v, _, x) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def audited(spark, rows, **kwargs):
    df = spark.createDataFrame([(*r, "mine") for r in rows], "text string, lang string, source string, term string")
    return sorted(map(tuple, divergence.divergence_audit(df, **kwargs).collect()))


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "été", "ÉTÉ", "ß", "x", "ﬀ", "naïve", "中文", "𝒜b", "be", "bet", "betas"] + [f"w{'abcdefgh'[k % 8]}{'abc' * (k % 5)}" for k in range(60)]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "1", "_", "-", "\x00", "\x7f", ", "]) for _ in range(rng.randint(0, 40)))
        rows.append((text, rng.choice(["en", "fr"]), rng.choice(["a", "b", "c", None])))
    return rows + [(None, "en", "a"), ("", None, None), ("alone", "xx", "a"), ("", "xx", "b"), ("beta " * 30_000, "en", "long")] + [("beta gamma", "en", "a")] * 12


@pytest.mark.parametrize(("seed", "kwargs"), [(1, {}), (2, {"chunk_bytes": 40, "cells": 300})])
def test_equals_the_plain_version(spark, seed, kwargs):
    assert audited(spark, corpus(seed), **kwargs) == plain(corpus(seed))


def test_blocks_of_sources_and_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 2)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 7)
    rows = [(t, lang, s) for (t, lang, _), s in zip(corpus(3), "abcdefg" * 100, strict=False)]
    assert audited(spark, rows) == plain(rows)


def test_no_rows_and_no_terms(spark):
    assert audited(spark, []) == []
    rows = [("one", "en", "a"), (None, "en", "b"), ("two", None, "b")]
    assert audited(spark, rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    rows = [r for r in corpus(4) if "\x00" not in (r[0] or "")]
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = sorted(con.execute(divergence.AUDIT_SQL.format(docs="documents", least=10, top=10)).fetchall())
    assert audited(spark, rows) == want


def test_the_transducer_is_minimal_and_gives_places():
    rng = random.Random(0)
    for _ in range(60):
        terms = sorted({bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 60))})
        _, _, used, _ = transducer.build(terms)
        prefixes = {t[:k] for t in terms for k in range(len(t) + 1)}
        ways = {frozenset(t[len(p) :] for t in terms if t.startswith(p)) for p in prefixes}
        assert len(used) == len(ways)  # one state for each set of endings
        asked = terms + [bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.randint(1, 6))) for _ in range(20)]
        lengths = np.array([len(q) for q in asked])
        which, place = transducer.unpack(transducer.pack(terms)).places(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(lengths) - lengths, lengths)
        assert dict(zip(which.tolist(), place.tolist(), strict=True)) == {k: terms.index(q) for k, q in enumerate(asked) if q in terms}


@pytest.mark.parametrize("size", [1, 3, 17, 1 << 20])
def test_tokens_of_slices(size):
    texts = ["Ab cd", "", "ef", "gh1ij", "É" * 9, " ", "z"]
    data, offsets = "".join(texts).encode(), np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = []
    for low, starts, lengths, doc in transducer.tokens(np.frombuffer(data, np.uint8), offsets, size):
        got += [(int(d), low[s : s + n].tobytes().decode()) for s, n, d in zip(starts, lengths, doc, strict=True)]
    assert got == [(k, small(t)) for k, text in enumerate(texts) for t in PATTERN.findall(text)]
