import random
import re

from quern.llm.line_dedup import dedup_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, least=50):
    """Delete the lines of every run of ``least`` words that stands at an earlier place, by comparing all runs."""
    lines = {d: [(i, x, len(WORD.findall(x))) for i, x in enumerate((t or "").split("\n")) if WORD.search(x)] for d, t in docs}
    runs = {}
    for d, own in sorted(lines.items()):
        for a in range(len(own)):
            words = 0
            for b in range(a, len(own)):
                words += own[b][2]
                if words >= least:
                    runs.setdefault(tuple(x[1] for x in own[a : b + 1]), []).append((d, a, b))
    gone = {d: set() for d, _ in docs}
    for places in runs.values():
        first = min(places)
        for d, a, b in places:
            if (d, a, b) != first:
                gone[d] |= {lines[d][k][0] for k in range(a, b + 1)}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def test_against_brute_force(documents):
    rng = random.Random(1)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice((3, 12, 20, 30, 55)))) for _ in range(14)]
    docs = []
    for d in range(40):
        docs.append((d, "\n".join(rng.choice([*pool, "", "  "]) for _ in range(rng.randint(0, 12)))))
    got = {r["doc_id"]: r["text"] for r in dedup_lines(documents(docs)).collect()}
    assert got == brute(docs)


def test_edges(documents, spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, long), (4, long), (4, long), (5, f"short\n{long}\n\ntail"), (None, long), (7, "\n".join(["one two"] * 3000))]
    df = dedup_lines(documents(rows, extra="n_removed"))
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in df.collect()]
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_removed"]
    assert (1, None, 0) in got and (2, "", 0) in got
    assert (None, long, 0) in got  # a null id comes first
    assert got.count((4, "", 1)) == 2 and (3, "", 1) in got
    assert (5, "short\n\ntail", 1) in got
    assert dict((d, n) for d, _, n in got)[7] > 2900
    assert dedup_lines(documents([])).count() == 0
