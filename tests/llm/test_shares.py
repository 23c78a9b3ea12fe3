import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import media, mixture, sharding


def words(n):
    return " ".join("w" for _ in range(n))


def water_fill(sizes, weights, epochs=3):
    total, fixed = sum(sizes.values()), {}
    while True:
        left, share = total - sum(fixed.values()), sum(w for s, w in weights.items() if s not in fixed)
        over = {s: sizes[s] * epochs for s in sizes if s not in fixed and share and left * weights[s] / share > sizes[s] * epochs}
        if not over:
            return {s: fixed.get(s, left * weights[s] / share if share else 0.0) for s in sizes}
        fixed |= over


def test_mixture(documents):
    rng = random.Random(2)
    rows = [(d, words(rng.randint(0, 60)), "en", rng.choice(["a", "b", "b", "b", "c", None, "d"])) for d in range(600)] + [(9000, None, "en", "a"), (9001, words(40), "en", "tiny"), (9002, "", "en", "void")]
    got = mixture.mixed_sizes(documents(rows)).collect()
    sizes = Counter()
    for d, t, _, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water_fill(dict(sizes), {s: float(i % 3 + 1) for i, s in enumerate(order)})
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again = mixture.mixed_sizes(documents(rows[::-1]).repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def taken_and_wanted(documents, rows):
    got = mixture.mixed_sizes(documents(rows)).collect()
    taken, size, want = Counter(), Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        want[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert len(got) == len(rows) and all(r["source_size"] == size[r["source"]] for r in got)
    return taken, want


def test_mixture_of_null_and_repeated_ids_keeps_its_targets(documents, monkeypatch):
    """A source misses its target by half a document at most, whether its ids are null, or one id stands on other texts or on equal ones."""
    monkeypatch.setattr(mixture, "COPIES", 7)
    rng = random.Random(4)
    null_ids = [(None, words(rng.randint(5, 15)) + f" {k}", "en", "a") for k in range(100)]
    one_id = [(7, words(rng.randint(5, 15)) + f" {k}", "en", "b") for k in range(100)]
    equal = [(8, words(10), "en", "c") for _ in range(100)]
    no_id = [(None, words(10), "en", None) for _ in range(50)]
    taken, want = taken_and_wanted(documents, null_ids + one_id + equal + no_id + [(9, "", "en", "c"), (10, None, "en", "a")])
    assert all(abs(taken[s] - want[s]) <= 8.5 for s in want), (taken, want)
    mixed = mixture.mix_sources(documents(null_ids + one_id + equal + no_id, extra="part"))
    assert mixed.columns[-1] == "part"
    found = Counter()
    for r in mixed.collect():
        found[r["source"]] += len(r["text"].split())
    assert all(abs(found[s] - want[s]) <= 8.5 for s in want)


def test_mixture_repeats_rows(documents):
    docs = documents([(1, words(10), "en", "a"), (2, words(300), "en", "b"), (2, words(300), "en", "b")], extra="target")
    out = mixture.mix_sources(docs)
    assert out.columns == docs.columns
    n = Counter(r["doc_id"] for r in out.collect())
    assert n[1] == 3 and n[2] in (2, 3)
    assert mixture.mix_sources(documents([])).count() == 0


def test_external_shuffle(documents):
    rows = [(d, f"text {d}" * (d % 7)) for d in range(500)] + [(None, "x"), (600, None), (601, ""), (601, ""), (602, "y" * 10**6)]
    docs = documents(rows, extra="slot")
    runs = [sorted((r["shard"], r["slot"], r["doc_id"] or -1, r["text"] or "") for r in sharding.external_shuffle(d, 24, bucket_bytes=4000).collect()) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    counts = Counter(s for s, *_ in runs[0])
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 24
    for s, n in counts.items():
        assert [x[1] for x in runs[0] if x[0] == s] == list(range(n))
    assert [x[2] for x in runs[0]] != sorted(x[2] for x in runs[0])
    assert sharding.external_shuffle(documents([]), 24).count() == 0


def test_ids_stay_as_they_are(documents):
    """Ids above 2**53 beside null ones: no operator may take them through floats."""
    big = 2**53 + 1
    rows = [(big, "a b c"), (None, "d e f"), (big + 2, None)]
    want = sorted([big, big + 2, -1])
    for df in (sharding.external_shuffle(documents(rows), 3), media.text_media(documents(rows)), mixture.mixed_sizes(documents(rows))):
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in df.collect()) == want
    images = media.image_tiles(documents(rows).selectExpr("doc_id AS id", "CAST(text AS binary) AS content"))
    assert sorted(-1 if r["id"] is None else r["id"] for r in images.collect()) == want


def test_one_id_and_equal_rows_fill_no_bucket(documents, monkeypatch):
    """Shards of a table with one id only, and of one with one row repeated: whole, even, and shuffled in small buckets."""
    monkeypatch.setattr(sharding, "MANY", 20)
    for rows in ([(1, f"text {k}") for k in range(400)], [(None, "same")] * 300 + [(2, f"t{k}") for k in range(40)]):
        df = sharding.external_shuffle(documents(rows), 7, bucket_bytes=500)
        got = df.collect()
        assert sorted((r["text"] for r in got)) == sorted(t for _, t in rows)
        counts = Counter(r["shard"] for r in got)
        assert max(counts.values()) - min(counts.values()) <= 1
        assert len({(r["shard"], r["slot"]) for r in got}) == len(rows)
        again = sharding.external_shuffle(documents(rows).repartition(3), 7, bucket_bytes=500).collect()
        assert sorted((r["shard"], r["slot"], r["text"]) for r in got) == sorted((r["shard"], r["slot"], r["text"]) for r in again)


def test_buckets_are_bounded_by_bytes(documents):
    """Equal rows too few to be many, but large together, are dealt out; a text larger than a bucket is alone in one."""
    rows = [(1, "same " * 1000)] * 300 + [(k, f"text {k}") for k in range(300)] + [(-1, "huge " * 100_000), (-2, "vast " * 200_000)]
    placed, _, _ = sharding.scattered(documents(rows), text="text", bucket_bytes=100_000, seed=11)
    buckets: dict[int, list[int]] = {}
    for r in placed.collect():
        buckets.setdefault(r["__bucket"], []).append(len(r["text"]))
    assert max(sum(b) for b in buckets.values() if len(b) > 1) < 250_000
    assert sorted(b for b in buckets.values() if max(b) > 50_000) == [[500_000], [1_000_000]]


def test_several_buckets_by_brute_force(documents):
    """Buckets in the order of their numbers, each its sorted records in the order of the seeded permutation."""
    rows = [(d, f"text {d}" * (d % 9)) for d in range(300)] + [(7, "text 7" * 7)] * 3 + [(None, None)]
    buckets: dict[int, list[tuple]] = {}
    for r in sharding.scattered(documents(rows), text="text", bucket_bytes=1500, seed=11)[0].collect():
        buckets.setdefault(r["__bucket"], []).append((r["doc_id"], r["text"], r["__row"], r["__copy"]))
    assert len(buckets) > 5
    want = []
    for b in sorted(buckets):
        own = sorted(buckets[b], key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2], r[3]))
        want += [own[k][:2] for k in sharding.fisher_yates(len(own), 11, b)]
    got = sharding.external_shuffle(documents(rows), 24, bucket_bytes=1500).collect()
    assert [(r["doc_id"], r["text"]) for r in sorted(got, key=lambda r: r["slot"] * 24 + r["shard"])] == want


def test_written_shards_hold_every_row_once(documents, spark, tmp_path):
    rows = [(d, f"text {d}") for d in range(300)] + [(5, "text 5"), (None, None)]
    sharding.write_shards(sharding.external_shuffle(documents(rows), 4, bucket_bytes=600), f"file://{tmp_path}/out")
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((k % 4, k // 4) for k in range(len(rows)))
    for file in tmp_path.glob("out/shard=*/*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(f"file://{file}").collect()]
        assert slots == sorted(slots)


def test_shards_by_brute_force(documents):
    """A small table in one bucket: the sorted records in the order of the seeded Fisher-Yates permutation."""
    rows = [(d, f"t{d % 5}") for d in random.Random(1).sample(range(1000), 60)]
    got = sorted(((r["slot"] * 24 + r["shard"], r["doc_id"], r["text"]) for r in sharding.external_shuffle(documents(rows), 24).collect()))
    order = sharding.fisher_yates(60, 11, 0)
    assert [(d, t) for _, d, t in got] == [sorted(rows)[k] for k in order] and [p for p, _, _ in got] == list(range(60))


def test_fisher_yates_is_a_seeded_permutation():
    a, b = sharding.fisher_yates(1000, 1, 2), sharding.fisher_yates(1000, 1, 3)
    assert sorted(a) == list(range(1000)) and a != b and a == sharding.fisher_yates(1000, 1, 2) and sharding.fisher_yates(0, 1, 1) == []


def test_media_round_trip(documents):
    texts = ["", None, "a", "x" * 192, "é" * 100, "z" * 50_000, "a"]
    got = {r["doc_id"]: r for r in media.text_media(documents(list(enumerate(texts)), extra="feature")).collect()}
    for d, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and media.decode(bytes(r["media"])).tobytes() == payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
    assert got[2]["feature"] == got[6]["feature"] and {r["format"] for r in got.values()} == {"bmp", "ppm"}


def test_netpbm_kinds():
    assert media.decode(b"P2 # grey\n2 2\n3\n0 1 2 3").reshape(-1).tolist() == [0, 85, 170, 255]
    assert media.decode(b"P1\n3 1\n101").reshape(-1).tolist() == [0, 255, 0]
    assert media.decode(b"P4\n3 1\n\xa0").reshape(-1).tolist() == [0, 255, 0]
    assert media.decode(b"P5\n2 1\n255\n\x01\x02").shape == (1, 2, 1)
    assert media.decode(b"P6\n1 1\n65535\n" + b"\xff\xff\x80\x00\x00\x00").reshape(-1).tolist() == [255, 128, 0]
    rng = np.random.default_rng(1)
    for shape in ((3, 5, 3), (1, 1, 3), (7, 2, 3)):
        pixels = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_bmp(pixels)) == pixels).all() and (media.decode(media.encode_ppm(pixels)) == pixels).all()


def test_area_resize_is_the_mean_of_areas():
    grey = np.arange(64.0).reshape(8, 8)
    assert np.allclose(media.area_resize(grey, 4, 2), grey.reshape(4, 2, 2, 4).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(np.full((5, 3), 7.0), 9, 8), 7)


def test_bad_images_give_their_error(spark):
    odd = [b"P5 0 0 255 ", b"P5 1 1 0 x", b"P2 1 1 70000 1", b"P6\n9 9\n255\nxx", b"BM", b"BM" + bytes(52), b"P9 1 1", b"P4 99999999 99999999 1", b"", None]
    rows = [(k, None if x is None else bytearray(x)) for k, x in enumerate(odd)] + [(50, bytearray(b"P5\n1 1\n255\n\x07"))] * 2
    got = [tuple(r) for r in media.image_tiles(spark.createDataFrame(rows, "id long, content binary")).collect()]
    assert all(r[-1] and r[1] is None for r in got if r[0] < 50) and len(got) == len(rows)
    assert [(r[1], r[-1]) for r in got if r[0] == 50] == [(1, None)] * 2


def test_features_by_brute_force(documents):
    """The whole feature of random texts: the means of areas of a plain loop, each cell against its right neighbour."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcXYZ 12é") for _ in range(n)) for n in (10, 191, 192, 193, 1000, 5000)]
    got = {r["doc_id"]: r for r in media.text_media(documents(list(enumerate(texts)))).collect()}
    for d, t in enumerate(texts):
        raw = t.encode()
        grey = np.frombuffer(raw.ljust(-(-len(raw) // 192) * 192, b" "), np.uint8).reshape(-1, 64, 3).mean(axis=2)
        fine = np.repeat(np.repeat(grey, 8, axis=0), 9, axis=1)  # so many samples that areas have whole ends
        small = fine.reshape(8, grey.shape[0], 9, 64).mean(axis=(1, 3))
        bits = "".join("1" if small[i, j] + 1e-6 < small[i, j + 1] else "0" for i in range(8) for j in range(8))
        assert got[d]["feature"] == f"{int(bits, 2):016x}"
