import os
import random
import struct

import numpy as np
import pytest

from quern.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.DEFAULT_MODEL), reason="no model file here")
TEXTS = ["", " ", "Hello world", "  a  b ", "a\tb\nc", "日本語 ﬁ Ⅳ é", "x ", "      Ⅳ  y", "aaaaaaaaaaaaaaaaaaaa", "12345 3.14", "x\n\n y", "it's don't", "\x00x", "Übergröße façade niño " * 50]


def test_ids_equal_the_librarys():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        model = pieces.PieceModel(f.read())
    for most in (600_000, 5):  # with and without room for what was learnt
        encoder = pieces.SharedPrefixViterbi(model, most)
        assert [x.tolist() for x in encoder.encode(TEXTS)] == sp.encode(TEXTS)
        assert [encoder.decode(np.array(sp.encode(t), np.int32)) for t in TEXTS] == [sp.decode(sp.encode(t)) for t in TEXTS]


def test_unigram_scores_give_the_best_sum():
    encoder = pieces.SharedPrefixViterbi.__new__(pieces.SharedPrefixViterbi)
    pieces.SharedPrefixViterbi.__init__(encoder, type("M", (), {"ids": {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4, "▁": 5}, "scores": [-1.0, -1.0, -1.5, -0.2, -3.0, -1.0], "ranked": False, "longest": 3, "lowest": -13.0, "byte": {}, "unk": 9})())
    assert encoder.encode(["aba"])[0].tolist() == [5, 0, 3]


def field(number, payload):
    """A length-delimited protobuf field, or a varint or float one for numbers."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(payload, float):
        return varint(number << 3 | 5) + struct.pack("<f", payload)
    if isinstance(payload, int):
        return varint(number << 3) + varint(payload)
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def unigram_model(pieces_):
    """A unigram model file with these pieces and scores: unknown, then the given ones; no normalisation but a leading mark."""
    out = field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, 2))
    for piece, score in pieces_:
        out += field(1, field(1, piece.encode()) + field(2, score))
    trainer = field(2, field(3, 1))  # unigram
    normalizer = field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    return out + trainer + normalizer


def test_unigram_ids_equal_the_librarys():
    """Forward scores shared along the trie: random pieces and scores, random words, the library's own Viterbi. The same pieces in
    another order (a|aa) tie; there the library goes by what rounding of the whole text's sum makes of it."""
    import sentencepiece

    rng = random.Random(3)
    found = {"▁": -3.5} | {c: -rng.uniform(3, 6) for c in "abcd"}
    while len(found) < 80:
        found.setdefault("".join(rng.choice("abcd") for _ in range(rng.randint(2, 5))) if rng.random() < 0.6 else "▁" + "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))), -rng.uniform(2, 12))
    data = unigram_model(found.items())
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 8))) for _ in range(400)]
    encoder = pieces.SharedPrefixViterbi(pieces.PieceModel(data))
    assert not encoder.model.ranked
    got, want = [x.tolist() for x in encoder.encode(texts)], [sp.encode(t) for t in texts]
    assert [sorted(x) for x in got] == [sorted(x) for x in want] and sum(x == y for x, y in zip(got, want, strict=True)) > 0.9 * len(texts)
    assert [encoder.decode(np.array(x, np.int32)) for x in want] == texts


def test_frames(documents):
    docs = documents([*enumerate(TEXTS), (100, None), (101, "word " * 20000), (101, "word " * 20000)], extra="ids")
    got = {r["doc_id"]: r for r in pieces.round_trip(docs).collect()}
    assert all(r["round_trip"] for r in got.values()) and got[100]["ids"] is None and got[0]["ids"] == []
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode_pieces(pieces.encode_pieces(docs)).collect()}
    assert all(back[d] == t for d, t in enumerate(TEXTS)) and back[100] is None
    assert pieces.round_trip(documents([])).count() == 0
    big = 2**53 + 1
    assert {r["doc_id"] for r in pieces.round_trip(documents([(big, "a"), (None, "b")])).collect()} == {big, None}
