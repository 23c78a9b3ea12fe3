"""Hashing embedder and vector arithmetic."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import word_tokens

DIM = 384
#: The hash's start and factor, and the characters of a text that an embedder reads.
FNV_START, FNV_FACTOR = 2166136261, 16777619
MOST_CHARS = 3000
_MASK = np.uint64(0xFFFFFFFF)
#: Words of the texts that are embedded together.
CHUNK = 1 << 19


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-8 bytes, as a long."""
    bytes_ = F.filter(F.regexp_extract_all(F.hex(text.cast("binary")), F.lit("[0-9A-F]{2}"), 0), lambda x: x != "")
    return F.aggregate(bytes_, F.lit(FNV_START).cast("long"), lambda h, b: (h.bitwiseXOR(F.conv(b, 16, 10).cast("long")) * F.lit(FNV_FACTOR)).bitwiseAND(F.lit(0xFFFFFFFF)))


def _hashed(parts: list[bytes], start: np.ndarray | int = FNV_START) -> np.ndarray:
    """FNV-1a of many byte strings at once, a byte of each in a step, from given states on."""
    size = np.array([len(p) for p in parts], np.int64)
    flat, first = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(size)])[:-1]
    state = np.zeros(len(parts), np.uint64) + np.asarray(start, np.uint64)
    order = np.argsort(-size, kind="stable")
    for k in range(int(size.max(initial=0))):
        live = order[: int(np.searchsorted(-size[order], -k))]  # those of more than k bytes
        state[live] = ((state[live] ^ flat[first[live] + k]) * np.uint64(FNV_FACTOR)) & _MASK
    return state


def embed_tokens(texts: list[list[str]], dim: int = DIM) -> np.ndarray:
    """A row of bucket weights for each text: words by 1, word pairs by 1.2, both with more weight on the first ten words, and the
    letter trigrams of longer words by 0.4. Not normalised."""
    known: dict[str, int] = {}
    ids = [np.array([known.setdefault(w, len(known)) for w in words], np.int64) for words in texts]
    coded = [w.encode() for w in known]
    state = _hashed(coded)
    threes: dict[str, int] = {}
    own = [[threes.setdefault(w[i : i + 3], len(threes)) for i in range(len(w) - 2)] for w in known]
    three_bucket = (_hashed([t.encode() for t in threes]) % np.uint64(dim)).astype(np.int64)
    counts = np.array([len(x) for x in own], np.int64)
    flat, first = np.array([i for x in own for i in x], np.int64), np.concatenate([[0], np.cumsum(counts)])
    word, at = np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in ids]])
    text = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    place = 1.0 + 0.5 * np.maximum(0, 10 - at) / 10
    out = np.zeros(len(ids) * dim)
    out += np.bincount(text * dim + (state[word] % np.uint64(dim)).astype(np.int64), weights=place, minlength=len(out))
    joined = np.flatnonzero(text[1:] == text[:-1])
    if len(joined):
        pair, back = np.unique(word[joined] * len(known) + word[joined + 1], return_inverse=True)
        under = ((state ^ np.uint64(ord("_"))) * np.uint64(FNV_FACTOR)) & _MASK
        bucket = (_hashed([coded[i] for i in pair % len(known)], under[pair // len(known)]) % np.uint64(dim)).astype(np.int64)
        out += np.bincount(text[joined] * dim + bucket[back], weights=1.2 * place[joined], minlength=len(out))
    n = counts[word]
    if n.sum():
        steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = three_bucket[flat[np.repeat(first[word], n) + steps]]
        out += np.bincount(np.repeat(text, n) * dim + found, weights=np.full(len(found), 0.4), minlength=len(out))
    return out.reshape(len(ids), dim)


def _weights(dim: int, unit: bool) -> Callable[[Column], Column]:
    """Of tokens joined by spaces: one string a text is cheaper to hand over than an array of them."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def weights(joined: pd.Series) -> pd.Series:
        out, held, size = [], [], 0
        for k, words in enumerate(joined):
            held.append(words.split(" ") if words else [])
            size += len(held[-1])
            if size > CHUNK or k == len(joined) - 1:
                rows = embed_tokens(held, dim)
                if unit:
                    rows /= np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300)
                out += list(rows)
                held, size = [], 0
        return pd.Series(out, dtype=object)

    return lambda tokens: weights(F.array_join(tokens, " "))


def hash_embedding_buckets(docs: DataFrame, key: str, text: str, dim: int = DIM, unit: bool = False) -> DataFrame:
    """(key, bucket, weight) of ``embed_tokens``, the buckets that a text's words fill, at unit length with ``unit``. Texts without words give no rows. One pass, no shuffle."""
    found = docs.select(key, F.posexplode(_weights(dim, unit)(word_tokens(F.col(text)))).alias("bucket", "weight"))
    return found.where("weight > 0")


def hash_embeddings(docs: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, vector): the embedder's unit vectors of the texts' first ``MOST_CHARS`` characters; those without words get zeros. One pass, no shuffle."""
    return docs.select(key, _weights(dim, True)(word_tokens(F.left(F.col(text), F.lit(MOST_CHARS)))).alias("vector"))


def embeddings(docs: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]] | None = None, dim: int = DIM) -> DataFrame:
    """(key, model_name, vector): vectors of a given embedder, called in the tasks with a batch of texts; where it fails or there is none, the hashing one's."""
    own = hash_embeddings(docs, key, text, dim).select(key, F.lit("hash").alias("model_name"), "vector")
    if embed is None:
        return own

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def called(texts: pd.Series) -> pd.Series:
        try:
            got = embed([t or "" for t in texts])
            return pd.Series([[float(x) for x in v] for v in got], dtype=object)
        except Exception:  # noqa: BLE001  whatever fails, the fallback takes over
            return pd.Series([None] * len(texts), dtype=object)

    cut = docs.select(key, text, called(F.left(F.col(text), F.lit(MOST_CHARS))).alias("__given"), _weights(dim, True)(word_tokens(F.left(F.col(text), F.lit(MOST_CHARS)))).alias("__own"))
    return cut.select(key, F.when(F.col("__given").isNotNull(), F.lit("given")).otherwise(F.lit("hash")).alias("model_name"), F.coalesce("__given", "__own").alias("vector"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm(v)), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
