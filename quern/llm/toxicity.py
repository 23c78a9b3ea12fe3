"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .grams import code_points, gram_buckets, squeezed

ORDERS, BITS = (3, 4, 5), 18


def present(text: str) -> np.ndarray:
    """The distinct n-gram buckets of a text."""
    seen = np.zeros(1 << BITS, bool)
    seen[gram_buckets(code_points(squeezed(text)), ORDERS, BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # log-count ratio times learnt weight, a value for each bucket
    bias: float

    def score(self, text: str | None) -> float:
        z = float(self.weights[present(text or "")].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit(texts: list[str], toxic: np.ndarray, *, alpha: float = 1.0, l2: float = 2e-4, rounds: int = 80, clip: float = 1.0) -> ToxicityModel:
    """Logistic regression on presence times ratio. ``ratio`` compares the share of toxic and of other documents
    that hold a gram, so grams that both kinds hold alike, however long the text, add next to nothing; ratios
    within ``clip`` of zero count as zero."""
    if not texts:
        return ToxicityModel(np.zeros(1 << BITS, np.float32), -2.0)
    sets = [present(t) for t in texts]
    lengths = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    y = np.asarray(toxic, np.float64)
    n_pos, n_neg = y.sum(), (1 - y).sum()
    p = (alpha + np.bincount(flat, weights=y[row], minlength=1 << BITS)) / (2 * alpha + n_pos)
    q = (alpha + np.bincount(flat, weights=1 - y[row], minlength=1 << BITS)) / (2 * alpha + n_neg)
    ratio = np.log(p / (1 - p)) - np.log(q / (1 - q))
    # Few holders make a ratio uncertain: shrink it by its standard error.
    held = np.bincount(flat, minlength=1 << BITS)
    error = np.sqrt(1 / (p * (n_pos + 2 * alpha)) + 1 / (q * (n_neg + 2 * alpha)))
    ratio = np.sign(ratio) * np.maximum(0, np.abs(ratio) - 2 * error) * (held > 1)
    ratio[np.abs(ratio) < clip] = 0
    keep = ratio[flat] != 0
    flat, row = flat[keep], row[keep]
    value = ratio[flat]
    w, bias = np.zeros(1 << BITS), float(np.log((n_pos + 1) / (n_neg + 1)))
    ahead_w, ahead_b = w, bias
    n = len(sets)
    # A bound on the curvature: the largest mean square row norm.
    norms = np.bincount(row, weights=value * value, minlength=n) + 1
    step = 4 / (norms.mean() + np.sqrt(norms.max()))
    for k in range(rounds):
        z = np.bincount(row, weights=value * ahead_w[flat], minlength=n) + ahead_b
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        new_w = ahead_w - step * (np.bincount(flat, weights=value * g[row], minlength=1 << BITS) + l2 * ahead_w)
        new_b = ahead_b - step * g.sum()
        m = k / (k + 3)
        ahead_w, ahead_b = new_w + m * (new_w - w), new_b + m * (new_b - bias)
        w, bias = new_w, float(new_b)
    return ToxicityModel((w * ratio).astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 6000, seed: int = 3) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows, the least by a seeded hash of the id, none of the held-out quarter.

    Duplicate labels of a document teach twice; null labels, ids and texts teach nothing; of an id that repeats, rows count
    towards ``max_rows`` each. The bounded sample is fitted in one task; only the model comes to the driver.
    """
    rows = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"))
    picked = rows.withColumn("draw", draw).orderBy("draw", "doc_id", "toxic").limit(max_rows)
    # max_rows ids bound this side; the rows that they find are cut to max_rows again, since ids may repeat.
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sample = sample.orderBy("draw", "doc_id", "toxic", F.xxhash64("text")).limit(max_rows).select("doc_id", "text", "toxic")

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([*batches, pd.DataFrame({"doc_id": [], "text": [], "toxic": []})]).sort_values(["doc_id", "toxic", "text"], kind="stable")
        yield pd.DataFrame({"model": [pickle.dumps(fit(list(got["text"]), got["toxic"].to_numpy(dtype=float)))]})

    row = sample.repartition(1).mapInPandas(fitted, "model binary").first()
    return pickle.loads(row["model"]) if row else fit([], np.zeros(0))  # Spark skips the task of an empty sample


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), replacing columns of those names.

    Null and empty texts get the score of a text without n-grams; a score follows from the text alone, so repeated rows and
    rows of null id score alike. One pass over whole texts, no shuffle; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.score(t) for t in texts], dtype="float64")

    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = docs.withColumn("__score", score(F.col("text"))).select(*rest, F.col("__score").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
