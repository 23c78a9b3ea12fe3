"""Language identification by hierarchical discrimination: family first, then one-versus-one linear SVMs."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, materialise
from .grams import code_points, gram_buckets, letters_only

#: Families by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
    "semitic": ("ar", "he", "mt"),
}
ORDERS, BITS = (1, 2, 3), 13
UNDETERMINED = "und"


def features(text: str) -> np.ndarray | None:
    """Unit vector of root counts of letter 1- to 3-grams; None if there is no letter."""
    text = letters_only(text)
    if not text.strip():
        return None
    counts = np.sqrt(np.bincount(gram_buckets(code_points(text), ORDERS, BITS), minlength=1 << BITS).astype(np.float32))
    return counts / np.linalg.norm(counts)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 120) -> np.ndarray:
    """Linear SVM (squared hinge, classes weighted alike) by accelerated gradient descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    step = 1 / (1 / c + 4)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (ahead / c - 2 * (x.T @ (weight * y * slack)))
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


@dataclass
class LanguageModel:
    families: list[tuple[str, list[str]]]
    family_weights: np.ndarray  # a row for each family
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    sharpness: float = 6.0

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: share of the family times share of pairwise wins within it."""
        x = features(text) if text else None
        if x is None or not self.families:
            return UNDETERMINED, 0.0
        margins = self.family_weights[:, :-1] @ x + self.family_weights[:, -1]
        if len(self.families) == 1:
            best, share = 0, 1.0
        else:
            odds = np.exp(self.sharpness * (margins - margins.max()))
            best = int(odds.argmax())
            share = float(odds[best] / odds.sum())
        members = self.families[best][1]
        if len(members) == 1:
            return members[0], share
        wins, soft = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for (a, b), w in self.pair_weights.items():
            if a in wins and b in wins:
                m = float(w[:-1] @ x + w[-1])
                p = 1 / (1 + np.exp(-self.sharpness * m))
                wins[a if m >= 0 else b] += 1
                soft[a] += p
                soft[b] += 1 - p
        lang = max(members, key=lambda k: (wins[k], soft[k], k))
        return lang, min(1.0, max(0.0, float(share * soft[lang] / (len(members) - 1))))


def fit(rows: list[tuple[str, str]], families: dict[str, tuple[str, ...]] | None = None) -> LanguageModel:
    """Fit on (text, lang) pairs; texts without a letter teach nothing."""
    family_of = {lang: name for name, langs in (families or FAMILIES).items() for lang in langs}
    made = [(f, lang) for text, lang in rows if (f := features(text)) is not None]
    if not made:
        return LanguageModel([], np.zeros((0, (1 << BITS) + 1), np.float32))
    x, lang = np.array([f for f, _ in made]), np.array([k for _, k in made], dtype=object)
    names = sorted({family_of.get(k, k) for k in lang})
    groups = [(n, sorted({k for k in lang if family_of.get(k, k) == n})) for n in names]
    own = np.array([family_of.get(k, k) for k in lang], dtype=object)
    top = np.array([fit_svm(x, np.where(own == n, 1, -1).astype(np.float32)) if len(names) > 1 else np.zeros(x.shape[1] + 1, np.float32) for n in names])
    pairs = {}
    for _, members in groups:
        for a, b in combinations(members, 2):
            both = (lang == a) | (lang == b)
            pairs[a, b] = fit_svm(x[both], np.where(lang[both] == a, 1, -1).astype(np.float32))
    return LanguageModel(groups, top, pairs)


def train(docs: DataFrame, *, max_per_lang: int = 400, max_rows: int = 40_000, families: dict[str, tuple[str, ...]] | None = None, seed: int = 5) -> LanguageModel:
    """Fit on at most ``max_per_lang`` rows of each language, fewer (but one at least) where that were over ``max_rows`` in all.

    The sample is the least by a seeded hash of the id, ties by the text's hash. Rows of the held-out quarter and rows without id, text
    or language are never used. The bounded sample is fitted in one task; only the model comes to the driver.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"))
    share = F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") / float(1 << 32)
    counts = materialise(known.groupBy("lang").agg(F.count("*").alias("n")), "lang-counts")
    most = max(1, min(max_per_lang, max_rows // max(1, counts.count())))
    # Of a language's n rows those of a share that holds ``most`` for certain, so that few are sorted.
    near = known.select("doc_id", "text", "lang", draw.alias("draw")).join(counts, "lang").where(share <= (1.5 * most + 50) / F.col("n"))
    first = Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text"))
    sample = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).select("doc_id", "text", "lang")

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"doc_id": [], "text": [], "lang": []})]).sort_values(["doc_id", "lang", "text"], kind="stable")
        yield pd.DataFrame({"model": [pickle.dumps(fit(list(zip(rows["text"], rows["lang"], strict=True)), families))]})

    row = sample.repartition(1).mapInPandas(fitted, "model binary").first()
    return pickle.loads(row["model"]) if row else fit([], families)  # Spark skips the task of an empty sample


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (0 to 1), replacing columns of those names.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text for a model without languages. A prediction
    follows from the text alone, so repeated rows and rows of null id are predicted alike; of languages that tie
    the last by name wins. One pass over whole texts, no shuffle; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.withColumn("__found", predict(F.col("text"))).select(*rest, "__found.lang_pred", "__found.score")
