"""Quality rules: word and line statistics, and a character n-gram language model's perplexity.

The model is interpolated modified Kneser-Ney of order four over characters, whose n-grams Spark counts over every document: two for
each language, of either half of its texts, so that a text is scored by the half that doesn't hold it. Scores come from sorted
arrays of hashed n-grams if the model is small (its size is checked first), else from a join of each document's distinct n-grams
with the model's table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise
from .grams import code_points

ORDER = 4
_WORD = re.compile(WORD)
_SPACES = re.compile(r"\s+")
_DIGITS = re.compile(r"\d")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Characters are folded to 16 bits, so a 4-gram is one long; 1 marks the start of a text and 2 its end.
_START, _END = 1, 2
CHUNK = 1 << 20


def symbols(text: str) -> np.ndarray:
    """The text as 16-bit symbols: lower case, digits as 0, white space runs as one space, three starts and an end around it."""
    plain = _DIGITS.sub("0", _SPACES.sub(" ", text.lower())).strip()
    codes = code_points(plain)
    codes = (codes ^ (codes >> np.uint64(16)) * np.uint64(40503)) & np.uint64(0xFFFF)
    return np.concatenate([np.full(ORDER - 1, _START, np.uint64), codes, np.full(1, _END, np.uint64)])


def packed(text: str) -> np.ndarray:
    """The 4-grams that end at each symbol after the starts, as signed longs."""
    s = symbols(text)
    s16 = np.uint64(16)
    n = len(s) - ORDER + 1
    out = s[:n].copy()
    for k in range(1, ORDER):
        out <<= s16
        out |= s[k : k + n]
    return out.view(np.int64)


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts), return_counts=True)


#: Each model has a language and a half of its texts.
MODEL = ["lang", "fold"]


def fold_of(text: Column) -> Column:
    """The half that a text belongs to: equal texts to the same, so copies don't vouch for each other."""
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, fold, gram, n) over every text of ``docs`` (text, lang, fold); counts are combined in tasks before the shuffle."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (lang, fold), own in batch.groupby(MODEL, sort=False):
                parts, held = [], 0
                for text in own["text"]:
                    parts.append(packed(text or ""))
                    held += len(parts[-1])
                    if held > CHUNK:
                        gram, n = _counted(parts)
                        yield pd.DataFrame({"lang": lang, "fold": fold, "gram": gram, "n": n})
                        parts, held = [], 0
                if parts:
                    gram, n = _counted(parts)
                    yield pd.DataFrame({"lang": lang, "fold": fold, "gram": gram, "n": n})

    return docs.select("text", *MODEL).mapInPandas(counts, "lang string, fold int, gram long, n long").groupBy(*MODEL, "gram").agg(F.sum("n").alias("n"))


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 16 * order) - 1))


def _discounts(grams: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts of each model from its counts of counts."""
    c = [F.count_if(F.col("n") == k).cast("double") for k in (1, 2, 3, 4)]
    t = grams.groupBy(*MODEL).agg(*[x.alias(f"n{k}") for k, x in enumerate(c, 1)])
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * F.try_divide(f"n{k + 1}", f"n{k}")
        fallback = F.lit((0.5, 1.0, 1.5)[k - 1])
        good = (F.col(f"n{k}") > 0) & (F.col("n1") > 0) & (d > 0) & (d < k)
        out.append(F.when(good, d).otherwise(fallback).alias(f"d{k}"))
    return t.select(*MODEL, *out)


def kneser_ney(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(lang, fold, gram, p) for every 4-gram of ``asked`` (lang, fold, gram): its interpolated modified Kneser-Ney probability in that model.

    Below the highest order a gram's count is the number of different symbols seen before it. A gram that the model hasn't seen
    has what its context leaves to the order below, all of it if the context is unseen too. All joins are on
    the model and the gram, its context or its suffix; ``p`` is null for models without any text.
    """
    tables, wanted = {ORDER: counts}, {ORDER: asked}
    for order in range(ORDER - 1, 0, -1):
        suffix = _suffix(F.col("gram"), order).alias("gram")
        tables[order] = materialise(tables[order + 1].groupBy(*MODEL, suffix).agg(F.count("*").alias("n")), "ppl-counts")
        wanted[order] = wanted[order + 1].select(*MODEL, suffix).distinct()
    lower = None
    for order in range(1, ORDER + 1):
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = F.shiftrightunsigned(F.col("gram"), 16).alias("context")
        grams = tables[order].join(_discounts(tables[order]), MODEL).select(*MODEL, "gram", "n", d.alias("d"))
        contexts = grams.groupBy(*MODEL, context).agg(F.sum("n").alias("total"), F.sum("d").alias("mass"), F.count("*").alias("kinds"))
        rows = wanted[order].select(*MODEL, "gram", context).join(grams, [*MODEL, "gram"], "left").join(contexts, [*MODEL, "context"], "left")
        first = F.coalesce((F.col("n") - F.col("d")) / F.col("total"), F.lit(0.0))
        if lower is None:
            rows = rows.withColumn("p", first + F.col("mass") / F.col("total") / (F.col("kinds") + 1))
        else:
            below = lower.select(*MODEL, F.col("gram").alias("suffix"), F.col("p").alias("q"))
            rows = rows.withColumn("suffix", _suffix(F.col("gram"), order - 1)).join(below, [*MODEL, "suffix"], "left")
            rows = rows.withColumn("p", first + F.coalesce(F.col("mass") / F.col("total"), F.lit(1.0)) * F.col("q"))
        lower = materialise(rows.select(*MODEL, "gram", "p"), "ppl-model")
    return lower


def cross_fitted(counts: DataFrame) -> DataFrame:
    """(lang, fold, gram, p): the 4-grams of each half of a language's texts, as the other half's model expects them."""
    other = (1 - F.col("fold")).alias("fold")
    return kneser_ney(counts, counts.select("lang", other, "gram")).where("p IS NOT NULL").select("lang", other, "gram", "p")


class HashArrays:
    """A table of ``cross_fitted`` as sorted hash arrays, one pair (keys, log probabilities) for each language and half."""

    def __init__(self, table: pa.Table) -> None:
        langs = table.column("lang").combine_chunks().dictionary_encode()
        group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + table.column("fold").to_numpy()
        keys, values = self.hashed(table.column("gram").to_numpy()), np.log(table.column("p").to_numpy())
        order = np.lexsort((keys, group))
        ends = np.searchsorted(group[order], np.arange(2 * len(langs.dictionary) + 1))
        names = [(lang, fold) for lang in langs.dictionary.to_pylist() for fold in (0, 1)]
        self.of = {name: (keys[order[a:b]], values[order[a:b]]) for name, a, b in zip(names, ends[:-1], ends[1:], strict=True) if a < b}

    @staticmethod
    def hashed(grams: np.ndarray) -> np.ndarray:
        """An odd multiplier: one-to-one, so no two grams share a key."""
        return grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def mean_log_p(self, lang: str, fold: int, grams: np.ndarray) -> float:
        """Of grams that were all counted; not a number if the other half has no text."""
        if (lang, fold) not in self.of:
            return float("nan")
        keys, values = self.of[lang, fold]
        return float(values[np.searchsorted(keys, self.hashed(grams))].mean())


def mean_log_p_joined(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(row, log_ppl, n_grams) by joining each text's distinct grams with the model's table: for models of any size.

    ``docs`` has row, text, lang, fold, and each text once. Long texts leave a task in pieces of CHUNK grams.
    """

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for at, text in enumerate(batch["text"]):
                held.append((at, *_counted([packed(text or "")])))
                size += len(held[-1][1])
                if size > CHUNK or at == len(batch) - 1:
                    rows = np.repeat([k for k, _, _ in held], [len(g) for _, g, _ in held])
                    out = batch[["row", *MODEL]].iloc[rows].reset_index(drop=True)
                    yield out.assign(gram=np.concatenate([g for _, g, _ in held]), n=np.concatenate([n for _, _, n in held]))
                    held, size = [], 0

    found = docs.select("row", "text", *MODEL).mapInPandas(grams, "row string, lang string, fold int, gram long, n long")
    joined = found.join(model, [*MODEL, "gram"], "left")
    return joined.groupBy("row").agg((-F.sum(F.col("n") * F.log("p")) / F.sum("n")).alias("log_ppl"), F.sum("n").alias("n_grams"))


def base_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = _WORD.findall(text)
    n = len(words)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        count = Counter(windows)
        if len(count) < len(windows):
            reach = -1
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeated += i + 3 - max(i, reach)
                    reach = i + 3
    seen, dup = set(), 0
    for line in text.split("\n"):
        if _WORD.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, words)), len(_SYMBOLS.findall(text)), dup, repeated


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def perplexity_bands(scored: DataFrame, *, width: float = 0.001, step: float = 0.01) -> DataFrame:
    """(lang, fold, centre, below, above, least) of ``scored`` (lang, fold, log_ppl, n_grams): what the band of a text of any length follows from.

    A mean over n symbols strays from its language's by 1 / sqrt(n): ``centre`` is the median log perplexity, ``below`` and ``above`` are the
    medians of what texts on that side of it deviate, times sqrt(n). Long texts differ by more than that, so ``least`` is the median
    deviation of the longest quarter. Quantiles come from exact counts in cells, linear ones of ``width`` or of a ratio
    of e**``step``, so a task sees a row for each cell, not for each document.
    """

    def quantile(rows: DataFrame, by: list[str], name: str, share: float = 0.5, ratio: bool = True) -> DataFrame:
        """The quantile of the column of that name in each group."""
        cell = F.log(F.greatest(F.col(name), F.lit(1e-6))) / step if ratio else F.col(name) / width
        cells = rows.groupBy(*by, F.round(cell).cast("long").alias("cell")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*by).orderBy("cell"))
        total = F.sum("n").over(Window.partitionBy(*by))
        found = cells.select(*by, "cell", upto.alias("upto"), total.alias("total")).where(F.col("upto") >= share * F.col("total")).groupBy(*by).agg(F.min("cell").alias("cell"))
        return found.select(*by, (F.exp(F.col("cell") * step) if ratio else F.col("cell") * width).alias(name))

    rows = scored.select(*MODEL, F.col("log_ppl").alias("centre"), F.col("n_grams").cast("double").alias("long"))
    known = materialise(quantile(rows, MODEL, "centre", ratio=False).join(quantile(rows, MODEL, "long", 0.75), MODEL), "ppl-centres")
    off = F.abs(F.col("log_ppl") - F.col("centre"))
    side = F.when(F.col("log_ppl") < F.col("centre"), "below").otherwise("above")
    rows = scored.join(known, MODEL).select(*MODEL, side.alias("side"), (F.col("n_grams") >= F.col("long") * (1 - step)).alias("is_long"), off.alias("least"), (off * F.sqrt("n_grams")).alias("scaled"))
    sides = quantile(rows, [*MODEL, "side"], "scaled")
    both = sides.groupBy(*MODEL).agg(*[F.max(F.when(F.col("side") == s, F.col("scaled"))).alias(s) for s in ("below", "above")])
    return known.select(*MODEL, "centre").join(both, MODEL).join(quantile(rows.where("is_long"), MODEL, "least"), MODEL)


def quality_rules(docs: DataFrame, *, min_words: int = 50, max_repeat_percent: int = 50, spread: float = 5.0, max_arrays: int = 2_000_000) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, lang) with base statistics, log_ppl, the band of its language and length, base_failed and kept.

    A document is kept if it passes the base rules and its log perplexity lies within the band of its language and length
    (``spread`` median deviations of that side below and above the median, see ``perplexity_bands``), which is learnt from the documents
    that pass the base rules. A text is scored by a model of the half of its language's texts that it isn't in; a language
    without other texts has no model, its log_ppl and band are null and it is kept if it passes the base rules.
    A null language is a language of its own; null and
    empty texts have no words, fail the base rules and so are not kept. Repeated rows and rows of null id are judged by their text alike.
    Columns of the added names are replaced; an empty table gives no rows. ``max_arrays`` is the number of n-grams
    up to which the model is broadcast as sorted arrays; both ways of scoring give the same figures to nine digits.
    """
    added = (*BASE, "log_ppl", "low", "high", "base_failed", "kept")
    keep = [c for c in docs.columns if c.lower() not in added]

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    def base(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([base_statistics(t or "") for t in texts], columns=list(BASE), dtype="int64")

    text, lang = F.coalesce("text", F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit("\x00"))
    model = cross_fitted(materialise(count_grams(docs.select(text.alias("text"), lang.alias("lang"), fold_of(text).alias("fold"))), "ppl-counts"))
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("text"), lang.alias("lang"), fold_of(text).alias("fold"))
    failed = (F.col("b.n_words") < min_words) | (100 * F.col("b.n_repeat_words") > max_repeat_percent * F.col("b.n_words"))
    if model.count() <= max_arrays:
        held = docs.sparkSession.sparkContext.broadcast(HashArrays(model.toArrow()))

        @F.pandas_udf("log_ppl double, n_grams long")
        def score(texts: pd.Series, langs: pd.Series, folds: pd.Series) -> pd.DataFrame:
            log_ppl, n_grams = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for i, (text, lang, fold) in enumerate(zip(texts, langs, folds, strict=True)):
                grams = packed(text)
                log_ppl[i], n_grams[i] = -held.value.mean_log_p(lang, fold, grams), len(grams)
            return pd.DataFrame({"log_ppl": log_ppl, "n_grams": n_grams})

        scored = texts.select("row", *MODEL, base("text").alias("b"), score("text", *MODEL).alias("s"))
        scored = scored.select("row", *MODEL, "b", F.nanvl("s.log_ppl", F.lit(None)).alias("log_ppl"), "s.n_grams")
    else:
        keyed = texts.withColumn("key", F.sha2(F.concat_ws("\x00", "lang", "text"), 256))
        distinct = keyed.groupBy(F.col("key").alias("row")).agg(*[F.any_value(c).alias(c) for c in ("text", *MODEL)])
        found = mean_log_p_joined(distinct, model)
        scored = keyed.join(found.withColumnRenamed("row", "key"), "key").select("row", *MODEL, base("text").alias("b"), "log_ppl", "n_grams")
    scored = materialise(scored.withColumn("log_ppl", F.round("log_ppl", 9)).withColumn("base_failed", failed), "ppl-scores")
    bands = materialise(perplexity_bands(scored.where("NOT base_failed AND log_ppl IS NOT NULL")), "ppl-bands")

    def reach(side: str) -> Column:
        """Texts that are all alike have no deviation; a hundredth is no difference."""
        return F.greatest(spread * F.greatest(F.col(side) / F.sqrt("n_grams"), F.col("least")), F.lit(0.01))

    low, high = F.col("centre") - reach("below"), F.col("centre") + reach("above")
    within = F.coalesce(F.col("log_ppl").between(low, high), F.lit(True))
    return scored.join(bands, MODEL, "left").select("row.*", "b.*", "log_ppl", low.alias("low"), high.alias("high"), "base_failed", (~F.col("base_failed") & within).alias("kept"))
