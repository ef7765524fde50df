"""Quality: histogram gradient-boosted trees over document statistics, flattened into arrays.

The statistics are shares and means of a whole text that don't depend on its language: lengths, kinds of characters,
repeated words and lines, how lines end, how well the text compresses. Trees are grown on a bounded sample of labelled
rows: values are put into bins once and splits are read from sums of gradients by bin. The fitted trees lie in flat arrays
of features, limits and children; a batch of rows walks down all trees by array lookups. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, small_batches
from .learning import SAMPLE_ROWS, held_out, labelled_sample

SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]")
STATISTICS = (
    "log_chars log_words word_mean word_sd long_words short_words symbol_share symbol_words digits upper commas stops "
    "unique_words top_word same_as_before same_pairs lines_log line_words repeated_lines short_lines line_ends compression capital_words inner_marks"
).split()


def statistics(text: str | None) -> list[float]:
    """The statistics of one text; an empty text, or none, gives zeros."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    symbols = SYMBOL.findall(text)
    counts = Counter(words)
    pairs = n - 1
    same = sum(a == b for a, b in zip(words, words[1:]))
    distinct_pairs = len(set(zip(words, words[1:])))
    lines = [line.strip() for line in text.split("\n")]
    lines = [line for line in lines if line]
    raw = text.encode("utf-8", "surrogatepass")
    bare = [w.rstrip(".,;:!?") for w in words]
    return [
        np.log1p(chars),
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        float((lengths > 12).mean()),
        float((lengths < 3).mean()),
        len(symbols) / chars,
        sum(not w.replace("'", "").replace("-", "").isalnum() for w in bare) / n,
        sum(map(str.isdigit, text)) / chars,
        sum(map(str.isupper, text)) / chars,
        text.count(",") / n,
        (text.count(".") + text.count("!") + text.count("?")) / n,
        len(counts) / n,
        max(counts.values()) / n,
        same / pairs if pairs else 0.0,
        1 - distinct_pairs / pairs if pairs else 0.0,
        np.log1p(len(lines)),
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        sum(len(line) < 30 for line in lines) / len(lines),
        sum(line[-1] in ".!?\"'" for line in lines) / len(lines),
        len(zlib.compress(raw, 1)) / len(raw),
        sum(w[0].isupper() for w in words) / n,
        sum(1 for w in words if w in "|*#$%&-_=+~^<>/\\") / n,
    ]


@dataclass
class Trees:
    """Trees in flat arrays. ``feature`` is -1 at a leaf, whose ``value`` counts; ``roots`` has the place of each tree's root."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            f = self.feature[at]
            inner = f >= 0
            goes_left = x[rows, np.maximum(f, 0)] <= self.limit[at]
            at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
        z = self.base + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 10) -> Trees:
    """Boost ``trees`` trees under the logistic loss. Without rows, or with one label, the score is the share of label 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    feature, limit, left, right, value, roots = [], [], [], [], [], []
    if len(y) and y.min() < y.max():
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # bin b: values up to cuts[b]
        z = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)

            def grow(rows: np.ndarray, left_depth: int) -> int:
                here = len(feature)
                for column, empty in ((feature, -1), (limit, 0.0), (left, 0), (right, 0), (value, 0.0)):
                    column.append(empty)
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, -1, 0)
                if left_depth and len(rows) >= 2 * least:
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[rows, j]
                        size = len(c) + 1
                        gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        gain[(nl < least) | (len(rows) - nl < least)] = -1
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (float(gain[k]), j, k)
                if best[1] < 0:
                    value[here] = -rate * gs / (hs + ridge)
                    z[rows] += value[here]
                    return here
                _, j, k = best
                feature[here], limit[here] = j, cuts[j][k]
                goes = binned[rows, j] <= k
                left[here] = grow(rows[goes], left_depth - 1)
                right[here] = grow(rows[~goes], left_depth - 1)
                return here

            roots.append(grow(np.arange(len(y)), depth))
    return Trees(*(np.array(a, t) for a, t in ((feature, np.int32), (limit, float), (left, np.int32), (right, np.int32), (value, float), (roots, np.int32))), depth, base)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> Trees:
    """Fit on at most ``rows`` labelled rows that aren't held out; their statistics reach the driver, not their texts."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "label": batch["label"].astype("int32"), "x": [statistics(t) for t in batch["text"]]})

    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, rows, key, text).select(F.col("k_").cast("string").alias("k"), "label", "text")
    got = sample.mapInPandas(of, "k string, label int, x array<double>").toPandas().sort_values("k", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(STATISTICS))
    return fit(x, got["label"].to_numpy(float))


def score(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, score, predicted (1 from a score of 0.3).

    Null text counts as empty and is scored by its statistics, all zero. Keys may be null or repeat. Other columns are not read.
    """

    @F.pandas_udf(T.DoubleType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch], float).reshape(-1, len(STATISTICS))
            yield pd.Series(model.score(x))

    small_batches(docs.sparkSession)
    out = docs.select(F.col(key).alias("k"), held_out(key).alias("held_out"), of(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("score"))
    return out.select(F.col("k").alias(key), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score(docs, learn(docs, load(spark, sf_dir, "labels")))
