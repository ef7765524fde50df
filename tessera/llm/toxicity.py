"""Toxicity: a counterfactual-regularised logistic classifier on words and word stems.

Learning. From a bounded sample of labelled rows, presence features (words and their first four and five letters, hashed)
are chosen by how well they tell the labels apart, and a logistic model is fitted. In every labelled text that
names a group, the identity term is swapped for the others of its set; the squared change of the score that the swap makes is
penalised. A term that merely co-occurs with abuse thus can't carry weight of its own, and neutral mentions of a
group aren't taken for abuse.

Scoring is one pass over the whole texts: a word's weight is looked up once and cached in a bounded table; there is no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, small_batches
from .learning import SAMPLE_ROWS, held_out, labelled_sample

BUCKETS = 1 << 22
FEATURES = 1500
CACHED_WORDS = 200_000
#: Weight of the squares of the coefficients, steps of the fit, and least gain of a feature: chosen by ``choose`` on rows that are learned from (see README).
RIDGE, STEPS, LEAST_GAIN = 1e-5, 400, 8.0
WORD = re.compile(r"[^\W\d_]+")
#: Sets of terms that name groups; a swap takes another term of the same set.
IDENTITY = [
    ["women", "men"],
    ["woman", "man"],
    ["female", "male"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino"],
    ["gay", "lesbian", "straight", "transgender", "bisexual"],
    ["immigrants", "refugees", "citizens"],
    ["deaf", "blind", "disabled"],
    ["young", "old"],
]


def feature_ids(word: str) -> list[int]:
    """Hashed features of a word: itself and, if it is longer, its first four and five letters."""
    names = [f"w{word}"] + [f"p{word[:n]}" for n in (4, 5) if len(word) >= n]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def score(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            z = self.bias
            for word in words_of(text or ""):
                w = cache.get(word)
                if w is None:
                    w = sum(self.weights.get(f, 0.0) for f in set(feature_ids(word)))
                    if len(cache) < CACHED_WORDS:
                        cache[word] = w
                z += w
            out[i] = z
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _gather(sample: DataFrame) -> pd.DataFrame:
    """Feature ids of each sampled text, and of the texts that identity swaps make of it, as bytes of 32-bit integers."""
    groups = {term: [t for t in terms if t != term] for terms in IDENTITY for term in terms}

    def pack(words: set[str]) -> bytes:
        return np.unique(np.array([f for w in words for f in feature_ids(w)], np.int32)).tobytes()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for label, text in zip(batch["label"], batch["text"]):
                words = words_of(text)
                swapped = [pack((words - {t}) | {other}) for t in sorted(words & groups.keys()) for other in groups[t]]
                rows.append((int(label), pack(words), swapped))
            yield pd.DataFrame(rows, columns=["label", "ids", "swapped"])

    return sample.select("label", "text").mapInPandas(of, "label int, ids binary, swapped array<binary>").toPandas()


def _select(docs: list[np.ndarray], y: np.ndarray, features: int, least_gain: float) -> np.ndarray:
    """The features that tell the labels apart best, by their likelihood ratio; each occurs in three texts at least."""
    n, pos = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for ids, label in zip(docs, y.astype(np.int32).tolist()):  # a text's features are distinct
        n[ids] += 1
        pos[ids] += label
    ids = np.flatnonzero(n >= 3)
    n, pos = n[ids].astype(float), pos[ids].astype(float)
    base = min(max(y.mean(), 1e-6), 1 - 1e-6) if len(y) else 0.5

    def xlog(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log(np.maximum(a, 1e-300) / np.maximum(b, 1e-300)), 0)

    gain = xlog(pos, n * base) + xlog(n - pos, n * (1 - base))
    best = np.argsort(-gain, kind="stable")[:features]
    return np.sort(ids[best[gain[best] > least_gain]])


def fit(data: pd.DataFrame, features: int = FEATURES, ridge: float = RIDGE, counterfactual: float = 1.0, steps: int = STEPS, least_gain: float = LEAST_GAIN) -> Model:
    """Fit from rows of ``label, ids, swapped``. ``counterfactual`` weighs the penalty on score changes under swaps.

    Without rows, or with one label only, the model gives the share of label 1 (one half without rows).
    """
    y = data["label"].to_numpy(np.float32) if len(data) else np.zeros(0, np.float32)
    docs = [np.frombuffer(b, np.int32) for b in data["ids"]] if len(data) else []
    share = (float(y.sum()) + 0.5) / (len(y) + 1)
    chosen = _select(docs, y, features, least_gain)
    if not len(chosen) or y.min() == y.max():
        return Model({}, float(np.log(share / (1 - share))))

    def places(ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(chosen, ids)
        return at[(at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == ids)]

    x = np.zeros((len(docs), len(chosen)), np.float32)
    for i, d in enumerate(docs):
        x[i, places(d)] = 1
    # A swap changes a few features; only these are held: which change, of which swap, with which sign.
    change, owner, sign, swaps = [], [], [], 0
    for i, own in enumerate(data["swapped"]):
        for other in own if own is not None else []:
            other = places(np.frombuffer(other, np.int32))
            gone, new = np.setdiff1d(np.flatnonzero(x[i]), other), other[x[i, other] == 0]
            if len(gone) + len(new):
                change += [gone, new]
                owner.append(np.full(len(gone) + len(new), swaps))
                sign.append(np.append(np.ones(len(gone)), -np.ones(len(new))))
                swaps += 1
    change, owner, sign = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (change, owner, sign))
    # The fit starts at a third of each feature's log-odds, as a word has three features.
    odds = np.log((y @ x + 0.5) / (y.sum() + 1)) - np.log(((1 - y) @ x + 0.5) / ((1 - y).sum() + 1))
    w, b = (odds / 3).astype(np.float32), float(np.log(share / (1 - share)))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        err = ((p - y) / len(y)).astype(np.float32)
        grad = np.append(err @ x + ridge * w, err.sum())
        if swaps:
            by_swap = np.bincount(owner, sign * w[change], swaps)
            grad[:-1] += 2 * counterfactual * np.bincount(change, sign * by_swap[owner], len(chosen)) / swaps
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1].astype(np.float32)
        b -= float(move[-1])
    return Model({int(f): float(c) for f, c in zip(chosen, w) if abs(c) > 1e-4}, b)


def choose(data: pd.DataFrame, settings: list[dict], folds: int = 3) -> list[tuple[float, dict]]:
    """Settings of ``fit`` with their log loss in cross-validation on the rows of ``data``, the best one first."""
    fold, out = np.arange(len(data)) % folds, []
    for setting in settings:
        loss = 0.0
        for f in range(folds):
            model, rest = fit(data[fold != f], **setting), data[fold == f]
            z = [model.bias + sum(model.weights.get(i, 0.0) for i in np.frombuffer(ids, np.int32).tolist()) for ids in rest["ids"]]
            p = np.clip(1 / (1 + np.exp(-np.clip(z, -40, 40))), 1e-6, 1 - 1e-6)
            loss -= float(np.where(rest["label"] == 1, np.log(p), np.log(1 - p)).sum())
        out.append((loss / max(1, len(data)), setting))
    return sorted(out, key=lambda x: x[0])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most ``rows`` labelled rows that aren't held out."""
    small_batches(docs.sparkSession)
    return fit(_gather(labelled_sample(docs, labels, label, rows, key, text)))


def score_column(model: Model, text: str = "text") -> Column:
    """The score of a text column; null counts as empty and gets the model's base rate."""

    @F.pandas_udf(T.DoubleType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, float] = {}
        for batch in batches:
            yield pd.Series(model.score(list(batch), cache))

    return of(F.coalesce(F.col(text).cast("string"), F.lit("")))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, score, predicted (1 from a score of 0.5).

    Null text counts as empty. Keys may be null or repeat. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    out = docs.select(F.col(key).alias("k"), held_out(key).alias("held_out"), score_column(model, text).alias("score"))
    return out.select(F.col("k").alias(key), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score(docs, learn(docs, load(spark, sf_dir, "labels")))
