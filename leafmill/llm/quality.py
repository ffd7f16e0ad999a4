"""Quality scores by Bradley-Terry ranking.

Features of whole texts (character classes, repetition, word lengths) are learned from preference pairs: a
document labelled good is preferred to one labelled bad, and the loss is the logistic of the difference of
their features. The raw score at the quantile that the share of bad labels gives is the threshold; it maps
to a score of 0.3.

Null and empty texts have features of zeros and get a score like any other. With labels of one kind only, or
none, there are no pairs, and every score is 0.5. Repeated rows are scored one by one.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import crc_mod

#: The most labelled rows that training takes (those whose ids hash lowest) and the pairs drawn from them.
MAX_LABELLED, PAIRS = 20_000, 40_000
THRESHOLD = 0.3

_SIGNS = {**{c: 1 for c in range(65, 91)}, **{c: 2 for c in range(48, 58)}, 32: 3, 9: 3, 10: 3, 13: 3, **{ord(c): 4 for c in ".,;:'\"()-"}, 33: 5, 63: 5, 124: 6, **{ord(c): 7 for c in "%&$#*@^~<>{}[]\\/=+_`"}}
_CLASS = np.array([_SIGNS.get(c, 0) for c in range(256)], dtype=np.uint8)
N_FEATURES = 13


def features(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    small, upper, digit, _, punct, shout, pipe, sign = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=8).tolist()
    lines = text.split(b"\n")
    share = len(set(words)) / n
    return [
        upper / (upper + small + 1), digit / len(text), punct / n, shout / n, pipe / n, sign / n,
        np.log(n), np.log(len(text) / n), np.log(share), share,
        sum(map(operator.eq, words, words[1:])) / n, len(set(lines)) / len(lines), np.log1p(n) * np.log(share),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.at) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Model | None:
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton steps of the penalised logistic loss
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        grad = d.T @ (p - 1) / pairs + 1e-3 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ w
    ranked = np.sort(raw)
    k = len(bad)  # the quantile between the share of bad labels and the rest
    at = float((ranked[k - 1] + ranked[k]) / 2)
    spread = max(1e-6, float(np.median(raw[good]) - np.median(raw[bad])))
    return Model(mean, scale, w, at, 12 / spread)


def labelled_sample(labels: DataFrame, label: str, fold: int, held: int, most: int = MAX_LABELLED) -> DataFrame:
    """At most ``most`` labelled ids outside the held-out fold, those whose ids hash lowest."""
    return (
        labels.where((crc_mod(F.col("doc_id"), fold) != held) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64(F.col("label_id"), F.lit(17)), "label_id", "y").limit(most)
    )


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    sample = labelled_sample(labels, "quality", 5, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    rows = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("y", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    found = sorted((r["y"], r["x"]) for r in rows.mapInArrow(run, "y int, x array<double>").collect())
    if not found:
        return None
    return fit(np.array([x for _, x in found]), np.array([y for y, _ in found]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, N_FEATURES)
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
