"""Quality classifier: naive Bayes support vectors.

Indicators of hashed token unigrams and bigrams are scaled by the log ratio of the classes' counts, which are
counted over all labelled training rows. A linear hinge-loss model is then fitted by dual coordinate descent
on a bounded sample of the labelled training rows (SAMPLE), drawn towards the scaled mean as usual for this
method, and its margin is turned into a probability on a part of the sample that it has not seen.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from .common import WordHasher, documents, mix64

#: Features (a power of two), rows of the fitting sample at most, penalty of the hinge loss, share of the fitted weights.
FEATURES, SAMPLE, PENALTY, BETA = 1 << 17, 8_000, 0.1, 0.5
THRESHOLD = 0.3
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]")
_hasher = None


def features(text: str | None, n: int = FEATURES) -> np.ndarray:
    """Sorted distinct indices of a text's unigrams (words and single signs) and bigrams; null and blank texts have none."""
    global _hasher
    if _hasher is None:
        _hasher = WordHasher(300_000)
    tokens = _TOKEN.findall((text or "").encode().lower())
    if not tokens:
        return np.zeros(0, np.int32)
    h = _hasher(tokens)
    both = np.concatenate([h, mix64(h[:-1] * np.uint64(3) + h[1:])])
    seen = np.unique((both >> np.uint64(40)) % np.uint64(n))
    return seen.astype(np.int32)


def count(rows: DataFrame, n: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Documents of either class that have a feature, over all rows (text, y)."""

    def work(batches):
        c = np.zeros((2, n), np.int64)
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist()):
                c[y, features(t.as_py(), n)] += 1
        at = np.flatnonzero(c.any(axis=0))
        for i in range(0, len(at), 10_000):
            k = at[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(c[0, k]), pa.array(c[1, k])], ["f", "n0", "n1"])

    got = rows.mapInArrow(work, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # at most n rows
    out = np.zeros((2, n))
    out[0, got["f"]], out[1, got["f"]] = got["n0"], got["n1"]
    return out[0], out[1]


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, penalty: float = PENALTY, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared-norm hinge loss over rows of feature indices scaled by `ratio`; classes weigh the same."""
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())]) / max(1, len(y))
    upper = penalty * 0.5 / share[(y > 0).astype(int)]
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    norm = np.array([float((ratio[r] ** 2).sum()) + 1.0 for r in rows])
    order = np.random.default_rng(17)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            r = rows[i]
            g = sign[i] * (float(w[r] @ ratio[r]) + bias) - 1
            a = min(max(alpha[i] - g / norm[i], 0.0), upper[i])
            if a != alpha[i]:
                d = (a - alpha[i]) * sign[i]
                w[r] += d * ratio[r]
                bias += d
                moved = max(moved, abs(a - alpha[i]))
                alpha[i] = a
        if moved < 1e-4:
            break
    return w, bias


def fit_logit(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from margins to labels (Newton steps, targets kept off 0 and 1)."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return (max(a, 1e-3), b)


class Model:
    def __init__(self, weight: np.ndarray, bias: float, slope: float, shift: float):
        self.weight, self.bias, self.slope, self.shift = weight.astype(np.float32), bias, slope, shift

    def margin(self, f: np.ndarray) -> float:
        return float(self.weight[f].sum(dtype=np.float64)) + self.bias

    def score(self, text: str | None) -> float:
        f = features(text, len(self.weight))
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(f) + self.shift, -30, 30))))


def train(docs: DataFrame, y: DataFrame, n: int = FEATURES, most: int = SAMPLE) -> Model:
    """Learn from (doc_id, text) and (doc_id, y). Without rows of both classes every score is the share of label 1, or 0.5."""
    n0, n1 = count(labelled.with_labels(docs, y), n)
    p, q = (n1 + 1) / (n1 + 1).sum(), (n0 + 1) / (n0 + 1).sum()
    ratio = np.log(p / q)

    def work(batches):
        for b in batches:
            f = [features(t.as_py(), n).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), b.column(1)], ["f", "y"])

    chosen = labelled.sample(y, most)
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).select("text", "y").limit(most).mapInArrow(work, "f binary, y int").collect()  # at most `most` rows
    rows, t = [np.frombuffer(r["f"], np.int32) for r in got], np.array([r["y"] for r in got], int)
    if len(set(t.tolist())) < 2:
        mean = float(t.mean()) if len(t) else 0.5
        return Model(np.zeros(n), 0.0, 1.0, float(np.log((mean + 1e-3) / (1 - mean + 1e-3))))
    part = np.arange(len(t)) % 4 == 0  # for the probabilities
    if len(set(t[part].tolist())) < 2 or len(set(t[~part].tolist())) < 2:
        part[:] = True
        fit = part
    else:
        fit = ~part
    w, bias = fit_hinge([r for r, k in zip(rows, fit) if k], t[fit], ratio)
    seen = w != 0
    w = np.where(seen, (1 - BETA) * np.abs(w[seen]).mean() * np.sign(w) + BETA * w, 0) if seen.any() else w
    model = Model(w * ratio, bias, 1.0, 0.0)
    m = np.array([model.margin(r) for r, k in zip(rows, part) if k])
    model.slope, model.shift = fit_logit(m, t[part])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text; null counts as empty, repeated rows are scored each."""

    def work(batches):
        for b in batches:
            s = np.array([model.score(t.as_py()) for t in b.column(1)], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. Rows without an id count as the id of empty text; other columns are not read."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    y = labelled.training_labels(labels, "quality", 5, lambda r: r == 0)
    out = score(docs, train(docs, y))
    return out.select("doc_id", (labelled.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
