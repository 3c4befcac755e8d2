"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is counted over all labelled training rows: words whose share of toxic documents is far above
their share of the others. The features of a text are densities of lexicon words (plain, and once disguised
signs are read as letters), how near they stand to a second person, capitals, punctuation and disguise rates.
Trees are fitted on a bounded sample of the labelled training rows (SAMPLE); a part of it that they have not
seen calibrates their sums.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import labelled
from .common import documents, unused

#: Rows of the fitting sample at most; a lexicon word's least log ratio, z value (a word in 3 toxic and no other documents has 2.6 at a tenth of toxic ones) and toxic documents.
SAMPLE, LEAST_RATIO, LEAST_Z, LEAST_DOCS = 20_000, 2.0, 2.0, 3
THRESHOLD = 0.7
#: Words between a lexicon word and a second person that count as near.
NEAR = 5
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32

# Second persons of English, French, German and Spanish.
SECOND = frozenset(w.encode() for w in ("you", "your", "yours", "yourself", "u", "ur", "tu", "toi", "te", "vous", "votre", "ton", "ta", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "usted", "ustedes", "ti", "tus"))
# Signs that stand for letters.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_letters = bytes(range(97, 123)) + bytes(range(128, 256))
_plain = bytes(b if b in _letters else 32 for b in range(256))
_keep = bytearray(_plain)
for _a, _b in _LEET.items():
    _keep[ord(_a)] = ord(_b)
_read = bytes(_keep)
#: Signs put inside words to hide them.
_inside = b"*.-_+~^'`|"
_not_upper = bytes(b for b in range(256) if not 65 <= b <= 90)
_not_sign = bytes(b for b in range(256) if not (33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126))
_not_letter = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
_MIXED = re.compile(rb"[a-z][0-9@$!*_]+[a-z]")
_SHOUT = re.compile(rb"(?<![A-Za-z\x80-\xff])[A-Z]{3,}(?![A-Za-z\x80-\xff])")
NAMES = ("hits", "weight", "kinds", "strongest", "n_hits", "hidden", "hidden_kinds", "near", "near_share", "persons", "upper", "shouts", "signs", "marks", "mixed", "words")


def words_of(raw: bytes) -> list[bytes]:
    """Words of letters, ASCII capitals lowered."""
    return raw.lower().translate(_plain).split()


def features(text: str | None, lexicon: dict[bytes, float]) -> list[float]:
    """The dense features, in the order of NAMES; all 0 for null and blank texts."""
    raw = (text or "").encode()
    low = raw.lower()
    words = low.translate(_plain).split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    hits = [w for w in words if w in lexicon]
    read = [w for w in low.translate(_read, _inside).split() if w in lexicon]
    hidden = max(0, len(read) - len(hits))
    persons = near = 0
    if hits or hidden:
        at = np.array([i for i, w in enumerate(words) if w in lexicon])
        you = np.array([i for i, w in enumerate(words) if w in SECOND])
        persons = len(you)
        if len(at) and len(you):
            k = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
            near = int((gap <= NEAR).sum())
    letters = max(1, len(raw.translate(None, _not_letter)))
    weights = [lexicon[w] for w in hits]
    more = set(read) - set(hits)
    return [
        len(hits) / n, sum(weights) / n, float(len(set(hits))), max(weights, default=0.0), float(np.log1p(len(hits))), hidden / n, float(len(more)), float(near), near / max(1, len(hits)), persons / n,
        len(raw.translate(None, _not_upper)) / letters, len(_SHOUT.findall(raw)) / n, len(raw.translate(None, _not_sign)) / max(1, len(raw)), raw.count(b"!") / n, len(_MIXED.findall(low)) / n, float(np.log1p(n)),
    ]


def lexicon_of(rows: DataFrame) -> dict[bytes, float]:
    """Words and their log ratios, from the document counts of all rows (text, y)."""

    def work(batches):
        counts: tuple[dict, dict] = ({}, {})
        docs, size = [0, 0], 0

        def flush():
            keys = list(counts[0].keys() | counts[1].keys())
            for i in range(0, len(keys), 10_000):
                part = keys[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[0].get(k, 0) for k in part], pa.int64()), pa.array([counts[1].get(k, 0) for k in part], pa.int64())], ["w", "n0", "n1"])
            counts[0].clear()
            counts[1].clear()

        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist()):
                docs[y] += 1
                own, before = counts[y], len(counts[y])
                seen = set(words_of((t.as_py() or "").encode()))
                for w in seen:
                    own[w] = own.get(w, 0) + 1
                size += 100 * (len(own) - before) + sum(len(w) for w in seen if len(w) > 64)  # long words count by their length
                if size > 50_000_000:
                    yield from flush()
                    size = 0
        yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([docs[0]], pa.int64()), pa.array([docs[1]], pa.int64())], ["w", "n0", "n1"])

    counts = rows.mapInArrow(work, "w binary, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n1") >= LEAST_DOCS)
    total = F.broadcast(counts.where("w = X''").select(F.col("n0").alias("all0"), F.col("n1").alias("all1")))  # one row
    ratio = F.log((F.col("n1") + 0.5) / (F.col("all1") + 1)) - F.log((F.col("n0") + 0.5) / (F.col("all0") + 1))
    scored = counts.where("w != X''").crossJoin(total).withColumn("ratio", ratio)
    scored = scored.withColumn("z", F.col("ratio") / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5)))
    best = scored.where((F.col("ratio") >= LEAST_RATIO) & (F.col("z") >= LEAST_Z))
    return {bytes(r["w"]): float(r["ratio"]) for r in best.select("w", "ratio").collect()}


class Trees:
    """Boosted trees for the logistic loss, on features cut into bins at their quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        # rare features: also the smallest value above the least one
        self.cuts = [np.unique(np.concatenate([c, [v.min() + (v[v > v.min()].min() - v.min()) / 2]])) if (v > v.min()).any() else c for c, v in zip(self.cuts, x.T)]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        b = self.binned(x)
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(b, q - y, q * (1 - q) + 1e-6)
            self.trees.append(tree)
            f += RATE * self._one(tree, b)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> list:
        """Splits by node number (children of k: 2k+1 and 2k+2), each (feature, bin) or a leaf's value."""
        tree: dict = {}
        node = np.zeros(len(g), np.int64)
        for level in range(DEPTH + 1):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, None)
                if level < DEPTH:
                    for j, c in enumerate(self.cuts):
                        if not len(c):
                            continue
                        gl = np.cumsum(np.bincount(b[rows, j], g[rows], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b[rows, j], h[rows], len(c) + 1))[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(hl < 0.5) | (hs - hl < 0.5)] = 0
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (gain[i], (j, i))
                if best[1] is None:
                    tree[k] = -gs / (hs + 1)
                else:
                    tree[k] = best[1]
                    node[rows] = 2 * k + 1 + (b[rows, best[1][0]] > best[1][1])
        return [tree.get(k) for k in range(2 ** (DEPTH + 1) - 1)]

    @staticmethod
    def _one(tree: list, b: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(b)), [(0, np.arange(len(b)))]
        while todo:
            k, rows = todo.pop()
            if isinstance(tree[k], tuple):
                right = b[rows, tree[k][0]] > tree[k][1]
                todo += [(2 * k + 1, rows[~right]), (2 * k + 2, rows[right])]
            elif tree[k] is not None:
                out[rows] = tree[k]
        return out

    def sums(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.base + RATE * sum((self._one(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing fit of y over m as knots for interpolation."""
    order = np.argsort(m, kind="stable")
    xs, first, inverse = np.unique(m[order], return_index=True, return_inverse=True)
    value, weight, left, right = [], [], [], []
    sums, sizes = np.bincount(inverse, y[order]), np.bincount(inverse)
    for x, s, n in zip(xs, sums / sizes, sizes):
        value.append(s), weight.append(n), left.append(x), right.append(x)
        while len(value) > 1 and value[-2] >= value[-1]:
            v, w, _, r = value.pop(), weight.pop(), left.pop(), right.pop()
            value[-1] = (value[-1] * weight[-1] + v * w) / (weight[-1] + w)
            weight[-1] += w
            right[-1] = r
    knots = [(x, v) for v, a, b in zip(value, left, right) for x in ((a,) if a == b else (a, b))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class Model:
    def __init__(self, lexicon: dict[bytes, float], trees: Trees | None, knots: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def score(self, texts: list) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), float(self.knots[1][0]))
        return np.clip(np.interp(self.trees.sums(np.array([features(t, self.lexicon) for t in texts], float)), *self.knots), 0, 1)


def train(docs: DataFrame, y: DataFrame, most: int = SAMPLE) -> Model:
    """Learn from (doc_id, text) and (doc_id, y). Without rows of both classes every score is the share of label 1, or 0."""
    lexicon = lexicon_of(labelled.with_labels(docs, y))

    def work(batches):
        for b in batches:
            f = [features(t.as_py(), lexicon) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), b.column(1)], ["f", "y"])

    chosen = labelled.sample(y, most)
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).select("text", "y").limit(most).mapInArrow(work, "f array<double>, y int").collect()  # at most `most` rows
    x, t = np.array([r["f"] for r in got], float), np.array([r["y"] for r in got], float)
    if len(set(t.tolist())) < 2:
        return Model(lexicon, None, (np.zeros(1), np.array([t.mean() if len(t) else 0.0])))
    part = np.arange(len(t)) % 4 == 0  # for the calibration
    if len(set(t[part].tolist())) < 2 or len(set(t[~part].tolist())) < 2:
        part, fit = np.ones(len(t), bool), np.ones(len(t), bool)
    else:
        fit = ~part
    trees = Trees(x[fit], t[fit])
    return Model(lexicon, trees, isotonic(trees.sums(x[part]), t[part]))


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """The input's columns and the score, in a column `name` that the input must not have.

    Texts are in column `text`; null and blank ones have a score too, very long ones are read whole, repeated
    rows are scored each, other columns, whatever their names, are only handed on; an empty table gives an empty result.
    """
    at = docs.columns.index("text")

    def work(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(part.column(at).to_pylist()), pa.float64())], [*part.schema.names, name])

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    name = unused("toxicity", docs.columns)
    return score(docs, model, name).where(F.col(name) < threshold).select(docs.columns)


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    y = labelled.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", 3, lambda r: r == 1)
    return train(docs, y)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. Rows without an id count as the id of empty text; other columns are not read."""
    docs = documents(spark, sf_dir)
    model = learned(spark, docs, sf_dir)
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).withColumnRenamed("toxicity", "score")
    return out.select("doc_id", (labelled.remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
