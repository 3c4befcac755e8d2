"""What finds repeated windows without moving every window: anchors.

A window of n units (words or bytes) holds n - k + 1 grams of k units; the smallest hash among them is its
anchor. Equal windows have equal anchors, so windows can repeat only under an anchor that repeats, and all
candidates for a repeat of a window lie under its anchor. Neighbouring windows mostly share an anchor, so a
document has few of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, mix64, sliding_min

#: An odd multiplier for polynomial hashes.
_B = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Scrambled polynomial hashes of every k consecutive units (uint64), by doubling."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, acc, span = np.zeros(0, np.uint64), 0, units, 1
    while True:
        if k & span:  # append a stretch of `span` units to what is there
            part = acc[have : have + n]
            out = part.copy() if not have else out * np.uint64(pow(_B, span, 1 << 64)) + part
            have += span
        if span * 2 > k:
            return mix64(out)
        acc = acc[:-span] * np.uint64(pow(_B, span, 1 << 64)) + acc[span:]
        span *= 2


def window_anchors(units: np.ndarray, window: int, k: int) -> np.ndarray:
    """The anchor of every window, as int64."""
    if len(units) < window:
        return np.zeros(0, np.int64)
    return sliding_min(gram_hashes(units, k), window - k + 1).view(np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]])


def true_spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    d = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def covered(n: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which of n units lie in a window that starts in one of the stretches (start, number of starts)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + counts + window - 1, n), -1)
    return np.cumsum(d[:n]) > 0


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, did, key, text): did puts a null id last; rows that agree in did and key agree in all that matters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("key"), text.alias("text"))
