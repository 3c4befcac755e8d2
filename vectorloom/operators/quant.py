"""Block quantisation of weights: 256 values in a super-block of 16 sub-blocks, with quantised scales and minima, in the byte layouts Q2_K and Q3_K.

Blocks are independent, so a batch of them is one numpy kernel. With 2 bits a weight is step * code - minimum, and a
super-block 84 bytes; with 3 bits it is step * code with a signed step, and a super-block 110 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SUPER, SUB = 256, 16
#: Shares of the range that are tried as the first step; sub-blocks that are not spread evenly need a tighter one.
CLIPS = (1.0, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 1.05)
LEAST = 1e-8


class _Best:
    """The fit with the least error of each sub-block, of those shown so far; the first of equals stays."""

    def __init__(self):
        self.err, self.kept = None, ()

    def show(self, err: np.ndarray, *fit: np.ndarray) -> None:
        if self.err is None:
            self.err, self.kept = err, fit
            return
        better = err < self.err
        self.err = np.where(better, err, self.err)
        self.kept = tuple(np.where(better, new, old) for new, old in zip(fit, self.kept))


def _half(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float16).astype(np.float64)


def fit2(x: np.ndarray, weight: np.ndarray | float = 1.0, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Steps and minima of sub-blocks (last axis) for codes 0 to 3, by rounding and least squares in turn from each clip; the least weighted error wins."""
    low, high, n, best = np.minimum(x.min(axis=-1), 0), np.maximum(x.max(axis=-1), 0), x.shape[-1], _Best()
    code = lambda step, off: np.clip(np.rint((x + off[..., None]) / step[..., None]), 0, 3)
    total = x.sum(axis=-1)
    for clip in CLIPS:
        step, off = np.maximum((high - low) / 3 * clip, LEAST), -low * clip
        for _ in range(rounds):
            q = code(step, off)
            sq, sqq, sqx = q.sum(axis=-1), (q * q).sum(axis=-1), (q * x).sum(axis=-1)
            det = n * sqq - sq * sq
            ok = det != 0
            slope = (n * sqx - sq * total) / np.where(ok, det, 1)
            step, off = np.where(ok & (slope > 0), slope, step), np.where(ok, np.maximum((slope * sq - total) / n, 0), off)
        e = x - (step[..., None] * code(step, off) - off[..., None])
        best.show((weight * e * e).sum(axis=-1), step, off)
    return best.kept


def fit3(x: np.ndarray, weight: np.ndarray | float = 1.0, rounds: int = 2) -> np.ndarray:
    """Signed steps of sub-blocks for codes -4 to 3: the weight of the largest size takes the code -4, or 3, at first."""
    peak, best = np.take_along_axis(x, np.abs(x).argmax(axis=-1)[..., None], -1)[..., 0], _Best()
    code = lambda step: np.clip(np.rint(x / step[..., None]), -4, 3)
    for base in (-peak / 4, peak / 3):
        for clip in CLIPS:
            step = np.where(np.abs(base * clip) < LEAST, LEAST, base * clip)
            for _ in range(rounds):
                q = code(step)
                sqq = (q * q).sum(axis=-1)
                new = (q * x).sum(axis=-1) / np.where(sqq == 0, 1, sqq)
                step = np.where((sqq > 0) & (np.abs(new) > LEAST), new, step)
            e = x - step[..., None] * code(step)
            best.show((weight * e * e).sum(axis=-1), step)
    return best.kept[0]


def quantise(x: np.ndarray, bits: int, column_weight: np.ndarray | None = None) -> dict:
    """Super-blocks (rows of 256 values) as codes, scales (and minima) of their sub-blocks, and common factors in half precision. column_weight: how much an error in each place counts when the clip is chosen."""
    g = x.reshape(-1, SUPER // SUB, SUB)
    weight = 1.0 if column_weight is None else np.maximum(column_weight, 1e-12).reshape(-1, SUPER // SUB, SUB)
    if bits == 2:
        step, off = fit2(g, weight)
        d, m = _half(step.max(axis=1) / 15), _half(off.max(axis=1) / 15)
        scales, minima = (np.clip(np.rint(v / np.where(f > 0, f, 1)[:, None]), 0, 15) for v, f in ((step, d), (off, m)))
        out = {"bits": 2, "d": d, "dmin": m, "scales": scales.astype(np.int64), "minima": minima.astype(np.int64)}
        s, o = scales * d[:, None], minima * m[:, None]
        q = np.clip(np.rint((g + o[..., None]) / np.where(s > 0, s, 1)[..., None]), 0, 3)
    elif bits == 3:
        step = fit3(g, weight)
        top = np.take_along_axis(step, np.abs(step).argmax(axis=1)[:, None], 1)[:, 0]
        d = _half(-top / 32)  # the largest scale becomes -32
        scales = np.clip(np.rint(step / np.where(d != 0, d, 1)[:, None]), -32, 31)
        out = {"bits": 3, "d": d, "scales": scales.astype(np.int64)}
        s = scales * d[:, None]
        q = np.clip(np.rint(g / np.where(s != 0, s, 1)[..., None]), -4, 3)
    else:
        raise ValueError("there are layouts for 2 and 3 bits")
    return out | {"codes": np.where((s != 0)[..., None], q, 0).astype(np.int64).reshape(-1, SUPER)}


def restore(p: dict) -> np.ndarray:
    """The weights that a reader of the bytes gets."""
    q = p["codes"].reshape(-1, SUPER // SUB, SUB) * (p["scales"] * p["d"][:, None])[..., None]
    return (q - (p["minima"] * p["dmin"][:, None])[..., None] if p["bits"] == 2 else q).reshape(-1, SUPER)


def _two_bits(codes: np.ndarray) -> np.ndarray:
    """64 bytes: of each half of a super-block, byte i holds the codes i, i + 32, i + 64 and i + 96, low bits first."""
    parts = codes.reshape(-1, 2, 4, 32) << np.array([0, 2, 4, 6])[:, None]
    return parts.sum(axis=2).astype(np.uint8).reshape(-1, 64)


def _from_two_bits(raw: np.ndarray) -> np.ndarray:
    return ((raw.reshape(-1, 2, 1, 32).astype(np.int64) >> np.array([0, 2, 4, 6])[:, None]) & 3).reshape(-1, SUPER)


def to_bytes(p: dict) -> np.ndarray:
    """Rows of 84 bytes (2 bits: scales and minima as nibbles, codes, d, dmin) or 110 (3 bits: high bits, low bits, 6-bit scales, d)."""
    factor = lambda x: x.astype("<f2")[:, None].view(np.uint8)
    if p["bits"] == 2:
        return np.concatenate([(p["scales"] | p["minima"] << 4).astype(np.uint8), _two_bits(p["codes"]), factor(p["d"]), factor(p["dmin"])], axis=1)
    # a code's high bit says that 4 is not taken off; byte i holds those of i, i + 32, ...
    high = ((p["codes"] >= 0).reshape(-1, 8, 32) << np.arange(8)[:, None]).sum(axis=1).astype(np.uint8)
    v = p["scales"] + 32
    low4 = (v[:, :8] & 15) | (v[:, 8:] & 15) << 4
    high2 = ((v >> 4).reshape(-1, 4, 4) << np.array([0, 2, 4, 6])[:, None]).sum(axis=1)
    return np.concatenate([high, _two_bits(p["codes"] & 3), low4.astype(np.uint8), high2.astype(np.uint8), factor(p["d"])], axis=1)


def from_bytes(raw: np.ndarray, bits: int) -> dict:
    raw = np.ascontiguousarray(raw)
    factor = lambda a: np.ascontiguousarray(raw[:, a : a + 2]).view("<f2")[:, 0].astype(np.float64)
    if bits == 2:
        return {"bits": 2, "scales": (raw[:, :16] & 15).astype(np.int64), "minima": (raw[:, :16] >> 4).astype(np.int64), "codes": _from_two_bits(raw[:, 16:80]), "d": factor(80), "dmin": factor(82)}
    high = ((raw[:, None, :32] >> np.arange(8, dtype=np.uint8)[:, None]) & 1).reshape(-1, SUPER).astype(np.int64)
    low4 = np.concatenate([raw[:, 96:104] & 15, raw[:, 96:104] >> 4], axis=1).astype(np.int64)
    high2 = ((raw[:, None, 104:108] >> np.array([0, 2, 4, 6], np.uint8)[:, None]) & 3).reshape(-1, 16).astype(np.int64)
    return {"bits": 3, "codes": _from_two_bits(raw[:, 32:96]) + 4 * high - 4, "scales": (low4 | high2 << 4) - 32, "d": factor(108)}


def bits_per_weight(bits: int) -> float:
    return {2: 84, 3: 110}[bits] * 8 / SUPER


def quantise_blocks(blocks: DataFrame, bits: int) -> DataFrame:
    """(block, packed, mse, largest error) of (block, w: 1 to 256 doubles); shorter ones are filled with zeros, which the errors leave out."""

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows = [np.array(r.as_py(), float) for r in b.column(1)]
            x = np.stack([np.pad(r, (0, SUPER - len(r))) for r in rows])
            raw = to_bytes(quantise(x, bits))
            e = restore(from_bytes(raw, bits)) - x
            own = [e[i, : len(r)] for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([float((r * r).mean()) for r in own], pa.float64()), pa.array([float(np.abs(r).max()) for r in own], pa.float64())], ["block", "packed", "mse", "max_err"])

    return blocks.select("block", "w").mapInArrow(work, "block long, packed binary, mse double, max_err double")


def half_round_trip(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, max_err): vectors after a half-precision file edge."""

    def work(batches):
        for b in batches:
            lists = b.column(1)
            out = [np.array(v.as_py(), np.float64) for v in lists]
            half = [x.astype(np.float16).astype(np.float64) for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.tolist() for h in half], pa.list_(pa.float64())), pa.array([float(np.abs(h - x).max(initial=0)) for h, x in zip(half, out)], pa.float64())], [id_col, "vector", "max_err"])

    kind = dict(vectors.dtypes)[id_col]
    return vectors.select(id_col, vector_col).mapInArrow(work, f"{id_col} {kind}, vector array<double>, max_err double")


def gram(pairs: DataFrame, left: str, right: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums of left^T left and left^T right over all rows: one small matrix for each task, added up on the driver."""

    def work(batches):
        a = b_ = None
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for i in (0, 1))
            a, b_ = (x.T @ x, x.T @ y) if a is None else (a + x.T @ x, b_ + x.T @ y)
        if a is not None:
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b_.tobytes()], pa.binary()), pa.array([a.shape[0]], pa.int64())], ["a", "b", "d"])

    rows = pairs.select(left, right).mapInArrow(work, "a binary, b binary, d long").collect()
    if not rows:
        raise ValueError("no rows to fit")
    d = rows[0]["d"]
    return sum(np.frombuffer(r["a"]).reshape(d, d) for r in rows), sum(np.frombuffer(r["b"]).reshape(d, -1) for r in rows)


def ridge(pairs: DataFrame, left: str, right: str, strength: float = 1e-3) -> np.ndarray:
    """The linear map W with left W close to right; the penalty is a share of the mean diagonal."""
    a, b = gram(pairs, left, right)
    return np.linalg.solve(a + strength * np.trace(a) / len(a) * np.eye(len(a)), b)


#: Penalties that are tried, as shares of the mean diagonal.
PENALTIES = (1e-3, 1e-2, 1e-1, 1.0, 10.0)


def ridge_grid(train: DataFrame, held: DataFrame, left: str, right: str, penalties: tuple[float, ...] = PENALTIES) -> tuple[np.ndarray, list[tuple[str, float | None, float]]]:
    """The linear map with the best mean cosine on held-out pairs, and (kind, penalty, cosine) of all tried, with the plain rotation as a control. Only matrices of the vectors' dimension come to the driver; the held-out pairs are scored where they are."""
    a, b = gram(train, left, right)
    eye, mean = np.eye(len(a)), np.trace(a) / len(a)
    u, _, v = np.linalg.svd(b, full_matrices=False)
    maps = [("ridge", p, np.linalg.solve(a + p * mean * eye, b)) for p in penalties] + [("rotation", None, u @ v)]

    def work(batches):
        total, n = np.zeros(len(maps)), 0
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i in (0, 1))
                n += len(x)
                for i, (_, _, w) in enumerate(maps):
                    z = x @ w
                    total[i] += ((z * y).sum(axis=1) / np.maximum(np.linalg.norm(z, axis=1) * np.linalg.norm(y, axis=1), 1e-8)).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["total", "n"])

    rows = held.select(left, right).mapInArrow(work, "total array<double>, n long").collect()  # one row for each task
    n = sum(r["n"] for r in rows)
    if not n:
        raise ValueError("no held-out pairs")
    cos = sum(np.array(r["total"]) for r in rows) / n
    best = int(cos[: len(penalties)].argmax())
    return maps[best][2], [(kind, p, float(c)) for (kind, p, _), c in zip(maps, cos)]


def procrustes(pairs: DataFrame, left: str, right: str) -> np.ndarray:
    """The orthogonal map closest to taking left to right."""
    u, _, v = np.linalg.svd(gram(pairs, left, right)[1])
    return u @ v
