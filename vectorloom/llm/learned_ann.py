"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors (SAMPLE) makes a neighbour graph, which is cut into parts of nearly equal size
that keep neighbours together. A small network learns to tell a vector's part. It deals every vector to its
likeliest part and a query to several of the likeliest, whose vectors are reranked by exact cosine. Parts of
more than SPLIT vectors are cut anew in the same way, each by a sample of its own on the executors, so the number
of parts grows with the table; a vector's probability of such a part is the product of the two networks'.

How many parts a query visits is read off a bounded set of trial queries (TRIALS) that no network was fitted on,
and whose exact neighbours among all vectors are known: the fewest that hold TARGET of them.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Vectors that the parts of a level are learned from, about; trial queries; the share of true neighbours to be found, with a margin over 0.9.
SAMPLE, TRIALS, TARGET = 8_192, 256, 0.97
#: Parts that one network tells apart at most, and vectors in a part that is cut anew.
FANOUT, SPLIT = 64, 40_000
#: Neighbours in the graph, hidden units of the network; vectors and queries that meet in a task.
NEIGHBOURS, HIDDEN, BLOCK, QUERY_BLOCK = 10, 128, 20_000, 20_000
#: One distinct vector in so many can be a trial query, and is not in any sample.
HELD_OUT = 16


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of each unit vector's k nearest others."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(x) - 1 else np.argsort(-s, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 15, slack: float = 0.1) -> np.ndarray:
    """Parts of nearly equal size with few graph edges between them: halving along main directions, then moves towards neighbours."""
    part = np.zeros(len(x), np.int64)
    todo, n_parts = [(np.arange(len(x)), parts)], 0
    while todo:
        rows, k = todo.pop()
        if k == 1 or len(rows) < 2:
            part[rows] = n_parts
            n_parts += 1
            continue
        c = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.eigh(c.T @ c)[1][:, -1]
        order = rows[np.argsort(c @ axis, kind="stable")]
        cut = len(rows) * (k // 2) // k
        todo += [(order[:cut], k // 2), (order[cut:], k - k // 2)]
    most = int(np.ceil(len(x) / parts * (1 + slack)))
    least = int(len(x) / parts * (1 - slack))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            a, b = part[i], best[i]
            if sizes[b] < most and sizes[a] > least:
                part[i], moved = b, moved + 1
                sizes[a] -= 1
                sizes[b] += 1
        if moved < len(x) / 200:
            break
    return part


class Router:
    """A network of one hidden layer that tells the parts' probabilities."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, rounds: int = 30):
        rng = np.random.default_rng(4)
        d, k = x.shape[1], target.shape[1]
        self.w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, k)), np.zeros(k)]
        m, v, t = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        scale = d**0.5
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                b, y = x[order[i : i + 256]] * scale, target[order[i : i + 256]]
                h = np.maximum(b @ self.w[0] + self.w[1], 0)
                p = self._soft(h @ self.w[2] + self.w[3])
                g = (p - y) / len(b)
                gh = (g @ self.w[2].T) * (h > 0)
                t += 1
                for j, q in enumerate((b.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                    m[j] = 0.9 * m[j] + 0.1 * q
                    v[j] = 0.999 * v[j] + 0.001 * q * q
                    self.w[j] = self.w[j] - 3e-3 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of the parts for each unit vector."""
        z = np.maximum((x * x.shape[1] ** 0.5) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def n_parts(n: int) -> int:
    """Parts that a set of n vectors is cut into: half the root of n, FANOUT at most."""
    return int(min(FANOUT, max(1, round(n**0.5 / 2))))


def learn(x: np.ndarray, parts: int) -> Router:
    """Cut a sample of unit vectors into parts and fit a network that tells them."""
    graph = neighbour_graph(x, NEIGHBOURS)
    one_hot = np.eye(parts)[balanced_parts(x, graph, parts)]
    return Router(x, 0.5 * one_hot + 0.5 * one_hot[graph].mean(axis=1))


@dataclass
class Partitions:
    """What was learned: a network at the root (none: one part), one for each part that was cut anew, and the number of parts to visit."""

    root: Router | None
    below: dict
    visits: int = 1

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all parts, and each unit vector's log probabilities of them."""
        if self.root is None:
            return np.zeros(1, np.int64), np.zeros((len(x), 1))
        top = self.root.log_odds(x)
        names, odds = [], []
        for p in range(top.shape[1]):
            z = top[:, p : p + 1] + self.below[p].log_odds(x) if p in self.below else top[:, p : p + 1]
            names.append(p * FANOUT + np.arange(z.shape[1])), odds.append(z)
        return np.concatenate(names), np.concatenate(odds, axis=1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each unit vector, likeliest first."""
        names, odds = self.leaves(x)
        return names[np.argsort(-odds, axis=1, kind="stable")]

    @property
    def parts(self) -> int:
        return len(self.leaves(np.zeros((0, len(self.root.w[0]))))[0]) if self.root else 1


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that very long and very short vectors neither overflow nor vanish; this changes no cosine, not in the last bit."""
    most = np.abs(x).max(axis=1, keepdims=True)
    return np.ldexp(x, -np.frexp(most)[1])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths."""
    x = scaled(x) if len(x) else x
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows in pairs, in double precision; equal inputs give equal results wherever they stand."""
    if not len(a):
        return np.zeros(0)
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec) of rows with an id and a finite vector that is not zero, each once."""
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0)).dropDuplicates(["vec_id", "vec"])


def _best(q: np.ndarray, v: np.ndarray, k: int):
    """For each row of q the rows of v that may be among its k nearest, ties and rounding included, with exact cosines."""
    uq, uv = unit(q), unit(v)
    for i in range(0, len(q), 256):
        s = uq[i : i + 256] @ uv.T
        edge = np.partition(s, s.shape[1] - k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        r, c = np.nonzero(s >= edge[:, None] - 1e-9)
        yield r + i, c, cosine(q[r + i], v[c])


def _trained(sample: DataFrame, sizes: dict[int, int]) -> dict[int, Router]:
    """A network for each part of `sample` (part, vec), fitted on the executors. At most FANOUT of them, of some 100 KB each, come to the driver."""

    def work(key, table):
        x = unit(_matrix(table["vec"]))
        parts = min(n_parts(sizes[key[0].as_py()]), len(x))
        made = pickle.dumps(learn(x, parts)) if parts > 1 else b""
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([made], pa.binary())})

    return {r["part"]: pickle.loads(r["model"]) for r in sample.groupBy("part").applyInArrow(work, "part int, model binary").collect() if len(r["model"])}


def partitions(distinct: DataFrame, k: int, sample: int = SAMPLE, target: float = TARGET, split: int = SPLIT) -> tuple[Partitions, DataFrame]:
    """Learn from distinct vectors (vec, ids, rep); the parts, and the vectors with their `part`, written."""
    pick = F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(1 << 30))

    def some(df, rate):  # one of HELD_OUT is kept for the trials
        return df.where(F.pmod(F.xxhash64("vec"), F.lit(HELD_OUT)) != 0).where(pick < (rate * (1 << 30)).cast("long")).select("part", "vec")

    n = distinct.count()
    routers = _trained(some(distinct.withColumn("part", F.lit(0)), F.lit(min(1.0, sample / max(1, n)))), {0: n})
    made = Partitions(routers.get(0), {})

    def deal(made):
        def work(batches):
            for b in batches:
                m = _matrix(b.column(0))
                p = made.order(unit(m))[:, 0] if len(m) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), *b.columns], ["part", *b.schema.names])

        return materialise(distinct.select("vec", "ids", "rep").mapInArrow(work, "part int, vec array<double>, ids array<long>, rep long"), "ann-index")

    index = deal(made)
    large = {r["part"] // FANOUT: r["count"] for r in index.groupBy("part").count().collect() if r["count"] > split}
    if large and made.root is not None:
        rate = F.element_at(F.create_map(*[F.lit(x) for p, c in large.items() for x in (p, min(1.0, sample / c))]), F.col("part"))
        inner = index.withColumn("part", F.floor(F.col("part") / FANOUT).cast("int")).where(F.col("part").isin(list(large)))
        made = Partitions(made.root, _trained(some(inner, rate), large))
        index = deal(made)
    if made.root is None:
        return made, index
    held = distinct.where(F.pmod(F.xxhash64("vec"), F.lit(HELD_OUT)) == 0).orderBy(pick, "rep").limit(TRIALS).select("vec").toArrow()  # at most TRIALS vectors
    if not held.num_rows:
        return Partitions(made.root, made.below, made.parts), index
    trial = _matrix(held["vec"])

    def trials(batches):
        for b in batches:
            v = _matrix(b.column("vec"))
            if not len(v):
                continue
            p = b.column("part").to_numpy()
            for r, c, s in _best(trial, v, k + 1):
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(p[c]), pa.array(s)], ["q", "part", "s"])

    near = index.select("part", "vec").mapInArrow(trials, "q long, part int, s double")
    top = F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "part"))
    # the first is the trial vector itself
    truth = near.withColumn("r", top).where((F.col("r") > 1) & (F.col("r") <= k + 1)).select("q", "part").collect()  # at most k for each trial
    order = made.order(unit(trial))
    at = np.sort([int(np.flatnonzero(order[r["q"]] == r["part"])[0]) for r in truth]) if truth else np.array([order.shape[1] - 1])
    return Partitions(made.root, made.below, int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)]) + 1), index


def prepared(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec, ids, rep) of the distinct usable vectors of the most frequent length, and that length (0: there is none). Of equal vectors' ids the k + 1 smallest are all that can be in a result."""
    good = usable(vectors, id_col, vector_col)
    lengths = good.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = lengths[0]["d"] if lengths else 0
    place = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    distinct = good.where(F.size("vec") == dim).withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return materialise(distinct.withColumn("rep", F.col("ids")[0]), "ann-distinct"), dim


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, target: float = TARGET, split: int = SPLIT) -> DataFrame:
    """The k nearest of `vectors` for each row of `queries` (the same columns; its own id is no candidate): query_id, rank, vec_id, score.

    Nearest first, ties to the smaller id; score is the cosine of the original vectors in double precision. A
    query with fewer candidates gives fewer rows. Rows that are null, zero or hold a null or a non-finite
    component, rows without an id, and vectors whose length is not that of the most take no part. Rows that
    agree in id and vector count once. Other columns are not read. Without vectors or queries the result is empty.
    """
    spark = vectors.sparkSession
    distinct, dim = prepared(vectors, k, id_col, vector_col)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = usable(queries, id_col, vector_col).where(F.size("vec") == dim)
    made, index = partitions(distinct, k, sample, target, split)

    def route(batches):
        for b in batches:
            m = _matrix(b.column(0))
            if len(m):
                order = made.order(unit(m))[:, : made.visits]
                at = pa.array(np.repeat(np.arange(len(m)), order.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype(np.int32)), b.column(0).take(at), b.column(1).take(at)], ["part", "vec", "q"])

    # queries with equal vectors are searched once
    searched = materialise(asked.groupBy("vec").agg(F.min("vec_id").alias("q")), "ann-queries")
    routed = materialise(searched.mapInArrow(route, "part int, vec array<double>, q long"), "ann-routed")
    # large parts and large sets of queries are met block by block; one number for each part
    blocks, turns = (F.create_map(*[F.lit(x) for r in df.groupBy("part").count().collect() for x in (r["part"], -(-r["count"] // most))], F.lit(-1), F.lit(1)) for df, most in ((index, BLOCK), (routed, QUERY_BLOCK)))
    times = lambda m: F.coalesce(F.try_element_at(m, F.col("part")), F.lit(1))
    spot = lambda col, m: F.pmod(F.xxhash64(col), times(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), (times(m) - 1).cast("int")))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q, ids, qs = _matrix(right["vec"]), left["ids"].combine_chunks(), right["q"].to_numpy()
        v, out = _matrix(left["vec"]), []
        for r, c, s in _best(q, v, k + 1):
            out.append(pa.Table.from_arrays([pa.array(qs[r]), pa.array(s), ids.take(pa.array(c))], schema=schema))
        return pa.concat_tables(out)

    left = index.select("part", "vec", "ids", spot("rep", blocks).alias("block"), every(turns).alias("turn"))
    right = routed.select("part", "vec", "q", every(blocks).alias("block"), spot("q", turns).alias("turn"))
    found = left.groupBy("part", "block", "turn").cogroup(right.groupBy("part", "block", "turn")).applyInArrow(compare, "q long, score double, ids array<long>")
    flat = found.select("q", "score", F.explode("ids").alias("vec_id"))
    best = flat.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    # back to every query of that vector
    who = asked.join(searched.select(F.col("vec").alias("v"), "q"), F.col("vec") == F.col("v")).select(F.col("vec_id").alias("query_id"), "q")
    out = who.join(best.select("q", "score", "vec_id"), "q").where("vec_id != query_id")
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_learned_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
