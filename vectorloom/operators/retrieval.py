"""Scoring and exact top-k: queries against all documents, in blocks.

Scores of all pairs are never rows. A block of queries is scored against a block of documents with one matrix
product, and a kernel gives what is wanted of it: the block's own k best, counts, or a histogram. Queries of at
most `CHUNK_BYTES` are broadcast and documents stay where they are; beyond, blocks of both are shuffled to each
other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vector as V

#: Bytes of query vectors that are broadcast at most, and in a block beyond that; documents in a block.
CHUNK_BYTES, DOC_BLOCK = 64 << 20, 100_000
#: Documents that a kernel gets at a time: at most so many, and at most so many bytes of their vectors. What a kernel
#: gives grows with the number of such runs, not with that of Arrow's batches.
RUN, RUN_BYTES = 65_535, 32 << 20
#: Queries that are scored at a time, and the documents of a run that they are scored against at a time.
STEP, TILE = 512, 4_096
DIGITS = 6


def vectors(df: DataFrame, id_col: str, vector_col: str, as_id: str) -> DataFrame:
    """(id, unit vector in double precision)."""
    return df.select(F.col(id_col).alias(as_id), V.l2_normalise(V.as_double(F.col(vector_col))).alias("v"))


def rank(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Ranks by score, ties to the smaller doc_id; the k first, or all."""
    out = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return out.where(F.col("rank") <= k) if k else out


def blocks(queries: DataFrame, docs: DataFrame, kernel: Callable, schema: str, chunk_bytes: int = CHUNK_BYTES, doc_block: int = DOC_BLOCK, more: tuple[str, ...] = (), row_bytes: int = 0) -> DataFrame:
    """What `kernel` gives for blocks of queries (query_id, v, and more columns) and documents (doc_id, v, and `more`), in `schema`.

    kernel(table of queries, document ids, document vectors, more columns) yields Arrow batches; every query meets
    every document once. A kernel that is a class has an object for each task, which may gather until its rest() is
    called. row_bytes is what a query holds besides its vectors. Null vectors are left out.
    """
    spark = docs.sparkSession
    queries, docs = queries.where("v is not null"), docs.select("doc_id", "v", *more).where("v is not null")
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    chunks = -(-(size["n"] * ((size["d"] or 1) * 8 * sum("array" in t for _, t in queries.dtypes) + row_bytes)) // chunk_bytes)
    if not chunks:
        return spark.createDataFrame([], schema)

    def scored(own, parts):
        k = kernel() if isinstance(kernel, type) else kernel
        for b in runs(parts):
            d = matrix(b["v"])
            for i in range(0, own.num_rows, STEP):
                yield from k(own.slice(i, STEP), b["doc_id"].to_numpy(), d, *[b[c] for c in more])
        if isinstance(kernel, type):
            yield from k.rest()

    if chunks == 1:
        sent = spark.sparkContext.broadcast(queries.toArrow().combine_chunks())
        return docs.mapInArrow(lambda batches: scored(sent.value, batches), schema)
    n_docs = max(1, -(-docs.count() // doc_block))
    spot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("*", spot("query_id", chunks).alias("__q")).select("*", every(n_docs).alias("__d"))
    right = docs.select("*", spot("doc_id", n_docs).alias("__d")).select("*", every(chunks).alias("__q"))
    names = queries.columns

    def meet(a, b):
        out = list(scored(a.select(names).combine_chunks(), b.to_batches())) if a.num_rows and b.num_rows else []
        return pa.Table.from_batches(out) if out else empty

    empty = spark.createDataFrame([], schema).toArrow()
    return left.groupBy("__q", "__d").cogroup(right.groupBy("__q", "__d")).applyInArrow(meet, schema)


def runs(batches) -> Iterator[pa.Table]:
    """Batches of documents, put together to tables of at most RUN rows and about RUN_BYTES."""
    held, n = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            most = max(1, min(RUN, RUN_BYTES // (8 * max(1, len(b["v"][at])))))
            if n >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
            part = b.slice(at, most - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def scores_of(own: pa.Table, doc: np.ndarray, d: np.ndarray, column: str = "v", mask_self: bool = True, masked: float = -np.inf) -> np.ndarray:
    """Scores of a block, rounded; with mask_self a query's own id has `masked`."""
    s = np.round(matrix(own[column]) @ d.T, DIGITS)
    if mask_self:
        s[own["query_id"].to_numpy()[:, None] == doc[None, :]] = masked
    return s


def topk(queries: DataFrame, docs: DataFrame, k: int, mask_self: bool = True, chunk_bytes: int = CHUNK_BYTES, doc_block: int = DOC_BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query.

    Scores are dot products rounded to six digits before they are ranked; with mask_self a query's own id is no
    candidate.
    """

    def best(own, doc, d):
        q, ids, place = matrix(own["v"]), own["query_id"].to_numpy(), np.argsort(np.argsort(doc, kind="stable"))
        # single precision tells who may be among the best, as far as it errs at most; those are scored in double precision
        q32, d32 = q.astype(np.float32), d.astype(np.float32)
        room = 10.0**-DIGITS + (q.shape[1] + 8) * 2.0**-23 * _longest(q) * _longest(d)
        edge, held = np.full(len(q), -np.inf), []
        for at in range(0, len(d), TILE):
            s = q32 @ d32[at : at + TILE].T
            if at == 0 and s.shape[1] > k + 1:
                # k of the first tile reach this, even without the query itself
                edge = np.partition(np.fmax(s, -np.inf), -k - 1, axis=1)[:, -k - 1].astype(float) - room
            hit = np.flatnonzero(s >= (edge - room).astype(np.float32)[:, None])
            r, x = hit // s.shape[1], hit % s.shape[1] + at
            if mask_self:
                other = ids[r] != doc[x]
                r, x = r[other], x[other]
            s = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", q[r[i : i + STEP * 16]], d[x[i : i + STEP * 16]]) for i in range(0, len(r), STEP * 16))])
            held.append((r, x, np.round(s, DIGITS)))
            if at + TILE >= len(d) or sum(len(h[0]) for h in held) > 4 * k * len(q):
                held = [_first(*map(np.concatenate, zip(*held)), place, k, edge)]
        r, x, s = held[0]
        yield pa.RecordBatch.from_arrays([own["query_id"].combine_chunks().take(pa.array(r)), pa.array(doc[x]), pa.array(s)], ["query_id", "doc_id", "score"])

    schema = f"query_id {_kind(queries, 'query_id')}, doc_id {_kind(docs, 'doc_id')}, score double"
    return rank(blocks(queries.select("query_id", "v"), docs, best, schema, chunk_bytes, doc_block), k)


def _longest(m: np.ndarray) -> float:
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    return float(n[np.isfinite(n)].max(initial=0.0))


def _first(r: np.ndarray, x: np.ndarray, s: np.ndarray, place: np.ndarray, k: int, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, then smaller place) of each query r; `edge` is raised to the k-th best where there are k."""
    if len(s) and np.abs(s).max() < 30_000 and max(len(edge), 1) <= 1 << 10 and len(place) <= 1 << 17:  # all of them in one number
        o = np.argsort(r << 53 | (3 * 10**10 - np.rint(s * 10**DIGITS).astype(np.int64)) << 17 | place[x])
    else:
        o = np.lexsort((place[x], -s, r))
    r, x, s = r[o], x[o], s[o]
    start = np.searchsorted(r, np.arange(len(edge) + 1))
    full = np.flatnonzero(np.diff(start) >= k)
    edge[full] = np.maximum(edge[full], s[start[full] + k - 1])
    keep = np.arange(len(r)) - start[r] < k
    return r[keep], x[keep], s[keep]


def pair_scores(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of given pairs alone."""
    j = pairs.select("query_id", "doc_id").join(queries.select("query_id", F.col("v").alias("qv")), "query_id").join(docs.select("doc_id", F.col("v").alias("dv")), "doc_id")
    return j.select("query_id", "doc_id", F.round(V.dot(F.col("qv"), F.col("dv")), DIGITS).alias("score"))


#: Scores are whole millionths between -1 and 1, so a histogram has at most so many rows.
CODES = 2 * 10**DIGITS + 1


def histogram(queries: DataFrame, docs: DataFrame, mask_self: bool = True) -> DataFrame:
    """(code, n): how many pairs have a score of code millionths; at most CODES rows for unit vectors, whatever the number of pairs."""

    class Count:
        """Adds up what a task sees; a task gives a row for each code once, not for each block."""

        def __init__(self):
            self.n = np.zeros(CODES, np.int64)

        def __call__(self, own, doc, d):
            top = CODES // 2
            for at in range(0, len(d), TILE):
                s = scores_of(own, doc[at : at + TILE], d[at : at + TILE], mask_self=mask_self, masked=np.nan)
                code = np.rint(s[~np.isnan(s)] * 10**DIGITS).astype(np.int64)
                if len(far := code[np.abs(code) > top]):  # no unit vectors
                    yield self.batch(*np.unique(far, return_counts=True))
                    code = code[np.abs(code) <= top]
                self.n += np.bincount(code + top, minlength=CODES)

        def rest(self):
            code = np.flatnonzero(self.n)
            yield self.batch(code - CODES // 2, self.n[code])

        @staticmethod
        def batch(code, n):
            return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])

    return blocks(queries.select("query_id", "v"), docs, Count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def ranks_of(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank) of given pairs among all documents (score, then smaller id; a query's own id is no candidate), without ranking the others."""
    scored = pair_scores(pairs.where("query_id != doc_id"), queries, docs)
    code = F.round(F.col("score") * 10**DIGITS).cast("long")
    wanted = scored.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-code).alias("c"), F.col("doc_id").alias("i")))).alias("p"))  # the given ones of a query
    own = queries.select("query_id", "v").join(wanted, "query_id").select("query_id", "v", F.col("p.c").alias("c"), F.col("p.i").alias("i"))

    def count(own, doc, d):
        s = -np.rint(scores_of(own, doc, d, masked=-np.inf) * 10**DIGITS)
        for row, c, i in zip(s, own["c"].to_pylist(), own["i"].to_pylist()):
            c, i, ordered = np.array(c, float), np.array(i), np.sort(row)
            above = np.searchsorted(ordered, c, side="left")
            for j in np.flatnonzero(np.searchsorted(ordered, c, side="right") > above):
                above[j] += int((doc[row == c[j]] < i[j]).sum())  # equal scores go by id
            yield above

    def work(own, doc, d):
        above = list(count(own, doc, d))
        n = [len(x) for x in above]
        r = np.repeat(np.arange(len(n)), n)
        yield pa.RecordBatch.from_arrays([own["query_id"].combine_chunks().take(pa.array(r)), own["i"].combine_chunks().flatten(), pa.array(np.concatenate(above).astype(np.int64))], ["query_id", "doc_id", "above"])

    out = blocks(own, docs, work, f"query_id {_kind(queries, 'query_id')}, doc_id {_kind(docs, 'doc_id')}, above long")
    return out.groupBy("query_id", "doc_id").agg((F.sum("above") + 1).alias("rank"))


def _kind(df: DataFrame, col: str) -> str:
    return dict(df.dtypes)[col]


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def kth_score(ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, kth): the k-th best score."""
    return ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))


def pseudo_qrels(ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, grade): the k best documents of a trusted ranking count as relevant."""
    return ranked.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("grade"))


def search(query: DataFrame, docs: DataFrame, payload: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents with their payload, for ad-hoc queries; ids are not masked."""
    return topk(query, docs, k, mask_self=False).join(payload, "doc_id")
