"""Mixture-controlled packing by deficit round-robin.

The documents of a source, in ascending doc_id order, make a queue of token ids. The queues are cut into
chunks of about `CHUNK` windows, each of them with the same share of every queue (what a cut rounds off is
the deficit that the next chunk starts with). In a chunk every window is filled by deficit round-robin: each
queue earns its share of the window, gives the whole tokens that it has earned, and carries the rest to the
next window. Which tokens a window holds follows from the queues' lengths alone, so any batch of documents can
be cut into its pieces by itself. What a chunk has left after its full windows goes into sequences whose lengths are
powers of two, so that no sequence needs padding.

Without targets the queues have their natural shares of every window. With targets they are dealt in phases:
the shares of a phase are those of the targets among the queues that are not dry, until the next one is dry.
"""

from __future__ import annotations

import zlib
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BATCH_ROWS, documents, materialise
from .tokens import encoder, in_chunks

#: Tokens in a full sequence; windows in a chunk, about; bytes of text in a part of neighbouring documents, at least, about.
WINDOW, CHUNK, PART_BYTES = 2048, 1024, 8_000_000


def _deal(size: int, earned: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Tokens that each queue gives to a sequence of `size`: what it has earned, to whole tokens, none above what is left."""
    take = np.clip(np.floor(earned), 0, left).astype(np.int64)
    short = size - int(take.sum())
    rest = earned - take
    while short:
        if short > 0:
            room = np.flatnonzero(take < left)
            best = room[np.argsort(-rest[room], kind="stable")][:short]
            take[best] += 1
            rest[best] -= 1
            short -= len(best)
        else:
            room = np.flatnonzero(take > 0)
            worst = room[np.argsort(rest[room], kind="stable")][:-short]
            take[worst] -= 1
            rest[worst] += 1
            short += len(worst)
    return take


def phases(lengths: tuple[int, ...], weights: list) -> list[tuple[int, ...]]:
    """Tokens that each queue gives in each phase; queues without a weight come after all others, by their lengths."""
    left, w, out = list(lengths), [Fraction(x or 0) for x in weights], []
    while any(left):
        live = [i for i, n in enumerate(left) if n and w[i] > 0]
        if not live:
            out.append(tuple(left))
            break
        end = min(left[i] / w[i] for i in live)  # exact: weights are fractions
        # what would leave less than a token is dry too
        give = [0 if i not in live else n if n - end * w[i] < 1 else int(end * w[i]) for i, n in enumerate(left)]
        out.append(tuple(give))
        left = [n - g for n, g in zip(left, give)]
    return out


@lru_cache(maxsize=16)
def chunk_plan(c: int, n_chunks: int, lengths: tuple[int, ...], window: int) -> tuple[np.ndarray, np.ndarray]:
    """For chunk c: tokens of each queue before each of its sequences (one row more than sequences), and where each queue's tokens start in it."""
    t = np.array(lengths, object)
    low = np.array([int(x) * c // n_chunks for x in t], np.int64)
    size = np.array([int(x) * (c + 1) // n_chunks for x in t], np.int64) - low
    carried = np.array([int(x) * c % n_chunks for x in t], float) / n_chunks
    n = int(size.sum())
    full, tail = divmod(n, window)
    kinds = [window] * full + [1 << b for b in range(window.bit_length() - 1, -1, -1) if tail >> b & 1]
    share = size / n if n else np.zeros(len(size))
    takes, left, earned = np.zeros((len(kinds), len(size)), np.int64), size.copy(), carried
    for j, k in enumerate(kinds):
        earned = earned + k * share
        takes[j] = _deal(k, earned, left)
        earned = earned - takes[j]
        left -= takes[j]
    before = np.concatenate([np.zeros((1, len(size)), np.int64), np.cumsum(takes, axis=0)])
    return before, np.cumsum(takes, axis=1) - takes


def chunks_of(at: np.ndarray, t: int, n_chunks: int) -> np.ndarray:
    """The chunk in which each token of a queue of t lies: the last c that begins, at t * c // n_chunks, at it or before."""
    kind = np.int64 if t * n_chunks < 1 << 62 else object  # whole numbers of any size
    return (((at.astype(kind) + 1) * n_chunks - 1) // t).astype(np.int64)


def cut(queue: np.ndarray, at: np.ndarray, size: np.ndarray, plan: list, window: int, stride: int) -> tuple[np.ndarray, ...]:
    """Pieces of documents that take `size` tokens of their queues from `at`, over all phases (lengths, n_chunks): (document, start in it, length, sequence, offset), in order.

    Only the chunks that the documents lie in are planned, each of them once.
    """
    queues = [int(q) for q in np.unique(queue[size > 0])]
    places: dict[int, list] = {q: [] for q in queues}  # of each queue (first token, end, sequence, offset of the first)
    before_phase, chunks = [0] * (max(queues, default=-1) + 1), 0
    for lengths, n_chunks in plan:
        wanted: dict[int, list[int]] = {}
        for q in queues:
            t, base = lengths[q], before_phase[q]
            own = (queue == q) & (size > 0) & (at < base + t) & (at + size > base)
            if t and own.any():
                a, z = np.maximum(at[own] - base, 0), np.minimum(at[own] + size[own] - base, t)
                first, last = chunks_of(a, t, n_chunks), chunks_of(z - 1, t, n_chunks)
                thin = last - first >= z - a  # a short queue: not every chunk has a token of it
                found = [first[~thin & (first + k <= last)] + k for k in range(int((last - first)[~thin].max(initial=-1)) + 1)]
                if thin.any():
                    found.append(chunks_of(np.concatenate([np.arange(i, j) for i, j in zip(a[thin].tolist(), z[thin].tolist())]), t, n_chunks))
                for c in np.unique(np.concatenate(found)).tolist():
                    wanted.setdefault(c, []).append(q)
        for c in sorted(wanted):
            before, offsets = chunk_plan(c, n_chunks, lengths, window)
            for q in wanted[c]:
                has = np.flatnonzero(np.diff(before[:, q]))
                begin = before_phase[q] + lengths[q] * c // n_chunks
                places[q].append((begin + before[has, q], begin + before[has + 1, q], (chunks + c) * stride + has, offsets[has, q]))
        before_phase = [b + lengths[q] for q, b in enumerate(before_phase)]
        chunks += n_chunks
    first, many, have, tables = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), 0, []
    for q in queues:
        own, table = (queue == q) & (size > 0), [np.concatenate(x) for x in zip(*places[q])]
        first[own] = have + np.searchsorted(table[0], at[own], side="right") - 1
        many[own] = have + np.searchsorted(table[0], at[own] + size[own], side="left") - first[own]
        tables.append(table)
        have += len(table[0])
    if not have:
        return (np.zeros(0, np.int64),) * 5
    begin, end, sequence, offset = (np.concatenate(x) for x in zip(*tables))
    doc = np.repeat(np.arange(len(at)), many)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + first[doc]
    start = np.maximum(begin[k], at[doc])
    return doc, start - at[doc], np.minimum(end[k], at[doc] + size[doc]) - start, sequence[k], offset[k] + start - begin[k]


def part_bytes(total: int) -> int:
    """Bytes of text in a part: 8 MB for small tables, 128 MB at most, so that there are neither few parts nor millions."""
    return min(max(total // 20_000, PART_BYTES), 16 * PART_BYTES)


def pack(
    docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = WINDOW, chunk: int = CHUNK, targets: dict[str | None, float] | None = None, payload: bool = True,
    bytes_per_part: int | None = None,
) -> DataFrame:
    """One row per piece: doc_id, source, start, length, doc_tokens, sequence_id, offset, ids_crc32, and with `payload` ids (binary, little-endian of 16 or 32 bits).

    A document is its text's ids and end_id; null and empty texts are the end id alone. A null source is a
    queue of its own, null doc_ids come last in their queue, repeated rows are documents of their own. Other
    columns are not read. An empty table gives an empty result. `targets` are weights of sources, in tokens
    (without them: the natural shares); no token is left out, so once a source is dry the others go on by
    their weights, and sources without a weight come last. The lengths of the queues, one number for each
    source, are the only data that pass through the driver.

    Texts move once, into parts by ranges of (doc_id, text), so rows with one doc_id or none are split like any
    others; ids stay in the part where they were made.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.monotonically_increasing_id().alias("row"))
    n = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    total = n["bytes"] + 8 * n["rows"]
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text"), F.col("row")]  # equal rows are told apart by their place in the input
    dealt = slim.repartitionByRange(max(1, round(total / (bytes_per_part or part_bytes(total)))), *order).sortWithinPartitions(F.asc_nulls_last("source"), *order).select("text", "doc_id", "source")

    def encode(batches):
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(vocabulary)
        done: dict = {}  # tokens of each source in the part so far
        for b in in_chunks(batches):
            ids = enc.encode(b.column(0), end_id)
            size = pc.binary_length(ids).to_numpy().astype(np.int64) // enc.dtype.itemsize
            inner = np.cumsum(size) - size
            names = b.column(2).to_pylist()
            cuts = [i for i, s in enumerate(names) if not i or s != names[i - 1]]
            for i, j in zip(cuts, [*cuts[1:], len(names)]):  # sources are in order
                inner[i:j] += done.get(names[i], 0) - inner[i]
                done[names[i]] = int(inner[j - 1] + size[j - 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), part, np.int32)), b.column(1), b.column(2), pa.array(size), pa.array(inner), ids], ["part", "doc_id", "source", "n", "inner", "ids"])

    encoded = materialise(dealt.mapInArrow(encode, "part int, doc_id long, source string, n long, inner long, ids binary"), "pack-ids")
    parts = materialise(encoded.groupBy("part", "source").agg(F.sum("n").alias("n")), "pack-parts")
    queues = sorted(parts.groupBy("source").agg(F.sum("n").alias("n")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    lengths = tuple(int(r["n"]) for r in queues)
    amounts = [lengths] if targets is None else phases(lengths, [targets.get(r["source"], 0) for r in queues])
    plan = [(x, max(1, round(sum(x) / (chunk * window)))) for x in amounts]
    stride = max(((sum(x) // k + len(x) + 1) // window + window.bit_length() + 1 for x, k in plan), default=1)
    number = {r["source"]: i for i, r in enumerate(queues)}
    # a row for each part and source
    before = F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n")
    bases = materialise(parts.select("part", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("z"), before.alias("base")), "pack-bases")
    keyed = encoded.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("z", F.col("source").isNull())
    placed = keyed.join(bases, ["part", "s", "z"]).select("doc_id", "source", "n", (F.col("base") + F.col("inner")).alias("at"), "ids")
    width = encoder(vocabulary).dtype.itemsize

    def give(batches):
        for b in (whole.slice(lo, BATCH_ROWS) for whole in batches for lo in range(0, whole.num_rows, BATCH_ROWS)):
            size, at = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            names = b.column(1).dictionary_encode()
            of = np.array([number[s] for s in names.dictionary.to_pylist()] + [number.get(None, 0)])
            queue = of[names.indices.fill_null(len(of) - 1).to_numpy()]
            doc, start, length, sequence, offset = cut(queue, at, size, plan, window, stride)
            ids = b.column(4)
            buffer, first = ids.buffers()[2], int(np.frombuffer(ids.buffers()[1], np.int32)[ids.offset])
            raw = buffer.slice(first, int(size.sum()) * width)
            wide = memoryview(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
            to = 4 * np.cumsum(length)  # the pieces are the documents' tokens in order
            sums = [zlib.crc32(wide[x:y]) for x, y in zip((to - 4 * length).tolist(), to.tolist())]
            take = pa.array(doc)
            columns = [b.column(0).take(take), b.column(1).take(take), pa.array(start), pa.array(length), pa.array(size[doc]), pa.array(sequence), pa.array(offset), pa.array(sums, pa.int64())]
            if payload:
                columns.append(pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.concatenate([[0], to // 4 * width]).astype(np.int32)), raw]))
            yield pa.RecordBatch.from_arrays(columns, names_)

    names_ = ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"] + ["ids"] * payload
    return placed.mapInArrow(give, "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long" + ", ids binary" * payload)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 1, payload=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")
