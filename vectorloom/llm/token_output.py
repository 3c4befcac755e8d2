"""Token ids in binary shards with a minimal perfect hash index.

A data set is a folder of Parquet container files, so any store that Spark can write to holds it and Spark's
committer publishes it whole or not at all. Rows of `blocks` are contiguous runs of documents in ascending
doc_id order: raw little-endian ids, and an index over the block's document keys, which is a minimal perfect
hash (levels of bit arrays in which a key that falls alone settles; a key's slot is the rank of its bit) with,
for each slot, a 32-bit fingerprint of the key, the key, the offset and the number of ids. A lookup reads a
constant expected number of bits, checks the fingerprint and the key, and slices the payload; keys that are not
there are refused. Every shard is a folder, and `shards` has each one's range of doc_ids and number of ids, so a
key's shard is known before any block is read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, documents, materialise, mix64, new_path
from .tokens import encoder, in_chunks

#: Bytes of text in a shard of a small table, about (8 times as many at most); bytes of ids in a block, at most (a longer document has a block of its own); shards or blocks that a filter names.
SHARD_BYTES, BLOCK_BYTES, FEW = 16_000_000, 250_000, 10_000
_LEVELS = 40


#: The writer looks at its buffers after a few rows, as rows are large.
_WIDE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 4, "parquet.block.size.row.check.min": 4}


def key_hashes(ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Keys are doc_ids and, for repeated ones, their number in the order of the file."""
    return mix64(ids.astype(np.int64).view(np.uint64) ^ mix64(nth.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


class PerfectHash:
    """Minimal perfect hash of n distinct 64-bit keys onto 0..n-1, with fingerprints."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, prints: np.ndarray):
        self.sizes, self.bits, self.prints = sizes.astype(np.int64), bits, prints
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ranks = np.concatenate([[0], np.cumsum(bits)])

    @staticmethod
    def at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left = [], [], keys
        for level in range(_LEVELS):
            if not len(left):
                break
            sizes.append(2 * len(left))
            pos = cls.at(left, level, sizes[-1])
            alone = np.bincount(pos, minlength=sizes[-1]) == 1
            parts.append(alone)
            left = left[~alone[pos]]
        if len(left):
            raise ValueError("keys are not distinct")
        bits = np.concatenate(parts) if parts else np.zeros(0, bool)
        made = cls(np.array(sizes, np.int64), bits, np.zeros(len(keys), np.uint32))
        made.prints[made.slots(keys)] = cls.fingerprint(keys)
        return made

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix64(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            pos = self.at(keys[open_], level, int(size)) + self.starts[level]
            hit = self.bits[pos]
            out[open_[hit]] = self.ranks[pos[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots; -1 where the fingerprint says that the key is not there."""
        s = self.slots(keys)
        ok = s >= 0
        ok[ok] = self.prints[s[ok]] == self.fingerprint(keys[ok])
        return np.where(ok, s, -1)


_BLOCK = "shard int, block int, first long, n_ids long, n_docs int, width int, first_id long, last_id long, keys binary, nth binary, again binary, sizes binary, bits binary, prints binary, offsets binary, lengths binary, ids binary"


def _block_row(shard: int, block: int, first: int, docs: np.ndarray, nth: np.ndarray, lengths: np.ndarray, ids: bytes, width: int) -> dict:
    """A block of documents in ascending order; what belongs to a key stands in its slot."""
    again = _numbers(docs)
    ph = PerfectHash.build(key_hashes(docs, again))
    at = ph.slots(key_hashes(docs, again))
    by_slot = lambda x, kind: x.astype(kind)[np.argsort(at)].tobytes()
    return {
        "shard": shard, "block": block, "first": first, "n_ids": int(lengths.sum()), "n_docs": len(docs), "width": width, "first_id": int(docs[0]), "last_id": int(docs[-1]), "keys": by_slot(docs, np.int64),
        "nth": by_slot(nth, np.uint32), "again": by_slot(again, np.uint32), "sizes": ph.sizes.tobytes(), "bits": np.packbits(ph.bits).tobytes(), "prints": ph.prints.tobytes(),
        "offsets": by_slot(np.cumsum(lengths) - lengths, np.int64), "lengths": by_slot(lengths, np.int64), "ids": ids,
    }


def _numbers(docs: np.ndarray) -> np.ndarray:
    """For ids in ascending order, how many of the same stand before each."""
    n = np.arange(len(docs))
    new = np.concatenate([[True], docs[1:] != docs[:-1]])
    return n - np.maximum.accumulate(np.where(new, n, 0))


def _block_schema() -> pa.Schema:
    kind = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kind[t]) for n, t in (x.split() for x in _BLOCK.split(", "))])


class Block:
    """A block row, opened."""

    def __init__(self, row: dict):
        self.ids = memoryview(row["ids"])
        self.width, self.first = row["width"], row["first"]
        sizes = np.frombuffer(row["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
        self.ph = PerfectHash(sizes, bits, np.frombuffer(row["prints"], np.uint32))
        self.keys, self.offsets, self.lengths = (np.frombuffer(row[k], np.int64) for k in ("keys", "offsets", "lengths"))
        self.nth, self.again = np.frombuffer(row["nth"], np.uint32), np.frombuffer(row["again"], np.uint32)

    def find(self, ids: np.ndarray) -> np.ndarray:
        """The slots of documents, of all rows of those repeated; the stored keys are compared after the fingerprints."""
        out, number = [], 0
        while len(ids):
            s = self.ph.find(key_hashes(ids, np.full(len(ids), number)))
            ok = s >= 0
            ok[ok] = (self.keys[s[ok]] == ids[ok]) & (self.again[s[ok]] == number)
            out.append(s[ok])
            ids, number = ids[ok], number + 1
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def get(self, slot: int) -> np.ndarray:
        o, n = int(self.offsets[slot]), int(self.lengths[slot])
        return np.frombuffer(self.ids[o * self.width : (o + n) * self.width], f"<u{self.width}")


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int | None = None, block_bytes: int = BLOCK_BYTES) -> None:
    """Encode every whole text, append end_id, and write the data set to `path` in ascending doc_id order.

    Null and empty texts have the end id alone. Null doc_ids come last. Repeated doc_ids keep all their rows,
    shorter texts first; `nth` numbers them from 0 in each shard that has some. Other columns are not read. An
    empty table gives an empty data set. Texts move once, into shards by ranges of (doc_id, text), so rows with
    one doc_id or none are split like any others.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    total = size["n"] + 8 * size["rows"]
    n_shards = max(1, round(total / (shard_bytes or min(max(total // 20_000, SHARD_BYTES), 8 * SHARD_BYTES))))
    order = [F.asc_nulls_last("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)), F.xxhash64("text"), F.col("row")]
    dealt = slim.repartitionByRange(n_shards, *order).sortWithinPartitions(*order).select("text", "doc_id")

    def assemble(batches):
        from pyspark import TaskContext

        shard, enc, schema = TaskContext.get().partitionId(), encoder(vocabulary), _block_schema()
        width = enc.dtype.itemsize
        docs_, nth, lengths, data = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), b""
        block = first = 0
        last, seen = None, 0

        def emit(n):
            nonlocal block, first, docs_, nth, lengths, data
            cut = int(lengths[:n].sum()) * width
            row = _block_row(shard, block, first, docs_[:n], nth[:n], lengths[:n], data[:cut], width)
            block, first = block + 1, first + row["n_ids"]
            docs_, nth, lengths, data = docs_[n:], nth[n:], lengths[n:], data[cut:]
            return row

        for b in in_chunks(batches):
            ids = enc.encode(b.column(0), end_id)
            new = b.column(1).fill_null(NO_ID).to_numpy()
            number = _numbers(new)
            number = np.where(new == last, number + seen, number)  # goes on from the chunk before
            last, seen = int(new[-1]), int(number[-1]) + 1
            size = pc.binary_length(ids).to_numpy().astype(np.int64)
            docs_, nth, lengths, data = np.concatenate([docs_, new]), np.concatenate([nth, number]), np.concatenate([lengths, size // width]), data + ids.buffers()[2].to_pybytes()[: int(size.sum())]
            rows = []
            while int(lengths.sum()) * width > block_bytes:
                rows.append(emit(max(1, int(np.searchsorted(np.cumsum(lengths) * width, block_bytes, side="right")))))
            for i in range(0, len(rows), 20):
                yield pa.RecordBatch.from_pylist(rows[i : i + 20], schema)
        if len(docs_):
            yield pa.RecordBatch.from_pylist([emit(len(docs_))], schema)

    dealt.mapInArrow(assemble, _BLOCK).write.options(**_WIDE_ROWS).partitionBy("shard").parquet(f"{path}/blocks")
    # a row for each shard: 20,000 to a million
    shards = _blocks(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_docs").alias("n_docs"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))
    shards = shards.withColumn("start", F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_ids"))
    shards.coalesce(1).write.parquet(f"{path}/shards")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks; only folders of shards that a filter on `shard` names are read."""
    return spark.read.schema(_BLOCK).parquet(f"{path}/blocks")


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a data set, each got through its block's index: doc_id, nth, start, n_tokens, ids_crc32."""

    def look(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                slots = block.ph.find(key_hashes(block.keys, block.again))
                if (slots != np.arange(len(block.keys))).any():
                    raise ValueError("a key of the block is not in its index")
                wide = memoryview(np.frombuffer(block.ids, f"<u{block.width}").astype("<u4").tobytes())
                sums = [zlib.crc32(wide[4 * o : 4 * (o + n)]) for o, n in zip(block.offsets.tolist(), block.lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slots), row["shard"], np.int32)), pa.array(block.keys), pa.array(block.nth.astype(np.int32)), pa.array(block.first + block.offsets), pa.array(block.lengths), pa.array(sums, pa.int64())],
                    ["shard", "doc_id", "nth", "place", "n_tokens", "ids_crc32"],
                )

    found = _blocks(spark, path).mapInArrow(look, "shard int, doc_id long, nth int, place long, n_tokens long, ids_crc32 long")
    starts = spark.read.parquet(f"{path}/shards").select("shard", F.col("start").alias("shard_start"))
    return found.join(starts, "shard").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "nth", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def candidates(keys: DataFrame, path: str, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The blocks that may hold the keys, and (shard, block, asked): which keys those are.

    A key goes to its shards and blocks by their ranges of ids, which are read without the payload. Up to `FEW`
    shards and blocks are named in a filter, so that no other folder and no other page of a file is read.
    """
    spark = keys.sparkSession
    ranges = spark.read.parquet(f"{path}/shards").orderBy("shard").select("shard", "first_id", "last_id").toArrow()
    shard, low, high = (ranges[c].to_numpy() for c in ("shard", "first_id", "last_id"))  # three numbers for each shard

    def route(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            i, j = np.searchsorted(high, ids, side="left"), np.searchsorted(low, ids, side="right")
            n = np.maximum(j - i, 0)
            at = np.repeat(i - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(shard[at].astype(np.int32)), pa.array(np.repeat(ids, n))], ["shard", "key"])

    routed = keys.select(F.col(id_col).cast("long").alias("key")).where("key is not null").distinct().mapInArrow(route, "shard int, key long")
    blocks = _blocks(spark, path)
    named = [r["shard"] for r in routed.select("shard").distinct().limit(FEW + 1).collect()]
    if len(named) <= FEW:
        blocks = blocks.where(F.col("shard").isin(named))
    near = blocks.select("shard", "block", "first_id", "last_id").join(routed, "shard").where("key between first_id and last_id")
    near = materialise(near.groupBy("shard", "block").agg(F.collect_list("key").alias("asked")), "asked-blocks")
    pairs = near.select("shard", "block").limit(FEW + 1).collect()
    if len(pairs) <= FEW:
        blocks = blocks.where(F.col("shard").isin(sorted({r["shard"] for r in pairs})) & F.col("block").isin(sorted({r["block"] for r in pairs})))
    return blocks, near


def lookup(keys: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """The ids of the documents asked for: doc_id, nth, ids (array<long>). Keys that are not there, and null ones, give no row.

    Repeated doc_ids give all their rows. A block's index takes a key to its slot, where its fingerprint and the
    key itself are compared, and the slot's offset cuts the ids out of the payload.
    """

    def get(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                slots = block.find(np.array(row["asked"], np.int64))
                if len(slots):
                    yield pa.RecordBatch.from_arrays([pa.array(block.keys[slots]), pa.array(block.nth[slots].astype(np.int32)), pa.array([block.get(s).astype(np.int64) for s in slots], pa.list_(pa.int64()))], ["doc_id", "nth", "ids"])

    blocks, near = candidates(keys, path, id_col)
    return blocks.join(near, ["shard", "block"]).mapInArrow(get, "doc_id long, nth int, ids array<long>")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-ids")
    write(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), 0)
    return read_all(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
