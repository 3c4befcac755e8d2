"""Suffix-array dedup: bytes covered by a string of `window` bytes that also starts anywhere else.

Strings are dealt to shards by their anchors (see anchors.py), so that equal strings meet; only the stretches
of text under an anchor that occurs twice are sent. A shard's array is made by induced sorting, and its
permuted common prefixes tell which strings repeat. Texts that occur twice as a whole are found by digest, and
one of them stands for all. Under an anchor of very many bytes (of many texts, or of a periodic one), strings are
counted by aggregation of 128-bit hashes instead, so that no task holds them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import covered, gram_hashes, runs, true_spans, window_anchors
from .common import documents, drop, materialise, mix64
from .induced_sort import permuted_common_prefixes, suffix_array

#: Bytes of a string and of an anchored gram (long, so that few texts share one by chance); bytes of stretches in a shard; bytes of stretches under an anchor that is counted by aggregation.
WINDOW, GRAM, SHARD_BYTES, HOT = 200, 64, 3_000_000, 1_500_000

#: Strings in a row of hashes, at most; digests (16 bytes each) that are broadcast, at most.
LONG, FEW = 10_000, 1_000_000

_SIGN = mix64(np.arange(1, 257, dtype=np.uint64))


def _units(text: bytes) -> np.ndarray:
    return _SIGN[np.frombuffer(text, np.uint8)]


def _anchors(window: int, gram: int):
    """Each text's anchors and the bytes of the stretches under them, in two halves if the text holds the gram twice."""

    def work(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                fps, sizes = [], []
                for t in b.column(1).slice(lo, 200):
                    units = _units(t.as_py().encode())
                    a = window_anchors(units, window, gram)
                    s, e = runs(a)
                    a, inverse = np.unique(a[s], return_inverse=True)
                    size = np.bincount(inverse, e - s + window - 1, len(a)).astype(np.int64)
                    if len(a):
                        g = gram_hashes(units, gram).view(np.int64)
                        at = np.searchsorted(a, g)
                        hit = a[np.minimum(at, len(a) - 1)] == g
                        n = np.minimum(np.bincount(at[hit], minlength=len(a)), 2)
                        a, size = np.repeat(a, n), np.repeat(size // n, n)
                    fps.append(a), sizes.append(size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 200), pa.array(fps, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], ["whole", "fps", "sizes"])

    return work


def _stretches(window: int, gram: int, hashed: bool):
    """Rows (fp, whole, start, bytes) of the stretches under a text's shared anchors, or with two hashes of each string in place of bytes."""

    def work(batches):
        pair = pa.list_(pa.struct([("h", pa.int64()), ("g", pa.int64())]))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pair if hashed else pa.binary()]
        names = ["fp", "whole", "start", "hashes" if hashed else "piece"]
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for whole, text, fps in zip(*(b.column(k) for k in range(3))):
                raw = text.as_py().encode()
                units = _units(raw)
                a = window_anchors(units, window, gram)
                if hashed:
                    h, g = (gram_hashes(mix64(units ^ np.uint64(x)), window).view(np.int64) for x in (0xA5A5A5A5A5A5A5A5, 0x5DEECE66D1234567))
                s, e = runs(a)
                ok = np.isin(a[s], np.array(fps.as_py(), np.int64))
                for x, y in zip(s[ok].tolist(), e[ok].tolist()):
                    for z in range(x, y, LONG if hashed else y - x):
                        end = min(z + LONG, y) if hashed else y
                        rows.append((int(a[x]), whole.as_py(), z, [{"h": i, "g": j} for i, j in zip(h[z:end].tolist(), g[z:end].tolist())] if hashed else raw[z : end + window - 1]))
                        size += (100 if hashed else 1) * (end - z) + 200
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return work


def repeated_strings(pieces: list[bytes], counts: list[int], window: int) -> list[np.ndarray]:
    """For each of distinct pieces, which of its strings of `window` bytes repeat in any piece; a piece counted twice repeats as a whole."""
    sizes = np.array([len(p) for p in pieces])
    t = np.zeros(int(sizes.sum()) + len(pieces) + 1, np.uint16)
    t[:-1] = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    t[:-1] += 2
    ends = np.cumsum(sizes + 1) - 1
    t[ends] = 1
    before, common = permuted_common_prefixes(t, suffix_array(t))
    left = np.zeros(len(t), np.int64)  # bytes to the end of the piece
    left[:-1] = np.repeat(ends, sizes + 1) - np.arange(len(t) - 1)
    match = np.flatnonzero((common >= window) & (left >= window))
    hit = np.zeros(len(t), bool)
    hit[match] = True
    hit[before[match]] = True
    out, at = [], 0
    for p, n in zip(pieces, counts):
        starts = len(p) - window + 1
        out.append(np.ones(starts, bool) if n > 1 else hit[at : at + starts])
        at += len(p) + 1
    return out


def _resolve(window: int, shard_bytes: int):
    """Of rows sorted by fp: the strings that occur twice, as (whole, start, count)."""

    def work(batches):
        known: dict[tuple[int, bytes], int] = {}
        pieces: list[bytes] = []
        counts: list[int] = []
        owners: list[tuple[int, bytes, int]] = []
        size, last = 0, None

        def solve():
            rows: list[tuple] = []
            spans = [list(zip(*(x.tolist() for x in true_spans(h)))) for h in repeated_strings(pieces, counts, window)]
            for k, whole, start in owners:
                rows += [(whole, start + i, j - i) for i, j in spans[k]]
            for lo in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 10_000]), (pa.binary(), pa.int64(), pa.int64()))], ["whole", "start", "count"])

        for b in batches:
            for fp, whole, start, piece in zip(*(b.column(k).to_pylist() for k in range(4))):
                if fp != last and size > shard_bytes:
                    yield from solve()
                    known, pieces, counts, owners, size = {}, [], [], [], 0
                last = fp
                k = known.setdefault((fp, piece), len(pieces))
                if k == len(pieces):
                    pieces.append(piece)
                    counts.append(0)
                    size += len(piece)
                counts[k] += 1
                size += 60
                owners.append((k, whole, start))
        if pieces:
            yield from solve()

    return work


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, kept (binary: its remaining bytes), removed (spans of bytes).

    A byte goes when a string of `window` bytes that covers it starts at any other place, in the same text or
    another; strings are judged on the input and never cross texts. Texts are their UTF-8 bytes, null ones are
    empty, and those shorter than a string stay whole. Repeated rows are texts of their own, so both lose all
    of a text that is as long as a string. Ids, null or not, are only handed on; other columns are not read;
    an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("whole"), text.alias("text"))
    base = materialise(rows.select("whole", "text").mapInArrow(_anchors(window, gram), "whole binary, fps array<long>, sizes array<int>").where(F.size("fps") > 0), "strings-base")
    own = base.groupBy("whole").agg(F.count("*").alias("copies"), F.first("fps").alias("fps"), F.first("sizes").alias("sizes"))
    own = materialise(own, "strings-own")
    drop(base)
    copies = own.where("copies > 1").select("whole")
    marks = own.select("whole", F.explode(F.arrays_zip("fps", "sizes")).alias("x")).select("whole", F.col("x.fps").alias("fp"), F.col("x.sizes").alias("size"))
    shared = materialise(marks.groupBy("fp").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where("n > 1"), "strings-shared")
    wanted = marks.select("whole", "fp").join(shared, "fp").groupBy("whole").agg(F.collect_set(F.when(F.col("size") <= HOT, F.col("fp"))).alias("fps"), F.collect_set(F.when(F.col("size") > HOT, F.col("fp"))).alias("hot"))
    wanted = materialise(wanted, "strings-wanted")
    # a row for each distinct text; copies are put together before they move, so a text of many copies is no burden
    one = _among(rows, wanted, "left_semi").groupBy("whole").agg(F.first("text").alias("text")).join(wanted, "whole")
    any_hot = shared.where(F.col("size") > HOT).limit(1).count() > 0
    if any_hot:
        one = materialise(one, "strings-texts")
    pieces = one.select("whole", "text", "fps").mapInArrow(_stretches(window, gram, False), "fp long, whole binary, start long, piece binary")
    size = shared.where(F.col("size") <= HOT).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    n_parts = max(2, round(size / SHARD_BYTES))
    hits = pieces.repartition(n_parts, "fp").sortWithinPartitions("fp").mapInArrow(_resolve(window, SHARD_BYTES), "whole binary, start long, count long")
    if any_hot:
        lists = one.where(F.size("hot") > 0).select("whole", "text", "hot").mapInArrow(_stretches(window, gram, True), "fp long, whole binary, start long, hashes array<struct<h:long,g:long>>")
        single = lists.select("fp", "whole", "start", F.posexplode("hashes").alias("i", "x")).select("fp", "x.h", "x.g", "whole", (F.col("start") + F.col("i")).alias("start"))
        single = materialise(single, "strings-hot")
        # written, so that the join with it can split what very many texts share
        twice = materialise(single.groupBy("fp", "h", "g").agg(F.count("*").alias("n")).where("n > 1").select("fp", "h", "g"), "strings-twice")
        hits = hits.unionByName(single.join(twice, ["fp", "h", "g"]).select("whole", "start", F.lit(1).cast("long").alias("count")))
    spans = hits.groupBy("whole").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    marks = spans.withColumn("copy", F.lit(False)).unionByName(copies.select("whole", F.array().cast("array<struct<start:long,count:long>>").alias("spans"), F.lit(True).alias("copy")))
    marks = materialise(marks.groupBy("whole").agg(F.max("copy").alias("copy"), F.first("spans").alias("spans")), "strings-marks")

    def work(batches):
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                n, gone, kept, removed = [], [], [], []
                for text, copy, s in zip(*(part.column(k) for k in (1, 2, 3))):
                    raw = text.as_py().encode()
                    n.append(len(raw))
                    if copy.as_py():
                        kept.append(b""), gone.append(len(raw)), removed.append([(0, len(raw))])
                    elif s.is_valid:
                        x = s.as_py()
                        out = covered(len(raw), np.array([i["start"] for i in x]), np.array([i["count"] for i in x]), window)
                        kept.append(np.frombuffer(raw, np.uint8)[~out].tobytes())
                        gone.append(int(out.sum()))
                        removed.append([(int(i), int(j)) for i, j in zip(*true_spans(out))])
                    else:
                        kept.append(raw), gone.append(0), removed.append([])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array([[{"start": i, "end": j} for i, j in r] for r in removed], pa.list_(span))], ["doc_id", "n_bytes", "n_removed", "kept", "removed"])

    kind = "doc_id long, n_bytes long, n_removed long, kept binary, removed array<struct<start:long,end:long>>"
    columns = ["doc_id", "text", "copy", "spans"]
    if marks.count() > FEW:
        return rows.join(marks, "whole", "left").select(*columns).mapInArrow(work, kind)
    # texts without a repeat stay where they are
    hit, free = _among(rows, marks, "left_semi").join(marks, "whole"), _among(rows, marks, "left_anti")
    free = free.select("doc_id", "text", F.lit(None).cast("boolean").alias("copy"), F.lit(None).cast("array<struct<start:long,count:long>>").alias("spans"))
    return hit.select(*columns).mapInArrow(work, kind).unionByName(free.mapInArrow(work, kind))


def _among(rows: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """Rows whose text is among the known ones (left_semi) or is not (left_anti): at most FEW digests are broadcast; beyond, nothing is gained by looking."""
    return rows.join(F.broadcast(known.select("whole")), "whole", how) if known.count() <= FEW else rows


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Strings are compared by their digests; a run of removed bytes ends where the next string starts more than 200 bytes on.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
spots AS (SELECT r, b, unnest(generate_series(1, octet_length(b) - 199)) AS s FROM d WHERE octet_length(b) >= 200),
win AS (SELECT r, s, md5(b[s:s + 199]) AS w FROM spots),
hit AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY w) AS n FROM win) WHERE n > 1),
mark AS (SELECT r, s, s > lag(s, 1, -1000) OVER (PARTITION BY r ORDER BY s) + 200 AS opens FROM hit),
runs AS (SELECT r, s, sum(opens::INT) OVER (PARTITION BY r ORDER BY s) AS k FROM mark),
span AS (SELECT r, min(s) AS a, max(s) + 199 AS z FROM runs GROUP BY r, k),
gap AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS a, a - 1 AS z, 0 AS tail FROM span UNION ALL SELECT r, max(z) + 1, 1000000000, 1 FROM span GROUP BY r),
rest AS (SELECT r, coalesce(string_agg(hex(b[gap.a:gap.z]), '' ORDER BY gap.a), '') AS h FROM gap JOIN d USING (r) GROUP BY r),
total AS (SELECT r, sum(z - a + 1)::BIGINT AS gone, count(*) AS n FROM span GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, CASE WHEN h IS NULL THEN sha256(b) ELSE sha256(unhex(h)) END AS kept_sha256
FROM d LEFT JOIN rest USING (r) LEFT JOIN total USING (r)
"""
