"""Substring dedup with a log-structured fingerprint index.

The index is a set of immutable runs, each sorted by fingerprint and bucketed by it, of the window fingerprints
(anchors) of a batch of documents and who holds them: (fp, did, key). A new batch is fingerprinted into a run of
its own, which is merge-joined with the runs of history (equal buckets, sorted, so without a shuffle);
fingerprints that history holds too, or two documents of the batch, are candidates, and the runs tell which
documents hold them. Runs are compacted into one when there are more than `FAN`. Candidates are verified against
the texts: under each candidate fingerprint, all windows of the documents that hold it are compared by a 128-bit
hash over the whole window, and the smallest doc_id that holds a window owns it.

An index may live on in a folder of its own (`FingerprintIndex.open`), with the texts of its documents;
`dedup_batch` judges a new batch against it and adds it.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import covered, gram_hashes, keyed, runs, true_spans, window_anchors
from .common import WordHasher, documents, drop_path, materialise, new_path

#: Words in a window and in a fingerprinted gram; runs before they are compacted; batches of a one-off call.
WINDOW, GRAM, FAN, BATCHES = 50, 16, 2, 4
#: Fingerprints in a bucket, about. Fingerprints of more documents than HOT are compared by aggregation, not in one task.
BUCKET_ROWS, HOT = 1_000_000, 5_000
#: Stands for every document of history where a batch is judged.
EARLIER = -(1 << 63)

_hashers: list[WordHasher] = []


def _hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    if not _hashers:
        _hashers.extend(WordHasher(seed=i) for i in range(2))
    return _hashers[seed](words)


class FingerprintIndex:
    """Runs of (fp, did, key) as bucketed, sorted tables in a folder that the cluster shares."""

    SCHEMA = "fp long, did long, key long"

    def __init__(self, spark: SparkSession, buckets: int = 8, fan: int = FAN, path: str | None = None):
        self.spark, self.buckets, self.fan, self.runs, self.texts, self.version = spark, buckets, fan, [], [], 0
        self.lasting, self.path = path is not None, path or new_path(spark, "fingerprints")
        self.name = f"vectorloom_{uuid.uuid4().hex}"  # of the tables in the session's catalogue, until close()

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int = 8, fan: int = FAN) -> FingerprintIndex:
        """The index in a folder, as its last batch left it; a new one where there is none."""
        index = cls(spark, buckets, fan, path.rstrip("/"))
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{index.path}/state")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p):
            done = [int(x) for x in cls._versions(spark, fs, p)]
            if done:
                state = json.loads(spark.read.text(f"{index.path}/state/{max(done)}").first()[0])
                index.buckets, index.runs, index.texts, index.version = state["buckets"], state["runs"], state["texts"], max(done)
                for run in index.runs:
                    spark.sql(f"CREATE TABLE {index._table(run)} ({cls.SCHEMA.replace(' long', ' BIGINT')}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {index.buckets} BUCKETS LOCATION '{index.path}/{run}'")
        return index

    @staticmethod
    def _versions(spark, fs, p) -> list[str]:
        """States that were written to the end."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return [f.getPath().getName() for f in fs.listStatus(p) if fs.exists(path(f.getPath(), "_SUCCESS"))]

    def _table(self, run: str) -> str:
        return f"{self.name}_{run.replace('-', '_')}"

    def _save(self, gone: tuple[str, ...] = ()) -> None:
        """What the index consists of from now on; what is no part of it any more goes afterwards."""
        if self.lasting:
            self.version += 1
            state = json.dumps({"buckets": self.buckets, "runs": self.runs, "texts": self.texts})
            self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.text(f"{self.path}/state/{self.version}")
        for run in gone:
            self.spark.sql(f"DROP TABLE {self._table(run)}")
            drop_path(self.spark, f"{self.path}/{run}")

    def _write(self, marks: DataFrame) -> str:
        run = f"run-{uuid.uuid4().hex}"
        # one sorted file for each bucket, so that a merge join needs neither exchange nor sort
        marks.select("fp", "did", "key").repartition(self.buckets, "fp").write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.path}/{run}").saveAsTable(self._table(run))
        return run

    def history(self) -> DataFrame:
        """All runs as plain files."""
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{run}" for run in self.runs])

    def add(self, marks: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """Add a batch of (fp, did, key), each once, and the documents' (did, key, text) if the index shall last; returns the batch's candidates (fp)."""
        run = self._write(marks)
        new = self.spark.table(self._table(run))
        found = new.groupBy("fp").agg(F.min("did").alias("low"), F.max("did").alias("high")).where("low < high").select("fp")
        for old in self.runs:
            found = found.unionByName(new.select("fp").hint("merge").join(self.spark.table(self._table(old)).select("fp").hint("merge"), "fp", "left_semi"))
        found = materialise(found.distinct(), "fp-candidates")
        self.runs.append(run)
        if texts is not None:
            part = f"texts-{uuid.uuid4().hex}"
            texts.select("did", "key", "text").write.parquet(f"{self.path}/{part}")
            self.texts.append(part)
        if len(self.runs) > self.fan:
            self.compact()
        else:
            self._save()
        return found

    def holders(self, candidates: DataFrame) -> DataFrame:
        """(fp, did, key) of all documents of the index that hold a candidate."""
        out = [self.spark.table(self._table(run)).join(candidates, "fp", "left_semi") for run in self.runs]
        both = out[0]
        for x in out[1:]:
            both = both.unionByName(x)
        return both

    def stored(self) -> DataFrame:
        """(did, key, text) of the documents of all batches."""
        return self.spark.read.schema("did long, key long, text string").parquet(*[f"{self.path}/{part}" for part in self.texts])

    def compact(self) -> None:
        """Merge all runs into one."""
        old = tuple(self.runs)
        self.runs = [self._write(self.history())]
        self._save(old)

    def close(self) -> None:
        """Forget the tables; an index that lasts can be opened again, the files of any other go."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
        if not self.lasting:
            drop_path(self.spark, self.path)
        self.runs = []


def _fingerprint(window: int, gram: int):
    def work(batches):
        from xxhash import xxh3_128_digest

        for b in batches:
            did, key = b.column(0), b.column(1)
            for lo in range(0, b.num_rows, 500):
                texts = b.column(2).slice(lo, 500).to_pylist()
                n, sha, fps = [], [], []
                for t in texts:
                    words = t.encode().split()
                    n.append(len(words))
                    sha.append(xxh3_128_digest(b" ".join(words)))
                    fps.append(np.unique(window_anchors(_hashes(words), window, gram)) if len(words) >= window else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([did.slice(lo, 500), key.slice(lo, 500), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(fps, pa.list_(pa.int64()))], ["did", "key", "n", "whole", "fps"])

    return work


def _windows(window: int, gram: int):
    """Rows (fp, did, key, start, two hashes each of the windows from there) of the stretches under a document's candidate fingerprints."""

    def work(batches):
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for did, key, text, fps in zip(*(b.column(k) for k in range(4))):
                words = text.as_py().encode().split()
                units = _hashes(words)
                a = window_anchors(units, window, gram)
                h, g = (gram_hashes(x ^ np.uint64(0xA5A5A5A5A5A5A5A5), window).view(np.int64) for x in (units, _hashes(words, 1)))
                s, e = runs(a)
                ok = np.isin(a[s], np.array(fps.as_py(), np.int64))
                for x, y in zip(s[ok], e[ok]):
                    rows.append((int(a[x]), did.as_py(), key.as_py(), int(x), h[x:y], g[x:y]))
                    size += 2 * int(y - x) + 5
                if size > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
    names = ["fp", "did", "key", "start", "hashes", "more"]
    return work


def _owned(batches):
    """Of rows sorted by fp: the windows that a smaller did has under the same fp, as (did, key, start, count)."""

    def solve(parts):
        t = pa.Table.from_batches(parts)
        fp, did, key, start = (t.column(k).to_numpy() for k in range(4))
        lists = t.column(4).combine_chunks()
        flat, more, count = lists.flatten().to_numpy(), t.column(5).combine_chunks().flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(fp)), count)
        order = np.lexsort((did[row], more, flat, fp[row]))
        f, h, g, d = fp[row][order], flat[order], more[order], did[row][order]
        new = np.concatenate([[True], (f[1:] != f[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        hit = np.empty(len(flat), bool)
        hit[order] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
        # stretches of hits within each row
        edge = np.zeros(len(flat), bool)
        edge[np.cumsum(count) - count] = True
        head = hit & (edge | ~np.concatenate([[False], hit[:-1]]))
        at = np.flatnonzero(head)
        if not len(at):
            return None
        size = np.add.reduceat(hit.astype(np.int64), at)
        first = np.cumsum(count) - count
        r = row[at]
        return pa.RecordBatch.from_arrays([pa.array(did[r]), pa.array(key[r]), pa.array(start[r] + at - first[r]), pa.array(size)], ["did", "key", "start", "count"])

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        while b.num_rows:
            fp = b.column(0).to_numpy()
            if size > 1_000_000 and held:  # finish at a change of fp
                last = held[-1].column(0)[-1].as_py()
                cut = int(np.searchsorted(fp != last, True)) if (fp != last).any() else len(fp)
                held.append(b.slice(0, cut))
                b = b.slice(cut)
                if b.num_rows:
                    out = solve(held)
                    if out is not None:
                        yield out
                    held, size = [], 0
                continue
            held.append(b)
            size += 2 * len(b.column(4).flatten()) + b.num_rows
            break
    if held and sum(x.num_rows for x in held):
        out = solve(held)
        if out is not None:
            yield out


def _prepared(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """For keyed documents: (did, key, fps) of those that have windows, and (did, key) of those whose word sequence as a whole has a smaller did."""
    base = materialise(docs.select("did", "key", "text").mapInArrow(_fingerprint(window, gram), "did long, key long, n long, whole binary, fps array<long>"), "windows-base")
    firsts = materialise(base.groupBy("whole").agg(F.min("did").alias("first")), "windows-firsts")
    known = base.join(firsts, "whole")
    copies = known.where((F.col("did") > F.col("first")) & (F.col("n") >= window)).select("did", "key").distinct()
    own = known.where(F.col("did") == F.col("first")).where(F.size("fps") > 0).select("did", "key", "fps").dropDuplicates(["did", "key"])
    return materialise(own, "windows-own"), copies


def _verified(texts: DataFrame, holders: DataFrame, window: int, gram: int) -> DataFrame:
    """(did, key, spans) of the windows that a smaller did holds, among the documents (did, key, text) that hold candidates (fp, did, key).

    Windows start at `start`, `start + 1`, ... `count` of them.
    """
    holders = materialise(holders, "windows-holders")
    shared = holders.groupBy("fp").agg(F.count("*").alias("docs"))
    wanted = holders.groupBy("did", "key").agg(F.collect_list("fp").alias("fps"))
    rows = texts.join(wanted, ["did", "key"]).select("did", "key", "text", "fps")
    rows = rows.mapInArrow(_windows(window, gram), "fp long, did long, key long, start long, hashes array<long>, more array<long>")
    hot = materialise(shared.where(F.col("docs") > HOT).select("fp"), "windows-hot")
    n_hot, size = hot.count(), holders.count()
    if n_hot:
        rows = materialise(rows, "windows-rows")
        single = rows.join(hot, "fp", "left_semi").select("fp", "did", "key", "start", F.posexplode(F.arrays_zip("hashes", "more")).alias("i", "x"))
        single = single.select("fp", F.col("x.hashes").alias("h"), F.col("x.more").alias("g"), "did", "key", (F.col("start") + F.col("i")).alias("start"))
        owner = materialise(single.groupBy("fp", "h", "g").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last").select("fp", "h", "g", "first"), "windows-owners")
        more = single.join(owner, ["fp", "h", "g"]).where("did > first").select("did", "key", "start", F.lit(1).cast("long").alias("count"))
        rows = rows.join(hot, "fp", "left_anti")
    hits = rows.repartition(max(2, round(size / 30_000)), "fp").sortWithinPartitions("fp").mapInArrow(_owned, "did long, key long, start long, count long")
    if n_hot:
        hits = hits.unionByName(more)
    return hits.groupBy("did", "key").agg(F.collect_list(F.struct("start", "count")).alias("spans"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """For keyed documents: (did, key, spans) of windows that a smaller did holds, and (did, key) of those whose word sequence as a whole does."""
    own, copies = _prepared(docs, window, gram)
    size = own.agg(F.coalesce(F.sum(F.size("fps")), F.lit(0)).alias("n")).first()["n"]
    cuts = own.approxQuantile("did", [i / batches for i in range(1, batches)], 0.01) if size and batches > 1 else []
    index = FingerprintIndex(docs.sparkSession, max(4, round(size / BUCKET_ROWS)))
    try:
        found = None
        bounds = [None, *cuts, None]
        for low, high in zip(bounds[:-1], bounds[1:]):  # ascending batches
            part = own
            part = part.where(F.col("did") > low) if low is not None else part
            part = part.where(F.col("did") <= high) if high is not None else part
            new = index.add(part.select(F.explode("fps").alias("fp"), "did", "key"))
            found = new if found is None else found.unionByName(new)
        holders = materialise(index.holders(found.distinct()), "windows-found")
    finally:
        index.close()
    return _verified(docs.select("did", "key", "text"), holders, window, gram), copies


def _judged(rows: DataFrame, spans: DataFrame, copies: DataFrame, window: int) -> DataFrame:
    """One row per keyed document: doc_id, n_words, n_removed, kept, removed."""
    marks = spans.withColumn("whole", F.lit(False)).unionByName(copies.select("did", "key", F.array().cast("array<struct<start:long,count:long>>").alias("spans"), F.lit(True).alias("whole")))
    marks = materialise(marks.groupBy("did", "key").agg(F.max("whole").alias("whole"), F.first("spans").alias("spans")), "windows-marks")

    def work(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                n, gone, kept, removed = [], [], [], []
                for text, whole, s in zip(*(part.column(k) for k in (1, 2, 3))):
                    words = text.as_py().encode().split()
                    n.append(len(words))
                    if whole.as_py():
                        kept.append(""), gone.append(len(words)), removed.append([(0, len(words))])
                    elif s.is_valid:
                        x = s.as_py()
                        out = covered(len(words), np.array([i["start"] for i in x]), np.array([i["count"] for i in x]), window)
                        kept.append(b" ".join([w for w, o in zip(words, out.tolist()) if not o]).decode())
                        gone.append(int(out.sum()))
                        removed.append([(int(i), int(j)) for i, j in zip(*true_spans(out))])
                    else:
                        kept.append(b" ".join(words).decode()), gone.append(0), removed.append([])
                span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array([[{"start": i, "end": j} for i, j in r] for r in removed], pa.list_(span))], ["doc_id", "n_words", "n_removed", "kept", "removed"])

    joined = rows.join(marks, ["did", "key"], "left").select("doc_id", "text", "whole", "spans")
    return joined.mapInArrow(work, "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (its remaining words, joined by one space), removed (spans of words).

    A word goes when a window of `window` consecutive words that covers it also starts in a document with a
    smaller doc_id; all windows are judged on the input. Null texts have no words. Documents of fewer words
    than a window, and the first holder of a window, stay whole. A null doc_id counts as the largest. Rows
    with the same doc_id do not remove each other's words. Other columns are not read; an empty table gives an
    empty result.
    """
    rows = keyed(docs, id_col, text_col)
    spans, copies = repeated_windows(rows, window, gram)
    return _judged(rows, spans, copies, window)


def dedup_batch(index: FingerprintIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`dedup` of a new batch against an index that lasts, to which the batch is added.

    What any earlier batch holds counts as held by a smaller doc_id, so batches in ascending order of doc_ids give
    together what one run over all of them gives. Earlier batches are not judged again. The batch is in the index
    once this returns, but for the words of copies inside the batch, which the first of them holds. The other
    cases are as with `dedup`. The index stays open.
    """
    rows = keyed(docs, id_col, text_col)
    own, copies = _prepared(rows, window, gram)
    copies = materialise(copies, "windows-copies")
    mine = materialise(rows.select("did", "key", "text").join(own.select("did", "key"), ["did", "key"], "left_semi").dropDuplicates(["did", "key"]), "windows-batch")
    before = list(index.texts)
    old_texts = index.stored() if before else None
    found = index.add(own.select(F.explode("fps").alias("fp"), "did", "key"), mine)
    holders = index.holders(found)
    new = holders.join(own.select("did", "key"), ["did", "key"], "left_semi")
    texts = mine
    if old_texts is not None:
        # documents of history stand for one that is smaller than all; a document of both is judged with the batch
        past = holders.join(own.select("did", "key"), ["did", "key"], "left_anti")
        past = past.select("fp", F.lit(EARLIER).cast("long").alias("did"), F.xxhash64("did", "key").alias("key"))
        new = new.unionByName(past)
        texts = texts.unionByName(old_texts.select(F.lit(EARLIER).cast("long").alias("did"), F.xxhash64("did", "key").alias("key"), "text"))
    spans = _verified(texts, new, window, gram).where(F.col("did") != EARLIER)
    return _judged(rows, spans, copies, window)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows are compared as strings of their words.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), spots AS (
  SELECT r, doc_id, words, unnest(generate_series(1, len(words) - 49)) AS s FROM d WHERE len(words) >= 50
), win AS (
  SELECT r, doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS w FROM spots
), hit AS (
  SELECT r, s FROM (SELECT r, doc_id, s, min(doc_id) OVER (PARTITION BY w) AS first FROM win) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT r, unnest(generate_series(s, s + 49)) AS p FROM hit
), pos AS (
  SELECT r, list(p) AS ps FROM gone GROUP BY r
)
SELECT d.doc_id, len(words) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN words ELSE list_filter(words, lambda w, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN pos USING (r)
"""
