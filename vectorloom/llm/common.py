"""What the training-data operators share: shared storage, words, hashes and row keys."""

from __future__ import annotations

import tempfile
import uuid
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, \x20 and \x09-\x0D; every operator here splits words at them.
WHITE = " \t\n\x0b\x0c\r"
#: A word, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id in comparisons: nulls come last.
NO_ID = (1 << 63) - 1

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own, but only if all runs on one machine."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="vectorloom-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/vectorloom/{tag}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def until_exit(spark: SparkSession, path: str) -> None:
    """A folder that results may still read goes when the application ends."""
    p, fs = _files(spark, path)
    fs.deleteOnExit(p)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that no later step reads."""
    p, fs = _files(spark, path)
    fs.delete(p, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors. The folder goes by `drop`, or when the application ends."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    until_exit(spark, path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vectorloom_path = path
    return out


#: Folders that `materialise` has written and that are still there.
_written: list[str] = []


def settled(spark: SparkSession, build, tag: str) -> DataFrame:
    """What `build()` returns, written; whatever else it has written on the way goes, as nothing reads it any more."""
    before = len(_written)
    out = materialise(build(), tag)
    for path in _written[before:-1]:
        drop_path(spark, path)
    del _written[before:-1]
    return out


def drop(*frames: DataFrame) -> None:
    """Remove what `materialise` wrote, once all that reads it has been written itself."""
    for df in frames:
        drop_path(df.sparkSession, df._vectorloom_path)
        if df._vectorloom_path in _written:
            _written.remove(df._vectorloom_path)


def unused(name: str, columns: list[str]) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows in a batch that goes to Python, at most: texts are long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of rows in a batch that goes to Python; it stays so, as plans are made later."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents, in small batches from now on."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text) -> object:
    """Number of words of a column; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words (bytes), remembered up to a bound, so that the memory stays bounded."""

    def __init__(self, most: int = 150_000, seed: int = 0):
        from xxhash import xxh3_64_intdigest

        self.most, self.known, self.digest = most, {}, partial(xxh3_64_intdigest, seed=seed) if seed else xxh3_64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, self.digest
        if len(known) > self.most:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words).difference(known):
                known[w] = digest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def slices(n: int, sizes: np.ndarray, most: int):
    """Cut rows 0..n into runs whose sizes sum to about `most`; a longer row makes a run of its own."""
    start = total = 0
    for i in range(n):
        if total and total + int(sizes[i]) > most:
            yield start, i
            start, total = i, 0
        total += int(sizes[i])
    if start < n:
        yield start, n


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values (doubling: log2(w) passes)."""
    out, span = h, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
