"""Files of retrieval data sets: reading and writing.

A data set is a folder of corpus.jsonl.gz, queries.jsonl.gz, qrels.tsv, splits.json and meta.json (each a
folder of part files where Spark wrote it).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "_id string, title string, text string"
QUERIES = "_id string, text string"
QRELS = "query_id string, doc_id string, grade int"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """corpus, queries, qrels, splits and meta; nulls in titles and texts become empty."""
    if not exists(spark, f"{path}/corpus.jsonl.gz"):
        raise FileNotFoundError(f"no data set at {path}: save one there first")
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    corpus = spark.read.schema(CORPUS).json(f"{path}/corpus.jsonl.gz").select(F.col("_id").alias("doc_id"), none("title"), none("text"))
    queries = spark.read.schema(QUERIES).json(f"{path}/queries.jsonl.gz").select(F.col("_id").alias("query_id"), none("text"))
    qrels = spark.read.schema(QRELS).csv(f"{path}/qrels.tsv", sep="\t", header=True, quote="")
    raw = spark.read.schema("train array<string>, dev array<string>, test array<string>").json(f"{path}/splits.json", multiLine=True)
    splits = raw.select(F.explode(F.create_map(*[x for k in ("train", "dev", "test") for x in (F.lit(k), F.coalesce(k, F.array().cast("array<string>")))])).alias("split", "ids"))
    splits = splits.select("split", F.posexplode("ids").alias("pos", "query_id"))
    return {"corpus": corpus, "queries": queries, "qrels": qrels, "splits": splits, "meta": spark.read.json(f"{path}/meta.json", multiLine=True)}


def save(path: str, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, splits: DataFrame, meta: DataFrame) -> None:
    """Write a data set, over what is there. Spark publishes each of the five files whole; the data set is whole once meta, which is written last, is there again."""
    if exists(meta.sparkSession, f"{path}/meta.json"):
        remove(meta.sparkSession, f"{path}/meta.json")
    corpus.select(F.col("doc_id").alias("_id"), "title", "text").write.mode("overwrite").json(f"{path}/corpus.jsonl.gz", compression="gzip")
    queries.select(F.col("query_id").alias("_id"), "text").write.mode("overwrite").json(f"{path}/queries.jsonl.gz", compression="gzip")
    qrels.select("query_id", "doc_id", F.col("grade").cast("int")).write.mode("overwrite").csv(f"{path}/qrels.tsv", sep="\t", header=True, quote="")
    ids = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("split") == k, F.struct("pos", "query_id")))), lambda x: x["query_id"]).alias(k)
    splits.agg(ids("train"), ids("dev"), ids("test")).coalesce(1).write.mode("overwrite").json(f"{path}/splits.json")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta.json")


def read_import(spark: SparkSession, path: str, text_key: str = "text") -> DataFrame:
    """(doc_id, title, text) of JSON lines with `id` or `_id`; a line without either is an error when it is read."""
    raw = spark.read.schema(f"id string, _id string, title string, {text_key} string").json(path)
    known = F.coalesce("id", "_id", F.raise_error(F.lit("a line has no id")))
    return raw.select(known.alias("doc_id"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.trim(F.coalesce(text_key, F.lit(""))).alias("text"))


def graded(score):
    """Grades from scores: rounded half to even, none below 0."""
    return F.greatest(F.bround(score).cast("int"), F.lit(0))


#: Fixed value: names of splits that other sources use.
SPLIT_NAMES = {"validation": "dev"}


def by_split(qrels: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Judgements by their splits' own names, those of sources mapped; two that map to one are put together."""
    out: dict[str, DataFrame] = {}
    for name, df in qrels.items():
        own = SPLIT_NAMES.get(name, name)
        out[own] = out[own].unionByName(df) if own in out else df
    return out


def read_beir_qrels(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("q string, d string, s double").csv(path, sep="\t", header=True, quote="")
    return raw.select(F.col("q").alias("query_id"), F.col("d").alias("doc_id"), graded(F.col("s")).alias("grade"))


def read_trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("q string, z string, d string, s double").csv(path, sep="\t", quote="")
    return raw.select(F.col("q").alias("query_id"), F.col("d").alias("doc_id"), graded(F.col("s")).alias("grade"))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text): split at the first tab only."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where("value != ''").select(parts[0].alias("query_id"), parts[1].alias("text"))


def read_shards(spark: SparkSession, pattern: str) -> DataFrame:
    """JSON line shards with their number, from the file name's digits."""
    raw = spark.read.schema("docid string, title string, text string").json(pattern)
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return raw.select(F.col("docid").alias("doc_id"), none("title"), none("text"), F.regexp_extract(F.input_file_name(), r"(\d+)[^/\d]*$", 1).cast("int").alias("shard"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result rows of JSON lines; malformed lines are skipped, keys that a row lacks are null."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_latency(spark: SparkSession, path: str) -> DataFrame:
    """(file, label, p50, p95) of a tab-separated log; of one file and label the last line counts, lines of another width or without numbers do not."""
    part = F.split("value", "\t")
    raw = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where(F.size(part) == 4)
    rows = raw.select("at", part[0].alias("file"), part[1].alias("label"), part[2].try_cast("double").alias("p50"), part[3].try_cast("double").alias("p95")).where("p50 is not null and p95 is not null")
    return rows.groupBy("file", "label").agg(F.max_by(F.struct("p50", "p95"), "at").alias("r")).select("file", "label", "r.p50", "r.p95")


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(pos, text): paragraphs between blank lines."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.filter(F.split("value", r"\n\s*\n"), lambda x: F.trim(x) != "")).alias("pos", "text"))


def read_vectors(spark: SparkSession, path: str, dim: int | None = None, dtype: str = "<f4", rows: int | None = None) -> DataFrame:
    """(file, pos, embedding) of raw little-endian or .npy files of vectors.

    The dimension is given, or a .npy file's own, or follows from `rows`, the number of vectors in a file. A file
    that is no whole number of vectors, or has another number of them than `rows`, is an error. A file is read whole
    by one task, so larger collections come in several files (Spark's limit for one is 2 GB).
    """

    def work(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if raw[:6] == b"\x93NUMPY":
                    import io

                    x = np.load(io.BytesIO(raw), allow_pickle=False)
                else:
                    x = np.frombuffer(raw, dtype)
                own = dim or (x.shape[1] if x.ndim == 2 else x.size // rows if rows else None)
                if not own or x.size % own or (rows is not None and x.size // own != rows):
                    raise ValueError(f"{name}: {x.size} numbers are no {rows or 'whole'} vectors of {own or 'an unknown length'}")
                x = x.reshape(-1, own).astype(np.float32)
                for i in range(0, len(x), 1000):
                    part = x[i : i + 1000]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, own), pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), lists], ["file", "pos", "embedding"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInArrow(work, "file string, pos long, embedding array<float>")


def write_shards(rows: DataFrame, path: str, order: str, row_bytes: int, shard_bytes: int = 24 << 20) -> None:
    """Files of at most shard_bytes, in order."""
    rows.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").option("maxRecordsPerFile", max(1, shard_bytes // row_bytes)).parquet(path)


def write_missing(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key is not there yet, so that an interrupted run can go on."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = rows.join(spark.read.schema(rows.schema).json(path).select(key), key, "left_anti")
    rows.write.mode("append").json(path)


def manifest(spark: SparkSession, path: str, chunk: int) -> DataFrame:
    """(file, size, sha256, chunks): files with their checksums and the sizes of their chunks."""
    raw = spark.read.format("binaryFile").load(path)
    n = F.ceil(F.col("length") / chunk).cast("int")
    sizes = F.when(F.col("length") > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.least(F.lit(chunk).cast("long"), F.col("length") - (i - 1) * chunk))).otherwise(F.array().cast("array<bigint>"))
    return raw.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), sizes.alias("chunks"))


def save_embeddings(path: str, corpus: DataFrame, queries: DataFrame, about: dict[str, str]) -> None:
    """A cache of vectors: corpus and queries as (id, embedding), and one row of provenance (about, counts, dimension), written last."""
    spark = corpus.sparkSession
    for name, df in (("corpus", corpus), ("queries", queries)):
        df.select("id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(f"{path}/{name}")
    size = {}
    for name in ("corpus", "queries"):
        r = spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
        if r["low"] != r["high"]:
            raise ValueError(f"{name}: vectors of {r['low']} to {r['high']} numbers")
        size[name] = r
    if size["corpus"]["n"] and size["queries"]["n"] and size["corpus"]["low"] != size["queries"]["low"]:
        raise ValueError("corpus and queries differ in dimension")
    row = {"n_corpus": size["corpus"]["n"], "n_queries": size["queries"]["n"], "dim": size["corpus"]["low"], "about": about}
    spark.createDataFrame([row], "n_corpus long, n_queries long, dim int, about map<string,string>").coalesce(1).write.mode("overwrite").json(f"{path}/meta.json")


def load_embeddings(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """corpus, queries and meta of a cache; an error if its counts are not those of its provenance, as after a write that did not end."""
    if not exists(spark, f"{path}/meta.json"):
        raise FileNotFoundError(f"no embeddings at {path}, or not written to the end")
    meta = spark.read.schema("n_corpus long, n_queries long, dim int, about map<string,string>").json(f"{path}/meta.json")
    out = {name: spark.read.parquet(f"{path}/{name}") for name in ("corpus", "queries")}
    m = meta.first()
    if any(out[name].count() != m[f"n_{name}"] for name in out):
        raise ValueError(f"{path}: counts differ from the provenance")
    return out | {"meta": meta}


def save_per_query(results: DataFrame, path: str) -> None:
    """Values of each query (dataset, system, query_id, metric, value), a folder for each data set and system; those in `results` are replaced, others stay."""
    results.select("query_id", "metric", "value", "dataset", "system").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "system").parquet(path)


def load_per_query(spark: SparkSession, path: str, dataset: str | None = None, system: str | None = None) -> DataFrame:
    """What `save_per_query` wrote; only the folders asked for are read."""
    df = spark.read.schema("query_id string, metric string, value double, dataset string, system string").parquet(path)
    for c, v in (("dataset", dataset), ("system", system)):
        df = df if v is None else df.where(F.col(c) == v)
    return df


def write_doc_shards(docs: DataFrame, path: str, order: str, size: int = 5_000) -> None:
    """JSON files of `size` documents each, in order, as rows (shard, first_index, docs). `order` is a gapless number from 0."""
    shard = F.floor(F.col(order) / size).cast("long")
    rest = [c for c in docs.columns if c != order]
    rows = docs.groupBy(shard.alias("shard")).agg(F.min(order).alias("first_index"), F.sort_array(F.collect_list(F.struct(order, *rest))).alias("docs"))  # `size` of them
    rows.select("shard", F.col("shard").alias("part"), "first_index", "docs").write.mode("overwrite").partitionBy("part").json(path)


def shard_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, bytes) of what `write_shards` wrote, in order."""
    meta = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size")
    return meta.groupBy(F.col("file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.max("file_size").alias("bytes")).orderBy("file")


def load_index(spark: SparkSession, path: str, rows: int, dim: int) -> DataFrame:
    """(pos, embedding) of an index in Parquet shards: codes with a scale for each row are multiplied out, other vectors taken as they are. Another number of rows or numbers than said is an error."""
    df = spark.read.parquet(path)
    x = F.transform("codes", lambda c: (c * F.col("scale")).cast("float")) if "codes" in df.columns else F.col("embedding").cast("array<float>")
    out = df.select("pos", x.alias("embedding"))
    got = out.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("numbers")).first()
    if got["n"] != rows or got["numbers"] != rows * dim:
        raise ValueError(f"index size mismatch: {got['numbers']} numbers in {got['n']} rows, not {rows} x {dim}")
    return out
