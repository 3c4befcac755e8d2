"""Streaming extension: a result log as a stream, and the table of latest rows that it keeps fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import latest
from ..sources.datasets import remove


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New JSON files of a landing folder."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders below a path that were written to the end."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    p = make(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p) if fs.exists(make(f.getPath(), "_SUCCESS"))]
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


def keep_latest(stream: DataFrame, key: list[str], order: list[Column], target: str, checkpoint: str, compact: int = 20, once: bool = False):
    """Start a query that keeps `target` at the latest row of each key; `read_latest` reads it.

    A batch writes only its own latest rows, as a delta of its number, so a repeated batch does no harm. After
    every `compact` batches the base and the deltas since are merged into a new base, and what went into it is
    removed. With `once`, what is there now is read and the query ends.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest(batch, key, order).select(batch.columns).write.mode("overwrite").parquet(f"{target}/delta/v={number}")
        if (number + 1) % compact == 0:
            read_latest(spark, target, batch.schema, key, order).write.mode("overwrite").parquet(f"{target}/base/v={number}")
            for kind in ("delta", "base"):
                for v in _versions(spark, f"{target}/{kind}"):
                    if v < number or kind == "delta" and v == number:
                        remove(spark, f"{target}/{kind}/v={v}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_latest(spark: SparkSession, target: str, schema, key: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each key: of the newest base and the deltas after it."""
    base = _versions(spark, f"{target}/base")[-1:]
    paths = [f"{target}/base/v={v}" for v in base] + [f"{target}/delta/v={v}" for v in _versions(spark, f"{target}/delta") if not base or v > base[0]]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return latest(rows, key, order).select(rows.columns)


def windowed(stream: DataFrame, at: str, value: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and means of a value in tumbling windows, closed by a watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
