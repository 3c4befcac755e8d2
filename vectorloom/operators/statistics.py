"""Bootstrap intervals, contrasts and quantiles. Draws come from MD5(seed:replicate:position), so any engine can repeat them."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

DIGITS = 6


def _r(c):
    return F.round(c, DIGITS)


def differences(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """(query_id, d): a minus b over the queries that both have, undefined ones left out."""
    return a.select("query_id", F.col(value).alias("x")).join(b.select("query_id", F.col(value).alias("y")), "query_id").where("x is not null and y is not null").select("query_id", (F.col("x") - F.col("y")).alias("d"))


#: Values (one for each query) that are broadcast for the draws, at most.
FEW_VALUES = 10_000_000


def replicate_means(sample: DataFrame, n: int, seed: int, value: str = "d") -> DataFrame:
    """(rep, m): means of n resamples of the values in the order of query_id. The values, one number for each query, are broadcast; each task draws and averages some of the resamples."""
    spark = sample.sparkSession
    if (size := sample.count()) > FEW_VALUES:
        raise ValueError(f"{size} values are more than the {FEW_VALUES} that resamples are drawn from")
    sent = spark.sparkContext.broadcast(sample.orderBy("query_id").select(F.col(value).cast("double").alias("v")).toArrow()["v"].to_numpy())

    def work(batches):
        v = sent.value
        for b in batches:
            means = []
            for rep in b.column(0).to_pylist() if len(v) else ():
                lead = md5(f"{seed}:{rep}:".encode())
                means.append(float(v[np.fromiter((_drawn(lead, i, len(v)) for i in range(len(v))), np.int64, len(v))].mean()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(0, len(means)), pa.array(means, pa.float64())], ["rep", "m"])

    return spark.range(n).select(F.col("id").alias("rep")).mapInArrow(work, "rep long, m double")


def _drawn(lead, i: int, size: int) -> int:
    h = lead.copy()
    h.update(str(i).encode())
    return int.from_bytes(h.digest()[:4], "big") % size


def readouts(plain: DataFrame, variants: dict[str, DataFrame], value: str, n: int, seed: int) -> DataFrame:
    """(variant, n, mean, lo, hi, star): each variant against the plain reading of the same queries; a star where the interval leaves out 0."""
    out = None
    for name, df in variants.items():
        part = interval(differences(df, plain, value), n, seed).withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("variant", "n", "mean", "lo", "hi", F.when((F.col("lo") > 0) | (F.col("hi") < 0), "*").otherwise("").alias("star"))


def interval(sample: DataFrame, n: int, seed: int, alpha: float = 0.05, value: str = "d") -> DataFrame:
    """One row (n, mean, lo, hi): mean with a bootstrap interval of linear quantiles; nulls where there is no value."""
    ok = cut(sample.select("query_id", value).where(F.col(value).isNotNull()))  # a number for each query, read three times
    q = replicate_means(ok, n, seed, value).agg(F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    return ok.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).crossJoin(q).select("n", _r("mean").alias("mean"), _r(F.col("q")[0]).alias("lo"), _r(F.col("q")[1]).alias("hi"))


def interval_by_order(sample: DataFrame, n: int, seed: int, value: str = "d") -> DataFrame:
    """The same with order statistics at int(0.025 n) and int(0.975 n)."""
    sample = cut(sample.select("query_id", value))
    s = replicate_means(sample, n, seed, value).agg(F.sort_array(F.collect_list("m")).alias("s"))  # n numbers
    at = lambda p: F.element_at("s", min(int(p * n), n - 1) + 1)
    return sample.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).crossJoin(s).select("n", _r("mean").alias("mean"), _r(at(0.025)).alias("lo"), _r(at(0.975)).alias("hi"))


def verdict(df: DataFrame) -> DataFrame:
    """Better, worse or tie by the interval's sign, and whether it leaves out 0."""
    return df.withColumn("verdict", F.when(F.col("lo") > 0, "better").when(F.col("hi") < 0, "worse").otherwise("tie")).withColumn("significant", F.coalesce((F.col("lo") > 0) | (F.col("hi") < 0), F.lit(False)))


def interaction(aa: DataFrame, ab: DataFrame, ba: DataFrame, bb: DataFrame, value: str, n: int, seed: int) -> DataFrame:
    """Interval of the difference of differences (aa - ab) - (ba - bb) per query."""
    x, y = differences(aa, ab, value).withColumnRenamed("d", "x"), differences(ba, bb, value).withColumnRenamed("d", "y")
    return interval(x.join(y, "query_id").select("query_id", (F.col("x") - F.col("y")).alias("d")), n, seed)


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, percentiles and extremes of a value."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    return df.groupBy(*by).agg(F.count(value).alias("n"), _r(F.avg(value)).alias("mean"), _r(p[0]).alias("p50"), _r(p[1]).alias("p95"), _r(F.min(value)).alias("least"), _r(F.max(value)).alias("most"))


def peak_of_sums(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """The highest total of parallel values at any moment."""
    return df.groupBy(*by, at).agg(F.sum(value).alias("s")).groupBy(*by).agg(_r(F.max("s")).alias("peak"), F.count("*").alias("moments"))


def throughput(df: DataFrame, by: list[str], amount: str, millis: str) -> DataFrame:
    """Amount a second; null where no time passed."""
    return df.groupBy(*by).agg(_r(F.sum(amount) / F.nullif(F.sum(millis) / 1000.0, F.lit(0.0))).alias("per_second"))
