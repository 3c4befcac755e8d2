"""Thresholds on scores: calibration, confusion and diagnostics, from counts and histograms of blocks of pairs; no pair is a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import retrieval as X
from .storage import cut

DIGITS = 6


def _r(c):
    return F.round(c, DIGITS)


def _bins(hist: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A histogram of scores (at most `retrieval.CODES` rows) as arrays: codes in ascending order and how many pairs each has."""
    t = hist.orderBy("code").toArrow()
    return t["code"].to_numpy(), t["n"].to_numpy()


def _quantiles(code: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Quantiles with linear interpolation between neighbouring scores."""
    ends = np.cumsum(n)
    at = (ends[-1] - 1) * np.asarray(p, float)
    low = np.floor(at).astype(np.int64)
    value = lambda k: code[np.searchsorted(ends, k, side="right")] / 10**DIGITS
    a, b = value(low), value(np.minimum(low + 1, ends[-1] - 1))
    return a + (b - a) * (at - low)


def theta_rate(student: DataFrame, teacher: DataFrame, tau: float) -> DataFrame:
    """One row: the student's threshold that lets pass as large a share as the teacher's tau does; its highest score where that is none. From two histograms."""
    spark = student.sparkSession
    (sc, sn), (tc, tn) = _bins(student), _bins(teacher)
    if not len(sc) or not len(tc):
        return spark.createDataFrame([], "rate double, theta double")
    rate = float(tn[tc / 10**DIGITS >= tau].sum() / tn.sum())
    theta = float(_quantiles(sc, sn, np.array([1 - rate]))[0]) if rate > 0 else float(sc[-1] / 10**DIGITS)
    return spark.createDataFrame([(round(rate, DIGITS), round(theta, DIGITS))], "rate double, theta double")


def best_f1(scores: DataFrame, positives: DataFrame, low: float = 0.5, high: float = 0.99999, n: int = 400) -> DataFrame:
    """One row (theta, f1): the first of n quantile thresholds with the best micro F1 against positive pairs, from the histograms of all and of positive pairs."""
    spark = scores.sparkSession
    (code, count), (pos_code, pos) = _bins(scores), _bins(positives)
    if not len(code):
        return spark.createDataFrame([], "theta double, f1 double")
    theta = np.round(_quantiles(code, count, low + (high - low) * np.arange(n) / (n - 1)), DIGITS)
    above = lambda c, k: np.concatenate([np.cumsum(k[::-1])[::-1], [0]])[np.searchsorted(c, np.rint(theta * 10**DIGITS).astype(np.int64), side="left")]
    f1 = np.round(2.0 * above(pos_code, pos) / np.maximum(above(code, count) + pos.sum(), 1), DIGITS)
    i = int(f1.argmax())
    return spark.createDataFrame([(float(theta[i]), float(f1[i]))], "theta double, f1 double")


def histogram_of(scored: DataFrame) -> DataFrame:
    """The histogram of given pairs' scores."""
    return scored.groupBy(F.round(F.col("score") * 10**DIGITS).cast("long").alias("code")).agg(F.count("*").alias("n"))


def counts(queries: DataFrame, docs: DataFrame, theta: float, tau: float, guard: float = 0.0) -> DataFrame:
    """A row for each query (query_id, v: the teacher's vector, w: the student's): n, n_pos, n_neg, n_band, n_pred, tp, fp, fn, band_pred.

    Positive are pairs whose teacher's score is at least tau + guard, negative those below tau - guard; what is
    between is the band. n_pred are those that the student's theta lets pass.
    """
    names = ["n", "n_pos", "n_neg", "n_band", "n_pred", "tp", "fp", "fn", "band_pred"]

    def work(own, doc, d):
        t, s = X.scores_of(own, doc, d, "v", masked=np.nan), X.scores_of(own, doc, d, "w", masked=np.nan)
        there, pos, neg, pred = ~np.isnan(t), t >= tau + guard, t < tau - guard, s >= theta
        band = there & ~pos & ~neg
        total = [x.sum(axis=1).astype(np.int64) for x in (there, pos, neg, band, pred, pred & pos, pred & neg, ~pred & pos, pred & band)]
        yield pa.RecordBatch.from_arrays([own["query_id"].combine_chunks(), *map(pa.array, total)], ["query_id", *names])

    parts = X.blocks(queries.select("query_id", "v", "w"), docs, work, f"query_id {dict(queries.dtypes)['query_id']}, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("query_id").agg(*[F.sum(n).alias(n) for n in names])


def confusion(per_query: DataFrame) -> DataFrame:
    """A row for each query and one for all (query_id null), from `counts`. Undefined values are null.

    A query's precision divides by all that the student lets pass, the band included, and is undefined where
    that is nothing; its recall is undefined without positives, its fp_rate divides by the negatives. Over all,
    precision divides by tp + fp, no value is undefined but the rate of the band that passes, and fp_rate is the mean number of wrong pairs a query.
    """
    names = [c for c in per_query.columns if c != "query_id"]
    ratio = lambda x, y: F.col(x) / F.greatest(F.col(y), F.lit(1))
    one = per_query.select(
        "query_id", *names, F.when(F.col("n_pred") > 0, ratio("tp", "n_pred")).alias("precision"), F.when(F.col("n_pos") > 0, ratio("tp", "n_pos")).alias("recall"), F.lit(None).cast("double").alias("f1"),
        ratio("fp", "n_neg").alias("fp_rate"), F.lit(None).cast("double").alias("band_rate"), (F.col("n_pos") > 0).cast("long").alias("with_pos"),
    )
    total = per_query.agg(*[F.sum(n).alias(n) for n in names], F.avg("fp").alias("fp_rate"), F.count(F.when(F.col("n_pos") > 0, 1)).alias("with_pos")).where("n is not null")
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    all_ = total.select(
        F.lit(None).cast(dict(per_query.dtypes)["query_id"]).alias("query_id"), *names, p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-12))).alias("f1"), "fp_rate",
        F.when(F.col("n_band") > 0, F.col("band_pred") / F.col("n_band")).alias("band_rate"), "with_pos",
    )
    out = one.unionByName(all_)
    return out.select("query_id", *names, *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "fp_rate", "band_rate")], "with_pos")


def diagnostic(ranked: DataFrame, k: int) -> DataFrame:
    """One row about how a single threshold would fit all queries: spread of the k-th and of the best scores."""
    s = ranked.where(F.col("rank").isin(1, k)).groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"))
    return s.agg(
        F.count("*").alias("n"), _r(F.avg("kth")).alias("kth_mean"), _r(F.stddev_pop("kth")).alias("kth_std"), _r(F.percentile("kth", 0.1)).alias("kth_p10"), _r(F.percentile("kth", 0.9)).alias("kth_p90"),
        _r(F.avg("top")).alias("top_mean"), _r(F.stddev_pop("top")).alias("top_std"),
    )


def set_sizes(per_query: DataFrame) -> DataFrame:
    """One row: how many documents each query lets pass (n_pos of `counts` without a guard), and how many queries let none."""
    n = F.col("n_pos")
    p = F.percentile(n, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return per_query.agg(F.count("*").alias("queries"), _r(F.avg(n)).alias("mean"), _r(p[0]).alias("p10"), _r(p[1]).alias("median"), _r(p[2]).alias("p90"), F.max(n).alias("largest"), _r(F.avg((n == 0).cast("double"))).alias("empty_rate"))


def prefix_f1(ranked: DataFrame) -> DataFrame:
    """(query_id, f1, at): the best F1 that any prefix of a query's ranking reaches, from the ranks of its relevant documents (query_id, rank); a prefix that does not end with one is worse than the one before."""
    s = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("r"))  # a query's relevant documents
    at = F.transform("r", lambda x, i: F.struct(F.round(2.0 * (i + 1) / (x + F.size("r")), DIGITS).alias("f1"), (-x).alias("back")))
    return s.select("query_id", F.array_max(at).alias("b")).select("query_id", F.col("b.f1").alias("f1"), (-F.col("b.back")).cast("long").alias("at"))


#: Bins of scores that a query's ranking is counted in: so many millionths wide. Queries of a bin kernel that are scored
#: at a time; queries whose counts are put together at a time.
WIDE, FEW, MERGED = 1_000, 64, 128
BINS = 2 * 10**DIGITS // WIDE + 1


def _codes(own, doc, d) -> tuple[np.ndarray, np.ndarray]:
    """Scores in millionths and their bins; a query itself and what has no score are in bin BINS, beyond all others."""
    with np.errstate(invalid="ignore"):
        code = np.rint(X.scores_of(own, doc, d, masked=np.nan) * 10**DIGITS)
        there = np.isfinite(code)
        code = np.where(there, code, 0).astype(np.int64)
    return code, np.where(there, np.clip((code + 10**DIGITS) // WIDE, 0, BINS - 1), BINS)


def best_prefix(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """`prefix_f1` over all documents (doc_id, v, label), where those of a query's label (query_id, v, label) but itself are relevant. No list of these is made.

    First, documents and relevant ones are counted in bins of scores. With these counts a bin has a bound for the F1
    of prefixes that end in it; where it is below what the end of some bin reaches, the bin is left out. Of the other
    bins, mostly few documents, the documents are ranked one by one.
    """
    spark, kind = docs.sparkSession, dict(queries.dtypes)["query_id"]
    q = queries.select("query_id", "v", "label").where("label is not null")

    def count(own, doc, d, label):
        label = label.to_numpy()
        for i in range(0, own.num_rows, FEW):
            part = own.slice(i, FEW)
            n = part.num_rows
            at = _codes(part, doc, d)[1] + np.arange(n)[:, None] * (BINS + 1)
            every = np.bincount(at.ravel(), minlength=n * (BINS + 1))
            good = np.bincount(at[part["label"].to_numpy()[:, None] == label[None, :]], minlength=n * (BINS + 1))
            both = np.stack([x.reshape(n, -1)[:, :BINS] for x in (every, good)], axis=1).astype(np.uint16)  # a run has no more documents
            yield pa.RecordBatch.from_arrays([part["query_id"].combine_chunks(), pa.array([x.tobytes() for x in both], pa.binary())], ["query_id", "counts"])

    counted = X.blocks(q, docs, count, f"query_id {kind}, counts binary", more=("label",))

    def bounds(t):
        total = {}
        for i, c in zip(t["query_id"].to_pylist(), t["counts"]):
            c = np.frombuffer(c.as_buffer(), np.uint16).reshape(2, BINS)[:, ::-1]  # from the best score on
            total[i] = total[i] + c if i in total else c.astype(np.int64)
        ids, masks, bases = [], [], []
        for i, c in total.items():
            (n, r), (ends, found) = c, c.cumsum(axis=1)
            if not found[-1]:
                continue
            most = 2.0 * found / (ends - n + r + found[-1])  # all relevant ones of the bin first
            least = (2.0 * found / (ends + found[-1])).max()
            open_ = np.flatnonzero((r > 0) & (most >= least - 2 * 10.0**-DIGITS))
            mask = np.zeros(BINS + 1, bool)
            mask[BINS - 1 - open_] = True
            ids.append(i)
            masks.append(np.packbits(mask).tobytes())
            bases.append([{"bin": int(BINS - 1 - b), "before": int(ends[b] - n[b]), "found": int(found[b] - r[b]), "n_rel": int(found[-1])} for b in open_])
        return pa.table([pa.array(ids, own_type), pa.array(masks, pa.binary()), pa.array(bases, base_type)], names=["query_id", "mask", "bins"])

    own_type = spark.createDataFrame([], f"query_id {kind}").toArrow()["query_id"].type
    base_type = pa.list_(pa.struct([("bin", pa.int32()), ("before", pa.int64()), ("found", pa.int64()), ("n_rel", pa.int64())]))
    spread = F.pmod(F.xxhash64("query_id"), F.lit(max(1, q.count() // MERGED)))
    known = cut(counted.groupBy(spread.alias("g")).applyInArrow(bounds, f"query_id {kind}, mask binary, bins array<struct<bin:int,before:long,found:long,n_rel:long>>"))

    def listed(own, doc, d, label):
        label = label.to_numpy()
        for i in range(0, own.num_rows, FEW):
            part = own.slice(i, FEW)
            code, at = _codes(part, doc, d)
            masks = np.unpackbits(np.stack([np.frombuffer(m.as_buffer(), np.uint8) for m in part["mask"]]), axis=1)
            r, x = np.nonzero(np.take_along_axis(masks, at, axis=1))
            yield pa.RecordBatch.from_arrays(
                [part["query_id"].combine_chunks().take(pa.array(r)), pa.array(doc[x]), pa.array(code[r, x]), pa.array(at[r, x].astype(np.int32)), pa.array(part["label"].to_numpy()[r] == label[x])], ["query_id", "doc_id", "code", "bin", "good"]
            )

    asked = q.join(known.select("query_id", "mask"), "query_id")
    one = X.blocks(asked, docs, listed, f"query_id {kind}, doc_id {dict(docs.dtypes)['doc_id']}, code long, bin int, good boolean", more=("label",), row_bytes=BINS // 8 + 16)
    w = W.partitionBy("query_id", "bin").orderBy(F.desc("code"), "doc_id")
    one = one.withColumn("place", F.row_number().over(w)).withColumn("nth", F.sum(F.col("good").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("good")
    one = one.join(known.select("query_id", F.inline("bins")), ["query_id", "bin"])
    rank = F.col("before") + F.col("place")
    best = one.select("query_id", F.struct(F.round(2.0 * (F.col("found") + F.col("nth")) / (rank + F.col("n_rel")), DIGITS).alias("f1"), (-rank).alias("back")).alias("b")).groupBy("query_id").agg(F.max("b").alias("b"))
    return best.select("query_id", F.col("b.f1").alias("f1"), (-F.col("b.back")).cast("long").alias("at"))
