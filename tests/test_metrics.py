"""The hand-computed ranking example, and properties that must hold for any ranking."""

import math

from pyspark.sql import functions as F

from vectorloom.operators import metrics as M
from vectorloom.operators import reports as R
from vectorloom.operators import retrieval as X
from vectorloom.operators import statistics as S
from vectorloom.operators import thresholds as H


def golden(spark):
    qrels = spark.createDataFrame([("q1", "d1", 2), ("q1", "d2", 1), ("q2", "d5", 1)], "query_id string, doc_id string, grade int")
    run = spark.createDataFrame([("q1", "d1", 3.0), ("q1", "d2", 2.0), ("q1", "d3", 1.0), ("q1", "d4", 0.5), ("q2", "d6", 1.0), ("q2", "d5", 0.5)], "query_id string, doc_id string, score double")
    queries = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "query_id string")
    return X.rank(run), qrels, queries


def test_golden_example(spark):
    got = {r["query_id"]: r for r in M.evaluate(*golden(spark)).collect()}
    assert abs(got["q1"]["ndcg"] - 1) < 1e-6 and abs(got["q2"]["ndcg"] - 1 / math.log2(3)) < 1e-6
    assert [got[q]["recall"] for q in ("q1", "q2")] == [1, 1]
    assert [got[q]["mrr"] for q in ("q1", "q2")] == [1, 0.5] and [got[q]["ap"] for q in ("q1", "q2")] == [1, 0.5]
    # without judgements: one kind of reciprocal rank is 0, everything else is undefined
    assert got["q3"]["mrr_zero"] == 0 and got["q3"]["mrr"] is None and got["q3"]["ndcg"] is None


def test_self_comparison(spark):
    ranked, qrels, queries = golden(spark)
    assert {r["overlap"] for r in M.overlap(ranked, ranked, 2).collect()} == {1.0}
    e = M.evaluate(ranked, qrels, queries)
    i = S.interval(S.differences(e, e, "ndcg"), 50, 1).first()
    assert (i["n"], i["mean"], i["lo"], i["hi"]) == (2, 0, 0, 0)
    assert S.verdict(S.interval(S.differences(e, e, "ndcg"), 50, 1)).first()["verdict"] == "tie"
    p = M.parity(e, e, "ndcg").first()
    assert p["passes"] and p["n_diff"] == 0
    agree = M.order_agreement(ranked, ranked, 4, 0.0).collect()
    assert {r["agreement"] for r in agree} == {1.0}


def test_no_pair_above_gap_is_undefined(spark):
    ranked, _, _ = golden(spark)
    assert {r["agreement"] for r in M.order_agreement(ranked, ranked, 4, 100.0).collect()} == {None}


def test_topk_ties_chunks_and_masks(spark):
    v = [(i, [1.0, 0.0] if i < 4 else [0.0, 1.0]) for i in range(8)]
    d = spark.createDataFrame(v, "doc_id long, v array<double>")
    q = d.withColumnRenamed("doc_id", "query_id")
    want = {i: [x for x in [*range(4), *range(4, 8)] if x != i and (x < 4) == (i < 4)][:2] for i in range(8)}
    for chunk in (1 << 20, 16):
        got = {}
        for r in X.topk(q, d, 2, chunk_bytes=chunk).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert got == want
    assert X.topk(q, d, 100).count() == 56 and X.topk(q, d, 100, mask_self=False).count() == 64
    assert X.topk(q.where("false"), d, 3).count() == 0


def test_theta_without_positives_is_the_highest_score(spark):
    s = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.7)], "query_id long, doc_id long, score double")
    h = H.histogram_of(s)
    assert H.theta_rate(h, h, 2.0).first()["theta"] == 0.7


def test_release_and_latest(spark):
    df = spark.createDataFrame([("a", 99.0, -0.01, 0.95, 0.8), ("b", 99.0, -0.03, 0.95, 0.8), ("c", None, -0.01, 0.95, 0.8)], "f string, percent double, lo double, cos double, overlap double")
    assert {r["f"] for r in R.released(df).where("passes").collect()} == {"a"}
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, None)], "k int, t int, v string")
    assert {(r["k"], r["v"]) for r in R.latest(rows, ["k"], [F.col("t")]).collect()} == {(1, "y"), (2, None)}
