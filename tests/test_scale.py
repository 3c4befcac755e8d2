"""Judgements by labels, bounded kernels and what is read more than once: the same results as from rows of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import metrics as M
from vectorloom.operators import preparation as P
from vectorloom.operators import retrieval as X
from vectorloom.operators import thresholds as H
from vectorloom.plans import catalogue as C


def labelled(spark, n=400, step=5, dim=6, copies=1):
    rng = np.random.default_rng(3)
    v = np.repeat(rng.standard_normal((n // copies, dim)), copies, axis=0)
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(int(i), x.tolist(), None if i == 7 else int(i * i % 5), 2 if i % 3 == 0 else 1) for i, x in enumerate(v)] + [(9001, None, 1, 1), (9002, v[0].tolist(), 77, 1)]
    d = spark.createDataFrame(rows, "doc_id long, v array<double>, label int, grade int").cache()
    q = d.where(f"doc_id % {step} = 0 or doc_id in (7, 9002)").withColumnRenamed("doc_id", "query_id")
    return q, d


def pairs(q, d):
    return d.select("doc_id", "label", "grade").join(q.select("query_id", F.col("label").alias("l")), (F.col("label") == F.col("l")) & (F.col("query_id") != F.col("doc_id"))).select("query_id", "doc_id", "grade")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("copies", [1, 20])
def test_best_prefix_equals_that_of_all_ranks(spark, copies):
    q, d = labelled(spark, copies=copies)
    assert rows(H.best_prefix(q, d)) == rows(H.prefix_f1(X.ranks_of(pairs(q, d).where("doc_id != 9001"), q, d)))


def test_best_prefix_sends_no_lists_of_relevant_documents(spark, monkeypatch):
    q, d = labelled(spark)
    sent, blocks = [], X.blocks
    monkeypatch.setattr(X, "blocks", lambda own, *a, **k: sent.append([t for _, t in own.dtypes]) or blocks(own, *a, **k))
    H.best_prefix(q, d).collect()
    assert len(sent) == 2 and all("array<bigint>" not in t for t in sent)


def test_judgements_by_labels_equal_those_by_pairs(spark):
    q, d = labelled(spark)
    q = q.unionByName(q.where("query_id = 10")).unionByName(q.where("query_id = 15").withColumn("label", F.lit(2)))  # ids that repeat
    ranked, j, p = X.topk(q.dropDuplicates(["query_id"]), d, 100), M.SameLabel(q, d), pairs(q, d)
    assert rows(M.evaluate(ranked, j, q)) == rows(M.evaluate(ranked, p, q))
    assert rows(M.evaluate_run(ranked, j)) == rows(M.evaluate_run(ranked, p))


def test_no_judged_pair_is_a_row(spark):
    """What is joined and aggregated for the ideal rankings has a row for each query and grade, not for each pair."""
    q, d = labelled(spark)
    assert isinstance(C.judged(q, d.drop("grade")), M.SameLabel)
    assert M.SameLabel(q, d)._counts().count() <= 2 * q.count() and M.SameLabel(q, d).ideal((10,)).count() <= q.count()


def test_near_pairs_join_a_tenth_of_the_items_and_miss_none(spark, monkeypatch):
    """Texts with a common beginning: whatever is held for frequent, and with ids broadcast or not, pairs are those of a plain comparison."""
    rng, text = np.random.default_rng(5), {}
    for i in range(60):
        w = [f"w{x}" for x in rng.integers(0, 400, 60)]
        text[2 * i] = "the same few words begin every one of these texts " + " ".join(w)
        w[int(rng.integers(0, 60))] = "other"
        text[2 * i + 1] = text[2 * i] if i % 7 == 0 else "the same few words begin every one of these texts " + " ".join(w)
    c = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in text.items()}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    for few, known in ((P.FEW_IDS, 10), (0, 0)):
        monkeypatch.setattr(P, "FEW_IDS", few)
        monkeypatch.setattr(P, "FREQUENT", known)
        assert {(r["a"], r["b"]): r["jaccard"] for r in P.near_pairs(c, F.col("text"), 0.8).collect()} == want
    s = P.shingle_sets(c, F.col("text")).withColumnRenamed("doc_id", "rep")
    got = P.prefixes(s, P.frequent(s, 120), 0.9).groupBy("item").count().orderBy(F.desc("count")).collect()
    assert sum(r["count"] for r in got) <= 120 * 8 and got[0]["count"] <= 4  # of about 65 each; no frequent one
