"""Edge cases of data preparation, and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions import text as T
from vectorloom.operators import preparation as P
from vectorloom.operators import quant as Q
from vectorloom.sources import datasets as D


def test_exact_groups_and_remap(spark):
    c = spark.createDataFrame([("d1", "A  b"), ("d2", "a B "), ("d3", None), ("d4", "  ")], "doc_id string, text string")
    g = P.exact_groups(c, F.col("text"))
    assert {r["doc_id"]: r["canonical"] for r in g.collect()} == {"d1": "d1", "d2": "d1", "d3": "d3", "d4": "d3"}
    q = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 2), ("q", "x", 1)], "query_id string, doc_id string, grade int")
    assert {(r["doc_id"], r["grade"]) for r in P.remap_qrels(q, g).collect()} == {("d1", 2), ("x", 1)}


def test_shingles_and_groups(spark):
    long = " ".join(f"w{i}" for i in range(60))
    c = spark.createDataFrame([(1, long), (2, long + " more"), (3, "two words"), (4, "TWO  words"), (5, ""), (6, None), (7, "other")], "doc_id long, text string")
    n = {r["doc_id"]: r["n"] for r in P.shingle_sets(c, F.col("text")).collect()}
    assert n == {1: 56, 2: 57, 3: 1, 4: 1, 7: 1}
    assert {(r["doc_id"], r["group_id"]) for r in P.groups(P.near_pairs(c, F.col("text"))).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}


@pytest.mark.parametrize(("pools", "tag"), [(("train", "dev", "test"), "native"), (("train", "test"), "dev_from_train"), (("train", "dev"), "test_from_train"), (("test",), "synthetic_from_test"), (("train",), "synthetic_from_train"), (("dev",), "synthetic_from_dev")])
def test_splits_partition_the_ids(spark, pools, tag):
    dfs = {p: spark.createDataFrame([(f"{p}{i}",) for i in range(20)], "query_id string") for p in pools}
    s, how = P.ensure_splits(dfs, 3)
    rows = s.collect()
    assert how == tag and len({r["query_id"] for r in rows}) == len(rows) == 20 * len(pools)
    assert {r["split"] for r in rows} == {"train", "dev", "test"} and P.overlapping_splits(s).count() == 0


def test_no_pool_is_an_error():
    with pytest.raises(ValueError):
        P.ensure_splits({}, 1)


def test_query_judged_zero_is_no_orphan(spark):
    q = spark.createDataFrame([("a", "t"), ("b", "t")], "query_id string, text string")
    r = spark.createDataFrame([("a", "d", 0)], "query_id string, doc_id string, grade int")
    assert [x["query_id"] for x in P.orphans(q, r).collect()] == ["b"]


def test_prompt_without_any_is_an_error(spark):
    df = spark.range(1).select(T.instruction(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("p"))
    with pytest.raises(Exception, match="no prompt"):
        df.collect()


def test_dataset_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("d1", None, "x\ty"), ("d2", "T", None)], "doc_id string, title string, text string")
    q = spark.createDataFrame([("q1", 'a "b"')], "query_id string, text string")
    r = spark.createDataFrame([("q1", "d1", 2)], "query_id string, doc_id string, grade int")
    s = spark.createDataFrame([("q1", "test", 1), ("q0", "test", 0)], "query_id string, split string, pos int")
    D.save(str(tmp_path), c, q, r, s, spark.createDataFrame([(1,)], "n int"))
    got = D.load(spark, str(tmp_path))
    assert {(x["doc_id"], x["title"], x["text"]) for x in got["corpus"].collect()} == {("d1", "", "x\ty"), ("d2", "T", "")}
    assert [tuple(x) for x in got["qrels"].collect()] == [("q1", "d1", 2)] and got["queries"].first()["text"] == 'a "b"'
    assert {(x["pos"], x["query_id"]) for x in got["splits"].collect()} == {(0, "q0"), (1, "q1")}
    with pytest.raises(FileNotFoundError):
        D.load(spark, str(tmp_path / "none"))


def test_other_sources(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("file\tlabel\tp50\tp95\nf\ta\t1\t2\nf\ta\t3\t4\nbad\nf\tb\tx\t1\n")
    assert [tuple(r) for r in D.read_latency(spark, str(tmp_path / "l.tsv")).collect()] == [("f", "a", 3.0, 4.0)]
    (tmp_path / "v.f32").write_bytes(np.arange(6, dtype="<f4").tobytes())
    assert [list(r["embedding"]) for r in D.read_vectors(spark, str(tmp_path / "v.f32"), 3).orderBy("pos").collect()] == [[0, 1, 2], [3, 4, 5]]
    np.save(tmp_path / "v.npy", np.ones((2, 3), np.float32))
    assert D.read_vectors(spark, str(tmp_path / "v.npy"), 3).count() == 2
    (tmp_path / "i.jsonl").write_text('{"_id": "a", "text": " t "}\n{"id": "b", "title": "x"}\n')
    assert {tuple(r) for r in D.read_import(spark, str(tmp_path / "i.jsonl")).collect()} == {("a", "", "t"), ("b", "x", "")}
    (tmp_path / "r.jsonl").write_text('{"a": 1}\nnot json\n{"b": "x"}\n')
    assert D.read_log(spark, str(tmp_path / "r.jsonl"), "a int, b string").count() == 2
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq\td\t2.5\nq\te\t-1\n")
    assert [r["grade"] for r in D.read_beir_qrels(spark, str(tmp_path / "q.tsv")).collect()] == [2, 0]
    (tmp_path / "p.txt").write_text("one\ntwo\n\n\nthree\n")
    assert [r["text"].strip() for r in D.read_paragraphs(spark, str(tmp_path / "p.txt")).collect()] == ["one\ntwo", "three"]


def test_block_layouts():
    """Sizes and places of the two layouts, their round trip, and that the clip search is no worse than the plain range."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 256)) * 0.05
    x[0], x[1], x[2] = 0, 0.3, -rng.random(256)
    for bits, size in ((2, 84), (3, 110)):
        p = Q.quantise(x, bits)
        raw = Q.to_bytes(p)
        assert raw.shape == (20, size) and Q.bits_per_weight(bits) == size * 8 / 256
        back = Q.from_bytes(raw, bits)
        assert back.keys() == p.keys() and all(np.array_equal(p[k], back[k]) for k in p)
        assert np.abs(Q.restore(back)[3:] - x[3:]).mean() < 0.05 / bits and not Q.restore(back)[0].any()
        # weights of columns move the errors to where they count less
        w = np.ones((20, 256))
        w[:, ::2] = 100
        e = (Q.restore(Q.quantise(x, bits, w)) - x) ** 2
        assert e[3:, ::2].sum() <= ((Q.restore(p) - x) ** 2)[3:, ::2].sum()
    # one code 1 at place 32 of the first half is bits 2 and 3 of byte 0 of the codes; a scale of 5 is a low nibble
    one = {"bits": 2, "codes": np.zeros((1, 256), int), "scales": np.full((1, 16), 5), "minima": np.full((1, 16), 2), "d": np.array([0.5]), "dmin": np.array([0.25])}
    one["codes"][0, 32] = 1
    raw = Q.to_bytes(one)[0]
    assert raw[0] == 5 | 2 << 4 and raw[16] == 1 << 2 and raw[17:80].sum() == 0 and raw[80:82].tobytes() == np.float16(0.5).tobytes()
    three = {"bits": 3, "codes": np.full((1, 256), -4), "scales": np.arange(-32, -16)[None, :], "d": np.array([1.0])}
    three["codes"][0, 33] = 3
    raw = Q.to_bytes(three)[0]
    assert raw[1] == 2 and raw[32 + 1] == 3 << 2 and raw[:32].sum() == 2 and raw[96] == 0 | 8 << 4 and raw[97] == 1 | 9 << 4 and raw[104:108].sum() == 0
