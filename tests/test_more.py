"""Streams, caches, preparation from end to end, and blocks of queries and documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions import text as T
from vectorloom.operators import preparation as P
from vectorloom.operators import reports as R
from vectorloom.operators import retrieval as X
from vectorloom.operators import thresholds as H
from vectorloom.sources import datasets as D
from vectorloom.streaming import results as ST


def test_stream_keeps_the_latest_rows(spark, tmp_path):
    """Seven batches with a compaction after every third; the table is the latest row of each key whenever it is read."""
    schema, key, order = "id long, at long, v string", ["id"], [F.col("at")]
    target, want = f"{tmp_path}/table", {}
    for i in range(7):
        rows = [(k, 10 * i + k % 3, f"{i}-{k}") for k in range(i, i + 4)] + [(0, i, "late")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        for k, at, v in rows:
            if at >= want.get(k, (-1, ""))[0]:
                want[k] = (at, v)
        ST.keep_latest(ST.read_stream(spark, f"{tmp_path}/in", schema), key, order, target, f"{tmp_path}/checkpoint", compact=3, once=True).awaitTermination()
        assert {r["id"]: (r["at"], r["v"]) for r in ST.read_latest(spark, target, schema, key, order).collect()} == want
    assert ST._versions(spark, f"{target}/base") == [5] and ST._versions(spark, f"{target}/delta") == [6]


def test_windowed_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:01:00", 2.0), ("2024-01-01 00:02:00", 4.0), ("2024-01-01 00:20:00", 1.0)], "at string, v double").coalesce(1).write.json(f"{tmp_path}/in")
    stream = ST.read_stream(spark, f"{tmp_path}/in", "at timestamp, v double")
    ST.windowed(stream, "at", "v").writeStream.outputMode("append").format("memory").queryName("closed").trigger(availableNow=True).start().awaitTermination()
    assert [(r["n"], r["mean"]) for r in spark.table("closed").collect()] == [(2, 3.0)]


def tables(spark, n=120, dim=8, step=4):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, dim))
    x[10] = x[11]  # equal scores
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, v array<double>").repartition(3)
    return x, d.where(f"doc_id % {step} = 0").withColumnRenamed("doc_id", "query_id"), d


@pytest.mark.parametrize("chunk", [1 << 20, 500])
def test_blocks_give_the_same_broadcast_or_shuffled(spark, chunk):
    x, q, d = tables(spark)
    s = np.round(x[::4] @ x.T, 6)
    got = {}
    for r in X.topk(q, d, 3, chunk_bytes=chunk, doc_block=50).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    for row, i in zip(s, range(0, 120, 4)):
        best = sorted((-row[j], j) for j in range(120) if j != i)[:3]
        assert sorted(got[i]) == [(k + 1, j) for k, (_, j) in enumerate(best)]


def test_ranks_counts_and_histograms_without_pairs(spark):
    x, q, d = tables(spark)
    s = np.round(x[::4] @ x.T, 6)
    pairs = spark.createDataFrame([(i, j) for i in range(0, 120, 4) for j in (1, 10, 11, 50, i)], "query_id long, doc_id long")
    for r in X.ranks_of(pairs, q, d).collect():
        row = s[r["query_id"] // 4]
        order = sorted((-row[j], j) for j in range(120) if j != r["query_id"])
        assert order[r["rank"] - 1][1] == r["doc_id"] != r["query_id"]
    flat = np.concatenate([np.delete(row, i) for row, i in zip(s, range(0, 120, 4))])
    code, n = H._bins(X.histogram(q, d))
    assert np.array_equal(np.repeat(code, n), np.sort(np.rint(flat * 1e6).astype(int)))
    p = np.array([0, 0.1, 0.5, 0.987, 1])
    assert np.allclose(H._quantiles(code, n, p), np.quantile(flat, p), atol=1e-9)
    w = q.join(q.select("query_id", F.col("v").alias("w")), "query_id")
    c = {r["query_id"]: r for r in H.confusion(H.counts(w, d, 0.9, 0.3, 0.05)).collect()}
    assert sum(r["n_pos"] for k, r in c.items() if k is not None) == (flat >= 0.35).sum() == c[None]["n_pos"]
    none = next(r for k, r in c.items() if k is not None and not r["n_pred"])
    assert none["precision"] is None and none["recall"] == 0  # undefined, not 0, where nothing passes


def test_text_functions_after_their_definition(spark):
    good = "Word " * 20 + "ends here."
    lines = [good, "* " + good, "• " + good, good + " ”", good[:-1], good + "\tx.", "a|" + good, "Slovo může znamenat " + good, "Short one.", "12345 67890 " * 12 + "ends.", " " + good + " ", None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    assert {r["i"] for r in df.where(T.is_paragraph(F.col("x"), 10, 60)).collect()} == {0, 3, 10}
    one = spark.createDataFrame([("\n1. first thing?\n- *second* (2)\n•\tthird .\nab\n" + "y" * 201, "m-a-gptq-Q3_K-scifact_synth_only" + T.NAME_END + ".gguf")], "t string, n string")
    r = one.select(T.clean_lines(F.col("t"), 5).alias("l"), T.parse_file_name(F.col("n")).alias("p"), T.parse_file_name(F.lit("other.gguf")).alias("none")).first()
    assert r["l"] == ["first thing?", "second* (", "third"] and r["p"].asDict() == {"model": "m-a", "grid": "Q3_K", "calib": "scifact_synth_only"} and r["none"] is None
    arm = lambda c: spark.range(1).select(T.arm(F.lit(c), F.lit("scifact")).alias("a")).first()["a"]
    assert [arm(c) for c in ("generic_wikitext", "generic_cs", "scifact_corpus_only", "scifact_synth_noleak", "nfcorpus_corpus_only", "x")] == ["generic_en", "generic_cs", "corpus", "synth", None, None]


def test_embedding_cache(spark, tmp_path):
    c = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "id string, embedding array<double>")
    path = f"{tmp_path}/cache"
    D.save_embeddings(path, c, c.limit(1), {"teacher": "t", "split": "test"})
    got = D.load_embeddings(spark, path)
    assert got["meta"].first()["about"]["teacher"] == "t" and got["meta"].first()["dim"] == 2 and got["corpus"].count() == 2
    c.write.mode("append").parquet(f"{path}/corpus")
    with pytest.raises(ValueError, match="provenance"):
        D.load_embeddings(spark, path)
    with pytest.raises(ValueError, match="numbers"):
        D.save_embeddings(path, c.unionByName(spark.createDataFrame([("c", [1.0])], "id string, embedding array<double>")), c, {})
    with pytest.raises(FileNotFoundError):
        D.load_embeddings(spark, f"{tmp_path}/none")


def test_values_of_each_query_are_replaced_by_system(spark, tmp_path):
    frame = lambda system, v: spark.createDataFrame([("q1", "ndcg", v, "d", system), ("q2", "ndcg", v, "d", system)], "query_id string, metric string, value double, dataset string, system string")
    path = f"{tmp_path}/values"
    D.save_per_query(frame("a", 0.1).unionByName(frame("b", 0.2)), path)
    D.save_per_query(frame("b", 0.5), path)
    assert {(r["system"], r["value"]) for r in D.load_per_query(spark, path).collect()} == {("a", 0.1), ("b", 0.5)}
    assert D.load_per_query(spark, path, "d", "a").count() == 2 and D.load_per_query(spark, path, "none").count() == 0


def test_build_drops_what_leads_nowhere(spark):
    text = " ".join(f"w{i}" for i in range(60))
    corpus = spark.createDataFrame([(1, text), (2, text.upper()), (3, text + " more"), (4, "other words"), (5, "what now")], "doc_id long, text string")
    queries = spark.createDataFrame([(f"q{i}", "what now" if i == 3 else "t") for i in range(12)], "query_id string, text string")
    train = spark.createDataFrame([(f"q{i}", 1, 1) for i in range(6)], "query_id string, doc_id long, grade long")
    test = spark.createDataFrame([("q7", 2, 2), ("q8", 3, 1), ("q9", 99, 1), ("q10", 4, 0)], "query_id string, doc_id long, grade long")
    out = P.build(corpus, queries, {"train": train, "test": test}, None, 1)
    m = out["meta"].first()
    assert (m["n_docs"], m["exact_removed"], m["dangling"], m["orphaned"], m["query_dups"], m["split_source"]) == (4, 1, 1, 1, 1, "dev_from_train")
    assert {r["query_id"] for r in out["queries"].collect()} == {"q0", "q1", "q2", "q3", "q4", "q5", "q7", "q8", "q10"}  # q11 is in no split, q9 has no document
    assert {r["query_id"] for r in out["flagged"].collect()} == {"q7", "q8"} and m["graded"] is True and m["n_train"] + m["n_dev"] == 6 and m["n_test"] == 3


def test_reservoir_keeps_what_it_must(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"))
    keep = spark.createDataFrame([(5,), (6,), (6,)], "doc_id long")
    got, stats = P.reservoir(docs, keep, 30, 3)
    ids = {r["doc_id"] for r in got.collect()}
    assert len(ids) == 30 and {5, 6} <= ids and stats.first().asDict() == {"raw_total": 100, "kept": 2, "negatives_seen": 98}
    assert P.minhash_params(50_000) == (64, 2000) and P.minhash_params(50_001) == (32, 800)


def test_reports_of_what_is_missing(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", float("nan")), ("b", "x", None)], "g string, arm string, v double")
    assert [tuple(r) for r in R.arms_compared(df, ["g"], "arm", "v", "x", "y").collect()] == [("a", 1.0, 1.0, 3.0, 3.0, 3.0, False)]
    assert {r["g"]: r["mean"] for r in R.tail_mean(df, ["g"], [F.col("arm")], "v", 1).collect()} == {"a": 3.0, "b": None}
    assert [tuple(r) for r in R.pivot_measures(df, "g", "arm", ["x", "y"], {"n": F.count(F.lit(1))}).orderBy("g").collect()] == [("a", "1", "1"), ("b", "2", "–")]
    known = R.best_known(df.select("g").distinct().unionByName(spark.createDataFrame([("c",)], "g string")), "g", [("one", spark.createDataFrame([("a", 9.0)], "g string, v double"))], "v", {"b": 2.0})
    assert {tuple(r) for r in known.collect()} == {("a", 9.0, "one"), ("b", 2.0, "constant"), ("c", None, None)}


def test_log_and_name_parsing(spark):
    log = ["a", " ggml_webgpu: adapter_info x ", "offloaded 3/28 layers to GPU", "model buffer size 1", "model buffer size 2", "ggml_webgpu: Failed y"]
    df = spark.createDataFrame([(log, "webgpu"), (log[:1], "webgpu"), (log[:1], "cpu"), (["ggml_webgpu: adapter_info", "offloaded 0/28 layers to GPU"], "webgpu")], "l array<string>, r string")
    got = [r["g"] for r in df.select(T.gpu_evidence(F.col("l"), F.col("r")).alias("g")).collect()]
    assert [(g["layers"], g["active"], g["fallback"]) for g in got] == [("3/28", True, False), (None, False, True), (None, False, False), ("0/28", False, True)]
    assert got[0]["adapter"] == "ggml_webgpu: adapter_info x" and len(got[0]["buffers"]) == 2 and len(got[0]["errors"]) == 1
    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    tag = "Q2_K-nfcorpus_synth_only-ps20000-t300k-ao-tabQ2_K"
    assert one(T.describe_calibration(F.lit(tag))) == "nfcorpus_synth_only: synthetic queries (doc2query, Qwen3-1.7B) in the E5 query format, per-sample, act-order, token budget 300k"
    assert one(T.describe_calibration(F.lit("other"))) == "other"
    assert tuple(one(T.calibration_tokens(F.lit("n_seq=12 per_sample")))) == (12, 6144) and one(T.calibration_tokens(F.lit("nothing"))) is None


def test_documents_must_have_vectors(spark):
    d = spark.createDataFrame([(i,) for i in range(8)], "doc_id long")
    v = spark.createDataFrame([(i, [1.0]) for i in (1, 9)], "doc_id long, embedding array<double>")
    with pytest.raises(ValueError, match=r"\[0, 2, 3, 4, 5\]"):
        P.align(d, v)
    both, extra = P.align(d.where("doc_id = 1"), v)
    assert both.count() == 1 and [r["doc_id"] for r in extra.collect()] == [9]
    s = spark.createDataFrame([(2, "a", "test"), (0, "c", "test"), (1, "b", "test"), (0, "d", "dev")], "pos int, query_id string, split string")
    assert [r["query_id"] for r in P.members(s, "test", spark.createDataFrame([("a",), ("c",)], "query_id string")).collect()] == ["c", "a"]


def test_choosing_a_client(spark):
    known = spark.createDataFrame([(1, "b"), (0, "a")], "pos int, id string")
    assert [R.choose(known, "id", *x) for x in ((None, None), (None, "b"), ("b", "a"), (None, "gone"))] == ["a", "b", "b", "a"]
    with pytest.raises(KeyError):
        R.choose(known, "id", "gone", None)
    sets = P.calibration_sets(spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([(1, "y")], "query_id long, text string"), 3)
    assert {k: v.count() for k, v in sets.items()} == {"corpus_only": 1, "synth_only": 1, "corpus_synth": 2}


def test_index_and_vector_files(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "a.f32").write_bytes(x.tobytes())
    np.save(tmp_path / "b.npy", x)
    assert [r["embedding"] for r in D.read_vectors(spark, str(tmp_path / "a.f32"), rows=4).orderBy("pos").collect()] == x.tolist()
    assert D.read_vectors(spark, str(tmp_path / "b.npy")).count() == 4
    for how in ({"dim": 5}, {"rows": 5}, {"dim": 3, "rows": 3}, {}):
        with pytest.raises(Exception, match="vectors"):
            D.read_vectors(spark, str(tmp_path / "a.f32"), **how).collect()
    spark.createDataFrame([(0, [1, -2], 0.5), (1, [3, 4], 2.0)], "pos long, codes array<int>, scale double").write.parquet(str(tmp_path / "index"))
    assert [r["embedding"] for r in D.load_index(spark, str(tmp_path / "index"), 2, 2).orderBy("pos").collect()] == [[0.5, -1.0], [6.0, 8.0]]
    with pytest.raises(ValueError, match="mismatch"):
        D.load_index(spark, str(tmp_path / "index"), 2, 3)
    docs = spark.createDataFrame([(i, f"d{i}") for i in range(7)], "pos long, id string")
    D.write_doc_shards(docs, str(tmp_path / "shards"), "pos", 3)
    got = spark.read.json(str(tmp_path / "shards")).orderBy("shard").collect()
    assert [(r["first_index"], [x["id"] for x in r["docs"]]) for r in got] == [(0, ["d0", "d1", "d2"]), (3, ["d3", "d4", "d5"]), (6, ["d6"])]
    D.write_shards(docs, str(tmp_path / "ranges"), "pos", 10, 30)
    assert sum(r["rows"] for r in D.shard_counts(spark, str(tmp_path / "ranges")).collect()) == 7
    assert set(D.by_split({"validation": docs, "dev": docs, "test": docs})) == {"dev", "test"} and D.by_split({"validation": docs, "dev": docs})["dev"].count() == 14


def test_the_grid_of_penalties_finds_the_map(spark):
    rng = np.random.default_rng(5)
    w, x = rng.normal(size=(4, 4)), rng.normal(size=(200, 4))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, x @ w))], "i int, x array<double>, y array<double>")
    from vectorloom.operators import quant as Q

    best, tried = Q.ridge_grid(df.where("i < 160"), df.where("i >= 160"), "x", "y")
    assert np.abs(best - w).max() < 0.05 and tried[0][2] > 0.999 and tried[0][2] > tried[-1][2] and tried[-1][0] == "rotation"
