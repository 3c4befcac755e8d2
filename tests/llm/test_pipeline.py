"""The pipeline's stages, one after another, against plain versions on a small table."""

import collections

import numpy as np
import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from vectorloom.llm import mixing
from vectorloom.llm.tokens import PieceEncoder

from .test_operators import plain_classes, words


def table(tmp_path, spark):
    rng, rows, labels = np.random.default_rng(11), [], []
    for i in range(300):
        w = words(700 + i, 40, 900)
        if i % 6 == 0:
            for p in rng.integers(0, 40, 4):
                w[p] = ["vile", "brute", "fiend"][int(rng.integers(3))]
        rows.append((i, " ".join(w), "en", ["a", "b", None][i % 3], 0))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + i, rows[i][1] + " ", "en", "a", 0) for i in (1, 2, 3)]
    rows += [(2000 + i, rows[i][1] + " tail", "en", "b", 0) for i in (4, 5)]
    rows += [(3000, None, "en", "a", 0), (3001, "", "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = table(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    out = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        out[name] = docs
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    ids = lambda n: sorted(r["doc_id"] for r in out[n].collect())
    clean = [r for r in rows if not (r[0] < 300 and r[0] % 6 == 0)]
    assert ids("toxicity") == sorted(r[0] for r in clean)
    longest = {}
    for r in sorted(clean, key=lambda r: (-len(r[1] or ""), r[0])):
        longest.setdefault("".join((r[1] or "").split()), r)
    assert ids("exact_dedup") == sorted(r[0] for r in longest.values())
    left = list(longest.values())
    # one of each component stays, and empty texts stay
    assert ids("near_dedup") == sorted(d for d, _, c in plain_classes([r[:2] for r in left], 5) if d == c)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in out["near_dedup"].collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    for r in out["mixing"].collect():
        taken[r["source"]] += len(r["text"].split())
    goal = mixing.targets(dict(sizes))
    assert all(abs(taken[s] - goal[s]) < 1 for s in goal)
    enc = PieceEncoder(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    total = sum(len(x) // 2 + 1 for x in enc.encode(pa.array([r["text"] for r in out["mixing"].collect()])).to_pylist())
    packed = out["packing"].collect()
    assert sum(r["length"] for r in packed) == total
    assert sum(r["length"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == total
