"""The registered queries op1_ to op10_ themselves, on a small awkward table, against plain versions of their contracts."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from vectorloom.llm import entries, learned_ann, quality, toxicity

from .test_operators import plain_classes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    a, b, shared = words(1, 300), words(2, 260), words(3, 80)
    near = list(a)
    near[150] = "changed"
    long = " ".join(words(4, 60_000))
    out = [
        (0, " ".join(a)), (1, " ".join(a[:100] + shared + b[:50])), (2, " ".join(b[:120] + shared + b[120:])), (3, " ".join(a)), (4, "  ".join(near) + "\n"), (5, ""), (6, None), (7, "one two"), (8, "ONE\ttwo"),
        (9, "x" * 500), (10, "é€ " * 150), (11, long), (12, " ".join(a).upper()), (13, " ".join(b) + " "), (14, " \n "), (15, "  nbsp here \x1c x"), (16, long[:100_000]), (17, "ab" * 20_000), (18, "one two"), (19, "\x00 nul \x00"),
    ]
    return [(d, t, ["s", "t", None][d % 3]) for d, t in out]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, key string, row int, part int, size int"
    spark.createDataFrame([(d, t, "en", s, 0, 0.0, "k", 1, 2, 3) for d, t, s in rows()], schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def result(spark, sf, name):
    return [r.asDict() for r in __spark_entry__.queries()[name](spark, sf).collect()]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def spans(gone):
    return sum(1 for k, _ in itertools.groupby(gone) if k)


def test_op1(spark, sf):
    split = [(d, WORD.findall(t or "")) for d, t, _ in rows()]
    first = {}
    for d, w in split:
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    want = {}
    for d, w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = True
        want[d] = (len(w), int(gone.sum()), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in result(spark, sf, "op1_substring_dedup")} == want


def plain_targets(sizes):
    """The level at which shares, each cut at twice its source's size, sum to one and a half of all sizes: found by halving."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    low, high, total = 0.0, 4.0 * sum(sizes.values()), 1.5 * sum(sizes.values())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * weight[s], 2 * sizes[s]) for s in names) < total else (low, mid)
    return {s: min(low * weight[s], 2 * sizes[s]) for s in names}


def test_op2(spark, sf):
    got = result(spark, sf, "op2_mixing")
    size, source = {d: len(WORD.findall(t or "")) for d, t, _ in rows()}, {d: s for d, _, s in rows()}
    of = collections.Counter()
    for d, n in size.items():
        of[source[d]] += n
    goal, taken = plain_targets(of), collections.Counter()
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    for r in got:
        d = r["doc_id"]
        assert (r["size"], r["source_size"]) == (size[d], of[source[d]]) and abs(r["target"] - goal[source[d]]) < 1e-6 * (1 + goal[source[d]]) and 0 <= r["taken"] <= 2 * size[d]
        taken[source[d]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) < 1 for s in goal)
    assert sorted(map(repr, result(spark, sf, "op2_mixing"))) == sorted(map(repr, got))


def test_op3(spark, sf):
    raw = {d: (t or "").encode() for d, t, _ in rows()}
    seen = collections.Counter(t[i : i + 200] for t in raw.values() for i in range(len(t) - 199))
    want = {}
    for d, t in raw.items():
        gone = np.zeros(len(t), bool)
        starts = np.array([seen[t[i : i + 200]] > 1 for i in range(max(0, len(t) - 199))], bool)
        for i in np.flatnonzero(starts):
            gone[i : i + 200] = True
        want[d] = (len(t), int(gone.sum()), spans(gone.tolist()), sha(np.frombuffer(t, np.uint8)[~gone].tobytes()))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in result(spark, sf, "op3_suffix_dedup")} == want


def test_op4(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(20, 8))[rng.integers(0, 20, 600)] + 0.3 * rng.normal(size=(600, 8))).astype(np.float32)
    x[50:60] = x[50]
    table = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (750, [0.0] * 8), (800, [float("nan")] * 8), (850, [None] + [1.0] * 7)]
    spark.createDataFrame(table, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = collections.defaultdict(list)
    for r in sorted(result(spark, str(tmp_path), "op4_learned_ann"), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    d, found = x.astype(np.float64), 0
    assert sorted(got) == list(range(0, 600, 50))
    for q, out in got.items():
        s = learned_ann.cosine(d, np.repeat(d[q : q + 1], 600, 0))
        best = sorted((-s[i], i) for i in range(600) if i != q)[:5]
        found += len({i for _, i in best} & {i for _, i, _ in out})
        assert [k for k, _, _ in out] == [1, 2, 3, 4, 5] and [(-v, i) for _, i, v in out] == sorted((-v, i) for _, i, v in out)
        assert all(abs(v - s[i]) < 1e-15 and i != q for _, i, v in out)
    assert found >= 0.9 * 5 * len(got) and [i for _, i, _ in got[50]] == [51, 52, 53, 54, 55]


def test_op5(spark, sf):
    want = {}
    plain = [(d, t) for d, t, _ in rows()]
    for (d, t), (_, n, c) in zip(sorted(plain), sorted(plain_classes(plain, 4))):
        want[d] = (n, c, d == c)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in result(spark, sf, "op5_near_dedup")} == want


def token_ids(name, end):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.encode_special_tokens = True
    return {d: tok.encode(t or "", add_special_tokens=False).ids + [end] for d, t, _ in rows()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op6(spark, sf):
    want, at = {}, 0
    for d, ids in sorted(token_ids("byte_bpe_50k.json", 0).items()):
        want[d] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in result(spark, sf, "op6_token_output")} == want


def test_op8(spark, sf):
    got, ids = result(spark, sf, "op8_packing"), token_ids("word_bpe_49k.json", 1)
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(part) > 0 and r["ids_crc32"] == crc(part) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for d, x in ids.items():
        at = 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(x)
    padding = 0
    for parts in seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.01 * sum(map(len, ids.values()))


def test_op10(spark, sf):
    groups = collections.defaultdict(list)
    for d, t, _ in rows():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d))
    want = {d: (min(g)[1], len(g), d == min(g)[1], sha(k.encode())) for k, g in groups.items() for _, d in g}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in result(spark, sf, "op10_exact_dedup")} == want


def labelled_table(spark, path, n=500):
    """Documents of two kinds, some rows without a text, blank, or twice; labels of most of them."""
    rng, docs, labels = np.random.default_rng(6), [], []
    for i in range(n):
        w = words(9000 + i, 60, 300)
        bad, rude = i % 4 == 0, i % 5 == 0
        if bad:
            w = [x if rng.random() < 0.6 else "spam!!" for x in w]
        for p in rng.integers(0, 60, 5) if rude else ():
            w[p] = ["vile", "brute", "fiend"][int(rng.integers(3))]
        docs.append((i, " ".join(w), "toxic" if i % 2 else None))
        if i % 7:
            labels.append((i, int(not bad), int(rude)))
    docs += [(n, None, None), (n + 1, "", None), (n + 2, " \n", None), (3, docs[3][1], None), (n + 3, " ".join(words(1, 150_000, 300)), None)]
    spark.createDataFrame(docs, "doc_id long, text string, toxicity string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return n


@pytest.mark.parametrize(("name", "mod", "rest", "cut"), [("op7_quality", 5, 0, 0.3), ("op9_toxicity", 3, 1, 0.7)])
def test_classifiers(spark, tmp_path, name, mod, rest, cut):
    n = labelled_table(spark, tmp_path)
    got = result(spark, str(tmp_path), name)
    assert len(got) == n + 5
    score, right, seen = collections.defaultdict(set), 0, 0
    for r in got:
        d = r["doc_id"]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % mod == rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
        score[d].add(r["score"])
        if d < n and r["held_out"]:
            truth = int(d % 4 != 0) if name == "op7_quality" else int(d % 5 == 0)
            right, seen = right + (r["predicted"] == truth), seen + 1
    assert right >= 0.95 * seen and seen > 50
    assert len(score[3]) == 1 and score[n] == score[n + 1] == score[n + 2]  # repeated rows; null, empty and blank texts
    # what is held out is not learned from: other labels there change nothing
    other = spark.read.parquet(f"{tmp_path}/labels.parquet").collect()
    flip = [(r["doc_id"], *((1 - r["quality"], 1 - r["toxic"]) if zlib.crc32(str(r["doc_id"]).encode()) % mod == rest else (r["quality"], r["toxic"]))) for r in other]
    spark.createDataFrame(flip, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/flipped/labels.parquet")
    spark.read.parquet(f"{tmp_path}/documents.parquet").write.parquet(f"{tmp_path}/flipped/documents.parquet")
    assert {r["doc_id"]: r["score"] for r in result(spark, f"{tmp_path}/flipped", name)} == {r["doc_id"]: r["score"] for r in got}


def test_hinge_fit_is_optimal():
    """Dual coordinate descent against the primal objective: no gap is left between the two."""
    rng = np.random.default_rng(2)
    ratio, y = rng.normal(size=40), (rng.random(120) < 0.4).astype(int)
    rows_ = [np.sort(rng.choice(40, 6, replace=False)) for _ in y]
    w, bias = quality.fit_hinge(rows_, y, ratio, rounds=2000)
    x = np.zeros((120, 41))
    for i, r in enumerate(rows_):
        x[i, r] = ratio[r]
    x[:, 40] = 1
    sign, cost = np.where(y > 0, 1.0, -1.0), quality.PENALTY * 0.5 / np.array([(y == 0).mean(), (y == 1).mean()])[y]
    value = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    best = value(np.append(w, bias))
    v, step = np.zeros(41), 0.05
    for k in range(20_000):  # plain subgradient steps
        v = v - step / (1 + k / 50) * (v - ((cost * sign * (sign * (x @ v) < 1))[:, None] * x).sum(axis=0))
        best_plain = value(v) if not k else min(best_plain, value(v))
    assert best <= best_plain + 1e-4


def test_first_split_of_the_trees_is_the_best_of_all():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    y = (x[:, 2] + 0.3 * rng.normal(size=300) > 0.4).astype(float)
    t = toxicity.Trees(x, y)
    p = 1 / (1 + np.exp(-t.base))
    g, h = np.full(300, p) - y, np.full(300, p * (1 - p) + 1e-6)
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    gains = {(j, i): part(x[:, j] < c) + part(x[:, j] >= c) for j, cuts in enumerate(t.cuts) for i, c in enumerate(cuts)}
    assert t.trees[0][0] == max(gains, key=gains.get) and ((t.sums(x) > 0) == (y > 0)).mean() > 0.9


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_sql_gives_the_same_rows(spark, tmp_path, sf, name):
    """Without the longest texts, which SQL takes long for."""
    duckdb = pytest.importorskip("duckdb")
    spark.read.parquet(f"{sf}/documents.parquet").where("text is null or length(text) < 20000").write.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet/*.parquet')")
    want = c.execute(entries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(repr(tuple(r[n] for n in names)) for r in result(spark, sf, name)) == sorted(map(repr, want.fetchall()))
