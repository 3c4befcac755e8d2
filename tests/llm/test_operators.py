"""Each operator against a plain version on small, awkward tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from vectorloom.llm import exact_dedup, labelled, learned_ann, mixing, near_dedup, packing, quality, substring_dedup, suffix_dedup, token_output, toxicity
from vectorloom.llm.induced_sort import permuted_common_prefixes, suffix_array
from vectorloom.llm.tokens import PieceEncoder, in_chunks

# clashing names among the extra columns
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, did string, whole string, fp int, row string, n int, spans string, kept string, size int"


def frame(spark, rows):
    """rows: (doc_id, text[, source])."""
    out = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, 1, "x", None, 3, "r", 4, "", None, 7) for r in rows]
    return spark.createDataFrame(out, SCHEMA)


def words(seed, n, kinds=4000):
    rng = np.random.default_rng(seed)
    return [f"w{i}" for i in rng.integers(0, kinds, n)]


def corpus():
    a, b, shared = words(1, 300), words(2, 260), words(3, 80)
    near = list(a)
    near[150] = "changed"
    rows = [
        (1, " ".join(a), "s"), (2, " ".join(a[:100] + shared + b[:50]), "s"), (3, " ".join(b[:120] + shared + b[120:]), "t"), (4, " ".join(a), None), (5, "  ".join(near) + "\n", "t"), (6, "", "s"), (7, None, "s"), (8, "one two", "u"),
        (9, "ONE\ttwo", "u"), (10, "x" * 500, "u"), (11, "é€ " * 150, "t"), (12, " ".join(words(4, 3000)), "s"), (13, " ".join(a).upper(), "s"), (None, " ".join(a), "s"), (15, " ".join(b) + " ", "t"), (15, " ".join(b) + " ", "t"), (16, " \n ", None),
    ]
    return rows


def collected(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_windows(rows, n):
    first = {}
    split = [(r[1] or "").encode().split() for r in rows]
    order = [r[0] if r[0] is not None else 1 << 62 for r in rows]
    for d, w in zip(order, split):
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for r, d, w in zip(rows, order, split):
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone |= set(range(i, i + n))
        out.append((r[0], len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [5000, 1])
def test_substring_dedup(docs, none, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    assert collected(substring_dedup.dedup(docs), "doc_id", "n_words", "n_removed", "kept") == plain_windows(corpus(), 50)
    assert substring_dedup.dedup(none).count() == 0


def test_fingerprint_index_merges_runs(spark):
    index = substring_dedup.FingerprintIndex(spark, 2, fan=2)
    found = [index.add(spark.createDataFrame([(f, d, d) for f in fps], "fp long, did long, key long")) for d, fps in ((1, (1, 2)), (2, (2, 3)), (3, (3, 4)), (4, (1, 9)))]
    assert [sorted(r["fp"] for r in f.collect()) for f in found] == [[], [2], [3], [1]]
    assert len(index.runs) == 2  # three of them were compacted
    assert collected(index.holders(found[3]), "fp", "did") == [(1, 1), (1, 4)]
    index.compact()
    assert len(index.runs) == 1 and collected(index.history(), "fp", "did") == [(1, 1), (1, 4), (2, 1), (2, 2), (3, 2), (3, 3), (4, 3), (9, 4)]
    index.close()


def test_batches_against_a_lasting_index(spark, tmp_path):
    """Batches in ascending order, each with an index opened anew from its folder, give what one run over everything gives; runs are compacted on the way."""
    rows = sorted((r for r in corpus() if r[0] is not None), key=lambda r: r[0])
    rows += [(20, " ".join(words(1, 300)[40:200])), (21, None), (22, " ".join(words(2, 260)[5:70] + words(9, 100)))]
    got = []
    for i, part in enumerate((rows[:3], rows[3:8], rows[8:12], [], rows[12:15], rows[15:])):
        index = substring_dedup.FingerprintIndex.open(spark, str(tmp_path / "index"))
        out = substring_dedup.dedup_batch(index, frame(spark, part) if part else spark.createDataFrame([], SCHEMA))
        got += collected(out, "doc_id", "n_words", "n_removed", "kept")
        assert len(index.runs) <= 2 and len(index.texts) == i + 1
        index.close()
    assert sorted(got, key=repr) == plain_windows(rows, 50)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("vectorloom_")]


def plain_strings(rows, n):
    raw = [(r[1] or "").encode() for r in rows]
    count = collections.Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    out = []
    for r, t in zip(rows, raw):
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = 1
        out.append((r[0], len(t), int(gone.sum()), bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=lambda x: repr((x[0], x[1], x[2], bytearray(x[3]))))


@pytest.mark.parametrize("hot", [5000, 1])
def test_suffix_dedup(docs, none, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = sorted(map(tuple, suffix_dedup.dedup(docs).select("doc_id", "n_bytes", "n_removed", "kept").collect()), key=repr)
    assert [(*x[:3], bytes(x[3])) for x in got] == plain_strings(corpus(), 200)
    assert suffix_dedup.dedup(none).count() == 0


def test_suffix_dedup_of_long_periodic_texts(spark, monkeypatch):
    """Texts of a megabyte of one sign or two, by the shard (the first two) and by aggregation; nothing is left of what repeats."""
    random = "".join(map(chr, np.random.default_rng(3).integers(97, 123, 1_000_000)))
    rows = [(1, "a" * 1_000_000), (2, "ab" * 500_000), (3, random), (4, random[:500_000] + "!" + random[500_000:]), (5, "xy" * 99)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"])) for r in suffix_dedup.dedup(frame(spark, rows).repartition(2)).collect()}
    assert got == {1: (1_000_000, 1_000_000, 1), 2: (1_000_000, 1_000_000, 1), 3: (1_000_000, 1_000_000, 1), 4: (1_000_001, 1_000_000, 2), 5: (198, 0, 0)}
    monkeypatch.setattr(suffix_dedup, "HOT", 10_000)
    short = [(i, t[:30_000]) for i, t in rows]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.dedup(frame(spark, short)).collect()}
    assert got == {1: (30_000, 30_000), 2: (30_000, 30_000), 3: (30_000, 30_000), 4: (30_000, 30_000), 5: (198, 0)}


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(5)
    for n, k in ((1, 1), (2, 1), (40, 1), (60, 2), (300, 3), (200, 150), (2500, 2000)):
        t = np.append(rng.integers(1, k + 1, n), 0)
        sa, plain = suffix_array(t), sorted(range(n + 1), key=lambda i, t=t.tolist(): t[i:])
        assert sa.tolist() == plain
        before, common = permuted_common_prefixes(t, sa)
        for x, y in zip(plain[:-1], plain[1:]):
            m = 0
            while max(x, y) + m <= n and t[x + m] == t[y + m]:
                m += 1
            assert (before[y], common[y]) == (x, m)


def plain_classes(rows, k, percent=80):
    sets, n = [], len(rows)
    for r in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "").encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    ids = [r[0] if r[0] is not None else 1 << 62 for r in rows]
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    low = {}
    for x, i in zip(label, ids):
        low[x] = min(low.get(x, i), i)
    return sorted([(r[0], len(s), low[x] if low[x] != 1 << 62 else None) for r, s, x in zip(rows, sets, label)], key=repr)


def family():
    """A chain in which neighbours are linked and ends are not, and near copies of one text that are not all linked with each other."""
    rng, base, rows = np.random.default_rng(6), words(7, 120), []
    for i in range(12):
        rows.append((100 + i, " ".join(words(8, 260)[4 * i : 4 * i + 160])))
    for i in range(25):
        w = list(base)
        for p in rng.integers(0, 120, 3):
            w[p] = f"z{i}-{p}"
        rows.append((200 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("local", "pivots"), [(20_000, 64), (3, 2)])
def test_near_dedup(spark, docs, none, local, pivots):
    rows = corpus() + family()
    got = near_dedup.classes(frame(spark, rows), shingle=4, local=local, pivots=pivots)
    assert collected(got, "doc_id", "n_shingles", "component_id") == plain_classes(rows, 4)
    if local > 3:
        assert near_dedup.classes(none).count() == 0
        stay = near_dedup.keep(docs)
        assert stay.columns == docs.columns
        ids = sorted((r["doc_id"] for r in stay.collect()), key=repr)
        assert [i for i in ids if i in (4, 5, 13, None)] == [] and {1, 6, 7, 16} <= set(ids)


def test_rounds_judge_links_between_what_two_pivots_reached(spark):
    """A chain, in which only neighbours are linked, is one component, wherever the first pivots stand; a shorter one beside it is another."""
    w, v = words(10, 200, 10**6), words(11, 90, 10**6)
    order = [2, 0, 3, 4, 1, 5]  # the first pivots are the second and the fifth: each reaches its neighbours, and the link between those is left
    chains = [(order[i], " ".join(w[4 * i : 4 * i + 43])) for i in range(6)] + [(6 + i, " ".join(v[4 * i : 4 * i + 43])) for i in range(3)]
    members = spark.createDataFrame([(b"c", bytes([i]), t) for i, t in chains], "cluster binary, sig binary, text string")
    heads = {r["sig"][0]: bytes(r["head"]) for r in near_dedup._rounds(members.where("sig < X'06'"), 4, 80, 2).collect()}
    assert len(heads) == 6 and len(set(heads.values())) == 1
    heads = {r["sig"][0]: bytes(r["head"]) for r in near_dedup._rounds(members, 4, 80, 2).collect()}
    assert len(heads) == 9 and len({heads[i] for i in range(6)}) == 1 and len({heads[6 + i] for i in range(3)}) == 1 and heads[0] != heads[6]


def test_both_paths_of_near_dedup_find_the_same_links(spark, monkeypatch):
    """A cluster bounded by its shingles, not its members, goes through rounds, with the same result."""
    base = words(71, 400)
    rows = []
    for i in range(60):
        w = list(base)
        for p in np.random.default_rng(i).integers(0, 400, i % 12):
            w[p] = f"z{i}"
        rows.append((i, " ".join(w)))
    docs = frame(spark, rows)
    ask = lambda: collected(near_dedup.classes(docs), "doc_id", "component_id")
    local = ask()
    monkeypatch.setattr(near_dedup, "LOCAL_SET", 1_000)
    assert ask() == local == sorted([(d, c) for d, _, c in plain_classes(rows, 5)], key=repr) and len({c for _, c in local}) > 3


def test_resolving_unlinked_members_is_quick():
    import time

    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 62, 200).astype(np.uint64)) for i in range(1000)]
    began = time.process_time()
    assert near_dedup.resolve(sets).tolist() == list(range(1000))
    assert time.process_time() - began < 8


def test_sketch_estimate_is_near():
    a, b = np.arange(1, 4001, dtype=np.uint64), np.arange(401, 4401, dtype=np.uint64)
    from vectorloom.llm.common import mix64

    r = near_dedup.registers([mix64(a), mix64(b)])
    assert abs(near_dedup.similarity(r[0], 4000, r[1:], np.array([4000]))[0] - 3600 / 4400) < 0.15
    # sketches of parts merge by the larger register
    assert (np.maximum(*near_dedup.registers([mix64(a[:2000]), mix64(a[2000:])])) == r[0]).all()


@pytest.mark.parametrize("support", [1 / 256, 0.2])
def test_exact_dedup(docs, none, support):
    rows = corpus()
    group = collections.defaultdict(list)
    for r in rows:
        group[re.sub("[\x20\x09-\x0d]", "", r[1] or "")].append(r)
    want, kept = [], 0
    for t, g in group.items():
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0]))
        want += [(r[0], best[0], len(g), hashlib.sha256(t.encode()).hexdigest()) for r in g]
        kept += 1
    got = exact_dedup.decide(docs, support=support)
    assert collected(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    assert got.where("kept").count() == kept and got.where("kept").where("not (doc_id <=> keep_id)").count() == 0
    stay = exact_dedup.keep(docs, support=support)
    assert stay.columns == docs.columns and stay.count() == kept
    assert exact_dedup.decide(none).count() == 0 and exact_dedup.keep(none).count() == 0


def test_mixing_meets_its_targets(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus())
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert target == mixing.targets(dict(sizes)) and abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) < 1 for s in target)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    count = collections.Counter()
    for r in mixed.collect():
        count[r["source"]] += len(r["text"].encode().split())
    assert count == +taken and mixing.mix(none).count() == 0 and mixing.mixture(none).count() == 0


def test_targets_are_filled_up_again():
    t = mixing.targets({"a": 10, "b": 1000, None: 100})
    assert t["a"] == 20 and t[None] <= 200 and abs(sum(t.values()) - 1665) < 1e-9 and list(t) == ["a", "b", None]
    assert mixing.targets({"a": 0}) == {"a": 0.0} and mixing.targets({}) == {}


def test_pivotal_rounding_keeps_expectations():
    size, part, n = np.array([5.0, 1.0, 3.0, 8.0, 2.0]), np.array([0.3, 0.6, 0.5, 0.2, 0.9]), 4000
    mean = np.zeros(5)
    for i in range(n):
        p = mixing.settle(np.arange(5) + 1000 * i, part, size, 0)
        assert abs((p * size).sum() - (part * size).sum()) < 1e-9 and ((p > 0) & (p < 1)).sum() <= 1
        mean += p / n
    assert np.abs(mean - part).max() < 0.03


ODD = ["", " ", "a", " a", "a ", "\n", "a\n b", "a  b", "it 's", "don't stop", "x,", ",", "..", "ab,.", "1,", "½.", "é.", "ÀÉ,", "é x", " ́a", "a b", "\ta", "ß ſ", "ǅ.", "µ,ª", "<|endoftext|> hi", "x" * 300, "a\x1cb \x1c c", "　a b", "I'm, 's 'S", "a.\nB c\n\nd", "w\n", "\r\na"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piece_encoder_equals_the_tokenizer(name):
    e = PieceEncoder(public_tokenizers.path(name), most=20)
    for end in (None, 7):
        for t, ids in zip(ODD, e.encode(pa.array(ODD), end).to_pylist()):
            assert np.frombuffer(ids, e.dtype).tolist() == e.tok.encode(t, add_special_tokens=False).ids + [7] * bool(end), t


def test_token_output_round_trip(spark, docs, none, tmp_path):
    path, vocabulary = str(tmp_path / "ids"), public_tokenizers.path("byte_bpe_50k.json")
    token_output.write(docs, path, vocabulary, 0, shard_bytes=5000, block_bytes=3000)
    tok = PieceEncoder(vocabulary).tok
    rows = sorted(corpus(), key=lambda r: r[0] if r[0] is not None else 1 << 62)
    want, at = [], 0
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_output.read_all(spark, path).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert got == want
    asked = spark.createDataFrame([(1,), (15,), (999,), (None,)], "doc_id long")
    found = token_output.lookup(asked, path).collect()
    assert sorted((r["doc_id"], r["nth"]) for r in found) == [(1, 0), (15, 0), (15, 1)]
    assert next(r["ids"] for r in found if r["doc_id"] == 1) == tok.encode(corpus()[0][1], add_special_tokens=False).ids + [0]
    token_output.write(none, path + "0", vocabulary, 0)
    assert token_output.read_all(spark, path + "0").count() == 0


def test_lookup_compares_the_stored_keys(spark, docs, tmp_path):
    """A key that is not there gives no row, even where its fingerprint agrees with that of its slot."""
    path, vocabulary = str(tmp_path / "ids"), public_tokenizers.path("byte_bpe_50k.json")
    token_output.write(docs, path, vocabulary, 0)
    (row,) = (r.asDict() for r in spark.read.schema(token_output._BLOCK).parquet(f"{path}/blocks").collect())
    block, strangers = token_output.Block(row), np.arange(20, 1100)  # inside the block's range, as null ids come last
    keys = token_output.key_hashes(strangers, np.zeros(1080, np.uint32))
    k = int(np.flatnonzero(block.ph.slots(keys) >= 0)[0])
    prints = block.ph.prints.copy()
    prints[block.ph.slots(keys[k : k + 1])] = token_output.PerfectHash.fingerprint(keys[k : k + 1])
    spark.createDataFrame([row | {"prints": prints.tobytes()}], token_output._BLOCK).write.partitionBy("shard").parquet(f"{path}/blocks", mode="overwrite")
    asked = spark.createDataFrame([(int(strangers[k]),)], "doc_id long")
    assert token_output.candidates(asked, path)[0].count() == 1 and token_output.lookup(asked, path).count() == 0


def test_lookup_reads_the_files_of_its_shards_alone(spark, tmp_path):
    path, vocabulary = str(tmp_path / "ids"), public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, " ".join(words(5000 + i, 40))) for i in range(200)] + [(77, None)] * 150 + [(None, "nobody's")] * 100
    token_output.write(frame(spark, rows).repartition(4), path, vocabulary, 0, shard_bytes=4000, block_bytes=1000)
    shards = spark.read.parquet(f"{path}/shards").collect()
    assert len(shards) > 8
    asked = spark.createDataFrame([(5,), (6,), (500,)], "doc_id long")
    blocks, _ = token_output.candidates(asked, path)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shard" in plan and blocks.select("shard").distinct().count() <= 2 and token_output.lookup(asked, path).count() == 2
    # all rows of a repeated id, which several shards hold
    assert token_output.lookup(spark.createDataFrame([(77,)], "doc_id long"), path).count() == 151
    got = token_output.read_all(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows if r[0] is not None)) + [None] * 100
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    p = token_output.PerfectHash.build(keys)
    assert sorted(p.find(keys).tolist()) == list(range(5000))
    assert (p.find(keys + np.uint64(1)) >= 0).sum() < 5


def test_packing(spark, docs, none):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, vocabulary, 1, window=64, chunk=8, bytes_per_part=4000).collect()
    tok = PieceEncoder(vocabulary).tok
    want = collections.Counter((r[0], tuple(tok.encode(r[1] or "", add_special_tokens=False).ids + [1])) for r in corpus())
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
        assert zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == 2 * r["length"]
    for (d, ids), n in want.items():
        total = sorted(x for r in by[d] for x in range(r["start"], r["start"] + r["length"]))
        assert total == sorted(list(range(len(ids))) * n)
        for r in by[d]:
            assert tuple(np.frombuffer(r["ids"], "<u2")) == ids[r["start"] : r["start"] + r["length"]]
    for rows in seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64 and at & (at - 1) == 0
    assert packing.pack(none, vocabulary, 1).count() == 0


def test_every_window_has_the_queues_shares():
    lengths = (50_000, 3_000, 17, 120_000)
    for c in range(3):
        before, _ = packing.chunk_plan(c, 3, lengths, 256)
        full = before[: sum(np.diff(before.sum(axis=1)) == 256) + 1]
        share = np.array(lengths) / sum(lengths) * 256
        assert np.abs(np.diff(full, axis=0) - share).max() < 3 and np.abs(full - share * np.arange(len(full))[:, None]).max() < 3


def test_cutting_plans_only_the_chunks_of_its_documents(monkeypatch):
    """Documents from far ends of long queues, in no order: every token has its place, and few chunks are planned."""
    lengths, planned = (3_000_000, 1_000_000, 7), []
    monkeypatch.setattr(packing, "chunk_plan", lambda c, *a, plan=packing.chunk_plan.__wrapped__: planned.append(c) or plan(c, *a))
    plan, window, stride = [(lengths, 400)], 256, 1000
    queue, at, size = np.array([0, 1, 0, 2, 1, 0]), np.array([2_999_000, 10, 5_000, 0, 999_990, 0]), np.array([1000, 300, 9000, 7, 10, 1])
    doc, start, length, sequence, offset = packing.cut(queue, at, size, plan, window, stride)
    assert len(planned) == len(set(planned)) < 20
    for d in range(6):
        own = doc == d
        assert start[own][0] == 0 and (start[own][1:] == (start + length)[own][:-1]).all() and (start + length)[own][-1] == size[d]
    assert ((offset >= 0) & (offset + length <= window)).all()
    # as one document each, whole queues fill all windows without a gap
    doc, start, length, sequence, offset = packing.cut(np.arange(3), np.zeros(3, int), np.array(lengths), plan, window, stride)
    order = np.lexsort((offset, sequence))
    same = sequence[order][1:] == sequence[order][:-1]
    assert (offset[order][1:] == np.where(same, (offset + length)[order][:-1], 0)).all() and length.sum() == sum(lengths)
    assert packing.chunks_of(np.array([0, 6, 7, 8]), 9, 4).tolist() == [0, 3, 3, 3] and packing.chunks_of(np.array([0, 1]), 2, 5).tolist() == [2, 4]


def test_packing_to_targets(spark):
    """Windows hold the targets' shares until a source is dry, and nothing is lost."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, " ".join(words(1200 + i, 150)), "abcd"[min(3, i // 10)]) for i in range(36)]
    docs = frame(spark, rows).repartition(3)
    plain = packing.pack(docs, vocabulary, 1, window=64, chunk=8, bytes_per_part=4000).collect()
    got = packing.pack(docs, vocabulary, 1, window=64, chunk=8, bytes_per_part=4000, targets={"a": 6, "b": 3, "c": 1}).collect()
    tokens = lambda rows_: sorted((r["doc_id"], x) for r in rows_ for x in range(r["start"], r["start"] + r["length"]))
    assert tokens(got) == tokens(plain)
    seq = collections.defaultdict(collections.Counter)
    for r in got:
        seq[r["sequence_id"]][r["source"]] += r["length"]
    spans = collections.defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    for v in spans.values():
        v.sort()
        assert v[0][0] == 0 and all(x[1] == y[0] for x, y in zip(v, v[1:])) and v[-1][1] & (v[-1][1] - 1) == 0
    order = sorted(seq)
    dry = max(i for i, k in enumerate(order) if seq[k]["a"])
    first = [seq[k] for k in order[: dry + 1] if sum(seq[k].values()) == 64]
    assert len(first) > 20 and all(abs(c["a"] - 38.4) < 3 and abs(c["b"] - 19.2) < 3 and abs(c["c"] - 6.4) < 3 and not c["d"] for c in first)
    then = [seq[k] for k in order[dry + 1 : max(i for i, k in enumerate(order) if seq[k]["b"]) + 1] if sum(seq[k].values()) == 64]
    assert then and all(abs(c["b"] - 48) < 3 and abs(c["c"] - 16) < 3 and not c["d"] for c in then)
    assert packing.phases((10, 10, 0), [1, 1, 5]) == [(10, 10, 0)] and packing.phases((4, 9), [0, 0]) == [(4, 9)] and packing.phases((), []) == []


def test_toxicity_finds_held_out_insults(spark, none):
    rng, rows = np.random.default_rng(9), []
    for i in range(600):
        w = words(100 + i, 60, 500)
        if i % 5 == 0:
            for p in rng.integers(0, 60, 4):
                w[p] = ["vile", "brute", "fiend"][int(rng.integers(3))]
        rows.append((i, " ".join(w)))
    docs_ = frame(spark, [*rows, (900, None), (901, "")])
    y = labelled.training_labels(spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows] + [(None, 1)], "doc_id long, toxic int"), "toxic", 3, lambda r: r == 1)
    model = toxicity.train(docs_, y)
    assert {b"vile", b"brute", b"fiend"} <= set(model.lexicon)
    s = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs_, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((s[i] >= 0.7) == (i % 5 == 0) for i in held) and s[900] < 0.5 and s[901] < 0.5
    assert toxicity.keep(docs_, model).columns == docs_.columns
    assert toxicity.score(none, toxicity.train(none, y.where("false"))).count() == 0


def test_toxicity_learns_rare_insults(spark):
    """Insults of three to a dozen toxic training documents each, never seen in a clean one."""
    rng, rows, insults = np.random.default_rng(12), [], [f"slur{chr(97 + k)}" for k in range(20)]
    for i in range(600):
        w = words(700 + i, 60, 500)
        if i % 10 == 0:
            for p, k in zip(rng.choice(60, 3, replace=False), rng.choice(20, 3, replace=False)):
                w[p] = insults[k]
        rows.append((i, " ".join(w)))
    docs_ = frame(spark, rows)
    y = labelled.training_labels(spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int"), "toxic", 3, lambda r: r == 1)
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    seen = collections.Counter(w for i, t in rows if i not in held for w in set(t.split()) & set(insults))
    model = toxicity.train(docs_, y)
    assert {w.encode() for w, n in seen.items() if n >= 3} <= set(model.lexicon)
    s = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs_, model).collect()}
    toxic = [i for i in held if i % 10 == 0]
    assert sum(s[i] >= 0.7 for i in toxic) >= 0.9 * len(toxic) and sum(s[i] >= 0.7 for i in held if i % 10) <= 0.02 * len(held)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    m = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-m))).astype(float)
    x, v = toxicity.isotonic(m, y)
    assert (np.diff(x) >= 0).all() and (np.diff(v) >= -1e-12).all() and abs(np.interp(m, x, v).mean() - y.mean()) < 1e-9


def test_quality_on_held_out_rows(spark, none):
    rows = [(i, " ".join(x + "$$" * (i % 4 == 0) for x in words(500 + i, 40, 300))) for i in range(400)]
    docs_ = frame(spark, [*rows, (900, None)])
    y = labelled.training_labels(spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in rows], "doc_id long, quality int"), "quality", 5, lambda r: r == 0)
    model = quality.train(docs_, y)
    s = {r["doc_id"]: r["score"] for r in quality.score(docs_, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s[i] >= 0.3) == (i % 4 != 0) for i in held]) > 0.95 and 0 <= s[900] <= 1
    assert quality.score(none, quality.train(none, y.where("false"))).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x[100:140] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (2004, [1e-200] * 16, 1), (2005, [1.0, 2.0], 1), (7, x[7].tolist(), 2)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int")
    got = collections.defaultdict(list)
    for r in learned_ann.search(v, v.where("vec_id % 50 = 0"), sample=1024).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x = np.vstack([x, np.full((1, 16), 1.0)])
    ids = [*range(1500), 2004]
    found = 0
    for q in range(0, 1500, 50):
        s = learned_ann.cosine(x, np.repeat(x[q : q + 1], len(x), 0))
        best = sorted((-s[i], ids[i]) for i in range(len(x)) if ids[i] != q)[:5]
        assert len(got[q]) == 5
        found += len({i for _, i in best} & {i for i, _ in got[q]})
    assert len(got) == 30 and found >= 0.9 * 150
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105]
    assert learned_ann.search(v.where("false"), v).count() == 0 and learned_ann.search(v, v.where("false")).count() == 0
    few = v.where("vec_id in (1, 2, 3)")
    assert learned_ann.search(few, few).count() == 6


@pytest.mark.parametrize("split", [40_000, 150])
def test_learned_partitions_visit_few_parts_of_clustered_vectors(spark, split):
    """Recall over 0.9 for queries of all vectors, with less than half of the parts visited; with and without a second level."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 24))[rng.integers(0, 150, 9000)] + 0.35 * rng.normal(size=(9000, 24))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    distinct, _ = learned_ann.prepared(v, 5)
    made, index = learned_ann.partitions(distinct, 5, sample=3000, split=split)
    assert made.parts > (40 if split > 9000 else 100) and made.visits < made.parts / 2 and bool(made.below) == (split < 9000)
    assert index.count() == 9000
    got = collections.defaultdict(set)
    for r in learned_ann.search(v, v.where("vec_id % 50 = 0"), sample=3000, split=split).collect():
        got[r["query_id"]].add(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = sum(len(got[q] & set([i for i in np.argsort(-(u @ u[q]), kind="stable")[:6].tolist() if i != q][:5])) for q in range(0, 9000, 50))
    assert found >= 0.9 * 5 * 180


def test_cosine_of_very_long_and_very_short_vectors():
    x = np.random.default_rng(1).normal(size=(6, 8))
    for scale in (1e-200, 1e200, 1.0):
        assert learned_ann.cosine(x * scale, x[::-1]).tolist() == pytest.approx(learned_ann.cosine(x, x[::-1]).tolist(), rel=1e-14)
    plain = (x * x[::-1]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((x[::-1] ** 2).sum(axis=1)))
    assert (learned_ann.cosine(x, x[::-1]) == plain).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piece_encoder_on_slices_and_chunks(name):
    """Slices of Arrow columns with nulls, all kinds of white space, and a table of pieces that is full again and again."""
    rng, e = np.random.default_rng(31), PieceEncoder(public_tokenizers.path(name), most=300)
    pieces, gaps = ["à", "Å", "été", "The", "Ño", "ß", "x" * 80, "a,b", "€", "ü.", "日本", "don't", "(7)", "\x00"], [" ", "  ", "\n", "\t", " ", " ", " ", "\n\n", " \n"]
    for _ in range(30):
        rows = [None if rng.random() < 0.05 else "".join(pieces[rng.integers(len(pieces))] + str(rng.integers(99)) * int(rng.integers(2)) + gaps[rng.integers(len(gaps))] for _ in range(rng.integers(40))) for _ in range(60)]
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + 17], pa.string())], ["t"]) for i in range(0, 60, 17)]
        got = [x for b in in_chunks(iter(batches), most=int(rng.choice([200, 3000]))) for x in e.encode(b.column(0), 5).to_pylist()]
        want = e.tok.encode_batch_fast([r or "" for r in rows], add_special_tokens=False)
        assert [np.frombuffer(x, e.dtype).tolist() for x in got] == [w.ids + [5] for w in want]
