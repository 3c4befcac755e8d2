"""Near-duplicates by SetSketch registers.

A register holds the exponentially spaced, truncated minimum of an exponential hash over a set; sketches of
parts merge by the larger register, and equal sets have equal registers. `BANDS` bands of `ROWS` registers are
keys, and documents that share a key are candidates: each is tied to its key's pivot, and what the ties connect
is a cluster. Every link lies inside a cluster, which is then resolved exactly: a member is compared with those
not yet reached, first by the joint likelihood of the two sketches (which rules out only what is far below the
threshold), then on the full sets. Documents with equal sets are one member, however many they are.
A cluster of more than `LOCAL` members or `LOCAL_SET` shingles is resolved by rounds over all executors instead of
in one task, by the same comparisons.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .anchors import gram_hashes
from .common import NO_ID, WordHasher, documents, drop, materialise, mix64

#: A pair at a similarity of 0.8 shares none of 30 keys of 5 registers with a probability of (1 - 0.8**5)**30 < 1e-5.
BANDS, ROWS = 30, 5
#: Base and rate of the registers, and the largest value (they fit in 16 bits).
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: Percent of the union that two sets share; words in a shingle.
PERCENT, SHINGLE = 80, 5
#: Sketches that look less similar than this are not compared: 7 standard deviations below 0.8 with 150 registers (a chance below 1e-11 for a pair of 0.8).
RULED_OUT = 0.55
#: Nor are those of which a smaller share of registers is equal, which the likelihood would rule out as well: it is not worked out for them.
LEAST_EQUAL = 0.4
#: Members of a cluster that one task resolves, and their shingles; for larger ones pivots of each in the first round, and sets and shingles of all pivots of a round at most.
LOCAL, LOCAL_SET, PIVOTS, MOST_PIVOTS, PIVOT_SET = 2_000, 4_000_000, 64, 20_000, 2_000_000

_rng = np.random.default_rng(20)
_MUL = _rng.integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_hasher = None


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; ASCII capitals are lowered; fewer words than a shingle are one; none if no words."""
    global _hasher
    if _hasher is None:
        _hasher = WordHasher()
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    units = _hasher(words)
    k = min(size, len(words))
    return np.unique(gram_hashes(units, k) ^ mix64(np.array([k], np.uint64)))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of non-empty sets: one row each."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    low = np.empty((len(sets), len(_MUL)), np.uint64)
    for i, (m, x) in enumerate(zip(_MUL, _XOR)):
        low[:, i] = np.minimum.reduceat((flat ^ x) * m, starts)
    exponential = -np.log1p(-(low.astype(np.float64) / 2.0**64)) / RATE  # increasing, so the smallest hash has the smallest value
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint16)


def keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, as int64."""
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    h = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :].repeat(len(regs), 0)
    for i in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i] + np.uint64(1))
    return h.view(np.int64)


def similarity(reg: np.ndarray, n: int, regs: np.ndarray, ns: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of a sketch with others, from how many registers are larger, smaller and equal, and the sets' sizes."""
    up, down = (reg > regs).sum(axis=1), (reg < regs).sum(axis=1)
    same = len(reg) - up - down
    u, v = n / (n + ns), ns / (n + ns)
    lo, hi = np.zeros(len(ns)), np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def worth(j):
        a, b = p(u - v * j), p(v - u * j)
        return up * np.log(np.maximum(a, 1e-12)) + down * np.log(np.maximum(b, 1e-12)) + same * np.log(np.maximum(1 - a - b, 1e-12))

    g = (5**0.5 - 1) / 2  # golden section: the likelihood has one peak
    for _ in range(30):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        left = worth(a) > worth(b)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2


def plausible(reg: np.ndarray, n: int, regs: np.ndarray, ns: np.ndarray, percent: int) -> np.ndarray:
    """Which of other sets can share `percent` percent of the union with a set, by their sizes and sketches."""
    ok = 100 * np.minimum(ns, n) >= percent * np.maximum(ns, n)
    at = np.flatnonzero(ok)
    at = at[(regs[at] == reg).sum(axis=1) >= LEAST_EQUAL * len(reg)]
    return at[similarity(reg, n, regs[at], ns[at]) >= RULED_OUT] if len(at) else at


def resolve(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each of distinct non-empty sets the index of the first one that links connect it with; links are judged on the full sets."""
    n = len(sets)
    out = np.full(n, -1)
    sizes = np.array([len(s) for s in sets])
    if n == 1:
        return np.zeros(1, int)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    regs = np.concatenate([registers(sets[i : i + 500]) for i in range(0, n, 500)])
    flag = np.zeros(int(flat.max()) + 1, bool)
    left = np.arange(n)  # not reached yet
    for seed in range(n):
        if out[seed] >= 0:
            continue
        out[seed] = seed
        queue = [seed]
        left = left[left != seed]
        while queue and len(left):
            u = queue.pop()
            near = left[plausible(regs[u], sizes[u], regs[left], sizes[left], percent)]
            if not len(near):
                continue
            flag[flat[starts[u] : starts[u] + sizes[u]]] = True
            at = np.repeat(starts[near] - (np.cumsum(sizes[near]) - sizes[near]), sizes[near]) + np.arange(sizes[near].sum())
            both = np.add.reduceat(flag[flat[at]].astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
            flag[flat[starts[u] : starts[u] + sizes[u]]] = False
            linked = near[100 * both >= percent * (sizes[u] + sizes[near] - both)]
            out[linked] = seed
            queue += linked.tolist()
            left = left[out[left] < 0]
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of each connected component, for all nodes of the edges.

    Each round ties every node to its smallest neighbour and contracts; the tables shrink until no edge is left.
    """
    edges = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), "cc-edges")
    label = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = materialise(low, "cc-low")
        old = [low, edges] + ([label] if label is not None else [])
        if label is None:
            label = low.select(F.col("a").alias("node"), F.col("m").alias("label"))
        else:
            label = label.join(low, label["label"] == low["a"], "left").select("node", F.coalesce("m", "label").alias("label"))
        label = materialise(label, "cc-label")
        x, y = low.select(F.col("a").alias("xa"), F.col("m").alias("xm")), low.select(F.col("a").alias("ya"), F.col("m").alias("ym"))
        edges = edges.join(x, edges["a"] == x["xa"]).join(y, edges["b"] == y["ya"]).select(F.col("xm").alias("a"), F.col("ym").alias("b")).where("a != b").distinct()
        edges = materialise(edges, "cc-edges")
        drop(*old)
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _sketched(size: int):
    def work(batches):
        from xxhash import xxh3_128_digest

        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                sets = [shingles(t.as_py(), size) for t in part.column(2)]
                full = [s for s in sets if len(s)]
                k = iter(keys(registers(full))) if full else iter(())
                own = [next(k) if len(s) else np.zeros(0, np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["did", "key", "sig", "n", "bands"])

    return work


def _clusters(size: int, percent: int):
    """Of rows (cluster, sig, text) sorted by cluster: (sig, head), the head being a member's first linked one."""

    def work(batches):
        held: dict[bytes, np.ndarray] = {}
        last = None

        def solve():
            sigs = list(held)
            head = resolve([held[s] for s in sigs], percent)
            return pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array([sigs[i] for i in head], pa.binary())], ["sig", "head"])

        for b in batches:
            for cluster, sig, text in zip(*(b.column(k) for k in range(3))):
                c, s = cluster.as_py(), sig.as_py()
                if c != last and held:
                    yield solve()
                    held.clear()
                last = c
                if s not in held:
                    held[s] = shingles(text.as_py(), size)
        if held:
            yield solve()

    return work


def _rounds(members: DataFrame, size: int, percent: int, pivots: int) -> DataFrame:
    """(sig, head) of large clusters: in each round some members are compared with all that have not had their turn, in blocks on all executors.

    A member that had its turn was compared with all others but those of its own component, so a cluster is
    resolved once what has not had its turn is of one component. Members of the components with the fewest such
    members come first; each round has four times as many pivots as the one before, so that few rounds are needed.
    Only a round's pivots, at most MOST_PIVOTS sets of PIVOT_SET shingles in all, are broadcast.
    """
    spark = members.sparkSession

    def to_sets(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                sets = [shingles(t.as_py(), size) for t in b.column(2).slice(lo, 200)]
                regs = [r.tobytes() for r in registers(sets)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 200), b.column(1).slice(lo, 200), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(regs, pa.binary())], ["cluster", "sig", "set", "regs"])

    sets = materialise(members.dropDuplicates(["sig"]).mapInArrow(to_sets, "cluster binary, sig binary, set binary, regs binary"), "near-sets")
    # state: head = the component as known so far; done = had its turn
    state = materialise(sets.select("cluster", "sig", F.col("sig").alias("head"), F.lit(False).alias("done")), "near-state")
    width = pivots
    while True:
        todo = state.where("not done")
        free = todo.groupBy("cluster", "head").agg(F.count("*").alias("free"))
        open_ = free.groupBy("cluster").agg(F.count("*").alias("heads")).where("heads > 1").select("cluster")
        todo = todo.join(open_, "cluster", "left_semi")
        rank = F.row_number().over(W.partitionBy("cluster").orderBy("free", "sig"))
        chosen = todo.join(free, ["cluster", "head"]).withColumn("rank", rank).where(F.col("rank") <= width).orderBy("rank", "sig").limit(MOST_PIVOTS)
        slim = chosen.join(sets.select("sig", (F.length("set") / 8).alias("n")), "sig").orderBy("rank", "sig").select("sig", "head", "n").collect()  # at most MOST_PIVOTS
        if not slim:
            break
        n = int(np.searchsorted(np.cumsum([r["n"] for r in slim]), PIVOT_SET, side="right"))
        slim = slim[: max(1, n)]
        picked = spark.createDataFrame([(r["sig"], r["head"], True) for r in slim], "sig binary, h binary, picked boolean")
        picks = sets.join(F.broadcast(picked), "sig").select("cluster", "sig", "set", "regs", F.col("h").alias("head")).collect()  # about PIVOT_SET shingles
        width *= 4
        by: dict[bytes, list] = {}
        for r in picks:
            by.setdefault(bytes(r["cluster"]), []).append((bytes(r["head"]), np.frombuffer(r["set"], np.uint64), np.frombuffer(r["regs"], np.uint16)))
        packed = {c: ([h for h, _, _ in x], [s for _, s, _ in x], np.stack([g for _, _, g in x]), np.array([len(s) for _, s, _ in x])) for c, x in by.items()}
        shared = spark.sparkContext.broadcast(packed)

        def compare(batches):
            for b in batches:
                links = set()
                for cluster, head, raw, reg in zip(*(b.column(k) for k in range(4))):
                    got = shared.value.get(cluster.as_py())
                    if got is None:
                        continue
                    heads, pivots_, regs, ns = got
                    s, own = np.frombuffer(raw.as_py(), np.uint64), head.as_py()
                    for k in plausible(np.frombuffer(reg.as_py(), np.uint16), len(s), regs, ns, percent):
                        if heads[k] != own and (own, heads[k]) not in links:
                            n = len(np.intersect1d(s, pivots_[k], assume_unique=True))
                            if 100 * n >= percent * (len(s) + int(ns[k]) - n):
                                links.add((own, heads[k]))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], ["a", "b"])

        rows = sets.select("sig", "set", "regs").join(todo, "sig").select("cluster", "head", "set", "regs")
        cc = components(rows.mapInArrow(compare, "a binary, b binary"))
        now = state.join(cc, state["head"] == cc["node"], "left").join(F.broadcast(picked.drop("h")), "sig", "left")
        before, state = state, materialise(now.select("cluster", "sig", F.coalesce("label", "head").alias("head"), (F.col("done") | F.coalesce("picked", F.lit(False))).alias("done")), "near-state")
        drop(before)
        shared.unpersist()
    return state.select("sig", "head")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, local: int = LOCAL, pivots: int = PIVOTS) -> DataFrame:
    """One row per input row: doc_id, did, key (of the text), n_shingles, component_id, first (the row is its component's first).

    Two documents are linked when their sets of word shingles share `percent` percent of their union; null and
    blank texts have no shingles and no links. component_id is the smallest doc_id that links connect a
    document with, its own included; a null doc_id is the largest. Rows with the same doc_id are documents of
    their own. Other columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("key"), text.alias("text"))
    base = materialise(rows.mapInArrow(_sketched(shingle), "did long, key long, sig binary, n long, bands array<long>"), "near-base")
    nodes = base.where("n > 0").groupBy("sig").agg(F.min(F.struct("did", "key")).alias("row"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    keyed = materialise(nodes, "near-nodes")
    marks = keyed.select("sig", F.explode("bands").alias("band"))
    pivot = marks.groupBy("band").agg(F.min("sig").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("band", "pivot")
    ties = marks.join(pivot, "band").select(F.col("sig").alias("a"), F.col("pivot").alias("b"))
    cluster = components(ties)
    members = keyed.join(cluster, keyed["sig"] == cluster["node"]).select("sig", F.col("row.did").alias("did"), F.col("row.key").alias("key"), F.col("label").alias("cluster"), "n")
    members = materialise(members, "near-members")
    texts = rows.join(members.select("sig", "did", "key", "cluster"), ["did", "key"]).select("cluster", "sig", "text")
    large = materialise(members.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("n")).where((F.col("members") > local) | (F.col("n") > LOCAL_SET)).select("cluster"), "near-large")
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if large.limit(1).count():
        texts = materialise(texts, "near-texts")
        heads = _rounds(texts.join(large, "cluster", "left_semi"), shingle, percent, pivots)
        texts = texts.join(large, "cluster", "left_anti")
    else:
        heads = None
    small = texts.repartition(n_parts, "cluster").sortWithinPartitions("cluster").mapInArrow(_clusters(shingle, percent), "sig binary, head binary")
    heads = materialise(small if heads is None else small.unionByName(heads), "near-heads")
    slim = base.select("did", "key", "sig", "n").join(heads, "sig", "left").withColumn("head", F.coalesce("head", "sig"))
    # an empty set is linked with nothing
    firsts = materialise(slim.where("n > 0").groupBy("head").agg(F.min(F.struct("did", "key")).alias("row")), "near-firsts")
    named = slim.join(firsts, "head", "left").withColumn("row", F.when(F.col("n") > 0, F.col("row")).otherwise(F.struct("did", "key")))
    known = lambda c: F.when(c != NO_ID, c)
    return named.select(known(F.col("did")).alias("doc_id"), "did", "key", F.col("n").alias("n_shingles"), known(F.col("row.did")).alias("component_id"), (F.col("row") == F.struct("did", "key")).alias("first"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs of which one stays for each component; rows that agree in id and text count as one."""
    gone = classes(docs, id_col, text_col, **how).where("not first").select(F.col("did").alias("__did"), F.col("key").alias("__key")).distinct()
    keyed = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn("__hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return keyed.join(gone, (F.col("__id") == F.col("__did")) & (F.col("__hash") == F.col("__key")), "left_anti").select(docs.columns)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(documents(spark, sf_dir), shingle=4)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: Sets are lists of shingles; equal ones are compared once, pairs that share a shingle are counted, and links are followed to the end.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(generate_series(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d
), one AS (SELECT min(r) AS r, len(s) AS n, s FROM (SELECT r, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
item AS (SELECT r, n, unnest(s) AS x FROM one), often AS (SELECT x FROM item GROUP BY x HAVING count(*) > 1),
pair AS (SELECT a.r AS a, b.r AS b FROM item a JOIN often USING (x) JOIN item b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
same AS (SELECT sets.r, one.r AS rep FROM sets JOIN one ON list_sort(sets.s) = one.s WHERE len(sets.s) > 0),
edge AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair UNION SELECT r, r FROM one),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
label AS (SELECT a AS rep, min(b) AS label FROM reach GROUP BY a),
named AS (SELECT same.r, label FROM same JOIN label USING (rep)),
first AS (SELECT label, min(doc_id) AS component_id FROM named JOIN sets USING (r) GROUP BY label)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM sets LEFT JOIN named USING (r) LEFT JOIN first USING (label)
"""
