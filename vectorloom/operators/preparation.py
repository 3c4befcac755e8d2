"""Preparation of retrieval data: dedup, judgements, sampling, splits, leakage guards, integrity, profiles.

Tables: corpus (doc_id, title?, text, ord?), queries (query_id, text), qrels (query_id, doc_id, grade), splits (query_id, split).
Random choices are by the order of a seeded MD5, so that they are the same on any cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def draw(seed: int, *cols: str) -> Column:
    """The order of a seeded random draw."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


# -- duplicates ---------------------------------------------------------------------------------------------------


def exact_groups(corpus: DataFrame, text: Column, order: str = "doc_id") -> DataFrame:
    """(doc_id, hash, canonical): the first of each set of equal normalised texts stands for all.

    First and count come from an aggregation, which combines before it shuffles; a text that very many share is no burden to one task.
    """
    h = corpus.select("doc_id", F.col(order).alias("o"), T.content_hash(text).alias("hash"))
    first = h.groupBy("hash").agg(F.min(F.struct("o", "doc_id")).alias("first"))
    return h.join(first, "hash").select("doc_id", "hash", F.col("first.doc_id").alias("canonical"))


def remap_qrels(qrels: DataFrame, remap: DataFrame) -> DataFrame:
    """Judgements of duplicates go to their canonical document, unmapped ids stay, the largest grade wins."""
    m = remap.select(F.col("doc_id").alias("old"), "canonical")
    return qrels.join(m, F.col("doc_id") == F.col("old"), "left").groupBy("query_id", F.coalesce("canonical", "doc_id").alias("doc_id")).agg(F.max("grade").alias("grade"))


#: Beyond so many documents, sketches are made of fewer permutations and of shorter beginnings of texts.
MANY_DOCS, PERMUTATIONS, CHARS = 50_000, (64, 32), (2_000, 800)


def minhash_params(n_docs: int) -> tuple[int, int]:
    """(permutations, characters) of sketches for a corpus of so many documents. `near_pairs` needs neither, as it misses no pair; `shingle_sets` takes the characters for comparison with sketches so made."""
    many = n_docs > MANY_DOCS
    return PERMUTATIONS[many], CHARS[many]


def shingle_sets(corpus: DataFrame, text: Column, size: int = 5, max_chars: int | None = None) -> DataFrame:
    """(doc_id, n, items): hashes of the distinct word shingles (of the first max_chars characters of the normalised text, where given); texts without words are left out."""
    text = text if max_chars is None else F.substring(T.normalise(text), 1, max_chars)
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a generator's output is not worked out again wherever it is used
    s = corpus.select("doc_id", once(T.tokens(text)).alias("w")).where(F.size("w") > 0).select("doc_id", once(T.shingles(F.col("w"), size)).alias("items"))
    return s.select("doc_id", F.size("items").alias("n"), "items")


def near_pairs(corpus: DataFrame, text: Column, threshold: float = 0.9, size: int = 5) -> DataFrame:
    """(a, b, jaccard) of all pairs of different sets at or above the threshold, by prefix filtering, so that none is missed.

    In whatever order of all items, sets that reach the threshold share one of their first (1 - t) n + 1 items; only
    those are joined on, then the full sets are compared. The order is that of the hashes, frequent items last. Which
    are frequent is estimated from SAMPLE sets: that changes how many pairs are compared, never which are found.
    Documents with equal sets are compared once and tied to the first of them. Items leave their place only where a
    set is compared.
    """
    from .storage import cut

    # sorted, so that equal sets have equal signatures; worked out once, as what follows reads it several times
    sets = shingle_sets(corpus, text, size).select("doc_id", "n", F.array_sort("items").alias("items"))
    sets = cut(sets.withColumn("sig", F.md5(F.array_join(F.col("items").cast("array<string>"), ","))))
    reps = cut(sets.groupBy("sig").agg(F.min("doc_id").alias("rep")))
    n_reps = reps.count()
    one = _of_ids(sets.withColumnRenamed("doc_id", "rep"), reps, n_reps)
    prefix = prefixes(one, frequent(one, n_reps), threshold)
    x, y = prefix.alias("x"), prefix.alias("y")
    close = (F.col("x.rep") < F.col("y.rep")) & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * threshold)
    cand = cut(x.join(y, (F.col("x.item") == F.col("y.item")) & close).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())
    ids = cut(cand.select(F.col("a").alias("rep")).unionByName(cand.select(F.col("b").alias("rep"))).distinct())
    some = _of_ids(sets.select(F.col("doc_id").alias("rep"), "items"), ids, ids.count())
    left = some.select(F.col("rep").alias("a"), F.col("items").alias("ia"))
    right = some.select(F.col("rep").alias("b"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib"))
    pairs = cand.join(left, "a").join(right, "b").withColumn("jaccard", both / (F.size("ia") + F.size("ib") - both)).where(F.col("jaccard") >= threshold).select("a", "b", "jaccard")
    same = sets.select("doc_id", "sig").join(reps, "sig").where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("jaccard"))
    return pairs.unionByName(same).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


#: Ids that are broadcast at most; sets that frequent items are estimated from, and how many of these are known at most.
FEW_IDS, SAMPLE, FREQUENT = 4_000_000, 50_000, 1_000_000


def _of_ids(sets: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The sets of given ids (all columns of `ids`); few ids are broadcast, so that the sets stay where they are."""
    return sets.join(F.broadcast(ids) if n <= FEW_IDS else ids, ids.columns, "left_semi")


def frequent(sets: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Items that at least two of about SAMPLE of n sets (rep, items) have, in ascending order, and how often."""
    some = sets.where(F.pmod(F.xxhash64("rep"), F.lit(max(1, n // SAMPLE))) == 0)
    count = some.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    t = count.orderBy(F.desc("df"), "item").limit(FREQUENT).orderBy("item").toArrow()
    return t["item"].to_numpy(), t["df"].to_numpy()


def prefixes(sets: DataFrame, often: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """(rep, n, item): the first n - ceil(t n) + 1 items of each set (rep, n, items), frequent ones last."""
    sent = sets.sparkSession.sparkContext.broadcast(often)

    def work(batches):
        known, df = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 256):  # some at a time, as sets can be large
                part = b.slice(at, 256)
                n, item = part.column("n").to_numpy(), part.column("items").flatten().to_numpy()
                row, weight = np.repeat(np.arange(len(n)), n), np.zeros(len(item), np.int64)
                if len(known):
                    i = np.minimum(np.searchsorted(known, item), len(known) - 1)
                    weight = np.where(known[i] == item, df[i], 0)
                o = np.lexsort((item, weight, row))
                keep = np.arange(len(o)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(n - np.ceil(n * threshold) + 1, n)
                row, item = row[keep], item[o][keep]
                yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(row)), pa.array(n[row]), pa.array(item)], ["rep", "n", "item"])

    kind = dict(sets.dtypes)
    return sets.select("rep", "n", "items").mapInArrow(work, f"rep {kind['rep']}, n int, item long")


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, group_id): connected components of pairs (a, b), named by their smallest member.

    Every round ties each node to its smallest neighbour and contracts the graph; tables are checkpointed
    between rounds, in the folder the session names (or one of our own where it names none).
    """
    from .storage import cut

    edges = cut(pairs.select("a", "b").where("a != b").distinct())
    label = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        if label is None:
            label = low.select(F.col("a").alias("doc_id"), F.col("m").alias("group_id"))
        else:
            label = label.join(low, F.col("group_id") == F.col("a"), "left").select("doc_id", F.coalesce("m", "group_id").alias("group_id"))
        label = cut(label)
        x, y = low.toDF("xa", "xm"), low.toDF("ya", "ym")
        edges = cut(edges.join(x, F.col("a") == F.col("xa")).join(y, F.col("b") == F.col("ya")).select(F.col("xm").alias("a"), F.col("ym").alias("b")).where("a != b").distinct())
    return label if label is not None else edges.toDF("doc_id", "group_id")


# -- guards -------------------------------------------------------------------------------------------------------


def queries_in_corpus(queries: DataFrame, corpus: DataFrame, text: Column) -> DataFrame:
    """Queries whose normalised text equals a document's."""
    d = corpus.select(T.content_hash(text).alias("hash"))
    return queries.withColumn("hash", T.content_hash(F.col("text"))).join(d, "hash", "left_semi").select("query_id")


def leaking_tests(qrels: DataFrame, splits: DataFrame, group_of: DataFrame) -> DataFrame:
    """Test queries with a relevant document in a near-duplicate group that holds a training query's relevant document."""
    rel = qrels.where("grade >= 1").join(splits, "query_id").join(group_of, "doc_id")
    train = rel.where("split = 'train'").select("group_id")
    return rel.where("split = 'test'").join(train, "group_id", "left_semi").select("query_id").distinct()


def overlapping_splits(splits: DataFrame) -> DataFrame:
    """Queries that are in more than one split; empty if all is well."""
    return splits.groupBy("query_id").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def dangling(qrels: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judgements whose document exists, and those whose does not."""
    ids = corpus.select("doc_id")
    return qrels.join(ids, "doc_id", "left_semi"), qrels.join(ids, "doc_id", "left_anti")


def orphans(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries without any judgement left; one judged 0 only is no orphan."""
    return queries.join(qrels.select("query_id"), "query_id", "left_anti").select("query_id")


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def shared_ids(a: DataFrame, a_id: str, b: DataFrame, b_id: str) -> DataFrame:
    """Ids that both tables use."""
    return a.select(F.col(a_id).alias("id")).intersect(b.select(F.col(b_id).alias("id")))


def alignment(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: documents with a vector, documents without, vectors without a document."""
    d, v = docs.select("doc_id", F.lit(1).alias("in_docs")), vectors.select("doc_id", F.lit(1).alias("in_vectors"))
    return d.join(v, "doc_id", "full").agg(F.count(F.when(F.col("in_docs").isNotNull() & F.col("in_vectors").isNotNull(), 1)).alias("aligned"), F.count(F.when(F.col("in_vectors").isNull(), 1)).alias("missing"), F.count(F.when(F.col("in_docs").isNull(), 1)).alias("extra"))


def profile(corpus: DataFrame, text: Column, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: counts, relevant documents per query, whether grades go beyond 1, median lengths in words."""
    c = corpus.agg(F.count("*").alias("n_docs"), F.coalesce(F.percentile(T.token_count(text), 0.5), F.lit(0.0)).alias("median_doc_words"))
    q = queries.agg(F.count("*").alias("n_queries"), F.coalesce(F.percentile(T.token_count(F.col("text")), 0.5), F.lit(0.0)).alias("median_query_words"))
    per = qrels.groupBy("query_id").agg(F.count(F.when(F.col("grade") >= 1, 1)).alias("n"), F.max("grade").alias("g"))
    r = per.agg(F.round(F.avg("n"), 6).alias("relevant_per_query"), F.coalesce(F.bool_or(F.col("g") > 1), F.lit(False)).alias("graded"))
    return c.crossJoin(q).crossJoin(r)  # one row each


# -- samples and splits -------------------------------------------------------------------------------------------


def first_by_draw(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """n rows by seeded draw; a top-n sort, not a global window."""
    return df.orderBy(draw(seed, id_col), id_col).limit(n)


def subsample(corpus: DataFrame, qrels: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` documents: all judged ones, filled up with drawn others."""
    judged = qrels.select("doc_id").distinct()
    keep = corpus.join(judged, "doc_id", "left_semi")
    rest = corpus.join(judged, "doc_id", "left_anti")
    room = max(0, most - keep.count())
    return keep.withColumn("judged", F.lit(True)).unionByName(first_by_draw(rest, room, seed, "doc_id").withColumn("judged", F.lit(False)))


def carve(ids: DataFrame, shares: list[tuple[str, float]], seed: int) -> DataFrame:
    """(query_id, split): ids in the order of a draw, cut at rounded (half to even) shares; the last split takes the rest."""
    n = ids.count()
    bounds, at = [], 0
    for name, share in shares[:-1]:
        at += max(1, round(n * share)) if n else 0
        bounds.append((name, at))
    place = F.row_number().over(W.orderBy(draw(seed, "query_id"), "query_id"))  # a rank over all is what a split is
    split = F.lit(shares[-1][0])
    for name, b in reversed(bounds):
        split = F.when(F.col("place") <= b, name).otherwise(split)
    return ids.select("query_id").withColumn("place", place).select("query_id", split.alias("split"))


# Fixed values of the next function: the tags that say how splits were made, the shares of a missing dev or test split,
# and the shares where one pool has to give all three: 0.4/0.1/0.5 of a test or dev pool, 0.7/0.1/0.2 of a train pool.
def ensure_splits(pools: dict[str, DataFrame], seed: int, dev_share: float = 0.1, test_share: float = 0.3) -> tuple[DataFrame, str]:
    """Train, dev and test from what pools there are, and how they were made; an error without any."""
    have = {k for k in ("train", "dev", "test") if k in pools}
    native = lambda k: pools[k].select("query_id", F.lit(k).alias("split"))
    if have == {"train", "dev", "test"}:
        return native("train").unionByName(native("dev")).unionByName(native("test")), "native"
    if have == {"train", "test"}:
        return carve(pools["train"], [("dev", dev_share), ("train", 1 - dev_share)], seed).unionByName(native("test")), "dev_from_train"
    if have == {"train", "dev"}:
        return carve(pools["train"], [("test", test_share), ("train", 1 - test_share)], seed).unionByName(native("dev")), "test_from_train"
    if have == {"test"}:
        return carve(pools["test"], [("train", 0.4), ("dev", 0.1), ("test", 0.5)], seed), "synthetic_from_test"
    if have == {"train"}:
        return carve(pools["train"], [("train", 0.7), ("dev", 0.1), ("test", 0.2)], seed), "synthetic_from_train"
    if have == {"dev"}:
        return carve(pools["dev"], [("train", 0.4), ("dev", 0.1), ("test", 0.5)], seed), "synthetic_from_dev"
    raise ValueError("no pool of queries to split")


def flatten_qrels(by_split: dict[str, DataFrame]) -> DataFrame:
    """One table of judgements; of a pair judged in several splits the last split's grade stays."""
    out = None
    for i, (_, df) in enumerate(by_split.items()):
        part = df.select("query_id", "doc_id", "grade", F.lit(i).alias("o"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query_id", "doc_id").agg(F.max_by("grade", "o").alias("grade"))


def budget_prefix(docs: DataFrame, key: list[str], order: list[str], n_tokens: Column, budget: int, cap: int = 512) -> DataFrame:
    """For each key the longest run of rows, in order, whose capped token counts stay within the budget."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return docs.withColumn("used", F.sum(F.least(n_tokens, F.lit(cap))).over(w)).where(F.col("used") <= budget)


def windows(tokens: DataFrame, key: list[str], pos: str, size: int) -> DataFrame:
    """Chunks of `size` tokens of each key's stream; the incomplete last one is dropped."""
    return tokens.groupBy(*key, F.floor(F.col(pos) / size).cast("long").alias("chunk")).agg(F.count("*").alias("n"), F.min(pos).alias("start")).where(F.col("n") == size)


def one_per(docs: DataFrame, key: str, item: str, seed: int) -> DataFrame:
    """One drawn row for each key."""
    return docs.withColumn("draw", draw(seed, key, item)).groupBy(key).agg(F.min(F.struct("draw", item)).alias("m")).select(key, F.col(f"m.{item}").alias(item))


def common_prefix(streams: DataFrame, key: str, pos: str, token: str) -> DataFrame:
    """One row: how many leading tokens all streams share."""
    n = streams.select(F.countDistinct(key).alias("streams"))
    at = streams.groupBy(pos).agg(F.countDistinct(token).alias("kinds"), F.count("*").alias("have"))
    first_bad = at.crossJoin(F.broadcast(n)).agg(F.min(F.when((F.col("kinds") > 1) | (F.col("have") < F.col("streams")), F.col(pos))).alias("bad"), F.max(pos).alias("last"))
    return first_bad.select(F.coalesce(F.col("bad"), F.col("last") + 1, F.lit(0)).cast("long").alias("common"))


def reservoir(docs: DataFrame, keep_ids: DataFrame, most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """A uniform sample of what is not in keep_ids, as many as still go into `most`, and all of keep_ids; and one row (raw_total, kept, negatives_seen).

    The sample is what a one-pass reservoir gives: every subset is as likely. The rows with the smallest draws are
    found by a top-n sort, which holds n rows in each task and moves no others.
    """
    marked = docs.join(keep_ids.select("doc_id", F.lit(True).alias("kept")).distinct(), "doc_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    stats = marked.agg(F.count("*").alias("raw_total"), F.count(F.when(F.col("kept"), 1)).alias("kept"), F.count(F.when(~F.col("kept"), 1)).alias("negatives_seen"))
    room = max(0, most - keep_ids.select("doc_id").distinct().count())
    return marked.where("kept").unionByName(first_by_draw(marked.where("not kept"), room, seed, "doc_id")), stats


def restrict(queries: DataFrame, qrels: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and judgements of the queries that are in some split."""
    ids = splits.select("query_id").distinct()
    return queries.join(ids, "query_id", "left_semi"), qrels.join(ids, "query_id", "left_semi")


def build(corpus: DataFrame, queries: DataFrame, qrels_by_split: dict[str, DataFrame], max_docs: int | None, seed: int, near: float = 0.9) -> dict[str, DataFrame]:
    """From raw tables to a data set: corpus, queries, qrels, splits, near_groups, flagged (test queries that leak) and meta (one row).

    The order is fixed: subsample, exact dedup, near-duplicates, queries that equal documents, splits, restriction to
    them, judgements of documents that are not there, queries left without judgements, leakage, profile. Corpus has
    (doc_id, text), queries (query_id, text), judgements (query_id, doc_id, grade) by their split.
    """
    from .storage import cut

    flat = flatten_qrels(qrels_by_split)
    if max_docs is not None:
        corpus = subsample(corpus, flat, max_docs, seed).drop("judged")
    remap = cut(exact_groups(corpus, F.col("text")))
    n_raw = corpus.count()
    corpus = corpus.join(remap.where("doc_id = canonical").select("doc_id"), "doc_id", "left_semi")
    flat = remap_qrels(flat, remap)
    near_groups = groups(near_pairs(corpus, F.col("text"), near))
    same = queries_in_corpus(queries, corpus, F.col("text"))
    pools = {k: df.select("query_id").distinct() for k, df in qrels_by_split.items() if df.limit(1).count()}
    splits, how = ensure_splits(pools, seed)
    splits = cut(splits)
    if overlapping_splits(splits).limit(1).count():
        raise ValueError("a query is in more than one split")
    queries, flat = restrict(queries, flat, splits)
    n_total = splits.count()  # before queries without judgements go
    flat, lost = dangling(flat, corpus)
    orphaned = orphans(queries, flat)
    queries, splits = queries.join(orphaned, "query_id", "left_anti"), splits.join(orphaned, "query_id", "left_anti")
    flagged = leaking_tests(flat, splits, near_groups)
    one = profile(corpus, F.col("text"), queries, flat)
    for name, df in (("dangling", lost), ("orphaned", orphaned), ("query_dups", same), ("flagged", flagged), ("near_groups", near_groups.select("group_id").distinct())):
        one = one.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    per_split = splits.agg(*[F.count(F.when(F.col("split") == k, 1)).alias(f"n_{k}") for k in ("train", "dev", "test")])
    meta = one.crossJoin(per_split).withColumn("split_source", F.lit(how)).withColumn("n_queries_total", F.lit(n_total).cast("long")).withColumn("exact_removed", F.lit(n_raw).cast("long") - F.col("n_docs"))
    return {"corpus": corpus, "queries": queries, "qrels": flat, "splits": splits, "near_groups": near_groups, "flagged": flagged, "meta": meta}


def align(docs: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their vectors (doc_id, embedding), and the vectors of no document. Documents without one are an error that names the first five."""
    missing = [r["doc_id"] for r in docs.join(vectors.select("doc_id"), "doc_id", "left_anti").select("doc_id").orderBy("doc_id").limit(5).collect()]
    if missing:
        raise ValueError(f"documents without a vector (first: {missing})")
    return docs.join(vectors, "doc_id"), vectors.join(docs.select("doc_id"), "doc_id", "left_anti")


def only(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows whose id is asked for, and the ids asked for that are not there."""
    return df.join(ids.select(key), key, "left_semi"), ids.select(key).distinct().join(df.select(key), key, "left_anti")


def members(splits: DataFrame, split: str, vectors: DataFrame) -> DataFrame:
    """(pos, query_id) of a split's queries that have a vector, in the split's order, which stays as it is."""
    return splits.where(F.col("split") == split).join(vectors.select("query_id"), "query_id", "left_semi").select("pos", "query_id").orderBy("pos")


def paragraphs(docs: DataFrame, low: int, high: int, n: int, seed: int) -> DataFrame:
    """(doc_id, pos, line): one drawn paragraph of each document that has one, the first n documents by another draw."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(T.is_paragraph(F.col("line"), low, high))
    drawn = lines.withColumn("draw", draw(seed, "doc_id", "pos")).groupBy("doc_id").agg(F.min_by(F.struct("pos", "line"), "draw").alias("p"))
    return first_by_draw(drawn.select("doc_id", "p.pos", "p.line"), n, seed, "doc_id")


def calibration_sets(docs: DataFrame, queries: DataFrame, seed: int) -> dict[str, DataFrame]:
    """(kind, id, text) of documents, of queries, and of both together in a drawn order."""
    d = docs.select(F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("id"), "text")
    q = queries.select(F.lit("query").alias("kind"), F.col("query_id").cast("string").alias("id"), "text")
    both = d.unionByName(q)
    return {"corpus_only": d, "synth_only": q, "corpus_synth": both.orderBy(draw(seed, "kind", "id"), "kind", "id")}
