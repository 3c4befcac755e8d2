"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its documents is due. Whole copies are
given outright. The fractional copy is rounded dependently: two documents at a time, mass (weighted by size, so
that the source's words are conserved) moves at random from one to the other until one of the two is settled at
0 or 1. A block of documents leaves at most one unsettled document per source; these residuals meet in the same
operation, `FAN` blocks at a time, until one is left for each source. What is left of that last one is taken as
its first words, so a source misses its target by less than a word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, documents, materialise, mix64, word_count

#: Weights dealt out to the sources in code-point order, again and again; null comes last.
WEIGHTS = (5.0, 2.0, 1.0)
#: All sources together, as a share of all sizes.
SHARE = 1.5
#: A target is at most so many times its source's size.
MOST = 2.0
#: Sources whose totals are broadcast, at most; copies of a row that one task makes.
SOURCES, MANY = 100_000, 1_000
#: About so many documents are rounded in a block, and so many blocks' residuals meet in one of the next level.
BLOCK, FAN = 8_192, 64


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Words due to each source: shares by weight, none above `most` times its size, the excess shared anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), list(names), {}
    while free:
        unit = left / sum(w[s] for s in free)
        over = [s for s in free if unit * w[s] > most * sizes[s]]
        if not over:
            out.update({s: unit * w[s] for s in free})
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)
    return {s: float(out[s]) for s in names}


def settle(ids: np.ndarray, part: np.ndarray, size: np.ndarray, salt: int) -> np.ndarray:
    """Pivotal rounding of the fractions `part` of documents `ids` in order; the result has at most one fraction.

    Of a pair with fractions p, q and sizes a, b the mass a*p + b*q stays the same, and so do both expectations.
    The coin of a step is a hash of the later id, so a rerun gives the same result.
    """
    out = part.copy()
    todo = np.flatnonzero((part > 0) & (part < 1))
    coins = (mix64(mix64(ids[todo].astype(np.uint64) * np.uint64(2) + np.uint64(salt * 2 + 1))) >> np.uint64(11)).astype(float) / (1 << 53)
    got, sizes, places = part[todo].tolist(), size[todo].tolist(), todo.tolist()
    open_ = -1
    for i, u in enumerate(coins.tolist()):
        if open_ < 0:
            open_ = i
            continue
        a, b, p, q = sizes[open_], sizes[i], got[open_], got[i]
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)  # words that can move to the first, and to the second
        move = up if u * (up + down) < down else -down
        p, q = p + move / a, q - move / b
        p, q = (float(round(x)) if abs(x - round(x)) < 1e-12 else x for x in (p, q))
        if 0 < q < 1:
            if 0 < p < 1:  # rounding error only
                p = float(round(p))
            got[open_], got[i], open_ = p, q, i
        else:
            got[open_], got[i] = p, q
            if not 0 < p < 1:
                open_ = -1
    out[places] = got
    return out


#: What tells documents apart: rows that agree in all of it are copies, and are rounded together.
KEY = ["doc_id", "source", "size", "hash"]


def _groups(docs: DataFrame, id_col: str, text_col: str, source_col: str, hashed: list[str]) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(*hashed).alias("hash"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, hashed: list[str], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each group of equal rows: KEY, n (rows), source_size, target, copies (whole, of all rows), words (of one more copy)."""
    spark = docs.sparkSession
    # equal rows are put together before they move, so that no task holds them all
    slim = materialise(_groups(docs, id_col, text_col, source_col, hashed).groupBy(*KEY).agg(F.count("*").alias("n")), "mix-sizes")
    totals = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count("*").alias("rows")).collect()
    sizes = {r["source"]: r["words"] for r in totals}
    goal = targets(sizes, weights, share, most)
    plan = spark.createDataFrame([(s, int(sizes[s]), goal[s]) for s in goal], "source string, source_size long, target double")
    plan = F.broadcast(plan) if len(goal) <= SOURCES else plan
    due = slim.join(plan, slim["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    due = due.withColumn("due", F.when(F.col("size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    due = due.withColumn("copies", F.floor("due").cast("long")).withColumn("part", F.col("due") - F.col("copies"))
    due = materialise(due.drop("due"), "mix-due")
    n_blocks = max(1, -(-sum(r["rows"] for r in totals) // BLOCK))

    def one_level(salt: int):
        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["source", "size", "doc_id", "hash"], ascending=[True, False, True, True], na_position="last").reset_index(drop=True)
            ids = pdf["doc_id"].fillna(NO_ID).to_numpy().astype(np.int64)
            key = mix64(ids.astype(np.uint64) ^ mix64(pdf["hash"].to_numpy().astype(np.int64).view(np.uint64)))
            part, size = pdf["part"].to_numpy(float), pdf["size"].to_numpy(float)
            name = pdf["source"].to_numpy()
            cuts = [0, *(np.flatnonzero([not (a == b or (pd.isna(a) and pd.isna(b))) for a, b in zip(name[1:], name[:-1])]) + 1), len(name)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part[a:b] = settle(key[a:b], part[a:b], size[a:b], salt)
            return pdf.assign(part=part)

        return work

    kind = dict(due.dtypes)["doc_id"]
    cols = f"doc_id {kind}, source string, size long, hash long, part double, block long"
    level, settled = due.select(*KEY, "part").withColumn("block", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(n_blocks))), []
    salt = 0
    while True:
        done = materialise(level.groupBy("block").applyInPandas(one_level(salt), cols), "mix-rounded")
        if n_blocks == 1:
            settled.append(done)
            break
        settled.append(done.where("part = 0 or part = 1"))
        n_blocks, salt = -(-n_blocks // FAN), salt + 1
        level = done.where("part > 0 and part < 1").withColumn("block", F.floor(F.col("block") / FAN).cast("long"))
    parts = settled[0]
    for x in settled[1:]:
        parts = parts.unionByName(x)
    parts = parts.groupBy(*KEY).agg(F.max("part").alias("got"))
    same = [due[c].eqNullSafe(parts[c]) for c in KEY]
    out = due.join(parts, same[0] & same[1] & same[2] & same[3]).select(*[due[c] for c in KEY], "n", "source_size", "target", "copies", "got")
    out = out.withColumn("copies", F.col("copies") + F.floor("got").cast("long"))
    return out.withColumn("words", F.floor((F.col("got") - F.floor("got")) * F.col("size") + F.lit(1e-6)).cast("long")).drop("got")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies (whole), words (of one more copy), taken, row.

    size is the number of words (null text: 0); a document of size 0 is never taken. A null source is a source
    of its own, the last. Rows that agree in id, source and text are rounded together and share what falls to
    them evenly; `row` numbers them. Null ids take part as the largest id. Other columns are not read. An empty
    table gives an empty result. The sources' totals, one number for each source, are worked out on the driver;
    rows are not.
    """
    out = _mixed(docs, id_col, text_col, source_col, [text_col], weights, share, most)
    row = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("row")
    out = out.select("*", row)
    own = F.floor(F.col("copies") / F.col("n")) + (F.col("row") <= F.col("copies") % F.col("n")).cast("long")
    cut = F.when(F.col("row") == F.col("n"), F.col("words")).otherwise(F.lit(0)).cast("long")
    out = out.select("doc_id", "source", "size", "source_size", "target", own.cast("long").alias("copies"), cut.alias("words"), "row")
    return out.withColumn("taken", F.col("copies") * F.col("size") + F.col("words"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed documents, with the input's columns: a row for each copy, and for a source's last, partial copy its first words.

    Rows that agree in all columns (but maps) are rounded together. Documents of size 0, and so null texts, do
    not come out; null ids and sources do. An empty table gives an empty result. The input's columns may have any
    names. Texts move once, equal rows put together before.
    """
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind]
    # keys without nulls, so that the join keeps the partitioning of the aggregation
    keys = [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s")]
    none = (F.col(id_col).isNull().cast("int") + 2 * F.col(source_col).isNull().cast("int")).alias("none")
    rows = docs.select(*keys, none, word_count(F.col(text_col)).alias("size"), F.xxhash64(*hashed).alias("hash"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    got = _mixed(docs, id_col, text_col, source_col, hashed, **how).where("copies > 0 or words > 0")
    got = got.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.coalesce("source", F.lit("")).alias("s"), (F.col("doc_id").isNull().cast("int") + 2 * F.col("source").isNull().cast("int")).alias("none"), "size", "hash", "copies", "words")
    got = materialise(got, "mix-copies")
    by = ["i", "s", "none", "size", "hash"]
    joined = rows.where("size > 0").groupBy(*by).agg(F.first("row").alias("row")).join(got, by).select("row", "copies", "words")
    many = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    whole = joined.where(F.col("copies").between(1, MANY)).select("row", many(F.col("copies")).alias("copy")).select("row")
    if got.where(F.col("copies") > MANY).limit(1).count():  # copies of one row are made by many tasks
        parts = joined.where(F.col("copies") > MANY).select("row", "copies", many(F.ceil(F.col("copies") / MANY)).alias("part"))
        parts = parts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        whole = whole.unionByName(parts.select("row", many(F.least(F.lit(MANY).cast("long"), F.col("copies") - (F.col("part") - 1) * MANY)).alias("copy")).select("row"))
    first = F.concat_ws(" ", F.slice(F.filter(F.split(F.col(f"row.`{text_col}`"), r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), F.col("words").cast("int")))
    part = joined.where("words > 0").select("row", first.alias("cut"))
    field = lambda c: F.col("row").getField(c)
    cut = {c: F.col("cut") if c == text_col else F.char_length("cut").cast(kind) if c == "n_chars" else field(c) for c, kind in docs.dtypes}
    return whole.select(*[field(c).alias(c) for c in docs.columns]).unionByName(part.select(*[x.alias(c) for c, x in cut.items()]))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")
