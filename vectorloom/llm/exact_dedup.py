"""Exact dedup by a heavy-hitter split, with DataFrame operations only.

Misra-Gries summaries (Spark's freqItems merges one per partition, each of at most 1/support counters) name
every digest that may hold more than `support` of all rows. Their exact counts and winners are verified by a
partially aggregated group-by; this table has at most 1/support rows, so it is broadcast, and rows of frequent
digests are decided map-side. All other digests, none of which is frequent, take an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WHITE, documents, materialise

#: Share of all rows above which a digest counts as frequent; 1/SUPPORT bounds the broadcast table's rows.
SUPPORT = 1 / 2048
#: Rows of lost documents (about 100 bytes each) that are broadcast at most; beyond, texts are shuffled to them.
FEW = 200_000


def normalised_digest(text):
    """Lowercase hex SHA-256 of the text without ASCII white space (null: empty)."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, ""), 256)


def _order():
    """What stays first: most code points, then smallest doc_id (nulls last), then the row's own number."""
    return F.struct(-F.col("n_points"), F.col("doc_id").isNull().cast("int").alias("no_id"), "doc_id", "row")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, n_points, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space. Nulls and empty or blank texts are one
    group. Of equal texts the row with the most code points stays, then the smallest doc_id (null last), then
    one row of those that agree in both. Repeated rows count one by one. Other columns are not read, whatever
    their names. An empty table gives an empty result.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"),
        normalised_digest(F.col(text_col)).alias("text_sha256"),
    ).withColumn("row", F.monotonically_increasing_id())
    slim = materialise(slim, "exact-digests")
    suspects = slim.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    winners = (
        slim.join(F.broadcast(suspects), "text_sha256")  # at most 1/support digests
        .groupBy("text_sha256")
        .agg(F.count("*").alias("group_size"), F.min(_order()).alias("best"))
        .where("group_size > 1")
        .select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("best_row"))
    )
    winners = materialise(winners, "exact-winners")
    out = ["doc_id", "n_points", "keep_id", "group_size", "kept", "text_sha256"]
    frequent = slim.join(F.broadcast(winners), "text_sha256").withColumn("kept", F.col("row") == F.col("best_row"))
    by = W.partitionBy("text_sha256")
    rest = (
        slim.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
        .withColumn("place", F.row_number().over(by.orderBy(F.desc("n_points"), F.asc_nulls_last("doc_id"), "row")))
        .withColumn("group_size", F.count("*").over(by))
        .withColumn("keep_id", F.first("doc_id").over(by.orderBy(F.desc("n_points"), F.asc_nulls_last("doc_id"), "row").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .withColumn("kept", F.col("place") == 1)
    )
    return frequent.select(out).unionByName(rest.select(out))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The input rows that stay, with all their columns; of rows that agree in id and text one stays."""
    lost = (
        decide(docs, id_col, text_col, support)
        .groupBy("doc_id", "n_points", "text_sha256")
        .agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
        .where("not kept or copies > 1")
        .select(F.col("doc_id").alias("__id"), F.col("n_points").alias("__n"), F.col("text_sha256").alias("__sha"), F.col("kept").alias("__kept"))
    )
    lost = materialise(lost, "exact-lost")
    lost = F.broadcast(lost) if lost.count() <= FEW else lost
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select("*", F.char_length(text).cast("long").alias("__points"), normalised_digest(F.col(text_col)).alias("__digest"))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__points") == F.col("__n")) & (F.col("__digest") == F.col("__sha"))
    joined = keyed.join(lost, same, "left")
    whole = joined.where("__sha is null").select(docs.columns)
    # rows of one id and one text: the winner's group of exact repeats is reduced to a row
    repeats = joined.where("__kept").dropDuplicates(["__id", "__n", "__sha"]).select(docs.columns)
    return whole.unionByName(repeats)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(documents(spark, sf_dir)).drop("n_points")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT doc_id, text_sha256,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS place,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""
