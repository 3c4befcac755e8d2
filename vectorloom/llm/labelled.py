"""Labelled training rows, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many labels (two numbers each) are broadcast; beyond, documents and labels are shuffled to each other.
BROADCAST_LABELS = 500_000


def remainder(id_col, mod: int):
    """crc32 of the doc_id as text, mod `mod`; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def training_labels(labels: DataFrame, label: str, mod: int, held_out) -> DataFrame:
    """(doc_id, y) of the rows to learn from: labels that are 0 or 1 and agree in all rows of a document."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(remainder("doc_id", mod)))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("__y"))
        .where("y = __y")
        .select("doc_id", "y")
    )


def with_labels(docs: DataFrame, y: DataFrame) -> DataFrame:
    """(text, y) of all labelled documents; the labels are broadcast only where few enough."""
    few = y.count() <= BROADCAST_LABELS
    return docs.select("doc_id", "text").join(F.broadcast(y) if few else y, "doc_id").select("text", "y")


def sample(y: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled ids by the order of a hash, so that reruns agree."""
    return y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
