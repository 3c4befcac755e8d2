"""A corpus pipeline: toxicity, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared
folder and hands what it reads back to the next stage. All stages but the last return the columns of documents,
whatever further columns these have; an empty table goes through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vectorloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from vectorloom.llm.common import documents, settled, small_batches

VOCABULARY, END_ID = "word_bpe_49k.json", 1


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled documents among its input, outside the held-out third.

    Null and blank texts are scored like any others, repeated rows each by itself, long texts whole. Without labels
    of both classes, all have one score.
    """
    small_batches(spark)
    return toxicity.keep(docs, toxicity.learned(spark, docs, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one document stays: the one of most code points, then of the smallest doc_id (null last).

    Null and blank texts are one group. Of rows that agree in id and text one stays.
    """
    return exact_dedup.keep(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of five words, similarity 0.8) the document of the smallest doc_id (null last) stays.

    Null and blank texts have no shingles and stay. Rows that agree in id and text count as one.
    """
    small_batches(spark)
    return near_dedup.keep(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a row for each copy, and a source's last, partial copy as its first words.

    A null source is a source of its own. Documents without words, null ones included, do not come out. Rows that
    agree in all columns are rounded together.
    """
    return mixing.mixture(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as pieces of full windows, with their ids. Null and empty texts are the end id alone; null doc_ids come last in their queue."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), END_ID)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models and tokenizers are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
