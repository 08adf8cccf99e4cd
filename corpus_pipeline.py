"""The corpus pipeline: what a training set goes through, each stage on all that the one before kept.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of the documents. :func:`run` applies them to the documents table and writes each result to the shared folder, so that a lost
executor never costs more than the stage it was in.

    toxicity          documents scored at or above the threshold go
    exact_dedup       of equal texts the one with the smallest id stays
    ngram_join        of each class of near copies the one with the smallest id stays
    decontamination   documents that hold a benchmark item go
    packing           the rest is packed into windows of 2048 tokens
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanmill.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity
from scanmill.llm.common import stored, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, window=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
