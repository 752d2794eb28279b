"""The corpus pipeline over ``documents``: reject low quality, drop exact and near duplicates,
drop documents with benchmark passages, mix the sources.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is
written as Parquet before the next one reads it. All but the last return the columns of
``documents``; the last returns the mix."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from liveness.llm import decontamination, exact_dedup, mixing, near_dedup, quality
from liveness.llm.common import scratch
from liveness.session import delete_path, stage_root, table

#: The mix is drawn by chance and the classifier is fitted: not for SQL. Tests compare with brute force.
ORACLE_SQL = None


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose combined quality is 0.5 or more; those without an id stay."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased), the one with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, as ``op2_minhash_near_dedup`` finds them (sets of two-word shingles
    with a similarity of 0.8 or more), the one with the smallest id."""
    return near_dedup.drop_near_duplicates(docs, width=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of ten benchmark words occurs."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; every row stays."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("exact dedup", drop_exact_duplicates),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared folder and read again. What a
    stage left there, and its input, are deleted once its result is written."""
    root = f"{stage_root(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        if k:
            delete_path(spark, f"{root}/{k - 1}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
