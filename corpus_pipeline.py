"""A corpus from raw documents to packed sequences: the stages as functions of (spark, docs, sf_dir).

All stages but the last return the columns of `docs` as they came, whatever their names, and give an empty table for an
empty one. Texts of any length are read whole; a null text counts as empty, a null id is a value like others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontaminate, packing, pii, quality, simhash
from tallyloom.llm.common import durable


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust distances reject go.

    Null and empty texts have too few words and go. Rows that repeat are judged alike."""
    return quality.keep_inliers(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that with the smallest doc_id.

    Of rows that repeat one stays; texts without words have one fingerprint and so form a component."""
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Null and empty texts hold none and stay; rows that repeat are judged alike, and items without words find nothing."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become names of their kinds.

    Every row stays; a null text stays null."""
    return pii.masked(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences.

    Every row is packed for itself; a null text is the end token alone."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", benchmark_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Fingerprints, regex walks and packing are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
