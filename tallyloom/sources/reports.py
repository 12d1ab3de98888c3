"""Nested JSON reports: the baseline document and report sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BASELINE_SCHEMA = (
    "class_distribution map<string,bigint>, total_train_samples bigint, class_weights map<string,double>")


def read_report(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_text(df: DataFrame, into: str = "report") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(into))


def baseline_document(weighted: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """One row with the counts and weights of the given classes as maps, from (label, n, weight) rows.

    Classes without a row are left out of the maps; `unlisted_samples` counts the rows of other labels.
    """
    name = F.col(label).cast("string")

    def as_map(value: str) -> Column:
        pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.max(F.when(name == c, F.col(value))).alias("v")) for c in sorted(set(classes))])
        return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))

    listed = F.coalesce(name.isin(*classes), F.lit(False))
    return weighted.agg(
        as_map("n").alias("class_distribution"),
        F.sum("n").alias("total_train_samples"),
        as_map("weight").alias("class_weights"),
        F.coalesce(F.sum(F.when(~listed, F.col("n"))), F.lit(0)).alias("unlisted_samples"),
    )


def baseline_distribution(document: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight) rows back from the document."""
    return document.select(
        F.explode("class_distribution").alias(label, "n"), "class_weights"
    ).select(label, "n", F.element_at("class_weights", F.col(label)).alias("weight"))
