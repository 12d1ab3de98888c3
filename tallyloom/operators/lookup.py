"""Joins against small tables, label encoding and the class dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.constants import CLASS_DETAILS
from tallyloom.functions.columns import strings
from tallyloom.session import durable

HOT_SHARE = 1e-4
#: Rows from which a key is hot however large the table is, and hot keys that are broadcast at most.
HOT_ROWS = 1_000_000
HOT_KEYS = 10_000


def attach(facts: DataFrame, lookup: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join `facts` with a computed table that is unique on `on`.

    The lookup is written first, so the planner knows its true size: it is broadcast below the
    session's threshold. Above it both sides are shuffled straight from their files, and then the
    adaptive skew join can split a key that holds a large part of the facts (it cannot when an
    aggregation sits between the shuffle and the join).
    """
    return facts.join(durable(lookup), on, how)


def mark_hot(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, into: str = "hot") -> DataFrame:
    """Add a flag for rows whose key holds more than `share` of all rows, or more than HOT_ROWS rows.

    The hot keys are written and counted; up to HOT_KEYS of them are broadcast, more go through a shuffle join.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    limit = counts.agg(F.least(F.sum("_n") * share, F.lit(float(HOT_ROWS)))).scalar()
    found = durable(counts.where(F.col("_n") > limit).select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
    flagged = found.withColumn(into, F.lit(True))
    marked = df.join(F.broadcast(flagged) if found.count() <= HOT_KEYS else flagged, same, "left")
    return marked.withColumn(into, F.col(into).isNotNull()).drop(*[f"_hot_{k}" for k in keys])


def encode(df: DataFrame, label: str, classes: Sequence[str], into: str = "idx") -> DataFrame:
    """Add the 0-based position of `label` in the fixed class order (the first, if repeated); unknown labels give null."""
    place = F.array_position(strings(classes), F.col(label))
    return df.withColumn(into, F.when(place > 0, place - 1).cast("int"))


def decode(df: DataFrame, index: str, classes: Sequence[str], into: str = "label") -> DataFrame:
    """Inverse of `encode`; positions outside the list give null."""
    return df.withColumn(into, F.get(strings(classes), F.col(index)))


def class_dimension(spark: SparkSession) -> DataFrame:
    """The fixed table of seven classes, marked for broadcast."""
    rows = [
        (code, name, risk, advisory, symptoms, [(source, url)])
        for code, name, risk, advisory, symptoms, source, url in CLASS_DETAILS
    ]
    return F.broadcast(spark.createDataFrame(
        rows,
        "label string, display_name string, risk_level string, advisory string, "
        "symptoms array<string>, sources array<struct<name:string,url:string>>",
    ))


def risk_lookup(df: DataFrame, label: str, dimension: DataFrame) -> DataFrame:
    """Display name, risk level and advice for each predicted label, plus the high-risk flag."""
    known = dimension.withColumnRenamed("label", label)
    return df.join(known, label, "left").withColumn("high_risk", F.coalesce(F.col("risk_level") == "HIGH", F.lit(False)))
