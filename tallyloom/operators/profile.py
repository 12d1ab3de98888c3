"""Counts, nulls, distributions and other dataset statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import kilobytes


def class_distribution(df: DataFrame, label: str, order: str | None = None) -> DataFrame:
    """Rows per non-null label as (label, n); `order` is None, "count" (largest first) or "label"."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    if order == "count":
        return counts.orderBy(F.desc("n"), label)
    return counts.orderBy(label) if order == "label" else counts


def nulls(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def table_profile(df: DataFrame) -> DataFrame:
    """Row count, column count and nulls summed over all columns, in one pass."""
    missing = sum((nulls(c) for c in df.columns), F.lit(0))
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        missing.cast("long").alias("missing_values"),
    )


def distinct_keys(df: DataFrame, column: str, rsd: float | None = None) -> DataFrame:
    """Distinct non-null values; `rsd` switches to the sketch with that relative error."""
    counted = F.countDistinct(column) if rsd is None else F.approx_count_distinct(column, rsd)
    return df.agg(counted.alias("distinct_values"))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """Majority and minority label (smallest label on ties) and their count ratio."""
    return class_distribution(df, label).agg(
        F.count("*").alias("classes"),
        F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("majority_class"),
        F.min_by(label, F.struct(F.col("n"), F.col(label))).alias("minority_class"),
        F.round(F.max("n") / F.min("n"), 2).alias("imbalance_ratio"),
    )


def numeric_profile(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(
        nulls(column).alias("missing"),
        F.round(F.avg(c), 2).alias("mean"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distribution of several columns at once as (column, value, n): one scan, one shuffle."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ]))
    return (
        df.select(pairs.alias("p"))
        .select("p.column", "p.value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values and the commonest value of each column."""
    return value_counts(df, columns).groupBy("column").agg(
        F.count("*").alias("distinct_values"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_value"),
        F.max("n").alias("top_count"),
    )


def category_share(df: DataFrame, column: str, value: str, digits: int = 2) -> DataFrame:
    """Share of one value in percent of all rows, null values included."""
    hit = F.count_if(F.col(column) == value)
    return df.agg(
        hit.alias("matching"),
        F.count("*").alias("rows"),
        F.round(100.0 * hit / F.count("*"), digits).alias("share_pct"),
    )


def duplicate_groups(df: DataFrame, group: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"),
        F.countDistinct(group).alias("unique_groups"),
        (F.count("*") - F.countDistinct(group)).alias("duplicates"),
    )


def folder_stats(files: DataFrame, folder: str = "folder", size: str = "bytes",
                 width: str = "width", height: str = "height") -> DataFrame:
    """Image statistics per folder. Files without readable dimensions still count by number and size.

    Resolutions are counted per (folder, width, height) first, so a folder of any size stays a
    handful of rows before the per-folder step.
    """
    kb = kilobytes(size)
    per_resolution = files.groupBy(folder, width, height).agg(
        F.count("*").alias("n"),
        F.sum(F.col(size).cast("decimal(38,0)")).alias("_total"),
        F.max(kb).alias("_max_kb"),
        F.min(kb).alias("_min_kb"),
    )
    known = F.col(width).isNotNull() & F.col(height).isNotNull()
    n_known = F.when(known, F.col("n"))
    return per_resolution.groupBy(folder).agg(
        F.sum("n").alias("count"),
        F.max(F.when(known, F.col(width))).alias("max_width"),
        F.min(F.when(known, F.col(width))).alias("min_width"),
        F.max(F.when(known, F.col(height))).alias("max_height"),
        F.min(F.when(known, F.col(height))).alias("min_height"),
        F.count(n_known).alias("unique_resolutions"),
        F.when(F.count(n_known) == 1, "Yes").otherwise("No").alias("all_same_size"),
        F.min_by(
            F.when(known, F.concat(F.lit("("), F.col(width), F.lit(", "), F.col(height), F.lit(")"))),
            F.when(known, F.struct(-F.col("n"), F.col(width), F.col(height))),
        ).alias("common_resolution"),
        F.round(F.sum("_total").cast("double") / 1024 / F.sum("n"), 2).alias("avg_file_size_kb"),
        F.round(F.max("_max_kb"), 2).alias("max_file_size_kb"),
        F.round(F.min("_min_kb"), 2).alias("min_file_size_kb"),
        F.round(F.sum("_total").cast("double") / 1024 / 1024, 2).alias("total_size_mb"),
    )


def to_long(df: DataFrame, category: str, source: str | Column, skip: Sequence[str] = ()) -> DataFrame:
    """Wide statistics as (category, source, metric, value): one row per column, values as text."""
    origin = F.lit(source) if isinstance(source, str) else source
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value"))
        for c in df.columns if c not in skip
    ]))
    return df.select(F.lit(category).alias("category"), origin.alias("source"), pairs.alias("p")).select(
        "category", "source", "p.metric", "p.value"
    )


def profile(df: DataFrame, label: str, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
            group: str | None = None, source: str = "table") -> DataFrame:
    """The whole metadata profile in long form: two scans, whatever the number of columns."""
    missing = sum((nulls(c) for c in df.columns), F.lit(0))
    facts = [
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        missing.cast("long").alias("missing_values"),
    ]
    for c in numeric:
        facts += [
            nulls(c).alias(f"{c}_missing"),
            F.round(F.avg(c), 2).alias(f"{c}_mean"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    if group:
        facts += [
            F.countDistinct(group).alias(f"unique_{group}"),
            (F.count("*") - F.countDistinct(group)).alias(f"duplicate_{group}"),
        ]
    long = to_long(df.agg(*facts), "metadata", source)
    counts = value_counts(df, [label, *categorical])
    spread = counts.select(
        F.lit("metadata").alias("category"),
        F.lit(source).alias("source"),
        F.concat_ws("_", F.col("column"), F.lit("count"), F.col("value")).alias("metric"),
        F.col("n").cast("string").alias("value"),
    )
    tops = counts.groupBy("column").agg(
        F.count("*").alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("majority"),
        F.min_by("value", F.struct(F.col("n"), F.col("value"))).alias("minority"),
        F.round(F.max("n") / F.min("n"), 2).alias("imbalance_ratio"),
    )
    named = to_long(tops, "metadata", F.col("column"), skip=["column"]).select(
        "category", F.lit(source).alias("source"), F.concat_ws("_", "source", "metric").alias("metric"), "value"
    )
    return long.unionByName(spread).unionByName(named)
