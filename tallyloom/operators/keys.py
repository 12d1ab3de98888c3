"""Key resolution, membership and set comparisons. The looked-up side shrinks to distinct keys first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyloom.operators.lookup import attach
from tallyloom.session import durable


def _keys(df: DataFrame, key: str, name: str | None = None) -> DataFrame:
    return df.select(F.col(key).alias(name or key)).where(F.col(name or key).isNotNull()).distinct()


def resolve_first_match(keys: DataFrame, inventory: DataFrame, key: str, value: str,
                        priority: Sequence[str | Column]) -> DataFrame:
    """For each key the `value` of its best-ranked inventory row, null where there is none."""
    order = F.struct(*[F.col(p) if isinstance(p, str) else p for p in priority], F.col(value))
    best = inventory.groupBy(key).agg(F.min_by(value, order).alias(value))
    return attach(keys, best, key)


def drop_unresolved(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a value in `column`, and a one-row report of how many were kept and dropped."""
    report = df.agg(
        F.count("*").alias("total"),
        F.count(column).alias("kept"),
        (F.count("*") - F.count(column)).alias("dropped"),
    )
    return df.dropna(subset=[column]), report


def resolved(df: DataFrame, column: str) -> tuple[DataFrame, dict[str, int]]:
    """Written rows with a value in `column`, and how many were kept and dropped, counted while they were written."""
    seen = Observation()
    counted = df.observe(seen, F.count("*").alias("total"), F.count(column).alias("kept"))
    kept = durable(counted.dropna(subset=[column]))
    found = seen.get
    return kept, {**found, "dropped": found["total"] - found["kept"]}


def missing_keys(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return _keys(wanted, key).join(_keys(present, key), key, "left_anti")


def present_rows(df: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return attach(df, _keys(present, key), key, "left_semi")


def absent_rows(df: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return attach(df, _keys(present, key), key, "left_anti")


def union_keys(key: str, *tables: DataFrame) -> DataFrame:
    """Distinct keys found in any of the tables."""
    merged = tables[0].select(key)
    for table in tables[1:]:
        merged = merged.unionByName(table.select(key))
    return merged.distinct()


def overlap(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Group keys that occur on both sides."""
    return _keys(left, group).intersect(_keys(right, group))


def leaked_groups(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that occur in more than one split: one aggregation, no join."""
    return (
        df.where(F.col(group).isNotNull() & F.col(split).isNotNull())
        .groupBy(group)
        .agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"))
        .where(F.col("first_split") != F.col("last_split"))
    )


def assert_no_leakage(df: DataFrame, group: str, split: str = "split") -> None:
    found = leaked_groups(df, group, split).count()
    if found:
        raise ValueError(f"leakage: {found} groups in more than one split")


def class_diff(baseline: DataFrame, current: DataFrame, label: str) -> DataFrame:
    """Labels seen on one side only, marked `missing` (baseline only) or `unseen` (current only)."""
    left = _keys(baseline, label).withColumn("in_baseline", F.lit(True))
    right = _keys(current, label).withColumn("in_current", F.lit(True))
    return (
        left.join(right, label, "full_outer")
        .where(F.col("in_baseline").isNull() | F.col("in_current").isNull())
        .select(label, F.when(F.col("in_current").isNull(), "missing").otherwise("unseen").alias("status"))
    )


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    """Expected columns the table lacks, from its analysed schema alone."""
    return sorted(set(expected) - set(df.columns))


def class_match(df: DataFrame, label: str, expected: Sequence[str]) -> DataFrame:
    """One row: do the labels found equal the expected ones? Lists never outgrow `expected`."""
    wanted = F.array(*[F.lit(e) for e in sorted(expected)])
    name = F.col(label).cast("string")
    known = F.when(name.isin(list(expected)), name)
    return _keys(df, label).agg(
        F.count("*").alias("class_count"),
        F.sort_array(F.collect_set(known)).alias("_known"),
        F.count_if(known.isNull()).alias("unseen_count"),
    ).select(
        "class_count",
        F.concat_ws(",", "_known").alias("found_expected"),
        F.concat_ws(",", F.array_except(wanted, "_known")).alias("missing_classes"),
        "unseen_count",
        ((F.size("_known") == len(set(expected))) & (F.col("unseen_count") == 0)).alias("classes_match"),
    )


def link_check(facts: DataFrame, linked: DataFrame, key: str, linked_key: str) -> DataFrame:
    """Each fact with a flag telling whether its linked row exists."""
    there = _keys(linked, linked_key, key).withColumn("_there", F.lit(True))
    return attach(facts, there, key).withColumn("linked", F.col("_there").isNotNull()).drop("_there")
