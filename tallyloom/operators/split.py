"""Leakage-free stratified group split and class balancing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.constants import SPLIT_SEED, VAL_SIZE
from tallyloom.operators.lookup import attach
from tallyloom.operators.profile import class_distribution
from tallyloom.session import durable

HASH_DIGITS = 3
SLOTS = 4096


def group_mode(df: DataFrame, group: str, label: str) -> DataFrame:
    """Commonest label per group, smallest label on ties; null groups and labels are left out.

    Labels are counted per (group, label) before the per-group step, so a group holding a large
    part of all rows arrives there as one row per label.
    """
    counts = (
        df.where(F.col(group).isNotNull() & F.col(label).isNotNull())
        .groupBy(group, label)
        .agg(F.count("*").alias("n"))
    )
    return counts.groupBy(group).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label))


def val_quotas(sizes: DataFrame, stratum: str, size: str, val_size: float) -> DataFrame:
    """(stratum, val_quota): groups per stratum that go to val, so that train follows the largest remainder.

    Strata are ranked by remainder, smaller label first on ties. Counts per remainder bucket tell for
    most strata whether they get one more; only the bucket that the number of extra groups cuts is ordered.
    """
    facts = sizes.agg(F.sum(size).alias("total"), F.count("*").alias("k"), F.min(size).alias("least")).first()
    total, k = facts["total"] or 0, facts["k"]
    n_val = math.ceil(val_size * total)
    n_train = total - n_val
    if not k:
        return sizes.select(stratum, F.lit(0).cast("long").alias("val_quota"))
    if facts["least"] < 2:
        raise ValueError("a stratum needs at least two groups")
    if n_train < k or n_val < k:
        raise ValueError(f"{n_train} train and {n_val} val groups cannot cover {k} strata")
    share = F.col(size).cast("double") * F.lit(float(n_train)) / F.lit(float(total))
    parts = sizes.withColumns({"_floor": F.floor(share), "_rest": share - F.floor(share)})
    parts = durable(parts.withColumn("_slot", -F.floor(F.col("_rest") * SLOTS)))
    more = n_train - parts.agg(F.sum("_floor")).first()[0]
    upto = W.partitionBy(F.lit(0)).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)  # at most SLOTS + 1 rows
    slots = parts.groupBy("_slot").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    placed = parts.join(slots, "_slot").withColumn("_room", F.lit(more) - F.col("_before"))
    whole = placed.where((F.col("_room") <= 0) | (F.col("_room") >= F.col("_n"))).withColumn("_extra", F.col("_room") > 0)
    inside = W.partitionBy("_slot").orderBy(F.col("_rest").desc(), stratum)
    cut = placed.where((F.col("_room") > 0) & (F.col("_room") < F.col("_n"))).withColumn("_rank", F.row_number().over(inside))
    both = whole.unionByName(cut.withColumn("_extra", F.col("_rank") <= F.col("_room")).drop("_rank"))
    return durable(both.select(stratum, (F.col(size) - F.col("_floor") - F.col("_extra").cast("long")).alias("val_quota")))


def split_by_group(df: DataFrame, group: str, label: str, val_size: float = VAL_SIZE,
                   seed: int = SPLIT_SEED) -> DataFrame:
    """Add `split` (train or val): whole groups, stratified by each group's commonest label.

    Groups of a stratum are ordered by md5(seed:group). The group table is written once, as the
    quotas, the bucket counts and the final join all start from it. Counts per hash bucket tell for most buckets that they go to one side as a
    whole; the order inside is needed only in the single bucket per stratum that the quota cuts.
    Rows without a group belong to neither side and are left out, see `ungrouped`.
    """
    groups = group_mode(df, group, label).withColumnRenamed(label, "_stratum")
    groups = groups.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))))
    groups = durable(groups.withColumn("_bucket", F.substring("_hash", 1, HASH_DIGITS)))
    cells = groups.groupBy("_stratum", "_bucket").agg(F.count("*").alias("_n"))

    wanted = val_quotas(cells.groupBy("_stratum").agg(F.sum("_n").alias("n")), "_stratum", "n", val_size)

    upto = W.partitionBy("_stratum").orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = cells.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).join(wanted, "_stratum")
    cells = cells.select("_stratum", "_bucket", (F.col("val_quota") - F.col("_before")).alias("_room"), "_n")

    placed = groups.join(cells, ["_stratum", "_bucket"])
    whole = placed.where((F.col("_room") <= 0) | (F.col("_room") >= F.col("_n")))
    cut = placed.where((F.col("_room") > 0) & (F.col("_room") < F.col("_n")))
    inside = W.partitionBy("_stratum", "_bucket").orderBy("_hash", group)
    assigned = whole.select(group, F.when(F.col("_room") > 0, "val").otherwise("train").alias("split")).unionByName(
        cut.withColumn("_rank", F.row_number().over(inside)).select(
            group, F.when(F.col("_rank") <= F.col("_room"), "val").otherwise("train").alias("split"))
    )
    return attach(df, assigned, group, "inner")


def ungrouped(df: DataFrame, group: str, label: str | None = None) -> DataFrame:
    """How many rows the split leaves out: those without a group and, if `label` is given, those of groups without any label."""
    facts = [F.count_if(F.col(group).isNull()).alias("rows_without_group")]
    if label is None:
        return df.agg(*facts)
    groups = df.groupBy(group).agg(F.count("*").alias("_n"), F.count(label).alias("_labelled"))
    lost = F.col(group).isNotNull() & (F.col("_labelled") == 0)
    return groups.agg(
        F.coalesce(F.sum(F.when(F.col(group).isNull(), F.col("_n"))), F.lit(0)).alias("rows_without_group"),
        F.coalesce(F.sum(F.when(lost, F.col("_n"))), F.lit(0)).alias("rows_without_label"))


def class_weights(distribution: DataFrame, label: str, n: str = "n", digits: int = 4) -> DataFrame:
    """Balanced weight total / (classes * n) per label."""
    facts = distribution.agg(F.struct(F.sum(n).alias("total"), F.count("*").alias("k"))).scalar()
    return (
        distribution.withColumn("_f", facts)
        .withColumn("weight", F.round(F.col("_f.total") / (F.col("_f.k") * F.col(n)), digits))
        .drop("_f")
    )


def weight_vector(weights: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """One row with the weights in class order; a class without a weight is an error."""
    order = weights.sparkSession.createDataFrame(list(enumerate(classes)), f"idx int, `{label}` string")
    joined = F.broadcast(order).join(weights.select(F.col(label).cast("string").alias(label), "weight"), label, "left")
    checked = F.coalesce(
        F.col("weight"),
        F.raise_error(F.concat(F.lit("no weight for class "), F.col(label))).cast("double"),
    )
    return joined.agg(F.sort_array(F.collect_list(F.struct("idx", checked.alias("weight")))).alias("w")).select(
        F.transform("w", lambda x: x["weight"]).alias("weights"))


def row_weights(df: DataFrame, label: str) -> DataFrame:
    """Attach its class weight to every row."""
    weights = class_weights(class_distribution(df, label), label).select(label, "weight")
    return attach(df, weights, label)


def first_per_class(df: DataFrame, label: str, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first `n` rows of each class; each task keeps its own first `n` before the shuffle."""
    ranked = W.partitionBy(label).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(ranked)).where(F.col("_rn") <= n).drop("_rn")
