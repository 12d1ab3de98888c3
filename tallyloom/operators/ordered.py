"""Ordered computations per key, cut into chunks so that one hot key never is one task.

A key's rows are ordered inside (key, chunk) only. What earlier chunks contribute comes from one
summary row per (key, chunk), which is small whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.constants import PATIENCE

COMBINE = {"max": F.greatest, "min": F.least, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
FOLD = {"max": F.max, "min": F.min, "sum": F.sum}


def _by_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join where a null key equals a null key."""
    right = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(right, same, how).drop(*[f"_k_{k}" for k in keys])


def running_before(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chunk: Column,
                   folds: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Add, per output name, the max / min / sum of an expression over all earlier rows of the key.

    `chunk` must not decrease along `order`. Without earlier rows max and min are null, sum is 0.
    """
    df = df.withColumn("_chunk", chunk)
    cells = df.groupBy(*keys, "_chunk").agg(*[FOLD[how](e).alias(f"_t_{name}") for name, (how, e) in folds.items()])
    past = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = cells.select(
        *keys, "_chunk", *[FOLD[how](f"_t_{name}").over(past).alias(f"_c_{name}") for name, (how, _) in folds.items()])
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumns({f"_l_{name}": FOLD[how](e).over(inside) for name, (how, e) in folds.items()})
    joined = _by_keys(local, carried, [*keys, "_chunk"], "inner")
    return joined.withColumns({
        name: COMBINE[how](F.col(f"_l_{name}"), F.col(f"_c_{name}")) for name, (how, _) in folds.items()
    }).drop("_chunk", *[f"_l_{n}" for n in folds], *[f"_c_{n}" for n in folds])


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, chunk: Column,
                  into: str = "previous", chunked: Column | None = None) -> DataFrame:
    """Add the `value` of the row just before this one in the key's order (null for the first row).

    `chunked` marks the rows of keys that have more than one chunk; the others need no carried value.
    """
    df = df.withColumn("_chunk", chunk)
    tails = (df if chunked is None else df.where(chunked)).groupBy(*keys, "_chunk").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_tail"))
    by_chunk = W.partitionBy(*keys).orderBy("_chunk")
    heads = tails.select(*keys, "_chunk", F.lag("_tail").over(by_chunk).alias("_carried"))
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    local = df.withColumns({"_lag": F.lag(value).over(inside), "_rn": F.row_number().over(inside)})
    return (
        _by_keys(local, heads, [*keys, "_chunk"], "left")
        .withColumn(into, F.when(F.col("_rn") == 1, F.col("_carried")[value]).otherwise(F.col("_lag")))
        .drop("_chunk", "_carried", "_lag", "_rn")
    )


def early_stopping(history: DataFrame, metric: str, step: str, by: str, patience: int = PATIENCE,
                   chunk: Column | None = None) -> DataFrame:
    """Per run: where training stops and which step was best.

    Only a strictly larger value than the best so far (0.0 at the start) counts as an improvement; the
    run stops at the first step that is `patience` steps past the last improvement.
    """
    if chunk is None:
        chunk = F.floor(F.col(step) / 1000)
    seen = running_before(history.select(by, step, metric), [by], [step], chunk, {
        "_best": ("max", F.col(metric)), "_n": ("sum", F.lit(1))})
    start = F.greatest(F.coalesce("_best", F.lit(0.0)), F.lit(0.0))
    seen = seen.withColumns({"_best": start, "_pos": F.col("_n") + 1, "_up": F.coalesce(F.col(metric) > start, F.lit(False))})
    mark = F.when(F.col("_up"), F.struct(F.col("_pos").alias("pos"), F.col(step).alias("step")))
    held = running_before(seen, [by], [step], chunk, {"_last": ("max", mark)})
    held = held.withColumns({
        "_at": F.coalesce(mark, F.col("_last")),
        "_top": F.when(F.col("_up"), F.col(metric)).otherwise(F.col("_best")),
    })
    waited = F.col("_pos") - F.coalesce(F.col("_at.pos"), F.lit(0))
    facts = F.struct(
        F.col("_pos").alias("steps_run"), F.col(step).alias("stop_step"),
        F.col("_at.step").alias("best_step"), F.col("_top").alias("best_value"))
    out = held.groupBy(by).agg(
        F.min_by(F.when(waited >= patience, facts), F.when(waited >= patience, F.col("_pos"))).alias("_stop"),
        F.max_by(facts, F.col("_pos")).alias("_end"),
    )
    row = F.coalesce("_stop", "_end")
    return out.select(
        by,
        F.col("_stop").isNotNull().alias("stopped_early"),
        row["steps_run"].alias("steps_run"),
        row["stop_step"].alias("last_step"),
        row["best_step"].alias("best_step"),
        row["best_value"].alias("best_value"),
    )
