"""Metrics from event logs and samples, on an evaluation grid.

Events are counted per grid step first; every window is a multiple of the step. A windowed value is
constant between the moments at which a step enters or leaves the window, so a series is kept as
intervals [g_from, g_to) of grid numbers and spread over single grid points only when asked to.
Ordered work runs per series over at most two rows per step: bounded by time, not by rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.constants import EVALUATION_STEP, LOOKBACK
from tallyloom.functions.columns import grid_index, grid_time, micros, whole_steps
from tallyloom.functions.columns import histogram_quantile as quantile_of
from tallyloom.operators.lookup import HOT_SHARE, mark_hot
from tallyloom.operators.ordered import with_previous



# --- totals -----------------------------------------------------------------------------------------
def counter(df: DataFrame, by: Sequence[str | Column], into: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(into))


def gauge_last(df: DataFrame, by: Sequence[str], ts: str, value: str, tie: str | None = None) -> DataFrame:
    order = F.struct(ts, tie) if tie else F.col(ts)
    return df.groupBy(*by).agg(F.max_by(value, order).alias("value"), F.max(ts).alias("last_ts"))


def bucket_counts(value: Column, bounds: Sequence[float]) -> list[Column]:
    """Cumulative counts, one per finite bound and the last one for everything."""
    return [F.count_if(value <= float(b)) for b in bounds] + [F.count(value)]


def histogram(df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, le, cumulative): all buckets from one aggregation."""
    names = [*(str(float(b)) for b in bounds), "+Inf"]
    wide = df.groupBy(*by).agg(F.array(*[
        F.struct(F.lit(name).alias("le"), n.alias("cumulative"))
        for name, n in zip(names, bucket_counts(F.col(value), bounds))
    ]).alias("buckets"))
    return wide.select(*by, F.explode("buckets").alias("b")).select(*by, "b.le", "b.cumulative")


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("count"), F.sum(value).alias("sum"))


def target_up(df: DataFrame, by: Sequence[str], ts: str, as_of: Column, max_age: int) -> DataFrame:
    """Up when the last sample is no older than `max_age` seconds."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.max(micros(ts))) / 1_000_000.0
    return df.groupBy(*by).agg(F.max(ts).alias("last_ts"), age.alias("age_s")).withColumn(
        "up", (F.col("age_s") <= max_age).cast("int"))


# --- windows on the grid ------------------------------------------------------------------------------
def step_counts(df: DataFrame, ts: str, step: int, by: Sequence[str], values: Mapping[str, Column] | None = None) -> DataFrame:
    """Aggregates per series and grid step; an event counts at the first grid point at or after it."""
    values = values or {"n": F.count("*")}
    return df.withColumn("g", grid_index(ts, step)).groupBy(*by, "g").agg(*[v.alias(k) for k, v in values.items()])


def last_step(steps: DataFrame) -> Column:
    """The largest grid number, read inside the query that uses it."""
    return steps.agg(F.max("g")).scalar()


def _until(steps: DataFrame, until: int | Column | None) -> Column:
    return last_step(steps) if until is None else F.lit(until).cast("long")


def _exact(steps: DataFrame, name: str) -> Column:
    """Whole numbers stay; others become decimals, so that what enters a window also leaves it whole."""
    kind = dict(steps.dtypes)[name]
    return F.col(name) if kind in ("int", "bigint") or kind.startswith("decimal") else F.col(name).cast("decimal(28,9)")


def _moves(df: DataFrame, by: Sequence[str], values: Sequence[str], start: Column, stop: Column) -> DataFrame:
    """(by, g, values) where each row adds its values at `start` and takes them back at `stop`.

    The rows are partitioned by series once; the sums and the ordered step after them need no other shuffle.
    """
    placed = df.repartition(*by) if by else df.repartition(1)
    both = F.explode(F.array(
        F.struct(start.alias("g"), *[_exact(df, v).alias(v) for v in values]),
        F.struct(stop.alias("g"), *[(-_exact(df, v)).alias(v) for v in values]),
    ))
    moved = placed.select(*by, both.alias("_m")).select(*by, "_m.*")
    return moved.groupBy(*by, "g").agg(*[F.sum(v).alias(v) for v in values])


def windowed(steps: DataFrame, by: Sequence[str], values: Sequence[str], window: int, step: int,
             until: int | Column | None = None) -> DataFrame:
    """Sums over (t - window, t] for every grid point t up to `until` (the last step), as intervals.

    A series starts at its first step and then keeps its zeros.
    """
    if window % step:
        raise ValueError("window must be a multiple of the step")
    return windowed_steps(steps, by, values, F.lit(window // step), until)


def windowed_steps(steps: DataFrame, by: Sequence[str], values: Sequence[str], span: Column,
                   until: int | Column | None = None) -> DataFrame:
    """Like `windowed`, with the window given as a number of steps that may differ between series."""
    end = _until(steps, until)
    moves = _moves(steps, by, values, F.col("g"), F.col("g") + span)
    moves = moves.withColumn("_end", end).where(F.col("g") <= F.col("_end"))
    key = [*by] or [F.lit(0)]
    at = W.partitionBy(*key).orderBy("g")
    upto = at.rowsBetween(W.unboundedPreceding, W.currentRow)
    return moves.select(
        *by, F.col("g").alias("g_from"), F.coalesce(F.lead("g").over(at), F.col("_end") + 1).alias("g_to"),
        *[F.sum(v).over(upto).alias(v) for v in values])


def dense(intervals: DataFrame, step: int, into: str = "t") -> DataFrame:
    """One row per grid point of every interval."""
    rest = [c for c in intervals.columns if c not in ("g_from", "g_to")]
    return intervals.select(F.explode(F.sequence("g_from", F.col("g_to") - 1)).alias("g"), *rest).select(
        grid_time(F.col("g"), step).alias(into), *rest)


def windowed_rate(df: DataFrame, ts: str, window: int, step: int, by: Sequence[str],
                  until: int | Column | None = None) -> DataFrame:
    """Events per second over the window, per series and grid interval."""
    counted = windowed(step_counts(df, ts, step, by), by, ["n"], window, step, until)
    return counted.withColumn("rate", F.col("n") / float(window))


def merge_series(intervals: DataFrame, by: Sequence[str], values: Sequence[str], live: Column | None = None) -> DataFrame:
    """Sum series into coarser ones (`by`), with `series` counting those that are live at each moment.

    Every interval adds its value at its start and takes it back at its end.
    """
    live = F.lit(True) if live is None else live
    ends = intervals.where(live).withColumn("series", F.lit(1))
    changes = ["series", *values]
    both = F.explode(F.array(
        F.struct(F.col("g_from").alias("g"), *[_exact(ends, v).alias(v) for v in changes]),
        F.struct(F.col("g_to").alias("g"), *[(-_exact(ends, v)).alias(v) for v in changes]),
    ))
    moves = ends.select(*by, both.alias("_m")).select(*by, "_m.*").groupBy(*by, "g").agg(*[F.sum(v).alias(v) for v in changes])
    key = [*by] or [F.lit(0)]
    at = W.partitionBy(*key).orderBy("g")
    upto = at.rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = moves.select(
        *by, F.col("g").alias("g_from"), F.lead("g").over(at).alias("g_to"),
        *[F.sum(c).over(upto).alias(c) for c in ("series", *values)])
    return merged.where((F.col("series") > 0) & F.col("g_to").isNotNull())


def windowed_quantile(df: DataFrame, ts: str, value: str, bounds: Sequence[float], q: float, window: int, step: int,
                      by: Sequence[str] = (), until: int | Column | None = None) -> DataFrame:
    """histogram_quantile over the window; null where the window saw nothing."""
    names = [f"b{i}" for i in range(len(bounds) + 1)]
    steps = step_counts(df, ts, step, by, dict(zip(names, bucket_counts(F.col(value), bounds))))
    summed = windowed(steps, by, names, window, step, until)
    return summed.withColumn("value", quantile_of(q, bounds, F.array(*names))).drop(*names)


def held_steps(last: DataFrame, by: Sequence[str], step: int, lookback: int, until: int | None = None) -> DataFrame:
    """Intervals during which a sampled value is current, from (by, g, at, value) with the last sample per step.

    A sample holds until the next one, or until it is `lookback` seconds old.
    """
    width = step * 1_000_000
    stale = whole_steps(F.col("at") + F.lit(lookback * 1_000_000 + width - 1), width)
    order = W.partitionBy(*([*by] or [F.lit(0)])).orderBy("g")
    ends = [F.lead("g").over(order), stale] + ([] if until is None else [F.lit(until + 1).cast("long")])
    return last.select(*by, F.col("g").alias("g_from"), F.least(*ends).alias("g_to"), "value").where(
        F.col("g_to") > F.col("g_from"))


def held_samples(df: DataFrame, ts: str, value: str, by: Sequence[str], step: int = EVALUATION_STEP,
                 lookback: int = LOOKBACK, until: int | None = None) -> DataFrame:
    """Sampled gauge on the grid, see `held_steps`."""
    at = micros(ts)
    last = df.withColumns({"g": grid_index(ts, step), "_at": at}).groupBy(*by, "g").agg(
        F.max_by(value, F.col("_at")).alias("value"), F.max("_at").alias("at"))
    return held_steps(last, by, step, lookback, until)


def counter_deltas(df: DataFrame, ts: str, value: str, by: Sequence[str], tie: str | None = None,
                   chunk_seconds: int = 300, hot_share: float = HOT_SHARE) -> DataFrame:
    """Growth since the previous sample of the series; a drop means the counter started again from zero.

    Hot series are ordered within `chunk_seconds` only, with the last earlier sample carried over.
    """
    order = [ts, tie] if tie else [ts]
    chunk = F.when(F.col("_hot"), whole_steps(micros(ts), chunk_seconds * 1_000_000)).otherwise(0)
    before = F.col("_previous")
    return (
        with_previous(mark_hot(df, by, hot_share, "_hot"), by, order, value, chunk, "_previous", F.col("_hot"))
        .withColumn("delta", F.when(before.isNull(), F.lit(0.0)).when(F.col(value) >= before, F.col(value) - before)
                    .otherwise(F.col(value)))
        .drop("_previous", "_hot")
    )


def counter_increase(df: DataFrame, ts: str, value: str, window: int, step: int, by: Sequence[str],
                     tie: str | None = None, until: int | Column | None = None) -> DataFrame:
    """Increase of a sampled counter over the window, per series and grid interval."""
    grown = step_counts(counter_deltas(df, ts, value, by, tie), ts, step, by, {"increase": F.sum(
        F.col("delta").cast("decimal(28,9)"))})
    return windowed(grown, by, ["increase"], window, step, until)
