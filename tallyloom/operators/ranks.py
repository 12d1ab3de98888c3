"""Exact nearest-rank percentiles without sorting the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import durable

BUCKETS = 4096
LOG_STEPS = 64.0


def _log_bucket(v: Column) -> Column:
    """Coarse order-keeping bucket number that copes with outliers of any size."""
    infinite = F.abs(v) == float("inf")
    return F.when(infinite, F.signum(v) * 1e9).otherwise(F.signum(v) * F.floor(F.log1p(F.abs(v)) * LOG_STEPS)).cast("int")


def _even_bucket(v: Column, low: Column, high: Column) -> Column:
    """Order-keeping bucket 0..BUCKETS of equal widths between low and high."""
    return F.when(high > low, F.floor((v - low) / (high - low) * BUCKETS)).otherwise(0).cast("int")


def _target(n: Column, p: float) -> Column:
    return F.least(n - 1, F.greatest(F.lit(0), F.bround((n - 1) * F.lit(float(p))).cast("long")))


def _pick(cells: DataFrame, keys: Sequence[str], rank: Column) -> DataFrame:
    """The bucket that contains the target rank, and the rank inside it. At most BUCKETS rows per key."""
    upto = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = W.partitionBy(*(keys or [F.lit(0)]))
    counted = cells.withColumns({"_cum": F.sum("_n").over(upto), "_all": F.sum("_n").over(total)})
    counted = counted.withColumn("_rank", rank)
    return counted.where((F.col("_cum") - F.col("_n") <= F.col("_rank")) & (F.col("_rank") < F.col("_cum"))).select(
        *keys, F.col("_min").alias("_low"), F.col("_max").alias("_high"),
        (F.col("_rank") - (F.col("_cum") - F.col("_n"))).alias("_rank"))


def nearest_rank(df: DataFrame, column: str, p: float, by: Sequence[str] = ()) -> DataFrame:
    """The value at sorted position round((n - 1) * p), half to even; 0.0 for an empty table. Nulls and NaN take no part.

    Each pass counts rows per bucket of the value range and narrows down to the bucket with the
    target rank, until that bucket holds one value. Only bucket counts are ordered, never rows, and
    a value repeated in any number of rows does not matter.
    """
    keys = list(by)
    values = df.dropna(subset=[*keys, column]).select(*keys, F.col(column).cast("double").alias("_v"))
    counts = [F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")]
    cells = values.groupBy(*keys, _log_bucket(F.col("_v")).alias("_b")).agg(*counts)
    zone = durable(_pick(cells, keys, _target(F.col("_all"), p)))
    done = None
    while zone.where(F.col("_low") < F.col("_high")).limit(1).count():
        if keys:  # only keys that are still open are looked at again
            settled = zone.where(F.col("_low") >= F.col("_high"))
            done = settled if done is None else done.unionByName(settled)
            inside = values.join(zone.where(F.col("_low") < F.col("_high")), keys)
        else:
            only = zone.first()
            inside = values.withColumns({
                "_low": F.lit(only["_low"]), "_high": F.lit(only["_high"]), "_rank": F.lit(only["_rank"])})
        inside = inside.where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        bucket = _even_bucket(F.col("_v"), F.col("_low"), F.col("_high"))
        cells = inside.groupBy(*keys, bucket.alias("_b")).agg(*counts, F.first("_rank").alias("_target"))
        zone = durable(_pick(cells, keys, F.col("_target")))
    found = (zone if done is None else zone.unionByName(done)).select(*keys, F.col("_low").alias("value"))
    return found if keys else found.agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("value"))


def nearest_rank_approx(df: DataFrame, column: str, p: float, by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """One-pass sketch with rank error 1/accuracy."""
    return df.groupBy(*by).agg(F.percentile_approx(F.col(column).cast("double"), float(p), accuracy).alias("value"))
