"""Streaming forms of the event operators: built-in windows and dedup, keyed state where Spark has none.

The streams write to Parquet in append mode. Before a shuffle each Arrow batch is reduced to what the
keyed step needs, so a key that holds a large part of the stream arrives as a few rows per batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType


def read_events(spark: SparkSession, path: str, schema: StructType, glob: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    """Append-only file source with an explicit schema; zone-less timestamps become instants."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(path)
    naive = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else rows


def run_available(stream: DataFrame, out: str, checkpoint: str, partition_by: Sequence[str] = ()) -> dict:
    """Process everything that is there, append it to `out` and stop. A later call with the same checkpoint goes on.

    Returns the number of micro-batches and of rows dropped as late.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    running = writer.trigger(availableNow=True).start(out)
    running.awaitTermination()
    progress = running.recentProgress
    late = sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
    return {"batches": len({p["batchId"] for p in progress}), "late_rows": late}


def windowed_counts(stream: DataFrame, ts: str, window: str, slide: str, by: Sequence[str], watermark: str) -> DataFrame:
    """Counts per sliding window, emitted once the watermark has passed the window's end."""
    counted = stream.withWatermark(ts, watermark).groupBy(F.window(ts, window, slide), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def open_windows(spark: SparkSession, checkpoint: str, by: Sequence[str]) -> DataFrame:
    """Windows of a stopped `windowed_counts` stream that the watermark has not passed, with their counts so far.

    They are read from the state store, in which exactly the windows are left that never came out."""
    held = spark.read.format("statestore").load(checkpoint)
    return held.select(F.col("key.window.start").alias("start"), F.col("key.window.end").alias("end"),
                       *[F.col("key").getField(c).alias(c) for c in by], F.col("value.count").alias("n"))


def all_windows(spark: SparkSession, out: str, checkpoint: str, by: Sequence[str]) -> DataFrame:
    """Closed windows of a stopped `windowed_counts` stream and those still open at its end."""
    return spark.read.parquet(out).unionByName(open_windows(spark, checkpoint, by))


def _reduced(stream: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str) -> DataFrame:
    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values(list(order), kind="stable").drop_duplicates(list(keys), keep=keep)
    return stream.mapInPandas(shrink, stream.schema)


def first_seen(stream: DataFrame, keys: Sequence[str], ts: str, within: str) -> DataFrame:
    """Drop repeats of a key that arrive within the watermark."""
    early = _reduced(stream, keys, [ts], "first")
    return early.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def latest_changes(stream: DataFrame, key: str, ts: str, tie: str, value: str) -> DataFrame:
    """(key, ts, tie, value) each time a micro-batch brings a newer row for the key; keyed state holds the newest."""
    rows = _reduced(
        stream.select(F.col(key), F.unix_micros(ts).alias("at"), F.col(tie).cast("long").alias("tie"),
                      F.col(value).cast("string").alias("value")), [key], ["at", "tie"], "last")
    kind = StructType([rows.schema[key], StructField("at", LongType()), StructField("tie", LongType()),
                       StructField("value", StringType())])
    held = StructType([StructField("at", LongType()), StructField("tie", LongType())])

    def keep_newest(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = tuple(state.get) if state.exists else None
        text = None
        for batch in batches:
            top = batch.sort_values(["at", "tie"]).iloc[-1]
            place = (int(top["at"]), int(top["tie"]))
            if best is None or place > best:
                best, text = place, top["value"]
        if text is not None:
            state.update(best)
            yield pd.DataFrame({key: [group[0]], "at": [best[0]], "tie": [best[1]], "value": [text]})

    return rows.groupBy(key).applyInPandasWithState(keep_newest, kind, held, "append", GroupStateTimeout.NoTimeout)


def hold_changes(stream: DataFrame, series: str, g: str, on: str, need: int) -> DataFrame:
    """Alert transitions (series, g_active, g, status) from one row per series and grid point.

    Status is pending when the condition starts, firing once it has held for `need` steps and resolved
    at the first grid point without it. Grid points may be cut into any number of micro-batches, in
    time order; a gap in the grid counts as a point without the condition.
    """
    rows = stream.select(F.col(series).cast("string").alias("series"), F.col(g).cast("long").alias("g"), F.col(on).alias("on"))
    kind = StructType([StructField("series", StringType()), StructField("g_active", LongType()),
                       StructField("g", LongType()), StructField("status", StringType())])
    held = StructType([StructField("since", LongType()), StructField("last", LongType())])

    def follow(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, last = state.get if state.exists else (None, None)
        points = pd.concat(list(batches)).drop_duplicates("g").sort_values("g")
        out = []
        for at, active in zip(points["g"].tolist(), points["on"].tolist()):
            if since is not None and (not active or at != last + 1):
                out.append((since, last + 1, "resolved"))
                since = None
            if active:
                if since is None:
                    since = at
                    out.append((since, at, "pending"))
                if at - since == need:
                    out.append((since, at, "firing"))
            last = at
        state.update((since, last))
        yield pd.DataFrame({
            "series": [group[0]] * len(out), "g_active": [o[0] for o in out], "g": [o[1] for o in out],
            "status": [o[2] for o in out]}).astype({"g_active": "int64", "g": "int64"})

    return rows.groupBy("series").applyInPandasWithState(follow, kind, held, "append", GroupStateTimeout.NoTimeout)


def alerts_from_changes(changes: DataFrame) -> DataFrame:
    """One row per alert from its transitions."""
    def at(status: str):
        return F.max(F.when(F.col("status") == status, F.col("g")))
    return changes.groupBy("series", "g_active").agg(at("firing").alias("g_firing"), at("resolved").alias("g_resolved"))
