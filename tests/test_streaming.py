from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import accounts
from tallyloom.streaming import events as streams

START = datetime(2024, 1, 1)


@pytest.fixture
def parts(spark, tmp_path):
    """Five files in time order, written one after the other."""
    source = str(tmp_path / "in")
    df = spark.range(500).select(
        F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "error").otherwise("view").alias("kind"),
        (F.lit(START) + F.make_interval(mins=F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts"))

    def write(*numbers):
        for n in numbers:
            df.where((F.col("event_id") >= n * 100) & (F.col("event_id") < n * 100 + 100)).coalesce(1).write.mode("append").parquet(source)
    return source, df, write


def test_ingest_continues_after_a_restart(spark, tmp_path, parts):
    source, df, write = parts
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    write(0, 1)
    first = streams.run_available(streams.read_events(spark, source, df.schema, files_per_trigger=1), out, state)
    assert spark.read.parquet(out).count() == 200 and first["batches"] >= 2
    write(2)
    streams.run_available(streams.read_events(spark, source, df.schema), out, state)
    assert spark.read.parquet(out).count() == 300


def test_windows_equal_batch_and_late_rows_are_counted(spark, tmp_path, parts):
    source, df, write = parts
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = streams.read_events(spark, source, df.schema, files_per_trigger=1)
        return streams.run_available(streams.windowed_counts(stream, "ts", "1 hour", "15 minutes", ["kind"], "10 minutes"), out, state)

    write(0, 1, 2)
    run()
    write(3, 4)
    assert run()["late_rows"] == 0
    batch = df.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour", "15 minutes"), "kind").count()
    closed = batch.where(F.col("window.end") <= F.lit(START + timedelta(minutes=499 - 10)))
    want = {(r["window"]["start"], r["kind"], r["count"]) for r in closed.collect()}
    found = [(r["start"], r["kind"], r["n"]) for r in spark.read.parquet(out).collect()]
    assert set(found) == want and len(found) == len(want)
    write(0)
    assert run()["late_rows"] > 0
    assert spark.read.parquet(out).count() == len(want)


def test_latest_state_survives_restart(spark, tmp_path, parts):
    source, df, write = parts
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = streams.read_events(spark, source, df.schema, files_per_trigger=1)
        streams.run_available(streams.latest_changes(stream, "user_id", "ts", "event_id", "kind"), out, state)

    write(0, 3)
    run()
    write(1)  # older rows must not replace newer ones
    run()
    found = accounts.latest_per_key(spark.read.parquet(out), "user_id", ["at", "tie"]).collect()
    assert {(r["user_id"], r["tie"]) for r in found} == {(i % 7, i) for i in range(393, 400)}
    assert spark.read.parquet(out).where("tie between 100 and 199").count() == 0


def test_first_seen_across_batches(spark, tmp_path, parts):
    source, df, write = parts
    write(0, 1, 2)
    stream = streams.read_events(spark, source, df.schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    streams.run_available(streams.first_seen(stream, ["user_id", "kind"], "ts", "2 days"), out, str(tmp_path / "state"))
    found = spark.read.parquet(out)
    assert sorted((r["user_id"], r["kind"]) for r in found.collect()) == sorted(
        (r["user_id"], r["kind"]) for r in df.where("event_id < 300").select("user_id", "kind").distinct().collect())
    assert {r["event_id"] for r in found.collect()} == {r["event_id"] for r in accounts.first_per_key(
        df, ["user_id", "kind"], ["ts"]).collect()}


def test_hold_state_equals_batch_over_many_batches(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    on = [1, 1, 1, 0, 1, 1, 1, 1, 0, 1, 1, 1]
    schema = "series string, g long, on boolean"
    for cut in (slice(0, 2), slice(2, 5), slice(5, 12)):
        points = [(s, g, bool(v)) for s in ("a", "b") for g, v in list(enumerate(on))[cut]]
        spark.createDataFrame(points, schema).coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_events(spark, source, spark.read.parquet(source).schema)
        streams.run_available(streams.hold_changes(stream, "series", "g", "on", 3), out, state)
    found = streams.alerts_from_changes(spark.read.parquet(out)).where("series = 'a'").orderBy("g_active").collect()
    assert [tuple(r)[1:] for r in found] == [(0, None, 3), (4, 7, 8), (9, None, None)]
