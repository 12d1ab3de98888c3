"""Keyed streams with timers: unordered input over many micro-batches gives the rows of the batch form."""

from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.columns import grid_index
from tallyloom.operators import accounts, alerts, series
from tallyloom.streaming import events as streams
from tallyloom.streaming import keyed

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, kind string, ts timestamp_ntz"
DELAY = timedelta(minutes=30)


def instant(value):
    return value.replace(tzinfo=UTC)


def made(n=600, seed=1):
    """Events of a few users in bursts; a third belong to one user."""
    rng = np.random.default_rng(seed)
    at = np.sort(rng.integers(0, 3 * 86_400, n) // rng.choice([1, 400], n) * 1)
    users = np.where(rng.random(n) < 0.33, 0, rng.integers(1, 8, n))
    return [(i, int(u), ["view", "error"][i % 3 == 0], START + timedelta(seconds=int(a), microseconds=int(i % 2) * 500)) for i, (u, a) in enumerate(zip(users, at, strict=True))]


class Feed:
    """A folder that grows file by file; rows of neighbouring files overlap in time within the delay."""

    def __init__(self, spark, folder):
        self.spark, self.source, self.out, self.state = spark, f"{folder}/in", f"{folder}/out", f"{folder}/state"
        self.clock = keyed.Clock(spark, f"{folder}/clock")
        spark.createDataFrame([], SCHEMA).write.parquet(self.source)

    def stream(self):
        schema = self.spark.createDataFrame([], SCHEMA).schema
        return streams.read_events(self.spark, self.source, schema)

    def play(self, rows, build, files=4):
        """Several runs over the same checkpoint, each a restart; then the clock ends the replay."""
        rng = np.random.default_rng(0)
        moved = sorted(rows, key=lambda r: r[3] + timedelta(minutes=int(rng.integers(0, 25))))
        late = 0
        with keyed.keyed_state(self.spark):
            for part in np.array_split(np.arange(len(moved)), files):
                self.spark.createDataFrame([moved[i] for i in part], SCHEMA).coalesce(1).write.mode("append").parquet(self.source)
                late += streams.run_available(build(self.stream()), self.out, self.state)["late_rows"]
        as_of = max(r[3] for r in rows)
        late += keyed.replay(build(self.stream()), self.clock, self.out, self.state, instant(as_of) + timedelta(hours=1), DELAY)["late_rows"]
        assert late == 0
        return self.spark.read.parquet(self.out)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, str(tmp_path))


RULES = [{"alert": "Many", "by": "kind", "window": 3600, "above": 6, "hold": 1000},
         {"alert": "Busy", "by": "user_id", "window": 1800, "above": 2, "hold": 900}]


def test_alert_hold_equals_batch(spark, feed):
    rows = made()
    found = keyed.alert_rows(feed.play(rows, lambda s: keyed.alert_changes(s, "ts", RULES, 300, feed.clock, "30 minutes")))
    df = spark.createDataFrame(rows, SCHEMA)
    until = (max(r[3] for r in rows) + timedelta(hours=1) - datetime(1970, 1, 1)) // timedelta(seconds=300)
    want = set()
    for r in RULES:
        counts = series.step_counts(df.withColumn("series", F.col(r["by"]).cast("string")), "ts", 300, ["series"])
        each = series.windowed(counts, ["series"], ["n"], r["window"], 300, until)
        rule = {"alert": r["alert"], "severity": "s", "category": "c", "hold": r["hold"], "op": ">", "threshold": r["above"]}
        held = alerts.hold(alerts.active(each, [rule], "n"), ["series"], 300, until)
        want |= {tuple(x) for x in held.select("alertname", "series", "g_active", "g_firing", "g_resolved").collect()}
    got = [tuple(x) for x in found.collect()]
    assert set(got) == want and len(got) == len(want) and any(g[3] for g in got) and len({g[1] for g in got}) > 4


def test_silent_targets_equal_gaps(feed):
    rows = made()
    as_of = max(r[3] for r in rows) + timedelta(hours=1)
    found = keyed.down_spans(feed.play(rows, lambda s: keyed.down_changes(s, "user_id", "ts", 5400, feed.clock, "30 minutes")), "user_id")
    micro = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    want, age = set(), timedelta(seconds=5400)
    for user in {r[1] for r in rows}:
        times = sorted({r[3] for r in rows if r[1] == user})
        for a, b in zip(times, [*times[1:], None], strict=True):
            if (b or as_of) - a > age:
                want.add((user, micro(a + age), b and micro(b)))
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_request_counts_equal_batch(spark, feed):
    rows = made()
    found = feed.play(rows, lambda s: keyed.request_counts(s, "user_id", "ts", "event_id", 3600, feed.clock, "30 minutes"))
    batch = accounts.sliding_count(spark.createDataFrame(rows, SCHEMA).select("event_id", "user_id", "ts"), "user_id", "ts")
    want = sorted((r.event_id, r.requests) for r in batch.collect())
    assert sorted((r.id, r.requests) for r in found.collect()) == want and max(n for _, n in want) > 5
    left = keyed.state_rows(spark, feed.state, "ring")
    end = (max(r[3] for r in rows) + timedelta(hours=1) - datetime(1970, 1, 1)) // timedelta(minutes=15)
    assert all(r.slice + 5 >= end for r in left.collect())  # the ring lasts one window beyond a slice's end


def test_expired_records_equal_batch(spark, feed):
    rows, ttl = made(), timedelta(hours=2)
    as_of = max(r[3] for r in rows) + timedelta(hours=1)
    gone = feed.play(rows, lambda s: keyed.expired_records(s, "user_id", "ts", "event_id", "kind", 7200, feed.clock, "30 minutes"))
    live = keyed.live_records(spark, feed.state, "user_id")
    want_gone, want_live = set(), set()
    for user in {r[1] for r in rows}:
        mine = sorted((r[3], r[0]) for r in rows if r[1] == user)
        for (at, i), after in zip(mine, [*mine[1:], None], strict=True):
            if after is None and at + ttl > as_of:
                want_live.add((user, i))
            elif after is None or after[0] - at > ttl:
                want_gone.add((user, i))
    assert {(r.user_id, r.tie) for r in gone.collect()} == want_gone and gone.count() == len(want_gone)
    assert {(r.user_id, r.tie) for r in live.collect()} == want_live


def test_rows_beyond_the_watermark_are_dropped_and_counted(spark, feed):
    first = [(i, 1, "view", START + timedelta(minutes=i)) for i in range(120)]
    build = lambda s: keyed.request_counts(s, "user_id", "ts", "event_id", 3600, feed.clock, "30 minutes")
    with keyed.keyed_state(spark):
        for part in (first, [(500, 1, "view", START)]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(feed.source)
            late = streams.run_available(build(feed.stream()), feed.out, feed.state)["late_rows"]
    assert late == 1 and spark.read.parquet(feed.out).where("id = 500").count() == 0


def test_open_windows_are_in_the_state(spark, feed):
    rows = made()
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(feed.source)
    streams.run_available(streams.windowed_counts(feed.stream(), "ts", "1 hour", "15 minutes", ["kind"], "30 minutes"), feed.out, feed.state)
    every = streams.all_windows(spark, feed.out, feed.state, ["kind"])
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour", "15 minutes"), "kind").count()
    want = {(r.window.start, r.kind, r["count"]) for r in batch.collect()}
    got = [(r.start, r.kind, r.n) for r in every.collect()]
    assert set(got) == want and len(got) == len(want) and spark.read.parquet(feed.out).count() < len(want)


def test_counters_go_on_from_facts(spark, feed):
    rows = made(200)
    stored = spark.createDataFrame([("view", 1000, 5), ("other", 3, 3)], "kind string, n long, units long")
    with keyed.keyed_state(spark):
        for part in (rows[:90], rows[90:]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(feed.source)
            streams.run_available(keyed.running_counters(feed.stream(), "kind", F.col("event_id"), stored), feed.out, feed.state)
    last = {r.kind: (r.n, r.units) for r in spark.read.parquet(feed.out).groupBy("kind").agg(F.max("n").alias("n"), F.max("units").alias("units")).collect()}
    views = [r[0] for r in rows if r[2] == "view"]
    assert last == {"view": (1000 + len(views), 5 + sum(views)), "error": (200 - len(views), sum(range(200)) - sum(views))}
    assert {r.kind: r.n for r in keyed.state_rows(spark, feed.state, "total").collect()}["other"] == 3


def test_null_keys_and_times(spark, feed):
    rows = [(1, None, None, START), (2, 1, "view", None), (None, 1, "view", START), (4, 1, "view", START)]
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(feed.source)
    found = keyed.request_counts(feed.stream(), "user_id", "ts", "event_id", 3600, feed.clock, "30 minutes")
    keyed.replay(found, feed.clock, feed.out, feed.state, instant(START), DELAY)
    assert sorted((r.id, r.requests) for r in spark.read.parquet(feed.out).collect()) == [(-1, 2), (4, 2)]


def test_grid_point_of_an_event_is_never_before_it(spark):
    at = spark.createDataFrame([(START,), (START + timedelta(microseconds=1),)], "ts timestamp_ntz")
    assert [r.g % 4 for r in at.select(grid_index("ts", 900).alias("g")).collect()] == [0, 1]
