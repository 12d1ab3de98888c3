"""Streaming operators replaying the event table; results equal the batch form."""

from __future__ import annotations

from datetime import UTC, timedelta

from pyspark.sql import functions as F

from tallyloom.functions.columns import from_micros, grid_index
from tallyloom.operators import accounts, drift, series
from tallyloom.operators.profile import class_distribution
from tallyloom.plans.metric_queries import _AT, _GRID, STEP, WINDOW, _ratio_sql
from tallyloom.plans.registry import query, rounded
from tallyloom.session import scratch_path
from tallyloom.streaming import events as streams
from tallyloom.streaming import keyed


def _replay(t):
    return streams.read_events(t.spark, t.folder, t.events.schema, "events.parquet")


def _run(t, stream, purpose, partition_by=()):
    out = scratch_path(t.spark, purpose)
    streams.run_available(stream, out, scratch_path(t.spark, f"{purpose}-state"), partition_by)
    return out


def _windows(t, counted, purpose, by):
    """All windows of a replay: those the watermark closed and those still open at its end."""
    out, state = scratch_path(t.spark, purpose), scratch_path(t.spark, f"{purpose}-state")
    streams.run_available(counted, out, state)
    return streams.all_windows(t.spark, out, state, by)


def _to_end(t, clock, stream, purpose, as_of, delay):
    """Replay until the watermark has passed `as_of`; the written changes and the checkpoint."""
    out, state = scratch_path(t.spark, purpose), scratch_path(t.spark, f"{purpose}-state")
    keyed.replay(stream, clock, out, state, as_of, delay)
    return t.spark.read.parquet(out), state


@query("stream_append", "SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_append(t):
    out = _run(t, _replay(t).withColumn("date", F.to_date("ts")), "ingest", ["date"])
    return t.spark.read.parquet(out).groupBy("date", "event_type").agg(F.count("*").alias("n"))


@query("stream_windowed_counts", """
WITH w AS (SELECT event_type, unnest(range(0, 4)) AS k, time_bucket(INTERVAL 15 MINUTE, ts) AS b FROM events)
SELECT b - k * INTERVAL 15 MINUTE AS start, b - k * INTERVAL 15 MINUTE + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n FROM w
GROUP BY ALL
""")
def stream_windowed_counts(t):
    counted = streams.windowed_counts(_replay(t), "ts", "1 hour", "15 minutes", ["event_type"], "10 minutes")
    found = _windows(t, counted, "windows", ["event_type"])
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(t):
    seen = streams.first_seen(_replay(t).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "40 days")
    return t.spark.read.parquet(_run(t, seen, "dedup")).select("user_id", "event_type")


@query("stream_latest_per_key", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1
""")
def stream_latest_per_key(t):
    changes = t.spark.read.parquet(_run(t, streams.latest_changes(_replay(t), "user_id", "ts", "event_id", "event_type"), "latest"))
    return accounts.latest_per_key(changes, "user_id", ["at", "tie"]).select(
        "user_id", F.col("tie").alias("event_id"), F.col("value").alias("event_type"))


@query("stream_alert_hold", f"""
WITH {_GRID}, r AS ({_ratio_sql("event_type = 'error'", 'true')}),
act AS (SELECT g FROM r WHERE part / greatest(whole, 0.001) > 0.25),
isl AS (SELECT g, g - row_number() OVER (ORDER BY g) AS island FROM act),
sp AS (SELECT min(g) AS ga, max(g) + 1 AS ge FROM isl GROUP BY island)
SELECT 'HighErrorRate' AS series, {_AT.format('ga')} AS active_at,
       CASE WHEN ga + 2 < ge THEN {_AT.format('(ga + 2)')} END AS firing_at, CASE WHEN ge <= hi THEN {_AT.format('ge')} END AS resolved_at
FROM sp, lim
""")
def stream_alert_hold(t):
    counts = series.step_counts(t.events, "ts", STEP, [], {"part": F.count_if(F.col("event_type") == "error"), "whole": F.count("*")})
    ratio = series.windowed(counts, [], ["part", "whole"], WINDOW, STEP)
    high = F.col("part") / float(WINDOW) / F.greatest(F.col("whole") / float(WINDOW), F.lit(0.001)) > 0.25
    points = ratio.select(
        F.lit("HighErrorRate").alias("series"), F.explode(F.sequence("g_from", F.col("g_to") - 1)).alias("g"), high.alias("on"))
    source = scratch_path(t.spark, "grid")
    points.write.parquet(source)
    changes = streams.hold_changes(streams.read_events(t.spark, source, points.schema), "series", "g", "on", 2)
    found = streams.alerts_from_changes(t.spark.read.parquet(_run(t, changes, "hold")))
    return found.select("series", *[
        series.grid_time(F.col(f"g_{c}"), STEP).alias(f"{n}") for c, n in (("active", "active_at"), ("firing", "firing_at"), ("resolved", "resolved_at"))])


@query("stream_drift_by_day", """
WITH base AS (SELECT user_id % 40 AS label, count(*) AS nb FROM events GROUP BY 1),
bs AS (SELECT label, greatest(nb / sum(nb) OVER (), 1e-6) AS b FROM base),
ev AS (SELECT date_trunc('day', ts) AS period, user_id % 40 AS label, count(*) AS nc FROM events GROUP BY ALL),
pt AS (SELECT period, sum(nc) AS n FROM ev GROUP BY 1),
g AS (SELECT pt.period, n, b, greatest(coalesce(nc, 0) / n, 1e-6) AS c FROM pt CROSS JOIN bs LEFT JOIN ev ON ev.period = pt.period AND ev.label = bs.label)
SELECT CAST(period AS TIMESTAMP) AS period, CAST(any_value(n) AS BIGINT) AS n_current, round(sum(abs(round((c - b) * ln(c / b), 5))), 7) AS total_psi,
       round(0.5 * sum(abs(c - b)), 7) AS total_variation, count(*) FILTER (abs(c - b) / b > 0.05) AS shifted_classes
FROM g GROUP BY period
""")
def stream_drift_by_day(t):
    labelled = _replay(t).withColumn("label", F.col("user_id") % 40)
    daily = _windows(t, streams.windowed_counts(labelled, "ts", "1 day", "1 day", ["label"], "1 hour"), "daily", ["label"])
    counts = daily.select(F.col("start").cast("timestamp_ntz").alias("period"), "label", F.col("n").alias("nc"))
    baseline = class_distribution(t.events.select((F.col("user_id") % 40).alias("label")), "label")
    found = drift.drift_of_counts(counts, baseline, "label").select("period", "n_current", "total_psi", "total_variation", "shifted_classes")
    return rounded(found, 7, "total_psi", "total_variation")


SERIES_RULES = [
    {"alert": "TypeBurst", "by": "event_type", "window": WINDOW, "above": 4, "hold": 1800},
    {"alert": "UserBreach", "by": "user_id", "window": WINDOW, "above": 1, "hold": 900},
]
DELAY = timedelta(minutes=10)
SILENT = 4 * 3600
TTL = 24 * 3600


def _instant(value):
    """A scalar timestamp without zone as an instant."""
    return value.replace(tzinfo=UTC)


def _last(t):
    return t.events.agg(F.max("ts").alias("ts")).first()["ts"]


@query("stream_alert_series", f"""
WITH {_GRID},
sr AS (SELECT 'TypeBurst' AS alertname, 4 AS above, 2 AS need, event_type AS series, g FROM ev
       UNION ALL SELECT 'UserBreach', 1, 1, CAST(user_id AS VARCHAR), g FROM ev),
c AS (SELECT alertname, above, need, series, g, count(*) AS n FROM sr GROUP BY ALL),
s AS (SELECT f.alertname, f.above, f.need, f.series, gr.g FROM (SELECT alertname, above, need, series, min(g) AS lo FROM c GROUP BY ALL) f JOIN gr ON gr.g >= f.lo),
w AS (SELECT s.*, sum(coalesce(n, 0)) OVER (PARTITION BY s.alertname, s.series ORDER BY s.g ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v
      FROM s LEFT JOIN c ON c.alertname = s.alertname AND c.series = s.series AND c.g = s.g),
isl AS (SELECT *, g - row_number() OVER (PARTITION BY alertname, series ORDER BY g) AS island FROM w WHERE v > above),
sp AS (SELECT alertname, series, need, min(g) AS ga, max(g) + 1 AS ge FROM isl GROUP BY alertname, series, need, island)
SELECT alertname, series, {_AT.format('ga')} AS active_at, CASE WHEN ga + need < ge THEN {_AT.format('(ga + need)')} END AS firing_at,
       CASE WHEN ge <= hi THEN {_AT.format('ge')} END AS resolved_at
FROM sp, lim
""")
def stream_alert_series(t):
    clock = keyed.Clock(t.spark)
    changes = keyed.alert_changes(_replay(t), "ts", SERIES_RULES, STEP, clock, "10 minutes")
    last = t.events.agg(F.max(series.grid_time(grid_index("ts", STEP), STEP)).alias("at")).first()["at"]
    found, _ = _to_end(t, clock, changes, "series", _instant(last), DELAY)
    return keyed.alert_rows(found).select("alertname", "series", *[
        series.grid_time(F.col(f"g_{c}"), STEP).alias(n) for c, n in (("active", "active_at"), ("firing", "firing_at"), ("resolved", "resolved_at"))])


@query("stream_target_down", f"""
WITH o AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next, (SELECT max(ts) FROM events) AS now FROM events)
SELECT user_id, ts + INTERVAL {SILENT} SECOND AS down_at, next AS up_at FROM o WHERE coalesce(next, now) - ts > INTERVAL {SILENT} SECOND
""")
def stream_target_down(t):
    clock = keyed.Clock(t.spark)
    changes = keyed.down_changes(_replay(t), "user_id", "ts", SILENT, clock, "10 minutes")
    now = _last(t)
    found, _ = _to_end(t, clock, changes, "silence", _instant(now), DELAY)
    spans = keyed.down_spans(found, "user_id").select("user_id", *[from_micros(F.col(c)).alias(c) for c in ("down_at", "up_at")])
    return spans.where(F.col("down_at") < F.lit(now))  # the watermark ends a millisecond or two after the last sample


@query("stream_rate_limit", """
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS requests FROM events
""")
def stream_rate_limit(t):
    clock = keyed.Clock(t.spark)
    counted = keyed.request_counts(_replay(t), "user_id", "ts", "event_id", accounts.HOUR, clock, "10 minutes")
    found, _ = _to_end(t, clock, counted, "requests", _instant(_last(t)), DELAY)
    return found.select(F.col("id").alias("event_id"), "user_id", "requests")


@query("stream_expired", f"""
WITH o AS (SELECT user_id, event_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next, (SELECT max(ts) FROM events) AS now FROM events)
SELECT user_id, event_id, event_type, CASE WHEN ts + INTERVAL {TTL} SECOND <= now THEN ts + INTERVAL {TTL} SECOND END AS expired_at
FROM o WHERE next IS NULL OR next - ts > INTERVAL {TTL} SECOND
""")
def stream_expired(t):
    clock = keyed.Clock(t.spark)
    gone = keyed.expired_records(_replay(t), "user_id", "ts", "event_id", "event_type", TTL, clock, "10 minutes")
    now = _last(t)
    found, state = _to_end(t, clock, gone, "records", _instant(now), DELAY)
    live = keyed.live_records(t.spark, state, "user_id").withColumn("expired_at", F.lit(None).cast("long"))
    at = from_micros(F.col("expired_at"))
    return found.unionByName(live).select(
        "user_id", F.col("tie").alias("event_id"), F.col("value").alias("event_type"), F.when(at <= F.lit(now), at).alias("expired_at"))


@query("stream_restored_counters", """
SELECT event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS units FROM events GROUP BY 1
""")
def stream_restored_counters(t):
    units = F.floor("value")
    before = F.col("ts") < F.lit(t.half).cast("timestamp_ntz")
    stored = t.events.where(before).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(units).cast("long").alias("units"))
    later = _replay(t).where(F.col("ts") >= F.lit(t.half).cast("timestamp"))
    with keyed.keyed_state(t.spark):
        out = _run(t, keyed.running_counters(later, "event_type", units, stored), "counters")
    newest = t.spark.read.parquet(out).unionByName(stored)
    return newest.groupBy("event_type").agg(F.max_by("units", "n").alias("units"), F.max("n").alias("n"))
