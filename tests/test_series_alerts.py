import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyloom.constants import ALERT_RULES, HISTOGRAM_BOUNDS
from tallyloom.functions.columns import histogram_quantile
from tallyloom.operators import alerts, series
from tallyloom.plans import monitoring

EPOCH = datetime(2024, 3, 1)
BASE = int(EPOCH.replace(tzinfo=timezone.utc).timestamp()) // 15


def at(seconds):
    return EPOCH + timedelta(seconds=seconds)


def log(spark, data):
    return spark.createDataFrame([(at(s), k, float(v)) for s, k, v in data], "ts timestamp, k string, v double")


def quantile_by_hand(q, bounds, counts):
    total = counts[-1]
    if total == 0:
        return None
    rank = q * total
    for i, bound in enumerate(bounds):
        if counts[i] >= rank:
            low = bounds[i - 1] if i else 0.0
            below = counts[i - 1] if i else 0
            return low + (bound - low) * (rank - below) / (counts[i] - below) if counts[i] > below else low
    return bounds[-1]


@pytest.mark.parametrize("counts,q", [
    ([0, 0, 0, 0], 0.5), ([4, 4, 4, 4], 0.5), ([0, 0, 0, 9], 0.95), ([1, 3, 7, 10], 0.5), ([1, 3, 7, 10], 0.95), ([0, 5, 5, 5], 0.2)])
def test_quantile_edges(spark, counts, q):
    bounds = [0.5, 1.0, 2.0]
    got = spark.createDataFrame([(counts,)], "c array<long>").select(histogram_quantile(q, bounds, F.col("c")).alias("x")).first()["x"]
    want = quantile_by_hand(q, bounds, counts)
    assert got == (pytest.approx(want) if want is not None else None)


def test_rate_grid_against_brute_force(spark):
    rng = random.Random(1)
    data = [(rng.choice([15 * rng.randint(0, 60), rng.randint(0, 900) + rng.random()]), rng.choice("aab"), 1) for _ in range(150)]
    df = log(spark, data)
    found = series.dense(series.windowed_rate(df, "ts", 120, 15, ["k"]), 15)
    got = {(r["k"], int((r["t"] - EPOCH).total_seconds())): r["n"] for r in found.collect()}
    last = max(math.ceil(s / 15) for s, _, _ in data)
    want = {}
    for k in "ab":
        first = min(math.ceil(s / 15) for s, k2, _ in data if k2 == k)
        for g in range(first, last + 1):
            t = g * 15
            # events are whole microseconds in the table
            want[(k, t)] = sum(1 for s, k2, _ in data if k2 == k and t - 120 < round(s, 6) <= t)
    assert got == want
    whole = series.merge_series(series.windowed_rate(df, "ts", 120, 15, ["k"]).drop("rate"), [], ["n"])
    both = {int((r["t"] - EPOCH).total_seconds()): (r["series"], r["n"]) for r in series.dense(whole, 15).collect()}
    for t, (live, n) in both.items():
        parts = [v for (k, t2), v in want.items() if t2 == t]
        assert (live, n) == (len(parts), sum(parts))


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_counters_of_hot_and_cold_series(spark, share):
    rng = random.Random(9)
    data = [(s, "hot" if s % 4 else f"c{s % 3}", rng.randint(0, 9)) for s in range(0, 4000, 7)]
    found = series.counter_deltas(log(spark, data), "ts", "v", ["k"], hot_share=share, chunk_seconds=60).collect()
    got = sorted(((r["ts"] - EPOCH).total_seconds(), r["delta"]) for r in found)
    last, want = {}, []
    for s, k, v in data:
        before = last.get(k)
        want.append((s, 0 if before is None else v - before if v >= before else v))
        last[k] = v
    assert got == want


def test_counter_resets(spark):
    data = [(0, "a", 5), (15, "a", 9), (30, "a", 2), (45, "a", 2), (86_400, "a", 10)]
    found = series.counter_deltas(log(spark, data), "ts", "v", ["k"]).orderBy("ts")
    assert [r["delta"] for r in found.collect()] == [0.0, 4.0, 2.0, 0.0, 8.0]
    grown = series.dense(series.counter_increase(log(spark, data[:4]), "ts", "v", 30, 15, ["k"]), 15).orderBy("t")
    assert [float(r["increase"]) for r in grown.collect()] == [0.0, 4.0, 6.0, 2.0]


def test_histogram_and_summary(spark, rows):
    df = log(spark, [(0, "a", 0.05), (1, "a", 0.3), (2, "a", 99)])
    found = series.histogram(df, "v", [0.05, 0.5], ["k"])
    assert rows(found, "le", "cumulative") == [("+Inf", 3), ("0.05", 1), ("0.5", 2)]
    assert series.summary(df, "v").first()["count"] == 3
    assert series.counter(df, ["k"]).first()["n"] == 3
    assert series.gauge_last(df, ["k"], "ts", "v").first()["value"] == 99.0
    up = series.target_up(df, ["k"], "ts", F.lit(at(32)), 30).first()
    assert (up["up"], up["age_s"]) == (1, 30.0)


def test_samples_go_stale(spark):
    df = log(spark, [(0, "a", 1), (400, "a", 0)])
    spans = [(r["g_from"] - BASE, r["g_to"] - BASE, r["value"]) for r in series.held_samples(df, "ts", "v", ["k"], 15, 300).orderBy("g_from").collect()]
    # the first sample is 300 s old at step 20 and no longer counts there
    assert spans == [(0, 20, 1.0), (27, 47, 0.0)]


def test_hold_resets_on_one_false_point(spark):
    on = [1, 1, 1, 0, 1, 1, 1, 1, 0, 1]
    df = spark.createDataFrame([(i, i + 1, v) for i, v in enumerate(on) if v], "g_from long, g_to long, value int").withColumn("series", F.lit("s"))
    rule = {"alert": "A", "severity": "warning", "category": "c", "hold": 45, "op": ">", "threshold": 0}
    found = alerts.hold(alerts.active(df, [rule]), ["series"], 15, 9).orderBy("g_active").collect()
    assert [(r["g_active"], r["g_firing"], r["g_resolved"], r["state"]) for r in found] == [
        (0, None, 3, "pending"), (4, 7, 8, "firing"), (9, None, None, "pending")]


def test_hold_between_grid_points_fires_at_the_next(spark):
    df = spark.createDataFrame([(0, 10, 1, "s")], "g_from long, g_to long, value int, series string")
    rule = {"alert": "A", "severity": "warning", "category": "c", "hold": 20, "op": "==", "threshold": 1}
    assert alerts.hold(alerts.active(df, [rule]), ["series"], 15, 20).first()["g_firing"] == 2


def alert(name, severity, category, fired, end, label="x"):
    return (name, severity, category, label, fired, fired, end, end, "firing")


ALERT = "alertname string, severity string, category string, series string, g_active long, g_firing long, g_resolved long, g_end long, state string"


def test_routes_first_match_wins(spark):
    df = spark.createDataFrame([
        alert("D", "critical", "database", 0, 5), alert("W", "warning", "database", 0, 5),
        alert("I", "info", "database", 0, 5), alert("N", "info", "api", 0, 5)], ALERT)
    found = {r["alertname"]: (r["receiver"], r["group_wait"], r["group_interval"], r["repeat_interval"]) for r in alerts.route(df).collect()}
    assert found == {
        "D": ("critical_alerts", 10, 300, 1800), "W": ("warning_alerts", 60, 300, 7200),
        "I": ("database_alerts", 15, 300, 1800), "N": ("default", 30, 300, 3600)}


def test_notifications_repeat_and_resolve(spark):
    df = spark.createDataFrame([
        alert("C", "critical", "api", 0, 100, "a"), alert("C", "critical", "api", 50, 300, "b"), alert("W", "warning", "api", 0, 3)], ALERT)
    found = alerts.notifications(df, 15, 1000).orderBy("sent_at").collect()
    got = [(r["alertname"], r["status"], int(r["sent_at"].replace(tzinfo=timezone.utc).timestamp())) for r in found]
    # one group for both C alerts, 0 s to 4500 s; W ends before its 60 s wait is over
    assert got == [("C", "firing", 10), ("C", "firing", 1810), ("C", "firing", 3610), ("C", "resolved", 4510)]


def test_muting_needs_overlap_and_equal_labels(spark):
    data = [alert("A_Critical", "critical", "cpu", 10, 20), alert("A_Warning", "warning", "cpu", 5, 12, "1"),
            alert("A_Warning", "warning", "cpu", 20, 30, "2"), alert("A_Warning", "warning", "memory", 5, 30, "3")]
    df = spark.createDataFrame(data, ALERT)
    by_category = alerts.inhibit(df, [{"source": {"severity": "critical"}, "target": {"severity": "warning"}, "equal": ["category"]}])
    assert {r["series"] for r in by_category.where("muted").collect()} == {"1"}
    # names differ between the two severities, so the shipped rule mutes nothing
    assert alerts.inhibit(df).where("muted").count() == 0


def test_muting_against_pairs(spark):
    rng = random.Random(2)
    data = []
    for i in range(120):
        start = rng.randint(0, 300)
        data.append(alert("A", rng.choice(["critical", "warning"]), rng.choice("ab"), start, start + rng.randint(1, 20), str(i)))
    found = alerts.inhibit(spark.createDataFrame(data, ALERT))
    got = {r["series"] for r in found.where("muted").collect()}
    want = {w[3] for w in data if w[1] == "warning" and any(
        c[1] == "critical" and c[2] == w[2] and c[5] < w[7] and c[7] > w[5] for c in data)}
    assert got == want and found.count() == 120


# --- all shipped rules --------------------------------------------------------------------------------
def shipped_log():
    """Ten minutes in which every rule's condition holds long enough, and one quiet series."""
    out = []
    for s in range(0, 600):
        t = s + 0.5
        for k in range(9):
            out.append((t, "api_requests_total", {"endpoint": "/predict", "method": "POST", "status_code": "500" if k == 0 else "200"}, 1))
        out.append((t, "inference_latency_seconds", {"mode": "single"}, 6.0))
        out.append((t, "prediction_confidence", {"predicted_class": "nv"}, 0.2))
        out.append((t, "request_memory_usage_mb", {"endpoint": "/predict"}, 1500.0))
        out.append((t, "high_risk_predictions_total", {}, 1))
        out.append((t, "feedback_total", {"vote": "thumbs_down" if s % 3 else "thumbs_up"}, 1))
        out.append((t, "user_rate_limit_breach_total", {"uid": "1", "username": "busy"}, 1))
        if s % 100 == 0:
            out.append((t, "user_rate_limit_breach_total", {"uid": "2", "username": "calm"}, 1))
        if s % 15 == 0:
            node = {"job": "node_exporter"}
            out.append((t, "model_loaded", {}, 0))
            out.append((t, "node_memory_MemAvailable_bytes", node, 5.0))
            out.append((t, "node_memory_MemTotal_bytes", node, 100.0))
            out.append((t, "up", {"job": "fastapi_backend"}, 0))
            out.append((t, "up", {"job": "prometheus"}, 1))
            out.append((t, "mongodb_up", {"job": "mongodb_exporter"}, 0))
            out.append((t, "users_registered_total", {}, s // 15))
            for cpu in "01":
                out.append((t, "node_cpu_seconds_total", {**node, "mode": "idle", "cpu": cpu}, 1000 + s * 0.1))
                out.append((t, "node_cpu_seconds_total", {**node, "mode": "user", "cpu": cpu}, 1000 + s * 0.9))
    return out


@pytest.fixture(scope="module")
def shipped(spark):
    data = [(at(s), m, l, float(v)) for s, m, l, v in shipped_log()]
    return spark.createDataFrame(data, "ts timestamp, metric string, labels map<string,string>, value double").cache()


def test_all_twenty_rules_fire(spark, shipped):
    assert len(ALERT_RULES) == 20
    found, until = monitoring.evaluate(shipped)
    firing = {}
    for r in found.where("state = 'firing'").collect():
        firing.setdefault(r["alertname"], []).append(r)
    assert set(firing) == {r["alert"] for r in ALERT_RULES}
    # the gauge is first seen at step 1; 20 s later lies between steps 2 and 3
    loaded = firing["ModelNotLoaded"][0]
    assert (loaded["g_active"] - BASE, loaded["g_firing"] - BASE) == (1, 3)
    down, long_down = firing["MongoDBDown"][0], firing["MongoDBDown_Sustained"][0]
    assert (down["g_firing"] - down["g_active"], long_down["g_firing"] - long_down["g_active"]) == (3, 8)
    breach = firing["UserRateLimitBreach"]
    assert [[tuple(e) for e in r["series"]] for r in breach] == [[("username", "busy")]]
    # 11 breaches need 11 seconds, so the first step already holds 15
    assert breach[0]["g_active"] - BASE == 1 and breach[0]["g_firing"] - BASE == 3
    # nine requests a second reach more than 8/s over one minute after 54 of 60 seconds
    assert firing["HighRequestVolume"][0]["g_active"] - BASE == 4


def test_signals_have_the_expected_values(spark, shipped):
    steps = monitoring.step_table(shipped)
    until = BASE + 40
    named = {r["alert"]: r["signal"] for r in ALERT_RULES}

    def value(name, g):
        sig = monitoring.signals(steps, [named[name]], until)
        return [r["value"] for r in sig.where((F.col("g_from") <= BASE + g) & (F.col("g_to") > BASE + g)).collect()]

    assert value("HighErrorRate", 30) == pytest.approx([1 / 9])
    assert value("SystemMemory_Critical", 30) == pytest.approx([95.0])
    assert value("SystemCPU_Critical", 30) == pytest.approx([90.0])
    assert value("NegativeFeedbackSpike", 30) == pytest.approx([(200 / 300) / (100 / 300 + 0.001)])
    assert value("RegistrationSpike", 30) == pytest.approx([20.0])
    assert value("HighRiskPredictionSpike", 30) == pytest.approx([1.0])
    assert value("HighActiveRequests", 30) == pytest.approx([8.0])
    assert value("HighInferenceLatency_Critical", 30) == pytest.approx([9.75])
    bounds = HISTOGRAM_BOUNDS["prediction_confidence"]
    assert value("LowPredictionConfidence", 30) == pytest.approx([quantile_by_hand(0.5, bounds, [0] + [300] * 10)])


def test_quiet_log_raises_nothing(spark):
    data = [(at(s), "api_requests_total", {"status_code": "200"}, 1.0) for s in range(0, 600, 30)]
    df = spark.createDataFrame(data, "ts timestamp, metric string, labels map<string,string>, value double")
    assert monitoring.evaluate(df)[0].count() == 0
