"""Metrics and alerts on the event table. Windows and thresholds are scaled to its density."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.columns import clamp_min
from tallyloom.operators import alerts, series
from tallyloom.plans import monitoring
from tallyloom.plans.monitoring import sample
from tallyloom.plans.registry import query, rounded
from tallyloom.session import spread

STEP = 900
WINDOW = 3600
BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 200.0, 400.0]


@query("request_counts", """
SELECT event_type AS endpoint, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status_code, count(*) AS n FROM events GROUP BY ALL
""")
def request_counts(t):
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    return series.counter(t.events, [F.col("event_type").alias("endpoint"), status.alias("status_code")])


@query("outcome_counts", """
SELECT 'images_processed' AS metric, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS label, count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT 'errors', CASE WHEN value > 50 THEN 'internal' ELSE 'http' END, count(*) FROM events WHERE event_type = 'error' GROUP BY ALL
""")
def outcome_counts(t):
    failed = F.col("event_type") == "error"
    outcome = F.struct(F.lit("images_processed").alias("metric"), F.when(failed, "failed").otherwise("success").alias("label"))
    error = F.when(failed, F.struct(
        F.lit("errors").alias("metric"), F.when(F.col("value") > 50, "internal").otherwise("http").alias("label")))
    tagged = t.events.select(F.explode(F.array_compact(F.array(outcome, error))).alias("m")).select("m.*")
    return series.counter(tagged, ["metric", "label"])


@query("gauge_last", "SELECT event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS last_ts FROM events GROUP BY 1")
def gauge_last(t):
    return series.gauge_last(t.events, ["event_type"], "ts", "value", "event_id")


@query("histogram_buckets", """
SELECT event_type, le, count(*) FILTER (value <= CAST(le AS DOUBLE)) AS cumulative
FROM events, (SELECT unnest(['5.0', '10.0', '25.0', '50.0', '100.0', '200.0', '400.0']) AS le) GROUP BY ALL
UNION ALL SELECT event_type, '+Inf', count(*) FROM events GROUP BY 1
""")
def histogram_buckets(t):
    return series.histogram(t.events, "value", BOUNDS, ["event_type"])


@query("summary_agg", 'SELECT event_type, count(value) AS count, round(sum(value), 4) AS "sum" FROM events GROUP BY 1')
def summary_agg(t):
    return rounded(series.summary(t.events, "value", ["event_type"]), 4, "sum")


@query("target_up", """
SELECT user_id, max(ts) AS last_ts, round(date_diff('microsecond', max(ts), (SELECT max(ts) FROM events)) / 1e6, 6) AS age_s,
       CAST(date_diff('microsecond', max(ts), (SELECT max(ts) FROM events)) <= 14400000000 AS INTEGER) AS up
FROM events GROUP BY 1
""")
def target_up(t):
    now = t.events.agg(F.max("ts")).scalar()
    return rounded(series.target_up(t.events, ["user_id"], "ts", now, 14400), 6, "age_s")


_GRID = """
ev AS (SELECT *, CAST(ceil(epoch_us(ts) / 900000000.0) AS BIGINT) AS g FROM events),
lim AS (SELECT min(g) AS lo, max(g) AS hi FROM ev),
gr AS (SELECT unnest(range(lo, hi + 1)) AS g FROM lim)
"""
_AT = "CAST(make_timestamp({} * 900000000) AS TIMESTAMP)"


def _windowed(by: str, value: str) -> str:
    """Dense (by, g, v): sum of `value` over the four steps up to g, from each series' first step on."""
    return f"""
    SELECT s.{by}, s.g, CAST(coalesce(sum(c.v) OVER (PARTITION BY s.{by} ORDER BY s.g ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0) AS DOUBLE) AS v
    FROM (SELECT f.{by}, gr.g FROM (SELECT {by}, min(g) AS lo FROM ev GROUP BY 1) f JOIN gr ON gr.g >= f.lo) s
    LEFT JOIN (SELECT {by}, g, {value} AS v FROM ev GROUP BY ALL) c ON c.{by} = s.{by} AND c.g = s.g
    """


@query("windowed_rate", f"""
WITH {_GRID}, w AS ({_windowed('event_type', 'count(*)')})
SELECT event_type, {_AT.format('g')} AS t, round(v / 3600, 9) AS rate FROM w
""")
def windowed_rate(t):
    found = series.dense(series.windowed_rate(t.events, "ts", WINDOW, STEP, ["event_type"]), STEP)
    return rounded(found.drop("n"), 9, "rate")


@query("user_rate", f"""
WITH {_GRID}, w AS ({_windowed('user_id', 'count(*)')})
SELECT user_id, {_AT.format('g')} AS t, CAST(v AS BIGINT) AS n FROM w WHERE v > 0
""")
def user_rate(t):
    found = series.windowed_rate(t.events, "ts", WINDOW, STEP, ["user_id"]).where("n > 0")
    return series.dense(found, STEP).drop("rate")


@query("rate_by_label", f"""
WITH {_GRID}, w AS ({_windowed('event_type', 'count(*)')})
SELECT event_type = 'error' AS failed, {_AT.format('g')} AS t, count(*) AS series, CAST(sum(v) AS BIGINT) AS n FROM w GROUP BY ALL
""")
def rate_by_label(t):
    each = series.windowed_rate(t.events, "ts", WINDOW, STEP, ["event_type"]).drop("rate")
    merged = series.merge_series(each.withColumn("failed", F.col("event_type") == "error"), ["failed"], ["n"])
    return series.dense(merged, STEP)


@query("counter_increase", f"""
WITH {_GRID},
d AS (SELECT event_type, g, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM ev),
i AS (SELECT event_type, g, sum(CASE WHEN prev IS NULL THEN 0 WHEN value >= prev THEN value - prev ELSE value END) AS v FROM d GROUP BY ALL),
s AS (SELECT f.event_type, gr.g FROM (SELECT event_type, min(g) AS lo FROM ev GROUP BY 1) f JOIN gr ON gr.g >= f.lo)
SELECT s.event_type, {_AT.format('s.g')} AS t,
       round(coalesce(sum(i.v) OVER (PARTITION BY s.event_type ORDER BY s.g ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0), 5) AS increase
FROM s LEFT JOIN i ON i.event_type = s.event_type AND i.g = s.g
""")
def counter_increase(t):
    found = series.counter_increase(t.events, "ts", "value", WINDOW, STEP, ["event_type"], "event_id")
    return series.dense(found, STEP).withColumn("increase", F.round(F.col("increase").cast("double"), 5))


def _quantile_sql(bounds, q: float, value: str, window: int = 4, where: str = "true") -> str:
    """(g, v): histogram quantile over the `window` steps up to g, over all labels."""
    cum = ", ".join([f"count(ev.g) FILTER ({value} <= {b})" for b in bounds] + ["count(ev.g)"])
    size = len(bounds)
    return f"""
    SELECT g, CASE WHEN c[{size + 1}] = 0 THEN NULL WHEN i IS NULL THEN {float(bounds[-1])}
                   ELSE lo + (hi - lo) * ({q} * c[{size + 1}] - below) / (c[i] - below) END AS v
    FROM (SELECT *, CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END AS lo, b[i] AS hi, CASE WHEN i = 1 THEN 0 ELSE c[i - 1] END AS below
          FROM (SELECT g, c, b, list_min(list_filter(range(1, {size + 1}), lambda k: c[k] >= {q} * c[{size + 1}])) AS i
                FROM (SELECT gr.g, [{cum}] AS c, {[float(b) for b in bounds]}::DOUBLE[] AS b
                      FROM gr LEFT JOIN ev ON ev.g > gr.g - {window} AND ev.g <= gr.g AND {where} GROUP BY 1)))
    """


@query("histogram_quantile", f"""
WITH {_GRID}, q AS ({_quantile_sql(BOUNDS, 0.95, 'value')})
SELECT {_AT.format('g')} AS t, round(v, 7) AS value FROM q
""")
def histogram_quantile(t):
    found = series.windowed_quantile(t.events, "ts", "value", BOUNDS, 0.95, WINDOW, STEP)
    return rounded(series.dense(found, STEP), 7, "value")


def _ratio_sql(part: str, whole: str) -> str:
    return f"""SELECT gr.g, count(ev.g) FILTER ({part}) / 3600.0 AS part, count(ev.g) FILTER ({whole}) / 3600.0 AS whole
               FROM gr LEFT JOIN ev ON ev.g > gr.g - 4 AND ev.g <= gr.g GROUP BY 1"""


def _ratio(t, part, whole, combine):
    steps = series.step_counts(t.events, "ts", STEP, [], {"part": F.count_if(part), "whole": F.count_if(whole)})
    summed = series.windowed(steps, [], ["part", "whole"], WINDOW, STEP)
    found = summed.withColumn("ratio", combine(F.col("part") / float(WINDOW), F.col("whole") / float(WINDOW)))
    return rounded(series.dense(found.drop("part", "whole"), STEP), 9, "ratio")


@query("error_ratio", f"""
WITH {_GRID}, r AS ({_ratio_sql("event_type = 'error'", 'true')})
SELECT {_AT.format('g')} AS t, round(part / greatest(whole, 0.001), 9) AS ratio FROM r
""")
def error_ratio(t):
    return _ratio(t, F.col("event_type") == "error", F.lit(True), lambda a, b: a / clamp_min(b, 0.001))


@query("negative_ratio", f"""
WITH {_GRID}, r AS ({_ratio_sql("event_type = 'view'", "event_type = 'click'")})
SELECT {_AT.format('g')} AS t, round(part / (whole + 0.001), 9) AS ratio FROM r
""")
def negative_ratio(t):
    return _ratio(t, F.col("event_type") == "view", F.col("event_type") == "click", lambda a, b: a / (b + 0.001))


# --- rules ----------------------------------------------------------------------------------------------
LATENCY_BOUNDS = [0.5, 1.0, 2.0, 4.0, 8.0, 16.0]
RULE_BOUNDS = {
    "inference_latency_seconds": LATENCY_BOUNDS,
    "prediction_confidence": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0],
}
_LATENCY = {"kind": "quantile", "metric": "inference_latency_seconds", "q": 0.95, "window": WINDOW}
RULES = [
    {"alert": "Latency_Critical", "signal": _LATENCY, "op": ">", "threshold": 7.0, "hold": 1800, "severity": "critical", "category": "inference"},
    {"alert": "Latency_Warning", "signal": _LATENCY, "op": ">", "threshold": 5.0, "hold": 2000, "severity": "warning", "category": "inference"},
    {"alert": "LowConfidence", "signal": {"kind": "quantile", "metric": "prediction_confidence", "q": 0.5, "window": WINDOW},
     "op": "<", "threshold": 0.3, "hold": 1800, "severity": "warning", "category": "inference"},
    {"alert": "HighErrorRate", "signal": {"kind": "ratio", "metric": "api_requests_total", "window": WINDOW, "match": {"status_code": "4..|5.."},
                                          "over": {}, "floor": 0.001, "floor_mode": "clamp"},
     "op": ">", "threshold": 0.25, "hold": 900, "severity": "critical", "category": "api"},
    {"alert": "NegativeFeedback", "signal": {"kind": "ratio", "metric": "feedback_total", "window": WINDOW, "match": {"vote": "thumbs_down"},
                                             "over": {"vote": "thumbs_up"}, "floor": 0.001, "floor_mode": "add"},
     "op": ">", "threshold": 1.2, "hold": 900, "severity": "warning", "category": "api"},
    {"alert": "UserBreach", "signal": {"kind": "increase", "metric": "user_rate_limit_breach_total", "window": WINDOW, "by": ["username"], "match": {}},
     "op": ">", "threshold": 1.0, "hold": 900, "severity": "warning", "category": "abuse"},
    {"alert": "ModelNotLoaded", "signal": {"kind": "gauge", "metric": "model_loaded", "match": {}},
     "op": "==", "threshold": 0.0, "hold": 1200, "severity": "critical", "category": "database"},
    {"alert": "GrowthSpike", "signal": {"kind": "sample_increase", "metric": "users_registered_total", "window": WINDOW, "match": {}},
     "op": ">", "threshold": 150.0, "hold": 0, "severity": "info", "category": "database"},
]
LOOKBACK = 7200


def samples(t):
    """The event table as metric samples: requests, latencies, confidences, votes, users and two gauges."""
    kind, value = F.col("event_type"), F.col("value")

    votes = F.when(kind == "click", "thumbs_up").otherwise("thumbs_down")
    rows = F.array_compact(F.array(
        sample("api_requests_total", {"endpoint": kind, "status_code": F.when(kind == "error", "500").otherwise("200")}),
        sample("inference_latency_seconds", {"mode": F.lit("single")}, value / 25),
        sample("prediction_confidence", {"predicted_class": kind}, F.least(value / 100, F.lit(1.0))),
        sample("feedback_total", {"vote": votes}, when=kind.isin("click", "view")),
        sample("user_rate_limit_breach_total", {"uid": F.col("user_id").cast("string"), "username": F.col("user_id").cast("string")}),
        sample("model_loaded", {}, (value >= 40).cast("double"), when=kind == "signup"),
        sample("users_registered_total", {}, value, when=kind == "purchase"),
    ))
    return spread(t.events).select("ts", F.explode(rows).alias("s")).select("ts", "s.*")


_ACTIVE = f"""
{_GRID},
lat AS ({_quantile_sql(LATENCY_BOUNDS, 0.95, 'value / 25')}),
conf AS ({_quantile_sql([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0], 0.5, 'least(value / 100, 1)')}),
er AS ({_ratio_sql("event_type = 'error'", 'true')}),
ng AS ({_ratio_sql("event_type = 'view'", "event_type = 'click'")}),
ub AS ({_windowed('user_id', 'count(*)')}),
sm AS (SELECT g, arg_max(CAST(value >= 40 AS INTEGER), ts) AS v, max(ts) AS ts FROM ev WHERE event_type = 'signup' GROUP BY 1),
gauge AS (SELECT gr.g, sm.v, sm.ts FROM gr ASOF JOIN sm ON gr.g >= sm.g),
pd AS (SELECT g, value, lag(value) OVER (ORDER BY ts, event_id) AS prev FROM ev WHERE event_type = 'purchase'),
pi AS (SELECT g, sum(CASE WHEN prev IS NULL THEN 0 WHEN value >= prev THEN value - prev ELSE value END) AS v FROM pd GROUP BY 1),
gs AS (SELECT gr.g, coalesce(sum(pi.v), 0) AS v FROM gr LEFT JOIN pi ON pi.g > gr.g - 4 AND pi.g <= gr.g GROUP BY 1),
act AS (
  SELECT 'Latency_Critical' AS alertname, 'critical' AS severity, 'inference' AS category, 1800 AS hold, '' AS series, g FROM lat WHERE v > 7
  UNION ALL SELECT 'Latency_Warning', 'warning', 'inference', 2000, '', g FROM lat WHERE v > 5
  UNION ALL SELECT 'LowConfidence', 'warning', 'inference', 1800, '', g FROM conf WHERE v < 0.3
  UNION ALL SELECT 'HighErrorRate', 'critical', 'api', 900, '', g FROM er WHERE part / greatest(whole, 0.001) > 0.25
  UNION ALL SELECT 'NegativeFeedback', 'warning', 'api', 900, '', g FROM ng WHERE part / (whole + 0.001) > 1.2
  UNION ALL SELECT 'UserBreach', 'warning', 'abuse', 900, 'username=' || user_id, g FROM ub WHERE v > 1
  UNION ALL SELECT 'ModelNotLoaded', 'critical', 'database', 1200, '', g FROM gauge
            WHERE v = 0 AND epoch_us(ts) + 7200000000 > g * 900000000
  UNION ALL SELECT 'GrowthSpike', 'info', 'database', 0, '', g FROM gs WHERE v > 150)
"""
_ALERTS = f"""
{_ACTIVE},
isl AS (SELECT *, g - row_number() OVER (PARTITION BY alertname, series ORDER BY g) AS island FROM act),
sp AS (SELECT alertname, severity, category, series, hold, min(g) AS ga, max(g) + 1 AS ge FROM isl
       GROUP BY alertname, severity, category, series, hold, island),
al AS (SELECT alertname, severity, category, series, ga, ge, CASE WHEN ge <= hi THEN ge END AS gr,
              CASE WHEN ga + CAST(ceil(hold / 900.0) AS BIGINT) < ge THEN ga + CAST(ceil(hold / 900.0) AS BIGINT) END AS gf FROM sp, lim)
"""


def evaluated(t):
    return monitoring.evaluate(samples(t), RULES, STEP, LOOKBACK, RULE_BOUNDS)


@query("rules_active", f"WITH {_ACTIVE} SELECT alertname, severity, count(*) AS points, count(DISTINCT series) AS series FROM act GROUP BY ALL")
def rules_active(t):
    steps = monitoring.durable(monitoring.step_table(samples(t), RULES, STEP, RULE_BOUNDS))
    until = steps.agg(F.max("g").alias("g")).first()["g"]
    found = monitoring.active_intervals(steps, RULES, until, STEP, LOOKBACK, RULE_BOUNDS)
    per_series = found.groupBy("alertname", "severity", "series").agg(F.sum(F.col("g_to") - F.col("g_from")).alias("points"))
    return per_series.groupBy("alertname", "severity").agg(F.sum("points").alias("points"), F.count("*").alias("series"))


@query("alert_firing", f"""
WITH {_ALERTS}
SELECT alertname, severity, category, series, CASE WHEN gf IS NULL THEN 'pending' ELSE 'firing' END AS state,
       {_AT.format('ga')} AS active_at, {_AT.format('gf')} AS firing_at, {_AT.format('gr')} AS resolved_at FROM al
""")
def alert_firing(t):
    return monitoring.with_times(evaluated(t)[0], STEP)


_ROUTED = f"""
{_ALERTS},
rt AS (SELECT *, CASE severity WHEN 'critical' THEN 'critical_alerts' WHEN 'warning' THEN 'warning_alerts'
                 ELSE CASE WHEN category = 'database' THEN 'database_alerts' ELSE 'default' END END AS receiver FROM al WHERE gf IS NOT NULL)
"""


@query("alert_route", f"""
WITH {_ROUTED}
SELECT alertname, receiver, CASE receiver WHEN 'critical_alerts' THEN 10 WHEN 'warning_alerts' THEN 60 WHEN 'database_alerts' THEN 15 ELSE 30 END AS group_wait,
       CASE receiver WHEN 'warning_alerts' THEN 7200 WHEN 'default' THEN 3600 ELSE 1800 END AS repeat_interval, count(*) AS n
FROM rt GROUP BY ALL
""")
def alert_route(t):
    found = evaluated(t)[0]
    return alerts.route(found.where("state = 'firing'")).groupBy("alertname", "receiver", "group_wait", "repeat_interval").agg(
        F.count("*").alias("n"))


@query("alert_notifications", f"""
WITH {_ROUTED},
pts AS (SELECT DISTINCT alertname, category, receiver, unnest(range(gf, ge)) AS g FROM rt),
isl2 AS (SELECT *, g - row_number() OVER (PARTITION BY alertname, category, receiver ORDER BY g) AS island FROM pts),
sp2 AS (SELECT alertname, category, receiver, min(g) * 900 AS s, (max(g) + 1) * 900 AS e, max(g) + 1 <= any_value(hi) AS done
        FROM isl2, lim GROUP BY alertname, category, receiver, island),
tm AS (SELECT *, s + CASE receiver WHEN 'critical_alerts' THEN 10 WHEN 'warning_alerts' THEN 60 WHEN 'database_alerts' THEN 15 ELSE 30 END AS f,
              CASE receiver WHEN 'warning_alerts' THEN 7200 WHEN 'default' THEN 3600 ELSE 1800 END AS rep FROM sp2)
SELECT alertname, category, receiver, 'firing' AS status, CAST(make_timestamp(told * 1000000) AS TIMESTAMP) AS sent_at
FROM (SELECT *, unnest(range(f, e, rep)) AS told FROM tm)
UNION ALL
SELECT alertname, category, receiver, 'resolved', CAST(make_timestamp(CAST(f + ceil((e - f) / 300.0) * 300 AS BIGINT) * 1000000) AS TIMESTAMP)
FROM tm WHERE done AND f < e
""")
def alert_notifications(t):
    found, until = evaluated(t)
    return alerts.notifications(found, STEP, until)


@query("alert_inhibit", f"""
WITH {_ALERTS}
SELECT alertname, severity, category, series, {_AT.format('gf')} AS firing_at,
       severity = 'warning' AND EXISTS (SELECT 1 FROM al s WHERE s.severity = 'critical' AND s.category = al.category AND s.gf IS NOT NULL
                                        AND s.gf < al.ge AND s.ge > al.gf) AS muted
FROM al WHERE gf IS NOT NULL
""")
def alert_inhibit(t):
    rule = {"source": {"severity": "critical"}, "target": {"severity": "warning"}, "equal": ["category"]}
    found = alerts.inhibit(evaluated(t)[0], [rule]).where("state = 'firing'")
    return monitoring.with_times(found, STEP, ["muted"]).drop("state", "active_at", "resolved_at")


HOST_RULES = [
    {"alert": "DiskFilling", "signal": {"kind": "used_percent", "metric": "disk_free_bytes", "total": "disk_size_bytes", "match": {}},
     "op": ">", "threshold": 80.0, "hold": 900, "severity": "warning", "category": "host"},
    {"alert": "CpuBusy", "signal": {"kind": "busy_percent", "metric": "cpu_seconds_total", "match": {"mode": "idle"}, "window": WINDOW},
     "op": ">", "threshold": 85.0, "hold": 1800, "severity": "warning", "category": "host"},
]


def host_samples(t):
    """The event table as host metrics: free and whole space per mount, and idle seconds per processor."""
    kind, value = F.col("event_type"), F.col("value")
    mounted = kind.isin("click", "view", "error")
    rows = F.array_compact(F.array(
        sample("disk_free_bytes", {"mount": kind}, value, when=mounted),
        sample("disk_size_bytes", {"mount": kind}, 100 + F.col("user_id") % 7, when=mounted),
        sample("cpu_seconds_total", {"cpu": kind, "mode": F.when(kind == "signup", "user").otherwise("idle")}, value * 20)))
    return t.events.select("ts", F.explode(rows).alias("s")).select("ts", "s.*")


@query("host_alerts", f"""
WITH {_GRID},
sm AS (SELECT event_type, g, arg_max((1 - value / (100 + user_id % 7)) * 100, ts) AS v, max(ts) AS ts FROM ev WHERE event_type IN ('click', 'view', 'error') GROUP BY ALL),
sg AS (SELECT event_type, g FROM (SELECT DISTINCT event_type FROM sm), gr),
used AS (SELECT sg.event_type, sg.g, sm.v, sm.ts FROM sg ASOF JOIN sm ON sg.event_type = sm.event_type AND sg.g >= sm.g),
pd AS (SELECT event_type, g, value * 20 AS value, lag(value * 20) OVER (PARTITION BY event_type ORDER BY ts) AS prev FROM ev WHERE event_type <> 'signup'),
pi AS (SELECT event_type, g, sum(CASE WHEN prev IS NULL THEN 0 WHEN value >= prev THEN value - prev ELSE value END) AS v, count(*) AS n FROM pd GROUP BY ALL),
pw AS (SELECT gr.g, pi.event_type, sum(pi.v) AS v FROM gr JOIN pi ON pi.g > gr.g - 4 AND pi.g <= gr.g GROUP BY ALL),
busy AS (SELECT g, 100 * (1 - sum(v) / 3600 / count(*)) AS v FROM pw GROUP BY 1),
act AS (SELECT 'DiskFilling' AS alertname, 900 AS hold, 'mount=' || event_type AS series, g FROM used WHERE v > 80 AND epoch_us(ts) + 7200000000 > g * 900000000
        UNION ALL SELECT 'CpuBusy', 1800, '', g FROM busy WHERE v > 85),
isl AS (SELECT *, g - row_number() OVER (PARTITION BY alertname, series ORDER BY g) AS island FROM act),
sp AS (SELECT alertname, series, hold, min(g) AS ga, max(g) + 1 AS ge FROM isl GROUP BY alertname, series, hold, island),
al AS (SELECT *, CASE WHEN ga + CAST(ceil(hold / 900.0) AS BIGINT) < ge THEN ga + CAST(ceil(hold / 900.0) AS BIGINT) END AS gf FROM sp)
SELECT alertname, series, CASE WHEN gf IS NULL THEN 'pending' ELSE 'firing' END AS state, {_AT.format('ga')} AS active_at,
       {_AT.format('gf')} AS firing_at, {_AT.format('CASE WHEN ge <= hi THEN ge END')} AS resolved_at FROM al, lim
""")
def host_alerts(t):
    found = monitoring.evaluate(host_samples(t), HOST_RULES, STEP, LOOKBACK, RULE_BOUNDS)[0]
    return monitoring.with_times(found, STEP).drop("severity", "category")
