"""Per-user facts on customers, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import accounts
from tallyloom.plans.registry import query


@query("user_stats", """
SELECT c_custkey AS uid, coalesce(p, 0) AS prediction_count, coalesce(f, 0) AS feedback_count, coalesce(i, 0) AS image_count
FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey
LEFT JOIN (SELECT user_id, count(*) AS f FROM events GROUP BY 1) ON user_id = c_custkey
LEFT JOIN (SELECT l_suppkey, count(*) AS i FROM lineitem GROUP BY 1) ON l_suppkey = c_custkey
""")
def user_stats(t):
    return accounts.user_stats(t.customer.select(F.col("c_custkey").alias("uid")), {
        "prediction_count": t.orders.select(F.col("o_custkey").alias("uid")),
        "feedback_count": t.events.select(F.col("user_id").alias("uid")),
        "image_count": t.lineitem.select(F.col("l_suppkey").alias("uid")),
    }, "uid")


@query("user_counts", "SELECT count(*) AS total_users, count(*) FILTER (c_acctbal > 0) AS verified_users FROM customer")
def user_counts(t):
    return accounts.user_counts(t.customer, F.col("c_acctbal") > 0)


@query("user_history_topk", """
SELECT user_id, event_id, ts, CAST(rank AS INTEGER) AS rank FROM (
  SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events)
WHERE rank <= 20
""")
def user_history_topk(t):
    return accounts.history_topk(t.events.select("user_id", "event_id", "ts"), "user_id", "ts", 20, "event_id")


@query("busiest_user_history", """
SELECT user_id, event_id, ts, event_type FROM events
WHERE user_id = (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1) ORDER BY ts DESC, event_id DESC LIMIT 10
""")
def busiest_user_history(t):
    busiest = t.events.groupBy("user_id").agg(F.count("*").alias("n")).agg(
        F.min_by("user_id", F.struct(-F.col("n"), F.col("user_id")))).scalar()
    return accounts.one_history(t.events.select("user_id", "event_id", "ts", "event_type"), "user_id", busiest, "ts", 10, "event_id")


@query("prediction_stats", """
SELECT event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS high_risk,
       (SELECT count(*) FROM events) AS total_predictions, (SELECT count(*) FROM events WHERE event_type = 'error') AS high_risk_total
FROM events GROUP BY 1
""")
def prediction_stats(t):
    return accounts.prediction_stats(t.events, "event_type", F.col("event_type") == "error")


@query("latest_per_key", """
SELECT user_id, event_type, event_id, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def latest_per_key(t):
    return accounts.latest_per_key(
        t.events.select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])


_VOTES = """(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
             FROM events WHERE event_type IN ('click', 'view'))"""


@query("feedback_stats", f"""
SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS thumbs_up, count(*) FILTER (event_type = 'view') AS thumbs_down,
       round(count(*) FILTER (event_type = 'click') / count(*), 4) AS positive_rate
FROM {_VOTES} WHERE rn = 1
""")
def feedback_stats(t):
    votes = t.events.where(F.col("event_type").isin("click", "view")).select("user_id", "event_type", "ts", "event_id")
    return accounts.feedback_stats(votes, "user_id", ["ts", "event_id"], F.col("event_type") == "click")


@query("raw_vs_dedup_counts", """
SELECT event_type, count(*) AS writes, count(DISTINCT user_id) AS kept, count(*) - count(DISTINCT user_id) AS gap FROM events GROUP BY 1
""")
def raw_vs_dedup_counts(t):
    return accounts.raw_and_distinct(t.events, "event_type", "user_id")


_SLIDING = """
SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS requests
FROM events
"""


@query("rate_limit_window", _SLIDING)
def rate_limit_window(t):
    return accounts.sliding_count(t.events.select("event_id", "user_id", "ts"), "user_id", "ts")


@query("rate_limit_breaches", f"SELECT user_id, count(*) AS breaches, max(requests) AS peak FROM ({_SLIDING}) WHERE requests >= 3 GROUP BY 1")
def rate_limit_breaches(t):
    counted = accounts.sliding_count(t.events.select("event_id", "user_id", "ts"), "user_id", "ts")
    return accounts.breaches(counted, "user_id")


@query("ttl_filter", """
SELECT event_id, user_id, ts FROM events WHERE ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-20 12:00:00'
""")
def ttl_filter(t):
    return accounts.unexpired(t.events.select("event_id", "user_id", "ts"), "ts", 3600, "2024-01-20 12:00:00")


@query("dedup_first_wins", """
SELECT user_id, event_type, event_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1
""")
def dedup_first_wins(t):
    return accounts.first_per_key(
        t.events.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


@query("rejected_duplicates", """
SELECT reason, count(*) AS n, min(event_id) AS first_event FROM (
  SELECT event_id, 'user_id already registered' AS reason, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
WHERE rn > 1 GROUP BY 1
""")
def rejected_duplicates(t):
    refused = accounts.admit_unique(t.events.select("event_id", "user_id"), ["user_id"], "event_id")[1]
    return refused.groupBy("reason").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("unique_accounts", """
WITH RECURSIVE r AS (
  SELECT event_id, user_id, props, false AS accepted FROM events
  UNION ALL
  SELECT event_id, user_id, props, wins FROM (
    SELECT *, (user_id IS NOT NULL AND bool_or(wins) OVER (PARTITION BY user_id)) OR (props IS NOT NULL AND bool_or(wins) OVER (PARTITION BY props)) AS blocked
    FROM (SELECT *, (user_id IS NULL OR min(event_id) OVER (PARTITION BY user_id) = event_id)
                AND (props IS NULL OR min(event_id) OVER (PARTITION BY props) = event_id) AS wins FROM r WHERE NOT accepted))
  WHERE wins OR NOT blocked)
SELECT event_id, user_id, props FROM r WHERE accepted
""")
def unique_accounts(t):
    accepted, _ = accounts.admit_unique(t.events.select("event_id", "user_id", "props"), ["user_id", "props"], "event_id")
    return accepted


@query("restored_gauges", f"""
SELECT 'unique_predictions_total' AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders
UNION ALL SELECT 'feedback_positive_rate', round(count(*) FILTER (event_type = 'click') / count(*), 4) FROM {_VOTES} WHERE rn = 1
UNION ALL SELECT 'users_registered_total', CAST(count(*) AS DOUBLE) FROM customer
UNION ALL SELECT 'users_verified_total', CAST(count(*) FILTER (c_acctbal > 0) AS DOUBLE) FROM customer
""")
def restored_gauges(t):
    return accounts.restored_gauges(t.orders, feedback_stats(t), accounts.user_counts(t.customer, F.col("c_acctbal") > 0))
