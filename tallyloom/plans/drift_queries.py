"""Label drift on the event table: first half of the month against the second."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.constants import RETRAIN_ACTION, RETRAIN_COMMAND
from tallyloom.operators import drift
from tallyloom.operators.profile import class_distribution
from tallyloom.operators.split import class_weights
from tallyloom.plans import ingestion
from tallyloom.plans.registry import query, rounded
from tallyloom.session import scratch_path
from tallyloom.sources import reports

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
# `user_id % 40` as label gives enough classes for some to drift at every scale
_LABEL = "user_id % 40"


def halves(t):
    labelled = t.events.select("ts", (F.col("user_id") % 40).alias("label"))
    cut = F.lit(t.half).cast("timestamp_ntz")
    return class_distribution(labelled.where(F.col("ts") < cut), "label"), class_distribution(
        labelled.where(F.col("ts") >= cut), "label")


def pairs(t):
    return drift.paired_counts(*halves(t), "label")


_SHARES = f"""
h AS (SELECT {_LABEL} AS label, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS nb,
             count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS nc FROM events GROUP BY 1),
s AS (SELECT label, nb, nc, greatest(nb / sum(nb) OVER (), 1e-6) AS b, greatest(nc / sum(nc) OVER (), 1e-6) AS c FROM h)
"""
_TOTALS = f"""
{_SHARES},
tt AS (SELECT sum(abs(round((c - b) * ln(c / b), 5))) AS total_psi,
              sum(0.5 * b * ln(b / ((b + c) * 0.5)) + 0.5 * c * ln(c / ((b + c) * 0.5))) AS js_divergence,
              0.5 * sum(abs(c - b)) AS total_variation, count(*) FILTER (abs(c - b) / b > 0.05) AS shifted_classes,
              CAST(sum(nb) AS BIGINT) AS n_baseline, CAST(sum(nc) AS BIGINT) AS n_current,
              abs(sum(nc) - sum(nb)) / sum(nb) AS sample_ratio, count(*) FILTER (nb > 0 AND nc = 0) AS missing_classes,
              count(*) FILTER (nb = 0 AND nc > 0) AS unseen_classes FROM s)
"""


@query("drift_shares", f"WITH {_SHARES} SELECT label, nb, nc, round(b, 9) AS b, round(c, 9) AS c FROM s")
def drift_shares(t):
    return rounded(drift.shares(pairs(t)), 9, "b", "c")


@query("drift_psi", f"""
WITH {_SHARES}
SELECT label, round((c - b) * ln(c / b), 5) AS psi, round(abs(c - b) / b, 5) AS relative_shift, abs(c - b) / b > 0.05 AS drifted FROM s
""")
def drift_psi(t):
    return drift.per_class(drift.shares(pairs(t)), 0.05).select("label", "psi", "relative_shift", "drifted")


@query("drift_totals", f"""
WITH {_TOTALS}
SELECT round(total_psi, 9) AS total_psi, round(js_divergence, 9) AS js_divergence, round(total_variation, 9) AS total_variation,
       round(sample_ratio, 9) AS sample_ratio, shifted_classes, n_baseline, n_current, missing_classes, unseen_classes FROM tt
""")
def drift_totals(t):
    return rounded(drift.totals(pairs(t)), 9, "total_psi", "js_divergence", "total_variation", "sample_ratio")


@query("drift_triggers", f"""
WITH {_TOTALS}
SELECT 'relative_shift' AS trigger, shifted_classes > 0 AS breached FROM tt
UNION ALL SELECT 'total_psi', total_psi > 0.1 FROM tt
UNION ALL SELECT 'js_divergence', js_divergence > 0.02 FROM tt
UNION ALL SELECT 'total_variation', total_variation > 0.12 FROM tt
UNION ALL SELECT 'sample_ratio', sample_ratio > 0.2 FROM tt
UNION ALL SELECT 'missing_classes', missing_classes > 0 FROM tt
UNION ALL SELECT 'unseen_classes', unseen_classes > 0 FROM tt
""")
def drift_triggers(t):
    return drift.triggers(drift.totals(pairs(t)))


@query("drift_action", f"""
WITH {_TOTALS}, d AS (SELECT *, shifted_classes > 0 OR total_psi > 0.1 OR js_divergence > 0.02 OR total_variation > 0.12
                             OR sample_ratio > 0.2 AS drift_detected FROM tt)
SELECT 'nightly' AS run_id, CASE WHEN drift_detected THEN 'notify_drift_detected' ELSE 'no_retraining_needed' END AS action,
       CASE WHEN drift_detected THEN '{RETRAIN_ACTION}' END AS action_required,
       CASE WHEN drift_detected THEN '{RETRAIN_COMMAND}' END AS recommended_command,
       drift_detected, round(total_psi, 5) AS total_psi, round(js_divergence, 5) AS js_divergence,
       round(total_variation, 5) AS total_variation, round(sample_ratio, 5) AS sample_ratio, shifted_classes, missing_classes,
       unseen_classes, n_baseline, n_current FROM d
""")
def drift_action(t):
    baseline, _ = halves(t)
    current = t.events.where(F.col("ts") >= F.lit(t.half).cast("timestamp_ntz")).select((F.col("user_id") % 40).alias("label"))
    verdict = drift.drift_report(baseline, current, "label")["decision"]
    return drift.drift_action(verdict, "nightly")


_PERIOD = """
base AS (SELECT user_id % 400 AS label, count(*) AS nb FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-16' GROUP BY 1),
bt AS (SELECT sum(nb) AS n FROM base),
bs AS (SELECT label, greatest(nb / n, 1e-6) AS b FROM base, bt),
ev AS (SELECT date_trunc('{period}', ts) AS period, user_id % 400 AS label, count(*) AS nc FROM events GROUP BY ALL),
pt AS (SELECT period, sum(nc) AS n FROM ev GROUP BY 1),
grid AS (SELECT p.period, p.n AS n_current, bs.label, b, greatest(coalesce(nc, 0) / p.n, 1e-6) AS c, nc IS NULL AS absent
         FROM pt p CROSS JOIN bs LEFT JOIN ev ON ev.period = p.period AND ev.label = bs.label),
un AS (SELECT period, count(*) FILTER (bs.label IS NULL) AS unseen FROM ev LEFT JOIN bs ON ev.label = bs.label GROUP BY 1),
su AS (SELECT period, any_value(n_current) AS n_current, sum(abs(round((c - b) * ln(c / b), 5))) AS total_psi,
              sum(0.5 * b * ln(b / ((b + c) * 0.5)) + 0.5 * c * ln(c / ((b + c) * 0.5))) AS js_divergence,
              0.5 * sum(abs(c - b)) AS total_variation, count(*) FILTER (abs(c - b) / b > 0.05) AS shifted_classes,
              count(*) FILTER (absent) AS missing_classes FROM grid GROUP BY 1),
al AS (SELECT su.*, unseen AS unseen_classes, CAST(bt.n AS BIGINT) AS n_baseline, abs(n_current - bt.n) / bt.n AS sample_ratio
       FROM su JOIN un ON su.period = un.period CROSS JOIN bt)
SELECT CAST(period AS TIMESTAMP) AS period, CAST(n_current AS BIGINT) AS n_current, n_baseline, round(total_psi, 7) AS total_psi,
       round(js_divergence, 7) AS js_divergence, round(total_variation, 7) AS total_variation, round(sample_ratio, 7) AS sample_ratio,
       shifted_classes, missing_classes, unseen_classes,
       shifted_classes > 0 OR total_psi > 0.1 OR js_divergence > 0.02 OR total_variation > 0.12 OR sample_ratio > 0.2
         OR missing_classes > 0 OR unseen_classes > 0 AS drift_detected
FROM al
"""


def by_period(t, period):
    labelled = t.events.select("ts", "event_type", (F.col("user_id") % 400).alias("label"))
    cut = F.lit(t.half).cast("timestamp_ntz")
    baseline = class_distribution(labelled.where((F.col("event_type") == "click") & (F.col("ts") < cut)), "label")
    found = drift.drift_by_period(labelled, baseline, "ts", "label", period)
    return rounded(found, 7, "total_psi", "js_divergence", "total_variation", "sample_ratio")


@query("drift_by_day", "WITH " + _PERIOD.format(period="day"))
def drift_by_day(t):
    return by_period(t, "day")


@query("drift_by_hour", "WITH " + _PERIOD.format(period="hour"))
def drift_by_hour(t):
    return by_period(t, "hour")


@query("drift_document", f"""
WITH {_TOTALS}, s2 AS (SELECT CAST(label AS VARCHAR) AS key, *, round((c - b) * ln(c / b), 5) AS psi, round(abs(c - b) / b, 5) AS shift, abs(c - b) / b > 0.05 AS flag FROM s)
SELECT 'psi_per_class' AS section, key, psi AS value FROM s2 WHERE nb > 0
UNION ALL SELECT 'relative_shift_per_class', key, shift FROM s2 WHERE nb > 0
UNION ALL SELECT 'class_drift_flags', key, CAST(flag AS INTEGER) FROM s2 WHERE nb > 0
UNION ALL SELECT 'raised', key, 1 FROM s2 WHERE nb > 0 AND flag
UNION ALL SELECT 'current_dist', key, nc FROM s2 WHERE nc > 0
UNION ALL SELECT 'baseline_dist', key, nb FROM s2 WHERE nb > 0
UNION ALL SELECT 'missing', key, 1 FROM s2 WHERE nb > 0 AND nc = 0
UNION ALL SELECT 'unseen', key, 1 FROM s2 WHERE nb = 0 AND nc > 0
UNION ALL SELECT 'thresholds', unnest(['per_class_relative_shift', 'total_psi', 'jensen_shannon_divergence', 'total_variation_distance', 'sample_ratio_change']),
                 unnest([0.05, 0.1, 0.02, 0.12, 0.2])
UNION ALL SELECT 'total', unnest(['drift_detected', 'total_psi', 'jensen_shannon_divergence', 'total_variation_distance', 'n_current', 'n_baseline',
                 'sample_ratio_change', 'psi_threshold_breached', 'js_divergence_threshold_breached', 'total_variation_threshold_breached', 'sample_ratio_threshold_breached']),
                 unnest([CAST(shifted_classes > 0 OR total_psi > 0.1 OR js_divergence > 0.02 OR total_variation > 0.12 OR sample_ratio > 0.2 OR missing_classes > 0
                   OR unseen_classes > 0 AS INTEGER)::DOUBLE, round(total_psi, 5), round(js_divergence, 5), round(total_variation, 5), n_current, n_baseline, round(sample_ratio, 5),
                   (total_psi > 0.1)::INTEGER, (js_divergence > 0.02)::INTEGER, (total_variation > 0.12)::INTEGER, (sample_ratio > 0.2)::INTEGER]) FROM tt
""")
def drift_document(t):
    """The report document, written as JSON and read back, as one row per entry."""
    path = scratch_path(t.spark, "drift-report")
    reports.write_report(drift.drift_document(pairs(t), "label", F.current_timestamp()), path)
    found = reports.read_report(t.spark, path, drift.DOCUMENT)

    def entries(section, column):
        return F.transform(F.map_entries(column), lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("key"), e["value"].cast("double").alias("value")))

    def listed(section, column):
        return F.transform(column, lambda c: F.struct(F.lit(section).alias("section"), c.alias("key"), F.lit(1.0).alias("value")))

    tests = ["psi_threshold_breached", "js_divergence_threshold_breached", "total_variation_threshold_breached", "sample_ratio_threshold_breached"]
    single = ["drift_detected", "total_psi", "jensen_shannon_divergence", "total_variation_distance", "n_current", "n_baseline", "sample_ratio_change"]
    scalars = F.array(*[F.struct(F.lit("total").alias("section"), F.lit(c.split(".")[-1]).alias("key"), F.col(c).cast("double").alias("value"))
                        for c in [*single, *[f"triggers.{c}" for c in tests]]])
    maps = ["psi_per_class", "relative_shift_per_class", "class_drift_flags", "current_dist", "baseline_dist", "thresholds"]
    whole = F.concat(scalars, *[entries(m, m) for m in maps], entries("raised", "triggers.per_class_relative_shift"),
                     listed("missing", "triggers.missing_classes"), listed("unseen", "unseen_classes"))
    return found.select(F.explode(whole).alias("e")).select("e.*")


_NIGHT = """
b AS (SELECT event_type AS label, count(*) AS nb FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
c AS (SELECT event_type AS label, count(*) AS nc FROM events GROUP BY 1),
s AS (SELECT greatest(nb / sum(nb) OVER (), 1e-6) AS b, greatest(nc / sum(nc) OVER (), 1e-6) AS c, nb, nc FROM b FULL JOIN c USING (label)),
d AS (SELECT sum(abs(round((c - b) * ln(c / b), 5))) AS total_psi, bool_or(abs(c - b) / b > 0.05)
        OR sum(abs(round((c - b) * ln(c / b), 5))) > 0.1 OR 0.5 * sum(abs(c - b)) > 0.12
        OR sum(0.5 * b * ln(b / ((b + c) * 0.5)) + 0.5 * c * ln(c / ((b + c) * 0.5))) > 0.02 OR abs(sum(nc) - sum(nb)) / sum(nb) > 0.2 AS drift_detected FROM s),
p AS (SELECT CASE WHEN substr(md5(CAST(user_id AS VARCHAR)), 1, 1) < '4' THEN 'val' ELSE 'train' END AS split, event_type FROM events)
"""


def _night(t, stored):
    """Nightly run on the events: conditions are their types, lesions their users."""
    metadata = t.events.select(F.col("event_type").alias("dx"), F.col("user_id").alias("lesion_id"))
    side = F.when(F.substring(F.md5(F.col("user_id").cast("string")), 1, 1) < "4", "val").otherwise("train")
    parts = t.events.select(F.col("event_id").alias("image_id"), F.col("props").alias("image_path"), F.col("event_type").alias("label"),
                            F.col("user_id").alias("lesion_id"), side.alias("split"))
    splits = {**{n: parts.where(F.col("split") == n).drop("split") for n in ("train", "val")}, "test": None}
    report = ingestion.ingestion_report(metadata, stored, splits, "night", expected=EVENT_TYPES)
    folder = scratch_path(t.spark, "night")
    ingestion.save(report, "night", folder)
    return report, folder


@query("nightly_run", f"""
WITH {_NIGHT}
SELECT 'night' AS run_id, (SELECT count(*) FROM events) AS rows, (SELECT count(DISTINCT user_id) FROM events) AS unique_groups,
       (SELECT count(DISTINCT event_type) FROM events) AS class_count, drift_detected, round(total_psi, 5) AS total_psi,
       CASE WHEN drift_detected THEN 1 ELSE 0 END::BIGINT AS requests, 'test:false:0,train:true:' || (SELECT count(*) FROM p WHERE split = 'train')
       || ',val:true:' || (SELECT count(*) FROM p WHERE split = 'val') AS splits FROM d
""")
def nightly_run(t):
    """Integrity, drift against the stored baseline document and split checks, saved as documents and read back."""
    before = t.events.where(F.col("ts") < F.lit(t.half).cast("timestamp_ntz")).select(F.col("event_type").alias("label"))
    path = scratch_path(t.spark, "baseline")
    reports.write_report(reports.baseline_document(class_weights(class_distribution(before, "label"), "label"), "label", EVENT_TYPES), path)
    _, folder = _night(t, reports.read_report(t.spark, path, reports.BASELINE_SCHEMA))
    requests = t.spark.read.schema("run_id string, action string").json(f"{folder}/retraining_request.json").agg(F.count("*")).scalar()
    summary = t.spark.read.json(f"{folder}/ingestion_summary.json")
    checks = F.array_join(F.transform("splits", lambda x: F.concat_ws(":", x["split"], x["exists"].cast("string"), x["rows"].cast("string"))), ",")
    return summary.select("run_id", "integrity.rows", "integrity.unique_groups", "integrity.class_count", "drift.drift_detected", "drift.total_psi",
                          requests.alias("requests"), checks.alias("splits"))


@query("first_night", "SELECT 'night' AS run_id, false AS drift_detected, 'no_baseline' AS reason, 'no_retraining_needed' AS action, count(*) AS rows FROM events")
def first_night(t):
    """The first run has no baseline: nothing has drifted, for that reason, and nothing is asked for."""
    report, folder = _night(t, None)
    rows = t.spark.read.json(f"{folder}/ingestion_summary.json").select(F.col("integrity.rows").alias("rows"))
    return report["action"].select("run_id", "drift_detected", "reason", "action").withColumn("rows", rows.scalar())
