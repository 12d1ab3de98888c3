import math

import pytest

from tallyloom.operators import drift
from tallyloom.plans import ingestion
from tallyloom.sources import reports
from pyspark.sql import functions as F

BASE = {"akiec": 276, "bcc": 437, "bkl": 942, "df": 93, "mel": 945, "nv": 5705, "vasc": 120}
NOW = {"nv": 6705, "mel": 1113, "bkl": 1099, "bcc": 514, "akiec": 327, "vasc": 142, "df": 115}


def counts(spark, d):
    return spark.createDataFrame(list(d.items()), "label string, n long")


def raw(spark, d):
    return counts(spark, d).select("label", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))


def test_known_drift(spark):
    found = drift.drift_report(counts(spark, BASE), raw(spark, NOW), "label")
    per_class = {r["label"]: r for r in found["per_class"].collect()}
    assert {k: r["relative_shift"] for k, r in per_class.items()} == {
        "akiec": 0.00769, "bcc": 0.00039, "bkl": 0.00772, "df": 0.05172, "mel": 0.00173, "nv": 0.00039, "vasc": 0.00645}
    assert {k for k, r in per_class.items() if r["drifted"]} == {"df"}
    assert {k: r["psi"] for k, r in per_class.items() if r["psi"]} == {"bkl": 0.00001, "df": 0.00003}
    row = found["decision"].first()
    assert (row["drift_detected"], row["total_psi"], row["js_divergence"], row["total_variation"], row["sample_ratio"]) == (
        True, 0.00004, 0.0, 0.00112, 0.17575)
    assert {r["trigger"] for r in found["triggers"].collect() if r["breached"]} == {"relative_shift"}
    assert (row["n_baseline"], row["n_current"]) == (8518, 10015)


def test_same_counts_do_not_drift(spark):
    row = drift.drift_report(counts(spark, BASE), raw(spark, BASE), "label")["decision"].first()
    assert (row["drift_detected"], row["total_psi"], row["js_divergence"]) == (False, 0.0, 0.0)


def test_disjoint_classes(spark):
    found = drift.drift_report(counts(spark, {"a": 10, "b": 10}), raw(spark, {"c": 20}), "label")
    row = found["totals"].first()
    assert (row["missing_classes"], row["unseen_classes"]) == (2, 1)
    assert 0 <= row["js_divergence"] <= math.log(2)
    assert found["per_class"].count() == 2
    assert sorted(tuple(r) for r in found["classes"].collect()) == [("a", "missing"), ("b", "missing"), ("c", "unseen")]


def test_js_is_symmetric(spark):
    a, b = counts(spark, {"a": 10, "b": 30}), counts(spark, {"a": 25, "b": 15})
    one = drift.totals(drift.paired_counts(a, b, "label")).first()["js_divergence"]
    two = drift.totals(drift.paired_counts(b, a, "label")).first()["js_divergence"]
    assert one == pytest.approx(two)


def test_first_run_has_no_baseline(spark):
    row = drift.drift_report(None, raw(spark, {"a": 1}), "label")["decision"].first()
    assert (row["drift_detected"], row["reason"]) == (False, "no_baseline")
    assert drift.drift_action(drift.drift_report(None, raw(spark, {"a": 1}), "label")["decision"], "r").first()["action"] == "no_retraining_needed"


def test_periods_equal_single_reports(spark):
    events = spark.createDataFrame(
        [(f"2024-01-0{1 + i % 3} 10:00:00", "abcd"[(i * i) % (2 + i % 3)]) for i in range(60)], "ts string, label string").withColumn(
            "ts", F.col("ts").cast("timestamp"))
    base = counts(spark, {"a": 20, "b": 10, "z": 3})
    found = {r["period"].day: r for r in drift.drift_by_period(events, base, "ts", "label").collect()}
    for day in (1, 2, 3):
        one = events.where(F.dayofmonth("ts") == day)
        want = drift.totals(drift.paired_counts(base, drift.class_distribution(one, "label"), "label")).first()
        for c in ("total_psi", "js_divergence", "total_variation", "sample_ratio", "missing_classes", "unseen_classes", "shifted_classes"):
            assert found[day][c] == pytest.approx(want[c]), c


def test_nightly_report_round_trip(spark, tmp_path):
    weighted = counts(spark, BASE).withColumn("weight", F.lit(1.0))
    path = str(tmp_path / "baseline.json")
    reports.write_report(reports.baseline_document(weighted, "label", [*BASE, "absent"]), path)
    stored = reports.read_report(spark, path, reports.BASELINE_SCHEMA)
    assert stored.first()["total_train_samples"] == 8518
    meta = raw(spark, NOW).select(F.col("label").alias("dx"), F.concat_ws("-", "label", "i").alias("lesion_id"))
    splits = spark.createDataFrame([("1", "p", "nv", "g")], "image_id string, image_path string, label string, lesion_id string")
    report = ingestion.ingestion_report(meta, stored, {"train": splits, "val": None}, "run-1")
    assert report["integrity"].first()["unique_groups"] == 10015
    assert report["action"].first()["action"] == "notify_drift_detected"
    ingestion.save(report, "run-1", str(tmp_path / "out"))
    text = spark.read.json(str(tmp_path / "out" / "ingestion_summary.json")).first()
    assert text["drift"]["drift_detected"] and text["integrity"]["class_count"] == 7 and len(text["splits"]) == 2
    assert spark.read.json(str(tmp_path / "out" / "retraining_request.json")).count() == 1


def test_multi_line_report_is_read(spark, tmp_path):
    (tmp_path / "b.json").write_text('{\n "class_distribution": {"a": 3, "b": 1},\n "total_train_samples": 4,\n "class_weights": {"a": 0.5, "b": 2.0}\n}')
    doc = reports.read_report(spark, str(tmp_path / "b.json"), reports.BASELINE_SCHEMA)
    assert sorted(tuple(r) for r in reports.baseline_distribution(doc).collect()) == [("a", 3, 0.5), ("b", 1, 2.0)]
