"""The nightly check: integrity, drift against the baseline, split validation, and what to do next."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.constants import CLASS_NAMES, DRIFT_THRESHOLDS, SPLIT_COLUMNS
from tallyloom.operators.drift import drift_action, drift_report
from tallyloom.operators.quality import check_integrity, validate_splits
from tallyloom.sources.reports import baseline_distribution, write_report


def ingestion_report(metadata: DataFrame, baseline: DataFrame | None, splits: Mapping[str, DataFrame | None], run_id: str,
                     label: str = "dx", group: str = "lesion_id", expected: Sequence[str] = CLASS_NAMES,
                     thresholds: Mapping[str, float] = DRIFT_THRESHOLDS) -> dict[str, DataFrame]:
    """All tables of one run. Integrity comes first and raises; drift and split checks are independent.

    `baseline` is the stored baseline document, or None on the first run.
    """
    integrity = check_integrity(metadata, label, group, expected)
    stored = None if baseline is None else baseline_distribution(baseline, label).select(label, "n")
    drift = drift_report(stored, metadata, label, thresholds)
    return {
        "integrity": integrity,
        **{f"drift_{name}": table for name, table in drift.items()},
        "splits": validate_splits(splits, SPLIT_COLUMNS),
        "action": drift_action(drift["decision"], run_id),
    }


def summary_document(report: Mapping[str, DataFrame], run_id: str) -> DataFrame:
    """One nested row with the integrity facts, the drift verdict and the split checks."""
    def one(df: DataFrame):
        return df.agg(F.first(F.struct(*df.columns))).scalar()

    splits = report["splits"]
    return report["integrity"].sparkSession.range(1).select(
        F.lit(run_id).alias("run_id"),
        one(report["integrity"]).alias("integrity"),
        one(report["drift_decision"]).alias("drift"),
        splits.agg(F.sort_array(F.collect_list(F.struct(*splits.columns)))).scalar().alias("splits"),
    )


def save(report: Mapping[str, DataFrame], run_id: str, folder: str) -> None:
    write_report(summary_document(report, run_id), f"{folder}/ingestion_summary.json")
    write_report(report.get("drift_document", report["drift_decision"]), f"{folder}/drift_report.json")
    write_report(report["action"].where("drift_detected"), f"{folder}/retraining_request.json")
