"""Label drift between a baseline and a current distribution."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.constants import DRIFT_THRESHOLDS, RETRAIN_ACTION, RETRAIN_COMMAND, SHARE_FLOOR
from tallyloom.operators.profile import class_distribution


def paired_counts(baseline: DataFrame, current: DataFrame, label: str) -> DataFrame:
    """(label, nb, nc) from two (label, n) distributions; null marks a label one side lacks."""
    left = baseline.select(label, F.col("n").alias("nb"))
    right = current.select(label, F.col("n").alias("nc"))
    return left.join(right, label, "full_outer")


def one_sided(pairs: DataFrame, label: str) -> DataFrame:
    """Classes only the baseline has (`missing`) or only the current rows have (`unseen`)."""
    return pairs.where(F.col("nb").isNull() | F.col("nc").isNull()).select(
        label, F.when(F.col("nc").isNull(), "missing").otherwise("unseen").alias("status"))


def shares(pairs: DataFrame) -> DataFrame:
    """Floored shares (b, c) of the baseline classes; totals count every class on each side."""
    totals = pairs.agg(F.struct(
        F.greatest(F.coalesce(F.sum("nb"), F.lit(0)), F.lit(1)).alias("nb"),
        F.greatest(F.coalesce(F.sum("nc"), F.lit(0)), F.lit(1)).alias("nc"),
    )).scalar()
    return (
        pairs.where(F.col("nb").isNotNull())
        .withColumn("_t", totals)
        .withColumn("b", F.greatest(F.col("nb") / F.col("_t.nb"), F.lit(SHARE_FLOOR)))
        .withColumn("c", F.greatest(F.coalesce("nc", F.lit(0)) / F.col("_t.nc"), F.lit(SHARE_FLOOR)))
        .drop("_t")
    )


def psi(b: Column, c: Column) -> Column:
    return (c - b) * F.log(c / b)


def relative_shift(b: Column, c: Column) -> Column:
    return F.abs(c - b) / b


def js_term(b: Column, c: Column) -> Column:
    mix = (b + c) * 0.5
    return (b * F.log(b / mix) + c * F.log(c / mix)) * 0.5


def per_class(shared: DataFrame, threshold: float) -> DataFrame:
    """PSI and relative shift per class. The flag compares the unrounded shift."""
    b, c = F.col("b"), F.col("c")
    return shared.withColumns({
        "psi": F.round(psi(b, c), 5),
        "relative_shift": F.round(relative_shift(b, c), 5),
        "drifted": relative_shift(b, c) > threshold,
    })


def _totals(pairs: DataFrame, shared: DataFrame, threshold: float) -> DataFrame:
    b, c = F.col("b"), F.col("c")
    over_classes = shared.agg(
        F.coalesce(F.sum(F.abs(F.round(psi(b, c), 5))), F.lit(0.0)).alias("total_psi"),
        F.coalesce(F.sum(js_term(b, c)), F.lit(0.0)).alias("js_divergence"),
        F.coalesce(F.sum(F.abs(c - b)) * 0.5, F.lit(0.0)).alias("total_variation"),
        F.count_if(relative_shift(b, c) > threshold).alias("shifted_classes"),
    )
    counts = pairs.agg(F.struct(
        F.coalesce(F.sum("nb"), F.lit(0)).alias("nb"),
        F.coalesce(F.sum("nc"), F.lit(0)).alias("nc"),
        F.count_if(F.col("nc").isNull()).alias("missing"),
        F.count_if(F.col("nb").isNull()).alias("unseen"),
    )).scalar()
    return over_classes.withColumn("_n", counts).select(
        "total_psi", "js_divergence", "total_variation", "shifted_classes",
        F.col("_n.nb").alias("n_baseline"),
        F.col("_n.nc").alias("n_current"),
        (F.abs(F.col("_n.nc") - F.col("_n.nb")) / F.greatest(F.col("_n.nb"), F.lit(1))).alias("sample_ratio"),
        F.col("_n.missing").alias("missing_classes"),
        F.col("_n.unseen").alias("unseen_classes"),
    )


def totals(pairs: DataFrame, thresholds: Mapping[str, float] = DRIFT_THRESHOLDS) -> DataFrame:
    """One row: total PSI (sum of the rounded per-class values), JS, total variation, sample ratio, class gaps."""
    return _totals(pairs, shares(pairs), thresholds["relative_shift"])


def trigger_conditions(thresholds: Mapping[str, float]) -> dict[str, Column]:
    """The seven conditions, each over a `totals` row."""
    return {
        "relative_shift": F.col("shifted_classes") > 0,
        "total_psi": F.col("total_psi") > thresholds["total_psi"],
        "js_divergence": F.col("js_divergence") > thresholds["js_divergence"],
        "total_variation": F.col("total_variation") > thresholds["total_variation"],
        "sample_ratio": F.col("sample_ratio") > thresholds["sample_ratio"],
        "missing_classes": F.col("missing_classes") > 0,
        "unseen_classes": F.col("unseen_classes") > 0,
    }


def triggers(total: DataFrame, thresholds: Mapping[str, float] = DRIFT_THRESHOLDS) -> DataFrame:
    """(trigger, breached), one row per condition."""
    rows = [
        F.struct(F.lit(name).alias("trigger"), test.alias("breached"))
        for name, test in trigger_conditions(thresholds).items()
    ]
    return total.select(F.explode(F.array(*rows)).alias("t")).select("t.trigger", "t.breached")


def decision(total: DataFrame, thresholds: Mapping[str, float] = DRIFT_THRESHOLDS) -> DataFrame:
    """The report row: rounded totals and `drift_detected`, true when any condition holds."""
    breached = F.lit(False)
    for test in trigger_conditions(thresholds).values():
        breached = breached | test
    return total.select(
        breached.alias("drift_detected"),
        *[F.round(c, 5).alias(c) for c in ("total_psi", "js_divergence", "total_variation", "sample_ratio")],
        "shifted_classes", "missing_classes", "unseen_classes", "n_baseline", "n_current",
    )


DOCUMENT = (
    "drift_detected boolean, total_psi double, jensen_shannon_divergence double, total_variation_distance double, "
    "psi_per_class map<string,double>, relative_shift_per_class map<string,double>, class_drift_flags map<string,boolean>, "
    "missing_classes array<string>, unseen_classes array<string>, current_dist map<string,bigint>, baseline_dist map<string,bigint>, "
    "n_current bigint, n_baseline bigint, sample_ratio_change double, thresholds map<string,double>, "
    "triggers struct<per_class_relative_shift:map<string,boolean>,psi_threshold_breached:boolean,js_divergence_threshold_breached:boolean,"
    "total_variation_threshold_breached:boolean,sample_ratio_threshold_breached:boolean,missing_classes:array<string>,"
    "unseen_classes:array<string>>, timestamp string")
# fixed values: key names of the report document
_THRESHOLD_NAMES = {
    "per_class_relative_shift": "relative_shift", "total_psi": "total_psi", "jensen_shannon_divergence": "js_divergence",
    "total_variation_distance": "total_variation", "sample_ratio_change": "sample_ratio"}


def drift_document(pairs: DataFrame, label: str, at: Column, thresholds: Mapping[str, float] = DRIFT_THRESHOLDS) -> DataFrame:
    """One nested row with totals, both distributions, the figures of every class, thresholds, triggers and the time `at`."""
    name = F.col(label).cast("string")

    def as_map(value: Column, when: Column) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(when, F.struct(name.alias("k"), value.alias("v"))))))

    def names(when: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(when, name)))

    has_b, has_c = F.col("nb").isNotNull(), F.col("nc").isNotNull()
    sides = pairs.where(name.isNotNull()).agg(F.struct(
        as_map(F.col("nc"), has_c).alias("current_dist"), as_map(F.col("nb"), has_b).alias("baseline_dist"),
        names(~has_c).alias("missing"), names(~has_b).alias("unseen"))).scalar()
    classes = per_class(shares(pairs), thresholds["relative_shift"]).where(name.isNotNull()).agg(F.struct(
        as_map(F.col("psi"), F.lit(True)).alias("psi"), as_map(F.col("relative_shift"), F.lit(True)).alias("shift"),
        as_map(F.col("drifted"), F.lit(True)).alias("flags"), as_map(F.col("drifted"), F.col("drifted")).alias("raised"))).scalar()
    total = totals(pairs, thresholds)
    test = trigger_conditions(thresholds)
    breached = F.lit(False)
    for t in test.values():
        breached = breached | t
    limits = F.create_map(*[x for key, ours in _THRESHOLD_NAMES.items() for x in (F.lit(key), F.lit(float(thresholds[ours])))])
    return total.withColumns({"_s": sides, "_c": classes}).select(
        breached.alias("drift_detected"), F.round("total_psi", 5).alias("total_psi"),
        F.round("js_divergence", 5).alias("jensen_shannon_divergence"), F.round("total_variation", 5).alias("total_variation_distance"),
        F.col("_c.psi").alias("psi_per_class"), F.col("_c.shift").alias("relative_shift_per_class"), F.col("_c.flags").alias("class_drift_flags"),
        F.col("_s.missing").alias("missing_classes"), F.col("_s.unseen").alias("unseen_classes"), "_s.current_dist", "_s.baseline_dist",
        "n_current", "n_baseline", F.round("sample_ratio", 5).alias("sample_ratio_change"), limits.alias("thresholds"),
        F.struct(
            F.col("_c.raised").alias("per_class_relative_shift"), test["total_psi"].alias("psi_threshold_breached"),
            test["js_divergence"].alias("js_divergence_threshold_breached"), test["total_variation"].alias("total_variation_threshold_breached"),
            test["sample_ratio"].alias("sample_ratio_threshold_breached"), F.col("_s.missing").alias("missing_classes"),
            F.col("_s.unseen").alias("unseen_classes")).alias("triggers"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"))


def drift_report(baseline: DataFrame | None, current: DataFrame, label: str,
                 thresholds: Mapping[str, float] = DRIFT_THRESHOLDS) -> dict[str, DataFrame]:
    """All drift tables for raw current rows against a stored (label, n) baseline.

    Without a baseline nothing has drifted; the decision then carries the reason instead of numbers.
    """
    if baseline is None:
        none = current.sparkSession.range(1).select(
            F.lit(False).alias("drift_detected"), F.lit("no_baseline").alias("reason"))
        return {"decision": none}
    pairs = paired_counts(baseline, class_distribution(current, label), label)
    total = totals(pairs, thresholds)
    return {
        "per_class": per_class(shares(pairs), thresholds["relative_shift"]),
        "classes": one_sided(pairs, label),
        "totals": total,
        "triggers": triggers(total, thresholds),
        "decision": decision(total, thresholds),
        "document": drift_document(pairs, label, F.current_timestamp(), thresholds),
    }


def drift_action(verdict: DataFrame, run_id: str) -> DataFrame:
    """The follow-up for one run: ask for retraining, or nothing."""
    asked = F.col("drift_detected")
    return verdict.select(
        F.lit(run_id).alias("run_id"),
        F.when(asked, "notify_drift_detected").otherwise("no_retraining_needed").alias("action"),
        F.when(asked, RETRAIN_ACTION).alias("action_required"),
        F.when(asked, RETRAIN_COMMAND).alias("recommended_command"),
        *verdict.columns,
    )


def drift_by_period(events: DataFrame, baseline: DataFrame, ts: str, label: str, period: str = "day",
                    thresholds: Mapping[str, float] = DRIFT_THRESHOLDS) -> DataFrame:
    """Drift of every period (hour, day, ...) against one fixed (label, n) baseline."""
    counts = (
        events.where(F.col(label).isNotNull())
        .groupBy(F.date_trunc(period, ts).cast("timestamp_ntz").alias("period"), label)
        .agg(F.count("*").alias("nc"))
    )
    return drift_of_counts(counts, baseline, label, thresholds)


def drift_of_counts(counts: DataFrame, baseline: DataFrame, label: str,
                    thresholds: Mapping[str, float] = DRIFT_THRESHOLDS) -> DataFrame:
    """Drift per period from (period, label, nc) rows, of a batch or of a stream's closed windows.

    Baseline classes that a period lacks have the floored share there. Their part of each sum is
    known beforehand, so every class starts with it and the classes present replace their own part:
    no grid of periods and classes is built.
    """
    b_total = baseline.agg(F.greatest(F.sum("n"), F.lit(1))).scalar()
    base = baseline.withColumn("_bt", b_total).select(
        label, F.greatest(F.col("n") / F.col("_bt"), F.lit(SHARE_FLOOR)).alias("b"))
    n_period = counts.groupBy("period").agg(F.sum("nc").alias("n_current"))
    floor = F.lit(SHARE_FLOOR)
    b, c = F.col("b"), F.col("c")

    def sums(c_share: Column) -> list[Column]:
        return [
            F.abs(F.round(psi(b, c_share), 5)).alias("_psi"),
            js_term(b, c_share).alias("_js"),
            F.abs(c_share - b).alias("_tv"),
            (relative_shift(b, c_share) > thresholds["relative_shift"]).cast("long").alias("_shift"),
        ]

    empty = base.select(*sums(floor)).agg(F.struct(
        F.sum("_psi").alias("psi"), F.sum("_js").alias("js"), F.sum("_tv").alias("tv"),
        F.sum("_shift").alias("shift"), F.count("*").alias("k"))).scalar()
    base = base.select(label, "b", *[s.alias(f"{n}0") for s, n in zip(sums(floor), ("_psi", "_js", "_tv", "_shift"))])

    cells = counts.join(n_period, "period").join(base, label, "left").withColumn(
        "c", F.greatest(F.col("nc") / F.col("n_current"), floor))
    cells = cells.select(
        "period", "n_current", F.col("b").isNotNull().alias("_known"),
        *[(s - F.col(f"{n}0")).alias(n) for s, n in zip(sums(c), ("_psi", "_js", "_tv", "_shift"))],
    )
    by_period = cells.groupBy("period").agg(
        F.first("n_current").alias("n_current"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("_psi", "_js", "_tv", "_shift")],
        F.count_if("_known").alias("_present"),
        F.count_if(~F.col("_known")).alias("unseen_classes"),
    ).withColumn("_e", empty).withColumn("_bt", b_total)
    total = by_period.select(
        "period",
        (F.col("_psi") + F.col("_e.psi")).alias("total_psi"),
        (F.col("_js") + F.col("_e.js")).alias("js_divergence"),
        ((F.col("_tv") + F.col("_e.tv")) * 0.5).alias("total_variation"),
        (F.col("_shift") + F.col("_e.shift")).cast("long").alias("shifted_classes"),
        F.col("_bt").alias("n_baseline"), "n_current",
        (F.abs(F.col("n_current") - F.col("_bt")) / F.col("_bt")).alias("sample_ratio"),
        (F.col("_e.k") - F.col("_present")).alias("missing_classes"), "unseen_classes",
    )
    breached = F.lit(False)
    for test in trigger_conditions(thresholds).values():
        breached = breached | test
    return total.withColumn("drift_detected", breached)
