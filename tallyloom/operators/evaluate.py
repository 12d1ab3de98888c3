"""Classifier evaluation. Everything follows from the (true, predicted) pair counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.constants import ACCEPTANCE_MACRO_F1
from tallyloom.functions.columns import safe_ratio, strings

AVERAGES = ("macro", "micro", "weighted")
OTHER = "other"


def pair_counts(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """(true, pred, n); a null prediction is a wrong one, rows without a true label are left out (see `unscored`)."""
    return (
        df.where(F.col(y_true).isNotNull())
        .groupBy(F.col(y_true).cast("string").alias("true"), F.col(y_pred).cast("string").alias("pred"))
        .agg(F.count("*").alias("n"))
    )


def unscored(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """How many rows have no true label, and how many of the others no prediction."""
    return df.agg(
        F.count_if(F.col(y_true).isNull()).alias("rows_without_truth"),
        F.count_if(F.col(y_true).isNotNull() & F.col(y_pred).isNull()).alias("rows_without_prediction"))


def confusion(df: DataFrame, y_true: str, y_pred: str, classes: Sequence[str]) -> DataFrame:
    """(true, pred, n) over the fixed class list, empty cells as zero."""
    cells = df.sparkSession.range(1).select(F.explode(strings(classes)).alias("true")).select("true", F.explode(strings(classes)).alias("pred"))
    return cells.join(pair_counts(df, y_true, y_pred), ["true", "pred"], "left").select(
        "true", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_tallies(pairs: DataFrame) -> DataFrame:
    """Per label seen in true or predicted: hits, support and number of predictions."""
    ends = F.explode(F.array(
        F.struct(F.col("true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("true").eqNullSafe(F.col("pred")), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp")),
    ))
    return pairs.select(ends.alias("e")).select("e.*").where("label is not null").groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))


def _precision() -> Column:
    return safe_ratio(F.col("tp"), F.col("predicted"))


def _recall() -> Column:
    return safe_ratio(F.col("tp"), F.col("support"))


def _f1() -> Column:
    return safe_ratio(F.col("tp") * 2.0, F.col("predicted") + F.col("support"))


def scored_classes(tallies: DataFrame) -> DataFrame:
    return tallies.withColumns({"precision": _precision(), "recall": _recall(), "f1": _f1()})


def overall(pairs: DataFrame, digits: int = 4) -> DataFrame:
    """Accuracy and macro / micro / weighted precision, recall and F1, undefined parts as zero.

    Macro averages run over the labels seen in true or predicted.
    """
    rows = scored_classes(class_tallies(pairs))
    total = F.sum("support")
    hit_rate = safe_ratio(F.sum("tp"), total)
    facts = [F.round(hit_rate, digits).alias("accuracy")]
    for part in ("f1", "precision", "recall"):
        facts += [
            F.round(F.avg(part), digits).alias(f"macro_{part}"),
            F.round(hit_rate, digits).alias(f"micro_{part}"),
            F.round(safe_ratio(F.sum(F.col(part) * F.col("support")), total), digits).alias(f"weighted_{part}"),
        ]
    return rows.agg(*facts)


def over_classes(pairs: DataFrame, classes: Sequence[str], other: bool = False) -> DataFrame:
    """Scored tallies for the given classes, absent ones with zeros; with `other` a row of that name, if some label is unlisted."""
    order = pairs.sparkSession.createDataFrame(list(enumerate(classes)), "idx int, label string")
    tallies = class_tallies(pairs)
    if other:
        named = F.when(F.col("label").isin(*classes), F.col("label")).otherwise(OTHER)
        tallies = tallies.groupBy(named.alias("label")).agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    filled = F.broadcast(order).join(tallies, "label", "left").fillna(0, subset=["tp", "support", "predicted"])
    if other:
        filled = filled.unionByName(tallies.where(F.col("label") == OTHER).withColumn("idx", F.lit(len(classes))))
    return scored_classes(filled)


def per_class_f1(pairs: DataFrame, classes: Sequence[str], digits: int = 4) -> DataFrame:
    return over_classes(pairs, classes).select("label", F.round("f1", digits).alias("f1"))


def mistake_pct(pairs: DataFrame, classes: Sequence[str], digits: int = 2) -> DataFrame:
    """Share of each true class that was predicted as something else, 0 without samples."""
    wrong = safe_ratio((F.col("support") - F.col("tp")) * 100.0, F.col("support"))
    return over_classes(pairs, classes).select("label", F.round(wrong, digits).alias("mistake_pct"))


def report(pairs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Rows per class plus accuracy, macro avg and weighted avg: (label, precision, recall, f1, support).

    Labels outside the list make one more row, `other`; totals cover it, the macro average is over the list.
    """
    rows = over_classes(pairs, classes, other=True)
    columns = ["label", "precision", "recall", "f1", "support"]
    total = F.sum("support")
    hit_rate = safe_ratio(F.sum("tp"), total)
    parts = ("precision", "recall", "f1")
    summary = rows.agg(F.array(
        F.struct(F.lit("accuracy").alias("label"), *[hit_rate.alias(p) for p in parts], total.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), *[F.avg(F.when(F.col("idx") < len(classes), F.col(p))).alias(p) for p in parts], total.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"),
                 *[safe_ratio(F.sum(F.col(p) * F.col("support")), total).alias(p) for p in parts],
                 total.alias("support")),
    ).alias("rows"))
    return rows.select(columns).unionByName(summary.select(F.explode("rows").alias("r")).select("r.*"))


def to_metric_rows(df: DataFrame, name: str, value: str, prefix: str, step: str | int | None = None) -> DataFrame:
    """(key, value, step) with keys named prefix_class."""
    at = F.lit(None).cast("int") if step is None else (F.lit(step) if isinstance(step, int) else F.col(step))
    return df.select(
        F.concat_ws("_", F.lit(prefix), F.col(name).cast("string")).alias("key"),
        F.col(value).cast("double").alias("value"),
        at.cast("long").alias("step"),
    )


def promote(runs: DataFrame, name: str, version: str, metric: str, floor: float = ACCEPTANCE_MACRO_F1) -> DataFrame:
    """Per model name the numerically latest version among those that pass the gate, as `production`."""
    number = F.col(version).cast("long")
    return (
        runs.where(F.col(metric) >= floor)
        .groupBy(name)
        .agg(F.max(number).alias("version"), F.max_by(metric, number).alias(metric), F.count("*").alias("accepted"))
        .withColumn("alias", F.lit("production"))
    )


def metrics_document(pairs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One nested row: the overall metrics plus per-class F1 and mistake percentage as maps in class order."""
    def as_map(df: DataFrame, value: str) -> Column:
        order = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label"))
        entries = F.sort_array(F.collect_list(F.struct(order.alias("i"), F.col("label"), F.col(value).alias("v"))))
        return df.agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["label"], e["v"])))).scalar()

    return overall(pairs).withColumns({
        "per_class_f1": as_map(per_class_f1(pairs, classes), "f1"),
        "per_class_mistake_pct": as_map(mistake_pct(pairs, classes), "mistake_pct"),
    })
