"""From raw samples to alerts: one scan into a step table, then every rule on that small table.

Samples are (ts, metric, labels map<string,string>, value). Event counters hold one row per increment,
histogram metrics one row per observation, gauges and sampled counters one row per scrape.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.constants import ALERT_RULES, EVALUATION_STEP, HISTOGRAM_BOUNDS, LOOKBACK
from tallyloom.functions.columns import clamp_min, grid_index, grid_time, histogram_quantile, labels_match, micros
from tallyloom.operators import alerts, series
from tallyloom.session import durable

NO_SERIES = "cast(array() as array<struct<key:string,value:string>>)"
SAMPLED_KINDS = ("sample_increase", "busy_percent")
COUNT_KINDS = ("rate", "increase", "ratio", "quantile")


def sample(metric: str, labels: Mapping[str, Column], value: Column | None = None, when: Column | None = None) -> Column:
    """One sample as a struct (metric, labels, value), 1.0 by default, null where `when` is false."""
    pairs = [p for k, v in labels.items() for p in (F.lit(k), v)]
    row = F.struct(
        F.lit(metric).alias("metric"),
        (F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")).alias("labels"),
        (F.lit(1.0) if value is None else value.cast("double")).alias("value"))
    return row if when is None else F.when(when, row)


def _bucket(bounds: Mapping[str, Sequence[float]]) -> Column:
    """Number of the first bound at or above the value, for histogram metrics; their count for larger values."""
    found = F.lit(None).cast("int")
    for metric, limits in bounds.items():
        place = F.lit(len(limits))
        for i in reversed(range(len(limits))):
            place = F.when(F.col("value") <= float(limits[i]), i).otherwise(place)
        found = F.when(F.col("metric") == metric, place).otherwise(found)
    return found


def step_table(samples: DataFrame, rules: Sequence[Mapping] = ALERT_RULES, step: int = EVALUATION_STEP,
               bounds: Mapping[str, Sequence[float]] = HISTOGRAM_BOUNDS) -> DataFrame:
    """(metric, series, g, bucket, n, total, value, at): all a rule needs, whatever the number of samples."""
    wanted = sorted({m for r in rules for m in (r["signal"]["metric"], r["signal"].get("total")) if m})
    sampled = sorted({r["signal"]["metric"] for r in rules if r["signal"]["kind"] in SAMPLED_KINDS})
    keyed = samples.where(F.col("metric").isin(wanted)).select(
        "ts", "metric", F.sort_array(F.map_entries("labels")).alias("series"), F.col("value").cast("double").alias("value"))
    at = micros("ts")
    facts = [F.count("*").alias("n"), F.max_by("value", at).alias("value"), F.max(at).alias("at")]

    def per_step(rows: DataFrame, *more: Column) -> DataFrame:
        placed = rows.withColumns({"g": grid_index("ts", step), "bucket": _bucket(bounds)})
        return placed.groupBy("metric", "series", "g", "bucket").agg(*facts, *more)

    if not sampled:
        return per_step(keyed).withColumn("total", F.lit(None).cast("decimal(38,9)"))
    # written, as its growth needs several passes and the samples are made anew in each
    scraped = durable(keyed.where(F.col("metric").isin(sampled)))
    grown = series.counter_deltas(scraped, "ts", "value", ["metric", "series"])
    total = F.sum(F.col("delta").cast("decimal(28,9)")).alias("total")
    return per_step(keyed.where(~F.col("metric").isin(sampled))).unionByName(per_step(grown, total), allowMissingColumns=True)


def _pick(metric: str, match: Mapping[str, str]) -> Column:
    found = F.col("metric") == metric
    return found & labels_match(F.map_from_entries("series"), match) if match else found


def _reduced(by: Sequence[str] | None) -> Column:
    """All labels (None) or only those named in `by`."""
    if by is None:
        return F.col("series")
    return F.filter("series", lambda e: e["key"].isin(list(by))) if by else F.expr(NO_SERIES)


def _counts(spec: Mapping, bounds: Mapping[str, Sequence[float]]) -> list[Column]:
    """What a step row adds to a windowed signal: counts, or the growth of a sampled counter."""
    n, none = F.col("n"), F.lit(0).cast("long")
    if spec["kind"] == "sample_increase":
        return [F.coalesce("total", F.lit(0).cast("decimal(38,9)"))]
    if spec["kind"] == "quantile":
        return [F.when(F.col("bucket") <= i, n).otherwise(none) for i in range(len(bounds[spec["metric"]]) + 1)]
    if spec["kind"] == "ratio":
        label = F.map_from_entries("series")
        return [F.when(labels_match(label, m), n).otherwise(none) for m in (spec["match"], spec.get("over", {}))]
    return [n]


def _value(spec: Mapping, bounds: Mapping[str, Sequence[float]]) -> Column:
    """The signal's value from its windowed sums v0, v1, ..."""
    kind, window = spec["kind"], float(spec["window"])
    first = F.col("v0").cast("double")
    if kind == "rate":
        return first / window
    if kind in ("increase", "sample_increase"):
        return first
    if kind == "quantile":
        limits = bounds[spec["metric"]]
        return histogram_quantile(spec["q"], limits, F.array(*[F.col(f"v{i}") for i in range(len(limits) + 1)]))
    whole = F.col("v1").cast("double") / window
    return first / window / (clamp_min(whole, spec["floor"]) if spec["floor_mode"] == "clamp" else whole + spec["floor"])


def _windowed(steps: DataFrame, specs: Mapping[int, Mapping], until: int, step: int,
              bounds: Mapping[str, Sequence[float]]) -> DataFrame:
    """Several windowed signals in one pass: each step row is handed to the signals it counts for.

    The signals must all sum counts or all sum growth, so that counts stay whole numbers.
    """
    parts = {i: _counts(spec, bounds) for i, spec in specs.items()}
    names = [f"v{k}" for k in range(max(len(p) for p in parts.values()))]
    given = []
    for i, spec in specs.items():
        if spec["window"] % step:
            raise ValueError("window must be a multiple of the step")
        by = spec.get("by", None if spec["kind"] in ("rate", "increase", "sample_increase") else [])
        filled = parts[i] + [F.lit(0).cast("long")] * (len(names) - len(parts[i]))
        row = F.struct(
            F.lit(i).alias("signal"), _reduced(by).alias("series"), F.lit(spec["window"] // step).alias("span"),
            *[c.alias(n) for c, n in zip(filled, names)])
        given.append(F.when(_pick(spec["metric"], {} if spec["kind"] == "ratio" else spec.get("match", {})), row))
    rows = steps.select("g", F.explode(F.array_compact(F.array(*given))).alias("s")).select("g", "s.*")
    by = ["signal", "series", "span"]
    counted = rows.groupBy(*by, "g").agg(*[F.sum(c).alias(c) for c in names])
    value = F.lit(None).cast("double")
    for i, spec in specs.items():
        value = F.when(F.col("signal") == i, _value(spec, bounds)).otherwise(value)
    out = series.windowed_steps(counted, by, names, F.col("span"), until)
    return out.select("signal", "series", "g_from", "g_to", value.alias("value"))


def _gauges(steps: DataFrame, specs: Mapping[int, Mapping], until: int, step: int, lookback: int) -> DataFrame:
    """All plain gauges in one pass."""
    given = [
        F.when(_pick(spec["metric"], spec.get("match", {})), F.lit(i)) for i, spec in specs.items()
    ]
    rows = steps.select(F.explode(F.array_compact(F.array(*given))).alias("signal"), "series", "g", "at", "value")
    return series.held_steps(rows, ["signal", "series"], step, lookback, until)


def _used_percent(steps: DataFrame, spec: Mapping, until: int, step: int, lookback: int) -> DataFrame:
    """Used share in percent from a free and a total gauge of the same series."""
    free, total = (F.max(F.when(F.col("metric") == m, F.col("value"))) for m in (spec["metric"], spec["total"]))
    match = spec.get("match", {})
    both = steps.where(_pick(spec["metric"], match) | _pick(spec["total"], match)).groupBy("series", "g").agg(
        free.alias("free"), total.alias("all"), F.max("at").alias("at"))
    used = both.dropna(subset=["free", "all"]).select(
        "series", "g", "at", ((1.0 - F.col("free") / F.col("all")) * 100.0).alias("value"))
    return series.held_steps(used, ["series"], step, lookback, until)


def _busy_percent(steps: DataFrame, spec: Mapping, until: int, step: int) -> DataFrame:
    """100 * (1 - mean idle rate) over the series that grew within the window."""
    grown = steps.where(_pick(spec["metric"], spec.get("match", {}))).groupBy("series", "g").agg(
        F.sum("total").alias("grown"), F.sum("n").alias("n"))
    each = series.windowed(grown, ["series"], ["grown", "n"], spec["window"], step, until)
    out = series.merge_series(each, [], ["grown"], F.col("n") > 0)
    idle = F.col("grown").cast("double") / float(spec["window"]) / F.col("series")
    return out.select(F.expr(NO_SERIES).alias("series"), "g_from", "g_to", (100.0 * (1.0 - idle)).alias("value"))


def signals(steps: DataFrame, specs: Sequence[Mapping], until: int, step: int = EVALUATION_STEP, lookback: int = LOOKBACK,
            bounds: Mapping[str, Sequence[float]] = HISTOGRAM_BOUNDS) -> DataFrame:
    """The series the rules look at, as intervals (signal, series, g_from, g_to, value); `signal` counts through `specs`."""
    def of(*kinds: str) -> dict[int, Mapping]:
        return {i: s for i, s in enumerate(specs) if s["kind"] in kinds}

    unknown = {s["kind"] for s in specs} - {*COUNT_KINDS, "sample_increase", "gauge", "used_percent", "busy_percent"}
    if unknown:
        raise ValueError(f"unknown signal kinds {sorted(unknown)}")
    parts = [_windowed(steps, chosen, until, step, bounds) for chosen in (of(*COUNT_KINDS), of("sample_increase")) if chosen]
    if of("gauge"):
        parts.append(_gauges(steps, of("gauge"), until, step, lookback))
    parts += [_used_percent(steps, s, until, step, lookback).withColumn("signal", F.lit(i)) for i, s in of("used_percent").items()]
    parts += [_busy_percent(steps, s, until, step).withColumn("signal", F.lit(i)) for i, s in of("busy_percent").items()]
    found = None
    for part in parts:
        shaped = part.select("signal", "series", "g_from", "g_to", F.col("value").cast("double").alias("value"))
        found = shaped if found is None else found.unionByName(shaped)
    return found


def active_intervals(steps: DataFrame, rules: Sequence[Mapping], until: int, step: int = EVALUATION_STEP,
                     lookback: int = LOOKBACK, bounds: Mapping[str, Sequence[float]] = HISTOGRAM_BOUNDS) -> DataFrame:
    """All intervals in which a rule's condition holds; rules on the same signal share its computation."""
    numbers: dict[str, int] = {}
    specs, placed = [], []
    for rule in rules:
        name = json.dumps(rule["signal"], sort_keys=True)
        if name not in numbers:
            numbers[name] = len(specs)
            specs.append(rule["signal"])
        placed.append({**rule, "signal_id": numbers[name]})
    return alerts.active(signals(steps, specs, until, step, lookback, bounds), placed)


def evaluate(samples: DataFrame, rules: Sequence[Mapping] = ALERT_RULES, step: int = EVALUATION_STEP,
             lookback: int = LOOKBACK, bounds: Mapping[str, Sequence[float]] = HISTOGRAM_BOUNDS) -> tuple[DataFrame, int]:
    """All alerts with pending and firing times, and the last grid number."""
    steps = durable(step_table(samples, rules, step, bounds))
    until = steps.agg(F.max("g").alias("g")).first()["g"] or 0
    actives = active_intervals(steps, rules, until, step, lookback, bounds)
    return durable(alerts.hold(actives, ["series"], step, until)), until


def with_times(found: DataFrame, step: int, keep: Sequence[str] = ()) -> DataFrame:
    """Grid numbers as timestamps and the series as text, plus the columns in `keep`."""
    text = F.concat_ws(",", F.transform("series", lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select(
        "alertname", "severity", "category", text.alias("series"), "state", *keep,
        grid_time(F.col("g_active"), step).alias("active_at"),
        grid_time(F.col("g_firing"), step).alias("firing_at"),
        grid_time(F.col("g_resolved"), step).alias("resolved_at"))
