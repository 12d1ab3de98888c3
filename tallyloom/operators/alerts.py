"""Alert state from interval series: thresholds, hold times, routes, notifications, muting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.constants import DEFAULT_ROUTE, GROUP_BY, INHIBIT_RULES, ROUTES
from tallyloom.functions.columns import from_micros
from tallyloom.session import durable

TESTS = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
}


def active(intervals: DataFrame, rules: Sequence[Mapping], value: str = "value") -> DataFrame:
    """Intervals judged by the rules; only those where a rule holds remain.

    A rule with a `signal_id` looks only at intervals of that number in the column `signal`.
    """
    def holds(r: Mapping) -> Column:
        test = TESTS[r["op"]](F.col(value).cast("double"), F.lit(float(r["threshold"])))
        return test & (F.col("signal") == r["signal_id"]) if "signal_id" in r else test

    judged = F.explode(F.array(*[
        F.struct(
            F.lit(r["alert"]).alias("alertname"), F.lit(r["severity"]).alias("severity"),
            F.lit(r["category"]).alias("category"), F.lit(int(r["hold"])).alias("hold"),
            F.coalesce(holds(r), F.lit(False)).alias("on"),
        ) for r in rules
    ]))
    rest = [c for c in intervals.columns if c not in (value, "signal")]
    return intervals.select(*rest, judged.alias("r")).where("r.on").select(
        "r.alertname", "r.severity", "r.category", "r.hold", *rest)


def spans(intervals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join touching intervals [g_from, g_to) of a series into maximal spans."""
    order = W.partitionBy(*by).orderBy("g_from")
    starts = F.coalesce(F.col("g_from") > F.lag("g_to").over(order), F.lit(True))
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        intervals.withColumn("_new", starts.cast("int"))
        .withColumn("_span", F.sum("_new").over(upto))
        .groupBy(*by, "_span")
        .agg(F.min("g_from").alias("g_from"), F.max("g_to").alias("g_to"))
        .drop("_span")
    )


def hold(actives: DataFrame, series: Sequence[str], step: int, until: int) -> DataFrame:
    """Alerts with their pending and firing times.

    An alert fires at the first grid point that is at least `hold` seconds after it became active;
    one grid point without the condition ends it and the wait starts anew.
    """
    by = ["alertname", "severity", "category", "hold", *series]
    joined = spans(actives, by)
    fires = F.col("g_from") + F.ceil(F.col("hold") / F.lit(step)).cast("long")
    ended = F.col("g_to") <= until
    state = F.when(fires < F.col("g_to"), "firing").otherwise("pending")
    return joined.select(
        "alertname", "severity", "category", *series,
        F.col("g_from").alias("g_active"),
        F.when(fires < F.col("g_to"), fires).alias("g_firing"),
        F.when(ended, F.col("g_to")).alias("g_resolved"),
        F.col("g_to").alias("g_end"),
        state.alias("state"),
    )


def _all_equal(match: Mapping[str, str]) -> Column:
    test = F.lit(True)
    for key, value in match.items():
        test = test & (F.col(key) == value)
    return test


def route(alerts: DataFrame, routes: Sequence[Mapping] = ROUTES, default: Mapping = DEFAULT_ROUTE) -> DataFrame:
    """Receiver and timings from the first route that matches, else the default ones."""
    timings = ("receiver", "group_wait", "group_interval", "repeat_interval")
    chosen = {}
    for name in timings:
        value = F.lit(default[name])
        for r in reversed(routes):
            value = F.when(_all_equal(r["match"]), F.lit(r.get(name, default[name]))).otherwise(value)
        chosen[name] = value
    return alerts.withColumns(chosen)


def group_spans(firing: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spans during which at least one alert of the group fires.

    Starts and ends are counted per (group, grid number) before anything is ordered, so a group
    with very many alerts is no larger than the grid.
    """
    on = firing.select(*by, F.col("g_firing").alias("g"), F.lit(1).alias("d"))
    off = firing.select(*by, F.col("g_end").alias("g"), F.lit(-1).alias("d"))
    moves = on.unionByName(off).groupBy(*by, "g").agg(F.sum("d").alias("d"))
    order = W.partitionBy(*by).orderBy("g")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    levels = moves.select(
        *by, F.col("g").alias("g_from"), F.lead("g").over(order).alias("g_to"), F.sum("d").over(upto).alias("n"))
    return spans(levels.where(F.col("n") > 0), by)


def notifications(alerts: DataFrame, step: int, until: int, group_by: Sequence[str] = GROUP_BY,
                  routes: Sequence[Mapping] = ROUTES, default: Mapping = DEFAULT_ROUTE) -> DataFrame:
    """Messages per (group, receiver): the first after group_wait, then one per repeat_interval while
    the group fires, and a resolved one at the next group_interval. A group that ends before its first
    message stays silent.
    """
    routed = route(alerts.where(F.col("state") == "firing"), routes, default)
    keys = [*group_by, "receiver", "group_wait", "group_interval", "repeat_interval"]
    live = group_spans(routed, keys)
    start = F.col("g_from") * step
    end = F.col("g_to") * step
    first = start + F.col("group_wait")
    ticks = F.col("group_interval")
    timed = live.select(
        *group_by, "receiver", "repeat_interval", first.alias("_first"), end.alias("_end"),
        (F.col("g_to") <= until).alias("_over"),
        (first + F.ceil((end - first) / ticks) * ticks).cast("long").alias("_closing"),
    ).where(F.col("_first") < F.col("_end"))
    told = timed.select(
        *group_by, "receiver", F.lit("firing").alias("status"),
        F.explode(F.sequence("_first", F.col("_end") - 1, F.col("repeat_interval").cast("long"))).alias("_at"))
    closed = timed.where("_over").select(
        *group_by, "receiver", F.lit("resolved").alias("status"), F.col("_closing").alias("_at"))
    return told.unionByName(closed).withColumn("sent_at", from_micros(F.col("_at") * 1_000_000)).drop("_at")


def inhibit(alerts: DataFrame, rules: Sequence[Mapping] = INHIBIT_RULES) -> DataFrame:
    """Add `muted`: a matching source alert with equal labels fires at some time while this one does.

    Sources are counted per (labels, grid number) and summed up once; an alert overlaps a source when
    more of them start before its end than end by its start. No pairs are formed.
    """
    muted = F.lit(False)
    out = alerts
    for i, rule in enumerate(rules):
        equal = list(rule["equal"])
        firing = F.col("state") == "firing"
        sources = group_spans(alerts.where(firing & _all_equal(rule["source"])), equal)
        targets = alerts.where(firing & _all_equal(rule["target"]))
        zero = F.lit(0).cast("long")
        one = F.lit(1).cast("long")
        asked = targets.select(*equal, F.explode(F.array("g_firing", "g_end")).alias("g")).distinct()
        both = F.explode(F.array(F.struct(F.col("g_from").alias("g"), one.alias("s"), zero.alias("e")),
                                 F.struct(F.col("g_to").alias("g"), zero.alias("s"), one.alias("e"))))
        points = (
            sources.select(*equal, both.alias("_p")).select(*equal, "_p.*", F.lit(False).alias("ask"))
            .unionByName(asked.select(*equal, "g", zero.alias("s"), zero.alias("e"), F.lit(True).alias("ask")))
            .groupBy(*equal, "g").agg(F.sum("s").alias("s"), F.sum("e").alias("e"), F.max("ask").alias("ask"))
        )
        order = W.partitionBy(*equal).orderBy("g")
        upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
        read = points.select(
            *equal, "g", "ask", (F.sum("s").over(upto) - F.col("s")).alias("started"), F.sum("e").over(upto).alias("ended"),
        ).where("ask")
        read = durable(read)  # joined twice, from files, so that either join can split a hot grid number
        ends = read.select(*equal, F.col("g").alias("g_end"), F.col("started").alias(f"_s{i}"))
        begins = read.select(*equal, F.col("g").alias("g_firing"), F.col("ended").alias(f"_e{i}"))
        out = out.join(ends, [*equal, "g_end"], "left").join(begins, [*equal, "g_firing"], "left")
        hit = firing & _all_equal(rule["target"]) & (F.col(f"_s{i}") > F.col(f"_e{i}"))
        muted = muted | F.coalesce(hit, F.lit(False))
    return out.withColumn("muted", muted).select(*alerts.columns, "muted")
