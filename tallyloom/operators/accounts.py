"""Per-user facts: counts, history, latest-wins and first-wins records, rate limits, expiry."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.constants import RATE_LIMIT
from tallyloom.functions.columns import col, micros, whole_steps
from tallyloom.operators.lookup import HOT_SHARE, attach, mark_hot
from tallyloom.session import durable

HOUR = 3600
#: Rows that one task settles one by one, in `admit_unique`, and rounds over the whole table before that.
PASS_ROWS = 500_000
FIRST_ROUNDS = 2


def user_stats(users: DataFrame, facts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Users with one count column per fact table, zero where a user has none."""
    out = users
    for name, fact in facts.items():
        out = out.join(fact.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.fillna(0, subset=list(facts))


def user_counts(users: DataFrame, verified: str | Column) -> DataFrame:
    return users.agg(F.count("*").alias("total_users"), F.count_if(col(verified)).alias("verified_users"))


def history_topk(df: DataFrame, key: str, ts: str, n: int = 20, tie: str | None = None) -> DataFrame:
    """The newest `n` rows of every key. Tasks keep their own newest `n` per key before the shuffle."""
    order = [F.desc(ts)] + ([F.desc(tie)] if tie else [])
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def one_history(df: DataFrame, key: str, value, ts: str, n: int = 20, tie: str | None = None) -> DataFrame:
    order = [F.desc(ts)] + ([F.desc(tie)] if tie else [])
    return df.where(F.col(key) == value).orderBy(*order).limit(n)


def prediction_stats(df: DataFrame, label: str, high_risk: Column) -> DataFrame:
    """Per class count and high-risk count, with the grand totals on every row: one grouped pass."""
    by_class = df.groupBy(label).agg(F.count("*").alias("n"), F.count_if(high_risk).alias("high_risk"))
    sums = by_class.agg(F.struct(F.sum("n").alias("n"), F.sum("high_risk").alias("h"))).scalar()
    return by_class.withColumn("_s", sums).withColumns({
        "total_predictions": F.col("_s.n"), "high_risk_total": F.col("_s.h")}).drop("_s")


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last written row of each key: an aggregation that combines before the shuffle, so a hot key is one row per task."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, "_row.*")


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    oldest = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return oldest.select(*keys, "_row.*")


def feedback_stats(df: DataFrame, key: str, order: Sequence[str], up: Column) -> DataFrame:
    """Totals over the latest vote of each key; the rate is 0 without votes."""
    votes = latest_per_key(df, key, order)
    total, liked = F.count("*"), F.count_if(up)
    return votes.agg(
        total.alias("total"), liked.alias("thumbs_up"), (total - liked).alias("thumbs_down"),
        F.round(F.when(total > 0, liked / total).otherwise(F.lit(0.0)), 4).alias("positive_rate"))


def raw_and_distinct(df: DataFrame, by: str, key: str) -> DataFrame:
    """Writes per `by` next to the distinct keys they touched, and the gap between the two."""
    cells = df.groupBy(by, key).agg(F.count("*").alias("n"))
    return cells.groupBy(by).agg(F.sum("n").alias("writes"), F.count(key).alias("kept")).withColumn(
        "gap", F.col("writes") - F.col("kept"))


def sliding_count(df: DataFrame, key: str, ts: str, window: int = HOUR, slices: int = 60, into: str = "requests",
                  hot_share: float = HOT_SHARE) -> DataFrame:
    """Requests of the same key in [ts - window, ts], the row itself and same-instant rows included.

    Every row adds one at its time and takes it back one microsecond after it turns too old; a running
    sum over both is the answer, in linear time however many rows the window holds. A key is ordered
    as a whole, except for the few hot ones: their time is cut into slices of window/slices seconds,
    each ordered alone. When a slice opens, exactly the rows of the `slices` slices before it are
    alive, which counts per slice tell.
    """
    width = window * 1_000_000 // slices
    if width * slices != window * 1_000_000:
        raise ValueError("window must divide into whole microseconds")
    rows = mark_hot(df, [key], hot_share, "_hot").withColumn("_at", micros(ts))
    rows = rows.withColumn("_slice", F.when(F.col("_hot"), whole_steps(F.col("_at"), width)).otherwise(0))

    counts = rows.where("_hot").groupBy(key, "_slice").agg(F.count("*").alias("_n"))
    alive = W.partitionBy(key).orderBy("_slice").rangeBetween(-slices, -1)
    opening = counts.select(
        key, "_slice", F.lit(None).cast("long").alias("_at"), F.coalesce(F.sum("_n").over(alive), F.lit(0)).alias("_d"))

    gone = F.col("_at") + (window * 1_000_000 + 1)
    later = F.when(F.col("_hot"), F.col("_slice") + slices).otherwise(0)
    # of a hot key, the row whose last microsecond ends a slice is no longer counted when the next one opens
    leaving = rows.where(~F.col("_hot") | (whole_steps(gone, width) == F.col("_slice") + slices)).select(
        key, gone.alias("_at"), later.alias("_slice"), F.lit(-1).cast("long").alias("_d"))

    cells = rows.drop("_hot").withColumns({"_d": F.lit(1).cast("long"), "_row": F.lit(True)})
    for extra in (leaving, opening):
        cells = cells.unionByName(extra.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    upto = W.partitionBy(key, "_slice").orderBy(F.asc_nulls_first("_at")).rangeBetween(W.unboundedPreceding, W.currentRow)
    return cells.withColumn(into, F.sum("_d").over(upto)).where("_row").select(*df.columns, into)


def breaches(counted: DataFrame, key: str, limit: int = RATE_LIMIT, into: str = "requests") -> DataFrame:
    """Requests at or over the limit per key; they are flagged, never blocked."""
    return counted.where(F.col(into) >= limit).groupBy(key).agg(
        F.count("*").alias("breaches"), F.max(into).alias("peak"))


def unexpired(df: DataFrame, ts: str, ttl: int, as_of: str | Column) -> DataFrame:
    """Rows whose life of `ttl` seconds ends after `as_of`."""
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    bound = F.timestamp_micros(F.unix_micros(now.cast("timestamp")) - F.lit(ttl * 1_000_000))
    return df.where(F.col(ts) > bound.cast(df.schema[ts].dataType))  # the bare column, so that the scan can skip files


def _settled(keys: Sequence[str], order: str):
    """Admits the rows of a partition, which come in order, one by one."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: list[set] = [set() for _ in keys]
        for batch in batches:
            kept = []
            for row in batch.itertuples(index=False):
                held = [(s, v) for s, v in zip(taken, row[1:], strict=True) if not pd.isna(v)]
                if not any(v in s for s, v in held):
                    kept.append(row[0])
                    for s, v in held:
                        s.add(v)
            yield pd.DataFrame({order: kept})
    return run


def _settle(rows: DataFrame, keys: Sequence[str], order: str, tasks: int, by: Column | None = None) -> DataFrame:
    """Accepted rows of parts that share no key; parts of the same task settle together."""
    placed = rows.coalesce(1) if by is None else rows.repartition(tasks, by)
    return placed.select(order, *keys).sortWithinPartitions(order).mapInPandas(_settled(keys, order), StructType([rows.schema[order]]))


def conflict_parts(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds `part`: equal for rows that are linked through shared keys. It is the smallest `order` among them.

    Labels fall to the least one around a shared key and then jump to the label of the row they name, so the number
    of rounds grows with the logarithm of the longest chain. Every round is one written table."""
    labelled = durable(rows.select(order, *keys, F.col(order).alias("part")))
    while True:
        near = labelled
        for k in keys:
            least = labelled.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("part").alias(f"_m_{k}"))
            near = near.join(least, k, "left")
        near = near.withColumn("_to", F.least("part", "part", *[F.col(f"_m_{k}") for k in keys])).drop(*[f"_m_{k}" for k in keys])
        near = durable(near)
        jumps = near.select(F.col(order).alias("_to"), F.col("_to").alias("_jump"))
        moved = durable(near.join(jumps, "_to", "left").select(order, *keys, F.least("_to", "_jump").alias("_new"), "part"))
        if not moved.where("_new <> part").limit(1).count():
            return rows.join(moved.select(order, "part"), order)
        labelled = moved.select(order, *keys, F.col("_new").alias("part"))


def admit_unique(df: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Insert rows in `order` into a table with several unique keys: (accepted, rejected with reason).

    A row is rejected when an accepted earlier row holds one of its keys; the first such key in
    `keys` is the reason. `order` identifies rows. Null keys never clash. The first rounds accept the rows that come first on
    all their keys and reject the rows they block, all over the table at once. What is left is settled row by row in order:
    up to PASS_ROWS rows in one task, more in parts that share no keys; a part beyond that size goes on in rounds."""
    open_rows = durable(df.select(order, *keys))
    accepted, rounds = [], 0
    while left := open_rows.count():
        if left <= PASS_ROWS:
            accepted.append(durable(_settle(open_rows, keys, order, 1)))
            break
        if rounds % FIRST_ROUNDS == 0 and rounds:
            parts = durable(conflict_parts(open_rows, keys, order))
            sizes = durable(parts.groupBy("part").agg(F.count("*").alias("_n")))
            small = attach(parts, sizes.where(F.col("_n") <= PASS_ROWS).select("part"), "part", "left_semi")
            accepted.append(durable(_settle(small, keys, order, max(2, 4 * left // PASS_ROWS), F.col("part"))))
            open_rows = durable(attach(parts, sizes.where(F.col("_n") > PASS_ROWS).select("part"), "part", "left_semi").select(order, *keys))
        rounds += 1
        firsts = open_rows
        for k in keys:
            least = open_rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_f_{k}"))
            firsts = attach(firsts, least, k)
        wins = F.lit(True)
        for k in keys:
            wins = wins & (F.col(k).isNull() | (F.col(f"_f_{k}") == F.col(order)))
        won = durable(firsts.where(wins).select(order, *keys))
        accepted.append(won.select(order))
        rest = open_rows.join(won.select(order), order, "left_anti")  # `order` is unique
        for k in keys:
            rest = rest.join(won.where(F.col(k).isNotNull()).select(k), k, "left_anti")
        open_rows = durable(rest.select(order, *keys))
    chosen = df.select(order).limit(0)
    for part in accepted:
        chosen = chosen.unionByName(part)
    accepted = attach(df, chosen, order, "left_semi")
    refused = df.join(accepted.select(order), order, "left_anti")
    reason = F.lit(None).cast("string")
    for k in reversed(keys):
        holders = accepted.where(F.col(k).isNotNull()).select(F.col(k), F.col(order).alias(f"_h_{k}"))
        refused = refused.join(holders, k, "left")
        reason = F.when(F.col(f"_h_{k}") < F.col(order), F.lit(f"{k} already registered")).otherwise(reason)
    return accepted, refused.withColumn("reason", reason).select(*df.columns, "reason")


def restored_gauges(predictions: DataFrame, feedback: DataFrame, users: DataFrame) -> DataFrame:
    """Gauges a restarted service sets from stored facts; `feedback` and `users` are the stats rows."""
    def rows(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
        pairs = F.explode(F.array(*[
            F.struct(F.lit(metric).alias("metric"), F.col(c).cast("double").alias("value")) for metric, c in names.items()]))
        return df.select(pairs.alias("p")).select("p.*")

    made = predictions.agg(F.count("*").alias("n"))
    return (
        rows(made, {"unique_predictions_total": "n"})
        .unionByName(rows(feedback, {"feedback_positive_rate": "positive_rate"}))
        .unionByName(rows(users, {"users_registered_total": "total_users", "users_verified_total": "verified_users"}))
    )
