"""Keyed streams with event-time timers: alert holds, targets that fall silent, rate limits, expiring records, counters.

Rows of a key are held in its state until the watermark has passed them and are then taken in time order, so neither late
nor unordered rows within the watermark change a result. Timers speak up where no row comes: a window empties, a hold
is over, a target is silent, a record has outlived its time. Before the shuffle each Arrow batch is reduced to what the
keyed step needs. A replay is brought to its end by a clock: a second source whose one row says that all rows up to an instant
have come.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructType

from tallyloom.functions.columns import grid_index, micros
from tallyloom.session import scratch_path
from tallyloom.streaming.events import run_available

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
AT = "at"
MINUTE = 60_000_000


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that keyed state with timers needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Clock:
    """A folder that tells a stream up to which instant all rows have come."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "clock")
        spark.createDataFrame([], f"{AT} timestamp").write.mode("append").parquet(self.path)

    def join(self, stream: DataFrame, watermark: str) -> DataFrame:
        """`stream` (with the event time `at`) under a watermark, with rows of the clock marked by `tick`."""
        ticks = self.spark.readStream.schema(f"{AT} timestamp").parquet(self.path)
        # whole numbers are 0, not null, as a null would make floats of a batch's column
        empty = [F.lit(0 if isinstance(f.dataType, IntegralType) else None).cast(f.dataType).alias(f.name) for f in stream.schema if f.name != AT]
        both = stream.withColumn("tick", F.lit(False)).unionByName(ticks.select(AT, *empty).withColumn("tick", F.lit(True)))
        return both.withWatermark(AT, watermark)

    def set(self, instant: datetime) -> None:
        self.spark.createDataFrame([(instant,)], f"{AT} timestamp").coalesce(1).write.mode("append").parquet(self.path)


def replay(stream: DataFrame, clock: Clock, out: str, checkpoint: str, as_of: datetime, delay: timedelta) -> dict:
    """Run everything that is there, then let the watermark pass `as_of` (whole milliseconds, rounded up)."""
    with keyed_state(stream.sparkSession):
        first = run_available(stream, out, checkpoint)
        clock.set(as_of + delay + timedelta(milliseconds=2))
        last = run_available(stream, out, checkpoint)
    return {"batches": first["batches"] + last["batches"], "late_rows": first["late_rows"] + last["late_rows"]}


def _whole(values) -> list[int]:
    return [int(v) for v in values]


class InOrder(StatefulProcessor):
    """Base of the processors here: `take` adds rows to a key's state, `advance` works up to the watermark."""

    held: str
    made: Sequence[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", self.held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.fresh(self.state.get())
        some = False
        for batch in rows:
            batch = batch[~batch["tick"].astype(bool)]
            if len(batch):
                some = True
                self.take(state, batch)
        if some:
            yield from self._go_on(key, state, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.state.get()
        if found is not None:
            yield from self._go_on(key, self.fresh(found), timerValues)

    def _go_on(self, key, state: dict, timerValues) -> Iterator[pd.DataFrame]:
        out, wake = self.advance(state, timerValues.getCurrentWatermarkInMs() * 1000, key)
        if wake is None and self.empty(state):
            self.state.clear()
        else:
            self.state.update(self.packed(state))
        if wake is not None:
            self.handle.registerTimer(-(-wake // 1000))
        if out:
            named = pd.DataFrame([(*key, *row) for row in out], columns=[*self.keys, *self.made])
            yield named.astype({c: "Int64" for c in self.whole})

    def close(self) -> None:
        pass

    # what a processor defines
    keys: Sequence[str] = ()
    whole: Sequence[str] = ()

    def fresh(self, found: tuple | None) -> dict:
        raise NotImplementedError

    def packed(self, state: dict) -> tuple:
        raise NotImplementedError

    def take(self, state: dict, rows: pd.DataFrame) -> None:
        raise NotImplementedError

    def advance(self, state: dict, upto: int, key: tuple) -> tuple[list[tuple], int | None]:
        """(rows for the result, next microsecond at which something happens without a row) from what is at or before `upto`."""
        raise NotImplementedError

    def empty(self, state: dict) -> bool:
        return False


# --- alert hold -----------------------------------------------------------------------------------------
class Hold(InOrder):
    """Windowed counts per series on the grid, judged by the series' rule and held; transitions come out.

    The count over (g - span, g] changes only where a step enters or leaves the window, so only those points and the
    end of the hold are looked at."""

    held = "gs array<long>, ns array<long>, closed long, since long, fired boolean"
    keys, made, whole = ("alertname", "series"), ("g_active", "g", "status"), ("g_active", "g")

    def __init__(self, rules: Mapping[str, tuple[int, float, int]], step: int):
        self.rules, self.width = rules, step * 1_000_000

    def fresh(self, found):
        gs, ns, closed, since, fired = found or ([], [], None, None, False)
        return {"steps": dict(zip(gs or [], ns or [], strict=True)), "closed": closed, "since": since, "fired": bool(fired)}

    def packed(self, state):
        return (_whole(state["steps"]), _whole(state["steps"].values()), state["closed"], state["since"], state["fired"])

    def empty(self, state):
        return not state["steps"] and state["since"] is None

    def take(self, state, rows):
        steps = state["steps"]
        for g, n in rows.groupby("g")["n"].sum().items():
            if state["closed"] is None or g > state["closed"]:
                steps[int(g)] = steps.get(int(g), 0) + int(n)

    def advance(self, state, upto, key):
        span, above, need = self.rules[key[0]]
        steps, until = state["steps"], upto // self.width
        closed = min([*steps, until + 1]) - 1 if state["closed"] is None else state["closed"]
        moves: dict[int, int] = {}
        for g, n in steps.items():
            moves[g] = moves.get(g, 0) + n
            moves[g + span] = moves.get(g + span, 0) - n
        points = sorted(p for p in moves if p > closed)
        seen = sum(n for p, n in moves.items() if p <= closed)
        out = []

        def fire(end: int) -> None:
            if state["since"] is not None and not state["fired"] and state["since"] + need < end:
                state["fired"] = True
                out.append((state["since"], state["since"] + need, "firing"))

        for at in points:
            if at > until:
                break
            fire(at)
            seen += moves[at]
            on = seen > above
            if on and state["since"] is None:
                state["since"], state["fired"] = at, False
                out.append((at, at, "pending"))
            elif not on and state["since"] is not None:
                out.append((state["since"], at, "resolved"))
                state["since"] = None
        fire(until + 1)
        state["closed"] = max(closed, until)
        state["steps"] = {g: n for g, n in steps.items() if g + span > until}
        ahead = [p for p in points if p > until]
        if state["since"] is not None and not state["fired"]:
            ahead.append(state["since"] + need)
        return out, min(ahead) * self.width if ahead else None


def _stepped(rows: DataFrame) -> DataFrame:
    """(alertname, series, g, n, at): each Arrow batch is counted per series and step before the shuffle."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby(["alertname", "series", "g", AT], dropna=False, as_index=False).agg(n=("n", "sum"))[["alertname", "series", "g", "n", AT]]
    return rows.mapInPandas(count, "alertname string, series string, g long, n long, at timestamp")


def alert_changes(stream: DataFrame, ts: str, rules: Sequence[Mapping], step: int, clock: Clock, watermark: str) -> DataFrame:
    """Transitions (alertname, series, g_active, g, status) of alerts on many series, counted from the stream itself.

    A rule (`alert`, `by`, `window`, `above`, `hold`, in seconds) is active for a value of its column `by` while more than
    `above` rows of that value lie in the window; it fires once it has been active for `hold` without a break. Null values are
    a series of their own, named by an empty text."""
    g = grid_index(ts, step)
    each = F.explode(F.array(*[F.struct(F.lit(r["alert"]).alias("alertname"), F.coalesce(F.col(r["by"]).cast("string"), F.lit("")).alias("series"))
                               for r in rules]))
    rows = stream.where(F.col(ts).isNotNull()).select(g.alias("g"), each.alias("r")).select(
        "r.*", "g", F.lit(1).cast("long").alias("n"), F.timestamp_micros(F.col("g") * (step * 1_000_000)).alias(AT))
    for r in rules:
        if r["window"] % step:
            raise ValueError("window must be a multiple of the step")
    held = Hold({r["alert"]: (r["window"] // step, float(r["above"]), -(-r["hold"] // step)) for r in rules}, step)
    timed = clock.join(_stepped(rows), watermark)
    return timed.groupBy("alertname", "series").transformWithStateInPandas(
        held, "alertname string, series string, g_active long, g long, status string", "Append", "eventTime")


def alert_rows(changes: DataFrame) -> DataFrame:
    """One row per alert from its transitions: (alertname, series, g_active, g_firing, g_resolved)."""
    def at(status: str) -> Column:
        return F.max(F.when(F.col("status") == status, F.col("g")))
    return changes.groupBy("alertname", "series", "g_active").agg(at("firing").alias("g_firing"), at("resolved").alias("g_resolved"))


# --- silent targets ---------------------------------------------------------------------------------------
class Silence(InOrder):
    """Down when no sample came for `max_age`; up again with the next sample."""

    held = "waiting array<long>, last long, down long"
    made, whole = ("down_at", "up_at"), ("down_at", "up_at")

    def __init__(self, key: str, max_age: int):
        self.keys, self.age = (key,), max_age * 1_000_000

    def fresh(self, found):
        waiting, last, down = found or ([], None, None)
        return {"waiting": list(waiting or []), "last": last, "down": down}

    def packed(self, state):
        return (_whole(state["waiting"]), state["last"], state["down"])

    def take(self, state, rows):
        state["waiting"] += _whole(rows["us"])

    def advance(self, state, upto, key):
        out = []

        def look(now: int) -> None:
            if state["last"] is not None and state["down"] is None and state["last"] + self.age < now:
                state["down"] = state["last"] + self.age
                out.append((state["down"], None))

        waiting = sorted(set(state["waiting"]))
        passed = bisect.bisect_right(waiting, upto)
        for at in waiting[:passed]:
            if state["last"] is not None and at <= state["last"]:
                continue
            look(at)
            if state["down"] is not None:
                out.append((state["down"], at))
                state["down"] = None
            state["last"] = at
        look(upto)
        state["waiting"] = waiting[passed:]
        wakes = state["waiting"][:1]
        if state["last"] is not None and state["down"] is None:
            wakes.append(state["last"] + self.age + 1000)
        return out, min(wakes) if wakes else None


def _sliced(rows: DataFrame, key: str) -> DataFrame:
    """(key, us, at): of each Arrow batch only a key's first and last sample of every minute."""
    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch.groupby([key, batch["us"] // MINUTE], dropna=False)["us"].agg(["min", "max"]).stack().reset_index(level=0, name="us")
            yield found.drop_duplicates()[[key, "us"]]
    kind = StructType([rows.schema[key], rows.schema["us"]])
    return rows.mapInPandas(ends, kind).withColumn(AT, F.timestamp_micros("us"))


def down_changes(stream: DataFrame, key: str, ts: str, max_age: int, clock: Clock, watermark: str) -> DataFrame:
    """(key, down_at, up_at) in microseconds: a row when a target has been silent for `max_age` seconds (at least a
    minute), and one with the next sample. A timer speaks up where no sample comes. Targets without a key are left out."""
    if max_age < 60:
        raise ValueError("max_age must be a minute at least")
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, micros(ts).alias("us"))
    timed = clock.join(_sliced(rows, key), watermark)
    kind = StructType([rows.schema[key], *StructType.fromDDL("down_at long, up_at long").fields])
    return timed.groupBy(key).transformWithStateInPandas(Silence(key, max_age), kind, "Append", "eventTime")


def down_spans(changes: DataFrame, key: str) -> DataFrame:
    """One row per span; `up_at` is null while the target is down."""
    return changes.groupBy(key, "down_at").agg(F.max("up_at").alias("up_at"))


# --- rate limit -------------------------------------------------------------------------------------------
class Ring(StatefulProcessor):
    """Requests of a key in the last `window`, in a ring of slices: a step reads the slices it looks back on and writes
    those it changes. Rows that the watermark has not passed wait in a list."""

    def __init__(self, key: str, window: int, slices: int = 4):
        self.key, self.window = key, window * 1_000_000
        self.width = max(1, self.window // slices)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long")
        self.ring = handle.getMapState("ring", "slice long", "at array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = [b[["us", "id"]] for b in (b[~b["tick"].astype(bool)] for b in rows) if len(b)]
        if found:
            new = pd.concat(found)
            self.waiting.appendList(list(zip(_whole(new["us"]), _whole(new["id"]), strict=True)))
            for end in (new["us"].min(), new["us"].max()):
                self.handle.registerTimer(-(-int(end) // 1000))
            yield from self._go_on(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go_on(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _go_on(self, key, upto: int) -> Iterator[pd.DataFrame]:
        waiting = sorted((int(at), int(i)) for at, i in self.waiting.get())
        passed = bisect.bisect_right(waiting, upto, key=lambda r: r[0])
        held = sorted(int(k[0]) for k in self.ring.keys())
        gone = [s for s in held if (s + 1) * self.width + self.window <= upto]
        if passed:
            new = np.array([at for at, _ in waiting[:passed]], np.int64)
            first = (int(new[0]) - self.window) // self.width
            back = {s: list(self.ring.getValue((s,))[0]) for s in held if s >= first}
            seen = np.sort(np.concatenate([np.array([at for ats in back.values() for at in ats], np.int64), new]))
            count = np.searchsorted(seen, new, "right") - np.searchsorted(seen, new - self.window, "left")
            yield pd.DataFrame({self.key: [key[0]] * passed, "id": [i for _, i in waiting[:passed]], "us": new, "requests": count})
            slices = new // self.width
            for s in np.unique(slices).tolist():
                if (s + 1) * self.width + self.window > upto:  # later requests can still look back on it
                    self.ring.updateValue((s,), (back.get(s, []) + _whole(new[slices == s]),))
                    self.handle.registerTimer(-(-((s + 1) * self.width + self.window) // 1000))
            if waiting[passed:]:
                self.waiting.put(waiting[passed:])
            else:
                self.waiting.clear()
        for s in gone:
            self.ring.removeKey((s,))

    def close(self) -> None:
        pass


def request_counts(stream: DataFrame, key: str, ts: str, identity: str, window: int, clock: Clock, watermark: str) -> DataFrame:
    """(key, id, us, requests): each request with the number of its key's requests in [ts - window, ts], same-instant ones
    included. Rows without a key or a time are left out, a missing `id` is -1; state lasts one window."""
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        key, F.coalesce(F.col(identity).cast("long"), F.lit(-1)).alias("id"), micros(ts).alias("us"), F.col(ts).cast("timestamp").alias(AT))
    kind = StructType([rows.schema[key], *StructType.fromDDL("id long, us long, requests long").fields])
    return clock.join(rows, watermark).groupBy(key).transformWithStateInPandas(Ring(key, window), kind, "Append", "eventTime")


# --- records that expire ------------------------------------------------------------------------------------
class Record(InOrder):
    """The newest value of a key, forgotten `ttl` after its time unless a newer one came."""

    held = "us array<long>, tie array<long>, value array<string>"
    made, whole = ("us", "tie", "value", "expired_at"), ("us", "tie", "expired_at")

    def __init__(self, key: str, ttl: int):
        self.keys, self.ttl = (key,), ttl * 1_000_000

    def fresh(self, found):
        return {"rows": list(zip(*found, strict=True)) if found else []}

    def packed(self, state):
        us, tie, value = zip(*state["rows"], strict=True) if state["rows"] else ((), (), ())
        return (_whole(us), _whole(tie), list(value))

    def empty(self, state):
        return not state["rows"]

    def take(self, state, rows):
        state["rows"] += [(int(u), int(t), v) for u, t, v in zip(rows["us"], rows["tie"], rows["value"], strict=True)]

    def advance(self, state, upto, key):
        rows = sorted(state["rows"], key=lambda r: r[:2])  # rows[0] is the record, once the watermark has passed it
        out = []
        while rows and rows[0][0] <= upto:
            over = rows[0][0] + self.ttl
            if len(rows) > 1 and rows[1][0] <= min(over, upto):
                rows.pop(0)  # replaced in time
            elif over <= upto:
                out.append((*rows.pop(0), over))
            else:
                break
        state["rows"] = rows
        wakes = [r[0] for r in rows[:2] if r[0] > upto] + [r[0] + self.ttl for r in rows[:1]]
        return out, min(wakes) if wakes else None


def expired_records(stream: DataFrame, key: str, ts: str, tie: str, value: str, ttl: int, clock: Clock, watermark: str) -> DataFrame:
    """(key, us, tie, value, expired_at): records that outlived `ttl` seconds without a newer row of their key.

    A newer row replaces the record up to the instant at which it would expire. Live records are in the state, see
    `live_records`. Rows without a key or a time are left out; of equal times the larger `tie` wins, a missing one is -1."""
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        key, micros(ts).alias("us"), F.coalesce(F.col(tie).cast("long"), F.lit(-1)).alias("tie"), F.col(value).cast("string").alias("value"))

    def newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The last row of a key and minute; earlier ones of the same minute are replaced within any ttl of a minute."""
        for batch in batches:
            ordered = batch.sort_values(["us", "tie"], kind="stable")
            yield ordered[~pd.DataFrame({"k": ordered[key], "m": ordered["us"] // MINUTE}).duplicated(keep="last")]

    if ttl < 60:
        raise ValueError("ttl must be a minute at least")
    timed = clock.join(rows.mapInPandas(newest, rows.schema).withColumn(AT, F.timestamp_micros("us")), watermark)
    kind = StructType([rows.schema[key], *StructType.fromDDL("us long, tie long, value string, expired_at long").fields])
    return timed.groupBy(key).transformWithStateInPandas(Record(key, ttl), kind, "Append", "eventTime")


def state_rows(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """The keyed state of a stopped stream: the columns of its keys and of its values, map entries or list elements."""
    with keyed_state(spark):
        found = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).option("flattenCollectionTypes", True).load()
        return found.select(*[f"{c}.*" for c in found.columns if isinstance(found.schema[c].dataType, StructType)])


def live_records(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """(key, us, tie, value): the records a stopped `expired_records` stream still knows."""
    newest = F.array_max(F.arrays_zip("us", "tie", "value"))
    return state_rows(spark, checkpoint, "held").select(key, newest.alias("r")).select(key, "r.*")


# --- counters that go on from facts ---------------------------------------------------------------------------
class Counter(StatefulProcessor):
    """Running count and sum of a key; starts from what was stored."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long, units long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.total.update((int(initialState["n"].sum()), int(initialState["units"].sum())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, units = self.total.get() or (0, 0)
        for batch in rows:
            n, units = n + int(batch["n"].sum()), units + int(batch["units"].sum())
        self.total.update((n, units))
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "units": [units]})

    def close(self) -> None:
        pass


def running_counters(stream: DataFrame, key: str, units: Column, stored: DataFrame | None = None) -> DataFrame:
    """(key, n, units) after every micro-batch that brings rows for a key; `stored` (key, n, units) is where counting starts.

    `units` is a whole number per row. Only the first start of a checkpoint reads `stored`."""
    rows = stream.select(key, F.lit(1).cast("long").alias("n"), F.coalesce(units.cast("long"), F.lit(0)).alias("units"))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby(key, dropna=False, as_index=False)[["n", "units"]].sum()

    kind = StructType([rows.schema[key], *StructType.fromDDL("n long, units long").fields])
    begun = None if stored is None else stored.select(key, "n", "units").groupBy(key)
    return rows.mapInPandas(summed, rows.schema).groupBy(key).transformWithStateInPandas(
        Counter(key), kind, "Append", "None", initialState=begun)
