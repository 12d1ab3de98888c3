import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import lookup, ordered, ranks


def stopping_by_hand(values, patience):
    best, wait, best_at = 0.0, 0, None
    for i, v in enumerate(values, 1):
        if v is not None and v > best:
            best, wait, best_at = v, 0, i
        else:
            wait += 1
            if wait >= patience:
                return True, i, best_at, best
    return False, len(values), best_at, best


def test_early_stopping_against_a_loop(spark):
    rng = random.Random(4)
    runs = {f"r{k}": [rng.choice([0.0, -0.1, rng.random(), 0.5]) for _ in range(rng.randint(1, 40))] for k in range(40)}
    runs["flat"] = [0.0] * 12
    data = [(name, i, v) for name, values in runs.items() for i, v in enumerate(values, 1)]
    df = spark.createDataFrame(data, "run string, epoch int, f1 double")
    for chunk in (None, F.floor(F.col("epoch") / 3)):
        found = {r["run"]: r for r in ordered.early_stopping(df, "f1", "epoch", "run", 4, chunk).collect()}
        for name, values in runs.items():
            r = found[name]
            assert (r["stopped_early"], r["last_step"], r["best_step"], r["best_value"]) == stopping_by_hand(values, 4), name


def test_previous_value_crosses_chunks(spark):
    df = spark.createDataFrame([("a", i, i * i) for i in range(20)] + [("b", 100, 7)], "k string, t int, v int")
    found = ordered.with_previous(df, ["k"], ["t"], "v", F.floor(F.col("t") / 6)).collect()
    for r in found:
        assert r["previous"] == (None if r["t"] in (0, 100) else (r["t"] - 1) ** 2)


def test_running_folds(spark):
    df = spark.createDataFrame([("a", i, (i * 7) % 5) for i in range(30)], "k string, t int, v int")
    found = ordered.running_before(df, ["k"], ["t"], F.floor(F.col("t") / 4), {
        "top": ("max", F.col("v")), "low": ("min", F.col("v")), "total": ("sum", F.col("v"))}).collect()
    for r in found:
        before = [(i * 7) % 5 for i in range(r["t"])]
        assert (r["top"], r["low"], r["total"]) == (max(before, default=None), min(before, default=None), sum(before))


def rank_by_hand(values, p):
    if not values:
        return 0.0
    s = sorted(values)
    return s[min(len(s) - 1, max(0, int(round((len(s) - 1) * p))))]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=1, max_size=40), st.sampled_from([0.0, 0.25, 0.5, 0.95, 1.0]))
def test_any_doubles(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert ranks.nearest_rank(df, "v", p).first()["value"] == rank_by_hand(values, p)


def test_hot_value_and_groups(spark):
    rng = random.Random(8)
    data = [("hot", 5.0)] * 3000 + [("hot", rng.expovariate(0.01)) for _ in range(3000)] + [("b", float(i)) for i in range(5)]
    df = spark.createDataFrame(data, "k string, v double")
    for p in (0.3, 0.5, 0.95):
        found = {r["k"]: r["value"] for r in ranks.nearest_rank(df, "v", p, ["k"]).collect()}
        for k in ("hot", "b"):
            assert found[k] == rank_by_hand([v for g, v in data if g == k], p)


def test_empty_and_half_even(spark):
    empty = spark.createDataFrame([], "v double")
    assert ranks.nearest_rank(empty, "v", 0.95).first()["value"] == 0.0
    df = spark.createDataFrame([(float(i),) for i in range(6)], "v double")
    assert ranks.nearest_rank(df, "v", 0.5).first()["value"] == 2.0  # 2.5 rounds to even
    assert ranks.nearest_rank_approx(df, "v", 0.5).first()["value"] == pytest.approx(2.5, abs=0.6)


def test_null_keys_carry_over_chunks(spark):
    from tallyloom.operators import ordered, ranks

    data = [(k, i, float(i % 4)) for k in (None, "a") for i in range(12)]
    df = spark.createDataFrame(data, "k string, s int, v double")
    prev = ordered.with_previous(df, ["k"], ["s"], "v", F.floor(F.col("s") / 3))
    assert all(r["previous"] == (None if r["s"] == 0 else float((r["s"] - 1) % 4)) for r in prev.collect()) and prev.count() == 24
    runs = ordered.early_stopping(df, "v", "s", "k", 5, F.floor(F.col("s") / 3)).collect()
    assert len(runs) == 2 and tuple(runs[0])[1:] == tuple(runs[1])[1:]
    wide = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),), (float("inf"),)], "v double")
    assert [ranks.nearest_rank(wide, "v", p).first()["value"] for p in (0.0, 0.25, 0.5, 1.0)] == [float("-inf"), 1.0, 2.0, float("inf")]


def test_grid_before_1970_and_pushed_time_to_live(spark, tmp_path):
    from tallyloom.functions.columns import grid_index
    from tallyloom.operators.accounts import unexpired

    df = spark.createDataFrame([("1969-12-31 23:59:20",), ("1970-01-01 00:00:20",), ("1969-12-31 23:59:30",)], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    assert [r[0] for r in df.select(grid_index("ts", 30)).collect()] == [-1, 1, -1]
    df.write.parquet(str(tmp_path / "t"))
    left = unexpired(spark.read.parquet(str(tmp_path / "t")), "ts", 10, "1969-12-31 23:59:35")
    assert left.count() == 2
    assert "GreaterThan(ts" in left._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_by_share_or_by_rows(spark, monkeypatch):
    df = spark.createDataFrame([("a",)] * 30 + [("b",)] * 12 + [(None,)] * 15 + [(f"c{i}",) for i in range(43)], "k string")

    def hot(share):
        return {r.k for r in lookup.mark_hot(df, ["k"], share).where("hot").select("k").distinct().collect()}

    assert hot(0.2) == {"a"}
    monkeypatch.setattr(lookup, "HOT_ROWS", 11)
    assert hot(0.2) == {"a", "b", None}
    monkeypatch.setattr(lookup, "HOT_KEYS", 0)  # too many to broadcast
    assert hot(0.2) == {"a", "b", None} and lookup.mark_hot(df, ["k"], 0.2).count() == 100
