import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import accounts
from tallyloom.session import durable

START = datetime(2024, 1, 1)


def requests(spark, data):
    return spark.createDataFrame([(k, START + timedelta(microseconds=us)) for k, us in data], "uid string, ts timestamp")


@pytest.mark.parametrize("window,slices,share", [(3600, 60, 0.0), (3600, 60, 0.5), (3600, 1, 1.0), (60, 7, 0.5), (60, 6, 0.5)])
def test_sliding_count_against_brute_force(spark, window, slices, share):
    rng = random.Random(window + slices)
    data = []
    for uid in ("hot", "a", "b"):
        at = 0
        for _ in range(400 if uid == "hot" else 40):
            at += rng.choice([0, 1, window * 1_000_000, window * 1_000_000 + 1, rng.randint(0, window * 300_000)])
            data.append((uid, at))
    if (window * 1_000_000) % slices:
        with pytest.raises(ValueError):
            accounts.sliding_count(requests(spark, data), "uid", "ts", window, slices)
        return
    found = accounts.sliding_count(requests(spark, data), "uid", "ts", window, slices, hot_share=share)
    got = sorted((r["uid"], int((r["ts"] - START) / timedelta(microseconds=1)), r["requests"]) for r in found.collect())
    want = sorted((k, t, sum(1 for k2, t2 in data if k2 == k and t - window * 1_000_000 <= t2 <= t)) for k, t in data)
    assert got == want


def test_request_exactly_one_hour_old_counts(spark):
    data = [("u", 0), ("u", 3600_000_000), ("v", 0), ("v", 3600_000_001)]
    found = accounts.sliding_count(requests(spark, data), "uid", "ts")
    assert {(r["uid"], r["requests"]) for r in found.collect() if r["ts"] > START} == {("u", 2), ("v", 1)}


def test_breach_is_flagged_from_three(spark, rows):
    df = spark.createDataFrame([("u", n) for n in (1, 2, 3, 4)], "uid string, requests long")
    assert rows(accounts.breaches(df, "uid")) == [("u", 2, 4)]


def test_stats_count_facts_not_writes(spark, rows):
    users = spark.createDataFrame([("u",), ("v",)], "uid string")
    facts = spark.createDataFrame([("u",), ("u",), ("x",)], "uid string")
    out = accounts.user_stats(users, {"prediction_count": facts, "image_count": facts.limit(0)}, "uid")
    assert rows(out) == [("u", 2, 0), ("v", 0, 0)]
    people = spark.createDataFrame([(True,), (False,), (True,)], "verified boolean")
    assert tuple(accounts.user_counts(people, "verified").first()) == (3, 2)


def test_feedback_keeps_the_last_vote(spark):
    df = spark.createDataFrame([("p1", "thumbs_up", 1), ("p1", "thumbs_down", 2), ("p2", "thumbs_up", 1), ("p3", "thumbs_up", 5)], "pid string, vote string, ts int")
    row = accounts.feedback_stats(df, "pid", ["ts"], F.col("vote") == "thumbs_up").first()
    assert tuple(row) == (3, 2, 1, 0.6667)
    none = accounts.feedback_stats(df.limit(0), "pid", ["ts"], F.col("vote") == "thumbs_up").first()
    assert tuple(none) == (0, 0, 0, 0.0)
    gap = accounts.raw_and_distinct(df.withColumn("all", F.lit(1)), "all", "pid").first()
    assert (gap["writes"], gap["kept"], gap["gap"]) == (4, 3, 1)


def test_history_newest_first(spark):
    df = spark.createDataFrame([("u", i, i % 3) for i in range(30)], "uid string, id int, ts int")
    found = accounts.history_topk(df, "uid", "ts", 5, "id").orderBy("rank").collect()
    assert [(r["ts"], r["id"]) for r in found] == [(2, 29), (2, 26), (2, 23), (2, 20), (2, 17)]
    one = accounts.one_history(df, "uid", "u", "ts", 3, "id")
    assert [r["id"] for r in one.collect()] == [29, 26, 23]
    assert "TakeOrderedAndProject" in one._jdf.queryExecution().executedPlan().toString()
    plan = accounts.history_topk(df.repartition(3), "uid", "ts", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_expiry_bounds(spark):
    df = requests(spark, [("a", 0), ("b", 1)])
    now = (START + timedelta(seconds=3600)).isoformat(sep=" ")
    assert [r["uid"] for r in accounts.unexpired(df, "ts", 3600, now).collect()] == ["b"]


def admitted_by_hand(data):
    emails, names, kept, refused = set(), set(), [], []
    for i, email, name in sorted(data):
        if email is not None and email in emails:
            refused.append((i, "email already registered"))
        elif name is not None and name in names:
            refused.append((i, "name already registered"))
        else:
            kept.append(i)
            emails.add(email)
            names.add(name)
    return kept, refused


@pytest.mark.parametrize("seed", range(4))
def test_two_unique_keys_like_inserts_in_order(spark, seed):
    rng = random.Random(seed)
    size = rng.choice([30, 80])
    data = [(i, rng.choice([None, *(f"e{rng.randint(0, size // 3)}" for _ in range(9))]), f"n{rng.randint(0, size // 3)}") for i in range(size)]
    df = spark.createDataFrame(data, "i int, email string, name string")
    accepted, refused = accounts.admit_unique(df, ["email", "name"], "i")
    kept, lost = admitted_by_hand(data)
    assert sorted(r["i"] for r in accepted.collect()) == kept
    assert sorted((r["i"], r["reason"]) for r in refused.collect()) == sorted(lost)


@pytest.mark.parametrize("pass_rows", [1, 4, 25])
def test_unique_keys_by_parts_and_rounds(spark, monkeypatch, pass_rows):
    monkeypatch.setattr(accounts, "PASS_ROWS", pass_rows)
    monkeypatch.setattr(accounts, "FIRST_ROUNDS", 1)
    rng = random.Random(pass_rows)
    data = [(i, rng.choice([None, f"e{rng.randint(0, 12)}"]), rng.choice([None, f"n{rng.randint(0, 12)}"])) for i in range(30)]
    accepted, refused = accounts.admit_unique(spark.createDataFrame(data, "i int, email string, name string"), ["email", "name"], "i")
    kept, lost = admitted_by_hand(data)
    assert sorted(r["i"] for r in accepted.collect()) == kept
    assert sorted((r["i"], r["reason"]) for r in refused.collect()) == sorted(lost)


def chain(n, step=1):
    """Row i shares its email with row i - 1 and its name with row i + 1, so every second row is admitted."""
    return [(i * step, f"e{i // 2}", f"n{(i + 1) // 2}") for i in range(n)]


def test_a_chain_of_conflicts_needs_a_fixed_number_of_writes(spark, monkeypatch):
    counts = []
    for n in (100, 10_000):
        writes = []
        monkeypatch.setattr(accounts, "durable", lambda df: writes.append(1) or durable(df))
        accepted, _ = accounts.admit_unique(spark.createDataFrame(chain(n), "i int, email string, name string"), ["email", "name"], "i")
        assert sorted(r["i"] for r in accepted.collect()) == list(range(0, n, 2))
        counts.append(len(writes))
    assert counts[0] == counts[1]


def test_conflict_parts(spark, monkeypatch):
    rows = chain(200) + [(1000 + i, f"x{i}", None) for i in range(5)] + [(2000, "x3", "y"), (2001, None, "y"), (2002, None, None)]
    writes = []
    monkeypatch.setattr(accounts, "durable", lambda df: writes.append(1) or durable(df))
    parts = {r.i: r.part for r in accounts.conflict_parts(spark.createDataFrame(rows, "i int, email string, name string"), ["email", "name"], "i").collect()}
    assert {parts[i] for i in range(200)} == {0} and parts[2000] == parts[2001] == 1003 and parts[2002] == 2002 and parts[1004] == 1004
    assert len(writes) < 25


def test_prediction_totals(spark):
    df = spark.createDataFrame([("mel",), ("nv",), ("mel",)], "c string")
    found = {r["c"]: tuple(r)[1:] for r in accounts.prediction_stats(df, "c", F.col("c") == "mel").collect()}
    assert found == {"mel": (2, 2, 3, 2), "nv": (1, 0, 3, 2)}


def test_first_wins_and_latest_wins(spark, rows):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", 3, "c")], "k string, ts int, v string")
    assert rows(accounts.first_per_key(df, "k", ["ts"])) == [("k", 1, "a")]
    assert rows(accounts.latest_per_key(df, "k", ["ts"])) == [("k", 3, "c")]
