import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import split
from tallyloom.operators.keys import assert_no_leakage
from tallyloom.operators.profile import class_distribution

TRAIN = {"akiec": 276, "bcc": 437, "bkl": 942, "df": 93, "mel": 945, "nv": 5705, "vasc": 120}
WEIGHTS = {"akiec": 4.4089, "bcc": 2.7846, "bkl": 1.2918, "df": 13.0845, "mel": 1.2877, "nv": 0.2133, "vasc": 10.1405}


def test_known_class_weights(spark):
    counts = spark.createDataFrame(list(TRAIN.items()), "label string, n long")
    found = split.class_weights(counts, "label")
    assert {r["label"]: r["weight"] for r in found.collect()} == WEIGHTS
    vector = split.weight_vector(found, "label", sorted(TRAIN)).first()["weights"]
    assert vector == [WEIGHTS[c] for c in sorted(TRAIN)]
    with pytest.raises(Exception, match="no weight for class other"):
        split.weight_vector(found, "label", ["nv", "other"]).collect()


def test_mode_takes_smallest_on_ties(spark, rows):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("h", "c"), ("h", "c"), ("h", "a"), (None, "a"), ("i", None)], "g string, l string")
    assert rows(split.group_mode(df, "g", "l")) == [("g", "a"), ("h", "c")]


def quotas(spark, sizes, val_size):
    """Groups per stratum that go to train."""
    table = spark.createDataFrame(list(sizes.items()), "label string, n long")
    return {r["label"]: sizes[r["label"]] - r["val_quota"] for r in split.val_quotas(table, "label", "n", val_size).collect()}


def largest_remainder(sizes, val_size):
    total = sum(sizes.values())
    n_train = total - math.ceil(val_size * total)
    share = {k: n * float(n_train) / float(total) for k, n in sizes.items()}
    order = sorted(sizes, key=lambda k: (math.floor(share[k]) - share[k], k))
    short = n_train - sum(map(math.floor, share.values()))
    return {k: math.floor(share[k]) + (k in order[:short]) for k in sizes}


@pytest.mark.parametrize("seed", range(8))
def test_quotas_follow_largest_remainder(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(split, "SLOTS", rng.choice([1, 4, 4096]))
    sizes = {f"s{i}": rng.randint(2, 500) for i in range(rng.randint(1, 40))}
    assert quotas(spark, sizes, 0.3) == largest_remainder(sizes, 0.3)


def test_many_strata(spark):
    sizes = {f"s{i}": 2 + i % 9 for i in range(20_000)}
    assert quotas(spark, sizes, 0.3) == largest_remainder(sizes, 0.3)


def test_val_group_count_of_the_known_corpus(spark):
    assert 7470 - sum(quotas(spark, {"a": 7000, "b": 470}, 0.15).values()) == 1121


def test_small_strata_are_errors(spark):
    with pytest.raises(ValueError, match="two groups"):
        quotas(spark, {"a": 1, "b": 10}, 0.15)
    with pytest.raises(ValueError, match="cannot cover"):
        quotas(spark, {"a": 5, "b": 5, "c": 5}, 0.1)


def test_groups_without_label_are_counted(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", None), ("b", None), (None, "x")], "g string, l string")
    assert tuple(split.ungrouped(df, "g", "l").first()) == (1, 2)


def test_split_whole_groups_any_partitioning(spark):
    rng = random.Random(1)
    data = []
    for g in range(3000):
        label = rng.choices("abc", [70, 25, 5])[0]
        data += [(f"g{g}", label)] * rng.randint(1, 4)
    data += [("hot", "a")] * 4000 + [(None, "a")] * 7
    df = spark.createDataFrame(data, "g string, l string")
    placed = split.split_by_group(df, "g", "l", 0.15, 42)
    assert placed.count() == len(data) - 7
    assert split.ungrouped(df, "g").first()[0] == 7
    assert_no_leakage(placed, "g")
    first = {r["g"]: r["split"] for r in placed.select("g", "split").distinct().collect()}
    again = split.split_by_group(df.repartition(13), "g", "l", 0.15, 42)
    assert first == {r["g"]: r["split"] for r in again.select("g", "split").distinct().collect()}

    votes = defaultdict(Counter)
    for g, l in data:
        if g:
            votes[g][l] += 1
    stratum = {g: min(c, key=lambda l: (-c[l], l)) for g, c in votes.items()}
    sizes = Counter(stratum.values())
    quota = quotas(spark, sizes, 0.15)
    assert Counter(stratum[g] for g, s in first.items() if s == "train") == quota
    assert len([s for s in first.values() if s == "val"]) == math.ceil(0.15 * len(stratum))
    other = split.split_by_group(df, "g", "l", 0.15, 7)
    assert first != {r["g"]: r["split"] for r in other.select("g", "split").distinct().collect()}


def test_row_weights_and_first_rows(spark, rows):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(8)], "k int, label string")
    weights = {r["label"]: r["weight"] for r in split.row_weights(df, "label").collect()}
    assert weights == {"a": round(8 / (2 * 6), 4), "b": 2.0}
    assert rows(split.first_per_class(df, "label", 2, ["k"]), "label", "k") == [("a", 1), ("a", 2), ("b", 0), ("b", 4)]
    plan = split.first_per_class(df.repartition(4), "label", 2, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert class_distribution(df, "label").where(F.col("label") == "b").first()["n"] == 2
