import pytest
from pyspark.sql import functions as F

from tallyloom.functions.columns import labels_match, normalise
from tallyloom.operators import keys, quality
from tallyloom.session import scratch_path
from tallyloom.operators.lookup import attach, class_dimension, decode, encode, risk_lookup


def test_first_folder_wins_and_missing_is_null(spark, rows):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    found = spark.createDataFrame([("a", "part_2/a.jpg", 2), ("a", "part_1/a.jpg", 1), ("b", "part_2/b.jpg", 2)], "id string, path string, rank int")
    out = keys.resolve_first_match(wanted, found, "id", "path", ["rank"])
    assert rows(out, "id", "path") == [("a", "part_1/a.jpg"), ("b", "part_2/b.jpg"), ("c", None)]


def test_drop_unresolved_reports_the_count(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "id string, path string")
    kept, report = keys.drop_unresolved(df, "path")
    assert rows(kept) == [("a", "x")]
    assert rows(report) == [(2, 1, 1)]


def test_missing_present_union(spark, rows):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(keys.missing_keys(left, right, "k")) == [(1,)]
    assert rows(keys.present_rows(left, right, "k")) == [(2,)]
    assert rows(keys.union_keys("k", left.dropna(), right)) == [(1,), (2,), (3,)]
    assert rows(keys.overlap(left, right, "k")) == [(2,)]


def test_leakage_raises(spark):
    df = spark.createDataFrame([("g1", "train"), ("g1", "val"), ("g2", "train")], "g string, split string")
    with pytest.raises(ValueError, match="1 groups"):
        keys.assert_no_leakage(df, "g")
    keys.assert_no_leakage(df.where("g = 'g2'"), "g")


def test_class_match_needs_the_exact_set(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "label string")
    assert keys.class_match(df, "label", ["b", "a"]).first()["classes_match"]
    assert not keys.class_match(df, "label", ["a"]).first()["classes_match"]
    row = keys.class_match(df, "label", ["a", "b", "c"]).first()
    assert (row["classes_match"], row["missing_classes"], row["unseen_count"]) == (False, "c", 0)


def test_integrity_raises_on_other_classes(spark):
    df = spark.createDataFrame([("g", "a")], "lesion string, label string")
    assert quality.check_integrity(df, "label", "lesion", ["a"]).first()["rows"] == 1
    with pytest.raises(ValueError, match="class mismatch"):
        quality.check_integrity(df, "label", "lesion", ["b"])


def test_signup_and_vote_rules(spark, rows):
    users = spark.createDataFrame(
        [("  ab ", "male", "longenough"), ("abc", "robot", "short"), ("abc", "other", "12345678")],
        "username string, gender string, password string")
    checked = quality.check_rows(users, quality.signup_rules())
    assert [r["reasons"] for r in checked.collect()] == [["username_too_short"], ["gender_unknown", "password_too_short"], []]
    good, bad = quality.split_good_bad(users, quality.signup_rules())
    assert (good.count(), bad.count()) == (1, 2)
    votes = spark.createDataFrame([("thumbs_up",), ("invalid",), (None,)], "vote string")
    assert [r["ok"] for r in quality.check_rows(votes, quality.vote_rules()).collect()] == [True, False, False]


def test_file_check_statuses(spark):
    def ids(*values):
        return spark.createDataFrame([(v,) for v in values], "id string")

    table = quality.file_check({"Part 1": ids("a"), "Part 2": ids("b", "c")}, ids("a", "b"), ids("a", "b", "c"), ids("x", "y"), ids("x"))
    found = {r["check"]: (r["count"], r["status"]) for r in table.collect()}
    assert found == {
        "Part 1 images": (1, "OK"), "Part 2 images": (2, "OK"), "Train metadata rows": (2, "OK"),
        "Train missing images": (0, "OK"), "Test images on disk": (1, "OK"), "Test metadata raw": (2, "WARN"),
        "Test metadata clean": (1, "OK"), "Known missing test images": (1, "WARN"),
    }
    lost = quality.file_check({}, ids("a", "z"), ids("a"), ids("x"), ids("x"))
    assert {r["check"]: r["status"] for r in lost.collect()}["Train missing images"] == "FAIL"


def test_labels_encode_both_ways(spark, rows):
    df = spark.createDataFrame([("nv",), ("df",), ("??",), (None,)], "label string")
    small = encode(df, "label", ["df", "nv"])
    assert rows(small) == [(None, None), ("??", None), ("df", 0), ("nv", 1)]
    many = ["df", "nv", *(f"c{i}" for i in range(400))]
    assert rows(encode(df, "label", many)) == rows(small)
    assert rows(decode(small.where("idx is not null").select("idx"), "idx", many, "back")) == [(0, "df"), (1, "nv")]
    assert rows(decode(small.where("idx is not null").select("idx"), "idx", ["df", "nv"], "back")) == [(0, "df"), (1, "nv")]


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_attach_broadcasts_by_size_and_splits_a_hot_key(spark, rows):
    facts = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    lookup = facts.groupBy("k").agg(F.count("*").alias("n"))
    want = sorted((r["k"], r["v"], r["n"]) for r in facts.join(lookup, "k").collect())
    small = attach(facts, lookup, "k")
    assert "BroadcastHashJoin" in plan_of(small)
    assert sorted(tuple(r) for r in small.select("k", "v", "n").collect()) == want
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    }
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        source = spark.read.parquet(written(spark, facts))
        large = attach(source, lookup, "k")
        assert "SortMergeJoin(skew=true)" in plan_of(large)
        assert sorted(tuple(r) for r in large.select("k", "v", "n").collect()) == want
    finally:
        for key in limits:
            spark.conf.unset(key)


def written(spark, df):
    path = scratch_path(spark, "facts")
    df.repartition(8).write.parquet(path)
    return path


def test_risk_levels(spark):
    df = spark.createDataFrame([("mel",), ("bcc",), ("vasc",)], "label string")
    found = {r["label"]: r for r in risk_lookup(df, "label", class_dimension(spark)).collect()}
    assert (found["mel"]["risk_level"], found["mel"]["high_risk"], found["mel"]["display_name"]) == ("HIGH", True, "Melanoma")
    assert found["bcc"]["risk_level"] == "MEDIUM" and not found["vasc"]["high_risk"]
    assert found["vasc"]["sources"][0]["name"].startswith("AAD")


def test_normalise_and_label_match(spark):
    df = spark.createDataFrame([("\t  Ab C\n",)], "s string").select(normalise("s").alias("s"))
    assert df.first()["s"] == "ab c"
    labels = spark.createDataFrame([({"code": "404"},), ({"code": "1404"},), ({"other": "x"},)], "l map<string,string>")
    hit = labels.select(labels_match(F.col("l"), {"code": "4..|5.."}).alias("m"))
    assert [r["m"] for r in hit.collect()] == [True, False, False]


def test_kept_and_dropped_are_counted_while_writing(spark):
    calls = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, "x" if i % 3 else None) for i in range(30)], "i int, path string")

    def passed(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    kept, counted = keys.resolved(df.mapInPandas(passed, df.schema), "path")
    assert counted == {"total": 30, "kept": 20, "dropped": 10} and kept.count() == 20 and calls.value == 30
    assert keys.resolved(df.limit(0), "path")[1] == {"total": 0, "kept": 0, "dropped": 0}
