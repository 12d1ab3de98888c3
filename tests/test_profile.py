from pyspark.sql import functions as F

from tallyloom.operators import profile, quality

COUNTS = {"nv": 6705, "mel": 1113, "bkl": 1099, "bcc": 514, "akiec": 327, "vasc": 142, "df": 115}


def labels(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "label string, n int")
    return df.select("label", F.explode(F.sequence(F.lit(1), "n")).alias("i"))


def test_known_distribution(spark):
    df = labels(spark, COUNTS)
    assert [tuple(r) for r in profile.class_distribution(df, "label", "count").collect()] == sorted(
        COUNTS.items(), key=lambda kv: -kv[1])
    row = profile.imbalance(df, "label").first()
    assert (row["classes"], row["majority_class"], row["minority_class"], row["imbalance_ratio"]) == (7, "nv", "df", 58.3)


def test_ties_take_the_smallest_label(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), ("d",), ("d",)], "label string")
    row = profile.imbalance(df, "label").first()
    assert (row["majority_class"], row["minority_class"]) == ("c", "a")


def test_shares_and_duplicates(spark):
    df = spark.range(10015).select(
        F.when(F.col("id") < 5340, "histo").otherwise("other").alias("kind"), (F.col("id") % 7470).alias("lesion"))
    assert profile.category_share(df, "kind", "histo").first()["share_pct"] == 53.32
    assert profile.duplicate_groups(df, "lesion").first()["duplicates"] == 2545


def test_nulls_count_the_documented_way(spark):
    df = spark.createDataFrame([("a", 1.0), (None, None), ("a", 3.0)], "g string, x double")
    assert tuple(profile.table_profile(df).first()) == (3, 2, 2)
    assert tuple(profile.numeric_profile(df, "x").first()) == (1, 2.0, 1.0, 3.0)
    assert tuple(profile.duplicate_groups(df, "g").first()) == (3, 1, 2)
    assert profile.distinct_keys(df, "g").first()[0] == 1
    shares = profile.category_share(df, "g", "a").first()
    assert shares["share_pct"] == 66.67


def test_folder_stats_keep_unreadable_files(spark):
    files = spark.createDataFrame(
        [("p", 2048, 600, 450), ("p", 1024, 600, 450), ("p", 4096, 300, 200), ("p", 1024, None, None), ("q", 1024, None, None)],
        "folder string, bytes long, width int, height int")
    found = {r["folder"]: r for r in profile.folder_stats(files).collect()}
    p, q = found["p"], found["q"]
    assert (p["count"], p["max_width"], p["min_height"], p["unique_resolutions"], p["all_same_size"]) == (4, 600, 200, 2, "No")
    assert (p["common_resolution"], p["avg_file_size_kb"], p["max_file_size_kb"], p["total_size_mb"]) == ("(600, 450)", 2.0, 4.0, 0.01)
    assert (q["count"], q["max_width"], q["common_resolution"]) == (1, None, None)


def test_long_profile(spark):
    df = spark.createDataFrame([("a", "x", 1.0, "g"), ("b", "x", None, "g"), ("a", "y", 2.0, "h")], "label string, sex string, age double, lesion string")
    found = {r["metric"]: r["value"] for r in profile.profile(df, "label", ["age"], ["sex"], "lesion", "train").collect()}
    assert found["rows"] == "3" and found["age_missing"] == "1" and found["age_mean"] == "1.5"
    assert found["label_majority"] == "a" and found["label_imbalance_ratio"] == "2.0"
    assert found["unique_lesion"] == "2" and found["duplicate_lesion"] == "1" and found["sex_count_x"] == "2"


def test_split_checks(spark):
    good = spark.createDataFrame([("1", "p", "a", "g")], "image_id string, image_path string, label string, lesion_id string")
    table = quality.validate_splits({"train": good, "val": good.drop("label"), "test": None}, good.columns)
    found = {r["split"]: tuple(r)[1:] for r in table.collect()}
    assert found["train"] == (True, 1, 1, "", True)
    assert found["val"] == (True, 1, 0, "label", False)
    assert found["test"][:2] == (False, 0) and not found["test"][-1]
