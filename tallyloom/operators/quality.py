"""Row rules with reason codes, the file integrity table and split validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.constants import GENDERS, VOTES
from tallyloom.functions.columns import col, strip
from tallyloom.operators.keys import class_match, missing_columns, missing_keys
from tallyloom.operators.profile import table_profile


def min_length(column: str | Column, size: int, trimmed: bool = False) -> Column:
    text = col(column)
    return F.length(strip(text) if trimmed else text) >= size


def one_of(column: str | Column, values: Sequence) -> Column:
    return col(column).isin(list(values))


def between(column: str | Column, low: float, high: float, open_low: bool = False) -> Column:
    c = col(column)
    return ((c > low) if open_low else (c >= low)) & (c <= high)


def has_value(column: str | Column) -> Column:
    return col(column).isNotNull()


def signup_rules(username: str = "username", gender: str = "gender", password: str = "password") -> dict[str, Column]:
    return {
        "username_too_short": min_length(username, 3, trimmed=True),
        "gender_unknown": one_of(gender, GENDERS),
        "password_too_short": min_length(password, 8),
    }


def vote_rules(vote: str = "vote") -> dict[str, Column]:
    return {"vote_unknown": one_of(vote, VOTES)}


def check_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add `reasons` (codes of all broken rules, in rule order) and `ok`. A null test counts as broken."""
    broken = [F.when(~F.coalesce(good, F.lit(False)), F.lit(code)) for code, good in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*broken))).withColumn("ok", F.size("reasons") == 0)


def split_good_bad(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    checked = check_rows(df, rules)
    return checked.where("ok").drop("reasons", "ok"), checked.where("NOT ok").drop("ok")


def check_integrity(df: DataFrame, label: str, group: str, expected: Sequence[str]) -> DataFrame:
    """One row of integrity facts; raises when the label set is not exactly the expected one."""
    match = class_match(df, label, expected)
    row = match.first()
    if not row["classes_match"]:
        raise ValueError(
            f"class mismatch: missing [{row['missing_classes']}], {row['unseen_count']} unexpected of "
            f"{row['class_count']} labels"
        )
    groups = df.agg(F.countDistinct(group).alias("unique_groups"))
    return table_profile(df).withColumns({
        "unique_groups": groups.scalar(),
        "class_count": F.lit(row["class_count"]).cast("long"),
        "classes_match": F.lit(True),
    })


def file_check(inventories: Mapping[str, DataFrame], train: DataFrame, train_files: DataFrame,
               test: DataFrame, test_files: DataFrame, key: str = "id") -> DataFrame:
    """The (check, count, status) table: FAIL when train keys have no file, WARN when test keys have none.

    `inventories` are counted whole, one line each; the other tables carry the `key` column.
    """
    def line(counted: DataFrame, check: str, status: Column) -> DataFrame:
        return counted.agg(F.count("*").alias("count")).select(
            F.lit(check).alias("check"), "count", status.alias("status"))

    ok = F.lit("OK")
    lost_train = missing_keys(train, train_files, key)
    lost_test = missing_keys(test, test_files, key)
    lines = [line(files, f"{name} images", ok) for name, files in inventories.items()]
    lines += [
        line(train, "Train metadata rows", ok),
        line(lost_train, "Train missing images", F.when(F.col("count") == 0, "OK").otherwise("FAIL")),
        line(test_files.select(key).distinct(), "Test images on disk", ok),
        line(test, "Test metadata raw",
             F.when(lost_test.agg(F.count("*")).scalar() == 0, "OK").otherwise("WARN")),
        line(test.join(lost_test, key, "left_anti"), "Test metadata clean", ok),
        line(lost_test, "Known missing test images", F.when(F.col("count") == 0, "OK").otherwise("WARN")),
    ]
    table = lines[0]
    for extra in lines[1:]:
        table = table.unionByName(extra)
    return table


def validate_splits(splits: Mapping[str, DataFrame | None], expected: Sequence[str], label: str = "label") -> DataFrame:
    """Per split: does it exist, how many rows and classes, which columns are missing, is it valid."""
    spark = next(df.sparkSession for df in splits.values() if df is not None)
    found = None
    for name, df in splits.items():
        if df is None:
            row = spark.range(1).select(
                F.lit(name).alias("split"), F.lit(False).alias("exists"), F.lit(0).cast("long").alias("rows"),
                F.lit(0).cast("long").alias("classes"), F.lit("").alias("missing_cols"), F.lit(False).alias("valid"))
        else:
            absent = missing_columns(df, expected)
            classes = F.countDistinct(label) if label in df.columns else F.lit(0).cast("long")
            row = df.agg(F.count("*").alias("rows"), classes.alias("classes")).select(
                F.lit(name).alias("split"), F.lit(True).alias("exists"), "rows", "classes",
                F.lit(",".join(absent)).alias("missing_cols"), F.lit(not absent).alias("valid"))
        found = row if found is None else found.unionByName(row)
    return found


def split_summary(df: DataFrame, split: str, label: str, group: str) -> DataFrame:
    """Long form of size, unique groups and label counts per split, from one grouped pass over (split, group, label)."""
    cells = df.groupBy(split, group, label).agg(F.count("*").alias("n"))
    by_split = cells.groupBy(split).agg(F.sum("n").alias("size"), F.countDistinct(group).alias("unique_groups"))
    sizes = by_split.select(
        split, F.explode(F.array(
            F.struct(F.lit("size").alias("metric"), F.col("size").alias("value")),
            F.struct(F.lit("unique_groups").alias("metric"), F.col("unique_groups").alias("value")),
        )).alias("p")).select(split, "p.metric", "p.value")
    labels = cells.where(F.col(label).isNotNull()).groupBy(split, label).agg(F.sum("n").alias("value")).select(
        split, F.concat_ws("_", F.lit("label"), F.col(label)).alias("metric"), "value")
    return sizes.unionByName(labels)
