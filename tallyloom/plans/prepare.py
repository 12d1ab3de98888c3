"""From metadata and file listings to leakage-free splits, their reports and the drift baseline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.constants import CLASS_NAMES, SPLIT_COLUMNS, SPLIT_SEED, VAL_SIZE
from tallyloom.functions.columns import join_path
from tallyloom.operators.keys import assert_no_leakage, resolved, present_rows, resolve_first_match
from tallyloom.operators.profile import class_distribution
from tallyloom.operators.quality import split_summary
from tallyloom.operators.split import class_weights, split_by_group
from tallyloom.session import durable
from tallyloom.sources.delimited import write_csv
from tallyloom.sources.reports import baseline_document, write_report


@dataclass
class Prepared:
    splits: DataFrame
    summary: DataFrame
    baseline: DataFrame
    unresolved: DataFrame

    def split(self, name: str) -> DataFrame:
        return self.splits.where(F.col("split") == name).select(*SPLIT_COLUMNS)


def with_paths(metadata: DataFrame, inventory: DataFrame, priority: Column) -> DataFrame:
    """Metadata with the path of each image; of several folders the one with the lowest priority wins."""
    found = inventory.select(F.col("id").alias("image_id"), F.col("path").alias("image_path"), priority.alias("_priority"))
    return resolve_first_match(metadata, found, "image_id", "image_path", ["_priority"])


def prepare(metadata: DataFrame, inventory: DataFrame, priority: Column, test_metadata: DataFrame | None = None,
            test_inventory: DataFrame | None = None, test_folder: str = "test", label: str = "dx",
            val_size: float = VAL_SIZE, seed: int = SPLIT_SEED, classes: Sequence[str] = CLASS_NAMES) -> Prepared:
    """Resolve files, split whole lesions, keep the test table as it is (minus rows without a file).

    The split table is written once; the leakage check, the summary and the baseline read it.
    """
    named = metadata.withColumnRenamed(label, "label")
    kept, counted = resolved(with_paths(named, inventory, priority), "image_path")
    report = metadata.sparkSession.createDataFrame([counted], "total long, kept long, dropped long")
    parts = split_by_group(kept.select(*SPLIT_COLUMNS), "lesion_id", "label", val_size, seed)
    if test_metadata is not None:
        on_disk = test_inventory.select(F.col("id").alias("image_id"))
        test = present_rows(test_metadata.withColumnRenamed(label, "label"), on_disk, "image_id").withColumn(
            "image_path", join_path(test_folder, F.col("image_id"), suffix=".jpg"))
        parts = parts.select(*SPLIT_COLUMNS, "split").unionByName(
            test.select(*SPLIT_COLUMNS, F.lit("test").alias("split")))
    splits = durable(parts.select(*SPLIT_COLUMNS, "split"))
    assert_no_leakage(splits.where("split <> 'test'"), "lesion_id")
    train = class_distribution(splits.where("split = 'train'"), "label")
    return Prepared(
        splits=splits,
        summary=split_summary(splits, "split", "label", "lesion_id"),
        baseline=baseline_document(class_weights(train, "label"), "label", classes),
        unresolved=report,
    )


def save(prepared: Prepared, folder: str, names: tuple[str, ...] = ("train", "val", "test")) -> None:
    """Split tables as CSV, the summary and the baseline document as JSON."""
    for name in names:
        write_csv(prepared.split(name), f"{folder}/{name}.csv")
    write_report(prepared.summary, f"{folder}/prepare_summary.json")
    write_report(prepared.baseline, f"{folder}/baseline_stats.json")
