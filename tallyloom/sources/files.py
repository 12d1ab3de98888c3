"""File listings and image headers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tallyloom.functions.columns import col

HEAD_BYTES = 65_536
SIZE = StructType().add("width", IntegerType()).add("height", IntegerType())


def inventory(spark: SparkSession, path: str | list[str], glob: str = "*.jpg", recursive: bool = True) -> DataFrame:
    """(folder, path, id, bytes, modified) of every matching file; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", recursive)
        .load(path)
    )
    return files.select(
        F.element_at(F.split("path", "/"), -2).alias("folder"),
        "path",
        F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("id"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )


def read_contents(spark: SparkSession, path: str | list[str], glob: str = "*.jpg", recursive: bool = True) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -2).alias("folder"), "path", F.col("length").alias("bytes"), "content")


def _image_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from a PNG or JPEG header, None when there is no readable one."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        if len(data) < 24 or data[12:16] != b"IHDR":
            return None
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 2
            continue
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            if at + 9 > len(data):
                return None
            return int.from_bytes(data[at + 7:at + 9], "big"), int.from_bytes(data[at + 5:at + 7], "big")
        size = int.from_bytes(data[at + 2:at + 4], "big")
        if mark in (0xD9, 0xDA) or size < 2:
            return None
        at += 2 + size
    return None


@F.pandas_udf(SIZE)
def _header_size(content: pd.Series) -> pd.DataFrame:
    sizes = [_image_size(data) for data in content]
    return pd.DataFrame({
        "width": pd.array([s[0] if s else None for s in sizes], dtype="Int32"),
        "height": pd.array([s[1] if s else None for s in sizes], dtype="Int32"),
    })


def scan_image_headers(df: DataFrame, content: str | Column = "content") -> DataFrame:
    """Add width and height read from the header, null for files that are no readable image.

    Python gets the first 64 KiB; the few files whose header ends later are sent again in full.
    """
    data = col(content)
    first = df.withColumn("_size", _header_size(F.substring(data, 1, HEAD_BYTES)))
    undecided = F.col("_size.width").isNull() & (F.length(data) > HEAD_BYTES)
    second = first.withColumn("_again", _header_size(F.when(undecided, data)))
    return second.withColumns({
        "width": F.coalesce("_size.width", "_again.width"),
        "height": F.coalesce("_size.height", "_again.height"),
    }).drop("_size", "_again")
