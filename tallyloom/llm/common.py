"""Helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import durable, scratch_path  # noqa: F401

#: A side of a join is broadcast only if it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 50_000
#: Rows that one Arrow batch carries to Python; texts can be long.
BATCH_ROWS = 256

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return build
    return register


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the rows of an Arrow batch for the plans of this session, as one text can have megabytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def checked_broadcast(small: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table whose rows were counted; beyond the bound a shuffle join that AQE can split.

    The round-robin step keeps an aggregate from standing right under the join, so that a hot key is split."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small.repartition(max(2, rows // 1_000_000))


def words_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
