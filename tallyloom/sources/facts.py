"""Append-only fact tables, one Parquet folder per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

USERS = (
    "uid string, username string, email string, gender string, verified boolean, created_at timestamp, "
    "prediction_count bigint, feedback_count bigint")
PREDICTIONS = (
    "prediction_id string, uid string, username string, predicted_class string, confidence double, risk_level string, "
    "all_scores map<string,double>, inference_ms double, image_id string, image_filename string, timestamp timestamp")
IMAGES = (
    "image_id string, prediction_id string, uid string, username string, filename string, image_size_kb double, "
    "timestamp timestamp")
FEEDBACK = (
    "prediction_id string, uid string, username string, vote string, comment string, timestamp timestamp")
REQUEST_LOG = "uid string, endpoint string, timestamp timestamp"


def append(df: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Add rows to the day folders. The rebalance splits large days and joins small ones into sound files."""
    dated = df.withColumn("date", F.to_date(ts))
    dated.hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(path)


def append_once(df: DataFrame, path: str, batch: str, ts: str = "timestamp") -> None:
    """Add the rows of one named batch to the day folders; writing the same batch again replaces it.

    Each day folder has one folder per batch, and only the batch's own folders are overwritten, so a run that is repeated
    after a crash leaves every row once. The same batch must bring the same rows."""
    placed = df.withColumns({"date": F.to_date(ts), "batch": F.lit(batch)})
    placed.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("date", "batch").parquet(path)


def append_stream(stream: DataFrame, path: str, checkpoint: str, source: str, ts: str = "timestamp") -> int:
    """Append everything a stream has, once, whatever restarts come between; the number of micro-batches of this run.

    `source` names the stream among those that write to `path`."""
    def write(rows: DataFrame, number: int) -> None:
        append_once(rows, path, f"{source}-{number}", ts)

    running = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return len({p["batchId"] for p in running.recentProgress})


def read_facts(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed read; filters on `date` skip whole folders. Folders of batches below the days are read as well."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType(kind.fields).add("date", "date")).parquet(path)
