"""From scored requests to stored facts, rate-limit flags and metric samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.constants import CLASS_NAMES, RATE_LIMIT
from tallyloom.functions.columns import kilobytes
from tallyloom.operators.accounts import sliding_count
from tallyloom.operators.lookup import class_dimension, risk_lookup
from tallyloom.operators.scoring import score
from tallyloom.plans.monitoring import sample

REQUEST_COLUMNS = ["prediction_id", "uid", "username", "image_filename", "image_bytes", "inference_s", "timestamp"]


def prediction_facts(requests: DataFrame, logits: str = "logits", classes: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """Score requests and look up the risk; rounded the way they are stored."""
    scored = score(requests, logits, classes)
    known = risk_lookup(scored, "predicted_class", class_dimension(requests.sparkSession))
    return known.select(
        *REQUEST_COLUMNS, "predicted_class", F.round("confidence", 4).alias("confidence"), "risk_level", "high_risk",
        "display_name", "symptoms", "advisory", "sources", "all_scores",
        F.round(F.col("inference_s") * 1000, 2).alias("inference_ms"),
        F.md5(F.concat(F.lit("image:"), F.col("prediction_id"))).alias("image_id"),
    )


def prediction_rows(facts: DataFrame) -> DataFrame:
    return facts.select(
        "prediction_id", "uid", "username", "predicted_class", "confidence", "risk_level", "all_scores", "inference_ms",
        "image_id", "image_filename", "timestamp")


def image_rows(facts: DataFrame) -> DataFrame:
    return facts.select(
        "image_id", "prediction_id", "uid", "username",
        F.coalesce("image_filename", F.lit("unknown.jpg")).alias("filename"),
        F.round(kilobytes("image_bytes"), 2).alias("image_size_kb"), "timestamp")


def request_rows(facts: DataFrame, endpoint: str = "/predict", limit: int = RATE_LIMIT) -> DataFrame:
    """Request log with the sliding one-hour count; over the limit is flagged, the request still counts."""
    counted = sliding_count(facts.select("uid", "username", "timestamp"), "uid", "timestamp")
    return counted.withColumns({"endpoint": F.lit(endpoint), "breach": F.col("requests") >= limit})


def metric_samples(facts: DataFrame, requests: DataFrame, endpoint: str = "/predict") -> DataFrame:
    """(ts, metric, labels, value) rows of successful predictions and rate-limit breaches."""
    made = F.array_compact(F.array(
        sample("api_requests_total", {"endpoint": F.lit(endpoint), "method": F.lit("POST"), "status_code": F.lit("200")}),
        sample("images_processed_total", {"status": F.lit("success")}),
        sample("predictions_total", {"predicted_class": F.col("predicted_class"), "risk_level": F.col("risk_level")}),
        sample("prediction_confidence", {"predicted_class": F.col("predicted_class")}, F.col("confidence")),
        sample("inference_latency_seconds", {"mode": F.lit("single")}, F.col("inference_s")),
        sample("user_predictions_total", {"username": F.col("username")}),
        sample("high_risk_predictions_total", {}, when=F.col("high_risk")),
    ))
    breach = F.array(sample("user_rate_limit_breach_total", {"uid": F.col("uid"), "username": F.col("username")}))
    told = facts.select(F.col("timestamp").alias("ts"), F.explode(made).alias("s"))
    over = requests.where("breach").select(F.col("timestamp").alias("ts"), F.explode(breach).alias("s"))
    return told.unionByName(over).select("ts", "s.*")


def failure_samples(failures: DataFrame) -> DataFrame:
    """Samples of failed requests (ts, endpoint, error_type): http errors count as 400, internal ones as 500."""
    endpoint = F.col("endpoint")
    status = F.when(F.col("error_type") == "http", "400").otherwise("500")
    made = F.array_compact(F.array(
        sample("images_processed_total", {"status": F.lit("failed")}, when=endpoint == "/predict"),
        sample("errors_total", {"error_type": F.col("error_type"), "endpoint": endpoint}),
        sample("api_requests_total", {"endpoint": endpoint, "method": F.lit("POST"), "status_code": status}),
    ))
    return failures.select("ts", F.explode(made).alias("s")).select("ts", "s.*")
