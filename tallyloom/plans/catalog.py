"""Loads every query module so that the registry is complete."""

from tallyloom.plans import (  # noqa: F401
    account_queries,
    drift_queries,
    evaluation_queries,
    ingest_queries,
    metric_queries,
    profile_queries,
    split_queries,
    stream_queries,
)
from tallyloom.plans.registry import ORACLES, QUERIES  # noqa: F401
