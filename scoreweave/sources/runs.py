"""Append-only run records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .load import path_exists
from .tables import plain

RUN_SCHEMA = "run_id string, batch_id string, run_at timestamp, status string, payload string"


def run_table(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], RUN_SCHEMA)
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def require_new(spark: SparkSession, path: str, run_id: str) -> None:
    """Refuse an id that is already recorded; a failed attempt may be repeated."""
    if not run_table(spark, path).filter((F.col("run_id") == run_id) & (F.col("status") != "failed")).isEmpty():
        raise ValueError(f"run {run_id} is already recorded")


def save_run(spark: SparkSession, path: str, run_id: str, batch_id: str, status: str, record: dict) -> None:
    """Append one record; an id is never overwritten."""
    for value, name in ((run_id, "run_id"), (batch_id, "batch_id")):
        if not isinstance(value, str) or not value.strip():
            raise ValueError(f"{name} must be a non-blank string")
    payload = json.dumps(plain(record), ensure_ascii=False, allow_nan=False)
    require_new(spark, path, run_id)
    row = spark.createDataFrame(
        [(run_id, batch_id, status, payload)], "run_id string, batch_id string, status string, payload string"
    ).withColumn("run_at", F.current_timestamp())
    order = [part.split()[0] for part in RUN_SCHEMA.split(", ")]
    row.select(*order).coalesce(1).write.mode("append").parquet(path)


def load_runs(spark: SparkSession, path: str, limit: int = 200) -> DataFrame:
    """Newest runs first; reading never creates or changes a record."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError("limit must be a positive whole number")
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no run records at {path}")
    return run_table(spark, path).orderBy(F.desc("run_at"), F.desc("run_id")).limit(limit)


def append_opening(spark: SparkSession, path: str, manifest_digest: str, rows: int, predictions_digest: str) -> int:
    """Log one opening of the final part and return how often it was opened."""
    row = spark.createDataFrame(
        [(manifest_digest, rows, predictions_digest)], "manifest_digest string, n_rows long, predictions_digest string"
    ).withColumn("opened_at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).count()
