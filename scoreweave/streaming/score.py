"""Streaming entry points: scoring is a projection and monitoring runs per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import ID, RAW_COLUMNS
from ..models.logistic import LogisticModel
from ..models.scorecard import ScoreScale, predict_frame
from ..operators.policy import ApprovalRule
from ..plans.monitoring import Monitor, run_and_record
from ..sources import runs

INPUT_SCHEMA = T.StructType(
    [T.StructField(ID, T.LongType()), *[T.StructField(c, T.DoubleType()) for c in RAW_COLUMNS]]
)


def read_applications(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(INPUT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def score_stream(
    source: DataFrame, model: LogisticModel, scale: ScoreScale = ScoreScale(), rule: ApprovalRule | None = None
) -> DataFrame:
    """Stateless: the batch call applied to a streaming frame."""
    return predict_frame(source, model, scale, rule)


def monitor_stream(source: DataFrame, monitor: Monitor, runs_path: str, checkpoint: str, name: str) -> StreamingQuery:
    """One recorded monitoring run per micro-batch.

    The batch number is part of the run id, so a batch that was done is recognised when
    it is replayed. A batch that failed is run again.
    """

    def handle(batch: DataFrame, number: int) -> None:
        run_id = f"{name}-{number}"
        done = runs.run_table(batch.sparkSession, runs_path).filter((F.col("run_id") == run_id) & (F.col("status") == "done"))
        if batch.isEmpty() or not done.isEmpty():
            return
        run_and_record(monitor, batch, runs_path, run_id, f"{name}-batch-{number}")

    return (
        source.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
