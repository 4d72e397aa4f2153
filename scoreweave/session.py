"""Session helpers: shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel


def shared_folder(spark: SparkSession) -> str:
    """Return the folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="scoreweave-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage so that lost executors are harmless."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table_path(spark: SparkSession, name: str) -> str:
    """Return a fresh path for a written intermediate table."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    The table cuts the lineage: a lost executor costs a re-read, not a second run of the plan.
    """
    path = shared_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Generated methods above 8,000 bytes are never compiled by the JVM. With this limit
# Spark falls back to split projections for the widest expressions, which are.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}

# Inputs below this size may sit in one file split and leave all other cores idle.
SMALL_INPUT = 1 << 30


def apply_settings(spark: SparkSession) -> None:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)


def input_bytes(df: DataFrame) -> int:
    """Estimated size of everything ``df`` scans, from file statistics only."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread_small(df: DataFrame, key: str, limit: int = SMALL_INPUT) -> DataFrame:
    """Use all cores on a small input that is about to be scanned many times.

    Large inputs already come in many splits and are returned unchanged: they never
    pay for this shuffle.
    """
    if input_bytes(df) >= limit:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep ``df`` in memory and on disk while it is scanned several times.

    A frame the caller already keeps is used as it is.
    """
    if df.is_cached:
        yield df
        return
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()
