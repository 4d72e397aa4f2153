"""Modelling-table reader and report writers."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import guards
from ..functions.columns import ID, RAW_COLUMNS, TARGET


def load_model_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by suffix; required columns, no missing or repeated ids.

    Required CSV columns are read as numbers, other columns stay text.
    """
    if path.lower().rstrip("/").endswith(".csv"):
        text = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
        guards.require_columns(text, [ID, TARGET, *RAW_COLUMNS])
        numbers = {ID: "long", TARGET: "int", **{c: "double" for c in RAW_COLUMNS}}
        df = text.select(*[F.col(c).cast(numbers[c]).alias(c) if c in numbers else F.col(c) for c in text.columns])
    else:
        df = spark.read.parquet(path)
        guards.require_columns(df, [ID, TARGET, *RAW_COLUMNS])
    guards.require_unique_key(df, [ID])
    return df


def plain(value):
    """Undefined numbers become NULL; an infinite number is a fault, not a gap."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        if math.isnan(value):
            return None
        if math.isinf(value):
            raise ValueError("the report holds an infinite value")
    return value


def write_report(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a report table; infinite doubles stop the job, NaN is written as NULL."""
    checked = [
        F.when(F.isnan(f.name), F.lit(None))
        .when(F.abs(f.name) == float("inf"), F.raise_error(F.lit(f"{f.name} holds an infinite value")).cast("double"))
        .otherwise(F.col(f.name))
        .alias(f.name)
        if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    writer = df.select(*checked).write
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("kind must be parquet, csv or json")


def write_protocol(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON document as a single-row text file."""
    text = json.dumps(plain(document), ensure_ascii=False, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
