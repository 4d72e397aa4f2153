"""Main-table profile: shape, label shares, missing rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TARGET


def missing_rates(df: DataFrame, top: int | None = None) -> DataFrame:
    """Missing rate per column in one scan, highest first, ties by name."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.round(F.col(c), 9).alias("missing_rate")) for c in df.columns
    ]
    long = row.select(F.inline(F.array(*entries))).orderBy(F.desc("missing_rate"), "column_name")
    return long if top is None else long.limit(top)


def label_distribution(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows and share per label value."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    return counts.select(
        F.col(target).cast("int").alias(target), "n", (F.col("n") / F.sum("n").over(_all())).alias("share")
    )


def _all():
    from pyspark.sql.window import Window

    # Runs over the label counts (one row per label value), never over the data.
    return Window.partitionBy()


def table_shape(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows, columns, bad rate and good-to-bad ratio."""
    bad = F.count_if(F.col(target) == 1)
    n = F.count("*")
    return df.agg(
        n.alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        (bad / n).alias("bad_rate"),
        F.try_divide((n - bad).cast("double"), bad).alias("good_per_bad"),
    )
