"""Cumulative sums in a global order without sorting everything in one task.

Equal values are collapsed first (map-side), values are cut into buckets at
sketched quantiles, bucket totals give each bucket its starting sums, and the order
inside a bucket is an ordinary partitioned window.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rows (before collapsing ties) one ordered bucket should hold.
BUCKET_ROWS = 1_000_000


def bucket_edges(df: DataFrame, value: str, bucket_rows: int = BUCKET_ROWS) -> list[float]:
    """Cut points holding about ``bucket_rows`` rows apart, as literals.

    Literals keep the buckets identical when lost tasks are computed again. Their number
    follows the rows, so a bucket does not grow with the data.
    """
    rows = df.agg(F.count("*").alias("n")).first()["n"]
    buckets = -(-rows // bucket_rows)
    if buckets <= 1:
        return []
    points = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = df.agg(F.percentile_approx(value, points, max(10_000, 10 * buckets)).alias("q")).first()["q"]
    return sorted(set(cuts))


def with_bucket(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Add ``bucket`` by binary search over the cut points."""
    if not edges:
        return df.withColumn("bucket", F.lit(0))
    splits = [float("-inf"), *edges, float("inf")]
    placed = Bucketizer(splits=splits, inputCol=value, outputCol="bucket").transform(df)
    return placed.withColumn("bucket", F.col("bucket").cast("int"))


def cumulative(
    df: DataFrame,
    value: str,
    measures: list[str],
    by: tuple[str, ...] = (),
    descending: bool = True,
    edges: list[float] | None = None,
) -> DataFrame:
    """One row per (``by``, value): sums, ``cum_*`` up to and including it, ``total_*``."""
    by = list(by)
    ties = df.groupBy(*by, value).agg(*[F.sum(m).alias(m) for m in measures])
    placed = with_bucket(ties, value, edges or [])
    direction = F.desc if descending else F.asc

    inner = Window.partitionBy(*by, "bucket").orderBy(direction(value))
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by, "bucket")
    if not edges:
        return placed.select(
            *by, value, *measures,
            *[F.sum(m).over(upto).alias(f"cum_{m}") for m in measures],
            *[F.sum(m).over(whole).alias(f"total_{m}") for m in measures],
        )

    # One row per bucket and ``by`` group: a millionth of the rows.
    per_bucket = Window.partitionBy(*by).orderBy(direction("bucket"))
    before = per_bucket.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*by, "bucket")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(
            *by, "bucket",
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"start_{m}") for m in measures],
            *[F.sum(m).over(Window.partitionBy(*by)).alias(f"total_{m}") for m in measures],
        )
    )
    # Without groups the table has one row per bucket, so its size is known.
    joined = placed.join(offsets if by else F.broadcast(offsets), [*by, "bucket"])
    return joined.select(
        *by, value, *measures,
        *[(F.sum(m).over(upto) + F.col(f"start_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )
