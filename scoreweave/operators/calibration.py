"""Calibration tables on fixed equal-width bins and on quantile bins."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guards
from ..functions.math import balanced_position, log_loss_term
from .quantiles import exact_quantiles


def equal_edges(n_bins: int) -> list[float]:
    return [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]


def _positive(value, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a positive whole number")
    return value


def _inputs(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.select(guards.binary_label(y).alias("y"), guards.probability(p).alias("p"))


def calibration_bins(
    df: DataFrame, y: str, p: str, n_bins: int = 10, confidence: float = 0.95, min_bin_samples: int = 30
) -> DataFrame:
    """Right-closed equal-width bins with Wilson intervals; empty bins stay visible."""
    _positive(n_bins, "n_bins")
    _positive(min_bin_samples, "min_bin_samples")
    if isinstance(confidence, bool) or not 0 < confidence < 1:
        raise ValueError("confidence must lie strictly between 0 and 1")
    z = NormalDist().inv_cdf((1.0 + confidence) / 2.0)
    edges = equal_edges(n_bins)
    spark = df.sparkSession
    placed = _inputs(df, y, p).select(balanced_position("p", edges[1:-1]).alias("position"), "y", "p")
    counted = placed.groupBy("position").agg(
        F.count("*").alias("n"), F.sum("y").alias("b"), F.sum("p").alias("s")
    )
    bins = spark.createDataFrame(
        [(i, f"pbin_{i:02d}", edges[i], edges[i + 1]) for i in range(n_bins)],
        "position int, bin string, lower_edge double, upper_edge double",
    )
    full = bins.join(counted, "position", "left").select(
        "bin",
        "lower_edge",
        "upper_edge",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_samples"),
        F.coalesce("b", F.lit(0)).cast("long").alias("n_bad"),
        (F.col("s") / F.col("n")).alias("mean_probability"),
        (F.col("b") / F.col("n")).alias("observed_rate"),
    )
    n, rate = F.col("n_samples").cast("double"), F.col("observed_rate")
    filled = n > 0
    scale = 1 + z * z / n
    center = (rate + z * z / (2 * n)) / scale
    half = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)) / scale
    return full.select(
        "*",
        F.when(filled, F.greatest(F.lit(0.0), center - half)).alias("observed_lower"),
        F.when(filled, F.least(F.lit(1.0), center + half)).alias("observed_upper"),
        (F.col("mean_probability") - rate).alias("calibration_gap"),
        (~filled).alias("empty_bin"),
        (filled & (n < min_bin_samples)).alias("small_bin"),
    )


def calibration_summary(
    df: DataFrame, y: str, p: str, n_bins: int = 10, min_bin_samples: int = 30
) -> DataFrame:
    """One row: bias, Brier, log loss, weighted absolute error, bin and endpoint counts."""
    _positive(n_bins, "n_bins")
    edges = equal_edges(n_bins)
    q, label = F.col("p"), F.col("y")
    per_bin = (
        _inputs(df, y, p)
        .groupBy(balanced_position("p", edges[1:-1]).alias("position"))
        .agg(
            F.count("*").alias("n"),
            F.sum("y").alias("b"),
            F.sum("p").alias("s"),
            F.sum((q - label) * (q - label)).alias("brier"),
            F.sum(log_loss_term(label, q)).alias("loss"),
            F.count_if((q == 0) | (q == 1)).alias("ends"),
        )
    )
    n = F.sum("n")
    return per_bin.agg(
        n.cast("long").alias("n_samples"),
        (F.sum("b") / n).alias("bad_rate"),
        (F.sum("s") / n).alias("mean_probability"),
        (F.sum("s") / n - F.sum("b") / n).alias("bias"),
        (F.sum("brier") / n).alias("brier"),
        (F.sum("loss") / n).alias("log_loss"),
        (F.sum(F.abs(F.col("s") - F.col("b"))) / n).alias("ece"),
        (F.lit(n_bins) - F.count("*")).cast("long").alias("empty_bins"),
        F.count_if(F.col("n") < min_bin_samples).alias("small_bins"),
        F.sum("ends").cast("long").alias("endpoint_count"),
    )


def reliability_table(df: DataFrame, y: str, p: str, n_bins: int = 10) -> DataFrame:
    """Quantile bins, right-closed, lowest value included, repeated edges dropped."""
    rows = _inputs(df, y, p)
    points = [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]
    edges = sorted(set(exact_quantiles(rows, ["p"], points).get("p", [])))
    return (
        rows.groupBy(balanced_position("p", edges[1:-1]).alias("bin_index"))
        .agg(
            F.min("p").alias("lower"),
            F.max("p").alias("upper"),
            F.count("*").alias("n_samples"),
            F.avg("p").alias("mean_probability"),
            F.avg("y").alias("observed_rate"),
        )
    )


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of one column."""
    x = df.select(guards.finite(column, column).alias("x"))
    row = x.agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("lo"), F.max("x").alias("hi"),
    )
    known = row.first()
    quartiles = exact_quantiles(x, ["x"], [0.25, 0.5, 0.75]).get("x", [None] * 3)
    values = [known["n"], known["mean"], known["std"], known["lo"], *quartiles, known["hi"]]
    schema = "n long, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    return df.sparkSession.createDataFrame([tuple(values)], schema)
