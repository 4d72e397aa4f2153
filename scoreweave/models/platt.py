"""Platt calibration: logistic regression on clipped log-odds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards
from ..functions.math import clipped_log_odds, sigmoid
from .logistic import fit_weighted


@dataclass(frozen=True)
class PlattModel:
    slope: float
    intercept: float

    def apply(self, p: Column | str) -> Column:
        return sigmoid(clipped_log_odds(guards.probability(p)) * F.lit(self.slope) + F.lit(self.intercept))


def fit_platt(df: DataFrame, y: str, p: str, C: float = 1.0, max_iter: int = 1000) -> PlattModel:
    """Equal probabilities are trained as one weighted row."""
    rows = (
        df.select(guards.binary_label(y).cast("double").alias("y"), guards.probability(p).alias("p"))
        .groupBy("p", "y")
        .agg(F.count("*").cast("double").alias("w"))
        .select(clipped_log_odds(F.col("p")).alias("z"), "y", "w")
        .persist()
    )
    try:
        n = rows.agg(F.sum("w").alias("n")).first()["n"]
        slope, intercept, _ = fit_weighted(rows, ["z"], int(n), C, max_iter)
    finally:
        rows.unpersist()
    return PlattModel(slope[0], intercept)
