"""Ranking and probability metrics; tied predictions always move together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards
from ..functions.math import log_loss_term
from .ordered import bucket_edges, cumulative

METRICS = ("auc", "ks", "average_precision")


def ranking_aggregates() -> list[Column]:
    """AUC, KS and average precision over rows of :func:`ordered.cumulative`."""
    bad, good = F.col("bad"), F.col("good")
    cb, cg = F.col("cum_bad"), F.col("cum_good")
    total_bad, total_good = F.max("total_bad"), F.max("total_good")
    both = (total_bad > 0) & (total_good > 0)
    area = F.sum(good * (2 * cb - bad)) / 2
    gap = F.max(
        F.abs(
            F.try_divide(cb.cast("double"), F.col("total_bad"))
            - F.try_divide(cg.cast("double"), F.col("total_good"))
        )
    )
    precision = F.sum(F.coalesce(bad * F.try_divide(cb.cast("double"), cb + cg), F.lit(0.0)))
    one_class = F.raise_error(F.lit("both label classes must keep weight")).cast("double")
    return [
        F.when(both, area / (total_bad.cast("double") * total_good)).otherwise(one_class).alias("auc"),
        gap.alias("ks"),
        F.try_divide(precision, total_bad.cast("double")).alias("average_precision"),
    ]


def _classed(df: DataFrame, y: str, p: str, weight: Column | None, by=()) -> DataFrame:
    label = guards.binary_label(y)
    w = F.lit(1).cast("long") if weight is None else weight
    return df.select(*by, guards.probability(p).alias("p"), (w * label).alias("bad"), (w * (1 - label)).alias("good"))


def ranking_metrics(
    df: DataFrame,
    y: str,
    p: str,
    weight: str | None = None,
    by: tuple[str, ...] = (),
    edges: list[float] | None = None,
) -> DataFrame:
    """AUC (trapezoid), KS and average precision, optionally weighted and per group.

    Weights are divided by the largest one first; a weight that would vanish is refused.
    """
    w = None
    if weight is not None:
        top = df.agg(F.max(guards.weight(weight)).alias("top")).first()["top"]
        if top is None or top <= 0:
            raise ValueError("both label classes must keep weight")
        scaled = guards.weight(weight) / F.lit(float(top))
        w = F.when((F.col(weight) > 0) & (scaled == 0), F.raise_error(F.lit("weight range too wide"))).otherwise(scaled)
    classed = _classed(df, y, p, w, by)
    if edges is None:
        edges = bucket_edges(classed, "p")
    curve = cumulative(classed, "p", ["bad", "good"], by, True, edges)
    return (curve.groupBy(*by) if by else curve).agg(*ranking_aggregates())


def probability_report(df: DataFrame, y: str, p: str, edges: list[float] | None = None) -> DataFrame:
    """One row: rows, bad rate, mean p, AUC, Gini, KS, AP, Brier, log loss.

    Every term is additive per distinct p, so one shuffle serves all of them.
    """
    label, q = guards.binary_label(y), guards.probability(p)
    terms = df.select(
        q.alias("p"),
        label.cast("long").alias("bad"),
        (1 - label).cast("long").alias("good"),
        ((q - label) * (q - label)).alias("brier"),
        log_loss_term(label, q).alias("log_loss"),
    )
    if edges is None:
        edges = bucket_edges(terms, "p")
    curve = cumulative(terms, "p", ["bad", "good", "brier", "log_loss"], (), True, edges)
    n = F.sum(F.col("bad") + F.col("good"))
    mean_p = F.sum(F.col("p") * (F.col("bad") + F.col("good")))
    row = curve.agg(
        n.cast("long").alias("n_samples"),
        (F.sum("bad") / n).alias("bad_rate"),
        (mean_p / n).alias("mean_probability"),
        *ranking_aggregates(),
        (F.sum("brier") / n).alias("brier"),
        (F.sum("log_loss") / n).alias("log_loss"),
    )
    return row.select(
        "n_samples", "bad_rate", "mean_probability", "auc",
        (2 * F.col("auc") - 1).alias("gini"), "ks", "average_precision", "brier", "log_loss",
    )


def compare_models(df: DataFrame, y: str, probabilities: dict[str, str]) -> DataFrame:
    """Probability report per model, one row each."""
    rows = [
        probability_report(df, y, column).select(F.lit(name).alias("model"), "*")
        for name, column in probabilities.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


def constant_baseline(df: DataFrame, rate: float, name: str = "p_constant") -> DataFrame:
    return df.withColumn(name, F.lit(float(rate)))


def capacity_threshold(df: DataFrame, p: str, capacity: float, edges: list[float] | None = None) -> DataFrame:
    """Threshold of the k-th largest p, k = ceil(capacity * n); ties are kept together."""
    if not 0 < capacity <= 1:
        raise ValueError("capacity must lie in (0, 1]")
    counted = df.select(guards.probability(p).alias("p"), F.lit(1).cast("long").alias("n"))
    if edges is None:
        edges = bucket_edges(counted, "p")
    curve = cumulative(counted, "p", ["n"], (), True, edges)
    target = F.greatest(F.lit(1), F.ceil(F.lit(float(capacity)) * F.col("total_n")))
    reached = F.when(F.col("cum_n") >= target, F.col("p"))
    return (
        curve.withColumn("target", target)
        .agg(
            F.max("target").alias("target_count"),
            F.max(reached).alias("threshold"),
            F.min(F.when(F.col("cum_n") >= F.col("target"), F.col("cum_n"))).alias("flagged_count"),
            F.max("total_n").alias("n"),
        )
        .select(
            F.lit(float(capacity)).alias("capacity"),
            "target_count",
            "flagged_count",
            (F.col("flagged_count") / F.col("n")).alias("flagged_share"),
            "threshold",
        )
    )


def flag_quality(df: DataFrame, y: str, flagged: Column) -> DataFrame:
    """Share flagged, precision, recall, false-positive share, missed events."""
    label = guards.binary_label(y)
    base = df.select(label.alias("y"), flagged.alias("f"))
    bad, hit = F.col("y") == 1, F.col("f")
    row = base.agg(
        F.count("*").alias("n_samples"),
        F.count_if(bad).alias("n_bad"),
        F.count_if(hit).alias("n_flagged"),
        F.count_if(hit & bad).alias("caught"),
    )

    def share(a: Column, b: Column) -> Column:
        return F.try_divide(a.cast("double"), b)

    n, nb, nf, c = (F.col(x) for x in ("n_samples", "n_bad", "n_flagged", "caught"))
    return row.select(
        "n_samples",
        share(nb, n).alias("bad_rate"),
        share(nf, n).alias("flagged_share"),
        share(c, nf).alias("flagged_bad_rate"),
        share(c, nb).alias("bad_coverage"),
        share(nf - c, n - nb).alias("good_flagged_share"),
        (nb - c).alias("missed_bad"),
    )


def evaluation_rows(df: DataFrame, id_col: str, y: str, p: str, threshold: float) -> DataFrame:
    """Per-row evaluation output."""
    return df.select(
        id_col, F.col(y).alias("target"), F.col(p).alias("predicted_probability"),
        (F.col(p) >= F.lit(float(threshold))).alias("flagged_for_review"),
    )
