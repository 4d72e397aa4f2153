"""Logistic scoring on WOE columns: fitted once, applied as one projection."""

from __future__ import annotations

import json
from dataclasses import dataclass
from math import prod

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guards
from ..functions.columns import ID, TARGET
from ..functions.math import sigmoid, sql_literal
from ..functions.rules import FEATURES, business_features
from ..operators.binning import BinSpec, fit_bins
from ..operators.woe import WoeModel, fit_woe, select_encoded, unknown_sql, woe_sql
from ..session import spread_small
from .configs import LOGISTIC


class NotConvergedError(RuntimeError):
    """The optimiser ran out of iterations; its result must not be used."""


@dataclass(frozen=True)
class LogisticModel:
    """Frozen parameters: edges, WOE table, kept features, coefficients."""

    bins: BinSpec
    woe: WoeModel
    selected: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    training_rows: int = 0
    training_bad_rate: float = 0.0
    iterations: int = 0
    selection: tuple[tuple[str, float, str], ...] = ()

    def term_sql(self, feature: str, factor: float = 1.0) -> str:
        """``coefficient * woe`` of one feature, read straight from its bin."""
        coefficient = factor * self.coefficients[self.selected.index(feature)]
        scaled = {b: coefficient * w for b, w in self.woe.mapping(feature).items()}
        return self.bins[feature].lookup_sql(scaled, 0.0)

    def log_odds(self) -> Column:
        return F.expr(" + ".join([*(self.term_sql(f) for f in self.selected), sql_literal(self.intercept)]))

    def unknown_selected(self) -> Column:
        return F.expr(f"CAST({' + '.join(unknown_sql(self.bins, self.woe, f) for f in self.selected)} AS BIGINT)")

    def coefficient_report(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.selected, self.coefficients)), "feature string, coefficient double")

    def selection_report(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.selection), "feature string, iv double, selection_reason string")

    def summary(self, spark: SparkSession) -> DataFrame:
        row = (self.training_rows, self.training_bad_rate, len(self.selected), self.intercept, self.iterations)
        return spark.createDataFrame(
            [row], "training_rows long, training_bad_rate double, kept_features int, intercept double, iterations int"
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the parameters as three small tables."""
        self.bins.range_table(spark).coalesce(1).write.parquet(f"{path}/edges")
        self.woe.table(spark).coalesce(1).write.parquet(f"{path}/woe")
        document = {
            "n_bins": self.bins.n_bins,
            "alpha": self.woe.alpha,
            "features": list(self.woe.features),
            "selected": list(self.selected),
            "coefficients": list(self.coefficients),
            "intercept": self.intercept,
            "training_rows": self.training_rows,
            "training_bad_rate": self.training_bad_rate,
            "iterations": self.iterations,
            "selection": [list(x) for x in self.selection],
        }
        spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.text(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LogisticModel:
        d = json.loads(spark.read.text(f"{path}/model").first()["value"])
        bins = BinSpec.from_table(spark.read.parquet(f"{path}/edges"), d["n_bins"])
        woe = WoeModel.from_table(spark.read.parquet(f"{path}/woe"), d["features"], d["alpha"])
        return LogisticModel(
            bins, woe, tuple(d["selected"]), tuple(d["coefficients"]), d["intercept"], d["training_rows"],
            d["training_bad_rate"], d["iterations"], tuple(tuple(x) for x in d["selection"]),
        )


def _regression(C: float, rows: int, max_iter: int) -> LogisticRegression:
    """Same minimum as ``C * sum(loss) + |w|^2 / 2`` with a free intercept."""
    return LogisticRegression(
        regParam=1.0 / (C * rows), elasticNetParam=0.0, standardization=False, tol=1e-9,
        maxIter=max_iter, featuresCol="x", labelCol="y", weightCol="w",
    )


def fit_weighted(design: DataFrame, features: list[str], rows: int, C: float = 1.0, max_iter: int = 2000):
    """Fit on (features, y, w); returns coefficients, intercept, iterations."""
    vectors = VectorAssembler(inputCols=features, outputCol="x").transform(design).select("x", "y", "w")
    model = _regression(C, rows, max_iter).fit(vectors)
    steps = model.summary.totalIterations
    if steps >= max_iter:
        raise NotConvergedError("logistic regression did not converge")
    return [float(c) for c in model.coefficients], float(model.intercept), int(steps)


def fit_logistic(
    raw: DataFrame,
    target: str = TARGET,
    id_col: str = ID,
    n_bins: int = LOGISTIC["n_bins"],
    alpha: float = LOGISTIC["alpha"],
    iv_threshold: float = LOGISTIC["iv_threshold"],
    C: float = LOGISTIC["C"],
    max_iter: int = LOGISTIC["max_iter"],
) -> LogisticModel:
    """Rules, bins, WOE, selection and regression, all on the rows given here."""
    if isinstance(C, bool) or not 0 < C < float("inf"):
        raise ValueError("C must be finite and positive")
    if isinstance(max_iter, bool) or max_iter < 1:
        raise ValueError("max_iter must be a positive whole number")
    features = business_features(spread_small(raw, id_col), (id_col, target)).persist()
    try:
        bins = fit_bins(features, FEATURES, n_bins)
        woe = fit_woe(features, bins, target, alpha, 20)
        log = select_encoded(features, bins, woe, iv_threshold)
        selected = [r["feature"] for r in log if r["selection_reason"] == "keep"]
        if not selected:
            raise ValueError("no feature is left after selection")
        first = [r for r in woe.rows if r["feature"] == bins.names[0]]
        rows, bad = sum(r["n_samples"] for r in first), sum(r["n_bad"] for r in first)

        design = features.select(
            *[F.expr(woe_sql(bins, woe, f)).alias(f) for f in selected],
            guards.binary_label(target).cast("double").alias("y"),
        )
        combinations = 2 * prod(len(bins[f].labels) for f in selected)
        if 2 * combinations <= rows:
            # Every row is one of few bin combinations: train on those with weights.
            design = design.groupBy(*selected, "y").agg(F.count("*").cast("double").alias("w"))
        else:
            design = design.withColumn("w", F.lit(1.0))
        coefficients, intercept, steps = fit_weighted(design, selected, rows, C, max_iter)
    finally:
        features.unpersist()
    return LogisticModel(
        bins, woe, tuple(selected), tuple(coefficients), intercept, rows, bad / rows, steps,
        tuple((r["feature"], r["iv"], r["selection_reason"]) for r in log),
    )


def score_features(features: DataFrame, model: LogisticModel, keep=(ID,)) -> DataFrame:
    """Log-odds and probability from features; no shuffle, no fit."""
    scored = features.select(*keep, model.log_odds().alias("log_odds"))
    return scored.withColumn("predicted_bad_probability", sigmoid(F.col("log_odds")))


def score_raw(raw: DataFrame, model: LogisticModel, keep=(ID,)) -> DataFrame:
    return score_features(business_features(raw, tuple(keep)), model, keep)


def predict_class(scored: DataFrame) -> DataFrame:
    """Standard class at one half; not an approval rule."""
    return scored.withColumn("predicted_class", (F.col("predicted_bad_probability") >= 0.5).cast("int"))
