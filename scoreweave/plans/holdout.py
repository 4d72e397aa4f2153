"""Development reports on one stratified holdout: fit on train, report on valid.

The test part stays sealed: no function here reads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.columns import ID, TARGET
from ..functions.rules import FEATURES, business_features
from ..models.logistic import LogisticModel, fit_logistic
from ..models.scorecard import ScoreScale, bin_points, input_diagnostics, require_score_identities, score_frame, scorecard_unknown_report
from ..models.trees import TreeModel, fit_trees
from ..operators import bootstrap, calibration, drift, explain, policy, ranking, split
from ..sources.tables import write_protocol, write_report
from . import scoring

LOGISTIC, TREES = "logistic", "trees"


@dataclass(frozen=True)
class Holdout:
    """Both models with train and valid rows scored side by side."""

    logistic: LogisticModel
    trees: TreeModel
    train: DataFrame
    valid: DataFrame
    train_raw: DataFrame
    valid_raw: DataFrame

    @property
    def models(self) -> dict:
        return {LOGISTIC: self.logistic, TREES: self.trees}


@contextmanager
def holdout(table: DataFrame, seed: int = 42, tree_options: dict | None = None) -> Iterator[Holdout]:
    """Split, fit and score once; every report reads the kept frames."""
    parted = split.stratified_split(table, seed=seed)
    train_raw = parted.filter("partition = 'train'").drop("partition")
    valid_raw = parted.filter("partition = 'valid'").drop("partition")
    models = fit_logistic(train_raw), fit_trees(train_raw, **(tree_options or {}))

    def both(raw: DataFrame) -> DataFrame:
        features = business_features(raw, (ID, TARGET))
        keep = (ID, TARGET, *FEATURES)
        first = scoring.probability(features, models[0], keep, LOGISTIC)
        return scoring.probability(first, models[1], (*keep, LOGISTIC), TREES).persist(StorageLevel.MEMORY_AND_DISK)

    train, valid = both(train_raw), both(valid_raw)
    try:
        yield Holdout(*models, train, valid, train_raw, valid_raw)
    finally:
        train.unpersist()
        valid.unpersist()


def _stack(parts: dict[str, DataFrame]) -> DataFrame:
    labelled = [df.select(F.lit(name).alias("model"), "*") for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), labelled)


def comparison(run: Holdout) -> dict[str, DataFrame]:
    """Metrics of both models and of the constant training rate."""
    spark = run.valid.sparkSession
    valid = ranking.constant_baseline(run.valid, run.logistic.training_bad_rate, "constant")
    return {
        "metrics": ranking.compare_models(valid, TARGET, {n: n for n in (LOGISTIC, TREES, "constant")}),
        "encoded_selection": run.logistic.selection_report(spark),
        "raw_selection": run.trees.selection_report(spark),
        "coefficients": run.logistic.coefficient_report(spark),
        "importance": run.trees.importance(spark),
        "model_summary": run.logistic.summary(spark),
    }


def scorecard(run: Holdout, scale: ScoreScale = ScoreScale()) -> dict[str, DataFrame]:
    require_score_identities(run.valid, run.logistic, scale)
    scores = score_frame(run.valid, run.logistic, scale)
    return {
        "bin_points": bin_points(run.valid.sparkSession, run.logistic, scale),
        "unknown_bins": scorecard_unknown_report(run.valid, run.logistic),
        "score_distribution": calibration.describe(scores, "score_raw"),
        "diagnostics": input_diagnostics(run.valid, run.logistic),
    }


def discrimination(run: Holdout, n_bootstrap: int = 2000, seed: int = 42) -> bootstrap.BootstrapResult:
    return bootstrap.paired_bootstrap(run.valid, TARGET, LOGISTIC, TREES, n_bootstrap, seed=seed)


def diagnostics(run: Holdout) -> dict[str, DataFrame]:
    """Calibration per model plus drift of features and predictions, train to valid."""
    inputs = drift.fit_reference(run.train, FEATURES)
    outputs = drift.fit_reference(run.train, [LOGISTIC, TREES])
    names = (LOGISTIC, TREES)
    return {
        "calibration_bins": _stack({n: calibration.calibration_bins(run.valid, TARGET, n) for n in names}),
        "calibration_summary": _stack({n: calibration.calibration_summary(run.valid, TARGET, n) for n in names}),
        "feature_drift": drift.psi_summary(run.valid, inputs),
        "feature_drift_bins": drift.psi_bins(run.valid, inputs),
        "prediction_drift": drift.psi_summary(run.valid, outputs),
    }


def explanations(run: Holdout, top_k: int = 3) -> dict[str, DataFrame]:
    """Group contributions, top reasons and review counts over all valid rows."""
    summaries, reasons, reviews = {}, {}, {}
    for name, model in run.models.items():
        terms = scoring.contributions(run.valid, model)
        groups = list(explain.group_members(model.selected))
        grouped = explain.group_contributions(terms, model.selected)
        quality = explain.explanation_diagnostics(run.valid, scoring.unknown_selected(model))
        summaries[name] = explain.contribution_summary(grouped, groups)
        flagged = grouped.join(quality.select(ID, "data_review_required"), ID)
        reasons[name] = explain.top_reasons(flagged, groups, top_k, review="data_review_required")
        reviews[name] = explain.review_counts(quality)
    return {"contributions": _stack(summaries), "reasons": _stack(reasons), "review_counts": _stack(reviews)}


def simulate_policies(
    run: Holdout,
    thresholds=tuple(i * 0.01 for i in range(31)),
    assumptions: policy.UtilityAssumptions = policy.UtilityAssumptions(),
    requirements: policy.PolicyRequirements = policy.PolicyRequirements(),
    losses=(500.0, 1000.0, 2000.0),
) -> tuple[dict[str, DataFrame], dict[str, policy.ApprovalRule | None]]:
    """Curves, selected rules and their frozen-rule cost sensitivity."""
    curves = {n: policy.policy_curve(run.valid, TARGET, n, thresholds, assumptions) for n in run.models}
    rules: dict[str, policy.ApprovalRule | None] = {}
    for name, curve in curves.items():
        try:
            rules[name] = policy.select_policy(curve, requirements)[0]
        except policy.NoFeasiblePolicyError:
            rules[name] = None
    tables = {"curves": _stack(curves)}
    chosen = {
        n: policy.cost_sensitivity(run.valid, TARGET, n, rule, losses, assumptions) for n, rule in rules.items() if rule
    }
    if chosen:
        tables["sensitivity"] = _stack(chosen)
    return tables, rules


def write_all(run: Holdout, folder: str, n_bootstrap: int = 2000) -> dict:
    """Every report as a table below ``folder`` plus one protocol document."""
    spark = run.valid.sparkSession
    policies, rules = simulate_policies(run)
    paired = discrimination(run, n_bootstrap)
    reports = {
        **comparison(run), **scorecard(run), **diagnostics(run), **explanations(run), **policies,
        "bootstrap_summary": paired.summary, "bootstrap_draws": paired.draws,
    }
    for name, df in reports.items():
        write_report(df, f"{folder}/{name}")
    protocol = {
        "bootstrap": paired.metadata,
        "rules": {n: None if r is None else asdict(r) for n, r in rules.items()},
        "reports": sorted(reports),
        "test_part_read": False,
    }
    write_protocol(spark, protocol, f"{folder}/protocol")
    return protocol
