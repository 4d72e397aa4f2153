"""Named queries over the test tables, one per implemented operation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures
from ..functions.columns import ID, RAW_COLUMNS, TARGET
from ..functions.rules import FEATURES, business_features, row_diagnostics
from ..models import scorecard
from ..operators import (
    binning,
    bootstrap,
    calibration,
    compare,
    drift,
    explain,
    policy,
    ranking,
    split,
    wide,
    woe,
)
from ..session import apply_settings, shared_table_path, written
from ..sources import load
from ..sources.contract import APPLICATION, BUREAU
from . import frozen

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

PAIRED = ["target", "amt_income_total", "amt_credit", "days_birth", "ext_source_1", "name_contract_type"]
AMOUNTS = ["amt_credit_sum", "amt_credit_sum_debt"]
GRID = [i * 0.01 for i in range(31)]
# The credit-record contract with a key wide enough for numbers that Spark assigns.
WIDE_KEY_BUREAU = BUREAU.retyped(sk_id_bureau=T.LongType())


def query(run: Query) -> Query:
    def prepared(spark: SparkSession, sf: str) -> DataFrame:
        apply_settings(spark)
        return run(spark, sf)

    REGISTRY[run.__name__] = prepared
    return run


def r6(*names: str) -> list[Column]:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: the order of a parallel sum is not fixed."""
    return df.select(
        *[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields]
    )


# --- shared inputs -------------------------------------------------------------------


def model_table(spark: SparkSession, sf: str) -> DataFrame:
    return wide.model_table(fixtures.application(spark, sf), fixtures.bureau(spark, sf))


def features(spark: SparkSession, sf: str, keep=(ID, TARGET)) -> DataFrame:
    return business_features(model_table(spark, sf), keep)


def parted_table(spark: SparkSession, sf: str) -> DataFrame:
    """Modelling table plus partition; the split reads id and label only."""
    parted = split.stratified_split(fixtures.application(spark, sf))
    return wide.wide_table(parted, wide.aggregate_children(fixtures.bureau(spark, sf)))


def split_features(spark: SparkSession, sf: str) -> DataFrame:
    return business_features(parted_table(spark, sf), (ID, TARGET, "partition"))


def part(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("partition") == name).drop("partition")


def train_fit(spark: SparkSession, sf: str):
    """Features of every row, features of the training part, edges."""
    table = parted_table(spark, sf)
    train = written(business_features(part(table, "train"), (ID, TARGET)), "train-features")
    spec = binning.fit_bins(train, FEATURES)
    return business_features(table, (ID, TARGET, "partition")), train, spec


# --- load, reconciliation, profile ---------------------------------------------------


@query
def agg_left_join_wide(spark, sf):
    return rounded(model_table(spark, sf))


@query
def loaded_model_table(spark, sf):
    """Both sources as text files, loaded through contract, staging, checks and publication.

    Child keys are numbered through all records, because the contract wants them unique.
    """
    folder = shared_table_path(spark, "source-text")
    parents = fixtures.application(spark, sf).withColumns(
        {"code_gender": F.lit("F"), **{c: F.col(c).cast("int") for c in ("days_birth", "days_employed")}}
    )
    children = fixtures.bureau(spark, sf).withColumn("sk_id_bureau", F.monotonically_increasing_id())
    for contract, df in ((APPLICATION, parents), (WIDE_KEY_BUREAU, children)):
        df.select(*contract.names).write.option("header", True).csv(f"{folder}/{contract.file_name}")
    house = load.Warehouse(f"{folder}/house")
    load.load_tables(spark, folder, house, "query", (APPLICATION, WIDE_KEY_BUREAU))
    stored = load.read_table(spark, house, "model_input", "query").drop("code_gender")
    doubles = {f.name: F.col(f.name).cast("double") for f in stored.schema.fields if f.dataType.typeName() == "decimal"}
    days = {c: F.col(c).cast("double") for c in ("days_birth", "days_employed")}
    return rounded(stored.withColumns({**doubles, **days}).select(*model_table(spark, sf).columns))


@query
def child_aggregate(spark, sf):
    return rounded(wide.aggregate_children(fixtures.bureau(spark, sf)))


@query
def reconcile_key_mismatch(spark, sf):
    return compare.key_mismatch(
        fixtures.application(spark, sf), wide.aggregate_children(fixtures.bureau(spark, sf))
    )


@query
def reconcile_field_mismatch(spark, sf):
    # Compare against a copy whose credit amount was made absolute: known differences.
    changed = model_table(spark, sf).withColumn("amt_credit", F.abs("amt_credit"))
    return compare.field_mismatch_rows(fixtures.application(spark, sf), changed, PAIRED)


@query
def linkage_counts(spark, sf):
    return compare.linkage(fixtures.application(spark, sf), fixtures.bureau(spark, sf))


@query
def reconciliation_report(spark, sf):
    application, bureau = fixtures.application(spark, sf), fixtures.bureau(spark, sf)
    aggregate = wide.aggregate_children(bureau)
    return compare.reconciliation(application, bureau, aggregate, wide.wide_table(application, aggregate), PAIRED)


@query
def missing_counts(spark, sf):
    a = compare.missing_counts(fixtures.application(spark, sf), list(RAW_COLUMNS[:8]), "application")
    b = compare.missing_counts(
        fixtures.bureau(spark, sf), ["credit_active", "days_credit", *AMOUNTS, "credit_day_overdue"], "bureau"
    )
    return a.unionByName(b)


@query
def missingness_class(spark, sf):
    return wide.missingness_class(fixtures.bureau(spark, sf), fixtures.application(spark, sf), AMOUNTS)


@query
def duplicate_keys(spark, sf):
    return compare.duplicate_keys(fixtures.bureau(spark, sf), ["sk_id_bureau"])


@query
def control_totals(spark, sf):
    fields = ["days_employed", "days_birth", "amt_credit", "ext_source_1"]
    totals = compare.control_totals(fixtures.application(spark, sf), fields, {"days_employed": 365243.0})
    return totals.withColumn("total", F.round("total", 2))


@query
def control_totals_match(spark, sf):
    fields = ["days_employed", "amt_credit"]
    left = compare.control_totals(fixtures.application(spark, sf), fields, {"days_employed": 365243.0})
    right = compare.control_totals(
        model_table(spark, sf).withColumn("amt_credit", F.abs("amt_credit")), fields, {"days_employed": 365243.0}
    )
    return compare.compare_totals(left, right)


@query
def table_profile_missing_top10(spark, sf):
    from ..sources.profile import missing_rates

    return missing_rates(model_table(spark, sf), 10)


@query
def label_distribution(spark, sf):
    from ..sources.profile import label_distribution as distribution

    return rounded(distribution(fixtures.application(spark, sf)))


@query
def per_field_compare(spark, sf):
    changed = (
        fixtures.application(spark, sf)
        .filter(F.col(ID) % 10 != 3)
        .withColumn("amt_annuity", F.coalesce("amt_annuity", F.lit(0.0)))
    )
    return compare.per_field_compare(
        fixtures.application(spark, sf), changed, ["target", "amt_credit", "amt_annuity", "days_employed"]
    )


@query
def content_checksum(spark, sf):
    return compare.content_checksum(model_table(spark, sf))


@query
def content_fingerprint(spark, sf):
    df = fixtures.application(spark, sf)
    return compare.content_fingerprint(df, ID, df.columns, "application")


@query
def id_set_check(spark, sf):
    a, b = fixtures.application(spark, sf), fixtures.bureau(spark, sf).select(ID).distinct()
    only_left, only_right = compare.ids_only_in(a, b), compare.ids_only_in(b, a)
    return (
        only_left.select(F.lit("parents_only").alias("side"))
        .unionByName(only_right.select(F.lit("children_only").alias("side")))
        .groupBy("side")
        .agg(F.count("*").alias("n"))
    )


# --- rules ---------------------------------------------------------------------------


@query
def business_feature_table(spark, sf):
    return rounded(features(spark, sf, (ID,)))


@query
def row_quality(spark, sf):
    return row_diagnostics(features(spark, sf, (ID,)))


@query
def quality_counts(spark, sf):
    return explain.quality_counts(features(spark, sf, (ID,)))


# --- bins, WOE, selection ------------------------------------------------------------


@query
def bin_edges(spark, sf):
    _, train, spec = train_fit(spark, sf)
    return rounded(spec.edge_table(spark))


@query
def bin_labels(spark, sf):
    everything, train, spec = train_fit(spark, sf)
    return binning.apply_bins(everything.drop(TARGET, "partition"), spec)


@query
def bin_counts(spark, sf):
    _, train, spec = train_fit(spark, sf)
    return binning.bin_counts(train, spec, {"n_bad": F.col(TARGET)})


@query
def woe_table(spark, sf):
    _, train, spec = train_fit(spark, sf)
    return rounded(woe.woe_table(train, spec))


@query
def woe_table_labels(spark, sf):
    """The generic encoder: two text columns that were never numbers."""
    bins = fixtures.application(spark, sf).select(
        TARGET, "name_contract_type", F.concat(F.lit("d"), (F.col(ID) % 10).cast("string")).alias("last_digit")
    )
    counts = woe.label_counts(bins, ["name_contract_type", "last_digit"])
    return rounded(woe.woe_from_counts(counts, alpha=1.0, min_bin_samples=1500))


@query
def iv_report(spark, sf):
    _, train, spec = train_fit(spark, sf)
    return rounded(woe.iv_report(woe.woe_table(train, spec)))


@query
def candidate_features(spark, sf):
    _, train, spec = train_fit(spark, sf)
    return woe.iv_report(woe.woe_table(train, spec)).filter(F.col("iv") >= 0.02).select("feature", *r6("iv"))


@query
def woe_apply(spark, sf):
    everything, train, spec = train_fit(spark, sf)
    model = woe.fit_woe(train, spec)
    return rounded(woe.apply_woe(everything.drop("partition"), spec, model))


@query
def unknown_bins(spark, sf):
    return rounded(scorecard.scorecard_unknown_report(features(spark, sf, (ID,)), frozen.model()).drop("is_selected"))


@query
def encoded_selection_log(spark, sf):
    _, train, spec = train_fit(spark, sf)
    log = woe.select_encoded(train, spec, woe.fit_woe(train, spec))
    rows = [(r["feature"], round(r["iv"], 6), r["selection_reason"]) for r in log]
    return spark.createDataFrame(rows, "feature string, iv double, selection_reason string")


@query
def raw_selection_log(spark, sf):
    df = features(spark, sf).withColumn("amt_credit_copy", F.col("amt_credit"))
    rows = [tuple(r.values()) for r in woe.select_raw(df, [*FEATURES, "amt_credit_copy"])]
    return spark.createDataFrame(rows, "feature string, selection_reason string")


# --- split and samples ---------------------------------------------------------------


@query
def stratified_membership(spark, sf):
    return split.membership(split.stratified_split(fixtures.application(spark, sf).select(ID, TARGET)))


@query
def split_quality(spark, sf):
    return rounded(split.split_quality(split.stratified_split(fixtures.application(spark, sf).select(ID, TARGET))))


@query
def partition_check(spark, sf):
    source = fixtures.application(spark, sf).select(ID, TARGET)
    return split.partition_check(split.stratified_split(source), source)


@query
def validation_halves(spark, sf):
    parted = split.stratified_split(fixtures.application(spark, sf).select(ID, TARGET))
    return split.stratified_halves(part(parted, "valid"), 0.5, 42).select(ID, "inner_partition")


@query
def seeded_sample(spark, sf):
    return split.seeded_sample(fixtures.application(spark, sf), 200, 42).select(ID)


@query
def first_rows_per_partition(spark, sf):
    parted = split.stratified_split(fixtures.application(spark, sf).select(ID, TARGET))
    return split.first_per_group(parted, 50).select(ID, "partition")


# --- ranking, calibration, policy ----------------------------------------------------


@query
def ranking_metrics(spark, sf):
    return rounded(ranking.ranking_metrics(fixtures.scored(spark, sf), TARGET, "p_base"))


@query
def ranking_metrics_weighted(spark, sf):
    weighted = fixtures.scored(spark, sf).withColumn("w", (F.col(ID) % 5).cast("double"))
    return rounded(ranking.ranking_metrics(weighted, TARGET, "p_challenger", "w"))


@query
def probability_report(spark, sf):
    return rounded(ranking.probability_report(fixtures.scored(spark, sf), TARGET, "p_base"))


@query
def model_comparison(spark, sf):
    scored = ranking.constant_baseline(fixtures.scored(spark, sf), 0.12)
    return rounded(
        ranking.compare_models(
            scored, TARGET, {"base": "p_base", "challenger": "p_challenger", "constant": "p_constant"}
        )
    )


@query
def calibration_bins(spark, sf):
    return rounded(calibration.calibration_bins(fixtures.scored(spark, sf), TARGET, "p_base"))


@query
def calibration_summary(spark, sf):
    return rounded(calibration.calibration_summary(fixtures.scored(spark, sf), TARGET, "p_base"))


@query
def reliability_deciles(spark, sf):
    return rounded(calibration.reliability_table(fixtures.scored(spark, sf), TARGET, "p_challenger"))


@query
def score_describe(spark, sf):
    return rounded(calibration.describe(fixtures.scored(spark, sf), "p_base"))


@query
def capacity_threshold(spark, sf):
    return rounded(ranking.capacity_threshold(fixtures.scored(spark, sf), "p_base", 0.10))


@query
def flag_quality(spark, sf):
    scored = fixtures.scored(spark, sf)
    return rounded(ranking.flag_quality(scored, TARGET, F.col("p_base") >= 0.3))


@query
def evaluation_rows(spark, sf):
    return ranking.evaluation_rows(fixtures.scored(spark, sf), ID, TARGET, "p_challenger", 0.3)


@query
def policy_curve(spark, sf):
    return rounded(policy.policy_curve(fixtures.scored(spark, sf), TARGET, "p_base", GRID))


@query
def policy_select(spark, sf):
    curve = policy.policy_curve(fixtures.scored(spark, sf), TARGET, "p_base", GRID)
    return rounded(policy.best_policy(curve, policy.PolicyRequirements(0.05, 0.2, 100, False)))


@query
def fixed_rule_evaluation(spark, sf):
    rule = policy.ApprovalRule("threshold", 0.05)
    return rounded(policy.evaluate_fixed_rule(fixtures.scored(spark, sf), TARGET, "p_challenger", rule))


@query
def fixed_rule_sensitivity(spark, sf):
    rule = policy.ApprovalRule("threshold", 0.05)
    return rounded(
        policy.cost_sensitivity(fixtures.scored(spark, sf), TARGET, "p_base", rule, (500.0, 1000.0, 2000.0))
    )


@query
def rule_decisions(spark, sf):
    rule = policy.ApprovalRule("threshold", 0.08)
    return fixtures.scored(spark, sf).select(ID, rule.decide("p_base").alias("simulated_approval"))


@query
def bootstrap_intervals(spark, sf):
    """All 2,000 draws, by hashed slots."""
    return rounded(bootstrap.indexed_bootstrap(fixtures.scored(spark, sf), TARGET, "p_base", "p_challenger").summary)


@query
def bootstrap_intervals_split(spark, sf):
    """All 2,000 draws, split down the tree of row blocks; seeded generators have no SQL counterpart."""
    return bootstrap.paired_bootstrap(fixtures.scored(spark, sf), TARGET, "p_base", "p_challenger").summary


# --- drift ---------------------------------------------------------------------------


def _drift(spark, sf):
    """Reference: training part. Current: validation part with higher amounts."""
    everything = split_features(spark, sf)
    reference = drift.fit_reference(part(everything, "train"), FEATURES)
    return part(everything, "valid").withColumn("amt_credit", F.col("amt_credit") * 1.25), reference


@query
def psi_bins(spark, sf):
    current, reference = _drift(spark, sf)
    return rounded(drift.psi_bins(current, reference))


@query
def psi_summary(spark, sf):
    current, reference = _drift(spark, sf)
    return rounded(drift.psi_summary(current, reference))


@query
def prediction_drift(spark, sf):
    parted = split.stratified_split(fixtures.scored(spark, sf))
    reference = drift.fit_reference(part(parted, "train"), ["p_base", "p_challenger"])
    return rounded(drift.psi_summary(part(parted, "test"), reference))


# --- scoring and explanation with the frozen model -----------------------------------


@query
def score_scale(spark, sf):
    scale = scorecard.ScoreScale()
    p = F.col("p_base")
    return rounded(
        fixtures.scored(spark, sf)
        .select(ID, p, scale.from_probability(p).alias("score_raw"))
        .withColumn("p_back", scale.to_probability(F.col("score_raw")))
    )


@query
def score_frame(spark, sf):
    return rounded(scorecard.score_frame(features(spark, sf, (ID,)), frozen.model()))


@query
def score_contributions(spark, sf):
    return rounded(scorecard.contributions_long(features(spark, sf, (ID,)), frozen.model()))


@query
def input_diagnostics(spark, sf):
    return scorecard.input_diagnostics(features(spark, sf, (ID,)), frozen.model())


@query
def batch_prediction(spark, sf):
    raw = model_table(spark, sf).select(ID, *RAW_COLUMNS)
    return rounded(scorecard.predict_frame(raw, frozen.model(), rule=frozen.RULE))


@query
def score_identities(spark, sf):
    row = scorecard.score_identities(features(spark, sf, (ID,)), frozen.model())
    return row.select(
        "n_samples",
        (F.col("max_points_gap") <= 1e-9).alias("points_ok"),
        (F.col("max_inverse_gap") <= 1e-12).alias("inverse_ok"),
    )


@query
def bin_points(spark, sf):
    """Points per bin of a WOE table learned on the training part."""
    _, train, spec = train_fit(spark, sf)
    table = woe.woe_table(train, spec)
    scale = scorecard.ScoreScale()
    coefficient = 0.5
    return rounded(
        table.select(
            "feature", "bin", "woe", F.lit(coefficient).alias("coefficient"),
            (F.lit(-scale.factor * coefficient) * F.col("woe")).alias("points"),
        )
    )


def _grouped(spark, sf):
    model = frozen.model()
    terms = explain.linear_contributions(features(spark, sf, (ID,)), model)
    groups = list(explain.group_members(model.selected))
    return explain.group_contributions(terms, model.selected), groups


@query
def linear_contributions(spark, sf):
    return rounded(explain.linear_contributions(features(spark, sf, (ID,)), frozen.model()))


@query
def group_contributions(spark, sf):
    return rounded(_grouped(spark, sf)[0])


@query
def top_reasons(spark, sf):
    grouped, groups = _grouped(spark, sf)
    return rounded(explain.top_reasons(grouped, groups, 3))


@query
def contribution_summary(spark, sf):
    return rounded(explain.contribution_summary(*_grouped(spark, sf)))


@query
def review_counts(spark, sf):
    model = frozen.model()
    return explain.review_counts(
        explain.explanation_diagnostics(features(spark, sf, (ID,)), model.unknown_selected())
    )


# --- fitted models (learned coefficients: no SQL counterpart) ------------------------


@query
def logistic_fit(spark, sf):
    """Coefficients of the whole chain fitted on the training part."""
    from ..models.logistic import fit_logistic

    return fit_logistic(train_raw(spark, sf)).coefficient_report(spark)


@query
def logistic_summary(spark, sf):
    from ..models.logistic import fit_logistic

    return fit_logistic(train_raw(spark, sf)).summary(spark)


@query
def logistic_scores(spark, sf):
    """Fit on train, score every row."""
    from ..models.logistic import fit_logistic, score_raw

    return score_raw(model_table(spark, sf), fit_logistic(train_raw(spark, sf)))


def train_raw(spark, sf):
    return part(parted_table(spark, sf), "train")


@query
def gbt_fit(spark, sf):
    """Importance over the whole ensemble of 300 rounds."""
    from ..models.trees import fit_trees

    return fit_trees(train_raw(spark, sf)).importance(spark)


@query
def gbt_contributions(spark, sf):
    from ..models.trees import fit_trees, tree_contributions

    model = fit_trees(train_raw(spark, sf))
    return tree_contributions(features(spark, sf, (ID,)), model)


@query
def platt_fit(spark, sf):
    from ..models.platt import fit_platt

    scored = fixtures.scored(spark, sf)
    fitted = fit_platt(scored, TARGET, "p_base")
    return scored.select(ID, fitted.apply("p_base").alias("p_calibrated"))


@query
def scheme_selection(spark, sf):
    """Choice between two models and two probability versions, fixed calibration."""
    from ..models.platt import PlattModel
    from ..plans.experiment import choose_scheme, compare_versions

    fixed = PlattModel(1.25, 0.5)
    scored = fixtures.scored(spark, sf)
    scored = scored.withColumn("q_base", fixed.apply("p_base")).withColumn("q_challenger", fixed.apply("p_challenger"))
    versions = {
        (model, version): f"{prefix}_{model}"
        for model in ("base", "challenger")
        for version, prefix in (("raw", "p"), ("calibrated", "q"))
    }
    return rounded(choose_scheme(compare_versions(scored, versions)))


# --- contracts and monitoring --------------------------------------------------------


@query
def contract_violations(spark, sf):
    """Staging rules over a text form of the child table with known faults."""
    from ..sources.contract import BUREAU, staging_violations

    n = F.col("sk_id_bureau")
    text = fixtures.bureau(spark, sf).select(*[F.col(c).cast("string").alias(c) for c in BUREAU.names])
    key = n.cast("long")
    faulty = text.select(
        "sk_id_bureau",
        F.when(key % 1009 != 0, F.col("sk_id_curr")).alias("sk_id_curr"),
        F.when(key % 1013 == 0, F.repeat(F.lit("x"), 21)).otherwise(F.col("credit_active")).alias("credit_active"),
        F.when(key % 997 == 0, F.lit("soon")).otherwise(F.col("days_credit")).alias("days_credit"),
        "amt_credit_sum",
        F.when(key % 991 == 0, F.lit("n/a")).otherwise(F.col("amt_credit_sum_debt")).alias("amt_credit_sum_debt"),
        "credit_day_overdue",
    )
    return staging_violations(faulty, BUREAU)


@query
def partial_label_guard(spark, sf):
    """Labels cover only part of the documents: how many rows would refuse a batch."""
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    joined = documents.join(labels, "doc_id", "left")
    return joined.agg(
        F.count("*").alias("n_samples"),
        F.count_if(F.col("quality").isNull()).alias("without_label"),
        (F.count_if(F.col("quality").isNull()) > 0).alias("refused"),
    )


@query
def monitor_batch_totals(spark, sf):
    """One-scan totals of a batch scored with the frozen model."""
    from ..operators.drift import DriftReference
    from ..plans.monitoring import PROBABILITY, Monitor, batch_summary
    from ..functions.math import sigmoid

    model = frozen.model()
    monitor = Monitor(model, DriftReference(model.bins, (), 0), {}, frozen.RULE)
    view = features(spark, sf).withColumn(PROBABILITY, sigmoid(model.log_odds()))
    return rounded(batch_summary(view, monitor, TARGET))


@query
def monitor_summary(spark, sf):
    """A whole monitoring run: train part as reference, valid part as batch."""
    from ..plans.monitoring import build_monitor, evaluate_batch, summary_table

    versions = {"model": "m1", "reference": "r1", "policy": "p1", "monitor": "c1"}
    joined = parted_table(spark, sf)
    monitor = build_monitor(frozen.model(), part(joined, "train"), versions, frozen.RULE)
    report = evaluate_batch(monitor, part(joined, "valid"), TARGET, "observed")
    return rounded(summary_table(spark, report))
