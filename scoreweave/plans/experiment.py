"""Training, calibration, scheme choice and the single final evaluation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import guards
from ..functions.columns import ID, TARGET
from ..models.logistic import fit_logistic
from ..models.platt import PlattModel, fit_platt
from ..models.trees import fit_trees
from ..operators import calibration, compare, ranking, split
from ..session import written
from ..sources import files, runs
from . import scoring

LOGISTIC, TREES = "logistic", "trees"
RAW, CALIBRATED = "raw", "calibrated"
MATERIAL_AUC_GAP = 0.005


@dataclass(frozen=True)
class Scheme:
    """The frozen choice: model, probability version, threshold and why."""

    model: str
    version: str
    threshold: float
    auc_gap: float
    log_loss_gap: float
    material_advantage: bool


@dataclass(frozen=True)
class Experiment:
    models: dict
    calibrators: dict[str, PlattModel]
    comparison: tuple[dict, ...]
    scheme: Scheme


def restrict(table: DataFrame, membership: DataFrame, partition: str, id_col: str = ID) -> DataFrame:
    """Rows whose id belongs to one part."""
    ids = membership.filter(F.col("partition") == partition).select(id_col)
    return table.join(ids, id_col, "left_semi")


def choose_scheme(comparison: DataFrame) -> DataFrame:
    """Model by best AUC, then its probability version by lowest log loss.

    The report has one row per (model, version), so the choice is a tiny aggregate.
    """
    per_model = comparison.groupBy("model").agg(
        F.max("auc").alias("auc"),
        F.min_by("version", F.struct("log_loss", "version")).alias("version"),
        (F.max("log_loss") - F.min("log_loss")).alias("log_loss_gap"),
    )
    ranked = F.struct(F.col("auc"), F.col("model"))
    return per_model.agg(
        F.max_by("model", ranked).alias("model"),
        F.max_by("version", ranked).alias("version"),
        F.max_by("log_loss_gap", ranked).alias("log_loss_gap"),
        (F.max("auc") - F.min("auc")).alias("auc_gap"),
    )


def compare_versions(selection: DataFrame, columns: dict[tuple[str, str], str], y: str = TARGET) -> DataFrame:
    """AUC, AP, log loss and Brier for every (model, probability version)."""
    rows = [
        ranking.probability_report(selection, y, column).select(
            F.lit(model).alias("model"), F.lit(version).alias("version"), "auc", "average_precision", "log_loss", "brier"
        )
        for (model, version), column in columns.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


def run_experiment(
    table: DataFrame,
    membership: DataFrame,
    capacity: float = 0.10,
    selection_share: float = 0.5,
    seed: int = 42,
    tree_options: dict | None = None,
) -> Experiment:
    """Fit on train, calibrate on one half of valid, choose on the other half."""
    if not compare.same_id_set(table, membership):
        raise guards.GateError("the table and the membership list hold different ids")
    train = restrict(table, membership, "train")
    valid = split.stratified_halves(restrict(table, membership, "valid"), selection_share, seed)
    models = {LOGISTIC: fit_logistic(train), TREES: fit_trees(train, **(tree_options or {}))}

    scored = valid.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        frames = {}
        keep = (ID, TARGET, "inner_partition")
        for name, model in models.items():
            frames[name] = scoring.raw_probability(scored, model, keep).persist(StorageLevel.MEMORY_AND_DISK)
        calibrators, rows = {}, []
        for name, frame in frames.items():
            calibrators[name] = fit_platt(frame.filter(F.col("inner_partition") == "calibration"), TARGET, "p")
            selection = frame.filter(F.col("inner_partition") == "selection").withColumn(
                "q", calibrators[name].apply("p")
            )
            rows.append(compare_versions(selection, {(name, RAW): "p", (name, CALIBRATED): "q"}))
        comparison = reduce(lambda a, b: a.unionByName(b), rows)
        records = tuple(r.asDict() for r in comparison.collect())
        chosen = choose_scheme(table.sparkSession.createDataFrame([tuple(r.values()) for r in records], comparison.schema)).first()
        best = frames[chosen["model"]].filter(F.col("inner_partition") == "selection")
        if chosen["version"] == CALIBRATED:
            best = best.withColumn("p", calibrators[chosen["model"]].apply("p"))
        threshold = ranking.capacity_threshold(best, "p", capacity).first()["threshold"]
    finally:
        scored.unpersist()
        for frame in frames.values():
            frame.unpersist()
    scheme = Scheme(
        chosen["model"], chosen["version"], threshold, chosen["auc_gap"], chosen["log_loss_gap"],
        chosen["auc_gap"] > MATERIAL_AUC_GAP,
    )
    return Experiment(models, calibrators, records, scheme)


def final_evaluation(
    table: DataFrame,
    membership: DataFrame,
    experiment: Experiment,
    digests: DataFrame | None = None,
    manifest: DataFrame | None = None,
    openings: str | None = None,
) -> dict[str, DataFrame]:
    """Apply the frozen chain to the test part: capability, strategy, reliability, rows.

    With a ``manifest`` (``name``, ``digest``) the found ``digests`` must match it before any row is
    scored; with ``openings`` (a path) the opening of the test part is logged.
    """
    if manifest is not None:
        files.require_frozen(digests, manifest)
    overlap = membership.groupBy(ID).agg(F.count_distinct("partition").alias("n")).filter(F.col("n") > 1)
    if not overlap.isEmpty():
        raise guards.GateError("the test part overlaps another part")
    test = restrict(table, membership, "test")
    s = experiment.scheme
    scored = scoring.raw_probability(test, experiment.models[s.model], (ID, TARGET))
    if s.version == CALIBRATED:
        scored = scored.withColumn("p", experiment.calibrators[s.model].apply("p"))
    scored = written(scored, "test-scores")
    if openings is not None:
        mark = F.sum(F.xxhash64(ID, "p").cast("decimal(38,0)"))
        row = scored.agg(F.count("*").alias("n"), mark.alias("mark")).first()
        frozen = manifest.agg(F.array_join(F.array_sort(F.collect_list("digest")), ",").alias("d")).first()["d"] if manifest is not None else ""
        runs.append_opening(table.sparkSession, openings, sha256(frozen.encode()).hexdigest(), row["n"], str(row["mark"]))
    capability = ranking.probability_report(scored, TARGET, "p").select(F.lit(s.model).alias("model"), "*")
    if s.model != LOGISTIC:
        base = scoring.raw_probability(test, experiment.models[LOGISTIC], (ID, TARGET))
        capability = capability.unionByName(
            ranking.probability_report(base, TARGET, "p").select(F.lit(LOGISTIC).alias("model"), "*")
        )
    return {
        "capability": capability,
        "strategy": ranking.flag_quality(scored, TARGET, F.col("p") >= F.lit(s.threshold)),
        "reliability": calibration.reliability_table(scored, TARGET, "p"),
        "predictions": ranking.evaluation_rows(scored, ID, TARGET, "p", s.threshold),
    }
