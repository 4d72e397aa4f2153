"""Population stability on reference bins that current data can never move."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import guards
from ..functions.columns import MISSING
from ..session import kept
from .binning import BinSpec, FeatureBins, bin_counts, fit_bins


@dataclass(frozen=True)
class DriftReference:
    """Frozen edges plus reference counts for every defined bin."""

    spec: BinSpec
    counts: tuple[tuple[str, str, int], ...]
    size: int
    epsilon: float = 1e-6

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(self.counts), "feature string, bin string, reference_count long"
        )

    def known(self, feature: str) -> dict[str, int]:
        return {b: n for f, b, n in self.counts if f == feature}


def fit_reference(df: DataFrame, columns, n_bins: int = 5, epsilon: float = 1e-6) -> DriftReference:
    """Learn bins on the reference and count every bin, empty ones included."""
    if isinstance(epsilon, bool) or not 0 < epsilon < 1:
        raise ValueError("epsilon must lie strictly between 0 and 1")
    columns = list(columns)
    with kept(df if df.is_cached else df.select(*columns)) as rows:
        spec = fit_bins(rows, columns, n_bins)
        found = {(r["feature"], r["bin"]): r["n_samples"] for r in bin_counts(rows, spec).collect()}
    counts = tuple((f.feature, b, found.get((f.feature, b), 0)) for f in spec.features for b in f.labels)
    first = spec.features[0].feature
    size = sum(n for f, _, n in counts if f == first)
    return DriftReference(spec, counts, size, float(epsilon))


def _bin_columns(counts: DataFrame, n_reference, n_current, bins_per_feature, epsilon: float) -> DataFrame:
    k = bins_per_feature
    scale = 1 + k * epsilon
    r, c = F.col("reference_count") / n_reference, F.col("current_count") / n_current
    rs, cs = (r + epsilon) / scale, (c + epsilon) / scale
    return counts.select(
        "*",
        r.alias("reference_share"),
        c.alias("current_share"),
        rs.alias("reference_smoothed"),
        cs.alias("current_smoothed"),
        ((cs - rs) * (F.log(cs) - F.log(rs))).alias("psi_component"),
    )


def current_counts(df: DataFrame, reference: DriftReference) -> DataFrame:
    """Rows per (feature, bin) with the part outside the reference range, in one scan.

    The end bins are cut once more at the reference minimum and maximum; the pieces
    are counted apart and put back together afterwards.
    """
    guards.require_columns(df, reference.spec.names)
    cut, names = [], []
    for f in reference.spec.features:
        if f.all_missing:
            cut.append(f)
            names += [(f.feature, b, b, False, False) for b in f.labels]
            continue
        wider = FeatureBins(f.feature, (math.nextafter(f.low, -math.inf), *f.edges, f.high), False, None, None)
        cut.append(wider)
        inner = f.labels[:-1]
        pieces = [(inner[0], True, False), *[(b, False, False) for b in inner], (inner[-1], False, True), (MISSING, False, False)]
        names += [(f.feature, piece, b, lo, hi) for piece, (b, lo, hi) in zip(wider.labels, pieces)]
    table = df.sparkSession.createDataFrame(
        names, "feature string, piece string, bin string, below boolean, above boolean"
    )
    counted = bin_counts(df, BinSpec(reference.spec.n_bins, tuple(cut))).withColumnRenamed("bin", "piece")
    joined = table.join(counted, ["feature", "piece"], "left").withColumn("n", F.coalesce("n_samples", F.lit(0)))
    return joined.groupBy("feature", "bin").agg(
        F.sum("n").cast("long").alias("current_count"),
        F.sum(F.when(F.col("below"), F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("above"), F.col("n")).otherwise(0)).alias("above"),
    )


def _psi(df: DataFrame, reference: DriftReference) -> DataFrame:
    per_feature = {f.feature: len(f.labels) for f in reference.spec.features}
    dims = df.sparkSession.createDataFrame(
        [(f, b, n, per_feature[f]) for f, b, n in reference.counts],
        "feature string, bin string, reference_count long, k int",
    )
    # The window partition is one feature's defined bins.
    joined = dims.join(current_counts(df, reference), ["feature", "bin"]).withColumn(
        "n_current", F.sum("current_count").over(Window.partitionBy("feature"))
    )
    return _bin_columns(joined, F.lit(reference.size), F.col("n_current"), F.col("k"), reference.epsilon)


def psi_bins(df: DataFrame, reference: DriftReference) -> DataFrame:
    """Per (feature, bin): both counts, shares, smoothed shares, component.

    The bin table is the frozen one, so its size is fixed by the reference.
    """
    return _psi(df, reference).drop("k", "n_current", "below", "above")


def psi_reports(df: DataFrame, reference: DriftReference) -> tuple[DataFrame, DataFrame]:
    """Bin table and summary from one scan; the bin table's size is fixed by the reference."""
    full = _psi(df, reference)
    table = df.sparkSession.createDataFrame(full.collect(), full.schema)
    return table.drop("k", "n_current", "below", "above"), summarise(table, reference)


def psi_summary(df: DataFrame, reference: DriftReference) -> DataFrame:
    """Per feature: PSI, sizes, missing rates, new-bin share, out-of-range shares.

    Shares of all rows; a reference without values has no range (NULL).
    """
    return summarise(_psi(df, reference), reference)


def summarise(bins: DataFrame, reference: DriftReference) -> DataFrame:
    missing = F.col("bin") == MISSING
    no_range = F.col("feature").isin([f.feature for f in reference.spec.features if f.low is None])
    summary = bins.groupBy("feature").agg(
        F.sum("psi_component").alias("psi"),
        F.lit(reference.size).cast("long").alias("reference_size"),
        F.sum("current_count").alias("current_size"),
        F.max(F.when(missing, F.col("reference_share"))).alias("reference_missing_rate"),
        F.max(F.when(missing, F.col("current_share"))).alias("current_missing_rate"),
        (F.sum(F.when(F.col("reference_count") == 0, F.col("current_count")).otherwise(0)) / F.sum("current_count")).alias(
            "new_bin_share"
        ),
        F.max(F.when(~no_range, F.lit(0.0))).alias("zero"),
        (F.sum("below") / F.sum("current_count")).alias("below_min_share"),
        (F.sum("above") / F.sum("current_count")).alias("above_max_share"),
    )
    # ``zero`` is NULL for a feature without reference range.
    return summary.withColumn("below_min_share", F.col("below_min_share") + F.col("zero")).withColumn(
        "above_max_share", F.col("above_max_share") + F.col("zero")
    ).drop("zero")
