"""Weight of evidence: ``ln(bad share / good share)`` per bin, information value.

Smoothing adds ``alpha`` per bin to both classes; K counts the bins observed in the
feature. Bins unseen in training are neutral (0) and always reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import guards
from ..functions.columns import TARGET
from .binning import BinSpec, bin_counts

WOE_SCHEMA = (
    "feature string, bin string, n_samples long, n_bad long, n_good long, bad_rate double, "
    "bad_share double, good_share double, woe double, iv_component double, "
    "small_bin boolean, single_class_bin boolean"
)


def bin_label(value: Column | str) -> Column:
    """Bin names must be present and not blank."""
    x = F.col(value) if isinstance(value, str) else value
    return F.when(F.trim(x) != "", x).otherwise(F.raise_error(F.lit("bin names must not be missing or blank")))


def label_counts(bins: DataFrame, features, target: str = TARGET) -> DataFrame:
    """(feature, bin) counts from string bin columns."""
    features = list(features)
    guards.forbid_columns(features)
    for f in features:
        if bins.schema[f].dataType.simpleString() != "string":
            raise guards.GateError(f"column {f} is not binned")
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), bin_label(f).alias("bin")) for f in features])
    return (
        bins.select(guards.binary_label(target).alias("y"), F.explode(entries).alias("e"))
        .groupBy(F.col("e.feature").alias("feature"), F.col("e.bin").alias("bin"))
        .agg(F.count("*").alias("n_samples"), F.sum("y").alias("n_bad"))
    )


def woe_from_counts(counts: DataFrame, alpha: float = 0.5, min_bin_samples: int = 20) -> DataFrame:
    """Full WOE table from (feature, bin, n_samples, n_bad).

    The window partition is one feature's bins, a set whose size the binner fixes.
    """
    if isinstance(alpha, bool) or not 0 < alpha < float("inf"):
        raise ValueError("alpha must be finite and positive")
    if isinstance(min_bin_samples, bool) or min_bin_samples < 1:
        raise ValueError("min_bin_samples must be a positive whole number")
    per_feature = Window.partitionBy("feature")
    smooth = F.lit(float(alpha)) * F.count("*").over(per_feature)
    bad_total = F.sum("n_bad").over(per_feature)
    good_total = F.sum(F.col("n_samples") - F.col("n_bad")).over(per_feature)
    both = F.when((bad_total > 0) & (good_total > 0), F.lit(True)).otherwise(
        F.raise_error(F.lit("training labels must hold both classes")).cast("boolean")
    )
    shares = counts.select(
        "feature",
        "bin",
        F.col("n_samples").cast("long").alias("n_samples"),
        F.col("n_bad").cast("long").alias("n_bad"),
        (F.col("n_samples") - F.col("n_bad")).cast("long").alias("n_good"),
        F.when(both, (F.col("n_bad") + alpha) / (bad_total + smooth)).alias("bad_share"),
        ((F.col("n_samples") - F.col("n_bad") + alpha) / (good_total + smooth)).alias("good_share"),
    )
    woe = F.log("bad_share") - F.log("good_share")
    return shares.select(
        "feature",
        "bin",
        "n_samples",
        "n_bad",
        "n_good",
        (F.col("n_bad") / F.col("n_samples")).alias("bad_rate"),
        "bad_share",
        "good_share",
        woe.alias("woe"),
        ((F.col("bad_share") - F.col("good_share")) * woe).alias("iv_component"),
        (F.col("n_samples") < min_bin_samples).alias("small_bin"),
        ((F.col("n_bad") == 0) | (F.col("n_good") == 0)).alias("single_class_bin"),
    )


def woe_table(
    df: DataFrame, spec: BinSpec, target: str = TARGET, alpha: float = 0.5, min_bin_samples: int = 20
) -> DataFrame:
    """WOE table straight from numeric features and frozen edges."""
    counts = bin_counts(df, spec, {"n_bad": guards.binary_label(target)})
    return woe_from_counts(counts, alpha, min_bin_samples)


def iv_report(table: DataFrame) -> DataFrame:
    iv = F.sum("iv_component")
    return table.groupBy("feature").agg(
        iv.alias("iv"),
        F.count("*").alias("n_bins"),
        F.count_if("small_bin").alias("small_bins"),
        F.count_if("single_class_bin").alias("single_class_bins"),
        (iv >= 0.5).alias("review_high_iv"),
    )


@dataclass(frozen=True)
class WoeModel:
    """Frozen WOE table; ``rows`` follow :data:`WOE_SCHEMA`."""

    alpha: float
    features: tuple[str, ...]
    rows: tuple[dict, ...]

    @staticmethod
    def from_table(table: DataFrame, features, alpha: float = 0.5) -> WoeModel:
        # One row per (feature, bin): bounded by the binner, not by the data.
        rows = sorted((r.asDict() for r in table.collect()), key=lambda r: (r["feature"], r["bin"]))
        return WoeModel(alpha, tuple(features), tuple(rows))

    def table(self, spark: SparkSession) -> DataFrame:
        names = [part.split()[0] for part in WOE_SCHEMA.split(", ")]
        return spark.createDataFrame([[r[n] for n in names] for r in self.rows], WOE_SCHEMA)

    def mapping(self, feature: str) -> dict[str, float]:
        return {r["bin"]: r["woe"] for r in self.rows if r["feature"] == feature}

    def iv(self) -> dict[str, float]:
        """Information value per feature, highest first, ties in column order."""
        total = {f: sum(r["iv_component"] for r in self.rows if r["feature"] == f) for f in self.features}
        return dict(sorted(total.items(), key=lambda item: -item[1]))

    def candidates(self, iv_threshold: float = 0.02) -> list[str]:
        if iv_threshold < 0:
            raise ValueError("the IV threshold must not be negative")
        chosen = [f for f, v in self.iv().items() if v >= iv_threshold]
        if not chosen:
            raise ValueError("no feature reaches the IV threshold")
        return chosen


def fit_woe(df: DataFrame, spec: BinSpec, target: str = TARGET, alpha: float = 0.5, min_bin_samples: int = 20) -> WoeModel:
    return WoeModel.from_table(woe_table(df, spec, target, alpha, min_bin_samples), spec.names, alpha)


def woe_sql(spec: BinSpec, model: WoeModel, feature: str) -> str:
    """Encoded value of a numeric feature; an unseen bin is neutral."""
    return spec[feature].lookup_sql(model.mapping(feature), 0.0)


def unknown_sql(spec: BinSpec, model: WoeModel, feature: str) -> str:
    """1 where the row's bin was never seen in training, else 0."""
    known = model.mapping(feature)
    return spec[feature].lookup_sql({label: int(label not in known) for label in spec[feature].labels}, 1)


def apply_woe(df: DataFrame, spec: BinSpec, model: WoeModel, features=None, keep=("sk_id_curr",)) -> DataFrame:
    names = list(features or model.features)
    return df.selectExpr(*keep, *[f"{woe_sql(spec, model, f)} AS {f}" for f in names])


def apply_woe_labels(bins: DataFrame, model: WoeModel, keep=("sk_id_curr",), unknown_policy: str = "neutral") -> DataFrame:
    """Encode string bins; unknown bins become 0 or stop the job."""
    if unknown_policy not in ("neutral", "error"):
        raise ValueError("unknown_policy must be 'neutral' or 'error'")
    guards.require_same_columns([c for c in bins.columns if c not in keep], model.features)

    def encode(feature: str) -> Column:
        pairs = [F.lit(x) for item in model.mapping(feature).items() for x in item]
        woe = F.try_element_at(F.create_map(*pairs), bin_label(feature))
        if unknown_policy == "neutral":
            return F.coalesce(woe, F.lit(0.0))
        return F.coalesce(woe, F.raise_error(F.lit(f"column {feature} holds an unknown bin")).cast("double"))

    return bins.select(*keep, *[encode(f).alias(f) for f in model.features])


def unknown_report(df: DataFrame, spec: BinSpec, model: WoeModel, selected=()) -> DataFrame:
    """Unknown-bin count and rate per feature in one scan."""
    names = list(model.features)
    row = df.selectExpr("count(*) AS n_samples", *[f"sum({unknown_sql(spec, model, f)}) AS {f}" for f in names])
    entries = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col("n_samples"),
            F.col(f).alias("unknown_count"),
            F.try_divide(F.col(f).cast("double"), F.col("n_samples")).alias("unknown_rate"),
            F.lit(f in set(selected)).alias("is_selected"),
        )
        for f in names
    ]
    return row.select(F.inline(F.array(*entries)))


def unknown_report_labels(bins: DataFrame, model: WoeModel) -> DataFrame:
    """Same report for string bins."""
    row = bins.agg(
        F.count("*").alias("n_samples"),
        *[F.count_if(~bin_label(f).isin(list(model.mapping(f)))).alias(f) for f in model.features],
    )
    entries = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col("n_samples"),
            F.col(f).alias("unknown_count"),
            F.try_divide(F.col(f).cast("double"), F.col("n_samples")).alias("unknown_rate"),
        )
        for f in model.features
    ]
    return row.select(F.inline(F.array(*entries)))


def equal_pairs(df: DataFrame, columns: dict[str, Column], pairs: list[tuple[str, str]]) -> set[tuple[str, str]]:
    """Pairs of expressions that agree on every row (NULLs equal), one scan."""
    if not pairs:
        return set()
    row = df.agg(
        *[
            F.count_if(~columns[a].eqNullSafe(columns[b])).alias(f"p{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    ).first()
    return {pair for i, pair in enumerate(pairs) if row[f"p{i}"] == 0}


def keep_first(names, duplicates: set[tuple[str, str]]) -> dict[str, str]:
    """Outcome per name: ``keep`` or ``drop_duplicate_of:<kept>`` (first one wins)."""
    kept: list[str] = []
    outcome = {}
    for name in names:
        twin = next((k for k in kept if (k, name) in duplicates or (name, k) in duplicates), None)
        outcome[name] = "keep" if twin is None else f"drop_duplicate_of:{twin}"
        if twin is None:
            kept.append(name)
    return outcome


def select_encoded(df: DataFrame, spec: BinSpec, model: WoeModel, iv_threshold: float = 0.02) -> list[dict]:
    """Selection log in IV order: constant, low IV, exact duplicate of a kept one, keep.

    Two encoded columns can only be equal when each WOE value covers the same number
    of training rows in both, which the frozen table already tells; only pairs that
    pass are compared on the data.
    """
    profile = {}
    for f in model.features:
        spread: dict[float, int] = {}
        for r in model.rows:
            if r["feature"] == f:
                spread[r["woe"]] = spread.get(r["woe"], 0) + r["n_samples"]
        profile[f] = spread
    iv = model.iv()
    eligible = [f for f in iv if len(profile[f]) > 1 and iv[f] >= iv_threshold]
    pairs = [
        (a, b) for i, a in enumerate(eligible) for b in eligible[i + 1:] if profile[a] == profile[b]
    ]
    encoded = {f: F.expr(woe_sql(spec, model, f)) for f in {x for p in pairs for x in p}}
    outcome = keep_first(eligible, equal_pairs(df, encoded, pairs))
    log = []
    for f, value in iv.items():
        if len(profile[f]) <= 1:
            reason = "drop_constant"
        elif value < iv_threshold:
            reason = "drop_low_iv"
        else:
            reason = outcome[f]
        log.append({"feature": f, "iv": value, "selection_reason": reason})
    return log


def select_raw(df: DataFrame, features, id_col: str = "sk_id_curr") -> list[dict]:
    """Selection log in column order for raw features (NULL counts as a value)."""
    features = list(features)
    value = {f: F.expr(f"CAST({f} AS DOUBLE) + 0D") for f in features}
    aggregates = []
    for f in features:
        x = f"CAST({f} AS DOUBLE) + 0D"
        aggregates += [
            f"count({f}) AS {f}__n", f"min({x}) AS {f}__lo", f"max({x}) AS {f}__hi",
            f"bit_xor(xxhash64({id_col}, {x})) AS {f}__x",
        ]
    row = df.selectExpr("count(*) AS rows", *aggregates).first()
    mark = {f: tuple(row[f"{f}__{k}"] for k in ("n", "lo", "hi", "x")) for f in features}
    constant = {
        f for f in features
        if mark[f][0] == 0 or (mark[f][0] == row["rows"] and mark[f][1] == mark[f][2])
    }
    rest = [f for f in features if f not in constant]
    pairs = [(a, b) for i, a in enumerate(rest) for b in rest[i + 1:] if mark[a] == mark[b]]
    outcome = keep_first(rest, equal_pairs(df, value, pairs))
    return [
        {"feature": f, "selection_reason": "drop_constant" if f in constant else outcome[f]}
        for f in features
    ]
