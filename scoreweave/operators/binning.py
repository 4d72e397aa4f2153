"""Quantile bins learned on training rows only and applied as literals.

Intervals are right-closed: the position is the number of edges below the value.
Missing values keep their own bin. The fitted state is a small frozen object whose
size depends on the number of columns, never on the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guards
from ..functions.columns import MISSING, OUTSIDE, numeric_bin_name
from ..functions.math import balanced_case, sql_literal
from .quantiles import ranks_of, select_values


@dataclass(frozen=True)
class FeatureBins:
    feature: str
    edges: tuple[float, ...]
    all_missing: bool
    low: float | None
    high: float | None

    @property
    def labels(self) -> tuple[str, ...]:
        if self.all_missing:
            return (OUTSIDE, MISSING)
        return (*(numeric_bin_name(i) for i in range(len(self.edges) + 1)), MISSING)

    @property
    def number(self) -> str:
        return f"CAST({self.feature} AS DOUBLE)"

    def lookup_sql(self, values: dict[str, object], default) -> str:
        """Value of the row's bin, straight from the number (no label in between)."""
        leaves = [values.get(label, default) for label in self.labels[:-1]]
        missing = sql_literal(values.get(MISSING, default))
        return f"CASE WHEN {self.feature} IS NULL THEN {missing} ELSE {balanced_case(self.number, self.edges, leaves)} END"

    def position_sql(self, start: int = 0) -> str:
        """Index into ``labels``, counted from ``start``."""
        return self.lookup_sql({label: start + i for i, label in enumerate(self.labels)}, None)

    def lookup(self, values: dict[str, object], default) -> Column:
        return F.expr(self.lookup_sql(values, default))

    def label_sql(self) -> str:
        return self.lookup_sql({name: name for name in self.labels}, None)


@dataclass(frozen=True)
class BinSpec:
    n_bins: int
    features: tuple[FeatureBins, ...]

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(f.feature for f in self.features)

    def __getitem__(self, name: str) -> FeatureBins:
        return next(f for f in self.features if f.feature == name)

    def subset(self, names) -> BinSpec:
        return BinSpec(self.n_bins, tuple(self[n] for n in names))

    def edge_table(self, spark: SparkSession) -> DataFrame:
        """One row per feature and edge."""
        rows = [(f.feature, i, e) for f in self.features for i, e in enumerate(f.edges)]
        return spark.createDataFrame(rows, "feature string, position int, edge double")

    def range_table(self, spark: SparkSession) -> DataFrame:
        rows = [(f.feature, list(f.edges), f.all_missing, f.low, f.high) for f in self.features]
        return spark.createDataFrame(
            rows, "feature string, edges array<double>, all_missing boolean, low double, high double"
        )

    @staticmethod
    def from_table(df: DataFrame, n_bins: int) -> BinSpec:
        """Rebuild from :meth:`range_table` (one row per feature)."""
        rows = df.collect()
        return BinSpec(
            n_bins,
            tuple(
                FeatureBins(r["feature"], tuple(r["edges"]), r["all_missing"], r["low"], r["high"])
                for r in rows
            ),
        )


def few_values(df: DataFrame, columns, limit: int) -> dict[str, list[float] | None]:
    """Exact different values per column, or None where there are more than ``limit``."""
    return {c: s.distinct for c, s in select_values(df, columns, lambda n: (), limit).items()}


def fit_bins(df: DataFrame, columns, n_bins: int = 5) -> BinSpec:
    """Learn edges: distinct values when there are few, else exact quantiles.

    One selection finds counts, ends, few-valued columns and quantiles of all columns in six passes.
    """
    columns = list(columns)
    if isinstance(n_bins, bool) or not isinstance(n_bins, int) or n_bins < 2:
        raise ValueError("n_bins must be a whole number >= 2")
    guards.forbid_columns(columns)
    if not columns or df.isEmpty():
        raise ValueError("bins need at least one row and one column")
    # Same points as an even grid over [0, 1], computed as step * index.
    points = [i * (1.0 / n_bins) for i in range(1, n_bins)]
    fitted = []
    for c, found in select_values(df, columns, ranks_of(points), n_bins).items():
        if not found.n:
            fitted.append(FeatureBins(c, (), True, None, None))
            continue
        low, high = found.at[0], found.at[found.n - 1]
        cuts = [q for q in sorted(set(found.quantiles(points))) if low < q < high] if found.distinct is None else found.distinct[:-1]
        fitted.append(FeatureBins(c, tuple(cuts), False, low, high))
    return BinSpec(n_bins, tuple(fitted))


def apply_bins(df: DataFrame, spec: BinSpec, keep: tuple[str, ...] = ("sk_id_curr",)) -> DataFrame:
    """Label columns from frozen edges: one projection, no shuffle."""
    guards.require_same_columns([c for c in df.columns if c not in keep], spec.names)
    return df.selectExpr(*keep, *[f"{f.label_sql()} AS {f.feature}" for f in spec.features])


def bin_counts(df: DataFrame, spec: BinSpec, measures: dict[str, Column] | None = None) -> DataFrame:
    """Rows and summed measures per (feature, bin), only for bins that occur.

    The bins of a row are integer codes, spaced by the feature with the most labels. A task adds up all its
    rows in one vector of counts and one per measure (null measures count as zero), so no row is repeated per
    feature and the shuffle carries (features x bins) rows per task whatever the data size.
    """
    measures = measures or {}
    step = max(len(f.labels) for f in spec.features)
    size, width = step * len(spec.features), len(spec.features)
    codes = F.expr(f"array({', '.join(f.position_sql(i * step) for i, f in enumerate(spec.features))})")
    named = {f"m{i}": name for i, name in enumerate(measures)}
    rows = df.select(codes.cast("array<int>").alias("codes"), *[measures[name].alias(short) for short, name in named.items()])
    whole = [t in ("tinyint", "smallint", "int", "bigint") for _, t in rows.dtypes[1:]]
    rows = rows.select("codes", *[F.col(short).cast("long" if w else "double") for short, w in zip(named, whole, strict=True)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        sums = [np.zeros(size, np.int64 if w else np.float64) for w in whole]
        for batch in batches:
            flat = batch.column(0).flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            known = flat >= 0
            n += np.bincount(flat[known], minlength=size)
            for total, column in zip(sums, batch.columns[1:], strict=True):
                value = np.repeat(column.fill_null(0).to_numpy(zero_copy_only=False), width)[known]
                np.add.at(total, flat[known], value)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x[seen]) for x in (np.arange(size), n, *sums)], names=["code", "n", *named])

    kinds = ["code long", "n long", *[f"{short} {'long' if w else 'double'}" for short, w in zip(named, whole, strict=True)]]
    grouped = rows.mapInArrow(count, ", ".join(kinds)).groupBy("code").agg(
        F.sum("n").alias("n_samples"), *[F.sum(short).alias(name) for short, name in named.items()]
    )
    names = F.expr(f"array({', '.join(sql_literal(f.feature) for f in spec.features)})")
    labels = F.expr(
        f"array({', '.join('array(' + ', '.join(map(sql_literal, f.labels)) + ')' for f in spec.features)})"
    )
    which = F.floor(F.col("code") / step).cast("int")
    return grouped.select(
        F.element_at(names, which + 1).alias("feature"),
        F.element_at(F.element_at(labels, which + 1), (F.col("code") % step + 1).cast("int")).alias("bin"),
        "n_samples",
        *measures,
    )
