"""One-to-many aggregation and the wide modelling table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ID

# Count features are a known zero without child records; amounts stay unknown.
ZERO_WITHOUT_RECORD = ("bureau_cnt", "bureau_active_cnt", "bureau_overdue_cnt")
CHILD_FEATURES = (
    "bureau_cnt",
    "bureau_active_cnt",
    "bureau_credit_sum_total",
    "bureau_credit_sum_avg",
    "bureau_debt_total",
    "bureau_overdue_cnt",
    "bureau_overdue_days_max",
    "bureau_days_credit_recent",
)


def aggregate_children(bureau: DataFrame, id_col: str = ID) -> DataFrame:
    """One row per id. Every measure combines map-side, so a hot id costs one
    partial row per task and no task sees its raw records together."""
    return bureau.groupBy(id_col).agg(
        F.count("*").alias("bureau_cnt"),
        F.count_if(F.col("credit_active") == "Active").alias("bureau_active_cnt"),
        F.sum("amt_credit_sum").alias("bureau_credit_sum_total"),
        F.avg("amt_credit_sum").alias("bureau_credit_sum_avg"),
        F.sum("amt_credit_sum_debt").alias("bureau_debt_total"),
        F.max("credit_day_overdue").alias("bureau_overdue_days_max"),
        F.count_if(F.col("credit_day_overdue") > 0).alias("bureau_overdue_cnt"),
        F.max("days_credit").alias("bureau_days_credit_recent"),
    )


def wide_table(application: DataFrame, aggregate: DataFrame, id_col: str = ID) -> DataFrame:
    """Left join of the parents with the aggregate (unique on both sides)."""
    features = [
        F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) if c in ZERO_WITHOUT_RECORD else F.col(c)
        for c in CHILD_FEATURES
    ]
    return application.join(aggregate, id_col, "left").select(*application.columns, *features)


def model_table(application: DataFrame, bureau: DataFrame, id_col: str = ID) -> DataFrame:
    return wide_table(application, aggregate_children(bureau, id_col), id_col)


def missingness_class(
    bureau: DataFrame, parents: DataFrame, fields: list[str], id_col: str = ID
) -> DataFrame:
    """Per amount field: parents whose child values are all unknown, partly known
    or all known. Parents without any child are a different state and are left out."""
    per_id = bureau.groupBy(id_col).agg(
        F.count("*").alias("n"), *[F.count(f).alias(f) for f in fields]
    )
    linked = per_id.join(parents.select(id_col), id_col, "left_semi")
    counts = []
    for f in fields:
        counts += [
            F.count_if(F.col(f) == 0).alias(f"{f}__all_unknown"),
            F.count_if((F.col(f) > 0) & (F.col(f) < F.col("n"))).alias(f"{f}__partly_known"),
            F.count_if(F.col(f) == F.col("n")).alias(f"{f}__all_known"),
        ]
    entry = [
        F.struct(
            F.lit(f).alias("field"),
            *[F.col(f"{f}__{c}").alias(c) for c in ("all_unknown", "partly_known", "all_known")],
        )
        for f in fields
    ]
    return linked.agg(*counts).select(F.inline(F.array(*entry)))
