"""Value guards.

Row-level guards are expressions: they return the checked value and raise when a
row breaks the rule, so a check costs no extra scan. Set-level checks (unique
keys, equal id sets) need a shuffle and therefore run once, at a table boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class GateError(ValueError):
    """Input data broke a declared rule."""


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Column | str, what: str = "value") -> Column:
    """Non-null finite double."""
    x = _col(value).cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(ok, x).otherwise(F.raise_error(F.lit(f"{what} must be finite")))


def probability(value: Column | str) -> Column:
    """Non-null double in [0, 1]; NaN compares greater than one and is refused."""
    x = _col(value).cast("double")
    return F.when((x >= 0) & (x <= 1), x).otherwise(
        F.raise_error(F.lit("probability must be finite and in [0, 1]"))
    )


def open_probability(value: Column | str) -> Column:
    """Double strictly inside (0, 1); endpoints are refused, never clipped."""
    x = _col(value).cast("double")
    return F.when((x > 0) & (x < 1), x).otherwise(
        F.raise_error(F.lit("probability must be strictly inside (0, 1)"))
    )


def weight(value: Column | str) -> Column:
    x = _col(value).cast("double")
    return F.when((x >= 0) & (x < F.lit(float("inf"))), x).otherwise(
        F.raise_error(F.lit("weight must be finite and not negative"))
    )


def binary_label(value: Column | str) -> Column:
    x = _col(value)
    return F.when(x.isin(0, 1), x.cast("int")).otherwise(
        F.raise_error(F.lit("label must be 0 or 1 without missing values"))
    )


def numeric_or_missing(name: str, data_type: T.DataType) -> str:
    """Double with NULL as the only missing value, as SQL text.

    Infinities and unreadable text are refused. NaN compares greater than infinity,
    so it matches no branch and falls to NULL.
    """
    if isinstance(data_type, (T.BooleanType, T.DateType, T.TimestampType, T.ArrayType, T.MapType, T.StructType)):
        raise GateError(f"column {name} is not numeric")
    if not isinstance(data_type, (T.DoubleType, T.FloatType, T.StringType)):
        return f"CAST({name} AS DOUBLE)"
    x = f"CAST({name} AS DOUBLE)"
    infinite = f"WHEN abs({x}) = double('inf') THEN raise_error('column {name} holds an infinite value')"
    if isinstance(data_type, T.StringType):
        x = f"try_cast({name} AS DOUBLE)"
        infinite = (
            f"WHEN abs({x}) = double('inf') OR ({x} IS NULL AND {name} IS NOT NULL) "
            f"THEN raise_error('column {name} holds a value that is not a finite number')"
        )
    return f"CASE WHEN abs({x}) < double('inf') THEN {x} {infinite} END"


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> dict[str, int]:
    """Count rows breaking each rule, all rules in one aggregate."""
    row = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()]).first()
    return {name: int(row[name]) for name in rules}


def require_rules(df: DataFrame, rules: dict[str, Column]) -> None:
    broken = {k: v for k, v in rule_violations(df, rules).items() if v}
    if broken:
        raise GateError(f"rows breaking rules: {broken}")


def require_columns(df: DataFrame, names) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise GateError(f"missing columns: {missing}")


def require_same_columns(found, expected) -> None:
    if set(found) != set(expected):
        raise GateError(
            f"columns changed; missing {sorted(set(expected) - set(found))}, "
            f"extra {sorted(set(found) - set(expected))}"
        )


def forbid_columns(names, forbidden=("target", "sk_id_curr")) -> None:
    """Labels and identifiers may not enter a learned transform."""
    found = sorted(set(names) & set(forbidden))
    if found:
        raise GateError(f"label or identifier columns are not features: {found}")


def require_unique_key(df: DataFrame, keys: list[str]) -> None:
    """Keys must be present and unique; counts combine map-side before the shuffle."""
    null_key = F.lit(False)
    for key in keys:
        null_key = null_key | F.col(key).isNull()
    row = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .agg(
            F.count_if(F.col("n") > 1).alias("duplicated"),
            F.count_if(null_key).alias("null_keys"),
        )
        .first()
    )
    if row["duplicated"] or row["null_keys"]:
        raise GateError(f"key {keys}: {row['duplicated']} duplicated, {row['null_keys']} missing")


def require_integer_id(df: DataFrame, id_col: str) -> None:
    if not isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise GateError(f"identifier {id_col} must be an integer column")
