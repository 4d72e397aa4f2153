"""Row rules: 35 features from ten raw columns in one projection, no statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import guards
from .columns import RAW_COLUMNS

# Fixed values of the data contract.
EMPLOYED_SENTINEL = 365243
DAYS_PER_YEAR = 365.25

AMOUNTS = ("amt_income_total", "amt_credit", "amt_annuity", "bureau_debt_total")
SCORES = ("ext_source_1", "ext_source_2", "ext_source_3")
RATIOS = {
    "credit_to_income_proxy": "amt_credit",
    "annuity_to_income_proxy": "amt_annuity",
    "bureau_debt_to_income_proxy": "bureau_debt_total",
}


def _flag(condition: str, name: str) -> str:
    """0/1 flag; a comparison with a missing value is false."""
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END AS {name}"


def _masked_with_flags(name: str, valid: str, invalid: str) -> list[str]:
    """Value where valid (missing stays missing) plus its two flags."""
    return [
        f"CASE WHEN {valid} THEN {name} END AS {name}",
        _flag(f"{name} IS NULL", f"{name}_missing"),
        _flag(invalid, f"{name}_invalid"),
    ]


FEATURES = (
    *(f"{c}{s}" for c in AMOUNTS for s in ("", "_missing", "_invalid")),
    "days_birth_missing",
    "days_birth_invalid",
    "age_years",
    "days_employed_missing",
    "days_employed_sentinel",
    "days_employed_invalid",
    "employed_years",
    "employment_age_inconsistent",
    *(f"{c}{s}" for c in SCORES for s in ("", "_missing", "_invalid")),
    "bureau_cnt",
    "bureau_has_record",
    "income_zero",
    *RATIOS,
)


def business_features(df: DataFrame, keep: tuple[str, ...] = ("sk_id_curr",)) -> DataFrame:
    """Derive the 35 features; ``keep`` columns pass through untouched.

    Expressions are short on purpose: the whole projection has to stay below the size
    at which the JVM stops compiling a generated method.
    """
    guards.require_columns(df, RAW_COLUMNS)
    types = {f.name: f.dataType for f in df.schema.fields}
    raw = df.selectExpr(*keep, *[f"{guards.numeric_or_missing(c, types[c])} AS {c}" for c in RAW_COLUMNS])

    masked: list[str] = []
    for name in AMOUNTS:
        masked += _masked_with_flags(name, f"{name} >= 0", f"{name} < 0")
    masked += [
        _flag("days_birth IS NULL", "days_birth_missing"),
        _flag("days_birth >= 0", "days_birth_invalid"),
        f"CASE WHEN days_birth < 0 THEN (0 - days_birth) / {DAYS_PER_YEAR}D END AS age_years",
        _flag("days_employed IS NULL", "days_employed_missing"),
        _flag(f"days_employed = {EMPLOYED_SENTINEL}", "days_employed_sentinel"),
        _flag(f"days_employed > 0 AND days_employed <> {EMPLOYED_SENTINEL}", "days_employed_invalid"),
        f"CASE WHEN days_employed <= 0 THEN (0 - days_employed) / {DAYS_PER_YEAR}D END AS employed_years",
    ]
    for name in SCORES:
        masked += _masked_with_flags(name, f"{name} BETWEEN 0 AND 1", f"{name} < 0 OR {name} > 1")
    masked.append(
        "CASE WHEN bureau_cnt >= 0 AND bureau_cnt % 1 = 0 THEN bureau_cnt "
        "ELSE raise_error('bureau_cnt must be a non-missing whole number >= 0') END AS bureau_cnt"
    )
    derived = {
        "employment_age_inconsistent": _flag("employed_years > age_years", "employment_age_inconsistent"),
        "bureau_has_record": _flag("bureau_cnt > 0", "bureau_has_record"),
        "income_zero": _flag("amt_income_total = 0", "income_zero"),
        **{n: f"CASE WHEN amt_income_total > 0 THEN {x} / amt_income_total END AS {n}" for n, x in RATIOS.items()},
    }
    return raw.selectExpr(*keep, *masked).selectExpr(*keep, *[derived.get(f, f) for f in FEATURES])


def flag_columns(columns, *suffixes: str) -> list[str]:
    return [c for c in columns if c.endswith(suffixes)]


def row_diagnostics(features: DataFrame, keep: tuple[str, ...] = ("sk_id_curr",)) -> DataFrame:
    """Per-row data-quality counts over all 35 features."""

    def total(suffix: str, name: str) -> str:
        return f"CAST({' + '.join(flag_columns(FEATURES, suffix))} AS BIGINT) AS {name}"

    return features.selectExpr(
        *keep,
        total("_missing", "raw_missing_count"),
        total("_invalid", "invalid_value_count"),
        total("_sentinel", "sentinel_count"),
        "CAST(employment_age_inconsistent AS BIGINT) AS employment_age_inconsistent",
        "CAST(income_zero AS BIGINT) AS income_zero",
    )
