"""Names shared by every module: identifiers, labels and bin literals."""

ID = "sk_id_curr"
TARGET = "target"

MISSING = "missing"
OUTSIDE = "outside_training"

RAW_COLUMNS = (
    "amt_income_total",
    "amt_credit",
    "amt_annuity",
    "days_birth",
    "days_employed",
    "ext_source_1",
    "ext_source_2",
    "ext_source_3",
    "bureau_cnt",
    "bureau_debt_total",
)


def numeric_bin_name(position: int) -> str:
    return f"bin_{position:03d}"
