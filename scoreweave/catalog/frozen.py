"""A small frozen scoring model used by the scoring queries.

Its parameters are literals, so the queries exercise the apply path on whole tables
and the expected results can be written as plain SQL. One bin is left out of the WOE
table on purpose: it must show up as unknown.
"""

from __future__ import annotations

from ..models.logistic import LogisticModel
from ..operators.binning import BinSpec, FeatureBins
from ..operators.policy import ApprovalRule
from ..operators.woe import WoeModel

EDGES = {
    "ext_source_1": (0.2, 0.4, 0.6, 0.8),
    "ext_source_2": (0.2, 0.4, 0.6, 0.8),
    "ext_source_3": (0.3, 0.45, 0.55, 0.7),
    "credit_to_income_proxy": (0.75, 1.25, 1.5, 1.625),
    "amt_annuity": (7500.0, 15000.0, 22500.0),
    "age_years": (30.0, 45.0, 60.0),
    "days_employed_sentinel": (0.0,),
    "bureau_cnt": (0.0, 2.0, 4.0),
}

WOE = {
    "ext_source_1": {"bin_000": 0.75, "bin_001": 0.25, "bin_002": -0.25, "bin_003": -0.75, "bin_004": -1.25, "missing": 0.125},
    "ext_source_2": {"bin_000": 0.0625, "bin_001": 0.03125, "bin_002": 0.0, "bin_003": -0.03125, "bin_004": -0.0625},
    "ext_source_3": {"bin_000": 0.5, "bin_001": 0.25, "bin_002": 0.0, "bin_003": -0.25, "bin_004": -0.5, "missing": 0.0},
    "credit_to_income_proxy": {"bin_000": -0.125, "bin_001": -0.0625, "bin_002": 0.0, "bin_003": 0.0625, "bin_004": 0.125, "missing": 0.25},
    "amt_annuity": {"bin_000": -0.1875, "bin_001": 0.0, "bin_002": 0.0625, "bin_003": 0.1875},
    "age_years": {"bin_000": 0.25, "bin_001": 0.125, "bin_002": -0.125, "bin_003": -0.25, "missing": 0.0},
    "days_employed_sentinel": {"bin_000": -0.03125, "bin_001": 0.28125},
    "bureau_cnt": {"bin_000": 0.15625, "bin_001": 0.09375, "bin_002": -0.03125, "bin_003": -0.09375},
}

COEFFICIENTS = {
    "ext_source_1": 0.875,
    "ext_source_2": 0.5,
    "ext_source_3": 0.625,
    "credit_to_income_proxy": 0.75,
    "amt_annuity": 0.375,
    "age_years": 1.125,
    "days_employed_sentinel": 0.9375,
    "bureau_cnt": 0.8125,
}

INTERCEPT = -2.0
RULE = ApprovalRule("threshold", 0.09)


def _rows() -> tuple[dict, ...]:
    """WOE rows with the counts a training table would carry (fixed, illustrative)."""
    rows = []
    for feature, mapping in WOE.items():
        for label, woe in mapping.items():
            rows.append(
                dict(
                    feature=feature, bin=label, n_samples=1000 // len(mapping), n_bad=100 // len(mapping),
                    n_good=900 // len(mapping), bad_rate=0.1, bad_share=0.1, good_share=0.9, woe=woe,
                    iv_component=0.0, small_bin=False, single_class_bin=False,
                )
            )
    return tuple(rows)


def model() -> LogisticModel:
    bins = BinSpec(5, tuple(FeatureBins(f, e, False, None, None) for f, e in EDGES.items()))
    names = tuple(EDGES)
    return LogisticModel(
        bins, WoeModel(0.5, names, _rows()), names, tuple(COEFFICIENTS[f] for f in names), INTERCEPT,
        1000, 0.1, 1,
    )
