"""The driver contract: names, shapes and a fast sample of SQL comparisons."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"

ROWS_ONLY = {
    "content_checksum", "content_fingerprint", "logistic_fit", "logistic_summary", "logistic_scores", "gbt_fit",
    "gbt_contributions", "platt_fit", "monitor_summary", "bootstrap_intervals_split",
}
QUICK = [
    "agg_left_join_wide", "loaded_model_table", "reconcile_key_mismatch", "linkage_counts", "missingness_class", "business_feature_table",
    "bin_labels", "woe_table", "stratified_membership", "ranking_metrics_weighted", "probability_report",
    "calibration_bins", "policy_curve", "psi_summary", "batch_prediction", "top_reasons", "bootstrap_intervals",
    "contract_violations",
]


@pytest.fixture(scope="module")
def duck():
    from tools.check import duck as connect

    return connect(SF)


def test_every_query_has_sql_or_is_known_without():
    from scoreweave.catalog.queries import REGISTRY

    import __spark_entry__ as contract

    library = set(REGISTRY)
    assert library - set(contract.oracle_sql()) == ROWS_ONLY
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 1500


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    from tools.check import compare

    verdict, _ = compare(spark, duck, name, SF)
    assert verdict.startswith("ok"), verdict
