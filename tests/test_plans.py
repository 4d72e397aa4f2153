"""Plan shape: what may be shuffled, what must reach the scan."""

from scoreweave import fixtures
from scoreweave.catalog import frozen
from scoreweave.catalog.queries import REGISTRY
from scoreweave.functions.columns import RAW_COLUMNS
from scoreweave.functions.rules import business_features
from scoreweave.models import scorecard
from scoreweave.operators import policy, split

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_is_one_projection(spark, tmp_path, raw_model_table):
    path = str(tmp_path / "t")
    raw_model_table.write.parquet(path)
    out = scorecard.predict_frame(spark.read.parquet(path).select("sk_id_curr", *RAW_COLUMNS), frozen.model(), rule=frozen.RULE)
    assert "Exchange" not in plan(out) and "Python" not in plan(out)
    top = business_features(spark.read.parquet(path))
    assert "Exchange" not in plan(top)


def test_split_assignment_needs_no_shuffle(spark, tmp_path, raw_model_table):
    path = str(tmp_path / "t")
    raw_model_table.write.parquet(path)
    parted = split.stratified_split(spark.read.parquet(path))
    assert "Exchange" not in plan(parted)


def test_only_needed_columns_are_read(spark):
    text = plan(REGISTRY["rule_decisions"](spark, SF))
    assert "o_totalprice" not in text.split("ReadSchema")[-1]


def test_policy_curve_shuffles_grid_slots_only(spark, tmp_path):
    path = str(tmp_path / "s")
    fixtures.scored(spark, SF).write.parquet(path)
    curve = policy.policy_curve(spark.read.parquet(path), "target", "p_base", [0.1, 0.2])
    assert "partial_count" in plan(curve) and "CartesianProduct" not in plan(curve)


def test_no_query_uses_a_cross_join(spark):
    for name in ("agg_left_join_wide", "reconciliation_report", "probability_report", "model_comparison", "policy_curve"):
        text = plan(REGISTRY[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
