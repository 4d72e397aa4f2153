import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreweave.functions import guards
from scoreweave.functions.columns import RAW_COLUMNS
from scoreweave.functions.rules import FEATURES, business_features
from scoreweave.operators import binning, quantiles, woe

BASE = dict(
    amt_income_total=100.0, amt_credit=50.0, amt_annuity=10.0, days_birth=-7305.0, days_employed=-3652.5,
    ext_source_1=0.5, ext_source_2=0.5, ext_source_3=0.5, bureau_cnt=1.0, bureau_debt_total=20.0,
)
SCHEMA = "sk_id_curr long, " + ", ".join(f"{c} double" for c in RAW_COLUMNS)


def frame(spark, *changes):
    rows = [(i, *[{**BASE, **c}[n] for n in RAW_COLUMNS]) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, SCHEMA)


def features(spark, *changes):
    return business_features(frame(spark, *changes)).orderBy("sk_id_curr").collect()


def test_feature_rules(spark):
    rows = features(
        spark,
        {},
        {"days_employed": 365243.0},
        {"days_employed": 10.0},
        {"amt_income_total": 0.0, "amt_credit": -20.0},
        {"amt_income_total": None, "ext_source_1": 1.5, "bureau_cnt": 0.0},
        {"days_birth": 0.0, "days_employed": -9000.0, "ext_source_2": float("nan")},
    )
    assert len(FEATURES) == 35 and len(rows[0]) == 36
    assert (rows[0]["age_years"], rows[0]["employed_years"]) == (20.0, 10.0)
    assert (rows[1]["days_employed_sentinel"], rows[1]["days_employed_invalid"], rows[1]["employed_years"]) == (1, 0, None)
    assert (rows[2]["days_employed_sentinel"], rows[2]["days_employed_invalid"], rows[2]["employed_years"]) == (0, 1, None)
    assert (rows[3]["credit_to_income_proxy"], rows[3]["amt_credit_invalid"], rows[3]["income_zero"]) == (None, 1, 1)
    assert (rows[4]["annuity_to_income_proxy"], rows[4]["ext_source_1"], rows[4]["bureau_has_record"]) == (None, None, 0)
    assert (rows[4]["amt_income_total_missing"], rows[4]["income_zero"]) == (1, 0)
    assert (rows[5]["days_birth_invalid"], rows[5]["employment_age_inconsistent"]) == (1, 0)
    assert (rows[5]["ext_source_2"], rows[5]["ext_source_2_missing"]) == (None, 1)


@pytest.mark.parametrize("change", [{"bureau_cnt": None}, {"bureau_cnt": 1.5}, {"bureau_cnt": -1.0}, {"amt_credit": float("inf")}])
def test_feature_guards(spark, change):
    with pytest.raises(Exception, match="bureau_cnt|infinite"):
        features(spark, change)


def test_text_input(spark):
    text = frame(spark, {}).withColumn("amt_credit", F.lit("50"))
    assert business_features(text).first()["amt_credit"] == 50.0
    with pytest.raises(Exception, match="amt_credit"):
        business_features(text.withColumn("amt_credit", F.lit("many"))).collect()
    with pytest.raises(guards.GateError):
        business_features(text.drop("amt_credit"))


def bins_of(spark, train, applied, n_bins=5):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in train], "x double")
    spec = binning.fit_bins(df, ["x"], n_bins)
    new = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(applied)], "sk_id_curr long, x double")
    return spec, [r["x"] for r in binning.apply_bins(new, spec).orderBy("sk_id_curr").collect()]


def test_bins_ends_and_missing(spark):
    assert bins_of(spark, range(100), [-1000, 1e9, None])[1] == ["bin_000", "bin_004", "missing"]
    assert bins_of(spark, [None, None], [None, 3])[1] == ["missing", "outside_training"]
    assert bins_of(spark, [5, 5, 5], [5, 100])[1] == ["bin_000", "bin_000"]
    assert bins_of(spark, [0, 1, 1, 0], [0, 1])[1] == ["bin_000", "bin_001"]


def test_bin_edge_belongs_to_lower_bin(spark):
    spec, _ = bins_of(spark, range(100), [0])
    edge = spec["x"].edges[0]
    assert bins_of(spark, range(100), [edge, math.nextafter(edge, math.inf)])[1] == ["bin_000", "bin_001"]


def test_bins_refuse_label_and_structure_change(spark):
    df = spark.createDataFrame([(1.0, 1)], "x double, target int")
    with pytest.raises(guards.GateError):
        binning.fit_bins(df, ["x", "target"])
    spec, _ = bins_of(spark, range(10), [1])
    with pytest.raises(guards.GateError):
        binning.apply_bins(df.withColumn("sk_id_curr", F.lit(1)), spec)


def test_few_values_against_brute_force(spark):
    rng = np.random.default_rng(0)
    # Rare values far from the start of the table: the seed rows cannot show them.
    rare = np.r_[np.zeros(3000), [7.0, 9.0]]
    many = rng.normal(size=3002)
    six = np.r_[np.full(2997, 2.0), [1, 3, 4, 5, 6]]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(rare, many, six)], "a double, b double, c double")
    assert binning.few_values(df, ["a", "b", "c"], 5) == {"a": [0.0, 7.0, 9.0], "b": None, "c": None}


def test_selected_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    smooth = rng.normal(size=4000)
    # One value holds a third of the rows.
    hot = np.where(rng.uniform(size=4000) < 0.34, 0.25, rng.uniform(size=4000))
    # Neighbouring doubles, both signs, extremes and nulls.
    fine = rng.choice([1.0, np.nextafter(1.0, 2), -1.0, np.nextafter(-1.0, -2), 0.0, -0.0, 5e-324, 1e308, -1e308], 4000)
    rows = [(float(a), float(b), None if i % 7 == 0 else float(c), None) for i, (a, b, c) in enumerate(zip(smooth, hot, fine))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    points = [0.0, 0.1, 0.25, 0.4, 0.5, 0.6000000000000001, 0.99, 1.0]
    known = {"a": smooth, "b": hot, "c": np.array([r[2] for r in rows if r[2] is not None]) + 0.0}
    found = quantiles.exact_quantiles(df, list("abcd"), points)
    assert sorted(found) == list("abc")
    for name in "ab":
        assert np.allclose(found[name], np.quantile(known[name], points), rtol=0, atol=1e-12)
    ranks = [0, 1, 17, 1000, 2500, 3000]
    picked = quantiles.select_values(df, list("abcd"), lambda n: [r for r in ranks if r < n], few=9)
    for name, values in known.items():
        assert picked[name].n == len(values) and picked[name].at == {r: float(np.sort(values)[r]) for r in ranks}
    assert picked["a"].distinct is None and picked["d"] == (0, {}, [])
    assert picked["c"].distinct == sorted(set(known["c"].tolist())) and len(picked["c"].distinct) == 8
    assert (quantiles.doubles(quantiles.images(np.sort(known["c"]))) == np.sort(known["c"])).all()


def labelled(spark):
    rows = [("low", int(i == 0)) for i in range(5)] + [("high", int(i < 4)) for i in range(5)]
    return spark.createDataFrame(rows, "risk string, target int")


def test_woe_hand_calculated(spark):
    table = woe.woe_from_counts(woe.label_counts(labelled(spark), ["risk"]), 0.5, 20)
    rows = {r["bin"]: r for r in table.collect()}
    assert rows["low"]["bad_share"] == pytest.approx(0.25) and rows["high"]["bad_share"] == pytest.approx(0.75)
    assert rows["low"]["woe"] == pytest.approx(-math.log(3)) and rows["high"]["woe"] == pytest.approx(math.log(3))
    assert rows["low"]["small_bin"] and not rows["low"]["single_class_bin"]
    report = woe.iv_report(table).first()
    assert report["iv"] == pytest.approx(math.log(3)) and report["review_high_iv"]


def test_woe_unknown_bin(spark):
    table = woe.woe_from_counts(woe.label_counts(labelled(spark), ["risk"]), 0.5)
    model = woe.WoeModel.from_table(table, ["risk"])
    new = spark.createDataFrame([(1, "high"), (2, "high"), (3, "new")], "sk_id_curr long, risk string")
    values = [r["risk"] for r in woe.apply_woe_labels(new, model).orderBy("sk_id_curr").collect()]
    assert values == [pytest.approx(math.log(3)), pytest.approx(math.log(3)), 0.0]
    report = woe.unknown_report_labels(new.drop("sk_id_curr"), model).first()
    assert (report["unknown_count"], report["unknown_rate"]) == (1, pytest.approx(1 / 3))
    with pytest.raises(Exception, match="unknown bin"):
        woe.apply_woe_labels(new, model, unknown_policy="error").collect()


def test_woe_guards(spark):
    with pytest.raises(Exception, match="both classes"):
        woe.woe_from_counts(woe.label_counts(labelled(spark).filter("target = 1"), ["risk"])).collect()
    with pytest.raises(Exception, match="blank"):
        woe.label_counts(labelled(spark).withColumn("risk", F.lit("  ")), ["risk"]).collect()
    with pytest.raises(ValueError):
        woe.woe_from_counts(woe.label_counts(labelled(spark), ["risk"]), 0.0)
    model = woe.WoeModel(0.5, ("x",), ({"feature": "x", "bin": "b", "woe": 0.0, "iv_component": 0.001},))
    with pytest.raises(ValueError):
        model.candidates(0.02)


def test_numeric_and_label_paths_agree(spark, raw_model_table):
    features = business_features(raw_model_table, ("sk_id_curr", "target")).cache()
    spec = binning.fit_bins(features, FEATURES)
    direct = {(r["feature"], r["bin"]): r["woe"] for r in woe.woe_table(features, spec).collect()}
    labels = binning.apply_bins(features, spec, ("sk_id_curr", "target"))
    generic = {(r["feature"], r["bin"]): r["woe"] for r in woe.woe_from_counts(woe.label_counts(labels, FEATURES)).collect()}
    assert direct.keys() == generic.keys()
    assert all(direct[k] == pytest.approx(generic[k], abs=1e-12) for k in direct)


def test_selection_keeps_first_of_equal_columns(spark):
    rows = [(i, int(i < 8 or i % 3 == 0), float(i), float(i), float(-i), 3.0, None) for i in range(40)]
    df = spark.createDataFrame(rows, "sk_id_curr long, target int, a double, b double, c double, d double, e double")
    log = {r["feature"]: r["selection_reason"] for r in woe.select_raw(df, ["a", "b", "c", "d", "e"])}
    assert log == {"a": "keep", "b": "drop_duplicate_of:a", "c": "keep", "d": "drop_constant", "e": "drop_constant"}
    spec = binning.fit_bins(df, ["a", "b", "d"])
    encoded = {r["feature"]: r["selection_reason"] for r in woe.select_encoded(df, spec, woe.fit_woe(df, spec), 0.0)}
    assert encoded == {"a": "keep", "b": "drop_duplicate_of:a", "d": "drop_constant"}


def test_bin_codes_of_many_labels_stay_apart(spark):
    """More than 4,096 labels in one feature must not reach into the next feature's codes."""
    from scoreweave.operators.binning import BinSpec, FeatureBins, bin_counts

    wide = FeatureBins("x", tuple(float(i) for i in range(4200)), False, 0.0, 4200.0)
    spec = BinSpec(4200, (wide, FeatureBins("y", (0.5,), False, 0.0, 1.0)))
    df = spark.createDataFrame([(4199.5, 0.0), (4199.5, 1.0), (4100.5, 1.0), (None, None)], "x double, y double")
    found = {(r["feature"], r["bin"]): r["n_samples"] for r in bin_counts(df, spec).collect()}
    assert found == {
        ("x", wide.labels[4200]): 2, ("x", wide.labels[4101]): 1, ("x", wide.labels[-1]): 1,
        ("y", spec["y"].labels[0]): 1, ("y", spec["y"].labels[1]): 2, ("y", spec["y"].labels[-1]): 1,
    }
