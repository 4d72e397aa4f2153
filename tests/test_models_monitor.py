import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreweave.functions.columns import RAW_COLUMNS
from scoreweave.functions.guards import GateError
from scoreweave.functions.math import clipped_log_odds, sigmoid
from scoreweave.functions.rules import business_features
from scoreweave.models import histogram, logistic, platt, scorecard, trees
from scoreweave.operators import explain, policy, split
from scoreweave.plans import experiment, monitoring
from scoreweave.sources import runs
from scoreweave.streaming import score as stream

VERSIONS = {"model": "m", "reference": "r", "policy": "p", "monitor": "c"}


@pytest.fixture(scope="module")
def model(raw_model_table):
    return logistic.fit_logistic(raw_model_table)


@pytest.fixture(scope="module")
def forest(raw_model_table):
    return trees.fit_trees(raw_model_table, rounds=3, min_rows=30)


def newton(x, y, C=1.0, steps=50):
    """Independent solve of the penalised problem with a free intercept."""
    z = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(C * (z.T * (p * (1 - p))) @ z + penalty, C * z.T @ (p - y) + penalty @ w)
    return w


def test_regression_equals_newton(spark, raw_model_table, model):
    from scoreweave.operators.woe import apply_woe

    features = business_features(raw_model_table, ("sk_id_curr", "target"))
    design = apply_woe(features, model.bins, model.woe, model.selected, ("target",)).toPandas()
    w = newton(design[list(model.selected)].to_numpy(), design["target"].to_numpy(float))
    assert np.allclose(model.coefficients, w[:-1], atol=1e-5) and model.intercept == pytest.approx(w[-1], abs=1e-5)
    assert "ext_source_1" in model.selected and model.training_rows == 900


def test_combined_rows_train_the_same_model(spark):
    rows = [(float(i % 4), float(i % 3), float((i * 7) % 10 < 3 + i % 4)) for i in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, y double").withColumn("w", F.lit(1.0))
    plain = logistic.fit_weighted(df, ["a", "b"], 600)
    packed = logistic.fit_weighted(df.groupBy("a", "b", "y").agg(F.sum("w").alias("w")), ["a", "b"], 600)
    assert np.allclose(plain[0], packed[0], atol=1e-6) and plain[1] == pytest.approx(packed[1], abs=1e-6)


def test_scorecard_identities(spark, raw_model_table, model):
    features = business_features(raw_model_table)
    scorecard.require_score_identities(features, model)
    wide = scorecard.point_columns(features, model).toPandas().set_index("sk_id_curr")
    score = scorecard.score_frame(features, model).toPandas().set_index("sk_id_curr")
    total = wide.sum(axis=1) + scorecard.base_points(model, scorecard.ScoreScale())
    assert np.allclose(total, score.loc[wide.index, "score_raw"])
    long = scorecard.contributions_long(features, model).groupBy("sk_id_curr").agg(F.sum("points").alias("s")).toPandas()
    assert np.allclose(long.set_index("sk_id_curr").loc[wide.index, "s"], wide.sum(axis=1))
    table = scorecard.bin_points(spark, model)
    assert {r["feature"] for r in table.select("feature").distinct().collect()} == set(model.selected)


def test_score_scale_cases(spark):
    scale = scorecard.ScoreScale()
    df = spark.createDataFrame([(math.log(1 / 50),), (math.log(1 / 25),)], "z double")
    assert [r[0] for r in df.select(scale.from_log_odds(F.col("z"))).collect()] == pytest.approx([600.0, 580.0])
    with pytest.raises(Exception, match="strictly inside"):
        df.select(scale.from_probability(F.lit(1.0))).collect()
    for bad in ({"base_bad_good_odds": 0.0}, {"points_to_double_odds": -1.0}, {"base_score": float("nan")}, {"base_score": True}):
        with pytest.raises(ValueError):
            scorecard.ScoreScale(**bad)
    far = spark.createDataFrame([(-800.0,), (800.0,)], "z double").select(sigmoid(F.col("z"))).collect()
    assert [r[0] for r in far] == [0.0, 1.0]


def test_batch_prediction_and_reload(spark, tmp_path, raw_model_table, model):
    raw = raw_model_table.select("sk_id_curr", *RAW_COLUMNS)
    out = scorecard.predict_frame(raw, model)
    assert out.columns == ["sk_id_curr", *scorecard.OUTPUT_COLUMNS]
    assert out.filter("simulated_approval IS NOT NULL").isEmpty()
    decided = scorecard.predict_frame(raw, model, rule=policy.ApprovalRule("threshold", 0.5))
    assert decided.filter("simulated_approval <> (predicted_bad_probability <= 0.5)").isEmpty()
    with pytest.raises(ValueError):
        scorecard.predict_frame(raw_model_table, model)
    model.save(spark, str(tmp_path / "model"))
    again = logistic.LogisticModel.load(spark, str(tmp_path / "model"))
    assert scorecard.canary_gap(spark, model, again) <= 1e-12
    assert again.selected == model.selected


def test_linear_explanation(spark, raw_model_table, model):
    features = business_features(raw_model_table)
    terms = explain.linear_contributions(features, model)
    assert explain.require_reconstruction(terms, model.selected) < 1e-10
    groups = list(explain.group_members(model.selected))
    grouped = explain.group_contributions(terms, model.selected).toPandas().set_index("sk_id_curr")
    wide = terms.toPandas().set_index("sk_id_curr")
    assert np.allclose(grouped.sum(axis=1), wide.loc[grouped.index, list(model.selected)].sum(axis=1))
    top = explain.top_reasons(explain.group_contributions(terms, model.selected), groups, 2).toPandas()
    for i, part in list(top.groupby("sk_id_curr"))[:50]:
        row = grouped.loc[i]
        want = sorted(((-v, g) for g, v in row.items() if v > 1e-10))[:2]
        assert list(part.sort_values("rank")["group"]) == [g for _, g in want]
    with pytest.raises(ValueError):
        explain.feature_group("shoe_size")


def test_tree_explanation_reconstructs_the_margin(spark, raw_model_table, forest):
    features = business_features(raw_model_table)
    terms = trees.tree_contributions(features, forest).toPandas().set_index("sk_id_curr")
    scored = trees.score_tree_features(features, forest).toPandas().set_index("sk_id_curr")
    assert np.allclose(terms["model_log_odds"], scored.loc[terms.index, "log_odds"], atol=1e-9)
    assert np.allclose(terms["base_log_odds"] + terms[list(forest.selected)].sum(axis=1), terms["model_log_odds"])
    assert len(forest.forest.roots) == 3
    nodes = forest.node_table(spark).toPandas()
    assert nodes[nodes.node == 0].rows.tolist() == [900] * 3 and nodes.groupby("tree").left.apply(lambda x: x.isna().sum()).max() <= 15
    assert forest.importance(spark).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def one_split(x, g, h, penalty, min_rows):
    """Best (gain, feature, rows to the left) over all features, bounds and sides of the missing rows."""
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + penalty)
    best = (1e-10, None, None)
    for f in range(x.shape[1]):
        absent = np.isnan(x[:, f])
        for side in (False, True):
            for bound in np.unique(x[~absent, f]):
                left = np.where(absent, side, x[:, f] <= bound)
                if min(left.sum(), (~left).sum()) >= min_rows:
                    gain = score(left) + score(~left) - score(np.ones(len(g), bool))
                    if gain > best[0] + 1e-9:
                        best = (gain, f, left)
    return best


def test_every_split_is_the_best_first_one(spark, raw_model_table):
    """Three whole trees grown by hand: same splits, gains, rows and leaves, in the order of gain."""
    raw = raw_model_table.filter("sk_id_curr < 5250").withColumn("ext_source_1", F.expr("CASE WHEN sk_id_curr % 5 > 0 THEN round(ext_source_1, 1) END"))
    model = trees.fit_trees(raw, rounds=3, min_rows=20, leaves=6, penalty=1.0, step=0.3)
    data = business_features(raw, ("sk_id_curr", "target")).toPandas()
    x, y = data[list(model.selected)].to_numpy(dtype=float), data["target"].to_numpy()
    z = np.full(len(y), model.start)
    nodes = model.node_table(spark).toPandas()
    for t in range(3):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        found = [(one_split(x, g, h, 1.0, 20), np.ones(len(y), bool))]
        gains = []
        while len(found) < 6 and max(s[0] for s, _ in found) > 1e-9:
            i = max(range(len(found)), key=lambda k: found[k][0][0])
            (gain, f, _), own = found.pop(i)
            gains.append((gain, model.selected[f], int(own.sum())))
            inside = np.flatnonzero(own)
            left = one_split(x[own], g[own], h[own], 1.0, 20)[2]
            for side in (left, ~left):
                mask = np.zeros(len(y), bool)
                mask[inside[side]] = True
                found.append((one_split(x[mask], g[mask], h[mask], 1.0, 20), mask))
        own = nodes[(nodes.tree == t) & nodes.left.notna()]
        got = sorted(zip(own.gain, own["rows"]))
        assert np.allclose(got, sorted((a, c) for a, _, c in gains), atol=1e-7)
        for _, mask in found:
            z[mask] += -0.3 * g[mask].sum() / (h[mask].sum() + 1)
    scored = trees.score_tree_features(business_features(raw), model).toPandas().set_index("sk_id_curr").loc[data["sk_id_curr"]]
    assert np.allclose(scored["log_odds"], z, atol=1e-9)


def test_only_the_smaller_children_are_added_up(spark, raw_model_table, monkeypatch):
    """One tree: half of the rows at most in every pass but the first, no pass in more than one stage."""
    counted, whole = [], histogram.node_sums

    def seen(blocks, *rest):
        spark.sparkContext.setJobGroup("tree-pass", "")
        sums = whole(blocks, *rest)
        spark.sparkContext.setJobGroup("other", "")
        counted.append(sums[0, :, :, 2].sum(axis=1))
        return sums

    monkeypatch.setattr(histogram, "node_sums", seen)
    model = trees.fit_trees(raw_model_table, rounds=1, min_rows=30)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("tree-pass")
    assert [len(spark.sparkContext.statusTracker().getJobInfo(j).stageIds) for j in jobs] == [1] * len(counted)
    assert counted[0].tolist() == [900] and len(counted) > 2 and all(c.sum() <= 450 for c in counted[1:])
    f = model.forest
    inner = np.flatnonzero(f.left >= 0)
    assert (f.rows[f.left[inner]] + f.rows[f.right[inner]] == f.rows[inner]).all()


def test_rows_descend_as_one_by_one(forest):
    """Leaves of whole columns equal the walk of each row, missing values included."""
    own = forest.forest
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (500, len(forest.selected))).astype(np.uint8)
    codes[rng.uniform(size=codes.shape) < 0.2] = histogram.MISSING
    want = np.zeros(500)
    for i, row in enumerate(codes):
        for n in own.roots:
            while own.left[n] >= 0:
                x = row[own.feature[n]]
                below = own.missing_left[n] if x == histogram.MISSING else x <= own.code[n]
                n = own.left[n] if below else own.right[n]
            want[i] += own.value[n]
    assert np.allclose(own.by_codes(codes), want)


def test_features_of_few_codes_share_a_byte():
    """Every code, every test of a split and every sum of a shared byte are those of the features alone."""
    rng = np.random.default_rng(4)
    values, missing = [255, 2, 3, 2, 2, 8, 130, 2, 2, 129, 1], [1, 0, 1, 0, 1, 1, 1, 0, 0, 0, 0]
    codes = np.stack([rng.integers(0, n, 4000) for n in values], axis=1).astype(np.uint8)
    for f in np.flatnonzero(missing):
        codes[rng.uniform(size=len(codes)) < 0.2, f] = histogram.MISSING
    layout = histogram.Layout.of(values, missing)
    packed = np.ascontiguousarray(layout.pack(codes).T)
    assert len(packed) == layout.columns == 5
    weights = rng.integers(0, 9, (3, len(codes)))
    sums = [[np.bincount(c, w, 256) for w in weights] for c in packed]
    spread = layout.spread(np.moveaxis(np.array(sums), 1, -1)[:, None])
    for f, n in enumerate(values):
        assert (layout.code(f)[packed[layout.column[f]]] == codes[:, f]).all()
        assert (spread[f, 0].T == [np.bincount(codes[:, f], w, 256) for w in weights]).all()
        for bound in range(n):
            for side in (False, True):
                want = np.where(codes[:, f] == histogram.MISSING, side, codes[:, f] <= bound)
                assert (layout.goes_left(packed, f, bound, side) == want).all()


def test_packed_rows_hold_fewer_bytes_than_features(spark, raw_model_table, monkeypatch):
    """Flags do not travel as a byte each in every pass, and the trees are those of features alone."""
    seen, whole = [], histogram.block_rdd

    def blocks(table, rows):
        seen.append(sum(len(r["codes"]) for r in table.collect()) // rows)
        return whole(table, rows)

    monkeypatch.setattr(histogram, "block_rdd", blocks)
    nodes = lambda: trees.fit_trees(raw_model_table, rounds=3, min_rows=30).node_table(spark).toPandas()
    shared = nodes()
    monkeypatch.setattr(histogram.Layout, "of", classmethod(lambda cls, codes, missing: cls.alone(len(codes))))
    alone = nodes()
    assert seen[0] < seen[-1]
    exact = ["tree", "node", "feature", "left", "right", "rows"]
    assert shared[exact].astype(str).equals(alone[exact].astype(str))
    assert np.allclose(shared["log_odds"], alone["log_odds"])


def test_growth_asks_seldom():
    """A known tree of gains: best-first order, whatever is asked for ahead."""
    split = lambda gain: histogram.Split(gain, 0, 0, False, (0.0, 1.0, 1), (0.0, 1.0, 1))
    calls = []

    def evaluate(asked, splits, children):
        calls.append(list(asked))
        depth = {0: 0}
        for n in sorted(children):
            depth.update(dict.fromkeys(children[n], depth[n] + 1))
        return [split(10.0 / (1 + depth[n]) + 0.01 * n) if depth[n] < 4 else None for n in asked]

    splits, children = trees.grow(evaluate, 12)
    assert len(splits) == 11 and len(calls) <= 5
    assert trees.grow(lambda *_: [None], 5) == ({}, {})


def test_platt_recovers_a_shift(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=3000)
    y = (rng.uniform(size=3000) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(int)
    p = 1 / (1 + np.exp(-z))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    fitted = platt.fit_platt(df, "y", "p")
    w = newton(z[:, None], y.astype(float))
    assert (fitted.slope, fitted.intercept) == (pytest.approx(w[0], abs=1e-5), pytest.approx(w[1], abs=1e-5))
    ends = spark.createDataFrame([(0.0,), (1.0,)], "p double").select(clipped_log_odds(F.col("p"))).collect()
    assert ends[0][0] == pytest.approx(-ends[1][0])


def test_experiment_end_to_end(spark, tmp_path, raw_model_table):
    parted = split.stratified_split(raw_model_table)
    member = split.membership(parted)
    run = experiment.run_experiment(raw_model_table, member, tree_options={"rounds": 2, "min_rows": 30})
    assert len(run.comparison) == 4 and 0 <= run.scheme.threshold <= 1
    best = max(run.comparison, key=lambda r: r["auc"])
    assert run.scheme.model == best["model"]
    report = experiment.final_evaluation(raw_model_table, member, run)
    assert report["capability"].filter("auc > 0.6").count() >= 1
    assert report["predictions"].count() == 180
    assert report["reliability"].agg(F.sum("n_samples")).first()[0] == 180
    frozen = spark.createDataFrame([("model", "1"), ("table", "2")], "name string, digest string")
    with pytest.raises(GateError):
        experiment.final_evaluation(raw_model_table, member, run, frozen.filter("name = 'model'"), frozen)
    for n in (1, 2):
        experiment.final_evaluation(raw_model_table, member, run, frozen, frozen, str(tmp_path / "openings"))
        opened = spark.read.parquet(str(tmp_path / "openings"))
        assert opened.count() == n and opened.select("predictions_digest").distinct().count() == 1
    with pytest.raises(ValueError):
        experiment.run_experiment(raw_model_table, member.limit(10))


def test_failed_run_can_be_repeated(spark, tmp_path, raw_model_table, model):
    monitor = monitoring.build_monitor(model, raw_model_table, VERSIONS)
    path = str(tmp_path / "runs")
    with pytest.raises(GateError):
        monitoring.run_and_record(monitor, raw_model_table.limit(0), path, "r", "b")
    monitoring.run_and_record(monitor, raw_model_table, path, "r", "b")
    assert sorted(r["status"] for r in runs.run_table(spark, path).collect()) == ["done", "failed"]
    with pytest.raises(ValueError):
        monitoring.run_and_record(monitor, raw_model_table, path, "r", "b")


def test_monitoring(spark, tmp_path, raw_model_table, model):
    rule = policy.ApprovalRule("threshold", 0.5)
    monitor = monitoring.build_monitor(model, raw_model_table, VERSIONS, rule)
    path = str(tmp_path / "runs")
    report = monitoring.run_and_record(monitor, raw_model_table, path, "run-1", "batch-1", "target", "observed")
    assert report["n_samples"] == 900 and report["drift_summary"][0]["psi"] == pytest.approx(0.0, abs=1e-9)
    assert report["strategy"]["approved"] == report["strategy"]["labelled_result"]["approved_count"]
    assert report["labelled"]["metrics"]["auc"] > 0.7 and not report["automatic_action"]

    moved = raw_model_table.withColumn("amt_credit", F.col("amt_credit") * 3).withColumn(
        "days_employed", F.when(F.col("sk_id_curr") % 9 == 0, 365243.0).otherwise(F.col("days_employed"))
    )
    second = monitoring.evaluate_batch(monitor, moved)
    items = {n["item"] for n in second["notices"] if n["level"] == "review"}
    assert {"distribution", "special_codes"} <= items and second["labelled"] is None
    assert second["sentinel_rows"] == 100

    partial = raw_model_table.withColumn("target", F.when(F.col("sk_id_curr") % 2 == 0, F.col("target")))
    with pytest.raises(ValueError):
        monitoring.run_and_record(monitor, partial, path, "run-2", "batch-2", "target", "observed")
    recorded = {r["run_id"]: r["status"] for r in runs.load_runs(spark, path).collect()}
    assert recorded == {"run-1": "done", "run-2": "failed"}
    with pytest.raises(ValueError):
        monitoring.evaluate_batch(monitor, raw_model_table, "target", "mature labels")
    with pytest.raises(ValueError):
        monitoring.evaluate_batch(monitor, raw_model_table.union(raw_model_table))
    small = monitoring.evaluate_batch(monitor, raw_model_table.limit(50))
    assert {"level": "info", "item": "sample_size"}.items() <= next(n for n in small["notices"] if n["item"] == "sample_size").items()
    for bad in ({"min_batch_size": 0}, {"psi_review_threshold": 0.0}, {"unknown_rate_threshold": 2.0}):
        with pytest.raises(ValueError):
            monitoring.MonitoringConfig(**bad)


def test_tree_monitoring(raw_model_table, forest):
    monitor = monitoring.build_monitor(forest, raw_model_table, VERSIONS)
    report = monitoring.evaluate_batch(monitor, raw_model_table)
    assert report["max_unknown_rate"] is None and report["strategy"]["status"] == "not_configured"
    assert report["explanation_audit"]["max_reconstruction_error"] < 1e-8


def test_streaming_scores_equal_batch_and_record_once(spark, tmp_path, raw_model_table, model):
    raw = raw_model_table.select("sk_id_curr", *RAW_COLUMNS)
    folder = str(tmp_path / "in")
    raw.repartition(2).write.parquet(folder)
    source = stream.read_applications(spark, folder)
    out = stream.score_stream(source, model)
    query = out.writeStream.format("memory").queryName("scored_stream").trigger(availableNow=True).start()
    query.awaitTermination(120)
    streamed = {r["sk_id_curr"]: r["score_raw"] for r in spark.table("scored_stream").collect()}
    batch = {r["sk_id_curr"]: r["score_raw"] for r in scorecard.predict_frame(raw, model).collect()}
    assert streamed == batch

    monitor = monitoring.build_monitor(model, raw_model_table, VERSIONS)
    path = str(tmp_path / "runs")
    for attempt in range(2):
        # A fresh checkpoint replays batch 0: it must be recognised, not recorded twice.
        q = stream.monitor_stream(stream.read_applications(spark, folder), monitor, path, str(tmp_path / f"cp{attempt}"), "s")
        q.awaitTermination(300)
    saved = runs.load_runs(spark, path).collect()
    assert [r["run_id"] for r in saved] == ["s-0"] and json.loads(saved[0]["payload"])["n_samples"] == 900


@pytest.mark.parametrize("name", ["gbt_fit", "gbt_contributions"])
def test_registered_trees_train_all_rounds(name, monkeypatch):
    import inspect

    from scoreweave.catalog import queries
    from scoreweave.models import trees

    class Fitted(Exception):
        pass

    signature, seen = inspect.signature(trees.fit_trees), {}

    def fit(*args, **settings):
        bound = signature.bind(*args, **settings)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Fitted

    monkeypatch.setattr(trees, "fit_trees", fit)
    monkeypatch.setattr(queries, "train_raw", lambda spark, sf: None)
    monkeypatch.setattr(queries, "apply_settings", lambda spark: None)
    with pytest.raises(Fitted):
        queries.REGISTRY[name](None, "")
    assert seen["rounds"] == 300
