import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreweave.operators import bootstrap, calibration, drift, ordered, policy, ranking, split


def scored(spark, y, p, w=None):
    rows = [(i, int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, p, w if w is not None else np.ones(len(y))))]
    return spark.createDataFrame(rows, "sk_id_curr long, y int, p double, w double")


def brute(y, p, w):
    """Independent check: pairwise AUC, thresholds for KS and AP."""
    y, p, w = map(np.asarray, (y, p, w))
    bad, good = y == 1, y == 0
    wins = (p[bad][:, None] > p[good][None, :]) + 0.5 * (p[bad][:, None] == p[good][None, :])
    auc = (w[bad][:, None] * w[good][None, :] * wins).sum() / (w[bad].sum() * w[good].sum())
    ks = ap = last = 0.0
    for t in np.unique(p)[::-1]:
        over = p >= t
        tpr, fpr = w[over & bad].sum() / w[bad].sum(), w[over & good].sum() / w[good].sum()
        ks = max(ks, abs(tpr - fpr))
        ap += (tpr - last) * (w[over & bad].sum() / w[over].sum() if w[over].sum() else 0.0)
        last = tpr
    return auc, ks, ap


def sample(n=600, seed=3):
    rng = np.random.default_rng(seed)
    p = np.round(rng.uniform(size=n), 2)
    p[: n // 3] = 0.37  # a third of the rows share one value
    y = (rng.uniform(size=n) < p).astype(int)
    return y, p, rng.integers(0, 4, n).astype(float)


@pytest.mark.parametrize("edges", [[], [0.1, 0.37, 0.5, 0.9]])
def test_metrics_against_brute_force(spark, edges):
    y, p, w = sample()
    df = scored(spark, y, p, w)
    assert np.allclose(tuple(ranking.ranking_metrics(df, "y", "p", edges=edges).first()), brute(y, p, np.ones(len(y))))
    assert np.allclose(tuple(ranking.ranking_metrics(df, "y", "p", "w", edges=edges).first()), brute(y, p, w))


def test_metrics_known_cases(spark):
    assert tuple(ranking.ranking_metrics(scored(spark, [0, 0, 1, 1], [0.9, 0.8, 0.2, 0.1]), "y", "p").first())[:2] == (0.0, 1.0)
    row = ranking.ranking_metrics(scored(spark, [0, 1, 1, 0], [0.3] * 4), "y", "p").first()
    assert (row["auc"], row["ks"], row["average_precision"]) == (0.5, 0.0, 0.5)


def test_metric_guards(spark):
    with pytest.raises(Exception, match="both label classes"):
        ranking.ranking_metrics(scored(spark, [1, 1], [0.1, 0.2]), "y", "p").collect()
    with pytest.raises(Exception, match="probability"):
        ranking.ranking_metrics(scored(spark, [1, 0], [0.1, float("nan")]), "y", "p").collect()
    with pytest.raises(Exception, match="label"):
        ranking.ranking_metrics(scored(spark, [1, 2], [0.1, 0.2]), "y", "p").collect()


def test_bucket_edges_and_cumulative_order(spark):
    y, p, _ = sample(900, 8)
    df = scored(spark, y, p)
    edges = ordered.bucket_edges(df, "p", 100)
    assert len(edges) > 3
    rows = ordered.cumulative(df.withColumn("one", F.lit(1)), "p", ["one"], (), True, edges).orderBy(F.desc("p")).collect()
    values = np.unique(p)[::-1]
    assert [r["p"] for r in rows] == list(values)
    assert [r["cum_one"] for r in rows] == [int((p >= v).sum()) for v in values]
    assert {r["total_one"] for r in rows} == {900}


@pytest.mark.parametrize("edges", [[], [0.2, 0.5]])
def test_capacity_keeps_ties(spark, edges):
    row = ranking.capacity_threshold(scored(spark, [0] * 5, [0.1, 0.9, 0.5, 0.5, 0.5]), "p", 0.4, edges).first()
    assert (row["target_count"], row["threshold"], row["flagged_count"]) == (2, 0.5, 4)


def test_calibration_hand_calculated(spark):
    df = scored(spark, [1, 0, 0, 0, 1, 1, 1, 0], [0.25] * 4 + [0.75] * 4)
    assert [r["observed_rate"] for r in calibration.calibration_bins(df, "y", "p", 2).orderBy("bin").collect()] == [0.25, 0.75]
    row = calibration.calibration_summary(df, "y", "p", 2).first()
    assert (row["ece"], row["brier"], row["bias"]) == (0.0, 0.1875, 0.0)
    rows = calibration.calibration_bins(scored(spark, [0, 0, 1], [0, 0.5, 1]), "y", "p", 4).orderBy("bin").collect()
    assert [r["n_samples"] for r in rows] == [1, 1, 0, 1]
    assert rows[2]["observed_rate"] is None and rows[2]["empty_bin"] and not rows[2]["small_bin"]
    assert calibration.calibration_summary(scored(spark, [0, 0, 1], [0, 0.5, 1]), "y", "p", 4).first()["endpoint_count"] == 2


P6, Y6 = [0.01, 0.02, 0.02, 0.10, 0.20, 0.80], [0, 0, 1, 0, 1, 1]


def test_policy_curve_hand_calculated(spark):
    a = policy.UtilityAssumptions(100, 300, 5)
    row = policy.evaluate_fixed_rule(scored(spark, Y6, P6), "y", "p", policy.ApprovalRule("threshold", 0.02), a).first()
    assert (row["approved_count"], row["approved_event_count"], row["scenario_utility"]) == (3, 1, -115.0)
    assert row["predicted_scenario_utility"] == pytest.approx(265.0)
    decided = scored(spark, Y6, P6).orderBy("sk_id_curr").select(policy.ApprovalRule("threshold", 0.02).decide("p").alias("d"))
    assert [r["d"] for r in decided.collect()] == [True, True, True, False, False, False]
    none = policy.evaluate_fixed_rule(scored(spark, Y6, P6), "y", "p", policy.ApprovalRule("reject_all", None), a).first()
    assert (none["approved_count"], none["approved_event_rate"], none["scenario_utility"]) == (0, None, 0.0)


def test_zero_threshold_is_not_reject_all(spark):
    curve = policy.policy_curve(scored(spark, [0, 1], [0.0, 1.0]), "y", "p", [0.0])
    rows = {(r["rule_mode"], r["threshold"]): r["approved_count"] for r in curve.collect()}
    assert rows == {("reject_all", None): 0, ("threshold", 0.0): 1, ("threshold", 1.0): 2}


def test_long_grid_equals_short_grid(spark, monkeypatch):
    y, p, _ = sample(300)
    df, grid = scored(spark, y, p), [i / 50 for i in range(51)]
    short = sorted(map(tuple, policy.policy_curve(df, "y", "p", grid).collect()), key=str)
    monkeypatch.setattr(policy, "CASE_LIMIT", 3)
    long = sorted(map(tuple, policy.policy_curve(df, "y", "p", grid).collect()), key=str)
    assert [r[:5] for r in short] == [r[:5] for r in long]


def test_policy_selection(spark):
    a = policy.UtilityAssumptions(100, 1000, 5)
    free = policy.PolicyRequirements(0.0, 1.0, 1, False)
    curve = policy.policy_curve(scored(spark, [0, 0, 1, 1], [0.01, 0.02, 0.4, 0.8]), "y", "p", [0.01, 0.02, 0.4], a)
    rule, row = policy.select_policy(curve, free)
    assert (rule.threshold, row["scenario_utility"]) == (0.02, 190.0)
    tied = policy.policy_curve(scored(spark, [0, 1], [0.05, 0.9]), "y", "p", [0.1, 0.2], a)
    assert policy.select_policy(tied, free)[0].threshold == 0.1
    with pytest.raises(policy.NoFeasiblePolicyError):
        policy.select_policy(tied, policy.PolicyRequirements(0.0, 0.0, 100))


@pytest.mark.parametrize(
    "make",
    [
        lambda: policy.UtilityAssumptions(0, 1, 1),
        lambda: policy.UtilityAssumptions(1, -1, 1),
        lambda: policy.UtilityAssumptions(True, 1, 1),
        lambda: policy.ApprovalRule("threshold", 1.5),
        lambda: policy.ApprovalRule("reject_all", 0.1),
        lambda: policy.ApprovalRule("other", 0.1),
        lambda: policy.PolicyRequirements(min_approved_count=0),
        lambda: policy.threshold_grid([]),
        lambda: policy.threshold_grid([2.0]),
    ],
)
def test_policy_parameter_guards(make):
    with pytest.raises(ValueError):
        make()


def values(spark, xs):
    return spark.createDataFrame([(None if x is None else float(x),) for x in xs], "x double")


def test_psi_cases(spark):
    reference = drift.fit_reference(values(spark, [0] * 8 + [1] * 2), ["x"], 5, 1e-4)
    same = drift.psi_summary(values(spark, [0] * 80 + [1] * 20), reference).first()
    assert same["psi"] == pytest.approx(0.0, abs=1e-12)
    moved = drift.psi_summary(values(spark, [0] * 2 + [1] * 8), reference).first()
    r, c = [(s + 1e-4) / (1 + 3e-4) for s in (0.8, 0.2, 0)], [(s + 1e-4) / (1 + 3e-4) for s in (0.2, 0.8, 0)]
    assert moved["psi"] == pytest.approx(sum((b - a) * (math.log(b) - math.log(a)) for a, b in zip(r, c)))
    constant = drift.fit_reference(values(spark, [5] * 4), ["x"])
    above = drift.psi_summary(values(spark, [100] * 4), constant).first()
    assert above["psi"] == pytest.approx(0.0, abs=1e-12)
    assert (above["above_max_share"], above["below_min_share"]) == (1.0, 0.0)
    empty = drift.fit_reference(values(spark, [None] * 3), ["x"])
    seen = drift.psi_summary(values(spark, [1, None]), empty).first()
    assert (seen["new_bin_share"], seen["above_max_share"], seen["current_missing_rate"]) == (0.5, None, 0.5)


def test_split_quotas_and_order(spark):
    rows = [(i, int(i % 4 == 0), float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "sk_id_curr long, target int, x double")
    first = {r[0]: r["partition"] for r in split.stratified_split(df).collect()}
    again = {r[0]: r["partition"] for r in split.stratified_split(df.orderBy(F.desc("x")).repartition(3)).collect()}
    assert first == again
    got = {r["partition"]: (r["n_rows"], r["n_bad"]) for r in split.split_quality(split.stratified_split(df)).collect()}
    assert got == {"train": (72, 18), "valid": (24, 6), "test": (24, 6)}
    check = split.partition_check(split.stratified_split(df), df).first()
    assert tuple(check) == (0, 0, 0)
    with pytest.raises(ValueError):
        split.stratified_split(df.filter("target = 0"))
    with pytest.raises(ValueError):
        split.stratified_split(df, valid_size=0.6, test_size=0.5)
    with pytest.raises(Exception, match="duplicated"):
        split.stratified_split(df.union(df))


def test_deep_hash_cuts_equal_plain_ranking(spark):
    df = spark.range(5000).select(F.col("id").alias("sk_id_curr"), F.lit(0).alias("c"))
    keys = sorted(r["h"] for r in df.select(split.hash_key("sk_id_curr", 7).alias("h")).collect())
    counts = split.bucket_counts(df, 7)
    cuts = split.hash_cuts(df, counts, {0: [1, 2500, 4999]}, 7, rank_limit=1)
    assert cuts == {(0, k): keys[k - 1] for k in (1, 2500, 4999)}
    big = split.seeded_sample(df, 10_001, 7).count()
    assert big == 5000


def test_first_rows_per_group(spark):
    df = spark.range(3000).select(F.col("id").alias("sk_id_curr"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("partition"))
    got = split.first_per_group(df, 5).groupBy("partition").agg(F.sort_array(F.collect_list("sk_id_curr")).alias("ids")).collect()
    assert {r["partition"]: r["ids"] for r in got} == {"a": [0, 3, 6, 9, 12], "b": [1, 2, 4, 5, 7]}


def test_bootstrap_properties(spark):
    y, p, _ = sample(300, 11)
    df = scored(spark, y, p).withColumn("q", F.col("p"))
    result = bootstrap.paired_bootstrap(df, "y", "p", "q", 25, seed=1)
    for r in result.summary.collect():
        assert r["difference_value"] == r["difference_lower"] == r["difference_upper"] == 0.0
        assert r["base_lower"] <= r["base_upper"]
    point = {r["metric"]: r["base_value"] for r in result.summary.collect()}
    assert np.allclose([point[m] for m in ranking.METRICS], brute(y, p, np.ones(300)))
    slots = bootstrap.slot_indices(spark, {0: 7, 1: 5}, 4, 1).groupBy("draw", "y").count().collect()
    assert {(r["draw"], r["y"]): r["count"] for r in slots} == {(d, c): n for d in range(4) for c, n in ((0, 7), (1, 5))}
    assert result.metadata["quality_notes"]
    with pytest.raises(ValueError):
        bootstrap.paired_bootstrap(df, "y", "p", "q", 1)


def test_bootstrap_draw_against_numpy(spark):
    """Every draw recomputed by hand from the indices it used."""
    y, p, _ = sample(120, 4)
    q = np.clip(p + np.linspace(-0.2, 0.2, 120).round(2), 0, 1)
    df = scored(spark, y, p).join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(q)], "sk_id_curr long, q double"), "sk_id_curr")
    result = bootstrap.indexed_bootstrap(df, "y", "p", "q", 3, seed=2)
    index = {(r["y"], r["idx"]): r["sk_id_curr"] for r in bootstrap.dense_index(df, "y", 2).collect()}
    sizes = {0: int((y == 0).sum()), 1: int((y == 1).sum())}
    weights = np.zeros((3, 120))
    for r in bootstrap.slot_indices(spark, sizes, 3, 2).collect():
        weights[r["draw"], index[r["y"], r["idx"]]] += 1
    for r in result.draws.collect():
        w = weights[r["draw"]]
        assert np.allclose([r[f"base_{m}"] for m in ranking.METRICS], brute(y, p, w))
        assert np.allclose([r[f"challenger_{m}"] for m in ranking.METRICS], brute(y, q, w))


def test_indexed_sums_equal_the_join_of_slots(spark, monkeypatch):
    """Several blocks, chunks and flushes: sums by probability equal those of slots joined with the index."""
    monkeypatch.setattr(bootstrap, "INDEX_ROWS", 16)
    monkeypatch.setattr(bootstrap, "HELD_PAIRS", 50)
    monkeypatch.setattr(bootstrap, "DRAWS", 2)
    rows = spark.range(101).select(
        F.col("id").alias("sk_id_curr"), (F.col("id") % 3 == 0).cast("int").alias("y"),
        (F.col("id") % 7 / 10).cast("double").alias("base"), (F.col("id") % 11 / 20).cast("double").alias("challenger"),
    )
    index = bootstrap.dense_index(rows, "y", 5).select("y", "idx", "base", "challenger").cache()
    sizes = {0: 67, 1: 34}
    order = ["draw", "model", "p"]
    sums = lambda df: [tuple(r) for r in df.groupBy(*order).agg(F.sum("bad"), F.sum("good")).orderBy(*order).collect()]
    joined = bootstrap._long(bootstrap.slot_indices(spark, sizes, 5, 5).join(index, ["y", "idx"]))
    assert sums(bootstrap.indexed_sums(index, sizes, 5, 5)) == sums(joined)


def test_registered_bootstrap_takes_all_draws(monkeypatch):
    import inspect

    from scoreweave.catalog import oracle, queries

    class Called(Exception):
        pass

    signature, seen = inspect.signature(bootstrap.indexed_bootstrap), {}

    def run(*args, **settings):
        bound = signature.bind(*args, **settings)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Called

    monkeypatch.setattr(bootstrap, "indexed_bootstrap", run)
    monkeypatch.setattr(queries.fixtures, "scored", lambda spark, sf: None)
    monkeypatch.setattr(queries, "apply_settings", lambda spark: None)
    with pytest.raises(Called):
        queries.REGISTRY["bootstrap_intervals"](None, "")
    assert seen["n_bootstrap"] == 2000
    assert "range(2000) d(draw)" in oracle.statements()["bootstrap_intervals"]


def test_counts_of_a_draw_against_hashlib():
    """Digests of numbered texts, counts over several runs and parts of a draw, and their two-bit form."""
    import hashlib

    for prefix, first, n in (("42:7:0:", 0, 10), ("42:1999:1:", 990, 10), (f"{2**32 - 1}:{10**18}:1:", 10**18, 5)):
        words = bootstrap.numbered_digests(prefix, first, n)
        got = [b"".join(int(w[k]).to_bytes(4, "little") for w in words) for k in range(n)]
        assert got == [hashlib.md5(f"{prefix}{first + k}".encode()).digest() for k in range(n)]
    for size in (2, 7, 25, 1001):
        want = np.zeros(size, np.uint8)
        for slot in range(size):
            digest = hashlib.md5(f"42:3:1:{slot // 2}".encode()).hexdigest()
            want[int(digest[16 * (slot % 2) :][:15], 16) % size] += 1
        pairs = -(-size // 2)
        parts = [bootstrap.taken(42, 3, 1, size, ends, 64) for ends in ((0, pairs // 2), (pairs // 2, pairs))]
        assert (bootstrap.taken(42, 3, 1, size, (0, pairs), 64) == want).all() and (sum(parts) == want).all()
    counts = np.array([9, 0, 3, 4, 255, 1], np.uint8)
    assert (bootstrap.unpacked_counts(*bootstrap.packed_counts(counts), 6) == counts).all()


def test_bootstrap_tree_splits_every_draw_exactly(spark):
    """Weights of all blocks add up to the class size, have the moments of a multinomial and repeat."""
    rows = np.array([0, 3, 3, 10, 11, 20])
    shares = np.array([bootstrap.block_share(rows, b, 20, 4000, (7, 0, 1)) for b in range(5)])
    assert (shares.sum(axis=0) == 20).all() and (shares[1] == 0).all()
    for b, size in enumerate(np.diff(rows)):
        assert abs(shares[b].mean() - size) < 0.2 and abs(shares[b].var() - size * (1 - size / 20)) < 0.5
    covariance = np.cov(shares[0], shares[4])[0, 1]
    assert abs(covariance + 3 * 9 / 20) < 0.3


def test_bootstrap_by_tree_against_numpy(spark):
    """Every draw recomputed from the weights of the blocks, over many small blocks."""
    y, p, _ = sample(200, 6)
    q = np.clip(p + np.linspace(-0.2, 0.2, 200).round(2), 0, 1)
    schema = "sk_id_curr long, y int, p double, q double"
    df = spark.createDataFrame([(i, int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, p, q))], schema)
    result = bootstrap.paired_bootstrap(df, "y", "p", "q", 60, seed=3, block_cells=20)
    draws = {r["draw"]: r for r in result.draws.collect()}
    again = bootstrap.paired_bootstrap(df.repartition(5), "y", "p", "q", 60, seed=3, block_cells=20)
    assert {r["draw"]: r for r in again.draws.collect()} == draws and sorted(draws) == list(range(60))
    rows = df.selectExpr("y", "p AS base", "q AS challenger")
    blocks = bootstrap.cell_blocks(rows, 20)
    assert blocks.count() > 3
    sizes = {0: int((y == 0).sum()), 1: int((y == 1).sum())}
    sums = bootstrap.drawn_sums(blocks, sizes, 60, 3).toPandas()
    for (draw, model), own in sums.groupby(["draw", "model"]):
        assert own.bad.sum() == sizes[1] and own.good.sum() == sizes[0]
        values = np.concatenate([own.p, own.p])
        labels = np.repeat([1, 0], len(own))
        want = brute(labels, values, np.concatenate([own.bad, own.good]))
        name = ("base", "challenger")[model]
        assert np.allclose([draws[draw][f"{name}_{m}"] for m in ranking.METRICS], want)
