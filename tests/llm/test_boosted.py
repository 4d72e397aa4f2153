"""Histogram boosting: splits against brute force, walks of the arrays, held-out accuracy, statistics of texts."""

import math
import random

import numpy as np
import pytest

from scoreweave.functions.columns import RAW_COLUMNS
from scoreweave.llm import boosted, queries
from scoreweave.models import histogram

SF = "/root/testdata/sf0.01"


def brute_gain(x, g, h, penalty, min_rows):
    """Largest gain over all features, bounds between values and sides of the missing rows."""
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + penalty)
    best = 0.0
    for f in range(x.shape[1]):
        absent = np.isnan(x[:, f])
        for bound in np.unique(x[~absent, f]):
            for side in (False, True):
                left = np.where(absent, side, x[:, f] <= bound)
                if min(left.sum(), (~left).sum()) >= min_rows:
                    best = max(best, score(left) + score(~left) - score(np.ones(len(g), bool)))
    return best


def test_every_split_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    x[rng.random((300, 3)) < 0.15] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=9) + rng.normal(0, 2, 300) > 6).astype(int)
    rows = [(*(None if math.isnan(v) else float(v) for v in r), int(t)) for r, t in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, target int").repartition(3)
    model = boosted.fit_boosted(df, ("a", "b", "c"), rounds=3, depth=3, min_rows=15, least_gain=0.0)
    z = np.full(300, model.start)
    for t in range(len(model.leaves)):
        p = 1 / (1 + np.exp(-z))
        g, h, node = p - y, p * (1 - p), np.zeros(300, int)
        for level in range(3):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = node == k
                want = brute_gain(x[own], g[own], h[own], 1.0, 15) if own.any() else 0.0
                assert model.gains[t, k] == pytest.approx(want, abs=1e-8)
            used = model.feature[t, node]
            value = x[np.arange(300), used]
            left = np.where(np.isnan(value), model.missing_left[t, node], value <= model.threshold[t, node])
            node = 2 * node + 2 - left
        for k in np.unique(node):
            own = node == k
            if model.gains[t, (k - 1) // 2] > 0:
                assert model.leaves[t, k - 7] == pytest.approx(-0.3 * g[own].sum() / (h[own].sum() + 1))
        z += model.leaves[t, node - 7]
    scored = boosted.score_boosted(df, model).collect()
    by_row = {r[:3]: r.predicted_bad_probability for r in scored}
    assert all(by_row[r[:3]] == pytest.approx(1 / (1 + math.exp(-v))) for r, v in zip(rows, z, strict=True))


def test_applications(spark, raw_model_table):
    model = boosted.fit_boosted(raw_model_table, rounds=12)
    out = boosted.score_boosted(raw_model_table, model).collect()
    assert model.columns == RAW_COLUMNS and len(out) == 900
    right = [(r.predicted_bad_probability >= 0.5) == r.target for r in out]
    assert sum(right) / len(right) > 0.85
    again = boosted.fit_boosted(raw_model_table.orderBy("ext_source_3"), rounds=12)
    assert np.allclose(model.leaves, again.leaves) and (model.feature == again.feature).all()


def test_edge_cases(spark):
    schema = "sk_id_curr long, x double, target int, predicted_bad_probability string"
    for rows, share in (([], 0.5), ([(1, 1.0, 1, "old")] * 4, 0.9), ([(1, 1.0, None, "old"), (2, 1.0, 0, "old")], 0.25), ([(1, 1.0, 7, "old")], 0.5)):
        df = spark.createDataFrame(rows, schema)
        model = boosted.fit_boosted(df, ("x",))
        out = boosted.score_boosted(df, model).collect()
        assert len(model.leaves) == 0 and len(out) == len(rows)
        assert all(r.predicted_bad_probability == pytest.approx(share) for r in out)
    rows = [(i, None if i % 2 else float("nan"), i % 2, "old") for i in range(60)] + [(None, 3.0, 1, "old")] * 60
    df = spark.createDataFrame(rows, schema)
    model = boosted.fit_boosted(df, ("x",), rounds=5)
    out = {r.x if r.x == 3.0 else None: r.predicted_bad_probability for r in boosted.score_boosted(df, model).collect()}
    assert out[3.0] > 0.9 and out[None] < 0.7
    assert boosted.score_boosted(df, boosted.fit_boosted(df, ())).count() == 120


def plain(text):
    """A few of the statistics, one text at a time."""
    data = (text or "").encode()
    words, lines = [w for w in data.split() if w], [x for x in data.split(b"\n") if x]
    share = lambda a, b: a / b if b else None
    pairs = list(zip(words, words[1:], strict=False))
    counts = [data.count(bytes([b])) for b in set(data)]
    return {
        "log_bytes": math.log1p(len(data)), "log_words": math.log1p(len(words)), "word_bytes": share(sum(map(len, words)), len(words)),
        "log_lines": math.log1p(len(lines)), "symbol_share": share(sum(data.count(c) for c in b"#*$%&|<>"), len(words)),
        "upper_share": share(sum(65 <= c < 91 for c in data), sum(65 <= c < 91 or 97 <= c < 123 for c in data)),
        "distinct_words": share(len(set(words)), len(words)), "top_word": share(max((words.count(w) for w in set(words)), default=0), len(words)),
        "echoed_words": share(sum(a == b for a, b in pairs), len(words)), "distinct_pairs": share(len(set(pairs)), len(pairs)),
        "repeated_lines": share(len(lines) - len(set(lines)), len(lines)), "closed_lines": share(sum(x[-1:] in (b".", b"!", b"?", b":", b";", b'"', b"'", b")") for x in lines), len(lines)),
        "shouted_words": share(sum(sum(65 <= c < 91 for c in w) >= 2 and not any(97 <= c < 123 for c in w) for w in words), len(words)),
        "capital_words": share(sum(65 <= w[0] < 91 for w in words), len(words)),
        "byte_entropy": -sum(c / len(data) * math.log2(c / len(data)) for c in counts),
    }


def test_statistics_equal_plain_counts(spark):
    rng = random.Random(5)
    bag = ["ab", "AB", "Zé", "x!", "#1", "longerthanfourteen", "\n", "\n\n", "end.", '"q"', "(b)", " ", "\t"]
    texts = [" ".join(rng.choices(bag, k=rng.randrange(0, 80))) for _ in range(80)]
    texts += [None, "", " ", "\n", "one", "a a a a", "word " * 300_000, "w" * 3_000_000, "é" * 10]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "one", "clash")], "doc_id long, text string, log_bytes string").repartition(3)
    out = boosted.text_statistics(docs).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        for name, value in plain(texts[r.doc_id] if r.doc_id is not None else "one").items():
            assert r[name] == (None if value is None else pytest.approx(value, abs=1e-9)), (r.doc_id, name)
    assert boosted.text_statistics(docs.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    found = queries.op13_quality_classifier(spark, SF)
    assert found.count() == 1000
    out = found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = [r.predicted == r.quality for r in out]
    assert len(right) > 80 and sum(right) / len(right) > 0.95
