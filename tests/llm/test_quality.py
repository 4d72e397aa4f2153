"""Quality rules: base metrics against a brute-force count, limits against sorted values."""

import math
import re
from collections import Counter

import pytest

from scoreweave.llm import quality

SF = "/root/testdata/sf0.001"


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


CASES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two\x0bthree\x0cfour\x1cfive"), (5, "a b c d e f g h"),
    (6, "a b c d e f g h a b c d e f g h"), (7, "w " * 50), (8, "line\nline\n\n \nline\nother"), (9, "é😀# *| x" * 30),
    (10, " ".join(f"w{i % 37}" for i in range(500))), (10, "repeated id"), (None, "no id"), (11, "x" * 100000 + " y" * 9),
    (12, " ".join([f"p{i}" for i in range(12)] + ["gap"] + [f"p{i}" for i in range(3, 12)])),
]


def test_base_metrics_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", "clash") for i, t in CASES], "doc_id long, text string, lang string, source string, n_words string")
    rows = quality.judge(docs).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, *[r[c] for c in quality.BASE]) for r in rows)
    assert got == sorted((i is None, i or 0, *brute(t)) for i, t in CASES)
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.judge(docs).count() == 0


def marked(i, n):
    return " ".join(f"w{i}x{j}" + "#" * n for j in range(40))


def test_limits_follow_each_group(spark):
    calm = [(i, " ".join(f"w{i}x{j}" for j in range(39)) + " w" + "#" * (1 + i % 3), "en", "a") for i in range(150)]
    noisy = [(1000 + i, marked(i, i % 5 + 1), "en", "b") for i in range(150)]
    odd = [(5000, marked(7, 3), "en", "a"), (5001, marked(8, 3), "en", "b"), (5002, " ".join(f"zz{j}q" for j in range(40)), None, None)]
    docs = spark.createDataFrame(calm + noisy + odd, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(out[i].kept for i, *_ in calm + noisy)
    assert out[5000].failed_rules == ["symbols"] and not out[5000].kept
    assert out[5001].kept and out[5002].kept


SKETCHED = "l string, s string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def test_sketch_deciles_are_close(spark):
    import numpy as np

    x = np.random.default_rng(3).lognormal(1.5, 0.6, 3000)
    rows = spark.createDataFrame([("g", "s", 100, int(1e6 * v), 0, 1, 0, 0) for v in x], SKETCHED)
    found = quality.limits(quality.sketch(rows, ("l", "s")), "l", "s").first()
    v = np.sort(np.floor(1e6 * x) / 100)
    d1, d9 = v[299], v[2699]
    assert found["high_word_length"] == pytest.approx(d9 + quality.FENCE * (d9 - d1), rel=0.05)
    assert found["low_word_length"] == pytest.approx(d1 - quality.FENCE * (d9 - d1), rel=0.05)
    assert found["high_symbols"] is None and found["basis_symbols"] == 0


def test_no_fixed_value_decides_a_limit(spark):
    """Values ten times as large give limits ten times as large, for every metric."""
    rows = [("g", "s", 10**6, 10**7 + 999 * i, 10 * i, 10**6, 10 * i, 10 * i) for i in range(1, 201)]
    large = [("g", "s", w, 10 * c, 100 * y, n, 10 * d, 10 * r) for _, _, w, c, y, n, d, r in rows]
    one, ten = (quality.limits(quality.sketch(spark.createDataFrame(r, SKETCHED), ("l", "s")), "l", "s").first() for r in (rows, large))
    for m in quality.METRICS:
        # symbols are a share of the characters, so they grow a hundredfold above
        assert ten[f"high_{m}"] / one[f"high_{m}"] == pytest.approx(10, rel=0.05)


def test_zero_mode_takes_the_other_values(spark):
    rows = [("g", "s", 100, 500, 0, 10, 0, 0)] * 900 + [("g", "s", 100, 500, 0, 100, 10 + i % 11, 0) for i in range(110)]
    found = quality.limits(quality.sketch(spark.createDataFrame(rows, SKETCHED), ("l", "s")), "l", "s").first()
    assert found["basis_dup_lines"] == 110 and found["low_dup_lines"] == 0
    assert found["high_dup_lines"] == pytest.approx(0.19 + quality.FENCE * 0.08, rel=0.05)


def test_whole_table_base_metrics(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    for r in quality.judge(docs).collect():
        assert tuple(r[c] for c in quality.BASE) == want[r.doc_id]
