"""Near duplicates against all pairs of the same texts."""

import random

import pytest
from pyspark.sql import functions as F

from scoreweave.llm import neardup

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ")
    for c in "\t\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return set()
    k = min(4, len(words))
    return {(k, *words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows):
    """Classes of equal sets stand for their smallest key; links join the keys."""
    smallest = {}
    for key, text in rows:
        own = frozenset(shingles(text))
        if own and key is not None:
            smallest[own] = min(key, smallest.get(own, key))
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    classes = list(smallest)
    for i, a in enumerate(classes):
        for b in classes[:i]:
            if 100 * len(a & b) >= 80 * len(a | b):
                ra, rb = find(smallest[a]), find(smallest[b])
                root[max(ra, rb)] = min(ra, rb)
    out = []
    for key, text in rows:
        own = frozenset(shingles(text))
        out.append(((key is None, key or 0), len(own), find(smallest[own]) if own in smallest and key is not None else key))
    return sorted(out)


def check(spark, rows):
    docs = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, n_shingles int")
    out = neardup.near_duplicates(docs).collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in out)
    assert got == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def edited(words, rng, share):
    return " ".join(f"e{rng.random()}" if rng.random() < share else w for w in words)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two three"), (7, "ONE\ttwo\nthree"), (8, "a b c d"),
        (9, "a b c d e"), (10, long), (11, long + " more"), (12, long), (12, "repeated key"), (13, "repeated key"), (None, "a b c d"),
        (14, "é ü ß 漢"), (15, "É ü ß 漢"), (4, "one"),
    ]
    check(spark, rows)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("share", [0.01, 0.03, 0.08])
def test_large_group_of_edited_copies(spark, share):
    rng = random.Random(share)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(i, edited(base, rng, share)) for i in range(260)]
    rows += [(1000 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(60))) for i in range(60)]
    check(spark, rows)


def test_pairs_at_the_threshold(spark):
    rows = []
    for i in range(120):
        words = [f"p{i}x{j}" for j in range(93)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[: 93 - i % 22], *[f"q{i}y{j}" for j in range(i % 22)]]))]
    check(spark, rows)


def test_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_trees_reach_the_recall():
    assert neardup.trees_for(0.9999) >= 12
    assert neardup.trees_for(0.9, 0.95) < neardup.trees_for(0.9999, 0.95)


def test_branching_and_blocks_lose_nothing(spark, monkeypatch):
    """Tiny limits, so that nodes branch, go to tasks, and are compared in several blocks."""
    for name, value in (("PAIRED", 3), ("CAPACITY", 12), ("MAX_DEPTH", 2), ("BLOCK_BYTES", 4000)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = [(i, edited(base, rng, rng.choice([0.005, 0.02, 0.05]))) for i in range(150)]
    rows += [(500 + i, " ".join([*base[:30], *[f"x{rng.randrange(10**6)}" for _ in range(60)]])) for i in range(60)]
    check(spark, rows)


def test_spanning_links_join_all_components():
    import numpy as np
    import pandas as pd

    rng = random.Random(3)
    sets = []
    for _ in range(60):
        own = set(rng.sample(range(40), 30))
        sets += [own, own | {100 + rng.randrange(9)}, own - {rng.choice(sorted(own))}]
    packed = [np.array(sorted(s), np.uint64).tobytes() for s in sets]
    links = neardup.spanning_links(pd.DataFrame({"rec": range(len(sets)), "set": packed}), 80)
    root = list(range(len(sets)))
    full = list(range(len(sets)))

    def joined(to, a, b):
        x, y = to[a], to[b]
        for i, r in enumerate(to):
            if r == x:
                to[i] = y

    for a, b in zip(links["a"], links["b"], strict=True):
        assert 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
        joined(root, a, b)
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                joined(full, a, b)
    same = lambda to: {tuple(i for i, r in enumerate(to) if r == x) for x in set(to)}
    assert same(root) == same(full) and len(links) < len(sets)


def test_likely_loses_nothing(spark):
    rows = spark.range(20000).withColumnRenamed("id", "rec").withColumn("_x", F.lit(1))
    wanted = spark.range(0, 20000, 40).withColumnRenamed("id", "rec")
    left = neardup.likely(rows, "rec", wanted)
    assert left.join(wanted, "rec").count() == 500 and left.count() < 600 and left.columns == ["rec", "_x"]


def test_trees_meet_at_the_largest_depth(spark, monkeypatch):
    """Every node of two branches to the largest depth; a thousand pairs at the very threshold."""
    for name, value in (("PAIRED", 2), ("CAPACITY", 1)):
        monkeypatch.setattr(neardup, name, value)
    rows = []
    for i in range(1000):
        words = [f"p{i}x{j}" for j in range(93)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:83], *[f"q{i}y{j}" for j in range(10)]]))]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in out if r.component_id != r.doc_id - r.doc_id % 2] == []


def test_missed_pairs_by_simulation():
    import numpy as np

    rng, n, depth = np.random.default_rng(8), 20000, 5

    def meet(agree, level):
        if level == depth:
            return np.ones(len(agree), bool)
        first = rng.integers(64, size=len(agree))
        second = (first + 1 + rng.integers(63, size=len(agree))) % 64
        rows, twice = np.arange(len(agree)), rng.random(len(agree)) < neardup.SECOND_BRANCH
        out = np.zeros(len(agree), bool)
        for chosen in (agree[rows, first], agree[rows, second] & twice):
            out[chosen] |= meet(agree[chosen], level + 1)
        return out

    agree = rng.random((n, 64)) < 0.8
    found = np.zeros(n, bool)
    for tree in range(8):
        on = np.flatnonzero(agree[:, tree])
        found[on] |= meet(agree[on], 1)
    assert (~found).mean() == pytest.approx(neardup.missed(8, 0.8, depth), rel=0.12)
    assert neardup.missed(neardup.trees_for(0.9999), 0.8, 6) <= 1e-4 < neardup.missed(12, 0.8, 6)
    assert neardup.bits_for(0.8) == 22 and neardup.bits_for(0.5) > 22
    with pytest.raises(ValueError, match="coordinates"):
        neardup.trees_for(0.9999, 0.5)


def test_many_equal_rows_are_one_record(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.range(50_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    near = spark.createDataFrame([(9, text + " end"), (11, "something else in a text")], "doc_id long, text string")
    out = neardup.near_duplicates(docs.unionByName(near)).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(map(tuple, out)) == [(7, 7, True, 50_000), (9, 7, False, 1), (11, 11, True, 1)]


def test_stars_leave_the_rest_to_the_exact_comparison(spark, monkeypatch):
    """Two groups that share a node by a common passage, and a chain whose ends are not alike."""
    monkeypatch.setattr(neardup, "STAR", 5)
    rng = random.Random(5)
    common = [f"p{i}" for i in range(120)]
    rows = []
    for group in range(2):
        own = [f"g{group}w{i}" for i in range(60)]
        rows += [(100 * group + i, edited(common + own, rng, 0.01)) for i in range(40)]
    words = [f"c{i}" for i in range(200)]
    for step in range(30):
        words[step * 6 : step * 6 + 3] = [f"s{step}x{j}" for j in range(3)]
        rows.append((1000 + step, " ".join(words)))
    check(spark, rows)
