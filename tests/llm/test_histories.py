"""Credit-history trie: brute force, hand-made cases, repeated and missing values, blocks of ids."""

import hashlib
import random

import pytest

from scoreweave import fixtures
from scoreweave.llm import histories

BUREAU = "sk_id_curr long, days_credit int, credit_active string, credit_day_overdue int, id string, path int"


def brute(applications, records):
    """The nodes by listing every beginning of every history."""
    steps = {a: [] for a in applications if a is not None}
    for a, day, active, overdue in records:
        if a in steps:
            steps[a].append((day is not None, day or 0, (active, overdue)))
    histories_of = {a: tuple(x[2] for x in sorted(s, key=lambda x: x[:2])) for a, s in steps.items()}
    members, out = {}, {}
    for a, h in histories_of.items():
        for d in range(len(h) + 1):
            members.setdefault(h[:d], []).append(a)
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in members if q)]
        size = lambda p: sum(len(str(x).encode()) for x in p[-1] if x is not None) if p else 0
        saved = sum((len(members[p]) - 1) * size(p) for p in below)
        ends = sorted(a for a in own if histories_of[a] == path)
        out[min(own), len(path)] = (min(members[path[:-1]]) if path else None, len(own), len(children), len(leaves), saved, ends)
    return out


def found(trie):
    ends = {}
    for r in sorted(trie.ends.collect(), key=lambda r: r.block):
        assert 0 < len(r.ids) <= histories.BLOCK
        ends.setdefault((r.sk_id_curr, r.depth), []).extend(r.ids)
    rows = trie.nodes.collect()
    out = {
        (r.sk_id_curr, r.depth): (r.parent_sk_id_curr, r.n_applications, r.n_children, r.n_leaves, r.saved_bytes, ends.get((r.sk_id_curr, r.depth), []))
        for r in rows
    }
    assert len(out) == len(rows)
    digests = {(r.sk_id_curr, r.depth): r.ends_sha256 for r in histories.ends_digest(trie.ends).collect()}
    assert digests == {n: hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for n, e in ends.items()}
    return out


def tables(spark, applications, records):
    bureau = spark.createDataFrame([(*r, "clash", 7) for r in records], BUREAU)
    return spark.createDataFrame([(a,) for a in applications], "sk_id_curr long"), bureau


def test_equals_brute_force(spark):
    rng = random.Random(3)
    records = [
        (a, -day, rng.choice(["Active", "Closed", None, ""]), rng.choice([0, None]))
        for a in range(60) for day in rng.sample(range(100), rng.randrange(0, 6))
    ]
    records += [(None, -1, "Active", 0), (999, -1, "Active", 0), (3, None, "Sold", 1)]
    applications = [*range(60), 5, 5, None, -7]
    assert found(histories.history_trie(*tables(spark, applications, records))) == brute(applications, records)


def test_equal_histories_fill_blocks(spark):
    applications = list(range(0, 3000, 2))
    records = [(a, d, "Active", 0) for a in applications for d in (-2, -1)] + [(11, -2, "Active", 0)]
    out = found(histories.history_trie(*tables(spark, [*applications, 11], records)))
    assert out == {
        (0, 0): (None, 1501, 1, 1, 7 * 1500 + 7 * 1499, []), (0, 1): (0, 1501, 1, 1, 7 * 1500 + 7 * 1499, [11]),
        (0, 2): (0, 1500, 0, 1, 7 * 1499, applications),
    }


def test_long_histories_are_peeled_to_their_shared_depth(spark):
    rows = [(a, d, "Active" if d < cut else f"own {a}", 0) for a, cut, n in ((1, 40, 70), (2, 40, 70), (3, 5, 60), (4, 16, 16), (5, 16, 33), (6, 20, 20)) for d in range(n)]
    rows += [(7, d, "Active" if d < 5 else "own 3", 0) for d in range(60)]
    tables_ = tables(spark, range(1, 8), rows)
    assert found(histories.history_trie(*tables_)) == brute(range(1, 8), rows)
    enter = {r.id: (r.enter, r.depth) for r in histories._entries(histories._histories(*tables_, "days_credit", ["credit_active"], None, "sk_id_curr")).collect()}
    assert enter == {1: (64, 70), 2: (64, 70), 3: (16, 60), 4: (16, 16), 5: (32, 33), 6: (20, 20)}


def test_repeated_records_and_ties_do_not_depend_on_order(spark):
    rows = [(1, -5, "Closed", 0), (1, -5, "Active", 0), (1, -5, "Active", 0), (2, -5, "Active", 0), (2, -5, "Closed", 0), (2, -5, "Active", 0)]
    out = found(histories.history_trie(*tables(spark, [1, 2], rows)))
    assert out == found(histories.history_trie(*tables(spark, [2, 1], rows[::-1]))) and len(out) == 4
    assert out[1, 3][1] == 2 and out[1, 3][5] == [1, 2]


def test_empty_tables_and_wrong_ids(spark):
    applications, bureau = tables(spark, [], [])
    trie = histories.history_trie(applications, bureau)
    assert trie.nodes.count() == 0 and trie.ends.count() == 0 and histories.ends_digest(trie.ends).count() == 0
    assert found(histories.history_trie(tables(spark, [4, None], [])[0], bureau)) == {(4, 0): (None, 1, 0, 1, 0, [4])}
    with pytest.raises(ValueError, match="whole number"):
        histories.history_trie(applications.selectExpr("CAST(sk_id_curr AS STRING) AS sk_id_curr"), bureau)


def test_project_tables(spark):
    sf = "/root/testdata/sf0.001"
    application, bureau = fixtures.application(spark, sf), fixtures.bureau(spark, sf)
    trie = histories.history_trie(application, bureau, state=("credit_active",))
    root = trie.nodes.filter("depth = 0").first()
    assert root.n_applications == application.count() and root.parent_sk_id_curr is None
    assert trie.ends.selectExpr("sum(size(ids))").first()[0] == root.n_applications
    assert trie.nodes.filter("n_children = 0").count() == root.n_leaves
