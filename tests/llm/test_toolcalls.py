"""Tool calls: linking, order, validation and canonical JSON."""

import json
import random

import pytest

from scoreweave.llm import queries, toolcalls

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after string, repeats string"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMA = {
    "type": "object",
    "required": ["n"],
    "additionalProperties": False,
    "properties": {"n": {"type": "integer", "minimum": 1}, "s": {"type": ["string", "null"], "maxLength": 3}, "l": {"type": "array", "items": {"enum": [1, "a"]}}},
}


@pytest.mark.parametrize(
    ("value", "errors"),
    [
        ({"n": 1}, []), ({"n": 2.0, "s": None, "l": [1, "a"]}, []), ({}, ["$.n: missing"]), ([], ["$: not object"]), ({"n": True}, ["$.n: not integer"]),
        ({"n": 0, "s": "abcd"}, ["$.n: below minimum", "$.s: too long"]), ({"n": 1, "x": 1}, ["$.x: not allowed"]), ({"n": 1, "l": [1, 2]}, ["$.l[1]: not in enum"]),
    ],
)
def test_schema(value, errors):
    assert toolcalls.schema_errors(value, SCHEMA) == errors


def every(spark, calls, results, schemas=None, edges=None):
    c = spark.createDataFrame([(*x, "clash") for x in calls], CALLS)
    r = spark.createDataFrame(results, RESULTS)
    s = spark.createDataFrame(schemas if schemas is not None else [("f", json.dumps(SCHEMA)), ("bad", "{")], "name string, schema string")
    e = None if edges is None else spark.createDataFrame(edges, "conv_id long, call_id string, after string")
    return toolcalls.link_calls(c, r, s, e).collect()


def run(spark, *args):
    """First calls by id."""
    return {(x.conv_id, x.call_id): x for x in every(spark, *args) if x.status not in ("duplicate", "extra", "orphan")}


def test_linking_order_and_status(spark):
    good = '{"s":"ü", "n": 1}'
    calls = [
        (1, "a", 0, "f", good, None), (1, "b", 4, "f", good, "a"), (1, "c", 2, "f", good, "b"), (1, "d", 5, "f", "{}", "nowhere"),
        (1, "e", 6, "f", "not json", None), (1, "g", 7, None, None, None), (1, "h", 8, "bad", good, None), (1, "i", 9, "f", good, "i"),
        (1, "j", 1, "f", good, "k"), (1, "k", 1, "f", good, "j"), (2, "a", 3, "f", good, None), (2, "a", 1, "f", good, None), (2, "a", 1, "f", good, None),
        (3, "a", 5, "f", good, None), (None, "a", 0, "f", good, None), (4, None, 0, "f", good, None), (5, "x", 1, "f", '{"n": NaN}', None),
    ]
    results = [(1, "a", 1, "r1"), (1, "a", 1, "r2"), (1, "c", 3, None), (1, "z", 3, "orphan"), (3, "a", 2, "early"), (None, "a", 1, "x"), (1, "b", 9, "rb")]
    out = run(spark, calls, results)
    assert {k[1]: v.status for k, v in out.items() if k[0] == 1} == {
        "a": "ok", "b": "ok", "c": "ok", "d": "invalid", "e": "invalid", "g": "invalid", "h": "invalid", "i": "cycle", "j": "cycle", "k": "cycle",
    }
    assert [out[1, x].depth for x in "abcd"] == [0, 1, 2, 0]
    assert out[1, "a"].json == '{"arguments":{"n":1,"s":"ü"},"id":"a","name":"f","result":"r1"}'
    assert out[1, "e"].json is None and out[1, "g"].errors == ["no schema"] and out[1, "h"].errors == ["schema not usable"]
    assert out[2, "a"].status == "unanswered" and (out[2, "a"].repeats, out[2, "a"].turn) == (1, 1)
    rest = {(x.conv_id, x.call_id, x.status): x for x in every(spark, calls, results) if x.status in ("duplicate", "extra", "orphan")}
    assert set(rest) == {(2, "a", "duplicate"), (1, "a", "extra"), (1, "z", "orphan")}
    assert (rest[2, "a", "duplicate"].turn, rest[2, "a", "duplicate"].errors) == (3, []) and '"result":null' in rest[2, "a", "duplicate"].json
    assert rest[1, "a", "extra"].json == '{"arguments":null,"id":"a","name":null,"result":"r2"}' and rest[1, "z", "orphan"].result_turn == 3
    assert out[3, "a"].status == "early" and out[5, "x"].errors == ["$: not JSON"] and len(out) == 13


def test_long_chain_and_hot_conversation(spark):
    calls = [(1, f"c{i}", i, "f", '{"n":1}', f"c{i - 1}") for i in range(3000)]
    out = run(spark, calls, [(1, f"c{i}", i + 1, "x" * 10) for i in range(0, 3000, 2)])
    assert all(out[1, f"c{i}"].depth == i for i in range(3000))
    assert sum(r.status == "ok" for r in out.values()) == 1500


def longest_ways(names, edges):
    """Depths by plain rounds; calls on or behind a cycle stay out."""
    before = {n: {b for a, b in edges if a == n and b in names} for n in names}
    depth = {}
    while True:
        more = {n: max((depth[b] + 1 for b in before[n]), default=0) for n in names if n not in depth and before[n] <= set(depth)}
        if not more:
            return depth
        depth |= more


@pytest.mark.parametrize("seed", [1, 2])
def test_order_over_several_predecessors(spark, seed):
    rng = random.Random(seed)
    names = [f"c{i}" for i in range(60)]
    edges = [(a, rng.choice(names[:i])) for i, a in enumerate(names) if i for _ in range(rng.randrange(4))]
    edges += [("c50", "c55"), ("c55", "c50"), ("c7", "nowhere")] + edges[:5]
    want = longest_ways(set(names), edges)
    out = run(spark, [(1, n, 0, "f", '{"n":1}', None) for n in names], [], None, [(1, *e) for e in edges])
    assert {n: out[1, n].depth for n in names} == {n: want.get(n) for n in names}
    assert {n for n in names if out[1, n].status == "cycle"} == set(names) - set(want)
    assert len(want) < 60 and max(want.values()) > 3


def test_hot_identifier_keeps_every_call(spark):
    calls = [(1, "a", i, "f", '{"n":1}' if i % 2 else '{"n":0}', None) for i in range(2000)] * 2
    out = every(spark, calls, [(1, "a", 5000 + i, f"r{i}") for i in range(300)])
    assert sorted(x.turn for x in out if x.turn is not None) == list(range(2000))
    assert sum(x.status == "duplicate" for x in out) == 1999 and all(x.repeats == 1 for x in out if x.turn is not None)
    assert sum(x.status == "extra" for x in out) == 299 and sum(x.errors == ["$.n: below minimum"] for x in out) == 1000


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [(1, "a", 0, "f", "{}", None)], [], [])[1, "a"].errors == ["no schema"]


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    asked = {(r.conv_id, r.turn): r for r in turns if r.role != "assistant"}
    said = {(r.conv_id, r.turn): r.text for r in turns if r.role == "assistant"}
    found = queries.op10_tool_calls(spark, sf).collect()
    out = [r for r in found if r.turn is not None]
    assert len(out) == len(asked)
    alone = sorted((i, t, text) for (i, t), text in said.items() if (i, t - 1) not in asked)
    assert sorted((r.conv_id, r.result_turn, json.loads(r.json)["result"]) for r in found if r.turn is None) == alone
    for r in out:
        want = asked[r.conv_id, r.turn]
        back = json.loads(r.json)
        assert back["arguments"] == {"role": want.role, "text": want.text, "turn": want.turn}
        assert back["result"] == said.get((r.conv_id, r.turn + 1))
        assert r.json == json.dumps(back, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
