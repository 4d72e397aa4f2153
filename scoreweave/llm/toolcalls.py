"""Tool calls of conversations: linked to their results, ordered, validated, written as canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tools import stored

# JSON schema types and the Python values they stand for.
TYPES = {
    "object": dict,
    "array": list,
    "string": str,
    "boolean": bool,
    "null": type(None),
    "integer": int,
    "number": (int, float),
}


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks and no escapes beyond the necessary; NaN is refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def schema_errors(value: object, schema: object, at: str = "$") -> list[str]:
    """Where ``value`` breaks ``schema``: type, enum, const, bounds, lengths, required, properties, items."""
    if schema is True or not isinstance(schema, dict):
        return [] if schema is not False else [f"{at}: not allowed"]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    is_number = isinstance(value, int | float) and not isinstance(value, bool)
    fits = lambda k: isinstance(value, TYPES.get(k, ())) and (k == "boolean" or not isinstance(value, bool))
    if kinds and not any(fits(k) or (k == "integer" and is_number and value == int(value)) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        found.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        found.append(f"{at}: not the constant")
    if is_number:
        found += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    sized = {str: ("minLength", "maxLength"), list: ("minItems", "maxItems")}.get(type(value))
    if sized:
        found += [f"{at}: too short"] * (len(value) < schema.get(sized[0], 0)) + [f"{at}: too long"] * (len(value) > schema.get(sized[1], len(value)))
    if isinstance(value, list) and "items" in schema:
        found += [e for i, x in enumerate(value) for e in schema_errors(x, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        found += [e for k in sorted(value) for e in schema_errors(value[k], own.get(k, schema.get("additionalProperties", True)), f"{at}.{k}")]
    return found


@lru_cache(maxsize=256)
def _parsed(text: str) -> object:
    return json.loads(text)


def _no_constant(text: str) -> None:
    raise ValueError(text)


def judged(
    name: str | None, call_id: str, arguments: str | None, schema: str | None, result: str | None, is_call: bool = True
) -> tuple[list[str], str | None]:
    """Errors of one call and its canonical JSON (null if the arguments are not JSON); a mere result has no errors."""
    if not is_call:
        return [], canonical({"arguments": None, "id": call_id, "name": None, "result": result})
    try:
        value = json.loads(arguments or "{}", parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return ["$: not JSON"], None
    if schema is None:
        found = ["no schema"]
    else:
        try:
            found = schema_errors(value, _parsed(schema))
        except (ValueError, TypeError, AttributeError):
            found = ["schema not usable"]
    return found, canonical({"arguments": value, "id": call_id, "name": name, "result": result})


def depths(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``conv``, ``call``, ``depth``: the longest way to a call over ``edges`` (``conv``, ``call``, ``after``); null behind a cycle.

    ``calls`` (``conv``, ``call``) has each call once; edges to calls that are not there do not count. Runs of
    calls with one predecessor are walked by pointer doubling, up to their anchor: a call with none or with several
    predecessors. A million calls in a row take 20 joins. Anchors with several predecessors are settled
    level by level, once the anchors of all their predecessors are, so the rounds are as many as
    such anchors on one way.
    """
    there = calls.select("conv", F.col("call").alias("after"))
    links = stored(edges.select("conv", "call", "after").distinct().join(there, ["conv", "after"]), "edges")
    degree = links.groupBy("conv", "call").agg(F.count(F.lit(1)).alias("n_before"), F.min("after").alias("one"))
    placed = calls.select("conv", "call").join(degree, ["conv", "call"], "left")
    single = F.col("n_before") == 1
    rows = placed.select(
        "conv", "call", F.when(single, F.col("one")).otherwise(F.col("call")).alias("anchor"), F.when(single, F.col("one")).alias("next"),
        F.when(single, 1).otherwise(0).cast("long").alias("steps"), F.coalesce("n_before", F.lit(0)).alias("n_before"),
    )
    rows = stored(rows, "depths")
    limit, rounds = rows.count(), 0
    while 2**rounds <= limit and not rows.filter("next IS NOT NULL").isEmpty():
        ahead = rows.select("conv", F.col("call").alias("next"), F.col("anchor").alias("n_anchor"), F.col("next").alias("n_next"), F.col("steps").alias("n_steps"))
        open_rows = rows.filter("next IS NOT NULL").join(ahead, ["conv", "next"])
        moved = open_rows.select("conv", "call", F.col("n_anchor").alias("anchor"), F.col("n_next").alias("next"), (F.col("steps") + F.col("n_steps")).alias("steps"), "n_before")
        rows = stored(rows.filter("next IS NULL").unionByName(moved), "depths")
        rounds += 1
    ended = rows.filter("next IS NULL")
    known = ended.filter("n_before = 0").select("conv", F.col("call").alias("anchor"), F.lit(0).cast("long").alias("depth"))
    merging = ended.filter("n_before > 1").select("conv", F.col("call").alias("merge"), "n_before")
    if not merging.isEmpty():
        before = links.select("conv", F.col("call").alias("merge"), F.col("after").alias("call"))
        # Predecessors behind a cycle have no anchor: their merge is never complete.
        needed = merging.join(before, ["conv", "merge"]).join(ended.select("conv", "call", "anchor", "steps"), ["conv", "call"])
        needed = stored(needed.select("conv", "merge", "n_before", "anchor", "steps"), "merges")
        known = stored(known, "levels")
        # Few values for each waiting call: predecessors still to come, longest way so far.
        waiting = needed.groupBy("conv", "merge").agg(F.max("n_before").alias("left"), F.lit(0).cast("long").alias("longest"))
        fresh = known
        while not fresh.isEmpty():
            came = needed.join(fresh, ["conv", "anchor"]).groupBy("conv", "merge").agg(
                F.count(F.lit(1)).alias("n"), F.max(F.col("depth") + F.col("steps") + 1).alias("way")
            )
            waiting = waiting.join(came, ["conv", "merge"], "left").select(
                "conv", "merge", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), F.greatest("longest", F.coalesce("way", F.lit(0))).alias("longest")
            )
            waiting = stored(waiting, "waiting")
            fresh = waiting.filter("left = 0").select("conv", F.col("merge").alias("anchor"), F.col("longest").alias("depth"))
            known = stored(known.unionByName(fresh), "levels")
            waiting = waiting.filter("left > 0")
    named = known.withColumnRenamed("depth", "start")
    found = rows.join(named, ["conv", "anchor"], "left")
    return found.select("conv", "call", F.when(F.col("next").isNull(), F.col("start") + F.col("steps")).alias("depth"))


def firsts(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Each different row once, with ``copies`` and whether it is the ``first`` of its keys (the smallest fields).

    The mark comes by a union and one more grouping by all columns, not by a join on the keys, so
    an identifier with a third of all rows is spread over the tasks.
    """
    different = rows.groupBy(*keys, *fields).agg(F.count(F.lit(1)).alias("copies"))
    smallest = different.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("_f")).select(*keys, "_f.*")
    both = different.withColumn("first", F.lit(0)).unionByName(smallest.select("*", F.lit(0).cast("long").alias("copies"), F.lit(1).alias("first")))
    marked = both.groupBy(*keys, *fields).agg(F.sum("copies").alias("copies"), F.max("first").alias("first"))
    return marked.withColumn("first", F.col("first") == 1)


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row per different call, and one per different result that answers no call.

    ``calls`` has ``conv_id``, ``call_id``, ``turn``, ``name``, ``arguments`` (JSON text) and ``after`` (a
    call of the same conversation whose result it uses, or null), ``results`` has ``conv_id``,
    ``call_id``, ``turn``, ``content``, and ``schemas`` has ``name``, ``schema`` (JSON schema text). ``edges``
    (``conv_id``, ``call_id``, ``after``) names further calls whose results a call uses.

    Returns ``conv_id``, ``call_id``, ``turn``, ``name``, ``depth`` (the most calls one after another before it),
    ``result_turn``, ``repeats``, ``errors``, ``status`` and ``json``. Sorted by (``conv_id``, ``depth``, ``turn``,
    ``call_id``) every call stands after all those it follows. ``status`` is the first that holds of ``orphan`` (a
    result without a call), ``extra`` (a further result of an id), ``duplicate`` (a further call of an id),
    ``cycle``, ``invalid``, ``unanswered``, ``early`` (the result comes before the call) and ``ok``.

    Calls and results meet in a hash join by (``conv_id``, ``call_id``). On both sides only the first row of an
    identifier joins, so an identifier that holds a third of all rows neither multiplies nor lands
    whole in one task, and a conversation is never collected. Its order is given by columns, not by a
    list.

    Calls or results with a null conversation or id are left out: nothing can be linked. Null arguments
    are an empty object, null names have no schema. The first call of an id is the one with the earliest turn
    (then the smallest name, arguments, predecessor); others are ``duplicate`` rows, validated and serialised without a
    result, order or depth. Equal rows are one, their number less one is ``repeats``. Of the results of an id the earliest
    (then the smallest) is linked. Rows of results have their turn in ``result_turn``, and null ``turn``, ``name`` and ``depth``.
    Empty tables give an empty result. Further columns are not read. General: the scoring tables of
    this library hold no conversations.
    """
    keys = ["conv_id", "call_id"]
    named = lambda df: df.filter("conv_id IS NOT NULL AND call_id IS NOT NULL")
    asked = stored(firsts(named(calls), keys, ["turn", "name", "arguments", "after"]), "calls")
    said = stored(firsts(named(results).select(*keys, F.col("turn").alias("result_turn"), "content"), keys, ["result_turn", "content"]), "results")
    own = asked.filter("first")
    pairs = own.select(*keys, "after")
    pairs = pairs if edges is None else pairs.unionByName(named(edges).select(*keys, "after"))
    ids = {"conv_id": "conv", "call_id": "call"}
    place = depths(own.select(*keys).withColumnsRenamed(ids), pairs.filter("after IS NOT NULL").withColumnsRenamed(ids))
    place = place.withColumnsRenamed({v: k for k, v in ids.items()})
    answer = said.filter("first").select(*keys, "result_turn", "content", F.lit(1).alias("answered"), F.col("copies").alias("r_copies"))
    linked = own.withColumn("called", F.lit(1)).join(answer, keys, "full_outer").join(place, keys, "left")
    kind = F.when(F.col("called").isNull(), "orphan")
    linked = linked.select(
        *keys, "turn", "name", "arguments", "depth", "result_turn", "content", "answered", F.coalesce("copies", "r_copies").alias("copies"), kind.alias("kind")
    )
    further = asked.filter("NOT first").select(*keys, "turn", "name", "arguments", "copies", F.lit("duplicate").alias("kind"))
    extra = said.filter("NOT first").select(*keys, "result_turn", "content", "copies", F.lit("extra").alias("kind"))
    rows = linked.unionByName(further, allowMissingColumns=True).unionByName(extra, allowMissingColumns=True)
    known = schemas.filter("name IS NOT NULL").groupBy("name").agg(F.min("schema").alias("schema"))
    rows = rows.join(known, "name", "left")

    @F.pandas_udf("errors array<string>, json string")
    def checked(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            yield pd.DataFrame([judged(*row) for row in zip(*columns, strict=True)], columns=["errors", "json"])

    is_call = F.coalesce(~F.col("kind").isin("orphan", "extra"), F.lit(True))
    made = rows.withColumn("j", checked.asNondeterministic()("name", "call_id", "arguments", "schema", "content", is_call))
    status = (
        F.when(F.col("kind").isNotNull(), F.col("kind"))
        .when(F.col("depth").isNull(), "cycle")
        .when(F.size("j.errors") > 0, "invalid")
        .when(F.col("answered").isNull(), "unanswered")
        .when(F.col("result_turn") < F.col("turn"), "early")
        .otherwise("ok")
    )
    return made.select(
        *keys, "turn", "name", "depth", "result_turn", (F.col("copies") - 1).alias("repeats"), F.col("j.errors").alias("errors"),
        status.alias("status"), F.col("j.json").alias("json"),
    )


# Schema of the only tool of a plain chat: the user asks, the assistant answers.
REPLY = canonical(
    {
        "type": "object",
        "required": ["role", "text"],
        "properties": {"role": {"enum": ["user", "system"]}, "text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    }
)


def chat_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain chats (``conv_id``, ``turn``, ``role``, ``text``).

    Each turn that is not the assistant's is a call of ``reply`` named by its turn; it follows the
    call two turns before. An assistant turn is the result of the call one turn before it.
    """
    name = lambda n: F.concat(F.lit("call-"), F.col("turn") - n)
    asked = F.coalesce(F.col("role") != "assistant", F.lit(True))
    arguments = F.to_json(F.struct("role", "text", "turn"), {"ignoreNullFields": "false"})
    calls = turns.filter(asked).select(
        "conv_id", name(0).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), name(2).alias("after")
    )
    results = turns.filter(~asked).select("conv_id", name(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
