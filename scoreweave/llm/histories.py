"""Prefix trie of credit histories by truncation peeling.

A history is the sequence of an application's credit records, oldest first. Histories that begin alike
share the nodes of a trie. The trie is found from its deepest level upwards: the histories that end at a
depth join the nodes that survive from below, equal sequences are grouped, and the last record of every
node is stripped for the next level. All counts are added up in the same grouping that discovers the
nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ID
from ..session import shared_table_path
from .tools import stored

# Ids are listed in blocks of their value, so no row lists more ids than this.
BLOCK = 512
# Least depth from which a history that nobody shares is no longer peeled record by record.
ALONE = 16
# A parent's row reaches its children by way of so many parts at most.
SALTS = 1024
CHAIN = "array<struct<key: binary, upto: bigint>>"


class HistoryTrie(NamedTuple):
    """``nodes``: one row per node. ``ends``: the histories that end in a node, in blocks of ids."""

    nodes: DataFrame
    ends: DataFrame


def _digest(data: Column) -> Column:
    return F.unhex(F.substring(F.sha2(data, 256), 1, 32))


def _tagged(name: str) -> Column:
    """Text of a state column that no other value shares: its length and itself, ``n`` for null."""
    text = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("n"))


def _histories(
    application: DataFrame, bureau: DataFrame, order_col: str, state: Sequence[str], size_col: str | None, id_col: str
) -> DataFrame:
    """(id, chain, depth): one row per application with its records in order.

    A record of the chain is the digest ``key`` of the history up to it, and the bytes ``upto`` there.
    """
    sizes = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in state]
    size = reduce(lambda a, b: a + b, sizes) if size_col is None else F.coalesce(F.col(size_col), F.lit(0))
    told = [*state] if size_col is None else [*state, size_col]
    record = F.struct(
        F.col(order_col).alias("place"), _digest(F.concat(*map(_tagged, told)).cast("binary")).alias("digest"), size.cast("long").alias("size")
    )
    records = bureau.select(F.col(id_col).alias("id"), record.alias("record"))
    wanted = application.select(F.col(id_col).alias("id"), F.lit(True).alias("wanted")).distinct()
    both = records.withColumn("wanted", F.lit(None).cast("boolean")).unionByName(wanted, allowMissingColumns=True)
    ordered = F.sort_array(F.collect_list("record"))
    found = both.filter("id IS NOT NULL").groupBy("id").agg(ordered.alias("records"), F.max("wanted").alias("wanted"))

    def extended(chain: Column, record: Column) -> Column:
        last = F.try_element_at(chain, F.lit(-1))
        key = _digest(F.concat(F.coalesce(last["key"], F.lit(b"")), record["digest"]))
        return F.concat(chain, F.array(F.struct(key.alias("key"), (F.coalesce(last["upto"], F.lit(0)) + record["size"]).alias("upto"))))

    chain = F.aggregate("records", F.expr(f"CAST(array() AS {CHAIN})"), extended)
    return found.filter("wanted").select("id", chain.cast(CHAIN).alias("chain"), F.size("records").alias("depth"))


def _at(place: Column | int, field: str) -> Column:
    """Key or bytes of the chain after ``place`` records (one-based, from the end if negative); the root's if there are none."""
    place = F.lit(place) if isinstance(place, int) else place
    none = F.lit(b"") if field == "key" else F.lit(0).cast("long")
    return F.when(place == 0, none).otherwise(F.coalesce(F.try_element_at("chain", F.when(place != 0, place).cast("int"))[field], none))


def _entries(own: DataFrame) -> DataFrame:
    """Equal histories as one row, with the depth ``enter`` at which it joins the peeling.

    A history that shares its first 16, 32, 64, .. records with no different one is alone from there on: the nodes
    below form a plain path, and it enters with their sums. All others enter where they end.
    """
    merged = stored(own.groupBy(_at(-1, "key").alias("full"), "depth").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("chain").alias("chain")), "histories-merged")
    powers = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("depth") / ALONE)).cast("int")), lambda j: (F.lit(ALONE) * F.pow(F.lit(2), j)).cast("int"))
    marks = merged.filter(F.col("depth") >= ALONE).select("full", "chain", F.explode(powers).alias("place")).select("full", "place", _at(F.col("place"), "key").alias("key"))
    alone = marks.groupBy("key").agg(F.count("*").alias("sharing"), F.max("full").alias("full"), F.max("place").alias("place")).filter("sharing = 1")
    entered = merged.join(alone.groupBy("full").agg(F.min("place").alias("alone")), "full", "left")
    return entered.withColumn("enter", F.coalesce("alone", "depth"))


def history_trie(
    application: DataFrame,
    bureau: DataFrame,
    order_col: str = "days_credit",
    state: Sequence[str] = ("credit_active", "credit_day_overdue"),
    size_col: str | None = None,
    id_col: str = ID,
) -> HistoryTrie:
    """The trie of the credit histories of all applications.

    A history holds the records of ``bureau`` with the application's id, by ``order_col`` (null first,
    ties in the order of a digest of the record). Two records are equal if their ``state`` columns are
    (and ``size_col``, the bytes of a record, where it is named; else its state's UTF-8 bytes count).

    ``nodes``: ``sk_id_curr`` (smallest application whose history starts with the node's records),
    ``depth`` (number of records, 0 for the root), ``parent_sk_id_curr`` (null for the root),
    ``n_applications``, ``n_children``, ``n_leaves`` (childless nodes of its subtree, itself included) and
    ``saved_bytes`` (summed over its subtree: the bytes of each node's last record, times the
    applications beyond the first). A node is named by ``sk_id_curr`` and ``depth``.
    ``ends``: ``sk_id_curr``, ``depth`` and the ascending ``ids`` of the histories that end there, in
    rows of at most ``BLOCK`` ids, ordered by ``block``.

    Applications without a record end in the root. Records of no listed application, and null ids,
    are left out; repeated ids of ``application`` count once, repeated records each. Null states are
    states of their own, further columns are ignored, no application gives no node. One round and one
    written table a depth: at most 16 rounds, or twice the records that two different histories begin
    with; what only one history has below that is added at once. A row carries the digests (24 bytes a
    record) of its path. Counts combine before each shuffle, so a common beginning is no hot key; parents
    reach their children in salted parts.
    """
    spark = application.sparkSession
    if dict(application.dtypes).get(id_col) not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{id_col} must be a whole number")
    own = stored(_histories(application, bureau, order_col, state, size_col, id_col), "histories")
    path = shared_table_path(spark, "history-entries")
    entries = _entries(own)
    entries.write.partitionBy("enter").parquet(path)
    entries = spark.read.schema(entries.schema).parquet(path)

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    plain = F.col("depth") > F.col("enter")
    below = F.when(plain, (F.col("n") - 1) * (_at(-1, "upto") - _at(F.col("enter"), "upto"))).otherwise(zero)
    flag = F.when(plain, one).otherwise(zero)
    deepest = entries.agg(F.max("enter")).first()[0]
    levels: list[str] = []
    alive, schema = None, None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        rows = entries.filter(F.col("enter") == depth).select(
            F.slice("chain", 1, depth).alias("chain"), "id", "n", flag.alias("children"), flag.alias("leaves"), below.alias("saved")
        )
        if alive is not None:
            stripped = alive.select(F.slice("chain", 1, depth).alias("chain"), "id", "n", one.alias("children"), "leaves", "saved")
            rows = rows.unionByName(stripped)
        sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
        level = rows.groupBy(_at(-1, "key").alias("key")).agg(F.first("chain").alias("chain"), F.min("id").alias("id"), *sums)
        last = _at(depth, "upto") - _at(max(depth - 1, 0), "upto")
        level = level.select(
            "chain", F.lit(depth).alias("depth"), "key", _at(depth - 1, "key").alias("parent_key") if depth else F.lit(None).cast("binary").alias("parent_key"),
            "id", "n", "children", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).alias("leaves"), (F.col("saved") + (F.col("n") - 1) * last).alias("saved"),
        )
        levels.append(shared_table_path(spark, f"history-level-{depth}"))
        level.write.parquet(levels[-1])
        schema = level.schema
        alive = spark.read.schema(schema).parquet(levels[-1])

    if not levels:
        long = dict(application.dtypes)[id_col]
        nodes = f"{id_col} {long}, depth int, parent_{id_col} {long}, n_applications long, n_children long, n_leaves long, saved_bytes long"
        return HistoryTrie(
            spark.createDataFrame([], nodes), spark.createDataFrame([], f"{id_col} {long}, depth int, block long, ids array<{long}>")
        )
    peeled = spark.read.schema(schema).parquet(*levels).drop("chain").withColumn("salt", F.pmod(F.hash("key"), F.lit(SALTS)))
    parts = peeled.filter("depth > 0").select("parent_key", "salt").distinct()
    parents = peeled.select(F.col("key").alias("parent_key"), F.col("id").alias("parent_id"))
    linked = peeled.join(parts.join(parents, "parent_key"), ["parent_key", "salt"], "left")
    names = ("key", "id", "depth", "parent_id", "n", "children", "leaves", "saved")
    tail = entries.filter(plain).select("*", F.explode(F.sequence(F.col("enter") + 1, F.col("depth"))).alias("place"), _at(-1, "upto").alias("end"))
    tails = tail.select(
        _at(F.col("place"), "key").alias("key"), "id", F.col("place").alias("depth"), F.col("id").alias("parent_id"), "n",
        F.when(F.col("place") < F.col("depth"), one).otherwise(zero).alias("children"), one.alias("leaves"),
        ((F.col("n") - 1) * (F.col("end") - _at(F.col("place") - 1, "upto"))).alias("saved"),
    )
    nodes = linked.select(*names).unionByName(tails.select(*names))
    told = nodes.select(
        F.col("id").alias(id_col), "depth", F.col("parent_id").alias(f"parent_{id_col}"), F.col("n").alias("n_applications"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_bytes"),
    )
    ended = own.select("id", _at(-1, "key").alias("key"), F.floor(F.col("id") / BLOCK).alias("block"))
    blocks = ended.groupBy("key", "block").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    ending = peeled.select("key", "id", "depth").unionByName(tails.filter("children = 0").select("key", "id", "depth"))
    ends = blocks.join(ending, "key").select(F.col("id").alias(id_col), "depth", "block", "ids")
    return HistoryTrie(told, ends)


def ends_digest(ends: DataFrame, id_col: str = ID) -> DataFrame:
    """(``sk_id_curr``, ``depth``, ``ends_sha256``): SHA-256 of a node's ids, ascending and comma-joined.

    A node's blocks are hashed in order as they stream through a task; only the state of the hash is
    held. No blocks give no row, repeated blocks are hashed again.
    """
    kind = dict(ends.dtypes)[id_col]

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, at, state = [id_col, "depth", "ends_sha256"], None, None
        for batch in batches:
            done = []
            for *node, ids in zip(batch[id_col], batch["depth"], batch["listed"], strict=True):
                if node == at:
                    state.update(b",")
                else:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = node, hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=names)
        if at is not None:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=names)

    listed = ends.select(id_col, "depth", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("listed"))
    ordered = listed.repartition(id_col, "depth").sortWithinPartitions(id_col, "depth", "block")
    return ordered.mapInPandas(hashed, f"{id_col} {kind}, depth int, ends_sha256 string")
