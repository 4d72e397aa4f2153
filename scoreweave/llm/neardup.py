"""Near duplicates by a chosen-path set similarity join over word shingles.

Every document is a set of shingles and carries 64 minwise tokens of it. A tree starts with all
documents and sends each to the node of one minwise token; a node with many documents chooses one or two
further tokens (by its path, so alike for all its documents) and branches again. Small nodes are
compared exhaustively. Similar documents take the same path often, others part; independent trees are
repeated until a pair at the threshold meets with the target recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, NumericType

from .tools import LOWER, shingle_hashes, stored, word_hashes

COORDINATES = 64
SECOND_BRANCH = 0.25
# Nodes of at most PAIRED documents give pairs, blocks of about STAR in larger ones first give pairs with one
# document. Nodes of at most CAPACITY are compared inside one task; larger ones branch, and what is still larger at
# MAX_DEPTH is compared in blocks of that size.
PAIRED = 10
STAR = 200
CAPACITY = 2000
BLOCK_BYTES = 16 << 20
MAX_DEPTH = 6
# Share of the pairs at the threshold that the bit sketch may pass over.
BITS_MISSED = 2.5e-8
PROFILE = "n_shingles long, k1 long, k2 long, sketch long, coords array<int>"

_FACTORS = np.random.default_rng(20240229).integers(1, 1 << 32, (COORDINATES, 1), dtype=np.uint32) | np.uint32(1)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, one of none has none."""
    words = word_hashes((text or "").encode(), LOWER)
    if not len(words):
        return words
    values = np.sort(shingle_hashes(words, min(size, len(words))))
    return values[np.append(True, values[1:] != values[:-1])]


def minwise(values: np.ndarray) -> np.ndarray:
    """The minwise token of each coordinate: least value under a multiplication modulo 2^32."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 4096):
        np.minimum(least, (short[None, i : i + 4096] * _FACTORS).min(axis=1), out=least)
    return least


def missed(trees: int, similarity: float, depth: int) -> float:
    """Share of the pairs at ``similarity`` that meet in no node of ``depth`` of ``trees`` trees.

    Exact: all trees share the coordinates of a pair, so the number of agreeing ones is summed over, and
    of those the number among the roots, which are different coordinates.
    """
    total, c = 0.0, COORDINATES
    for a in range(c + 1):
        both, one = a * (a - 1) / (c * (c - 1)), 2 * a * (c - a) / (c * (c - 1))
        met = 1.0
        for _ in range(depth - 1):
            met = (1 - SECOND_BRANCH) * a / c * met + SECOND_BRANCH * (both * (1 - (1 - met) ** 2) + one * met)
        roots = sum(math.comb(a, h) * math.comb(c - a, trees - h) * (1 - met) ** h for h in range(min(a, trees) + 1))
        total += math.comb(c, a) * similarity**a * (1 - similarity) ** (c - a) * roots / math.comb(c, trees)
    return total


def trees_for(recall: float, similarity: float = 0.8, depth: int | None = None) -> int:
    """Trees after which a pair at ``similarity`` has met in a node of ``depth`` (the largest) with probability ``recall``."""
    for trees in range(1, COORDINATES + 1):
        if missed(trees, similarity, depth or MAX_DEPTH) <= 1 - recall:
            return trees
    raise ValueError(f"{COORDINATES} coordinates do not reach a recall of {recall} at a similarity of {similarity}")


def bits_for(similarity: float) -> int:
    """Differing sketch bits above which a pair is passed over; a bit differs with probability (1 - similarity) / 2."""
    p, bits, over = (1 - similarity) / 2, COORDINATES, 0.0
    while bits and (over := over + math.comb(COORDINATES, bits) * p**bits * (1 - p) ** (COORDINATES - bits)) <= BITS_MISSED:
        bits -= 1
    return bits


def profiles(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``rec`` with set size, 128-bit set digest, bit sketch and minwise tokens of each row."""

    @F.pandas_udf(PROFILE)
    def profile(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bits = np.uint64(1) << np.arange(COORDINATES, dtype=np.uint64)
        for texts in batches:
            rows = []
            for t in texts:
                values = shingle_set(t, size)
                digest = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), "<i8")
                tokens = minwise(values)
                parity = (tokens * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint64)
                rows.append((len(values), *digest, (parity * bits).sum().view(np.int64), tokens.view(np.int32)))
            yield pd.DataFrame(rows, columns=["n_shingles", "k1", "k2", "sketch", "coords"])

    made = docs.select(F.col(key).alias("rec"), profile.asNondeterministic()(F.col(text)).alias("p"))
    return made.select("rec", "p.*")


def shingle_sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``rec`` with its sorted shingle hashes as one binary value."""

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, size).tobytes() for t in texts])

    return docs.select(F.col(key).alias("rec"), packed.asNondeterministic()(F.col(text)).alias("set"))


@F.pandas_udf(LongType())
def shared_shingles(left: pd.Series, right: pd.Series) -> pd.Series:
    """Size of the intersection of two packed sets."""

    def shared(a: bytes, b: bytes) -> int:
        both = np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
        both.sort(kind="stable")
        return int((both[1:] == both[:-1]).sum())

    return pd.Series([shared(a, b) for a, b in zip(left, right, strict=True)], dtype="int64")


def likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``; none that is in it is lost.

    A bitmap of 2^23 places in 256 blocks of 4 kB is all that is broadcast, whatever the tables hold.
    The last filter is always true; as row numbers depend on the rows before, it keeps a later semi-join
    behind the bitmap.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 23)) + 1
    blocks = wanted.groupBy(F.bitmap_bucket_number(place).alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    joined = rows.withColumn("_place", place).join(F.broadcast(blocks), F.bitmap_bucket_number("_place") == F.col("_block"))
    bit = F.bitmap_bit_position("_place").cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.filter(F.getbit(byte, bit % 8) == 1).select(*rows.columns).filter(F.monotonically_increasing_id() >= 0)


def _possible(a: str, b: str, percent: int) -> Column:
    """Size bound and bit sketch of a pair whose sides are the struct columns ``a`` and ``b``."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    bits = F.bit_count(F.col(f"{a}.sketch").bitwiseXOR(F.col(f"{b}.sketch")))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (bits <= bits_for(percent / 100))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``, sizes ``na``, ``nb``) whose full sets reach the threshold."""
    near = pairs.join(sets.select(F.col("rec").alias("a"), F.col("set").alias("sa")), "a")
    near = near.join(sets.select(F.col("rec").alias("b"), F.col("set").alias("sb")), "b")
    shared = near.withColumn("shared", shared_shingles.asNondeterministic()("sa", "sb"))
    return shared.filter(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def spanning_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that join the components of a group: full sets, all pairs of different components.

    Shingles that two or more members share become bits; a member is compared with those after it
    that are not yet in its component.
    """
    group = group.drop_duplicates(["rec", "set"], ignore_index=True)
    sets = [np.frombuffer(x, np.uint64) for x in group["set"]]
    sizes = np.array([len(x) for x in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    common = count[place] > 1
    bit = (np.cumsum(count > 1) - 1)[place[common]]
    bits = np.zeros((len(sets), int((count > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (row[common], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    component, links = np.arange(len(sets)), []
    for i in range(len(sets)):
        others = i + 1 + np.flatnonzero(component[i + 1 :] != component[i])
        others = others[100 * np.minimum(sizes[i], sizes[others]) >= percent * np.maximum(sizes[i], sizes[others])]
        shared = np.bitwise_count(bits[i] & bits[others]).sum(axis=1, dtype=np.int64)
        near = others[100 * shared >= percent * (sizes[i] + sizes[others] - shared)]
        joined, first = np.unique(component[near], return_index=True)
        links += [(i, k) for k in near[first]]
        component[np.isin(component, joined)] = component[i]
    left, right = np.array(links, np.int64).reshape(-1, 2).T
    return pd.DataFrame({"a": group["rec"].to_numpy()[left], "b": group["rec"].to_numpy()[right]})


def contracted(edges: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex that has a smaller one: ``rec``, ``root``.

    Rounds of hooking each vertex onto its smallest smaller neighbour, shortening the chains by pointer
    jumping, and contracting the edges; all as joins over written tables.
    """
    ordered = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = stored(ordered(edges), "edges")
    mapped = None
    while not edges.isEmpty():
        parents = stored(edges.groupBy(F.col("a").alias("rec")).agg(F.min("b").alias("root")), "parents")
        while True:
            above = parents.select(F.col("rec").alias("root"), F.col("root").alias("next"))
            joined = stored(parents.join(above, "root", "left"), "jumps")
            parents = joined.select("rec", F.coalesce("next", "root").alias("root"))
            if joined.filter("next is not null").isEmpty():
                break
        found = parents if mapped is None else _mapped(mapped, "root", parents).unionByName(parents)
        mapped = stored(found, "labels")
        edges = stored(ordered(_mapped(_mapped(edges, "a", parents), "b", parents)), "edges")
    return mapped if mapped is not None else edges.select(F.col("a").alias("rec"), F.col("b").alias("root"))


def _mapped(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by its root where it has one."""
    roots = labels.select(F.col("rec").alias(column), F.col("root").alias("_root"))
    return rows.join(roots, column, "left").withColumn(column, F.coalesce("_root", column)).select(*rows.columns)


def _grouped(rows: DataFrame, name: str) -> DataFrame:
    """Members of the nodes that two or more records reach, with the size of the node."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("total")).filter("size > 1")
    return stored(rows.join(sizes, "node"), name)


def _children(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Members of branching nodes, sent on by the one or two tokens that their node chooses."""
    draw = lambda salt: F.xxhash64("node", F.lit(salt))
    first = F.pmod(draw("first"), F.lit(COORDINATES))
    second = F.pmod(first + 1 + F.pmod(draw("second"), F.lit(COORDINATES - 1)), F.lit(COORDINATES))
    twice = F.pmod(draw("branches"), F.lit(1000)) < int(1000 * SECOND_BRANCH)
    chosen = F.when(twice, F.array(first, second)).otherwise(F.array(first)).cast("array<int>")
    joined = rows.select("node", "rec", "n_shingles", "sketch", chosen.alias("chosen")).join(records.select("rec", "coords"), "rec")
    return joined.select(
        F.explode(F.transform("chosen", lambda c: F.xxhash64("node", c, F.get("coords", c)))).alias("node"), "rec", "n_shingles", "sketch"
    )


def _roots(records: DataFrame, first: int, last: int) -> DataFrame:
    """Members of the root nodes of the trees ``first`` to ``last``."""
    node = F.explode(F.transform(F.slice("coords", first, last - first + 1), lambda c, i: F.xxhash64(i + (first - 1), c)))
    return _grouped(records.select("rec", "n_shingles", "sketch", node.alias("node")), "nodes")


def leaves(records: DataFrame, recall: float, similarity: float) -> DataFrame:
    """``node``, ``rec``, ``n_shingles``, ``sketch``, ``size``, ``total`` of the nodes where branching ends.

    A pair that shares a root among the first trees meets there, unless that root branches. Only members
    of such roots need the trees for the full depth; both ways to miss a pair add up to 1 - ``recall``.
    """
    some = trees_for((1 + recall) / 2, similarity, 1)
    every = max(some, trees_for(recall + missed(some, similarity, 1), similarity))
    rows = _roots(records, 1, some)
    branching = stored(rows.filter(F.col("size") > CAPACITY).select("rec").distinct(), "branching")
    if every > some and not branching.isEmpty():
        rows = rows.unionByName(_roots(records.join(branching, "rec", "left_semi"), some + 1, every))
    done = rows.filter(F.col("size") <= CAPACITY)
    for _ in range(MAX_DEPTH - 1):
        rows = rows.filter(F.col("size") > CAPACITY)
        if rows.isEmpty():
            return done
        rows = _grouped(_children(rows, records), "nodes")
        done = done.unionByName(rows.filter(F.col("size") <= CAPACITY))
    return done.unionByName(rows.filter(F.col("size") > CAPACITY))


def _stars(large: DataFrame, percent: int) -> DataFrame:
    """Possible pairs of each member of a larger node with the smallest record of its block of the node."""
    block = F.pmod(F.xxhash64("node", "l.rec"), F.ceil(F.col("size") / STAR))
    centre = F.first("l").over(Window.partitionBy("node", "block").orderBy("l.rec"))
    met = large.withColumn("block", block).select(centre.alias("c"), F.col("l").alias("m"))
    met = met.filter((F.col("c.rec") < F.col("m.rec")) & _possible("c", "m", percent))
    return met.select(F.col("c.rec").alias("a"), F.col("m.rec").alias("b"), F.col("c.n_shingles").alias("na"), F.col("m.n_shingles").alias("nb"))


def _needed_sets(members: DataFrame, needed: DataFrame, size: int, name: str) -> DataFrame:
    """Packed sets of the records in ``needed``, as a written table."""
    found = likely(members, "rec", needed).join(needed.hint("shuffle_hash"), "rec", "left_semi")
    return stored(shingle_sets(found, "rec", "text", size), name)


def _open_members(large: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(``node``, ``i``, ``k``, ``rec``): members with a possible partner in another component, dealt into block pairs.

    Nodes whose members are all in one component are left out by their least and greatest root.
    """
    rows = large.select("node", "size", "total", "l", F.col("l.rec").alias("rec"))
    rows = rows.join(labels, "rec", "left").withColumn("root", F.coalesce("root", "rec"))
    mixed = rows.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("node")
    blocks = F.greatest(F.ceil(F.col("size") / CAPACITY), F.ceil(8 * F.col("total") / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("rec"), F.col("blocks")).cast("int")
    rows = rows.join(mixed, "node", "left_semi").withColumn("blocks", blocks).withColumn("own", own)
    dealt = rows.select("node", "l", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = stored(dealt.select("node", "l", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("k")), "dealt")
    partner = dealt.select(*[F.col(c).alias(f"p_{c}") for c in ("node", "i", "k", "root")], F.col("l").alias("r"))
    same = (F.col("node") == F.col("p_node")) & (F.col("i") == F.col("p_i")) & (F.col("k") == F.col("p_k"))
    active = same & (F.col("root") != F.col("p_root")) & _possible("l", "r", percent)
    return stored(dealt.join(partner, active, "left_semi").select("node", "i", "k", F.col("l.rec").alias("rec")), "active")


def similar_links(records: DataFrame, members: DataFrame, size: int, percent: int, recall: float) -> DataFrame:
    """Links (``a``, ``b``) that join all components of similar records.

    ``records`` are class representatives (``rec``, ``n_shingles``, ``sketch``, ``coords``); ``members``
    holds texts under ``rec``. Pairs of small nodes, and of members of larger nodes with the smallest
    record of their block, are made distinct over the trees and confirmed one by one. Larger nodes
    that still hold several components are then compared exhaustively: members with a possible partner in
    another component go to one task a node, or one for each two blocks of a node, and come back as a
    spanning forest.
    """
    nodes = leaves(records, recall, percent / 100)
    side = F.struct("rec", "n_shingles", "sketch")
    small = nodes.filter(F.col("size") <= PAIRED).select("node", side.alias("l"))
    met = small.join(small.withColumnRenamed("l", "r"), "node").filter((F.col("l.rec") < F.col("r.rec")) & _possible("l", "r", percent))
    met = met.select(F.col("l.rec").alias("a"), F.col("r.rec").alias("b"), F.col("l.n_shingles").alias("na"), F.col("r.n_shingles").alias("nb"))
    large = nodes.filter(F.col("size") > PAIRED).select("node", "size", "total", side.alias("l"))
    pairs = stored(met.unionByName(_stars(large, percent)).distinct(), "pairs")
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("rec")).distinct(), "needed")
    links = stored(verified(pairs, _needed_sets(members, needed, size, "sets"), percent), "links")
    active = _open_members(large, contracted(links), percent)
    if active.isEmpty():
        return links
    sets = _needed_sets(members, stored(active.select("rec").distinct(), "needed"), size, "sets")
    kind = records.schema["rec"].dataType.simpleString()
    compared = active.join(sets, "rec").groupBy("node", "i", "k").applyInPandas(lambda g: spanning_links(g, percent), f"a {kind}, b {kind}")
    return stored(links.union(compared), "links")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = 4,
    percent: int = 80,
    recall: float = 0.9999,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_shingles``, ``component_id``, ``kept``.

    Two documents are linked if their sets of ``size``-word shingles have a Jaccard similarity of at
    least ``percent`` / 100, confirmed on the full sets; ``component_id`` is the smallest key reachable
    over links. Words are runs of bytes other than ASCII white space, with A-Z lower-cased.

    Equal sets are one class with one representative, so copies never meet. Node members are counted
    before they are joined, sets are read once more for records that have a possible partner, and
    every step is a written table below the shared folder. No node is dropped: see
    :func:`similar_links`. ``recall`` sets the number of trees for a pair at the very threshold,
    also where it must meet in a node of the largest depth.

    Texts that are null or have no word have no set and are linked with nothing. Texts of fewer
    words than a shingle are one shingle. Whole texts are used at any length. Repeated rows get
    a row each. Rows that repeat a key with another text each follow their own text; texts whose smallest key is
    the same are one. A null key has a null component and is kept. An empty table gives an empty table. Further columns are not read. General:
    the scoring tables of this library hold no prose.
    """
    base = docs.select(F.col(key).alias("rec"), F.col(text).alias("text"))
    rows = stored(profiles(base, "rec", "text", size), "profiles")
    filled = rows.filter("n_shingles > 0 AND rec IS NOT NULL")
    classes = stored(filled.groupBy("k1", "k2").agg(F.min("rec").alias("rec"), F.count(F.lit(1)).alias("copies")), "classes")
    named = filled.join(classes, ["rec", "k1", "k2"])
    repeated = named.filter("copies > 1").dropDuplicates(["rec", "k1", "k2"])
    once = named.filter("copies = 1").unionByName(repeated)
    records = stored(once.select("rec", "n_shingles", "sketch", "coords"), "records")
    labels = contracted(similar_links(records, base, size, percent, recall))
    of_class = classes.join(labels, "rec", "left").filter("copies > 1 OR root IS NOT NULL")
    of_class = of_class.select("k1", "k2", F.coalesce("root", "rec").alias("component_id"))
    joined = rows.select("rec", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    component = F.when(F.col("rec").isNotNull(), F.coalesce("component_id", "rec"))
    return joined.select(
        F.col("rec").alias(key), "n_shingles", component.alias("component_id"), F.col("rec").eqNullSafe(component).alias("kept")
    )


def _text_names(docs: DataFrame, key: str, text: str) -> Column:
    """Name of a row's key and text, ordered as the key is; null for a null key."""
    digest = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 4)
    kind = docs.schema[key].dataType
    if isinstance(kind, NumericType):
        return F.col(key).cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)") + digest.cast("decimal(19,0)")
    return F.concat(F.col(key).cast("string"), F.lit("\0"), F.lpad(F.hex(digest), 15, "0"))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of their group of near duplicates.

    Of rows that repeat a key and its text, one stays. Rows that repeat a key with another text are
    documents of their own: each stays or goes with its own text. Rows with a null key, or without a word,
    stay.
    """
    filled = docs.filter(F.col(key).isNotNull())
    again = stored(filled.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key), "repeats")
    if again.isEmpty():
        rows = near_duplicates(docs, key, text, **settings)
        return docs.join(rows.filter(~F.col("kept")).select(key), key, "left_anti")
    name = next(c for i in range(len(docs.columns) + 1) if (c := f"_name{i}") not in docs.columns)
    named = docs.withColumn(name, _text_names(docs, key, text))
    once = named.filter(F.col(key).isNotNull()).dropDuplicates([name]).unionByName(named.filter(F.col(key).isNull()))
    rows = near_duplicates(named.select(name, text), name, text, **settings)
    return once.join(rows.filter(~F.col("kept")).select(name).distinct(), name, "left_anti").select(*docs.columns)
