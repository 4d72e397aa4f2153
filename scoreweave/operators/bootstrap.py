"""Paired stratified bootstrap of ranking metrics, in two ways.

:func:`paired_bootstrap` splits the draws of a class down a tree of row blocks: a node's number is split
binomially between its halves, a block spreads its number over its rows. Every task walks from the root to
its own block with seeded generators, so no draw is ever listed row by row, joined or sent to the driver.

:func:`indexed_bootstrap` can be written as plain SQL: every draw takes as many slots as the class has rows
and maps each slot to a dense row index by hash. It hashes draws x rows slots. A task hashes whole draws and
counts how often each index is taken, in one byte a row of the class; two bits a row travel to the block of
rows that holds the index, which adds up its draws by probability.

One weight per (draw, row) drives both models either way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import guards
from ..functions.columns import ID
from ..session import written
from .ordered import bucket_edges, cumulative
from .ranking import METRICS, ranking_aggregates
from .split import hash_key

# Rows of a block of the dense index: offsets inside it take two bytes.
INDEX_ROWS = 1 << 16
# Pairs of slots hashed at once: their words stay in the cache of a core.
HELD_PAIRS = 1 << 15
# Pairs of slots for a task of its own, where there are draws enough.
TASK_PAIRS = 1 << 24
# MD5: start words, and per step the function, the place of its message word, the constant and the rotation.
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_STEPS = tuple(
    (i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16, int(abs(math.sin(i + 1)) * 2**32),
     ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[i // 16][i % 4])
    for i in range(64)
)
# The four counts of two bits in each byte.
FOUR_COUNTS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8).view("<u4").ravel()
# Hash prefix length in hex digits: 65,536 equal buckets per class.
PREFIX = 4
# Different (label, base, challenger) rows of a block, on average, and draws a task makes at once.
BLOCK_CELLS = 4096
DRAWS = 50
SUMS = (("draw", pa.int64()), ("model", pa.int32()), ("p", pa.float64()), ("bad", pa.int64()), ("good", pa.int64()))
CELLS = "block long, goods long, bads long, labels binary, base binary, challenger binary, times binary"


@dataclass(frozen=True)
class BootstrapResult:
    summary: DataFrame
    draws: DataFrame
    metadata: dict


def dense_index(df: DataFrame, y: str, seed: int, id_col: str = ID) -> DataFrame:
    """Add ``idx``: 0..n_c-1 inside each class, in hash order.

    Hash prefixes cut every class into equal buckets, so no task ranks a class.
    """
    keyed = df.withColumn("h", hash_key(id_col, seed)).withColumn("hb", F.substring("h", 1, PREFIX))
    starts = (
        keyed.groupBy(y, "hb")
        .agg(F.count("*").alias("n"))
        .withColumn(
            "start",
            F.coalesce(
                F.sum("n").over(Window.partitionBy(y).orderBy("hb").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select(y, "hb", "start")
    )
    within = F.row_number().over(Window.partitionBy(y, "hb").orderBy("h")) - 1
    return (
        keyed.withColumn("within", within)
        .join(starts, [y, "hb"])
        .withColumn("idx", F.col("start") + F.col("within"))
        .drop("h", "hb", "within", "start")
    )


def slot_digests(spark: SparkSession, sizes: dict[int, int], n_bootstrap: int, seed: int) -> DataFrame:
    """(draw, y, pair, digest): one hash serves the two slots of a pair."""
    parts = []
    for label, size in sizes.items():
        pairs = -(-size // 2)
        grid = spark.range(n_bootstrap * pairs).select(
            F.floor(F.col("id") / pairs).alias("draw"), F.lit(label).alias("y"), (F.col("id") % pairs).alias("pair")
        )
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "draw", F.lit(str(label)), "pair"))
        parts.append(grid.withColumn("digest", F.unhex(digest)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def pair_indices(batch: pa.RecordBatch, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(draw, y, index) of the slots of a batch: 15 hex digits of each half of a digest, modulo the class size."""
    draw, y, pair = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    digests = batch.column(3)
    words = np.frombuffer(digests.buffers()[2], ">u8")[2 * digests.offset :][: 2 * len(digests)].reshape(-1, 2)
    size = np.where(y == 1, sizes[1], sizes[0])
    index = ((words.astype(np.uint64) >> np.uint64(4)).astype(np.int64)) % size[:, None]
    real = (2 * pair[:, None] + np.arange(2)) < size[:, None]
    return np.repeat(draw, 2)[real.ravel()], np.repeat(y, 2)[real.ravel()], index[real]


def slot_indices(spark: SparkSession, sizes: dict[int, int], n_bootstrap: int, seed: int) -> DataFrame:
    """(draw, y, idx) for every slot."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draw, y, index = pair_indices(batch, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(draw), pa.array(y.astype(np.int32)), pa.array(index)], names=["draw", "y", "idx"])

    return slot_digests(spark, sizes, n_bootstrap, seed).mapInArrow(rows, "draw long, y int, idx long")


def numbered_digests(prefix: str, first: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """MD5 of ``prefix`` followed by each of ``count`` numbers from ``first`` on, all with as many digits: four words.

    The message is one block. Words without a digit are the same for all and go into the constants.
    """
    word = lambda value: np.array(value & 0xFFFFFFFF, np.uint32)
    head = prefix.encode()
    digits = len(str(first))
    message = bytearray(64)
    message[: len(head)] = head
    message[len(head) + digits] = 0x80
    message[56:] = (8 * (len(head) + digits)).to_bytes(8, "little")
    fixed = [int(w) for w in np.frombuffer(message, "<u4")]
    varied: dict[int, np.ndarray] = {}
    rest = np.arange(first, first + count, dtype=np.uint64)
    for at in range(len(head) + digits - 1, len(head) - 1, -1):
        tens = rest // np.uint64(10)
        digit = (rest - tens * np.uint64(10) + np.uint64(48)).astype(np.uint32) << word(8 * (at % 4))
        varied[at // 4] = varied[at // 4] | digit if at // 4 in varied else digit | word(fixed[at // 4])
        rest = tens
    a, b, c, d = (np.full(count, w, np.uint32) for w in MD5_START)
    f = np.empty(count, np.uint32)
    for kind, place, constant, turn in MD5_STEPS:
        if kind == 0:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif kind == 1:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif kind == 2:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        np.add(a, f, a)
        if place in varied:
            np.add(a, varied[place], a)
            np.add(a, word(constant), a)
        else:
            np.add(a, word(constant + fixed[place]), a)
        np.left_shift(a, word(turn), f)
        np.right_shift(a, word(32 - turn), a)
        np.bitwise_or(a, f, a)
        np.add(a, b, a)
        a, b, c, d = d, a, b, c
    return tuple(x + word(w) for x, w in zip((a, b, c, d), MD5_START, strict=True))


def taken(seed: int, draw: int, label: int, size: int, pairs: tuple[int, int], held: int) -> np.ndarray:
    """How often each index of a class of ``size`` rows is taken by the slots of ``pairs`` (first, end) of a draw."""
    prefix, counts = f"{seed}:{draw}:{label}:", np.zeros(size, np.uint8)
    at, end = pairs
    while at < end:
        run = min(held, end - at, 10 ** len(str(at)) - at)
        words = numbered_digests(prefix, at, run)
        for half in (0, 1):
            high, low = (words[2 * half + i].byteswap().astype(np.uint64) for i in (0, 1))
            number = (high << np.uint64(32) | low) >> np.uint64(4)
            # Only the last pair of a class can lack its second slot.
            number = number[: run - (2 * (at + run) - 1 + half > size)]
            index = (number - number // np.uint64(size) * np.uint64(size)).view(np.int64)
            np.add.at(counts, index, np.ones(len(index), np.uint8))
        at += run
    if int(counts.sum(dtype=np.int64)) != min(2 * end, size) - 2 * pairs[0]:
        raise OverflowError("an index is taken more than 255 times")
    return counts


def packed_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts up to three as two bits a row, and the offset of a row once for each time beyond."""
    over = np.flatnonzero(counts > 3)
    low = np.zeros(-(-len(counts) // 4) * 4, np.uint8)
    np.minimum(counts, 3, out=low[: len(counts)])
    low = low.reshape(-1, 4)
    bits = low[:, 0] | low[:, 1] << 2 | low[:, 2] << 4 | low[:, 3] << 6
    return bits.tobytes(), np.repeat(over, counts[over] - 3).astype("<u2").tobytes()


def unpacked_counts(bits: pa.Buffer | bytes, more: pa.Buffer | bytes, rows: int) -> np.ndarray:
    """The counts of :func:`packed_counts`."""
    counts = FOUR_COUNTS.take(np.frombuffer(bits, np.uint8)).view(np.uint8)[:rows]
    offsets = np.frombuffer(more, "<u2")
    np.add.at(counts, offsets.astype(np.intp), np.ones(len(offsets), np.uint8))
    return counts


def drawn_counts(spark: SparkSession, sizes: dict[int, int], n_bootstrap: int, seed: int) -> DataFrame:
    """(y, block, chunk, draw, counts, more): how often a draw, or a part of one, takes each row of a block.

    A draw is hashed by one task, or by several parts where there are fewer draws than cores.
    """
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, -(-2 * cores // n_bootstrap))
    pairs = {label: -(-size // 2) for label, size in sizes.items()}
    tasks = max(2 * cores, n_bootstrap * sum(pairs.values()) // TASK_PAIRS)
    block_rows, chunk_draws, held = INDEX_ROWS, DRAWS, HELD_PAIRS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                draw, part = divmod(unit, parts)
                for label, size in sizes.items():
                    ends = tuple(pairs[label] * i // parts for i in (part, part + 1))
                    if ends[0] == ends[1]:
                        continue
                    counts = taken(seed, draw, label, size, ends, held)
                    own = [packed_counts(counts[i : i + block_rows]) for i in range(0, size, block_rows)]
                    n = len(own)
                    columns = [
                        pa.array(np.full(n, label, np.int32)), pa.array(np.arange(n)), pa.array(np.full(n, draw // chunk_draws)),
                        pa.array(np.full(n, draw)), *(pa.array(x, pa.binary()) for x in zip(*own, strict=True)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["y", "block", "chunk", "draw", "counts", "more"])

    units = n_bootstrap * parts
    schema = "y int, block long, chunk long, draw long, counts binary, more binary"
    return spark.range(0, units, 1, min(units, tasks)).mapInArrow(deal, schema)


def index_blocks(index: DataFrame) -> DataFrame:
    """(y, block, base, base_codes, challenger, challenger_codes): rows of a block in order, as codes of its values."""
    rows = index.select(
        "y", F.floor(F.col("idx") / INDEX_ROWS).alias("block"), (F.col("idx") % INDEX_ROWS).cast("int").alias("offset"), "base", "challenger"
    )

    def pack(group: pa.Table) -> pa.Table:
        own = group.sort_by("offset")
        columns = {"y": own["y"][:1], "block": own["block"][:1]}
        for name in ("base", "challenger"):
            p, codes = np.unique(own[name].to_numpy(), return_inverse=True)
            columns |= {name: pa.array([p.tobytes()]), f"{name}_codes": pa.array([codes.astype("<u2").tobytes()])}
        return pa.table(columns)

    schema = "y int, block long, base binary, base_codes binary, challenger binary, challenger_codes binary"
    return rows.groupBy("y", "block").applyInArrow(pack, schema)


def indexed_sums(index: DataFrame, sizes: dict[int, int], n_bootstrap: int, seed: int) -> DataFrame:
    """(draw, model, p, bad, good): slots of every draw, summed by probability inside each block of the index."""
    chunks = F.sequence(F.lit(0).cast("long"), F.lit((n_bootstrap - 1) // DRAWS).cast("long"))
    blocks = index_blocks(index).withColumn("chunk", F.explode(chunks))

    def add_up(own: pa.Table, drawn: pa.Table) -> pa.Table:
        if not own.num_rows or not drawn.num_rows:
            return pa.table({n: pa.array([], t) for n, t in SUMS})
        y, draws = own["y"][0].as_py(), drawn["draw"].to_numpy()
        values = {m: np.frombuffer(own[m][0].as_buffer(), np.float64) for m in ("base", "challenger")}
        codes = {m: np.frombuffer(own[f"{m}_codes"][0].as_buffer(), "<u2").astype(np.intp) for m in values}
        sums = {m: np.empty((len(draws), len(p))) for m, p in values.items()}
        for i, (bits, more) in enumerate(zip(drawn["counts"], drawn["more"], strict=True)):
            weights = unpacked_counts(bits.as_buffer(), more.as_buffer(), len(codes["base"])).astype(np.float64)
            for m in values:
                sums[m][i] = np.bincount(codes[m], weights, len(values[m]))
        parts = []
        for model, m in enumerate(values):
            d, i = np.nonzero(sums[m])
            hits, none = sums[m][d, i].astype(np.int64), np.zeros(len(d), np.int64)
            columns = [draws[d], np.full(len(d), model, np.int32), values[m][i], *((hits, none) if y else (none, hits))]
            parts.append(pa.table({n: pa.array(x, t) for (n, t), x in zip(SUMS, columns, strict=True)}))
        return pa.concat_tables(parts)

    key = ("y", "block", "chunk")
    both = blocks.groupBy(*key).cogroup(drawn_counts(index.sparkSession, sizes, n_bootstrap, seed).groupBy(*key))
    return both.applyInArrow(add_up, "draw long, model int, p double, bad long, good long")


def _checked(df: DataFrame, y: str, base: str, challenger: str, n_bootstrap: int, confidence: float, seed: int, id_col: str | None) -> tuple[DataFrame, dict[int, int]]:
    """Guarded rows and the number of rows of each class."""
    if isinstance(n_bootstrap, bool) or not isinstance(n_bootstrap, int) or n_bootstrap < 2:
        raise ValueError("n_bootstrap must be a whole number >= 2")
    if isinstance(confidence, bool) or not 0 < confidence < 1:
        raise ValueError("confidence must lie strictly between 0 and 1")
    if isinstance(seed, bool) or not isinstance(seed, int) or not 0 <= seed < 2**32:
        raise ValueError("seed must be a whole number in [0, 2**32)")
    rows = df.select(
        *([id_col] if id_col else []),
        guards.binary_label(y).alias("y"),
        guards.probability(base).alias("base"),
        guards.probability(challenger).alias("challenger"),
    )
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < 2:
        raise ValueError("each class needs at least two rows")
    return rows, sizes


def cell_blocks(rows: DataFrame, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Equal rows as one cell with a count, in blocks of a hash; a block's cells are in order."""
    cells = written(rows.groupBy("y", "base", "challenger").agg(F.count("*").alias("n")), "bootstrap-cells")
    blocks = max(1, -(-cells.count() // block_cells))

    def pack(group: pa.Table) -> pa.Table:
        own = group.sort_by([("y", "ascending"), ("base", "ascending"), ("challenger", "ascending")])
        y, n = own["y"].to_numpy().astype(np.int8), own["n"].to_numpy()
        parts = [y, own["base"].to_numpy(), own["challenger"].to_numpy(), n]
        values = [[own["block"][0].as_py()], [int(n[y == 0].sum())], [int(n[y == 1].sum())], *[[p.tobytes()] for p in parts]]
        return pa.table(dict(zip(("block", "goods", "bads", "labels", "base", "challenger", "times"), values, strict=True)))

    placed = cells.withColumn("block", F.pmod(F.xxhash64("y", "base", "challenger"), F.lit(blocks)))
    return written(placed.groupBy("block").applyInArrow(pack, CELLS), "bootstrap-blocks")


def block_share(sums: np.ndarray, block: int, size: int, draws: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many of ``size`` slots fall on ``block`` in each draw; ``sums`` are running row counts, zero first.

    The numbers of all blocks of a draw add up to ``size``, because the walks to two blocks share their
    generators down to the node where they part.
    """
    low, high, share = 0, len(sums) - 1, np.full(draws, size)
    while high - low > 1:
        middle = (low + high) // 2
        whole = int(sums[high] - sums[low])
        part = int(sums[middle] - sums[low]) / whole if whole else 0.0
        left = np.random.default_rng((*seed, low, high)).binomial(share, part)
        if block < middle:
            high, share = middle, left
        else:
            low, share = middle, share - left
    return share


def drawn_sums(blocks: DataFrame, sizes: dict[int, int], n_bootstrap: int, seed: int) -> DataFrame:
    """(draw, model, p, bad, good): weights of every draw, summed by probability inside each block."""
    spark = blocks.sparkSession
    totals = blocks.select("block", "goods", "bads").orderBy("block").collect()
    order = {r["block"]: i for i, r in enumerate(totals)}
    sums = [np.concatenate([[0], np.cumsum([r[c] for r in totals])]) for c in ("goods", "bads")]
    shipped = spark.sparkContext.broadcast((order, sums, sizes))
    chunks = -(-n_bootstrap // DRAWS)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, own_sums, own_sizes = shipped.value
        for batch in batches:
            for r in batch.to_pylist():
                chunk, block = r["chunk"], places[r["block"]]
                y, n = np.frombuffer(r["labels"], np.int8), np.frombuffer(r["times"], np.int64)
                weights = np.zeros((DRAWS, len(y)), np.int64)
                for c in (0, 1):
                    mine = n[y == c]
                    if len(mine):
                        share = block_share(own_sums[c], block, own_sizes[c], DRAWS, (seed, chunk, c))
                        rng = np.random.default_rng((seed, chunk, c, block))
                        weights[:, y == c] = rng.multinomial(share, mine / mine.sum())
                weights = weights[: n_bootstrap - chunk * DRAWS]
                for model, name in enumerate(("base", "challenger")):
                    p, inverse = np.unique(np.frombuffer(r[name]), return_inverse=True)
                    by_p = np.argsort(inverse, kind="stable")
                    first = np.searchsorted(inverse[by_p], np.arange(len(p)))
                    bad, good = (np.add.reduceat(weights[:, by_p] * (y[by_p] == c), first, axis=1) for c in (1, 0))
                    d, i = np.nonzero(bad + good)
                    columns = [d + chunk * DRAWS, np.full(len(d), model, np.int32), p[i], bad[d, i], good[d, i]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["draw", "model", "p", "bad", "good"])

    each = blocks.drop("goods", "bads").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    tasks = max(min(len(totals) * chunks, 4 * spark.sparkContext.defaultParallelism), blocks.rdd.getNumPartitions())
    return each.repartition(tasks, "block", "chunk").mapInArrow(draw, "draw long, model int, p double, bad long, good long")


def paired_bootstrap(
    df: DataFrame,
    y: str,
    base: str,
    challenger: str,
    n_bootstrap: int = 2000,
    confidence: float = 0.95,
    seed: int = 42,
    block_cells: int = BLOCK_CELLS,
) -> BootstrapResult:
    """Percentile intervals of base, challenger and challenger minus base.

    Depends on the rows and the seed alone, not on their order or partitions. What is shuffled per
    draw and model are sums by distinct probability of a block.
    """
    rows, sizes = _checked(df, y, base, challenger, n_bootstrap, confidence, seed, None)
    blocks = cell_blocks(rows, block_cells)
    drawn = drawn_sums(blocks, sizes, n_bootstrap, seed)
    point = _long(rows.select(F.lit(-1).cast("long").alias("draw"), "y", "base", "challenger"))
    return _result(drawn.unionByName(point), rows, sizes, n_bootstrap, confidence, seed)


def indexed_bootstrap(
    df: DataFrame,
    y: str,
    base: str,
    challenger: str,
    n_bootstrap: int = 2000,
    confidence: float = 0.95,
    seed: int = 42,
    id_col: str = ID,
) -> BootstrapResult:
    """The same intervals from hashed slots, row by row; see the module's text."""
    rows, sizes = _checked(df, y, base, challenger, n_bootstrap, confidence, seed, id_col)
    # Draw -1 is the observed sample with weight one.
    index = dense_index(rows, "y", seed, id_col).select("y", "idx", "base", "challenger")
    sums = indexed_sums(index, sizes, n_bootstrap, seed).groupBy("draw", "model", "p").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # Written, because the curves read the sums twice and no slot is to be hashed twice.
    drawn = written(sums, "bootstrap-sums")
    point = _long(rows.select(F.lit(-1).cast("long").alias("draw"), "y", "base", "challenger"))
    return _result(drawn.unionByName(point), rows, sizes, n_bootstrap, confidence, seed)


def _long(weighted: DataFrame) -> DataFrame:
    """Both models (0 and 1) in one pass over rows of weight one."""
    both_models = F.expr("inline(array(named_struct('model', 0, 'p', base), named_struct('model', 1, 'p', challenger)))")
    return weighted.select("draw", "y", both_models).select(
        "draw", "model", "p", F.col("y").cast("long").alias("bad"), (1 - F.col("y")).cast("long").alias("good")
    )


def _result(long: DataFrame, rows: DataFrame, sizes: dict[int, int], n_bootstrap: int, confidence: float, seed: int) -> BootstrapResult:
    """Metrics per draw (draw -1 is the observed sample) and their intervals."""
    edges = sorted({*bucket_edges(rows, "base"), *bucket_edges(rows, "challenger")})
    curve = cumulative(long, "p", ["bad", "good"], ("draw", "model"), True, edges)
    per_model = curve.groupBy("draw", "model").agg(*ranking_aggregates())
    both = per_model.groupBy("draw").agg(
        *[
            F.max(F.when(F.col("model") == code, F.col(m))).alias(f"{model}_{m}")
            for code, model in enumerate(("base", "challenger"))
            for m in METRICS
        ]
    )
    draws = both.select(
        "*", *[(F.col(f"challenger_{m}") - F.col(f"base_{m}")).alias(f"difference_{m}") for m in METRICS]
    )
    # One row per draw: the interval step is bounded by n_bootstrap, not by the data.
    tail = (1.0 - float(confidence)) / 2.0
    observed, sampled = F.col("draw") < 0, F.col("draw") >= 0
    aggregates = []
    for group in ("base", "challenger", "difference"):
        for m in METRICS:
            c = F.col(f"{group}_{m}")
            aggregates += [
                F.max(F.when(observed, c)).alias(f"{group}_{m}__value"),
                F.percentile(F.when(sampled, c), F.array(F.lit(tail), F.lit(1.0 - tail))).alias(f"{group}_{m}__q"),
            ]
    entries = [
        F.struct(
            F.lit(m).alias("metric"),
            *[
                x
                for g in ("base", "challenger", "difference")
                for x in (
                    F.col(f"{g}_{m}__value").alias(f"{g}_value"),
                    F.col(f"{g}_{m}__q")[0].alias(f"{g}_lower"),
                    F.col(f"{g}_{m}__q")[1].alias(f"{g}_upper"),
                )
            ],
        )
        for m in METRICS
    ]
    summary = draws.agg(*aggregates).select(F.inline(F.array(*entries)))
    notes = []
    if n_bootstrap < 1000:
        notes.append("few draws: tail quantiles may be unstable")
    if min(sizes.values()) < 30:
        notes.append("a class has few rows: read intervals with care")
    metadata = {
        "n_samples": sum(sizes.values()),
        "n_good": sizes[0],
        "n_bad": sizes[1],
        "n_bootstrap": n_bootstrap,
        "confidence": float(confidence),
        "seed": seed,
        "difference": "challenger minus base",
        "method": "paired stratified percentile interval",
        "refit": False,
        "fixed_class_sizes": True,
        "quality_notes": notes,
    }
    return BootstrapResult(summary, draws.filter(sampled), metadata)
