"""Exact order statistics by radix selection, for all columns and ranks at once.

A double is read as a 64-bit number of the same order. Each pass counts, for every column, the next digit of
the numbers that begin like a wanted one; six passes fix all 64 bits. A task adds up its rows into one vector of
counts, whose size depends on columns and ranks and never on the data, and vectors are added in a tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGIT = 11
SHIFTS = (55, 44, 33, 22, 11, 0)
BLOCK_ROWS = 16384
# Fewer rows than this are not worth a task of their own.
TASK_ROWS = 65536
# Image of a missing value; no number has it.
MISSING = np.uint64(0xFFFFFFFFFFFFFFFF)
SIGN = np.uint64(1 << 63)


class Selected(NamedTuple):
    """Non-null rows, values by rank, and all different values if there are few (else None)."""

    n: int
    at: dict[int, float]
    distinct: list[float] | None

    def quantiles(self, probabilities: Sequence[float]) -> list[float]:
        """Linear interpolation between neighbouring order statistics."""
        return [_interpolate(x, self.at[math.floor(x)], self.at[math.ceil(x)]) for x in ((self.n - 1) * p for p in probabilities)]


def _interpolate(position: float, low: float, high: float) -> float:
    floor, ceil = math.floor(position), math.ceil(position)
    if floor == ceil or low == high:
        return low
    return (ceil - position) * low + (position - floor) * high


def images(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers in the order of the doubles; both zeros are one, not-a-number is last."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def doubles(numbers: np.ndarray) -> np.ndarray:
    """The doubles of :func:`images`."""
    return np.where(numbers & SIGN, numbers & ~SIGN, ~numbers).view(np.float64)


def _packed(df: DataFrame, columns: Sequence[str]) -> RDD:
    """Blocks of images, column by column."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                rows = []
                for c in part.columns:
                    own = images(c.fill_null(0.0).to_numpy(zero_copy_only=False))
                    own[c.is_null().to_numpy(zero_copy_only=False)] = MISSING
                    rows.append(own)
                data = np.stack(rows).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([data], pa.binary())], names=["n", "data"])

    table = df.select(*[F.expr(f"CAST({c} AS DOUBLE) AS c{i}") for i, c in enumerate(columns)]).mapInArrow(pack, "n long, data binary")
    return table.rdd.map(tuple)


def _counted(blocks: RDD, columns: int, active: list[np.ndarray], shift: int) -> list[np.ndarray]:
    """Per column: (beginnings, digits) counts of the numbers that begin like an active one."""
    starts = np.cumsum([0, *[len(a) << DIGIT for a in active]])
    above = np.uint64(min(63, shift + DIGIT))
    first = shift == SHIFTS[0]

    def sums(part: Iterator[tuple[int, bytes]]) -> Iterator[np.ndarray]:
        total = np.zeros(int(starts[-1]), np.int64)
        for _, data in part:
            for i, own in enumerate(np.frombuffer(data, np.uint64).reshape(columns, -1)):
                if not len(active[i]):
                    continue
                own = own[own != MISSING]
                digit = ((own >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                if not first:
                    begin = own >> above
                    place = np.minimum(np.searchsorted(active[i], begin), len(active[i]) - 1)
                    hit = active[i][place] == begin
                    digit = digit[hit] + (place[hit] << DIGIT)
                total[starts[i] : starts[i + 1]] += np.bincount(digit, minlength=int(starts[i + 1] - starts[i]))
        yield total

    found = blocks.mapPartitions(sums).treeReduce(np.add, depth=3)
    return [found[starts[i] : starts[i + 1]].reshape(-1, 1 << DIGIT) for i in range(columns)]


def select_values(df: DataFrame, columns: Sequence[str], ranks: Callable[[int], Sequence[int]], few: int = 0) -> dict[str, Selected]:
    """Exact values at zero-based ``ranks(n)`` of the n non-null rows of each column.

    Columns with at most ``few`` different values also list them all. Columns without a value have none.
    """
    columns = list(columns)
    if not columns:
        return {}
    packed = _packed(df, columns).persist()
    try:
        rows = packed.map(lambda b: b[0]).fold(0, lambda a, b: a + b)
        blocks = packed.coalesce(max(1, min(packed.getNumPartitions(), -(-rows // TASK_ROWS))))
        return _selected(blocks, columns, ranks, few)
    finally:
        packed.unpersist()


def _selected(blocks: RDD, columns: list[str], ranks: Callable[[int], Sequence[int]], few: int) -> dict[str, Selected]:
    size = len(columns)
    active = [np.zeros(1, np.uint64) for _ in columns]
    n, wanted, listed = [0] * size, [{} for _ in columns], [few > 0] * size
    for shift in SHIFTS:
        counts = _counted(blocks, size, active, shift)
        for i, own in enumerate(counts):
            if not len(active[i]):
                continue
            if shift == SHIFTS[0]:
                n[i] = int(own.sum())
                # rank -> (place of its beginning in ``active``, rank among the numbers that begin so)
                wanted[i] = {r: (0, r) for r in ranks(n[i])} if n[i] else {}
            after = np.cumsum(own, axis=1)
            begins = set()
            steps = {}
            for rank, (place, inside) in wanted[i].items():
                digit = int(np.searchsorted(after[place], inside, "right"))
                steps[rank] = (int(active[i][place]) << DIGIT | digit, inside - int(after[place, digit - 1] if digit else 0))
                begins.add(steps[rank][0])
            if listed[i]:
                occurring = [int(active[i][p]) << DIGIT | int(d) for p, d in zip(*np.nonzero(own), strict=True)]
                listed[i] = len(occurring) <= few
                if listed[i]:
                    begins.update(occurring)
            active[i] = np.array(sorted(begins), np.uint64)
            places = {int(b): p for p, b in enumerate(active[i])}
            wanted[i] = {rank: (places[b], inside) for rank, (b, inside) in steps.items()}
    out = {}
    for i, c in enumerate(columns):
        values = doubles(active[i]) if len(active[i]) else np.empty(0)
        at = {rank: float(values[place]) for rank, (place, _) in wanted[i].items()}
        out[c] = Selected(n[i], at, [float(v) for v in values] if listed[i] else None)
    return out


def ranks_of(probabilities: Sequence[float]) -> Callable[[int], list[int]]:
    """Ranks that interpolated quantiles of n rows need, and both ends."""
    return lambda n: sorted({0, n - 1, *[r for p in probabilities for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))]})


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float]]:
    """Interpolated quantiles of the columns that have a value."""
    found = select_values(df, columns, ranks_of(probabilities))
    return {c: s.quantiles(probabilities) for c, s in found.items() if s.n}
