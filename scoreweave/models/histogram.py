"""Gradient histograms over packed rows, and the best split of every node from them.

Rows are packed once as one-byte bin codes, feature after feature inside a block; features of few codes may share
a byte. A pass adds up gradient, curvature and row count by (node, byte, code) inside each task and then across
tasks; the size of these sums does not depend on the rows. Sums of a shared byte are taken apart by the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = 255
MOST_EDGES = 254
BLOCK_ROWS = 131072
# Fewer rows than this are not worth a task of their own.
TASK_ROWS = 65536
LEAST_GAIN = 1e-10
# Sums of so many tasks are added up by the driver, those of more by tasks first.
DIRECT_TASKS = 16

# A packed block: codes (rows x features or their bytes), labels and current log-odds, as bytes.
Block = tuple[bytes, bytes, bytes]
# Rows of a block -> position of each row's node (-1: none).
Route = Callable[[np.ndarray], np.ndarray]


class Split(NamedTuple):
    """Rows with a code of at most ``code`` go left; missing ones where ``missing_left`` says."""

    gain: float
    feature: int
    code: int
    missing_left: bool
    left: tuple[float, float, int]
    right: tuple[float, float, int]


@dataclass(frozen=True)
class Layout:
    """Byte of each feature: a shared byte is the sum of stride x code over its features, missing as their last code.

    A feature of ``ALONE`` codes has its byte for itself, with the code as it is.
    """

    column: tuple[int, ...]
    stride: tuple[int, ...]
    codes: tuple[int, ...]
    missing: tuple[bool, ...]
    ALONE = 256

    @classmethod
    def alone(cls, features: int) -> Layout:
        return cls(tuple(range(features)), (1,) * features, (cls.ALONE,) * features, (True,) * features)

    @classmethod
    def of(cls, codes: Sequence[int], missing: Sequence[bool]) -> Layout:
        """Features of ``codes`` values (and missing ones), largest first into the first byte with room."""
        sizes = [max(2, n + m) for n, m in zip(codes, missing, strict=True)]
        column, stride = [0] * len(sizes), [1] * len(sizes)
        used: list[int] = []
        for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
            if 2 * sizes[f] > cls.ALONE:
                sizes[f] = cls.ALONE
            at = next((i for i, u in enumerate(used) if u * sizes[f] <= cls.ALONE), len(used))
            if at == len(used):
                used.append(1)
            column[f], stride[f] = at, used[at]
            used[at] *= sizes[f]
        return cls(tuple(column), tuple(stride), tuple(sizes), tuple(map(bool, missing)))

    @property
    def columns(self) -> int:
        return max(self.column) + 1

    def code(self, f: int) -> np.ndarray:
        """Code of feature ``f`` by value of its byte."""
        if self.codes[f] == self.ALONE:
            return np.arange(256)
        own = np.arange(256) // self.stride[f] % self.codes[f]
        return np.where(own == self.codes[f] - 1, MISSING, own) if self.missing[f] else own

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Rows x features -> rows x bytes."""
        out = np.zeros((len(codes), self.columns), np.uint8)
        for f, (column, stride, n) in enumerate(zip(self.column, self.stride, self.codes, strict=True)):
            own = codes[:, f]
            if n < self.ALONE:
                own = np.where(own == MISSING, n - 1, own).astype(np.uint8)
            out[:, column] += own * np.uint8(stride)
        return out

    def spread(self, sums: np.ndarray) -> np.ndarray:
        """Sums by (byte, node, value) -> by (feature, node, code)."""
        out = np.zeros((len(self.column), *sums.shape[1:]))
        for f, column in enumerate(self.column):
            if self.codes[f] == self.ALONE:
                out[f] = sums[column]
            else:
                own = self.code(f)
                for code in np.unique(own):
                    out[f][:, code] = sums[column][:, own == code].sum(axis=1)
        return out

    def goes_left(self, columns: np.ndarray, f: int, code: int, missing_left: bool) -> np.ndarray:
        """Which rows have a code of at most ``code``, missing ones where ``missing_left`` says."""
        own = columns[self.column[f]]
        if self.codes[f] == self.ALONE:
            # The missing code is the highest one: one step on it is the lowest.
            return own + np.uint8(1) <= np.uint8(code + 1) if missing_left else own <= np.uint8(code)
        by_value = self.code(f)
        return (np.where(by_value == MISSING, missing_left, by_value <= code)).take(own)


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int = MOST_EDGES + 1) -> list[np.ndarray]:
    """Upper ends of the bins of each column: distinct sketched quantiles below the largest value."""
    shares = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    row = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), shares, 100 * bins).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(q or [], np.float64))[:-1] for q in row]


def codes_of(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin codes of a rows x features matrix; not-a-number is missing."""
    out = np.empty(values.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.where(np.isnan(values[:, i]), MISSING, np.searchsorted(e, values[:, i], "left"))
    return out


def matrix(batch: pa.RecordBatch, first: int = 0) -> np.ndarray:
    """Columns of a batch from ``first`` on as doubles, null as not-a-number."""
    columns = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[first:]]
    return np.stack(columns, axis=1) if columns else np.empty((batch.num_rows, 0))


def packed(df: DataFrame, columns: Sequence[str], label: str, edges: list[np.ndarray], start: float, layout: Layout | None = None) -> DataFrame:
    """(codes, labels, margins): blocks of at most ``BLOCK_ROWS`` rows, all at log-odds ``start``."""
    layout = layout or Layout.alone(len(columns))

    def block(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        y = np.concatenate([labels for labels, _ in parts])
        codes = np.concatenate([own for _, own in parts], axis=1)
        values = [codes.tobytes(), y.tobytes(), np.full(len(y), start).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=["codes", "labels", "margins"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK_ROWS - held)
                y = part.column(0).to_numpy(zero_copy_only=False).astype(np.int8)
                parts.append((y, layout.pack(codes_of(matrix(part, 1), edges)).T))
                at, held = at + len(y), held + len(y)
                if held == BLOCK_ROWS:
                    yield block(parts)
                    parts, held = [], 0
        if held:
            yield block(parts)

    rows = df.select(F.col(label).cast("int"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    return rows.mapInArrow(pack, "codes binary, labels binary, margins binary")


def block_rdd(table: DataFrame, rows: int) -> RDD:
    """The packed rows as blocks, about ``TASK_ROWS`` rows to a task where files are smaller."""
    return table.rdd.map(tuple).coalesce(max(1, min(table.rdd.getNumPartitions(), -(-rows // TASK_ROWS))))


def unpacked(block: Block, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows x features, each feature in one piece), labels and log-odds."""
    codes, y, margin = block
    return np.frombuffer(codes, np.uint8).reshape(features, -1).T, np.frombuffer(y, np.int8), np.frombuffer(margin, np.float64)


def shifted(blocks: RDD, features: int, add: Callable[[np.ndarray], np.ndarray]) -> RDD:
    """Blocks with ``add(codes)`` on top of their log-odds."""

    def moved(block: Block) -> Block:
        codes, _, margin = unpacked(block, features)
        return block[0], block[1], (margin + add(codes)).tobytes()

    return blocks.map(moved, preservesPartitioning=True)


def search(sums: np.ndarray, penalty: float, min_rows: int) -> list[Split | None]:
    """Best split of every node from features x nodes x 256 x (gradient, curvature, rows).

    The last code holds the missing rows. Ties go to the first feature, missing rows on the right, the lowest code.
    """
    nodes = sums.shape[1]
    total, absent = sums[0].sum(axis=1), sums[:, :, MISSING]
    below = np.cumsum(sums[:, :, :MISSING], axis=2)
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + penalty + 1e-300)
    whole = score(total)[:, None]
    gains = []
    for left in (below, below + absent[:, :, None]):
        right = total[:, None] - left
        fits = (left[..., 2] >= min_rows) & (right[..., 2] >= min_rows)
        gains.append(np.where(fits, score(left) + score(right) - whole, -np.inf))
    gain = np.stack(gains, axis=1)  # features x sides x nodes x codes
    best: list[Split | None] = []
    for node in range(nodes):
        own = gain[:, :, node]
        feature, side, code = np.unravel_index(int(np.argmax(own)), own.shape)
        if own[feature, side, code] <= LEAST_GAIN:
            best.append(None)
            continue
        left = below[feature, node, code] + (absent[feature, node] if side else 0)
        ends = [(float(x[0]), float(x[1]), int(round(x[2]))) for x in (left, total[node] - left)]
        best.append(Split(float(own[feature, side, code]), int(feature), int(code), bool(side), *ends))
    return best


def node_sums(
    blocks: RDD, features: int, nodes: int, route: Route, add: Callable[[np.ndarray], np.ndarray] | None = None, layout: Layout | None = None
) -> np.ndarray:
    """Features x nodes x 256 x (gradient, curvature, rows) under log loss; ``add`` gives what the margins lack.
    With a ``layout`` the bytes of its rows are added up, and their sums are spread over ``features``.

    Tasks add up their rows, and where they are many a tree of tasks adds up their sums.
    """

    columns = layout.columns if layout else features

    def sums(part: Iterator[Block]) -> Iterator[np.ndarray]:
        total = np.zeros((3, columns, nodes * 256))
        for block in part:
            codes, y, margin = unpacked(block, columns)
            place = route(codes)
            inside = np.flatnonzero(place >= 0)
            if len(inside) < len(y):
                place, y, margin = place[inside], y[inside], margin[inside]
                codes = codes.T.take(inside, axis=1).T
            if add is not None:
                margin = margin + add(codes)
            p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            g, h = p - y, p * (1 - p)
            start = place.astype(np.intp) * 256
            for f in range(columns):
                at = start + codes[:, f]
                total[0, f] += np.bincount(at, g, nodes * 256)
                total[1, f] += np.bincount(at, h, nodes * 256)
                total[2, f] += np.bincount(at, minlength=nodes * 256)
        yield total

    depth = 1 if blocks.getNumPartitions() <= DIRECT_TASKS else 2
    summed = blocks.mapPartitions(sums).treeReduce(np.add, depth=depth)
    found = np.moveaxis(summed.reshape(3, columns, nodes, 256), 0, -1)
    return layout.spread(found) if layout else found


def best_splits(
    blocks: RDD, features: int, nodes: int, route: Route, penalty: float, min_rows: int, add: Callable[[np.ndarray], np.ndarray] | None = None
) -> list[Split | None]:
    """Best split of each of ``nodes`` nodes; ties go to the first feature."""
    return search(node_sums(blocks, features, nodes, route, add), penalty, min_rows)


def rest(whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Sums of the other child: those of the node less those of one child; codes without rows have none."""
    out = whole - part
    out[out[..., 2] == 0] = 0.0
    return out
