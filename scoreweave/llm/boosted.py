"""Histogram gradient-boosted trees over statistics of a record, and the statistics of a text.

Trees grow level by level to a fixed depth from gradient histograms and are flattened into arrays in
heap order, so that all trees of all rows of a batch are walked at once by numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ID, RAW_COLUMNS, TARGET
from ..models import histogram
from ..session import kept
from .tools import stored

# Trees whose effect is recomputed in a pass before the packed rows take it up.
REFRESH = 10
WALK_ROWS = 4096


class BoostedTrees(NamedTuple):
    """Complete trees of one depth: inner nodes and leaves in heap order, one row per tree."""

    columns: tuple[str, ...]
    feature: np.ndarray
    code: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    leaves: np.ndarray
    start: float
    rows: int
    gains: np.ndarray

    @property
    def depth(self) -> int:
        return int(self.leaves.shape[1]).bit_length() - 1

    def by_codes(self, codes: np.ndarray) -> np.ndarray:
        """Sum of the trees' leaves for rows of bin codes."""
        return self._sum(codes, self.code, codes == histogram.MISSING)

    def by_values(self, values: np.ndarray) -> np.ndarray:
        """Sum of the trees' leaves for rows of values (not-a-number: missing)."""
        return self._sum(values, self.threshold, np.isnan(values))

    def _sum(self, x: np.ndarray, bound: np.ndarray, absent: np.ndarray) -> np.ndarray:
        trees = len(self.leaves)
        total = np.zeros(len(x))
        if not trees:
            return total
        inner = self.feature.shape[1]
        base = np.arange(trees) * inner
        feature, bound, side = self.feature.ravel(), bound.ravel(), self.missing_left.ravel()
        for at in range(0, len(x), WALK_ROWS):
            own, own_absent = x[at : at + WALK_ROWS], absent[at : at + WALK_ROWS]
            rows = np.arange(len(own))[:, None]
            node = np.zeros((len(own), trees), np.int64)
            for _ in range(self.depth):
                here = base + node
                used = feature[here]
                with np.errstate(invalid="ignore"):
                    left = np.where(own_absent[rows, used], side[here], own[rows, used] <= bound[here])
                node = 2 * node + 2 - left
            total[at : at + WALK_ROWS] = self.leaves[np.arange(trees), node - inner].sum(axis=1)
        return total


def _places(codes: np.ndarray, tree: BoostedTrees, levels: int) -> np.ndarray:
    """Position of each row within level ``levels`` of a single, growing tree."""
    node = np.zeros(len(codes), np.int64)
    rows = np.arange(len(codes))
    for _ in range(levels):
        used = codes[rows, tree.feature[0, node]]
        left = np.where(used == histogram.MISSING, tree.missing_left[0, node], used <= tree.code[0, node])
        node = 2 * node + 2 - left
    return node - (2**levels - 1)


def _no_trees(columns: Sequence[str], depth: int, start: float, rows: int) -> BoostedTrees:
    inner = np.zeros((0, 2**depth - 1))
    return BoostedTrees(
        tuple(columns), inner.astype(np.int64), inner.astype(np.int64), inner, inner.astype(bool), np.zeros((0, 2**depth)), start, rows, inner
    )


def _joined(first: BoostedTrees, second: BoostedTrees) -> BoostedTrees:
    names = ("feature", "code", "threshold", "missing_left", "leaves", "gains")
    return first._replace(**{n: np.concatenate([getattr(first, n), getattr(second, n)]) for n in names})


def fit_boosted(
    model_input: DataFrame,
    columns: Sequence[str] = RAW_COLUMNS,
    target: str = TARGET,
    rounds: int = 40,
    depth: int = 4,
    step: float = 0.3,
    penalty: float = 1.0,
    min_rows: int = 10,
    bins: int = 128,
    least_gain: float = 0.01,
) -> BoostedTrees:
    """Boost log loss on all rows of ``model_input`` whose ``target`` is 0 or 1.

    Missing entries (null or not-a-number) go to the side of each split that gains more. A round is one
    job a level: histograms by task, sums and split search by feature. Nodes without a gain pass their rows
    on unchanged; rounds end early when a tree gains less than ``least_gain`` in all. No usable rows, no columns or a single class give a model without trees, whose score is
    the class's share. Repeated rows count each; further columns are ignored; the result does not
    depend on the order of rows but for rounding.
    """
    rows = model_input.select(*columns, F.col(target).cast("int").alias("_y_label")).filter("_y_label IN (0, 1)")
    with kept(rows) as kept_rows:
        n, bad = kept_rows.agg(F.count("*"), F.coalesce(F.sum("_y_label"), F.lit(0))).first()
        start = math.log((bad + 0.5) / (n - bad + 0.5))
        model = _no_trees(columns, depth, start, n)
        if not columns or bad in (0, n):
            return model
        edges = histogram.bin_edges(kept_rows, columns, bins)
        table = stored(histogram.packed(kept_rows, columns, "_y_label", edges, start), "packed-rows")
    blocks = histogram.block_rdd(table, n).persist()
    fresh = model
    for _ in range(rounds):
        tree = _grown(blocks, edges, fresh, depth, step, penalty, min_rows)
        if tree.gains.sum() < least_gain:
            break
        fresh = _joined(fresh, tree)
        if len(fresh.leaves) == REFRESH:
            model, old = _joined(model, fresh), blocks
            blocks = histogram.shifted(blocks, len(columns), fresh.by_codes).persist()
            blocks.count()
            old.unpersist()
            fresh = _no_trees(columns, depth, start, n)
    blocks.unpersist()
    return _joined(model, fresh)


def _grown(blocks, edges, fresh: BoostedTrees, depth: int, step: float, penalty: float, min_rows: int) -> BoostedTrees:
    """One tree on top of the packed log-odds and the ``fresh`` trees."""
    inner, features = 2**depth - 1, len(edges)
    tree = _no_trees(fresh.columns, depth, fresh.start, fresh.rows)
    tree = tree._replace(
        feature=np.zeros((1, inner), np.int64), code=np.full((1, inner), histogram.MISSING), threshold=np.full((1, inner), np.inf),
        missing_left=np.ones((1, inner), bool), leaves=np.zeros((1, 2**depth)), gains=np.zeros((1, inner)),
    )
    values: dict[int, float] = {}
    add = fresh.by_codes if len(fresh.leaves) else None
    for level in range(depth):
        first = 2**level - 1
        route = lambda codes, now=tree, at=level: _places(codes, now, at)
        found = histogram.best_splits(blocks, features, first + 1, route, penalty, min_rows, add)
        for node, split in enumerate(found, first):
            if split is None:
                if node in values:
                    values[2 * node + 1] = values[2 * node + 2] = values[node]
                continue
            tree.feature[0, node], tree.code[0, node], tree.missing_left[0, node] = split.feature, split.code, split.missing_left
            own = edges[split.feature]
            tree.threshold[0, node] = own[split.code] if split.code < len(own) else np.inf
            tree.gains[0, node] = split.gain
            for child, (g, h, _) in ((2 * node + 1, split.left), (2 * node + 2, split.right)):
                values[child] = -step * g / (h + penalty)
        if not any(found):
            break
    for node in range(inner):
        if node in values:
            values.setdefault(2 * node + 1, values[node])
            values.setdefault(2 * node + 2, values[node])
    tree.leaves[0] = [values.get(inner + i, 0.0) for i in range(2**depth)]
    return tree


def score_boosted(model_input: DataFrame, model: BoostedTrees, name: str = "predicted_bad_probability") -> DataFrame:
    """``model_input`` with the probability of target 1 under ``name``: one pass, no shuffle.

    Missing entries take the learned side. Rows and further columns are kept (a column called ``name`` is
    replaced); an empty table stays empty.
    """
    shipped = model_input.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        own = shipped.value
        for frame in batches:
            z = own.start + own.by_values(frame.to_numpy(dtype=np.float64))
            yield pd.Series(1 / (1 + np.exp(-z)))

    used = F.struct(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(model.columns)])
    if not model.columns:
        return model_input.withColumn(name, F.lit(1 / (1 + math.exp(-model.start))))
    return model_input.withColumn(name, scored(used))


# --- statistics of a text ------------------------------------------------------------

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "log_lines", "line_bytes", "upper_share", "digit_share", "symbol_share", "point_share",
    "bang_share", "bracket_share", "quote_share", "space_share", "wide_share", "short_words", "long_words", "capital_words",
    "shouted_words", "distinct_words", "top_word", "echoed_words", "distinct_pairs", "repeated_lines", "closed_lines", "byte_entropy",
)
CHUNK = 1 << 22


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    return table


# ASCII character classes.
_UPPER, _LOWER = _class(bytes(range(65, 91))), _class(bytes(range(97, 123)))
_DIGIT, _SPACE, _WIDE = _class(bytes(range(48, 58))), _class(b" \t\n\v\f\r"), _class(bytes(range(128, 256)))
_SYMBOL, _POINT, _BANG = _class(b"#*$%&|<>"), _class(b".,;:?"), _class(b"!")
_BRACKET, _QUOTE, _CLOSE = _class(b"()[]{}"), _class(b"\"'`"), _class(b".!?:;\"')")
_PLACE = np.random.default_rng(20240602).integers(1, 1 << 62, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def _per_text(owner: np.ndarray, keys: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of every text, and how often its commonest key occurs."""
    if not len(keys):
        return np.zeros(texts), np.zeros(texts)
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])]))
    runs, most = np.diff(np.append(first, len(o))), np.zeros(texts)
    np.maximum.at(most, o[first], runs)
    return np.bincount(o[first], minlength=texts).astype(float), most


def _hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of every (non-empty, ascending) range of ``data``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    where = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    place = where - np.repeat(starts, sizes)
    letters = (data[where].astype(np.uint64) + np.uint64(1)) * (_PLACE[place & 63] + (place >> 6).astype(np.uint64))
    total = np.add.reduceat(letters, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64)
    total ^= total >> np.uint64(29)
    return total * np.uint64(0x9E3779B97F4A7C15)


def _ranges(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, text) of the runs where ``inside`` holds, never across texts; ``cuts``: ends of the texts."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[cuts] = True
    begins = inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]) if len(inside) else inside
    ends = inside & (np.concatenate([~inside[1:], [True]]) | edge[1:]) if len(inside) else inside
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops - starts, np.searchsorted(cuts, starts, "right") - 1


def _statistics(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Statistics (texts x ``STATISTICS``) of texts laid end to end; ``cuts`` are their ends, zero first."""
    texts, size = len(cuts) - 1, np.diff(cuts).astype(float)
    share = lambda a, b: np.divide(a, b, out=np.full(texts, np.nan), where=b > 0)
    owner = np.repeat(np.arange(texts), np.diff(cuts))
    counts = np.bincount(owner * 256 + data, minlength=texts * 256).reshape(texts, 256).astype(float)
    of = lambda table: counts @ table.astype(float)
    p = counts / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)

    starts, sizes, text = _ranges(_SPACE[data] == 0, cuts)
    words = np.bincount(text, minlength=texts).astype(float)
    sums = lambda values: np.bincount(text, values, texts)
    key = _hashes(data, starts, sizes)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int64)])
    lower = np.concatenate([[0], np.cumsum(_LOWER[data], dtype=np.int64)])
    inside = lambda sums, ends: sums[ends] - sums[starts]
    loud = (inside(upper, starts + sizes) >= 2) & (inside(lower, starts + sizes) == 0)
    distinct, most = _per_text(text, key, texts)
    follows = (text[1:] == text[:-1]) if len(text) else np.zeros(0, bool)
    echo = np.bincount(text[1:][follows & (key[1:] == key[:-1])], minlength=texts) if len(text) else np.zeros(texts)
    pairs = text[1:][follows] if len(text) else text
    pair_keys = (key[1:] * np.uint64(3) + key[:-1] * np.uint64(0x9E3779B97F4A7C15))[follows] if len(text) else key
    n_pairs = np.bincount(pairs, minlength=texts).astype(float)

    line_start, line_size, line_text = _ranges(data != 10, cuts)
    lines = np.bincount(line_text, minlength=texts).astype(float)
    line_distinct, _ = _per_text(line_text, _hashes(data, line_start, line_size), texts)
    closed = np.bincount(line_text, _CLOSE[data[line_start + line_size - 1]] if len(line_start) else None, texts)
    return np.stack([
        np.log1p(size), np.log1p(words), share(sums(sizes.astype(float)), words), np.log1p(lines), share(size, lines),
        share(of(_UPPER), of(_UPPER) + of(_LOWER)), share(of(_DIGIT), size), share(of(_SYMBOL), words), share(of(_POINT), words),
        share(of(_BANG), words), share(of(_BRACKET), words), share(of(_QUOTE), words), share(of(_SPACE), size), share(of(_WIDE), size),
        share(sums((sizes <= 2).astype(float)), words), share(sums((sizes >= 14).astype(float)), words), share(sums(_UPPER[data[starts]].astype(float)), words),
        share(sums(loud.astype(float)), words), share(distinct, words), share(most, words), share(echo, words), share(_per_text(pairs, pair_keys, texts)[0], n_pairs),
        share(lines - line_distinct, lines), share(closed, lines), entropy,
    ], axis=1)


def text_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ``STATISTICS``): counts and shares over every whole text, in one pass without a shuffle.

    General: the scoring tables of this library hold no prose. Lengths are of UTF-8 bytes; words are runs
    without ASCII white space, lines are runs without line ends. Null and empty texts have lengths of zero
    and null shares. Texts are worked on in groups of about 4 MB, a longer one by itself. Repeated rows and
    null keys are kept, further columns are not returned, an empty table stays empty.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK):
                    size += len(texts[stop])
                    stop += 1
                data = np.frombuffer(b"".join(texts[at:stop]), np.uint8)
                cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts[at:stop]])])
                found = _statistics(data, cuts)
                columns = [pa.array(np.ascontiguousarray(c), from_pandas=True) for c in found.T]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), *columns], names=[key, *STATISTICS])
                at = stop

    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    kind = dict(docs.dtypes)[key]
    return rows.mapInArrow(measured, f"{key} {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))
