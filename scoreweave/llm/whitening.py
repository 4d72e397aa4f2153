"""Whitening of application vectors by Chebyshev-filtered subspace iteration.

The covariance is never formed. A block of vectors is multiplied with it by passes over the distributed,
centred rows; a Chebyshev polynomial in these products damps the unwanted end of the spectrum, a QR step
keeps the block independent and a Rayleigh-Ritz step reads eigenvectors off it. The rounds end when the
residuals are at the level of rounding and fresh random directions in the block show no larger eigenvalue.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ID, RAW_COLUMNS
from ..session import kept
from .tools import stored

# Rows packed into one value; largest polynomial degree of a round.
BLOCK_ROWS = 4096
DEGREE = 16
# Vectors of the block beyond the wanted ones, and how many of them start anew in every round.
BUFFER, PROBES = 20, 2
ROUNDS = 200
SEED = 20240601


class Whitening(NamedTuple):
    """Components by falling eigenvalue, and what they were fitted on."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    rounds: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_vectors(model_input: DataFrame, columns: str | Sequence[str], scale: int, id_col: str) -> DataFrame:
    """(id, x): rows whose entries are all present and finite, each entry c as ``floor(scale * c)``."""
    entries = F.col(columns) if isinstance(columns, str) else F.array(*[F.col(c).cast("double") for c in columns])
    rows = model_input.select(F.col(id_col).alias("id"), entries.cast("array<double>").alias("v")).filter("v IS NOT NULL")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    x = F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c))
    rows = rows.filter(finite).select("id", x.alias("x"))
    ends = rows.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if ends.low == ends.high:
        return rows
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(ends.high) - F.size("x"))))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _packed(rows: DataFrame) -> DataFrame:
    """(n, sums, data): every distinct vector once, in blocks of at most ``BLOCK_ROWS``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                m = _matrix(batch.column(0).slice(start, BLOCK_ROWS))
                safe = m if np.abs(m.astype(np.float64)).max(initial=0.0) < 2.0**50 else m.astype(object)
                sums = [str(s) for s in safe.sum(axis=0)]
                parts = [pa.array([len(m)], pa.int64()), pa.array([sums], pa.list_(pa.string())), pa.array([m.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(parts, names=["n", "sums", "data"])

    return rows.select("x").distinct().mapInArrow(pack, "n long, sums array<string>, data binary")


def _product(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    return a.T @ (a @ q)


def _squares(a: np.ndarray, _: None) -> np.ndarray:
    return (a * a).sum(axis=0)


def _moments(a: np.ndarray, turn: np.ndarray) -> np.ndarray:
    w = a @ turn
    return np.vstack([w.T @ w, w.sum(axis=0)])


def _total(
    blocks: DataFrame, mean: np.ndarray, shape: tuple[int, int], work: Callable[[np.ndarray, Any], np.ndarray], sent: np.ndarray | None = None
) -> np.ndarray:
    """Sum over all blocks of ``work(centred block, sent)``: one partial matrix a task, added up by place."""
    shipped = blocks.sparkSession.sparkContext.broadcast((mean, sent))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own_sent = shipped.value
        total = None
        for batch in batches:
            for data in batch.column(0):
                m = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, len(centre))
                own = work(m - centre, own_sent)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["part"])

    parts = blocks.select("data").mapInArrow(partial, "part array<double>")
    summed = parts.select(F.posexplode("part").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(shape[0] * shape[1])
    for r in summed.collect():
        out[r["place"]] = r["value"]
    shipped.destroy()
    return out.reshape(shape)


def _degree(values: np.ndarray, wanted: int, cut: float) -> int:
    """As many steps as keep the wanted directions within a factor of 1e8 of each other."""
    steps = [math.acosh(max(1.0, 2 * v / cut - 1)) for v in (values[0], values[wanted - 1])]
    spread = steps[0] - steps[1]
    return DEGREE if spread <= 0 else int(max(1, min(DEGREE, math.log(1e8) // spread)))


def _filtered(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, cut: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial that stays within one on [0, cut] and grows above."""
    half = cut / 2
    before, now = q, (product(q) - half * q) / half
    for _ in range(degree - 1):
        before, now = now, 2 * (product(now) - half * now) / half - before
    return now


def _subspace(product: Callable[[np.ndarray], np.ndarray], dims: int, components: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Leading eigenvalues and eigenvectors of ``product``, and the number of filter rounds."""
    rng = np.random.default_rng(SEED)
    width, wanted = min(dims, components + BUFFER), min(dims, components)
    y, found = rng.standard_normal((dims, width)), None
    eps, before = np.finfo(float).eps, math.inf
    for done in range(ROUNDS):
        q = np.linalg.qr(y)[0]
        image = product(q)
        h = q.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        top = max(values[0], 0.0)
        error = float(np.linalg.norm(image[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max())
        settled = error <= 8 * eps * math.sqrt(dims) * top or (error <= 1e-10 * top and error > before / 2)
        same = found is not None and np.allclose(found, values[:wanted], rtol=1e-10, atol=1e-13 * top)
        if width == dims or (settled and same) or not top:
            return values[:wanted], q[:, :wanted], done
        before, found = error, values[:wanted]
        kept_until = width - PROBES
        q[:, kept_until:] = rng.standard_normal((dims, PROBES))
        q = np.linalg.qr(q)[0]
        cut = max(values[kept_until - 1], 1e-12 * top)
        y = _filtered(product, q, cut, _degree(values, wanted, cut))
    raise RuntimeError(f"components are not certified after {ROUNDS} rounds")


def _fit(blocks: DataFrame, components: int) -> Whitening | None:
    n = blocks.agg(F.sum("n")).first()[0]
    if not n:
        return None
    places = blocks.select(F.posexplode("sums").alias("place", "part"))
    found = places.groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    sums = [int(r["total"]) for r in sorted(found, key=lambda r: r["place"])]
    dims = len(sums)
    if not dims:
        return None
    mean = np.array([s / n for s in sums])
    product = lambda q: _total(blocks, mean, q.shape, _product, q) / n
    trace = float(_total(blocks, mean, (1, dims), _squares).sum() / n)
    if not trace:
        return None
    values, vectors, rounds = _subspace(product, dims, components)
    real = int((values > 1e-12 * values[0]).sum())
    values, vectors = values[:real], vectors[:, :real]
    moment = _total(blocks, mean, (real + 1, real), _moments, vectors / np.sqrt(values)) / n
    covariance = moment[:-1] - np.outer(moment[-1], moment[-1])
    return Whitening(n, sums, vectors, values, trace, float(np.abs(covariance - np.eye(real)).max()), rounds)


def fit_whitening(rows: DataFrame, components: int = 4) -> Whitening | None:
    """Fit on the distinct ``x`` of :func:`whole_vectors`; None where no direction varies."""
    with kept(stored(_packed(rows), "vectors")) as blocks:
        return _fit(blocks, components)


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for rows of :func:`whole_vectors`."""
    kind = dict(rows.dtypes)["id"]
    turn, mean, sums = model.vectors / np.sqrt(model.values), model.mean, model.sums
    shipped = rows.sparkSession.sparkContext.broadcast((turn, mean, sums, model.n))
    largest = max(map(abs, sums))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_turn, own_mean, own_sums, n = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1))
            bound = n * int(np.abs(m.astype(np.float64)).max(initial=0.0) + 1) + largest
            dtype = np.int64 if bound * bound * len(own_sums) < 1 << 62 else object
            away = n * m.astype(dtype) - np.array(own_sums, dtype)
            w = (m - own_mean) @ own_turn
            offsets = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
            columns = [batch.column(0), pa.array([str(v) for v in (away * away).sum(axis=1)]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "deviation", "w"])

    found = rows.mapInArrow(project, f"id {kind}, deviation string, w array<double>")
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return found.select("id", F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), F.posexplode("w").alias("place", "whitened")).select(
        "id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("place")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def whitened_applications(
    model_input: DataFrame,
    columns: str | Sequence[str] = RAW_COLUMNS,
    components: int = 4,
    scale: int = 256,
    id_col: str = ID,
) -> DataFrame:
    """One row per application and component: its whitened coordinate on the leading directions.

    ``columns`` names the numeric columns of ``model_input``, or one array column. Each entry c becomes
    the whole number x = floor(scale * c) (held at the ends of 64 bits). The fit list is each distinct x
    vector once: n vectors with per-column sums S. Columns of the result: ``sk_id_curr``, ``component`` (from 1
    by falling eigenvalue of the fit list's covariance), ``n``, ``deviation`` (decimal, the exact sum over
    columns of (n * x - S)^2; null beyond 38 digits), ``whitened`` ((x - S/n) on the component, over the root of
    its eigenvalue), ``explained`` (share of the total variance) and ``identity_error`` (largest entry of
    the fit list's whitened covariance minus the identity).

    Applications with a null or non-finite entry, or a null array, are left out; shorter arrays count as
    followed by zeros. Repeated rows each get their coordinates but count once in the fit; null ids are
    kept; further columns are ignored. Directions without variance cannot be whitened and have no row: no
    row at all for an empty table, empty vectors or equal vectors.

    Distinct rows shuffle once and are packed. Each of the degree-many products of a round is a pass
    over the packed rows in which a task adds up one columns x block matrix; only sums by place reach the driver.
    Memory on the driver: a few columns x (components + 20) matrices.
    """
    rows = whole_vectors(model_input, columns, scale, id_col)
    model = fit_whitening(rows, components)
    kind = dict(rows.dtypes)["id"]
    if model is None:
        schema = f"{id_col} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], schema)
    return whiten(rows, model).withColumnRenamed("id", id_col)
