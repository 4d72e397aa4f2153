"""Whitening: against a dense eigen-decomposition, exact whole-number columns, edge cases."""

import math

import numpy as np
import pytest

from scoreweave import fixtures
from scoreweave.functions.columns import RAW_COLUMNS
from scoreweave.llm import queries, whitening
from scoreweave.operators import wide

SF = "/root/testdata/sf0.01"


def dense(x):
    """(n, sums, values, vectors) of the distinct rows, components by falling eigenvalue."""
    fit = np.unique(x, axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(fit.shape[1], -1))
    return len(fit), fit.sum(axis=0), values[::-1], vectors[:, ::-1]


def check(got, ids, x, components=4, tolerance=1e-9):
    n, sums, values, vectors = dense(x)
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    for c in range(components):
        own = got[got.component == c + 1].set_index("id").loc[ids]
        want = (x - sums / n) @ vectors[:, c] / math.sqrt(values[c])
        want *= np.sign(want @ own.whitened.to_numpy())
        assert np.abs(want - own.whitened).max() < tolerance
        assert own.explained.iloc[0] == pytest.approx(values[c] / values.sum(), rel=1e-9)
        assert list(map(int, own.deviation)) == exact and set(own.n) == {n}
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9 and len(got) == components * len(ids)


def test_query_equals_dense(spark):
    got = queries.op12_whitening(spark, SF).toPandas().rename(columns={"vec_id": "id"})
    source = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    check(got, source.vec_id, np.floor(256 * np.vstack(source.embedding).astype(float)))


def test_applications(spark):
    sf = "/root/testdata/sf0.001"
    table = wide.model_table(fixtures.application(spark, sf), fixtures.bureau(spark, sf))
    got = whitening.whitened_applications(table, scale=1).toPandas().rename(columns={"sk_id_curr": "id"})
    rows = table.selectExpr("sk_id_curr", *[f"CAST({c} AS DOUBLE) AS {c}" for c in RAW_COLUMNS]).toPandas().dropna()
    assert 0 < len(rows) < table.count()
    check(got, rows.sk_id_curr, np.floor(rows[list(RAW_COLUMNS)].to_numpy()), tolerance=1e-6)


def test_close_eigenvalues_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.standard_normal((400, 60)))
    rows = [(i, [float(v) / 256 for v in row], 1) for i, row in enumerate(x)]
    rows += [(400 + i, rows[0][1], 1) for i in range(300)]
    df = spark.createDataFrame(rows, "sk_id_curr long, v array<double>, component int").repartition(7)
    got = whitening.whitened_applications(df, "v").toPandas().rename(columns={"sk_id_curr": "id"})
    check(got, range(700), np.vstack([x, np.tile(x[0], (300, 1))]))
    assert whitening.fit_whitening(whitening.whole_vectors(df, "v", 256, "sk_id_curr")).rounds < 20


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(i * 10**9), 1e7 * ((i * i) % 17)]) for i in range(40)]
    got = whitening.whitened_applications(spark.createDataFrame(rows, "sk_id_curr long, v array<double>"), "v", scale=1).toPandas()
    check(got.rename(columns={"sk_id_curr": "id"}), range(40), np.array([r[1] for r in rows]), components=2)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [None, 1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [3.0, 1.0]), (6, [4.0]), (7, [])]
    out = whitening.whitened_applications(spark.createDataFrame(rows, "sk_id_curr long, v array<double>"), "v").collect()
    assert sorted((r.sk_id_curr or 0) for r in out) == [0, 0, 1, 1, 1, 1, 6, 6, 7, 7] and {r.n for r in out} == {4}
    plain = spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0])], "sk_id_curr long, v array<double>")
    found = whitening.whitened_applications(plain, "v").collect()
    assert len(found) == 2 and all(r.component == 1 and abs(r.whitened) == pytest.approx(1) and r.explained == pytest.approx(1) for r in found)
    for same in ([], [(1, [])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])], [(1, None)]):
        assert whitening.whitened_applications(spark.createDataFrame(same, "sk_id_curr long, v array<double>"), "v").count() == 0


def test_filter_damps_the_unwanted_end():
    values = np.array([9.0, 5.0, 1.0, 0.5, 0.1])
    grown = whitening._filtered(lambda q: values[:, None] * q, np.eye(5), 1.0, 8)
    assert np.abs(np.diag(grown)[2:]).max() <= 1 + 1e-12 and np.diag(grown)[1] > 1e6
    assert np.diag(grown)[1] == pytest.approx(math.cosh(8 * math.acosh(2 * 5.0 - 1)))
