"""Whitening against exact fractions and a plain eigen-solve."""

import collections
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from genoweave.llm import queries, whitening

FLOATS = st.floats(-1e12, 1e12, allow_subnormal=False).filter(lambda v: v == 0 or abs(v) > 1e-12)


@given(FLOATS, FLOATS)
@settings(deadline=None)
def test_error_free_transformations(a, b):
    x, y = np.array([a]), np.array([b])
    for (high, low), exact in ((whitening.two_sum(x, y), Fraction(a) + Fraction(b)), (whitening.two_product(x, y), Fraction(a) * Fraction(b))):
        assert Fraction(float(high[0])) + Fraction(float(low[0])) == exact


def test_products_are_exact_to_thirty_digits():
    rng = np.random.default_rng(0)
    rows = rng.integers(10**5, 10**5 + 2000, (301, 5)).astype(np.float64)
    sums = [int(s) for s in rows.sum(0)]
    high, low = whitening.products(rows, whitening.mean_pair(sums, len(rows)))
    i, j = np.triu_indices(5)
    for k in range(len(i)):
        exact = sum((Fraction(int(r[i[k]])) - Fraction(sums[i[k]], 301)) * (Fraction(int(r[j[k]])) - Fraction(sums[j[k]], 301)) for r in rows)
        assert abs(Fraction(high[k]) + Fraction(low[k]) - exact) <= abs(exact) / 10**25 + Fraction(1, 10**20)


def _plain(vectors, most=8):
    """Whitened values, shares and deviations by exact sums and a plain solver."""
    x = np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    centred = x.astype(np.longdouble) - s.astype(np.longdouble) / n
    v = (centred.T @ centred / n).astype(np.float64)
    values, directions = np.linalg.eigh(v)
    order = np.argsort(-values)[:most]
    white = centred.astype(np.float64) @ directions[:, order] / np.sqrt(np.maximum(values[order], 1e-300))
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s, strict=True)) for row in x]
    return white, values[order] / np.trace(v), deviation


def test_table_against_the_plain_solver(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    good = table[table.embedding.map(lambda v: v is not None and all(c is not None and np.isfinite(c) for c in v))]
    white, share, deviation = _plain(np.stack(good.embedding))
    got = queries.op13_whitening(spark, sf).toPandas()
    assert len(got) == 8 * len(good) and set(got.n) == {len(good)}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[good.vec_id].to_numpy()
    for k in range(8):
        assert min(np.abs(wide[:, k] - white[:, k]).max(), np.abs(wide[:, k] + white[:, k]).max()) < 1e-8
    assert np.allclose(got.groupby("component").explained.first(), share, rtol=1e-9)
    assert got.groupby("vec_id").deviation.first().loc[good.vec_id].tolist() == deviation
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=4).astype(np.float32).tolist(), k) for k in range(50)]
    rows += [(1, rows[0][1], 0), (None, rows[1][1], 0), (60, None, 0), (61, [1.0, None, 0.0, 0.0], 0), (62, [float("nan")] * 4, 0), (63, [float("inf"), 0.0, 0.0, 0.0], 0), (64, [], 0)]
    rows += [(70 + k, [float(k), 2.0 * k], 0) for k in range(5)] + [(80, [3.0, 3.0, 3.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").repartition(70)
    got = whitening.whiten(frame).collect()
    count = collections.Counter(r.vec_id for r in got)
    assert count[1] == 8 and count[None] == 4 and count[80] == 3 and count[70] == 2 and not {60, 61, 62, 63, 64} & {*count}
    flat = [r for r in got if r.vec_id is not None and 70 <= r.vec_id < 75]
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and {r.n for r in flat} == {5}
    assert all(r.whitened is None and r.explained == 0 and r.deviation == 0 for r in got if r.vec_id == 80)
    assert max(r.identity_error for r in got) < 1e-9
    assert whitening.whiten(frame.limit(0)).count() == 0


def test_deviation_beyond_a_long():
    x = np.array([[10**10, 0]])
    assert whitening.deviations(x, 10**6, [0, 0]) == [None]
    assert whitening.deviations(np.array([[5, 7]]), 2, [9, 14]) == [1]


@pytest.mark.parametrize("gap", [1.0, 1e-6])
def test_close_eigenvalues(gap):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    values = np.array([5.0, 5.0 - gap, 3, 2, 1, 0.5])
    exact = (q.astype(np.longdouble) * values.astype(np.longdouble)) @ q.T.astype(np.longdouble)
    high = exact.astype(np.float64)
    found, vectors = whitening.refined((high, (exact - high).astype(np.float64)), *np.linalg.eigh(high))
    assert np.allclose(np.sort(found), np.sort(values), rtol=1e-14)
    back = np.abs(vectors.T @ q).max(1)
    assert np.allclose(back, 1, atol=1e-12)
