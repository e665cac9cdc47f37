"""Whitening against numpy on the whole list, and the edges of its contract."""

import math

import numpy as np
import pytest

from pitstats.llm import whitening as wh


def plain(vectors, k=16):
    """Rows kept, and per row the whitened values up to sign, by float64 eigh over the whole list."""
    kept = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept])
    u = np.unique(x, axis=0)
    s, n = u.sum(axis=0), len(u)
    y = u - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    return [i for i, _ in kept], ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), n


def test_equals_numpy(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(20, 20))
    data = (rng.normal(size=(700, 20)) @ mix).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (800, None), (801, []), (802, [None] * 20), (803, [math.nan] + [0.0] * 19), (804, [math.inf] * 20)]
    rows += [(900 + i, rows[3][1]) for i in range(300)]  # one vector in a third of the rows
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n int").repartition(7)
    got = wh.whiten(df).toPandas()
    ids, deviation, white, explained, n = plain(rows)
    assert len(got) == 16 * len(ids) and set(got.n) == {n} == {700}
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    one = got[got.vec_id.isin(range(10))].drop_duplicates(["vec_id", "component"]).set_index(["vec_id", "component"])
    for i in range(10):
        at = ids.index(i)
        assert one.loc[i].deviation.tolist() == [deviation[at]] * 16
        assert np.allclose(np.abs(one.loc[i].whitened), np.abs(white[at]), rtol=1e-7, atol=1e-9)
    assert np.allclose(one.loc[0].explained, explained, rtol=1e-10)
    assert (got[got.vec_id.isna()].whitened.values == one.loc[7].whitened.values).all()
    by_vector = [got[got.vec_id == i].whitened.values for i in (3, 900, 1199)]
    assert (by_vector[0] == by_vector[1]).all() and (by_vector[0] == by_vector[2]).all()


@pytest.mark.parametrize("values", [np.arange(40, 0, -1.0), np.r_[np.ones(10), 1 + 1e-9 * np.arange(10), np.zeros(20)], np.r_[1e6, np.ones(39) * 1e-3], 1 + 1e-7 * np.arange(40)])
def test_refinement(values):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, x = wh.refined(a)
    assert np.allclose(x.T @ x, np.eye(40), atol=2e-15)
    high = np.longdouble
    left = a.astype(high) @ x.astype(high) - x.astype(high) * e.astype(high)
    assert np.abs(left).max() <= 4e-16 * np.abs(values).max()
    assert (np.diff(e) <= 0).all() and np.allclose(e, np.sort(values)[::-1], rtol=1e-12, atol=1e-14 * values.max())


def test_separate_eigenvectors_are_exact():
    """Vectors of eigenvalues 1e-5 apart, which float32 mixes, come out as a longer iteration in higher precision has them."""
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    values = 1 + 1e-5 * np.arange(12)[::-1]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    x = wh.refined(a)[1]
    b = a.astype(np.longdouble)
    for j in range(12):  # residual over gap bounds the angle to the true vector
        v = x[:, j].astype(np.longdouble)
        v /= np.sqrt(v @ v)
        assert np.abs(b @ v - (v @ b @ v) * v).max() / 1e-5 < 1e-10


def test_few_vectors_large_entries_and_empty(spark):
    one = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<double>")
    got = wh.whiten(one).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)] * 2
    two = spark.createDataFrame([(1, [0.0, 1.0, 3.0]), (2, [1.0, 1.0, 3.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.component, round(abs(r.whitened), 12), round(r.explained, 12)) for r in wh.whiten(two).collect())
    assert got == [(i, c, float(c == 1), float(c == 1)) for i in (1, 2) for c in (1, 2, 3)]
    big = spark.createDataFrame([(1, [2.0**49, 0.0]), (2, [-(2.0**49), 0.25]), (3, [1e300, 0.0])], "vec_id long, embedding array<double>")
    got = wh.whiten(big).collect()
    assert {r.vec_id for r in got} == {1, 2} and {r.deviation for r in got} == {None}
    assert wh.whiten(one.limit(0)).collect() == []
    assert wh.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []
