"""Isotonic distributional regression against the max-min formula, over many partitions."""

import numpy as np
import pytest

from pitstats.operators import isotonic as iso


def by_formula(x, o):
    """The fit that falls in x, at distinct x: the greatest over ends b of the least over beginnings a of mean(a..b), mirrored."""
    u = np.unique(x)
    s, n = np.array([o[x == v].sum() for v in u], float), np.array([(x == v).sum() for v in u], float)
    mean = lambda a, b: s[a : b + 1].sum() / n[a : b + 1].sum()
    return u, np.array([min(max(mean(a, b) for b in range(i, len(u))) for a in range(i + 1)) for i in range(len(u))])


def test_pooling_is_associative():
    rng = np.random.default_rng(0)
    x, o = np.arange(60.0), (rng.random(60) < np.linspace(0.9, 0.1, 60)).astype(float)
    whole = iso.pooled(x, x, np.ones(60), o)
    halves = [iso.pooled(x[s], x[s], np.ones(30), o[s]) for s in (slice(0, 30), slice(30, 60))]
    merged = iso.pooled(*(np.concatenate(c) for c in zip(*halves)))
    assert all((a == b).all() for a, b in zip(whole, merged))
    u, p = by_formula(x, o)
    assert np.allclose(iso.fitted_at(u, *whole), p)


def test_worked_values():
    # means 1, 1/2 (two rows), 1, 0 at x = 1, 2, 3, 4: 2 and 3 are pooled to 2/3
    low, high, n, s = iso.pooled(np.arange(1.0, 5), np.arange(1.0, 5), np.array([1, 2, 1, 1]), np.array([1, 1, 1, 0]))
    assert (low.tolist(), high.tolist(), n.tolist(), s.tolist()) == ([1, 2, 4], [1, 3, 4], [1, 3, 1], [1, 2, 0])
    assert np.allclose(iso.fitted_at(np.array([0.0, 1.5, 2.5, 3.5, 9.0]), low, high, n, s), [1, 5 / 6, 2 / 3, 1 / 3, 0])


@pytest.mark.parametrize("parts", ["3", "11"])
def test_fit_and_quantiles(spark, parts):
    rng = np.random.default_rng(2)
    rows = []
    for c in ("a", "b"):
        x = np.round(rng.gamma(2, 5, 160), 0)
        y = np.round(x * rng.random(160) * 2, 1)
        rows += [(c, float(a), float(b)) for a, b in zip(x, y)]
    rows += [("a", None, 1.0), ("b", 1.0, None), ("one", 4.0, 2.0)]
    df = spark.createDataFrame(rows, "c string, x double, y double").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set(coalesce, "false")  # so that classes do lie in several partitions
        levels, grid = [0.1, 0.5, 0.9], [i / 20 for i in range(21)]
        cells = iso.fit(df, ["c"], "x", "y", levels, grid).toPandas()
        new = spark.createDataFrame([("a", 7.25), ("b", 0.0), ("b", 500.0), ("none", 1.0)], "c string, x double")
        from pyspark.sql import functions as F

        out = iso.distribution(new, spark.createDataFrame(cells), ["c"], "x")
        got = {(r.c, r.x): r for r in out.withColumn("q", iso.quantile(F.col("f"), F.col("z"), 0.6, F.col("floor"))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset(coalesce)
    for c in ("a", "b"):
        x, y = (np.array([r[i] for r in rows if r[0] == c and None not in r]) for i in (1, 2))
        own = cells[cells.c == c].sort_values("k")
        g, z = np.unique(np.quantile(x, grid)), np.unique(np.quantile(y, levels))
        assert np.allclose(own.g0, g[:-1]) and np.allclose(own.g1, g[1:]) and np.allclose(own.z.iloc[0], z) and set(own.floor) == {y.min()}
        want = np.stack([np.interp(g, *by_formula(x, (y <= t).astype(float))) for t in z], axis=1)
        assert np.allclose(np.stack(own.f0), want[:-1]) and np.allclose(np.stack(own.f1), want[1:])
        for (k, at), r in got.items():
            if k == c:
                f = [np.interp(at, g, want[:, j]) for j in range(len(z))]
                assert np.allclose(r.f, f)
                assert np.isclose(r.q, max(y.min(), np.interp(0.6, f, z) if f[0] < 0.6 <= f[-1] else (z[0] if f[0] >= 0.6 else z[-1])))
    one = cells[cells.c == "one"]
    assert len(one) == 1 and one.f0.iloc[0].tolist() == [1.0] and got[("none", 1.0)].f is None


@pytest.mark.parametrize("piece", [1, 7])
def test_pieces_keep_equal_points_together(spark, piece):
    rng = np.random.default_rng(4)
    x = np.round(rng.gamma(2, 3, 90), 0)
    y = np.round(x * rng.random(90), 1)
    df = spark.createDataFrame([("a", float(u), float(v)) for u, v in zip(x, y)], "c string, x double, y double")
    got, want = (iso.fit(df, ["c"], "x", "y", [0.2, 0.5], [i / 10 for i in range(11)], piece=p).orderBy("k").collect() for p in (piece, 10_000))
    assert [r.f0 for r in got] == [r.f0 for r in want] and [r.f1 for r in got] == [r.f1 for r in want]


def test_many_points_are_pooled_in_passes():
    """A million points take less than a second; they took several before."""
    import time

    rng = np.random.default_rng(6)
    x, n = np.arange(1e6), np.ones(10**6)
    s = (rng.random(10**6) < np.linspace(0.7, 0.3, 10**6)).astype(float)
    began = time.process_time()
    low, high, m, total = iso.pooled(x, x, n, s)
    assert time.process_time() - began < 0.6
    assert m.sum() == 1e6 and total.sum() == s.sum() and (np.diff(total / m) < 0).all()
