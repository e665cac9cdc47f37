"""Logistic regressions of all groups at a time, and product-limit survival, against plain computations."""

import numpy as np
import pytest

from pitstats.operators import dist, fit, value


def newton(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    return b


def test_grouped_logit(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for g, b in (("a", (0.3, 2.0, -1.0)), ("b", (-2.0, 0.1, 0.0)), (None, (0.0, 1.0, 1.0))):
        x = rng.normal(size=(400, 2)) * (1, 3)
        y = (rng.random(400) < 1 / (1 + np.exp(-(b[0] + x @ b[1:])))).astype(float)
        rows += [(g, float(u), float(v), float(t)) for (u, v), t in zip(x, y)]
        want[g] = newton(x, y)
    rows += [("same", 1.0, 2.0, 1.0)] * 5 + [("split", float(i), float(i % 3), float(i > 5)) for i in range(12)] + [("flat", 1.0, 1.0, float(i % 2)) for i in range(6)]
    rows += [("a", None, 1.0, 1.0), ("a", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, u double, v double, y double").repartition(7)
    got = {r.g: r for r in fit.grouped_logit(df.where("g is not null"), ["g"], ["u", "v"], "y").collect()}
    for g in ("a", "b"):
        assert np.allclose(got[g].coef, want[g], atol=1e-8) and got[g].n == 400
    assert got["same"].coef is None and got["flat"].coef is None
    assert got["split"].coef is None  # separated outcomes have no finite fit


def test_calibration_slope(spark):
    rng = np.random.default_rng(1)
    p = rng.random(3000) * 0.98 + 0.01
    o = (rng.random(3000) < 1 / (1 + np.exp(-(0.5 + 0.6 * np.log(p / (1 - p)))))).astype(int)
    df = spark.createDataFrame([("x", float(a), int(b)) for a, b in zip(p, o)], "c string, p double, o long")
    r = dist.calibration(df, "p", "o", ["c"]).collect()[0]
    assert np.allclose([r.level, r.slope], newton(np.log(p / (1 - p))[:, None], o), atol=1e-6)


def test_survival_worked_values(spark):
    # weeks 1..5; entity 1 plays 1, 2, 3 and stops; 2 plays all; 3 plays 2 and 4
    rows = [(1, w) for w in (1, 2, 3)] + [(2, w) for w in (1, 2, 3, 4, 5)] + [(3, 2), (3, 4)]
    df = spark.createDataFrame([(k, 2000, w, "g") for k, w in rows], "k long, season int, week long, g string")
    runs = value.runs(df, ["k", "season"], "season", "week")
    seen = {(r.k, r.week): (r.run, r.ended) for r in runs.collect()}
    assert seen == {(1, 1): (2, True), (1, 2): (1, True), (1, 3): (0, True), (2, 1): (4, False), (2, 2): (3, False), (2, 3): (2, False), (2, 4): (1, False),
                    (2, 5): (0, False), (3, 2): (0, True), (3, 4): (0, True)}
    got = {r.lead: (r.at_risk, r.ended, r.alive) for r in value.survival(runs, ["g"], 4).collect()}
    assert {h: v[:2] for h, v in got.items()} == {1: (9, 3), 2: (5, 1), 3: (3, 1), 4: (1, 0)}
    assert np.allclose([got[h][2] for h in (1, 2, 3, 4)], [2 / 3, 2 / 3 * 4 / 5, 2 / 3 * 4 / 5 * 2 / 3, 2 / 3 * 4 / 5 * 2 / 3])


@pytest.mark.parametrize("seasons", [[1], [1, 2, 5]])
def test_earlier_seasons(spark, seasons):
    df = spark.createDataFrame([(s, i) for s in seasons for i in range(2)], "season long, v int")
    got = sorted((r.season, r.v) for r in fit.earlier_seasons(df).collect())
    assert got == sorted((t, v) for s in seasons for t in seasons if s < t for v in range(2))


def test_survival_of_earlier_seasons_repeats_counts(spark):
    rows = [(s, k, w, "g") for s in (2000, 2001, 2003) for k in range(6) for w in range(1, 3 + (k * s) % 4)]
    runs = value.runs(spark.createDataFrame(rows, "season int, k long, week long, g string"), ["k", "season"], "season", "week")
    want = {tuple(r) for r in value.survival(fit.earlier_seasons(runs), ["season", "g"], 4).select("season", "lead", "at_risk", "ended", "alive").collect()}
    got = {tuple(r) for r in value.survival(runs, ["season", "g"], 4, "season").select("season", "lead", "at_risk", "ended", "alive").collect()}
    assert got == want and {r[0] for r in got} == {2001, 2003}
