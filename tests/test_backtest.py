"""The backtest of values over replacement against plain Python on small cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from pitstats.operators import backtest, fit

SLOTS, FLEX, FLEXES = {"a": 2, "b": 1, "c": 1}, 2, ["a", "b", "d"]
CLASSES = ["a", "b", "c", "d"]


def seatable(counts):
    over = sum(max(0, counts[p] - SLOTS.get(p, 0)) for p in FLEXES)
    return over <= FLEX and all(n <= SLOTS.get(p, 0) for p, n in counts.items() if p not in FLEXES)


def allocate(rows):
    """Best value first, if the set still finds seats."""
    counts, out = dict.fromkeys(CLASSES, 0), []
    for k, p, v, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        if v > 0 and seatable({**counts, p: counts[p] + 1}):
            counts[p] += 1
            out.append((k, p, v))
    return out, counts


def swap(counts, p, q):
    after = dict(counts)
    after[p] -= 1
    after[q] += 1
    return seatable(after)


def replaced(rows, rostered, k=3):
    started, counts = allocate([r for r in rows if r[0] in rostered])
    free = [r for r in rows if r[0] not in rostered]
    out = {}
    for p in CLASSES:
        come = [q for q in CLASSES if swap(counts, p, q)] if counts[p] else [p]
        met = sorted((r for r in free if r[1] in come), key=lambda r: (-r[2], r[0]))
        if counts[p]:
            level = max([0.0, *(r[2] for r in met)])
        else:
            level = min((v for _, q, v in started if swap(counts, q, p)), default=0.0)
        out[p] = level, float(np.mean([r[3] for r in met[:k]])) if met else 0.0
    return out


def test_replacements_follow_exchange_rule(spark):
    r = random.Random(3)
    rows, want = [], {}
    for t in range(40):
        # few and many players: slots left open, flex slots full, classes without a starter
        players = [(k, r.choice(CLASSES[: r.choice([2, 4, 4])]), float(r.choice([0, 0, 1, 2, 3, 5, 8, 13, 21])) + k / 1000, float(r.randint(0, 30))) for k in range(r.choice([3, 8, 30]))]
        players = [(k, p, v if v >= 1 else 0.0, y) for k, p, v, y in players]
        rostered = {k for k, *_ in players if r.random() < 0.5}
        rows += [(t, k, p, v, y, k in rostered) for k, p, v, y in players]
        want |= {(t, p): x for p, x in replaced(players, rostered).items()}
    df = spark.createDataFrame(rows, "period long, k long, position string, v double, y double, rostered boolean").repartition(4)
    got = {(x.period, x.position): (x.level, x.realized) for x in backtest.replacements(df, (SLOTS, FLEX, FLEXES)).collect()}
    assert got.keys() == want.keys()
    for key, pair in want.items():
        assert np.allclose(got[key], pair), (key, got[key], pair)


def test_bucket_curves_equal_least_squares(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for p in ("a", "b"):
        bucket = rng.integers(0, 3, 300)
        x, o = rng.uniform(1, 20, 300), rng.normal(0, 0.2, 300)
        y = bucket + (1 + bucket) * x - 0.02 * x * x + 1.5 * x * o + rng.normal(size=300)
        is_in = [bucket == b for b in range(3)]
        design = np.column_stack([c * i for i in is_in for c in (np.ones(300), x, x * x)] + [x * o])
        coef = np.linalg.lstsq(design, y, rcond=None)[0]
        want |= {(p, str(b)): [*coef[3 * b : 3 * b + 3], coef[-1]] for b in range(3)}
        rows += [(p, str(b), float(i), float(i * j), float(k)) for b, i, j, k in zip(bucket, x, o, y)]
    rows += [("c", "0", 2.0, 0.0, 4.0), ("c", "0", 2.0, 0.0, 6.0)]
    want["c", "0"] = [5.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame(rows, "p string, bucket string, x double, u double, y double")
    got = {(r.p, r.bucket): [r.a, r.b, r.c, r.g] for r in fit.bucket_curves(df, ["p"], "bucket", "x", "u", "y", 20).collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert np.allclose(got[key], want[key], rtol=1e-6, atol=1e-6), key


def test_values_are_against_what_replacements_came_to(spark):
    # one class with one slot; 1 is rostered; 2 and 3 are free, and 2 is projected above 1 in the second week
    rows = [(1, 1, 9.0, 7.0), (2, 1, 4.0, 1.0), (3, 1, 3.0, 2.0), (1, 2, 5.0, 50.0), (2, 2, 6.0, 1.0), (3, 2, 1.0, 3.0)]
    df = spark.createDataFrame([(2000 * 10000 + 300 + w, 2000, 3, w, k, "a", v, y) for k, w, v, y in rows], "period long, season long, w long, week long, k long, position string, v double, y double")
    players = backtest.valued(df, ({"a": 1}, 0, []), 1)
    # week 1: 9 over 4, and 7 over the mean of 1 and 2; week 2 is not started, so its 50 points don't count
    assert {r.k: (r.rostered, r.vor, r.realized) for r in players.collect()} == {1: (True, 5.0, 5.5), 2: (False, 0.0, 0.0), 3: (False, 0.0, 0.0)}
    out = backtest.summaries(players, F.col("season") <= 2000, 1).where("season is not null").collect()
    assert [(r.split, r.w, r.n, r.projected, r.actual, r.ratio, r.top_projected) for r in out] == [("dev", 3, 1, 5.0, 5.5, 1.1, 3.0)]


def test_levels_and_horizons(spark):
    rows = [(1, "a", 2000, w, 0, p, float(w)) for w, p in [(1, 1.0), (2, 2.0), (3, None), (4, 3.0), (5, 4.0), (6, 0.0), (7, 9.0)]]
    df = spark.createDataFrame(rows, "k long, position string, season long, week long, team long, proj double, actual double")
    games = spark.createDataFrame([(2000, w, 0, 1) for w in (1, 2, 4, 5, 7, 8)], "season long, week long, team long, opponent long")
    factors = spark.createDataFrame([(2000, 4, "a", 1, 1.5)], "season long, w long, position string, defense long, opp double")
    got = backtest.horizons(backtest.player_seasons(df), games, factors, F.col("w").isin(4, 7)).collect()
    # week 8 has a game and no row; the opponent is known for week 4 only
    assert sorted((r.w, r.week, r.lvl, r.u, r.y, r.bucket) for r in got) == [
        (4, 4, 2.0, 1.0, 4.0, "h0"), (4, 5, 2.0, 1.0, 5.0, "h1"), (4, 7, 2.0, 1.0, 7.0, "h2_3"), (4, 8, 2.0, 1.0, 0.0, "h4_7"), (7, 7, 4.5, 0.0, 7.0, "h0"), (7, 8, 4.5, 0.0, 0.0, "h1")
    ]


def test_query_compares_projected_with_realized(spark):
    from pitstats.plans import registry

    out = registry.queries()["vor_backtest"](spark, "/root/testdata/sf0.001")
    assert {"season", "w", "projected", "actual", "ratio", "slope", "spearman", "top_projected", "top_actual", "pooled_ratio"} <= set(out.columns)
    assert out.where("season is null").count() > 0 and out.where("w is not null").count() > 0
