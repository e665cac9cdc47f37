"""Starting sets, levels and player values, revision tests and leak checks on small worked cases."""

import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from pitstats.operators import dist, joins, leakage, value


def greedy(rows, slots, flex, flex_classes):
    """Best value first, into an own slot or else a flex slot."""
    left, spare, out = dict(slots), flex, {}
    for v, k, p in sorted(((-v, k, p) for k, p, v in rows if v > 0)):
        if left.get(p, 0) > 0:
            left[p] -= 1
            out[k] = p
        elif p in flex_classes and spare > 0:
            spare -= 1
            out[k] = "flex"
    return out


def test_starters_equal_greedy(spark):
    r = random.Random(1)
    rows = [(t, k, r.choice("abcd"), float(r.choice([0, -1, 3, 3, 5, 8, 13]))) for t in (1, 2) for k in range(300)]
    df = spark.createDataFrame(rows, "t int, k long, p string, v double").repartition(6)
    got = value.starters(df, "t", "p", "v", "k", {"a": 5, "b": 40, "c": 0}, 7, ["a", "c"])
    assert got.count() == len(rows)
    for t in (1, 2):
        want = greedy([(k, p, v) for u, k, p, v in rows if u == t], {"a": 5, "b": 40, "c": 0}, 7, ["a", "c"])
        assert {x.k: x.slot for x in got.where((F.col("t") == t) & F.col("starter")).collect()} == want
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_levels_and_values(spark):
    # one season of three weeks; 4 has no game in week 2; 3 and 4 are free
    rows = [(1, "a", w, 10.0) for w in (1, 2, 3)] + [(2, "a", w, 6.0 + w) for w in (1, 2, 3)] + [(3, "b", w, 4.0) for w in (1, 2, 3)] + [(4, "a", 1, 8.0), (4, "a", 3, 5.0)]
    df = spark.createDataFrame([(k, p, 2000, w, v) for k, p, w, v in rows], "k long, p string, season int, week int, v double")
    weekly = value.with_byes(df, ["k", "p"], "season", "week", "v").withColumn("rostered", F.col("k") <= 2)
    assert weekly.count() == 12 and weekly.where("not has_game").count() == 1
    levels = value.weekly_levels(weekly, "week", "p", "v", "k", "rostered", {"a": 1}, 1, ["a"])
    got = {(r.week, r.p): (r.marginal, r.waiver, r.streamer) for r in levels.collect()}
    assert got == {(1, "a"): (7.0, 8.0, 8.0), (2, "a"): (0.0, 0.0, 0.0), (3, "a"): (5.0, 5.0, 5.0), **{(w, "b"): (4.0, 4.0, 4.0) for w in (1, 2, 3)}}
    out = value.player_values(weekly, levels, "week", "p", "v", ["season", "k"], "week", {"early": F.col("week") <= 2})
    four = next(r for r in out.collect() if r.k == 4)
    assert (four.points, four.games, four.replacement, four.vor, four.vor_raw, four.vas, four.starter_weeks, four.byes) == (13.0, 2, 13.0, 0.0, 0.0, 1.0, 2, "2")
    one = next(r for r in out.collect() if r.k == 1)
    assert (one.vor, one.vor_raw, one.points_early, one.vor_early, one.byes) == (17.0, 17.0, 20.0, 12.0, "")


def test_martingale_and_revisions(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        pull = rng.normal()
        v = np.cumsum(np.r_[20, rng.normal(size=4) + pull])
        rows += [(k, i, float(x), float(v[-1])) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k long, i int, v double, f double")
    r = dist.martingale(df, "k", ["k"], ["i"], "v", "f").collect()[0]
    a = np.array([rows[j + 1][2] - rows[j][2] for j in range(len(rows) - 1) if rows[j][0] == rows[j + 1][0]])
    b = np.array([rows[j][3] - rows[j + 1][2] for j in range(len(rows) - 1) if rows[j][0] == rows[j + 1][0]])
    assert r.pairs == len(a) and np.isclose(r.cor, np.corrcoef(a, b)[0, 1]) and np.isclose(r.slope, np.polyfit(a, b, 1)[0])
    # the interval is near that of a bootstrap of whole clusters
    groups = np.repeat(np.arange(60), 4)
    draws = [np.corrcoef(a[at], b[at])[0, 1] for at in (np.concatenate([np.flatnonzero(groups == g) for g in rng.integers(0, 60, 60)]) for _ in range(400))]
    assert abs((r.cor_high - r.cor_low) / 3.92 / np.std(draws) - 1) < 0.3 and r.predictable
    d = df.where("i < 4").withColumns({"g": F.lit("x"), "day": F.col("i")})
    s = dist.revisions(d, ["g"], "k", "day", "v", "f", 5.0, 9).collect()[0]
    assert s.n == 240 and s.n_days == 4 and s.adopted_drift == 0.0 and s.adopted_spread == 0.0  # too few periods
    assert dist.revisions(d, ["g"], "k", "day", "v", "f", 5.0, 4).collect()[0].adopted_spread > 0


def test_a_leak_at_a_middle_cutoff_is_found(spark):
    at = lambda d, h: datetime(2024, 1, d, h)
    history = spark.createDataFrame([(k, at(d, h), 100 * k + 10 * d + h) for k in (1, 2) for d in (1, 2, 3) for h in (5, 20)], "k long, ts timestamp, x long")
    targets = spark.createDataFrame([(k, d, at(d, 12), 7) for k in (1, 2) for d in (1, 2, 3)], "k long, d int, cutoff timestamp, y long")

    def features(rows, seen, by):
        known = joins.latest_before(seen, rows, by, "ts", "cutoff", ["x"], ["x"])
        # on the second day only, a value of the evening is seen
        peek = seen.where("day(ts) = 2 and hour(ts) >= 12").groupBy(*by).agg(F.max("x").alias("p"))
        return known.join(peek, by, "left").withColumn("peek", F.when(F.col("d") == 2, F.col("p"))).drop("p")

    got = {(r.cutoff.day, r.column): (r.n, r.n_changed) for r in leakage.leak_check_all(targets, history, features, ["k"], ["k", "d"], "ts", "cutoff", [], ["y"]).collect()}
    assert got == {(d, c): (2, 2 if (d, c) == (2, "peek") else 0) for d in (1, 2, 3) for c in ("x", "peek")}


def test_history_moves_before_it_is_repeated(spark):
    """The versions' windows find their rows where the entity's history lies: no exchange sees repeated rows."""
    from pyspark.sql import Window

    at = lambda d, h: datetime(2024, 1, d, h)
    history = spark.createDataFrame([(k, at(d, 5), d) for k in range(4) for d in (1, 2, 3)], "k long, ts timestamp, x long")
    targets = spark.createDataFrame([(k, d, at(d, 12), 7) for k in range(4) for d in (1, 2, 3)], "k long, d int, cutoff timestamp, y long")
    plans = []

    def features(rows, seen, by):
        counted = seen.withColumn("n_known", F.count("*").over(Window.partitionBy(*by).orderBy("ts")))
        known = joins.latest_before(counted, rows, by, "ts", "cutoff", ["x", "n_known"], ["x"])
        plans.append(known._jdf.queryExecution().executedPlan().toString())
        return known

    report = leakage.leak_check_all(targets, history, features, ["k"], ["k", "d"], "ts", "cutoff", [], ["y"])
    assert {r.n_changed for r in report.collect()} == {0}
    exchanges = [line for line in plans[1].splitlines() if "Exchange" in line]
    assert exchanges and not any("_version" in line for line in exchanges)


def test_ranks_of_many_partitions(spark):
    """Ranks go on over range partitions, and no window holds a whole season."""
    r = random.Random(5)
    rows = [(s, k, r.choice(["a", "b", None]), float(r.randrange(30))) for s in (1, 2, None) for k in range(300)]
    got = value.ranked(spark.createDataFrame(rows, "s int, k long, p string, v double"), "s", "p", [F.desc("v"), F.col("k")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    numbered = [line for line in plan.splitlines() if "row_number()" in line and "windowspecdefinition(" in line]
    assert numbered and all("windowspecdefinition(_part" in line for line in numbered)
    seen, want = {}, {}
    for s, k, p, v in sorted(rows, key=lambda x: (-x[3], x[1])):
        for group in ((s,), (s, p)):
            seen[group] = seen.get(group, 0) + 1
        want[s, k] = seen[(s,)], seen[s, p]
    assert {(x.s, x.k): (x.overall_rank, x.position_rank) for x in got.collect()} == want


def test_levels_move_a_few_rows_of_each_task(spark):
    rows = [(k, p, 2000, w, float((k * w) % 7)) for k in range(60) for p in ("ab"[k % 2],) for w in (1, 2, 3) if (k + w) % 5]
    rows += [(None, "a", 2000, 1, 9.0), (7, None, 2000, 2, 9.0), (8, "a", None, 1, 9.0), (9, "b", 2000, None, 9.0), (61, "a", 2000, 3, None)]
    df = spark.createDataFrame(rows, "k long, p string, season int, week int, v double")
    weekly = value.with_byes(df, ["k", "p"], "season", "week", "v").withColumn("rostered", F.col("k") % 3 != 0)
    # by joins of all entities with all weeks, as the rows are defined
    grid = df.select("k", "p", "season").distinct().join(df.select("season", "week").distinct(), "season")
    plain = grid.join(df.withColumn("has_game", F.lit(True)), ["k", "p", "season", "week"], "left").na.fill({"v": 0.0, "has_game": False})
    columns = ["k", "p", "season", "week", "v", "has_game"]
    assert sorted(map(str, weekly.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))
    levels = value.weekly_levels(weekly, "week", "p", "v", "k", "rostered", {"a": 1, "b": 2}, 3, ["a"])
    started = value.starters(weekly, "week", "p", "v", "k", {"a": 1, "b": 2}, 3, ["a"]).where("p is not null and week is not null").collect()
    for r in levels.where("week is not null").collect():
        own = [x for x in started if (x.week, x.p) == (r.week, r.p)]
        most = lambda found: max(found, default=0.0)
        free = most([x.v for x in own if x.rostered is False])
        assert (r.marginal, r.waiver, r.streamer) == (most([x.v for x in own if not x.starter]), free, free)
    assert levels._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 1
