"""Operators on tiny inputs with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pitstats.functions import scalars as fn
from pitstats.operators import checks, dedup, dist, evaluate, fit, joins, leakage, scoring, value, windows


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


def series(spark, values):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, x double")


def test_trailing_mean(spark):
    mean = lambda xs, k: column(series(spark, xs).withColumn("m", windows.trailing_mean("x", ["k"], ["i"], k)), "m", "i")
    assert mean([1.0, 2.0, 3.0, 4.0], 2) == [1, 1.5, 2.5, 3.5]
    assert mean([1.0, 2.0, 3.0], 8) == [1, 1.5, 2]
    assert mean([None, 2.0, None, 4.0], 2) == [None, 2, 2, 4]


def test_ewma_equals_the_recursion(spark):
    xs = [3.0, None, 5.0, 1.0, None, 2.0]
    got = column(windows.with_ewma(series(spark, xs), "x", ["k"], ["i"], 2.0, "e"), "e", "i")
    num = den = 0.0
    for x, g in zip(xs, got):
        num, den = num * 0.5**0.5 + (x or 0.0), den * 0.5**0.5 + (x is not None)
        assert g == pytest.approx(num / den)


def test_asof_is_strict(spark):
    states = spark.createDataFrame([("a", 202401, 10.0), ("a", 202402, 20.0)], "k string, gi int, v double")
    targets = spark.createDataFrame([("a", 202401), ("a", 202402), ("a", 202403), ("b", 202403)], "k string, gi int")
    out = joins.asof_strict(targets, states, ["k"], "gi", ["v"], "at").orderBy("k", "gi").collect()
    assert [r["v"] for r in out] == [None, 10, 20, None] and [r["at"] for r in out] == [None, 202401, 202402, None]


def test_latest_before_excludes_the_instant(spark):
    records = spark.createDataFrame([(1, 10, 1, "x"), (1, 20, 2, "y")], "k int, t int, id int, v string")
    cuts = spark.createDataFrame([(1, 10), (1, 20), (1, 21), (2, 5)], "k int, cut int")
    out = joins.latest_before(records, cuts, ["k"], "t", "cut", ["v"], ["id"]).orderBy("k", "cut").collect()
    assert [r["v"] for r in out] == [None, "x", "y", None]


def test_streak_and_levels(spark):
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, True, False, True, True])], "k int, i int, f boolean")
    assert column(windows.with_streak(df, "f", ["k"], "i", "s"), "s", "i") == [0, 1, 2, 0, 1]
    got = column(windows.with_level_of_positives(series(spark, [0.0, 2.0, 4.0, None, 6.0, 8.0, 10.0]), "x", ["k"], "i", 4, "l"), "l", "i")
    assert got == [None, 2, 3, 3, 4, 5, 7]


def test_checks(spark):
    df = series(spark, [1.0, None, 3.0])
    with pytest.raises(checks.DataCheckError):
        checks.assert_unique_key(df, ["k"])
    with pytest.raises(checks.DataCheckError):
        checks.assert_rules(df, checks.not_missing(["x"]))
    assert checks.assert_rules(df, checks.in_range("x", 0, 3)) is df
    miss = {r["column"]: r["n_missing"] for r in checks.missingness(df).collect()}
    assert miss == {"k": 0, "i": 0, "x": 1}


def test_safe_left_join_refuses_repeated_keys(spark):
    left, right = series(spark, [1.0]), spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="unique"):
        joins.safe_left_join(left, right, ["k"])
    with pytest.raises(ValueError, match="unmatched"):
        joins.safe_left_join(left, spark.createDataFrame([(2,)], "k int"), ["k"], 0.5)


def test_pareto_and_unique_best(spark):
    df = spark.createDataFrame([("g", x, y) for x, y in [(1, 5), (2, 5), (3, 1), (2, 4), (3, 1), (0, 9)]], "g string, x int, y int")
    assert sorted((r.x, r.y) for r in dedup.pareto(df, ["g"], "x", "y").collect()) == [(0, 9), (2, 5), (3, 1), (3, 1)]
    rows = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2)], "k int, p int")
    assert [r.k for r in dedup.unique_best(rows, ["k"], F.col("p")).collect()] == [2]


def test_scoring(spark):
    df = spark.createDataFrame([(2.0, None)], "a double, b double")
    assert df.select(scoring.weighted_score(df, {"a": 0.5, "b": 3.0}).alias("s")).first().s == 1.0
    with pytest.raises(ValueError):
        scoring.weighted_score(df, {"c": 1.0})


def test_names_and_bands(spark):
    df = spark.createDataFrame([("Odell  Beckham Jr.", 3.0), ("José Núñez III", None)], "n string, x double")
    assert column(df.withColumn("m", fn.name_normalise(F.col("n"))), "m", "n") == ["jose nunez", "odell beckham"]
    assert sorted(column(df.withColumn("b", fn.band(F.col("x"), [1.0, 3.0])), "b", "n"), key=str) == [3, None]


def test_rolling_line_sees_earlier_rows_only(spark):
    df = spark.createDataFrame([("p", i, float(i), 2.0 * i + 1) for i in range(1, 6)], "c string, t int, x double, y double")
    line = fit.rolling_line(df, ["c"], "t", "x", "y", 2).orderBy("t").collect()
    assert [(r.a, r.b) for r in line[:2]] == [(0, 1), (0, 1)]
    assert all(r.a == pytest.approx(1) and r.b == pytest.approx(2) for r in line[2:])


def test_rate_table_falls_back(spark):
    df = spark.createDataFrame([("a", "u", 1.0)] * 3 + [("a", "v", 0.0)], "x string, y string, o double")
    table = fit.rate_table(df, ["x", "y"], "o", 3)
    got = fit.apply_rates(df, table, ["x", "y"]).groupBy("y").agg(F.max("p").alias("p")).collect()
    assert {r.y: r.p for r in got} == {"u": 1.0, "v": 0.75}


def test_scores_of_forecasts(spark):
    q = F.array(*map(F.lit, [1.0, 2.0, 3.0]))
    row = spark.range(1).select(
        dist.crps(q, F.lit(2.0), 3).alias("c"), dist.cdf(q, F.lit(2.5), 3).alias("f"), dist.interval_score(F.lit(1.0), F.lit(3.0), F.lit(4.0), 0.2).alias("s")
    ).first()
    assert row.f == pytest.approx(0.625) and row.s == pytest.approx(12.0) and row.c == pytest.approx(2 * (0.25 + 0 + 0.25 + 0.25) / 4)


def test_leaks_are_caught(spark):
    history = spark.createDataFrame([(1, i, float(i)) for i in range(5)], "k int, gi int, x double")
    targets = history.select("k", "gi")
    honest = lambda rows, h: joins.asof_strict(rows, h, ["k"], "gi", ["x"])
    leaky = lambda rows, h: rows.join(h, ["k", "gi"])
    leakage.leak_gate(leakage.leak_check(targets, history, honest, ["k", "gi"], "gi", [3], ["k"]))
    with pytest.raises(leakage.LeakError):
        leakage.leak_gate(leakage.leak_check(targets, history, leaky, ["k", "gi"], "gi", [3], ["k"]))


def test_starters_fill_own_slots_then_flex(spark):
    rows = [(1, "A", k, v) for k, v in enumerate([9.0, 8.0, 7.0])] + [(1, "B", 10 + k, v) for k, v in enumerate([6.0, 7.5])]
    df = spark.createDataFrame(rows, "t int, p string, k int, v double")
    started = value.starters(df, "t", "p", "v", "k", {"A": 1, "B": 1}, 2, ["A", "B"])
    assert {r.k: r.slot for r in started.collect() if r.starter} == {0: "A", 11: "B", 1: "flex", 2: "flex"}
    assert {r.p: r.replacement for r in value.baselines(started, "t", "p", "v", ["A", "B"]).collect()} == {"A": 6.0, "B": 6.0}


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(s, c, float((s * 7 + c * 3) % 5)) for s in range(2) for c in range(12)], "s int, c int, d double")
    a, b = (evaluate.cluster_bootstrap(df.repartition(n), "d", ["s"], "c", 50, 1).first() for n in (1, 7))
    assert a == b and a.low <= a.mean <= a.high


def test_bootstrap_of_many_clusters_in_blocks(spark):
    """Clusters fill many blocks; equals draws made one by one, and only packed pieces of draws are moved."""
    import hashlib

    import numpy as np

    from pitstats.operators import evaluate

    rows = [(s, f"c{i:03d}", float((i * 37 + len(s)) % 11) - 5) for s in ("a", "bb") for i in range(90 if s == "a" else 7) for _ in range(i % 3 + 1)]
    df = spark.createDataFrame([*rows, (None, "c1", 9.0)], "s string, c string, d double").repartition(5)
    got = evaluate.cluster_bootstrap(df, "d", ["s"], "c", 60, 4, block=8).first()
    total, count = np.zeros(60), np.zeros(60)
    for s in ("a", "bb"):
        names = sorted({c for t, c, _ in rows if t == s})
        sums = [(sum(d for t, k, d in rows if (t, k) == (s, c)), sum((t, k) == (s, c) for t, k, _ in rows)) for c in names]
        for rep in range(60):
            for slot in range(1, len(names) + 1):
                u = int(hashlib.md5(f"4|{rep + 1}|{s}|{slot}".encode()).hexdigest()[:12], 16) / (1 << 48)
                v, n = sums[int(u * len(names))]
                total[rep] += v
                count[rep] += n
    m = total / count
    want = ((sum(d for *_, d in rows) + 9) / (len(rows) + 1), np.quantile(m, 0.025), np.quantile(m, 0.975), (m < 0).mean())
    assert np.allclose(list(got), want)
    drawn = evaluate._drawn_sums(evaluate._numbered(df.groupBy("s", "c").agg(F.sum("d").alias("_s"), F.count("d").alias("_n")), ["s"], "c"), ["s"], 60, 4, 8)
    assert "places" in drawn._jdf.queryExecution().toString() and drawn.count() == 60
