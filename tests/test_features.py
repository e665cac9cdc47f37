"""Feature rows where players' rows lie, against the moving as-of joins."""

import random

from pitstats.operators import features, joins
from pitstats.plans import registry


def test_asof_few_equals_asof_strict(spark):
    r = random.Random(2)
    states = [(r.choice([None, *range(12)]), r.choice([None, *range(1, 20)]), float(r.randint(0, 5)), r.choice("abc")) for _ in range(150)]
    targets = [(r.choice([None, *range(14)]), r.randint(0, 21), i) for i in range(200)]
    s = spark.createDataFrame(states, "k int, i int, v double, w string").where("k is not null").repartition(5)
    t = spark.createDataFrame(targets, "k int, i int, n int").repartition(3)
    got = joins.asof_few(t, s, ["k"], "i", ["v", "w"])
    want = joins.asof_strict(t, s, ["k"], "i", ["v", "w"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_last_seasons_mean_by_the_last_game(spark):
    games = [(1, 200001, 2000, 4.0), (1, 200005, 2000, 6.0), (1, 200101, 2001, 1.0), (2, 200002, 2000, 3.0), (3, 199901, 1999, 7.0)]
    games = spark.createDataFrame([(k, gi, s, v, k, 1) for k, gi, s, v in games], "k long, gi long, season long, pts double, team long, targets long")
    targets = spark.createDataFrame([(k, k, gi, gi // 100) for k in (1, 2, 3, 4) for gi in (200101, 200102, 200201)], "k long, team long, gi long, season long")
    rows = features.feature_rows(targets, games)
    got = {(r.k, r.gi): (r.prev_mean, r.season_mean, r.career) for r in rows.collect()}
    assert got == {
        (1, 200101): (5.0, None, 2), (1, 200102): (5.0, 1.0, 3), (1, 200201): (1.0, None, 3), (2, 200101): (3.0, None, 1), (2, 200102): (3.0, None, 1), (2, 200201): (None, None, 1),
        (3, 200101): (None, None, 1), (3, 200102): (None, None, 1), (3, 200201): (None, None, 1), (4, 200101): (None, None, 0), (4, 200102): (None, None, 0), (4, 200201): (None, None, 0),
    }


def test_players_rows_move_once(spark):
    """Of all exchanges of the query, two move games and one customers by player, beside the players' own facts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = registry.queries()["pit_features_m2"](spark, "/root/testdata/sf0.001")
        plan = out._jdf.queryExecution().executedPlan().toString()
        by_player = [line for line in plan.split("\n") if "- Exchange hashpartitioning(k#" in line]
        assert len(by_player) <= 4, "\n".join(by_player)
        assert out.count() == out.select("k", "gi").distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
