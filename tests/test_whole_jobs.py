"""Queries and operators against plain Python over all rows."""

import bisect
import random
from datetime import datetime, time

import pytest
from pyspark.sql import functions as F
from test_queries import SF

from pitstats.operators import archive, dist, evaluate
from pitstats.plans import registry
from pitstats.plans.forecasts import EDGES, LEAST
from pitstats.sources.fixtures import view


def pairs_by_hand(data):
    out = {}
    for i, (m, g, k, a, p) in enumerate(data):
        for m2, g2, k2, a2, p2 in data[:i]:
            if (m, g) == (m2, g2) and a != a2:
                hit = 0.5 if p is None or p2 is None or p == p2 else float((a < a2) == (p < p2))
                out.setdefault(m, []).append(hit)
    return {m: (len(h), pytest.approx(sum(h) / len(h))) for m, h in out.items()}


@pytest.mark.parametrize("large", [5, 20_000])
def test_pairwise_accuracy_counts_all_pairs(spark, large):
    r = random.Random(1)
    data = [(m, g, k, float(r.randint(0, 30)), r.choice([None, *range(20)])) for m in "ab" for g in (1, 2) for k in range(90)]
    data = [(m, g, k, a, p if p is None else float(p if k % 3 else 7)) for m, g, k, a, p in data]
    df = spark.createDataFrame(data, "model string, gi int, k int, actual double, pred double")
    got = evaluate.pairwise_accuracy(df, ["gi"], "k", "actual", "pred", ["model"], large=large, blocks=6).collect()
    assert {x["model"]: (x["n_pairs"], x["accuracy"]) for x in got} == pairs_by_hand(data)


def test_next_after_by_hand(spark):
    records = spark.createDataFrame(
        [(1, "2024-01-01 05:00:00", 9), (1, "2024-01-01 18:00:00", 8), (1, "2024-01-01 18:00:00", 7), (1, "2024-01-04 01:00:00", 6), (1, "2024-01-04 02:00:00", 5), (None, "2024-01-09 00:00:00", 4)],
        "k int, ts string, id int",
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    cuts = ["2024-01-01 04:00:00", "2024-01-01 18:00:00", "2024-01-01 18:00:01", "2024-01-02 00:00:00", "2024-01-04 01:30:00", "2024-01-04 03:00:00", None]
    asked = spark.createDataFrame([(k, c) for k in (1, 2, None) for c in cuts], "k int, cut string").withColumn("cut", F.col("cut").cast("timestamp_ntz"))
    got = archive.next_after(asked, records, ["k"], "ts", "cut", ["id"]).collect()
    assert len(got) == 21 and all(r["id"] is None for r in got if r["k"] != 1)
    assert [r["id"] for r in sorted((r for r in got if r["k"] == 1 and r["cut"]), key=lambda r: r["cut"])] == [9, 7, 6, 6, 5, None]


def test_ledger_join_of_all_users(spark):
    """Each decision of sf0.01, whose ids pass 40, against the first event by plain search."""
    sf = SF.replace("0.001", "0.01")
    events = sorted((r["user_id"], r["ts"], r["event_id"]) for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id").collect())
    want = {}
    for k, day in {(k, ts.date()) for k, ts, _ in events}:
        at = bisect.bisect_left(events, (k, datetime.combine(day, time(18)), -1))
        want[k, day] = events[at][2] if at < len(events) and events[at][0] == k else None
    got = registry.queries()["ledger_join"](spark, sf).collect()
    assert len({k for k, _ in want}) > 40 and len(got) == len(want)
    assert {(r["k"], r["day"]): r["event_id"] for r in got} == want


def test_dev_scoring_scores_each_season_but_the_first(spark):
    """The same bands, made season by season."""
    games = view(spark, SF, "fx_proj").where("proj is not null").withColumn("e", F.col("actual") - F.col("proj")).cache()
    seasons = sorted(r["season"] for r in games.select("season").distinct().collect())
    want = {}
    for season in seasons[1:]:
        t = dist.residual_bands(games.where(F.col("season") < season), ["position"], "e", "proj", EDGES, 19, LEAST)
        scored = dist.apply_bands(games.where(F.col("season") == season), t, ["position"], "proj", EDGES).where("q is not null")
        hit = dist.covered(F.col("q")[1], F.col("q")[17], F.col("actual")).cast("double")
        for r in scored.groupBy("position").agg(F.count("*").alias("n"), F.avg(dist.crps(F.col("q"), F.col("actual"), 19)).alias("crps"), F.avg(hit).alias("hit")).collect():
            want[season, r["position"]] = (r["n"], pytest.approx(r["crps"], abs=1e-4), pytest.approx(r["hit"], abs=1e-4))
    got = registry.queries()["dev_scoring"](spark, SF).collect()
    assert {r["season"] for r in got} == set(seasons[1:]) and len(seasons) > 4
    assert {(r["season"], r["position"]): (r["n"], r["crps"], r["coverage"]) for r in got} == want


def test_bands_are_merged_until_large_enough(spark):
    """Fixed bands; a small one joins its lower neighbour, the lowest the next."""

    def by_hand(counts, least):
        groups = [[i] for i in range(len(counts))]
        while True:
            small = [i for i, g in enumerate(groups) if sum(counts[j] for j in g) < least]
            if not small or len(groups) == 1:
                return groups
            i = max(small)
            j = i - 1 if i else 1
            groups[min(i, j)] = sorted(groups[i] + groups[j])
            del groups[max(i, j)]

    r = random.Random(8)
    cases = [[0, 0, 0, 0], [5, 0, 0, 0], [3, 3, 3, 3], [9, 1, 9, 1], [1, 9, 1, 9], [2, 2, 9, 2]] + [[r.randint(0, 8) for _ in range(4)] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, counts array<bigint>")
    for row in df.select("i", dist.merged_bands(F.col("counts"), 5).alias("of")).collect():
        want = [n for n, g in enumerate(by_hand(cases[row["i"]], 5)) for _ in g]
        assert [max(row["of"]) - g for g in row["of"]] == want
    rows = spark.createDataFrame([("a", float(x), 0.5) for x in range(12)] + [("b", 1.0, 2.0)], "c string, x double, e double")
    table = dist.residual_bands(rows, ["c"], "e", "x", [4.0, 8.0], 3, 5)
    got = {(t["c"], t["band_lo"], t["band_hi"]): (t["n"], t["floor"]) for t in table.collect()}
    assert got == {("a", 1, 3): (12, 0.5), ("b", 1, 3): (1, 3.0)}


def test_player_documents_are_bounded(spark):
    """A document holds the players of one month and one thousand numbers, whatever the number of players."""
    from pitstats.plans.records import _player_documents
    from pitstats.sources.documents import PLAYER

    parsed = _player_documents(spark, "/root/testdata/sf0.01").select(F.from_json("text", PLAYER).alias("d"))
    spans = parsed.select(F.array_distinct(F.transform("d.players", lambda p: F.floor(p["id"] / 1000))).alias("of"))
    assert spans.where(F.size("of") != 1).isEmpty() and spans.select(F.explode("of")).distinct().count() > 1
