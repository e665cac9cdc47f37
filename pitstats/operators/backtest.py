"""Backtest of values over replacement: what a live valuation would have said in an earlier week, and what came of it.

Players are rows of k, position, season, week, team, proj and actual. A player is valued in a week in which they are
projected above 0, over the games of their team from that week on; games without a row of theirs count as 0 points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitstats.operators import fit, value, windows
from pitstats.sources.documents import scratch, write_once

#: The league: own slots of each class that may start, flex slots and the classes that may fill them.
League = tuple[dict[str, int], int, list[str]]


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    write_once(df, path)
    return df.sparkSession.read.parquet(path)


def player_seasons(rows: DataFrame) -> DataFrame:
    """A row for each player and season with its weeks (`own`); `lvl` is the mean of the last four positive projections
    up to a week. Rows are moved once; horizons are filled in where a player's season lies."""
    by = ["k", "position", "season"]
    known = windows.with_level_of_positives(rows.repartition(*by), "proj", by, "week", 4, "lvl")
    return known.groupBy(*by).agg(F.collect_list(F.struct("week", "team", "proj", "lvl", "actual")).alias("own"))


def opponent_factors(rows: DataFrame, games: DataFrame, weeks: DataFrame, k: float) -> DataFrame:
    """Per season, week `w`, class and defense: points allowed per game before the week, shrunk to the league's mean by k
    games and relative to it (`opp`)."""
    own = ["season", "w", "position"]
    met = rows.join(games, ["season", "week", "team"]).groupBy("season", "week", "position", F.col("opponent").alias("defense")).agg(F.sum("actual").alias("x"))
    allowed = met.join(F.broadcast(weeks), F.col("week") < F.col("w")).groupBy(*own, "defense").agg(F.sum("x").alias("allowed"))
    # from here on a row for each season, week, defense and class
    played = games.select("season", "week", F.col("opponent").alias("defense")).distinct().crossJoin(weeks)
    played = played.groupBy("season", "w", "defense").agg(F.count_if(F.col("week") < F.col("w")).alias("games"))
    grid = played.crossJoin(rows.select("position").distinct()).join(allowed, [*own, "defense"], "left").na.fill(0.0, ["allowed"])
    league = Window.partitionBy(*own)
    grid = grid.withColumn("_mean", F.sum("allowed").over(league) / F.greatest(F.sum("games").over(league), F.lit(1)))
    ratio = (F.col("allowed") + k * F.col("_mean")) / (F.col("games") + k) / F.col("_mean")
    return grid.select(*own, "defense", F.when(F.col("_mean") > 0, ratio).otherwise(1.0).alias("opp"))


def horizons(held: DataFrame, games: DataFrame, factors: DataFrame, when: Column) -> DataFrame:
    """Players of `player_seasons` in each week `w` that `when` (of w) allows, with every game (`week`) of their team from
    that week on: projection and level as of w, `u` (level times what the opponent is above the mean), points `y`, and the
    bucket of the weeks between."""
    schedule = games.groupBy("season", "team").agg(F.collect_list(F.struct("week", "opponent")).alias("games"))
    at = held.select("k", "position", "season", "own", F.explode(F.filter("own", lambda x: x["proj"] > 0)).alias("p"))
    at = at.select("k", "position", "season", "own", F.col("p.week").alias("w"), F.col("p.team").alias("team"), F.col("p.proj").alias("proj"), F.col("p.lvl").alias("lvl"))
    # a row for each season and team
    at = at.where(when).join(F.broadcast(schedule), ["season", "team"]).where(F.exists("games", lambda g: g["week"] == F.col("w")))
    ahead = at.select("k", "position", "season", "w", "proj", "lvl", "own", F.explode(F.filter("games", lambda g: g["week"] >= F.col("w"))).alias("g"))
    same = F.filter("own", lambda x: x["week"] == F.col("g.week"))
    rows = ahead.select(
        "k", "position", "season", "w", "proj", "lvl", F.col("g.week").alias("week"), F.col("g.opponent").alias("defense"),
        F.coalesce(F.get(same, F.lit(0))["actual"], F.lit(0.0)).alias("y"),
    )
    h = F.col("week") - F.col("w")
    bucket = F.when(h == 0, "h0").when(h == 1, "h1").when(h <= 3, "h2_3").when(h <= 7, "h4_7").otherwise("h8p")
    rows = rows.join(F.broadcast(factors), ["season", "w", "position", "defense"], "left")
    return rows.withColumn("u", F.col("lvl") * (F.coalesce("opp", F.lit(1.0)) - 1)).withColumn("bucket", bucket).drop("opp", "defense")


def curves(held: DataFrame, games: DataFrame, factors: DataFrame, dev: Column, weeks: Column, least: int) -> DataFrame:
    """Position, bucket and the coefficients of expected points, fitted on the seasons that `dev` names: of the week's
    projection for bucket h0 (all weeks), of level, its square and the opponent for later weeks."""
    past = held.where(dev)
    later = fit.bucket_curves(horizons(past, games, factors, weeks).where("bucket <> 'h0'"), ["position"], "bucket", "lvl", "u", "y", least)
    met = F.broadcast(games.select("season", "week", "team").distinct())
    shown = past.select("position", "season", F.inline(F.filter("own", lambda x: x["proj"] > 0))).join(met, ["season", "week", "team"], "left_semi")
    now = shown.groupBy("position").agg(
        F.coalesce(F.regr_intercept("actual", "proj"), F.avg("actual")).alias("a"), F.coalesce(F.regr_slope("actual", "proj"), F.lit(0.0)).alias("b")
    )
    now = now.select("position", F.lit("h0").alias("bucket"), "a", "b", F.lit(0.0).alias("c"), F.lit(0.0).alias("g"))
    # coefficients as a valuation would publish them
    return now.unionByName(later.drop("n")).select("position", "bucket", *(F.round(c, 9 if c == "c" else 6).alias(c) for c in "abcg"))


def expected(rows: DataFrame, coefs: DataFrame) -> DataFrame:
    """`rows` of `horizons` with `v`, the points expected in each week; 0 where a class has no fit."""
    x = F.when(F.col("bucket") == "h0", F.col("proj")).otherwise(F.col("lvl"))
    e = F.col("a") + F.col("b") * x + F.col("c") * x * x + F.col("g") * F.col("u")
    period = F.col("season") * 10000 + F.col("w") * 100 + F.col("week")
    rows = rows.join(F.broadcast(coefs), ["position", "bucket"], "left")
    return rows.select(period.alias("period"), "season", "w", "week", "k", "position", "y", F.greatest(e, F.lit(0.0)).alias("v"))


def weekly_values(rows: DataFrame, games: DataFrame, dev: Column, fit_weeks: tuple[int, int], weeks: list[int], k: float = 4.0, least: int = 20) -> DataFrame:
    """Expected points and outcomes of players valued in `weeks`; fits are of the seasons that `dev` names.

    What several passes read is stored, so that all see the same numbers.
    """
    spark = rows.sparkSession
    games = _stored(games.distinct(), "games")
    held = _stored(player_seasons(rows), "player-seasons")
    factors = _stored(opponent_factors(rows, games, spark.range(fit_weeks[0], fit_weeks[1] + 1).select(F.col("id").alias("w")), k), "opponents")
    coefs = _stored(curves(held, games, factors, dev, F.col("w").between(*fit_weeks), least), "curves")
    return _stored(expected(horizons(held, games, factors, F.col("w").isin(*weeks)), coefs), "weekly")


def pool(weekly: DataFrame, league: League, size: int) -> DataFrame:
    """Season, w, position and k of those on a roster: each class has the share of `size` that it has of all starters, and
    those with the most expected points of the horizon fill it."""
    own = ["season", "w", "position"]
    seated = value.seats(weekly, "period", "position", "v", "k", *league)
    counts = seated.groupBy(F.floor(F.col("period") / 10000).alias("season"), (F.floor(F.col("period") / 100) % 100).alias("w"), "position").agg(F.count("*").alias("_c"))
    share = F.col("_c") / F.sum("_c").over(Window.partitionBy("season", "w"))
    counts = counts.select(*own, F.round(share * size).alias("_size"))
    totals = weekly.groupBy(*own, "k").agg(F.sum("v").alias("_v")).withColumn("_v", F.round("_v", 6))
    totals = totals.withColumn("_r", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("_v"), "k"))).where(F.col("_r") <= size)
    # counts have a row for each season, week and class
    return totals.join(F.broadcast(counts), own).where("_r <= _size").select(*own, "k")


def replacements(weekly: DataFrame, league: League, k: int = 3) -> DataFrame:
    """Period, position, `level` and `realized` from `weekly` (period, k, position, v, y, rostered), for classes of a slot.

    `level` is the best value on no roster that can take the place of a starter of the class among the rostered, so that
    all others still find seats; a class that nobody starts of has the price of entry, the least value of a starter whose
    place it could take. `realized` is the mean of what the `k` best-projected ones came to (of the class itself where
    nobody starts of it). Both are 0 where there is nobody.
    """
    slots, flex, flex_classes = league
    classes = sorted({*slots, *flex_classes})
    size = reduce(lambda a, c: a.when(F.col("position") == c, slots.get(c, 0)), classes, F.when(F.lit(False), 0))
    rostered = weekly.where("rostered")
    seated = value.seats(rostered, "period", "position", "v", "k", *league).join(rostered.select("period", "position", "k", "v"), ["period", "position", "k"])
    seated = seated.groupBy("period", "position").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    best = Window.partitionBy("period", "position").orderBy(F.desc("v"), "k")
    free = weekly.where("not rostered").select("period", "position", "k", "v", "y").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    # from here on a few rows for each period and class; each class that leaves meets each that may come instead
    each = weekly.select("period").distinct().select("period", F.explode(F.lit(classes)).alias("position"))
    counts = each.join(seated, ["period", "position"], "left").na.fill(0, ["n"]).withColumn("size", size).withColumn("flexes", F.col("position").isin(*flex_classes))
    over = F.sum(F.when(F.col("flexes"), F.greatest(F.col("n") - F.col("size"), F.lit(0))).otherwise(0)).over(Window.partitionBy("period"))
    counts = _stored(counts.withColumn("over", over), "seat-counts")
    renamed = lambda tag: counts.select("period", *(F.col(c).alias(f"{tag}_{c}") for c in ("position", "n", "least", "size", "flexes")))
    pairs = renamed("out").join(renamed("in"), "period").join(counts.select("period", "over").distinct(), "period")
    frees = (F.col("out_flexes") & (F.col("out_n") > F.col("out_size"))).cast("int")
    takes = (F.col("in_n") >= F.col("in_size")).cast("int")
    fits = (F.col("out_position") == F.col("in_position")) | F.when(F.col("in_flexes"), F.col("over") - frees + takes <= flex).otherwise(F.col("in_n") < F.col("in_size"))
    pairs = _stored(pairs.where((F.col("out_n") > 0) & fits).select("period", "out_position", "in_position", "out_least", "in_n"), "exchanges")
    nobody = counts.where("n = 0").select("period", "position")
    entry = pairs.where("in_n = 0").groupBy("period", F.col("in_position").alias("position")).agg(F.min("out_least").alias("_entry"))
    come = pairs.select("period", F.col("out_position").alias("position"), F.col("in_position").alias("_q"), F.lit(True).alias("_full"))
    come = come.unionByName(nobody.select("*", F.col("position").alias("_q"), F.lit(False).alias("_full")))
    met = come.join(free.withColumnRenamed("position", "_q"), ["period", "_q"])
    met = met.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    found = met.groupBy("period", "position").agg(F.max(F.when(F.col("_full"), F.col("v"))).alias("_best"), F.avg("y").alias("_mean"))
    out = counts.join(found, ["period", "position"], "left").join(entry, ["period", "position"], "left")
    level = F.when(F.col("n") > 0, F.greatest("_best", F.lit(0.0))).otherwise(F.coalesce("_entry", F.lit(0.0)))
    return out.select("period", "position", level.alias("level"), F.coalesce("_mean", F.lit(0.0)).alias("realized"))


def valued(weekly: DataFrame, league: League, size: int) -> DataFrame:
    """Season, w, k, position, `rostered`, and over the horizon `vor`, the expected points over replacement, and
    `realized`: in weeks projected above replacement, points over what replacements came to."""
    own = ["season", "w", "position", "k"]
    chosen = F.broadcast(_stored(pool(weekly, league, size), "rostered").withColumn("rostered", F.lit(True)))  # `size` for each season and week
    weekly = weekly.join(chosen, own, "left").na.fill(False, ["rostered"])
    levels = _stored(replacements(weekly, league), "replacements")
    rows = weekly.join(F.broadcast(levels), ["period", "position"])
    over = F.col("v") > F.col("level")
    sums = rows.groupBy(*own, "rostered").agg(
        F.sum(F.greatest(F.col("v") - F.col("level"), F.lit(0.0))).alias("vor"), F.sum(F.when(over, F.col("y") - F.col("realized")).otherwise(0.0)).alias("realized")
    )
    return sums.withColumns({c: F.round(c, 6) for c in ("vor", "realized")})


def _ranks(x: str, by: list[str]) -> Column:
    """Ranks from the least on, equal values sharing their mean."""
    same = F.count("*").over(Window.partitionBy(*by, x))
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (same - 1) / F.lit(2.0)


def _calibration(top: DataFrame, by: list[str]) -> DataFrame:
    return top.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("vor").alias("projected"), F.avg("realized").alias("actual"), F.sum("vor").alias("_vor"), F.sum("realized").alias("_realized"),
        (F.sum("realized") / F.nullif(F.sum("vor"), F.lit(0.0))).alias("ratio"), F.regr_slope("realized", "vor").alias("slope"),
    )


def summaries(players: DataFrame, dev: Column, size: int, first: int = 30, biased: float = 0.25) -> DataFrame:
    """Of `valued`: rows for each season, week and class, and, with season and w null, for each split and class.

    n, means, ratio and slope are of a class's best by `vor`, as many as it has on rosters; `spearman` is among the
    rostered (the mean of seasons and weeks for a split); `top_projected` and `top_actual` say how many of a season and
    week's `first` players are of the class (mean for a split). A split has the ratio of all its classes, too, and whether
    a class's own is off it by more than `biased`.
    """
    split = F.when(dev, "dev").otherwise("check").alias("split")
    players = _stored(players.select(split, "*"), "valued")
    week, own = ["split", "season", "w"], ["split", "season", "w", "position"]
    held = players.where("rostered")
    place = lambda x, by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(x), "k", "position"))
    best = players.withColumn("_r", place("vor", own)).where(F.col("_r") <= size)
    # a row for each season, week and class
    top = _stored(best.join(F.broadcast(held.groupBy(*own).agg(F.count("*").alias("_k"))), own).where("_r <= _k"), "best")
    ranked = held.select(*own, _ranks("vor", own).alias("p"), _ranks("realized", own).alias("q")).groupBy(*own)
    # null, as `corr` under ANSI isn't, where ranks are all alike
    rho = ranked.agg((F.covar_pop("p", "q") / F.nullif(F.stddev_pop("p") * F.stddev_pop("q"), F.lit(0.0))).alias("spearman"))
    out = players.select(*own).distinct().join(_calibration(top, own), own, "left").join(rho, own, "left")
    for name, x in (("top_projected", "vor"), ("top_actual", "realized")):
        among = players.withColumn("_r", place(x, week)).where(F.col("_r") <= first)
        out = out.join(among.groupBy(*own).agg(F.count("*").alias(name)), own, "left")
    out = _stored(out.na.fill(0, ["n", "top_projected", "top_actual"]), "by-week")
    # from here on a row for each split and class; a class that a week doesn't have counts as none of its first
    weeks = out.select(*week).distinct().groupBy("split").agg(F.count("*").alias("_weeks"))
    means = out.groupBy("split", "position").agg(F.avg("spearman").alias("spearman"), *(F.sum(c).alias(c) for c in ("top_projected", "top_actual")))
    means = means.join(weeks, "split").withColumns({c: F.col(c) / F.col("_weeks") for c in ("top_projected", "top_actual")})
    pooled = top.groupBy("split").agg((F.sum("realized") / F.nullif(F.sum("vor"), F.lit(0.0))).alias("pooled_ratio"))
    whole = means.join(_calibration(top, ["split", "position"]), ["split", "position"], "left").join(pooled, "split", "left").na.fill(0, ["n"])
    whole = whole.withColumn("biased", F.abs(F.col("ratio") / F.nullif(F.col("pooled_ratio"), F.lit(0.0)) - 1) > biased)
    columns = ["split", "season", "w", "position", "n", "projected", "actual", "ratio", "slope", "spearman", "top_projected", "top_actual", "pooled_ratio", "biased"]
    out = out.withColumns({c: F.col(c).cast("double") for c in ("top_projected", "top_actual")})
    return out.select(*columns[:-2]).unionByName(whole.select(*(c for c in columns if c not in ("season", "w"))), allowMissingColumns=True).select(*columns)
