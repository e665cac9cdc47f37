"""Horizon forecasts, starting sets and value over replacement, as windows over (period, class)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitstats.operators.fit import earlier_seasons
from pitstats.sources.documents import scratch, write_once


def seats(weekly: DataFrame, period: str, position: str, value: str, key: str, slots: dict[str, int], flex: int, flex_classes: list[str]) -> DataFrame:
    """Period, class, key and `slot` of those of `weekly` who start; see `starters`."""
    best = Window.partitionBy(period, position).orderBy(F.desc(value), key)
    among = weekly.select(period, position, value, key).where(F.col(value) > 0)
    among = among.withColumn("_own", F.row_number().over(best)).where(F.col("_own") <= max(slots.values(), default=0) + flex)
    size = reduce(lambda a, i: a.when(F.col(position) == i[0], i[1]), slots.items(), F.when(F.lit(False), 0)).otherwise(0)
    own = among.where(F.col("_own") <= size).select(period, position, key, F.col(position).cast("string").alias("slot"))
    rest = among.where((F.col("_own") > size) & F.col(position).isin(*flex_classes))
    rest = rest.withColumn("_flex", F.row_number().over(Window.partitionBy(period).orderBy(F.desc(value), key))).where(F.col("_flex") <= flex)
    return own.unionByName(rest.select(period, position, key, F.lit("flex").alias("slot")))


def starters(weekly: DataFrame, period: str, position: str, value: str, key: str, slots: dict[str, int], flex: int, flex_classes: list[str]) -> DataFrame:
    """`weekly` with `starter` and `slot`: the best of each class fill its own slots, the best of the rest the flex slots.

    Values of 0 and less never start. For slots of this (laminar) kind the greedy choice is the best league-wide set. No
    more than a class's own and the flex slots can start of a class, so each map task first keeps its best so many of a
    period and class (a limit that Spark applies before it shuffles), and the choice is among these. `key` is unique in a
    period and class.
    """
    chosen = seats(weekly, period, position, value, key, slots, flex, flex_classes)
    return weekly.join(chosen, [period, position, key], "left").withColumn("starter", F.col("slot").isNotNull())


def with_byes(rows: DataFrame, by: list[str], season: str, week: str, value: str) -> DataFrame:
    """A row for each entity (`by`) of a season and each of the season's weeks, with `has_game`; without one the value is 0.

    Only the given rows are moved, to their entity and season; weeks are filled in there, so that what is summed for each
    entity and season needn't be moved again.
    """
    weeks = rows.select(season, week).distinct().groupBy(season).agg(F.collect_list(F.struct(F.col(week).alias("w"))).alias("_weeks"))
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*by, week)])
    zero = F.lit(0).cast(rows.schema[value].dataType)
    entry = F.struct(F.struct(F.col(week).alias("w")).alias("w"), F.coalesce(F.col(value), zero).alias("v"), F.lit(True).alias("g"))
    own = rows.where(F.col(season).isNotNull()).groupBy(*by, season).agg(F.collect_list(F.when(known, entry)).alias("_own"))
    off = F.transform(F.array_except("_weeks", F.col("_own.w")), lambda w: F.struct(w.alias("w"), zero.alias("v"), F.lit(False).alias("g")))
    # a row for each season, with its weeks
    filled = own.join(F.broadcast(weeks), season).select(*by, season, F.explode(F.concat("_own", off)).alias("_e"))
    return filled.select(*by, season, F.col("_e.w.w").alias(week), F.col("_e.v").alias(value), F.col("_e.g").alias("has_game"))


def weekly_levels(
    weekly: DataFrame, period: str, position: str, value: str, key: str, rostered: str, slots: dict[str, int], flex: int, flex_classes: list[str]
) -> DataFrame:
    """Per period and class three levels, 0 where nobody is left:

    `marginal`, the best value that doesn't start, and `waiver`, the best on no roster, over the classes that share slots;
    `streamer`, the best on no roster in the class itself.

    The starters of a class are its first in order, so the best that doesn't start is among its first few or is not
    above 0; beyond these, rows only give maxima, so none but the first few of each map task are moved.
    """
    group = F.when(F.col(position).isin(*flex_classes), "flex").otherwise(F.col(position))
    free = F.max(F.when(~F.col(rostered), F.col(value))).alias("_free")
    rest = weekly.groupBy(period, position).agg(free, F.max(F.when(F.col(value) <= 0, F.col(value))).alias("_low"))
    best = Window.partitionBy(period, position).orderBy(F.desc(value), key)
    first = weekly.select(period, position, value, key).where(F.col(value) > 0).withColumn("_own", F.row_number().over(best))
    first = first.where(F.col("_own") <= max(slots.values(), default=0) + flex + 1).drop("_own")
    spare = starters(first, period, position, value, key, slots, flex, flex_classes).where(~F.col("starter"))
    spare = spare.groupBy(period, position).agg(F.max(value).alias("_spare"))
    # from here on a row for each period and class
    own = rest.join(spare, [period, position], "left").withColumn("_g", group)
    shared = own.groupBy(period, "_g").agg(F.greatest(F.max("_spare"), F.max("_low")).alias("marginal"), F.max("_free").alias("waiver"))
    own = own.withColumn("streamer", F.col("_free"))
    return own.join(shared, [period, "_g"]).select(period, position, "streamer", "marginal", "waiver").na.fill(0.0, ["marginal", "waiver", "streamer"])


def player_values(weekly: DataFrame, levels: DataFrame, period: str, position: str, value: str, key: list[str], week: str, segments: dict[str, Column]) -> DataFrame:
    """Per entity over the horizon: points, games, what a replacement would score in them, value over it with (`vor`) and
    without (`vor_raw`) replacing bad weeks, value over the marginal starter, weeks that start, weeks off as text, and
    points and vor of each segment."""
    v, plus = F.col(value), F.greatest(F.col(value) - F.col("waiver"), F.lit(0.0))
    part = lambda x, when: F.coalesce(F.sum(F.when(when, x)), F.lit(0.0))
    parts = [part(x, when).alias(f"{name}_{s}") for s, when in segments.items() for name, x in (("points", v), ("vor", plus))]
    byes = F.array_sort(F.collect_list(F.when(~F.col("has_game"), F.col(week))))  # weeks of one season
    # levels are a row for each period and class
    return weekly.join(F.broadcast(levels), [period, position]).groupBy(*key, position).agg(
        F.sum(v).alias("points"), F.count_if("has_game").alias("games"), part(F.col("waiver"), F.col("has_game")).alias("replacement"), F.sum(plus).alias("vor"),
        F.sum(v - F.col("waiver")).alias("vor_raw"), F.sum(v - F.col("marginal")).alias("vas"), F.count_if((v > 0) & (v >= F.col("marginal"))).alias("starter_weeks"),
        F.array_join(byes.cast("array<string>"), ",").alias("byes"), *parts,
    )


def ranked(rows: DataFrame, season: str, position: str, order: list[Column]) -> DataFrame:
    """`rows` with `overall_rank` in their season, by `order` and class, and `position_rank` in their class of the season.

    Rows are range-partitioned and ranks go on from the counts of the partitions before, so that no season has to fit one
    task.
    """
    spark = rows.sparkSession
    every = [F.col(season), *order, F.col(position)]
    path = scratch(spark, "to-rank")
    write_once(rows, path)  # read for the ranges' bounds too
    rows, path = spark.read.parquet(path), scratch(spark, "ranked")
    write_once(rows.repartitionByRange(*every).withColumn("_part", F.spark_partition_id()), path)
    stored = spark.read.parquet(path)
    counts = stored.groupBy("_part", season, position).agg(F.count("*").alias("_here"))
    seen = lambda by: F.sum("_here").over(Window.partitionBy(*by).orderBy("_part").rangeBetween(Window.unboundedPreceding, -1))
    before = counts.select("_part", season, position, F.coalesce(seen([season]), F.lit(0)).alias("_all"), F.coalesce(seen([season, position]), F.lit(0)).alias("_class"))
    # a row for each partition, season and class; nulls are equal as they are in the windows
    before = before.select(F.col("_part").alias("_p"), F.col(season).alias("_s"), F.col(position).alias("_c"), "_all", "_class")
    same = (F.col("_part") == F.col("_p")) & F.col(season).eqNullSafe(F.col("_s")) & F.col(position).eqNullSafe(F.col("_c"))
    placed = stored.join(F.broadcast(before), same)
    here = lambda by: F.row_number().over(Window.partitionBy("_part", *by).orderBy(*every[1:]))
    overall, own = here([season]) + F.col("_all"), here([season, position]) + F.col("_class")
    return placed.select(*rows.columns, overall.cast("long").alias("overall_rank"), own.cast("long").alias("position_rank"))


def runs(rows: DataFrame, by: list[str], season: str, week: str) -> DataFrame:
    """`rows` (one for each week in which an entity was active) with `run`, how many weeks on its activity has no gap, and
    `ended`: whether it then stopped before the season's last week. Runs that reach it are censored."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(week))
    last = rows.groupBy(season).agg(F.max(week).alias("_last"))
    own = rows.withColumn("_island", F.col(week) - number)
    stop = F.max(week).over(Window.partitionBy(*by, "_island"))
    return own.withColumn("_stop", stop).join(last, season).withColumns(
        {"run": F.col("_stop") - F.col(week), "ended": F.col("_stop") < F.col("_last")}
    ).drop("_island", "_stop", "_last")


def survival(rows: DataFrame, by: list[str], leads: int, season: str | None = None) -> DataFrame:
    """Per group and lead (1 to `leads`): runs at risk, runs that ended there, and the product-limit share `alive` after it.

    Rows are counted by the length of their run first; the product is over a few counts for each group. With `season`, one
    of `by`, each season has the runs of all earlier ones: their counts are repeated for it, not the rows.
    """
    counts = rows.groupBy(*by, "run").agg(F.count("*").alias("_c"), F.count_if(F.col("ended")).alias("_d"))
    if season:
        path = scratch(rows.sparkSession, "runs")
        write_once(counts, path)  # read for its seasons too
        counts = earlier_seasons(rows.sparkSession.read.parquet(path), season)
    by_lead = counts.groupBy(*by).agg(
        F.array(*(F.struct(
            F.lit(h).cast("long").alias("lead"),
            (F.sum(F.when(F.col("run") >= h, F.col("_c")).otherwise(0)) + F.sum(F.when(F.col("run") == h - 1, F.col("_d")).otherwise(0))).alias("at_risk"),
            F.sum(F.when(F.col("run") == h - 1, F.col("_d")).otherwise(0)).alias("ended"),
        ) for h in range(1, leads + 1))).alias("_l")
    )
    long = by_lead.select(*by, F.inline("_l")).where("at_risk > 0")
    stay = F.ln(F.greatest(1 - F.col("ended") / F.col("at_risk"), F.lit(1e-12)))
    return long.withColumn("alive", F.exp(F.sum(stay).over(Window.partitionBy(*by).orderBy("lead"))))


def baselines(started: DataFrame, period: str, position: str, value: str, flex_classes: list[str]) -> DataFrame:
    """Per period and class: the best value that doesn't start (flex classes share one)."""
    group = F.when(F.col(position).isin(*flex_classes), "flex").otherwise(F.col(position))
    best = started.withColumn("_g", group).groupBy(period, "_g").agg(F.max(F.when(~F.col("starter"), F.col(value))).alias("replacement"))
    classes = started.select(period, position).distinct().withColumn("_g", group)
    return classes.join(best, [period, "_g"], "left").select(period, position, F.coalesce("replacement", F.lit(0.0)).alias("replacement"))


def over_replacement(started: DataFrame, base: DataFrame, period: str, position: str, value: str, key: list[str]) -> DataFrame:
    """Per entity: value over replacement, its positive part, and value of started periods, summed over the horizon."""
    d = F.col(value) - F.col("replacement")
    joined = started.join(base, [period, position])
    return joined.groupBy(*key, position).agg(
        F.sum(d).alias("vor"), F.sum(F.greatest(d, F.lit(0.0))).alias("vor_plus"), F.sum(F.when(F.col("starter"), d).otherwise(0.0)).alias("vas"),
        F.count("*").alias("periods"),
    )


def opponent_factor(allowed: DataFrame, by: list[str], season: str, period: str, k: float) -> DataFrame:
    """Points allowed per game before each period, relative to the league's, shrunk to 1 by k games.

    `allowed`: by, season, period, points, games.
    """
    own = Window.partitionBy(*by, season).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    # league sums per period first, so that the league's window has one row per period
    league = allowed.groupBy(season, period).agg(F.sum("points").alias("lp"), F.sum("games").alias("lg"))
    all_ = Window.partitionBy(season).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    league = league.select(season, period, (F.sum("lp").over(all_) / F.sum("lg").over(all_)).alias("mean"))
    sums = allowed.select(*by, season, period, F.sum("points").over(own).alias("p"), F.sum("games").over(own).alias("g"))
    ratio = (F.col("p") / F.col("mean") + k) / (F.col("g") + k)
    return sums.join(league, [season, period]).select(*by, season, period, F.coalesce(ratio, F.lit(1.0)).alias("factor"))
