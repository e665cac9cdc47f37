"""Queries of named specifications, blocked evaluations and horizon studies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitstats.operators import dist, evaluate, fit, isotonic, joins, leakage, specs
from pitstats.plans.evaluation import LINE
from pitstats.plans.forecasts import HORIZON, _horizon
from pitstats.plans.registry import query
from pitstats.sources.fixtures import rounded, view


def r4(column, places=4):
    return rounded(F.col(column) if isinstance(column, str) else column, places)


@query("registry", f"""
    with {LINE}, p as (select 'm_vendor' as model, k, gi, actual, proj as pred from fx_proj where proj is not null
      union all select 'm_line', p.k, p.gi, p.actual, l.icpt + l.slope * p.proj from fx_proj p join line l on l.position = p.position and l.gi = p.gi where p.proj is not null
      union all select 'm_naive4', p.k, p.gi, p.actual, coalesce(avg(p.actual) over (partition by p.k order by p.gi rows between 4 preceding and 1 preceding), l.m)
        from (select * from fx_proj where proj is not null) p left join (select k, season + 1 as season, avg(actual) as m from fx_proj where proj is not null group by k, season) l on l.k = p.k and l.season = p.season)
    select model, count(*) as n, round(avg(abs(pred - actual)), 4) as mae from p where pred is not null group by model""")
def registry(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_proj").where("proj is not null")
    named = {"m_vendor": {"type": "vendor"}, "m_line": {"type": "line", "settings": {"least": 50}}, "m_naive4": {"type": "naive", "settings": {"size": 4}}}
    p = specs.predictions(rows, named)
    return p.groupBy("model").agg(F.count("*").alias("n"), r4(F.avg(F.abs(F.col("pred") - F.col("actual")))).alias("mae"))


@query("udf_spec", """
    with l as (select k, season + 1 as season, avg(actual) as m from fx_proj where proj is not null group by k, season)
    select 'm_half' as model, count(*) as n, round(avg(abs(p.proj * 0.5::double + l.m * 0.5::double - p.actual)), 4) as mae from fx_proj p join l on l.k = p.k and l.season = p.season where p.proj is not null
    union all select 'm_vendor', count(*), round(avg(abs(proj - actual)), 4) from fx_proj where proj is not null""")
def udf_spec(spark, sf_dir):
    """A model type that a user adds by name, and a registry of models stated as YAML."""
    from pitstats.operators import scoring
    from pitstats.sources.documents import scratch

    @specs.spec("half_last_season")
    def half(rows, share: float = 0.5):
        last = rows.groupBy("k", (F.col("season") + 1).alias("season")).agg(F.avg("actual").alias("_m"))
        return rows.join(last, ["k", "season"], "left").withColumn("pred", F.col("proj") * share + F.col("_m") * (1 - share)).drop("_m")

    path = scratch(spark, "registry")
    text = "m_half:\n  type: half_last_season\n  settings: {share: 0.5}\nm_vendor:\n  type: vendor\n"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    p = specs.predictions(view(spark, sf_dir, "fx_proj").where("proj is not null"), scoring.read_yaml(spark, path))
    return p.groupBy("model").agg(F.count("*").alias("n"), r4(F.avg(F.abs(F.col("pred") - F.col("actual")))).alias("mae"))


@query("udf_provider", """
    select g.k, g.gi, coalesce(p.v, g.v) as v, case when p.v is not null then 'projected' else 'played' end as provider from (select k, gi, pts as v from fx_games) g
    left join (select k, gi, proj as v from fx_proj where proj is not null) p on p.k = g.k and p.gi = g.gi""")
def udf_provider(spark, sf_dir):
    specs.provider("projected")(lambda c: c["proj"].where("proj is not null").select("k", "gi", F.col("proj").alias("v")))
    specs.provider("played")(lambda c: c["games"].select("k", "gi", F.col("pts").alias("v")))
    context = {"proj": view(spark, sf_dir, "fx_proj"), "games": view(spark, sf_dir, "fx_games")}
    return specs.cascade_of(["projected", "played"], context, ["k", "gi"])


@query("live_predict", f"with {LINE} select p.k, p.gi, round(l.icpt + l.slope * p.proj, 3) as pred, 'line' as model, cast(l.n_before as bigint) as n_train from fx_proj p join line l on l.position = p.position and l.gi = p.gi where p.proj is not null and p.gi = 200003")
def live_predict(spark, sf_dir):
    """Fit on rows before the target month only, predict its rows, stamp the lineage."""
    base = view(spark, sf_dir, "fx_proj").where("proj is not null and gi <= 200003")
    line = fit.rolling_line(base, ["position"], "gi", "proj", "actual", 50).where("gi = 200003")
    return base.where("gi = 200003").join(F.broadcast(line), ["position", "gi"]).select(
        "k", "gi", r4(F.col("a") + F.col("b") * F.col("proj"), 3).alias("pred"), F.lit("line").alias("model"), F.col("n_before").alias("n_train")
    )


@query("leak_check_reports", """
    with t as (select distinct k, day, cutoff from fx_reports)
    select cutoff, c.col as "column", count(*) as n, count(*) filter (where c.col in ('day_last', 'outcome_seen')) as n_changed from t, (values ('known'), ('n_known'), ('day_last'), ('outcome_seen')) c(col) group by cutoff, c.col""")
def leak_check_reports(spark, sf_dir):
    """Every day's cutoff at a time: reports from it on are rewritten, a late one is added for each target, and the realised
    number of the day's reports is changed. The state known before the cutoff must not move; two planted columns do."""
    reports = view(spark, sf_dir, "fx_reports").select("event_id", "k", "ts", "status", "day", "cutoff")
    targets = reports.groupBy("k", "day", "cutoff").agg(F.count("*").alias("played"))
    history = reports.select("k", "ts", "event_id", "status")

    def features(rows, seen, by):
        so_far = seen.withColumn("n_known", F.count("*").over(Window.partitionBy(*by).orderBy("ts")))
        known = joins.latest_before(so_far, rows, by, "ts", "cutoff", ["event_id", "status", "n_known"], ["event_id"])
        known = known.select(*rows.columns, F.struct("event_id", "status").alias("known"), "n_known", F.col("played").alias("outcome_seen"))
        last = seen.groupBy(*by, F.to_date("ts").alias("day")).agg(F.max_by("event_id", F.struct("ts", F.abs("event_id"))).alias("day_last"))
        return known.join(last, [*by, "day"], "left")

    return leakage.leak_check_all(targets, history, features, ["k"], ["k", "day"], "ts", "cutoff", [], ["played"]).select(
        "cutoff", "column", "n", "n_changed"
    )


@query("avail_eval", """
    with d as (select season, week, team % 5 as b, case when receptions >= 4 then 1.0::double else 0.0::double end as y from fx_games),
    r as (select s.season, d.b, avg(d.y) as r from (select distinct season from d) s join d on d.season < s.season group by s.season, d.b),
    z as (select s.season, avg(d.y) as r0 from (select distinct season from d) s join d on d.season < s.season group by s.season),
    l as (select d.season, d.week, (r.r - d.y) * (r.r - d.y) as s, (z.r0 - d.y) * (z.r0 - d.y) as b from d join r on r.season = d.season and r.b = d.b join z on z.season = d.season),
    c as (select season, week, sum(s) as s, sum(b) as b, count(*) as n from l group by season, week),
    nm as (select *, row_number() over (partition by season order by week) as i, count(*) over (partition by season) as size from c),
    dr as (select season, rep, cast(floor(('0x' || substr(md5('17|' || rep || '|' || season || '|' || i), 1, 12))::bigint / 281474976710656.0::double * size) as bigint) + 1 as i from nm, range(1, 2001) g(rep)),
    ms as (select season, rep, 1 - sum(s) / sum(b) as m from dr join nm using (season, i) group by season, rep),
    sp as (select season, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from ms group by season)
    select season, sum(n)::bigint as n, round(sum(s) / sum(n), 6) as brier, round(sum(b) / sum(n), 6) as base, round(1 - sum(s) / sum(b), 5) as skill, round(any_value(low), 5) as low, round(any_value(high), 5) as high from c join sp using (season) group by season""")
def avail_eval(spark, sf_dir):
    """Rates by group from all earlier seasons, scored on each season: Brier score, skill against the common rate, and its
    interval when the season's weeks are redrawn."""
    d = view(spark, sf_dir, "fx_games").select("season", "week", (F.col("team") % 5).alias("b"), (F.col("receptions") >= 4).cast("double").alias("y"))
    sums = d.groupBy("season", "b").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    before = lambda *by: Window.partitionBy(*by).orderBy("season").rangeBetween(Window.unboundedPreceding, -1)
    rates = sums.select("season", "b", (F.sum("s").over(before("b")) / F.sum("n").over(before("b"))).alias("r")).where("r is not null")
    whole = sums.groupBy("season").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = whole.select("season", (F.sum("s").over(before()) / F.sum("n").over(before())).alias("r0")).where("r0 is not null")  # a row for each season
    rows = d.join(rates, ["season", "b"]).join(whole, "season").select("season", "week", dist.brier(F.col("r"), F.col("y")).alias("s"), dist.brier(F.col("r0"), F.col("y")).alias("base"))
    out = evaluate.bootstrap_skill(rows, "s", "base", ["season"], "week", 2_000, 17)
    return out.select("season", "n", r4("loss", 6).alias("brier"), r4("base", 6).alias("base"), *(r4(c, 5).alias(c) for c in ("skill", "low", "high")))


@query("ros_groups", f"""
    with {HORIZON}, f as (select position, bucket, regr_intercept(y, level) as a, regr_slope(y, level) as b, stddev_samp(y) as s from hz where season < 2000 group by position, bucket)
    select k, season, week, round(sum(f.a + f.b * level), 3) as q50, round(sum(f.a + f.b * level) + 1.2815515655446008::double * sqrt(sum(s * s)), 3) as q90 from hz join f using (position, bucket) where season >= 2000 group by k, season, week""")
def ros_groups(spark, sf_dir):
    """Horizon totals with a normal spread as the baseline distribution."""
    rows = _horizon(spark, sf_dir)
    coef = rows.where("season < 2000").groupBy("position", "bucket").agg(F.regr_intercept("y", "level").alias("a"), F.regr_slope("y", "level").alias("b"), F.stddev_samp("y").alias("s"))
    total = F.sum(F.col("a") + F.col("b") * F.col("level"))
    return rows.where("season >= 2000").join(F.broadcast(coef), ["position", "bucket"]).groupBy("k", "season", "week").agg(
        r4(total, 3).alias("q50"), r4(total + 1.2815515655446008 * F.sqrt(F.sum(F.col("s") * F.col("s"))), 3).alias("q90")
    )


@query("ros_studies", """
    with a as (select season, actual, proj as cur, avg(actual) over (partition by k order by gi rows between 4 preceding and 1 preceding) as l4 from fx_proj),
    l as (select season, actual, 'cur' as level, cur as v from a union all select season, actual, 'avg4', l4 from a union all select season, actual, 'blend', (cur + l4) / 2 from a)
    select season, level, count(v) as n, round(avg(abs(actual - v)), 4) as mae from l where v is not null group by season, level""")
def ros_studies(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("gi").rowsBetween(-4, -1)
    a = view(spark, sf_dir, "fx_proj").select("season", "actual", F.col("proj").alias("cur"), F.avg("actual").over(w).alias("avg4"))
    long = a.withColumn("blend", (F.col("cur") + F.col("avg4")) / 2).unpivot(["season", "actual"], ["cur", "avg4", "blend"], "level", "v").where("v is not null")
    return long.groupBy("season", "level").agg(F.count("v").alias("n"), r4(F.avg(F.abs(F.col("actual") - F.col("v")))).alias("mae"))


@query("representation", """
    with r as (select season, actual, avg(actual) over (partition by k order by gi rows between 3 preceding and 1 preceding) as last3, avg(actual) over (partition by k order by gi rows between unbounded preceding and 1 preceding) as career,
      avg(actual) over (partition by k, season order by gi rows between unbounded preceding and 1 preceding) as season_so_far from fx_proj),
    l as (select 'last3' as encoding, actual, last3 as v from r union all select 'career', actual, career from r union all select 'season_so_far', actual, season_so_far from r)
    select encoding, count(*) as n, round(regr_slope(actual, v), 5) as slope, round(corr(actual, v), 5) as r from l where v is not null group by encoding""")
def representation(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("gi")
    r = view(spark, sf_dir, "fx_proj").select(
        "actual", F.avg("actual").over(w.rowsBetween(-3, -1)).alias("last3"), F.avg("actual").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("career"),
        F.avg("actual").over(Window.partitionBy("k", "season").orderBy("gi").rowsBetween(Window.unboundedPreceding, -1)).alias("season_so_far"),
    )
    long = r.unpivot(["actual"], ["last3", "career", "season_so_far"], "encoding", "v").where("v is not null")
    return long.groupBy("encoding").agg(F.count("*").alias("n"), r4(F.regr_slope("actual", "v"), 5).alias("slope"), r4(F.corr("actual", "v"), 5).alias("r"))


@query("isotonic_fit")
def isotonic_fit(spark, sf_dir):
    """Quantiles from isotonic distributional regression on the projection, each season from all earlier ones."""
    rows = view(spark, sf_dir, "fx_proj").where("proj is not null").select("k", "gi", "season", "position", "proj", "actual")
    by = ["season", "position"]
    past = fit.earlier_seasons(rows.select(*by, "proj", "actual"))
    cells = isotonic.fit(past, by, "proj", "actual", [i / 100 for i in range(1, 100)], [i / 200 for i in range(201)])
    out = isotonic.distribution(rows, cells, by, "proj").where("z is not null")
    levels = {f"q{round(100 * t)}": t for t in (0.1, 0.5, 0.9)}
    out = out.withColumn("q", isotonic.quantiles(F.col("f"), F.col("z"), levels, F.col("floor")))
    return out.select("season", "position", "k", "gi", "actual", *(r4(F.col("q")[n], 3).alias(n) for n in levels))


@query("display_map")
def display_map(spark, sf_dir):
    """Monotone map of projected onto actual totals within each season, zero at zero."""
    totals = view(spark, sf_dir, "fx_proj").groupBy("season", "k").agg(F.sum(F.coalesce("proj", F.lit(0.0))).alias("v"), F.sum("actual").alias("y"))
    shown = F.when(F.col("v") <= 0, 0.0).otherwise(F.greatest("fitted", F.lit(0.0)))
    seasons = [r["season"] for r in totals.select("season").distinct().orderBy("season").collect()]  # a fit for each
    parts = [fit.isotonic(own, "v", "y").transform(own) for own in (totals.where(F.col("season") == s) for s in seasons)]
    return reduce(DataFrame.unionByName, parts).select("season", "k", r4(shown, 3).alias("shown"))
