"""Queries of fits and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitstats.functions.scalars import portable_uniform
from pitstats.operators import evaluate, fit
from pitstats.operators.quantiles import exact_quantiles
from pitstats.plans.registry import query
from pitstats.sources.fixtures import rounded, view


def r4(column, places=4):
    return rounded(F.col(column) if isinstance(column, str) else column, places)


#: Rolling line of actual on projection per position, over strictly earlier months; identity below 50 rows.
LINE = """
    ls as (select position, gi, count(*) as n, sum(proj) as sx, sum(actual) as sy, sum(proj * proj) as sxx, sum(proj * actual) as sxy from fx_proj where proj is not null group by position, gi),
    lb as (select position, gi, sum(n) over w as n, sum(sx) over w as sx, sum(sy) over w as sy, sum(sxx) over w as sxx, sum(sxy) over w as sxy from ls
      window w as (partition by position order by gi range between unbounded preceding and 1 preceding)),
    line0 as (select *, coalesce(n, 0) >= 50 as ok from lb),
    line1 as (select *, case when ok then (n * sxy - sx * sy) / (n * sxx - sx * sx) else 1.0 end as slope from line0),
    line as (select position, gi, coalesce(n, 0) as n_before, slope, case when ok then (sy - slope * sx) / n else 0.0 end as icpt from line1)"""

#: Predictions of four models on rows with a projection.
PREDS = f"""{LINE},
    base as (select p.*, l.icpt + l.slope * p.proj as cal, avg(p.actual) over (partition by p.k order by p.gi rows between 8 preceding and 1 preceding) as roll
      from fx_proj p join line l on l.position = p.position and l.gi = p.gi where p.proj is not null),
    preds as (select 'vendor' as model, k, gi, season, position, actual, proj as pred from base union all select 'cal', k, gi, season, position, actual, cal from base
      union all select 'naive', k, gi, season, position, actual, roll from base where roll is not null union all select 'zero', k, gi, season, position, actual, 0.0 from base),
    aligned as (select * from (select *, count(*) over (partition by k, gi) as nm from preds) where nm = 4)"""


def predictions(spark, sf_dir):
    """Long predictions of four models: vendor, calibrated, naive and zero."""
    base = view(spark, sf_dir, "fx_proj").where("proj is not null")
    cal = fit.rolling_predict(base, ["position"], "gi", "proj", "actual", 50).withColumnRenamed("pred", "cal")
    w = Window.partitionBy("k").orderBy("gi").rowsBetween(-8, -1)
    wide = cal.withColumn("naive", F.avg("actual").over(w)).withColumn("zero", F.lit(0.0)).withColumnRenamed("proj", "vendor")
    long = wide.unpivot(["k", "gi", "season", "position", "actual"], ["vendor", "cal", "naive", "zero"], "model", "pred")
    return long.where("pred is not null")


def aligned(spark, sf_dir):
    return evaluate.align(predictions(spark, sf_dir), ["k", "gi"], 4)


# --- fits ----------------------------------------------------------------------------------------------------------


@query("suff_stats", "select position, gi, cast(sum(n) over w as bigint) as n_before, round(sum(sx) over w, 3) as sx_before from (select position, gi, count(*) as n, sum(proj) as sx from fx_proj where proj is not null group by position, gi) window w as (partition by position order by gi range between unbounded preceding and 1 preceding)")
def suff_stats(spark, sf_dir):
    from pitstats.operators import windows

    sums = fit.sufficient(view(spark, sf_dir, "fx_proj").where("proj is not null"), ["position"], "gi", "proj", "actual")
    w = windows.before(["position"], "gi")
    return sums.select("position", "gi", F.sum("n").over(w).alias("n_before"), r4(F.sum("sx").over(w), 3).alias("sx_before"))


@query("rolling_base", f"with {LINE} select position, gi, cast(n_before as bigint) as n_before, round(icpt, 3) as a, round(slope, 5) as b from line")
def rolling_base(spark, sf_dir):
    line = fit.rolling_line(view(spark, sf_dir, "fx_proj").where("proj is not null"), ["position"], "gi", "proj", "actual", 50)
    return line.select("position", "gi", "n_before", r4("a", 3).alias("a"), r4("b", 5).alias("b"))


@query("rolling_fit", f"with {LINE} select p.k, p.gi, round(l.icpt + l.slope * p.proj, 3) as pred from fx_proj p join line l on l.position = p.position and l.gi = p.gi where p.proj is not null")
def rolling_fit(spark, sf_dir):
    base = view(spark, sf_dir, "fx_proj").where("proj is not null")
    return fit.rolling_predict(base, ["position"], "gi", "proj", "actual", 50).select("k", "gi", r4("pred", 3).alias("pred"))


@query("static_folds", """
    with f as (select s.season, count(*) as n_train, regr_slope(p.actual, p.proj) as b, regr_intercept(p.actual, p.proj) as a
      from (select distinct season from fx_proj) s join fx_proj p on p.season < s.season where p.proj is not null group by s.season)
    select p.season, f.n_train, count(*) as n, round(avg(abs(p.actual - f.a - f.b * p.proj)), 4) as mae from fx_proj p join f on f.season = p.season where p.proj is not null group by p.season, f.n_train""")
def static_folds(spark, sf_dir):
    """Each season predicted from all earlier seasons: the rolling line with seasons as periods."""
    base = view(spark, sf_dir, "fx_proj").where("proj is not null").withColumn("all", F.lit(1))
    line = fit.rolling_line(base, ["all"], "season", "proj", "actual", 2).where("n_before > 0")
    e = F.abs(F.col("actual") - F.col("a") - F.col("b") * F.col("proj"))
    return base.join(F.broadcast(line), ["all", "season"]).groupBy("season", F.col("n_before").alias("n_train")).agg(F.count("*").alias("n"), r4(F.avg(e)).alias("mae"))


@query("calib_ols", "select season, round(regr_intercept(actual, proj), 3) as a, round(regr_slope(actual, proj), 5) as b from fx_proj where proj is not null group by season")
def calib_ols(spark, sf_dir):
    return view(spark, sf_dir, "fx_proj").where("proj is not null").groupBy("season").agg(
        r4(F.regr_intercept("actual", "proj"), 3).alias("a"), r4(F.regr_slope("actual", "proj"), 5).alias("b")
    )


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    return "(" + " + ".join(f"({'-' if j % 2 else ''}1) * {m[0][j]} * {_det([r[:j] + r[j + 1 :] for r in m[1:]])}" for j in range(len(m))) + ")"


def _least_squares_sql(name: str, rows: str, xs: list[str], y: str, weight: str = "1.0::double") -> str:
    """SQL of a one-row table `name` with intercept b0 and slopes b1, ...: Cramer's rule on centred weighted sums."""
    n = len(xs)
    mean = lambda c: f"sum(w * {c}) / sum(w)"
    sums = [f"sum(w * (x{i} - m{i}) * (x{j} - m{j})) as s{i}{j}" for i in range(n) for j in range(i, n)] + [f"sum(w * (x{i} - m{i}) * (y - my)) as t{i}" for i in range(n)]
    a = [[f"s{min(i, j)}{max(i, j)}" for j in range(n)] for i in range(n)]
    solve = [f"{_det([[f't{i}' if j == k else a[i][j] for j in range(n)] for i in range(n)])} / {_det(a)} as b{k + 1}" for k in range(n)]
    return f"""
    {name}_r as (select {weight} as w, {y} as y, {", ".join(f"cast({x} as double) as x{i}" for i, x in enumerate(xs))} from {rows}),
    {name}_m as (select {mean("y")} as my, {", ".join(f"{mean(f'x{i}')} as m{i}" for i in range(n))} from {name}_r),
    {name}_s as (select {", ".join(sums)} from {name}_r, {name}_m),
    {name}_b as (select {", ".join(solve)} from {name}_s),
    {name} as (select my - {" - ".join(f"b{i + 1} * m{i}" for i in range(n))} as b0, {name}_b.* from {name}_m, {name}_b)"""


@query("calib_components", f"""
    with la as (select max(season) as last from fx_proj), tr as (select p.*, last from fx_proj p, la where season < last), {_least_squares_sql("ls", "tr", ["c1", "c2", "c3"], "actual", "pow(0.5, (last * 12 - (season * 12 + week)) / 17.0::double)")}
    select k, gi, round(b0 + b1 * c1 + b2 * c2 + b3 * c3, 3) as pred, round(actual, 3) as actual from fx_proj, la, ls where season = last""")
def calib_components(spark, sf_dir):
    """Least squares on three components, weights halved every 17 months of age; fitted on rows before the last year."""
    df = view(spark, sf_dir, "fx_proj")
    last = df.agg(F.max("season")).first()[0]
    clock = F.col("season") * 12 + F.col("week")
    weight = F.pow(F.lit(0.5), (F.lit((last or 0) * 12) - clock) / 17.0)
    train = df.where(F.col("season") < last)
    b = fit.normal_equations(train, ["c1", "c2", "c3"], "actual", weight)
    pred = F.lit(float(b[0])) + sum(F.lit(float(w)) * F.col(c) for w, c in zip(b[1:], ("c1", "c2", "c3")))
    return df.where(F.col("season") == last).select("k", "gi", r4(pred, 3).alias("pred"), r4("actual", 3).alias("actual"))


@query("baseline_naive", """
    select p.k, p.gi, round(coalesce(avg(p.actual) over (partition by p.k order by p.gi rows between 8 preceding and 1 preceding), l.m), 4) as pred
    from fx_proj p left join (select k, season + 1 as season, avg(actual) as m from fx_proj group by k, season) l on l.k = p.k and l.season = p.season""")
def baseline_naive(spark, sf_dir):
    return fit.naive(view(spark, sf_dir, "fx_proj"), "k", "gi", "season", "actual", 8).select("k", "gi", r4("pred").alias("pred"))


@query("linear_imputed")
def linear_imputed(spark, sf_dir):
    df = view(spark, sf_dir, "fx_proj").select("k", "gi", "season", "proj", *(F.col(c).cast("double").alias(c) for c in ("c1", "c2")), "actual")
    model = fit.ml_linear(df.where("season <= 1997"), ["proj", "c1", "c2"], "actual", 0.5, 0.01)
    return model.transform(df.where("season > 1997")).select("k", "gi", r4("pred", 3).alias("pred"), "actual")


@query("boosted")
def boosted(spark, sf_dir):
    df = view(spark, sf_dir, "fx_proj").select("k", "gi", "season", "proj", *(F.col(c).cast("double").alias(c) for c in ("c1", "c2")), "actual")
    model = fit.ml_boosted(df.where("season <= 1997"), ["proj", "c1", "c2"], "actual", 3, 5)
    return model.transform(df.where("season > 1997")).select("k", "gi", r4("pred", 3).alias("pred"), "actual")


@query("residual_stack", f"""
    with {LINE}, r as (select p.k, p.gi, p.position, p.c2, p.actual, l.icpt + l.slope * p.proj as base from fx_proj p join line l on l.position = p.position and l.gi = p.gi where p.proj is not null),
    g as (select c2, gi, sum(actual - base) as s, count(*) as n from r group by c2, gi),
    m as (select c2, gi, sum(s) over w / (sum(n) over w + 20) as adj from g window w as (partition by c2 order by gi range between unbounded preceding and 1 preceding))
    select r.k, r.gi, round(r.base + coalesce(m.adj, 0), 3) as pred from r left join m on m.c2 = r.c2 and m.gi = r.gi""")
def residual_stack(spark, sf_dir):
    """Base line plus the shrunken mean of earlier residuals of rows with the same number of receptions."""
    from pitstats.operators import windows

    base = fit.rolling_predict(view(spark, sf_dir, "fx_proj").where("proj is not null"), ["position"], "gi", "proj", "actual", 50)
    sums = base.groupBy("c2", "gi").agg(F.sum(F.col("actual") - F.col("pred")).alias("s"), F.count("*").alias("n"))
    w = windows.before(["c2"], "gi")
    adjust = sums.select("c2", "gi", (F.sum("s").over(w) / (F.sum("n").over(w) + 20)).alias("adj"))
    return base.join(adjust, ["c2", "gi"], "left").select("k", "gi", r4(F.col("pred") + F.coalesce("adj", F.lit(0.0)), 3).alias("pred"))


@query("rate_table", """
    with d as (select season % 3 as a, team % 5 as b, week as c, case when receptions >= 4 then 1.0::double else 0.0::double end as y, k, gi from fx_games),
    t3 as (select a, b, c, avg(y) as r from d group by a, b, c having count(*) >= 30), t2 as (select a, b, avg(y) as r from d group by a, b having count(*) >= 30),
    t1 as (select a, avg(y) as r from d group by a having count(*) >= 30), t0 as (select avg(y) as r from d)
    select d.k, d.gi, round(coalesce(t3.r, t2.r, t1.r, t0.r), 6) as p from d left join t3 on t3.a = d.a and t3.b = d.b and t3.c = d.c left join t2 on t2.a = d.a and t2.b = d.b left join t1 on t1.a = d.a cross join t0""")
def rate_table(spark, sf_dir):
    d = view(spark, sf_dir, "fx_games").select("k", "gi", (F.col("season") % 3).alias("a"), (F.col("team") % 5).alias("b"), F.col("week").alias("c"), (F.col("receptions") >= 4).cast("double").alias("y"))
    table = fit.rate_table(d, ["a", "b", "c"], "y", 30)
    return fit.apply_rates(d, table, ["a", "b", "c"]).select("k", "gi", r4("p", 6).alias("p"))


@query("logit_fit")
def logit_fit(spark, sf_dir):
    """Probability of four receptions and more from targets and expected points, each season from all earlier ones."""
    df = view(spark, sf_dir, "fx_games").select("k", "gi", "season", F.col("targets").cast("double").alias("t"), "xfp", (F.col("receptions") >= 4).cast("double").alias("y"))
    coefs = fit.grouped_logit(fit.earlier_seasons(df.select("season", "t", "xfp", "y")), ["season"], ["t", "xfp"], "y")
    p = fit.logistic(F.col("coef"), [F.col("t"), F.col("xfp")])
    return df.join(coefs.select("season", "coef"), "season").select("k", "gi", "season", r4(p, 5).alias("p"), "y")


@query("group_ratio_params", """
    with s as (select *, count(*) over (partition by position) as c from fx_proj where proj is not null)
    select case when c >= 230 then position else 'pooled' end as "group", count(*) as n, round((sum(actual) / sum(proj) - 1) / 2, 2) as m from s group by 1""")
def group_ratio_params(spark, sf_dir):
    return fit.ratio_params(view(spark, sf_dir, "fx_proj").where("proj is not null"), "position", "actual", "proj", 230)


@query("tune_grid", """
    with r as (select k, gi, actual, avg(actual) over (partition by k order by gi rows between 2 preceding and 1 preceding) as p2, avg(actual) over (partition by k order by gi rows between 4 preceding and 1 preceding) as p4,
      avg(actual) over (partition by k order by gi rows between 8 preceding and 1 preceding) as p8 from fx_proj)
    select 'roll_2' as spec, count(p2) as n, round(avg(abs(actual - p2)), 4) as mae from r union all select 'roll_4', count(p4), round(avg(abs(actual - p4)), 4) from r union all select 'roll_8', count(p8), round(avg(abs(actual - p8)), 4) from r""")
def tune_grid(spark, sf_dir):
    """Pooled error of each window size, all sizes in one pass."""
    w = Window.partitionBy("k").orderBy("gi")
    wide = view(spark, sf_dir, "fx_proj").select("actual", *(F.avg("actual").over(w.rowsBetween(-n, -1)).alias(f"roll_{n}") for n in (2, 4, 8)))
    long = wide.unpivot(["actual"], ["roll_2", "roll_4", "roll_8"], "spec", "pred")
    return long.groupBy("spec").agg(F.count("pred").alias("n"), r4(F.avg(F.abs(F.col("actual") - F.col("pred")))).alias("mae"))


# --- evaluation ----------------------------------------------------------------------------------------------------


@query("align_models", f"with {PREDS} select model, count(*) as n from aligned group by model")
def align_models(spark, sf_dir):
    return aligned(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"))


@query("point_metrics", f"""
    with {PREDS} select model, count(*) as n, round(avg(abs(pred - actual)), 4) as mae, round(sqrt(avg((pred - actual) * (pred - actual))), 4) as rmse, round(avg(pred - actual), 4) as bias,
        round(quantile_cont(abs(pred - actual), 0.5), 4) as median_ae from aligned group by model""")
def point_metrics(spark, sf_dir):
    m = evaluate.point_metrics(aligned(spark, sf_dir), ["model"])
    return m.select("model", "n", *(r4(c).alias(c) for c in ("mae", "rmse", "bias", "median_ae")))


@query("weekly_rank_cor", f"""
    with {PREDS}, rk as (select model, gi, rank() over (partition by model, gi order by actual) + (count(*) over (partition by model, gi, actual) - 1) / 2.0 as a,
        rank() over (partition by model, gi order by pred) + (count(*) over (partition by model, gi, pred) - 1) / 2.0 as p from aligned where model <> 'zero'),
    c as (select model, gi, corr(a, p) as r, count(*) as n from rk group by model, gi having count(*) > 2)
    select model, round(avg(r), 5) as rank_cor, count(r) as n_groups from c group by model""")
def weekly_rank_cor(spark, sf_dir):
    r = evaluate.rank_correlation(aligned(spark, sf_dir).where("model <> 'zero'"), ["gi"], ["model"], "actual", "pred")
    return r.select("model", r4("rank_cor", 5).alias("rank_cor"), "n_groups")


@query("pairwise_accuracy", f"""
    with {PREDS}, s as (select * from aligned where model <> 'zero')
    select a.model, count(*) as n_pairs, round(avg(case when sign(a.actual - b.actual) * sign(a.pred - b.pred) > 0 then 1.0::double when sign(a.actual - b.actual) * sign(a.pred - b.pred) < 0 then 0.0::double else 0.5::double end), 6) as accuracy
    from s a join s b on a.gi = b.gi and a.model = b.model and a.k < b.k and a.actual <> b.actual group by a.model""")
def pairwise_accuracy(spark, sf_dir):
    rows = aligned(spark, sf_dir).where("model <> 'zero'").select("model", "gi", "k", "actual", "pred")
    acc = evaluate.pairwise_accuracy(rows, ["gi"], "k", "actual", "pred", ["model"])
    return acc.select("model", "n_pairs", r4("accuracy", 6).alias("accuracy"))


@query("extended_metrics", f"""
    with {PREDS}, r as (select *, row_number() over (partition by model, gi order by pred desc, k) as rp, row_number() over (partition by model, gi order by actual desc, k) as ra from aligned)
    select model, round(cast(count(*) filter (where rp <= 24 and ra <= 24) as double) / count(*) filter (where ra <= 24), 6) as top24, round(avg(case when abs(pred - actual) > 100 then 1.0::double else 0.0::double end), 6) as large_miss from r where model <> 'zero' group by model""")
def extended_metrics(spark, sf_dir):
    rank = lambda c: F.row_number().over(Window.partitionBy("model", "gi").orderBy(F.desc(c), "k"))
    df = aligned(spark, sf_dir).where("model <> 'zero'").withColumn("rp", rank("pred")).withColumn("ra", rank("actual"))
    both = F.count_if((F.col("rp") <= 24) & (F.col("ra") <= 24)) / F.count_if(F.col("ra") <= 24)
    miss = F.avg((F.abs(F.col("pred") - F.col("actual")) > 100).cast("double"))
    return df.groupBy("model").agg(r4(both, 6).alias("top24"), r4(miss, 6).alias("large_miss"))


@query("evaluate_report", f"""
    with {PREDS} select model, season, position, count(*) as n, round(avg(abs(pred - actual)), 4) as mae, round(quantile_cont(pred - actual, 0.9), 4) as q90 from aligned
    group by grouping sets ((model), (model, season), (model, position))""")
def evaluate_report(spark, sf_dir):
    rows = aligned(spark, sf_dir).select("model", "season", "position", (F.col("pred") - F.col("actual")).alias("e"))
    # a row counts for its model, its season and its position; what a group isn't about is null
    sets = F.array(*(F.struct(*(F.col(c).alias(c) if c in own else F.lit(None).alias(c) for c in ("season", "position"))) for own in ((), ("season",), ("position",))))
    rows = rows.select("model", "e", F.explode(sets).alias("s")).select("model", "s.season", "s.position", "e")
    out = exact_quantiles(rows, ["model", "season", "position"], "e", [0.9], F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"))
    return out.select("model", "season", "position", "n", r4("mae").alias("mae"), r4(F.col("q")[0]).alias("q90"))


BOOT = """
    d as (select k, gi, season, max(case when model = 'cal' then abs(pred - actual) end) - max(case when model = 'vendor' then abs(pred - actual) end) as d from aligned where model in ('cal', 'vendor') group by k, gi, season),
    s as (select season, {cluster} as c, sum(d) as s, count(d) as n from d group by season, {cluster}),
    num as (select *, row_number() over (partition by season order by c) as i, count(*) over (partition by season) as size from s),
    draws as (select season, rep, cast(floor(('0x' || substr(md5('{seed}|' || rep || '|' || season || '|' || i), 1, 12))::bigint / 281474976710656.0::double * size) as bigint) + 1 as i from num, range(1, {reps} + 1) r(rep)),
    m as (select rep, sum(s) / sum(n) as m from draws join num using (season, i) group by rep)
    select round((select sum(s) / sum(n) from s), 4) as mean, round(quantile_cont(m, 0.025), 4) as low, round(quantile_cont(m, 0.975), 4) as high, avg(case when m < 0 then 1.0::double else 0.0::double end) as share_below from m"""


def _boot(spark, sf_dir, cluster, seed, reps):
    d = evaluate.paired_differences(aligned(spark, sf_dir), "cal", "vendor", ["k", "gi", "season"])
    b = evaluate.cluster_bootstrap(d, "d", ["season"], cluster, reps, seed)
    return b.select(*(r4(c).alias(c) for c in ("mean", "low", "high")), "share_below")


@query("cluster_bootstrap", f"with {PREDS}, {BOOT.format(cluster='gi', seed=7, reps=2000)}")
def cluster_bootstrap(spark, sf_dir):
    return _boot(spark, sf_dir, "gi", 7, 2000)


@query("entity_bootstrap", f"with {PREDS}, {BOOT.format(cluster='k', seed=8, reps=200)}")
def entity_bootstrap(spark, sf_dir):
    return _boot(spark, sf_dir, "k", 8, 200)


@query("seasonal_deltas", f"""
    with {PREDS} select season, count(*) filter (where model = 'cal') as n, round(avg(case when model = 'cal' then abs(pred - actual) end) - avg(case when model = 'vendor' then abs(pred - actual) end), 4) as delta from aligned group by season""")
def seasonal_deltas(spark, sf_dir):
    e = F.abs(F.col("pred") - F.col("actual"))
    of = lambda m: F.avg(F.when(F.col("model") == m, e))
    return aligned(spark, sf_dir).groupBy("season").agg(F.count_if(F.col("model") == "cal").alias("n"), r4(of("cal") - of("vendor")).alias("delta"))


@query("selection_rules", f"""
    with {PREDS}, m as (select position, model, avg(abs(pred - actual)) as mae, case model when 'zero' then 0 when 'vendor' then 1 when 'naive' then 2 else 3 end as c from aligned group by position, model),
    b as (select *, min(mae) over (partition by position) as best from m), r as (select *, row_number() over (partition by position order by c, mae) as r from b where mae <= best * 1.005)
    select position, model, round(mae, 4) as mae from r where r = 1""")
def selection_rules(spark, sf_dir):
    cost = F.when(F.col("model") == "zero", 0).when(F.col("model") == "vendor", 1).when(F.col("model") == "naive", 2).otherwise(3)
    m = aligned(spark, sf_dir).groupBy("position", "model").agg(F.avg(F.abs(F.col("pred") - F.col("actual"))).alias("mae")).withColumn("c", cost)
    return evaluate.select_model(m, ["position"], "mae", "c").select("position", "model", r4("mae").alias("mae"))


@query("holm_gate", f"""
    with {PREDS}, hc as (select season, position, gi, sum(case when abs(pred - actual) <= 60 then 1.0::double else 0.0::double end) as s, count(*) as n from aligned where model = 'cal' group by season, position, gi),
    nm as (select *, row_number() over (partition by season, position order by gi) as i, count(*) over (partition by season, position) as size from hc),
    dr as (select season, position, rep, cast(floor(('0x' || substr(md5('9|' || rep || '|' || season || '|' || position || '|' || i), 1, 12))::bigint / 281474976710656.0::double * size) as bigint) + 1 as i from nm, range(1, 2001) r(rep)),
    ms as (select season, position, rep, sum(s) / sum(n) as m from dr join nm using (season, position, i) group by season, position, rep),
    ps as (select season, position, least(1.0::double, 2 * least((1 + count(*) filter (where m <= 0.8)) / 2001.0::double, (1 + count(*) filter (where m >= 0.8)) / 2001.0::double)) as p from ms group by season, position),
    cv as (select season, position, sum(s) / sum(n) as cov from hc group by season, position),
    r as (select *, p * (count(*) over (partition by season) - row_number() over (partition by season order by p, position) + 1) as raw from ps join cv using (season, position))
    select season, position, round(cov, 5) as cov, round(p, 5) as p, round(least(1.0, max(raw) over (partition by season order by p, position rows unbounded preceding)), 5) as adjusted from r""")
def holm_gate(spark, sf_dir):
    """Coverage per cell against 0.8: bootstrap p of 2,000 draws of months, adjusted within the season."""
    from pitstats.operators import windows

    rows = aligned(spark, sf_dir).where("model = 'cal'").withColumn("hit", (F.abs(F.col("pred") - F.col("actual")) <= 60).cast("double"))
    cells = evaluate.coverage_p(rows, "hit", ["season", "position"], "gi", 0.8, 2_000, 9)
    out = windows.with_holm(cells, "p", ["season"], ["position"], "adjusted")
    return out.select("season", "position", r4("cov", 5).alias("cov"), r4("p", 5).alias("p"), r4("adjusted", 5).alias("adjusted"))


@query("week_t", f"""
    with {PREDS}, d as (select k, gi, season, max(case when model = 'cal' then abs(pred - actual) end) - max(case when model = 'vendor' then abs(pred - actual) end) as d from aligned where model in ('cal', 'vendor') group by k, gi, season),
    w as (select season, gi, avg(d) as m from d group by season, gi)
    select season, count(m) as weeks, case when count(m) > 1 and stddev_samp(m) > 0 then round(avg(m) / (stddev_samp(m) / sqrt(count(m))), 4) end as t, count(m) - 1 as df from w group by season""")
def week_t(spark, sf_dir):
    d = evaluate.paired_differences(aligned(spark, sf_dir), "cal", "vendor", ["k", "gi", "season"])
    return evaluate.week_t(d, "d", ["season", "gi"], ["season"]).select("season", "weeks", r4("t").alias("t"), "df")


@query("power_mde", f"""
    with {PREDS}, d as (select k, gi, season, max(case when model = 'cal' then abs(pred - actual) end) - max(case when model = 'vendor' then abs(pred - actual) end) as d from aligned where model in ('cal', 'vendor') group by k, gi, season),
    w as (select season, gi, avg(d) as d from d group by season, gi)
    select season, count(*) as weeks, round(stddev_samp(d), 4) as sd, round(2.801585218112969::double * stddev_samp(d) / sqrt(count(*)), 4) as mde from w group by season having count(*) > 1""")
def power_mde(spark, sf_dir):
    d = evaluate.paired_differences(aligned(spark, sf_dir), "cal", "vendor", ["k", "gi", "season"])
    weeks = d.groupBy("season", "gi").agg(F.avg("d").alias("d"))
    out = weeks.groupBy("season").agg(F.count("*").alias("weeks"), F.stddev_samp("d").alias("s")).where("weeks > 1")
    return out.select("season", "weeks", r4("s").alias("sd"), r4(evaluate.mde(F.col("s"), F.col("weeks"))).alias("mde"))


_NAMES = ["proj", "c1", "c2", "c3"]
_USED = {left: [n for n in _NAMES if n != left] for left in ("none", *_NAMES)}


@query("ablation", f"""
    with tr as (select * from fx_proj where proj is not null and season < 1998), te as (select * from fx_proj where proj is not null and season >= 1998), {", ".join(_least_squares_sql(f"l_{left}", "tr", used, "actual") for left, used in _USED.items())}
    {" union all ".join(f"select '{left}' as left_out, count(*) as n, round(avg(abs(b0 + {' + '.join(f'b{i + 1} * {c}' for i, c in enumerate(used))} - actual)), 4) as mae from te, l_{left}" for left, used in _USED.items())}""")
def ablation(spark, sf_dir):
    """Error of the linear model when one predictor at a time is left out, trained before 1998."""
    df = view(spark, sf_dir, "fx_proj").where("proj is not null").select("season", "proj", *(F.col(c).cast("double").alias(c) for c in ("c1", "c2", "c3")), "actual")
    names, out = ["proj", "c1", "c2", "c3"], None
    for left_out in ["none", *names]:
        used = [n for n in names if n != left_out]
        b = fit.normal_equations(df.where("season < 1998"), used, "actual")
        pred = F.lit(float(b[0])) + sum(F.lit(float(w)) * F.col(c) for w, c in zip(b[1:], used))
        row = df.where("season >= 1998").agg(F.count("*").alias("n"), r4(F.avg(F.abs(pred - F.col("actual")))).alias("mae")).select(F.lit(left_out).alias("left_out"), "n", "mae")
        out = row if out is None else out.unionByName(row)
    return out


@query("residual_study", f"""
    with {PREDS}, l as (select gi, 'position' as factor, position as level, pred - actual as e from aligned where model = 'cal' union all select gi, 'half', case when gi % 100 <= 6 then 'first' else 'second' end, pred - actual from aligned where model = 'cal'),
    w as (select factor, level, gi, avg(e) as m from l group by factor, level, gi)
    select factor, level, count(*) as weeks, round(avg(m), 4) as mean, round(stddev_samp(m) / sqrt(count(*)), 4) as se from w group by factor, level""")
def residual_study(spark, sf_dir):
    df = aligned(spark, sf_dir).where("model = 'cal'").select("gi", (F.col("pred") - F.col("actual")).alias("e"), "position", F.when(F.col("gi") % 100 <= 6, "first").otherwise("second").alias("half"))
    weeks = df.unpivot(["gi", "e"], ["position", "half"], "factor", "level").groupBy("factor", "level", "gi").agg(F.avg("e").alias("m"))
    return weeks.groupBy("factor", "level").agg(F.count("*").alias("weeks"), r4(F.avg("m")).alias("mean"), r4(F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("se"))


@query("component_decomp", """
    with c as (select 'c1' as component, cast(c1 as double) as x, actual from fx_proj union all select 'c2', c2, actual from fx_proj union all select 'c3', c3, actual from fx_proj),
    v as (select component, var_samp(x) as v, regr_slope(actual, x) as slope from c group by component)
    select component, round(v / sum(v) over (), 6) as share, round(slope, 5) as slope from v""")
def component_decomp(spark, sf_dir):
    df = view(spark, sf_dir, "fx_proj").select("actual", *(F.col(c).cast("double").alias(c) for c in ("c1", "c2", "c3")))
    v = df.unpivot(["actual"], ["c1", "c2", "c3"], "component", "x").groupBy("component").agg(F.var_samp("x").alias("v"), F.regr_slope("actual", "x").alias("slope"))
    total = v.agg(F.sum("v").alias("t"))
    return v.crossJoin(total).select("component", r4(F.col("v") / F.col("t"), 6).alias("share"), r4("slope", 5).alias("slope"))


@query("shortfall_tables", """
    select r.status, count(*) as n, round(avg(case when g.k is not null then 1.0::double else 0.0::double end), 6) as played, round(avg(g.targets), 4) as workload, round(sum(g.pts) / sum(g.targets), 5) as efficiency
    from fx_reports r left join fx_games g on g.k = r.k and g.gi = 199601 + r.event_id % 12 group by r.status""")
def shortfall_tables(spark, sf_dir):
    reports = view(spark, sf_dir, "fx_reports").select("k", "status", (199601 + F.col("event_id") % 12).alias("gi"))
    games = view(spark, sf_dir, "fx_games").select("k", "gi", "targets", "pts")
    return reports.join(games, ["k", "gi"], "left").groupBy("status").agg(
        F.count("*").alias("n"), r4(F.avg(F.col("pts").isNotNull().cast("double")), 6).alias("played"), r4(F.avg("targets")).alias("workload"), r4(F.sum("pts") / F.sum("targets"), 5).alias("efficiency")
    )


@query("candidate_eval", """
    with c as (select k, gi, actual, proj, proj * case position when 'BUILDING' then 0.9::double else 1.0::double end as m1, proj - case when c2 >= 8 then 2.0::double else 0.0::double end as m2 from fx_proj where proj is not null),
    l as (select 'm1' as candidate, actual, proj, m1 as pred from c union all select 'm2', actual, proj, m2 from c)
    select candidate, count(*) as n, count(*) filter (where pred <> proj) as affected, round(avg(abs(pred - actual) - abs(proj - actual)), 5) as delta from l group by candidate""")
def candidate_eval(spark, sf_dir):
    df = view(spark, sf_dir, "fx_proj").where("proj is not null").select(
        "actual", "proj", (F.col("proj") * F.when(F.col("position") == "BUILDING", 0.9).otherwise(1.0)).alias("m1"), (F.col("proj") - F.when(F.col("c2") >= 8, 2.0).otherwise(0.0)).alias("m2")
    )
    long = df.unpivot(["actual", "proj"], ["m1", "m2"], "candidate", "pred")
    delta = F.avg(F.abs(F.col("pred") - F.col("actual")) - F.abs(F.col("proj") - F.col("actual")))
    return long.groupBy("candidate").agg(F.count("*").alias("n"), F.count_if(F.col("pred") != F.col("proj")).alias("affected"), r4(delta, 5).alias("delta"))


@query("policy_pairs", """
    with w as (select season, cluster, week, max(case when arm = 'A' then points end) as a, max(case when arm = 'N' then points end) as n, max(points) as best from fx_arms group by season, cluster, week)
    select season, count(*) as n, round(avg(a - n), 4) as diff, round(avg(best - a), 4) as regret from w where a is not null and n is not null group by season""")
def policy_pairs(spark, sf_dir):
    wide = view(spark, sf_dir, "fx_arms").groupBy("season", "cluster", "week").pivot("arm", ["A", "N", "R"]).agg(F.max("points"))
    pairs = wide.where("A is not null and N is not null").withColumn("best", F.greatest("A", "N", "R"))
    return pairs.groupBy("season").agg(F.count("*").alias("n"), r4(F.avg(F.col("A") - F.col("N"))).alias("diff"), r4(F.avg(F.col("best") - F.col("A"))).alias("regret"))


@query("stage_correlation", """
    with s as (select season, k, cast(sum(targets) as double) as v1, cast(sum(receptions) as double) as v2, sum(pts) as gain from fx_games group by season, k),
    l as (select season, k, 'v1' as metric, v1 as v, gain from s union all select season, k, 'v2', v2, gain from s),
    r as (select season, metric, rank() over (partition by season, metric order by v) + (count(*) over (partition by season, metric, v) - 1) / 2.0 as a, rank() over (partition by season, metric order by gain) + (count(*) over (partition by season, metric, gain) - 1) / 2.0 as b from l)
    select season, metric, round(corr(a, b), 5) as r from r group by season, metric""")
def stage_correlation(spark, sf_dir):
    s = view(spark, sf_dir, "fx_games").groupBy("season", "k").agg(F.sum("targets").cast("double").alias("v1"), F.sum("receptions").cast("double").alias("v2"), F.sum("pts").alias("gain"))
    long = s.unpivot(["season", "k", "gain"], ["v1", "v2"], "metric", "v")
    ranked = long.select("season", "metric", evaluate.average_rank("v", ["season", "metric"]).alias("a"), evaluate.average_rank("gain", ["season", "metric"]).alias("b"))
    return ranked.groupBy("season", "metric").agg(r4(F.corr("a", "b"), 5).alias("r"))


@query("boot_p", """
    with u as (select c_mktsegment as position, ('0x' || substr(md5('5|' || c_custkey || '|0'), 1, 12))::bigint / 281474976710656.0::double - 0.1 as u from customer)
    select position, (1 + count(*) filter (where u <= 0)) / cast(1 + count(*) as double) as p from u group by position""")
def boot_p(spark, sf_dir):
    u = portable_uniform(F.lit(5), F.col("c_custkey"), F.lit(0)) - 0.1
    return evaluate.bootstrap_p(view(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("position"), u.alias("u")), "u", ["position"])
