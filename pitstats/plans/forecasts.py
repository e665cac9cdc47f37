"""Queries of distributional forecasts, leakage audits, horizons and value."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitstats.functions.scalars import portable_uniform, quantile_interp
from pitstats.operators import backtest, dist, fit, joins, leakage, value, windows
from pitstats.operators.quantiles import exact_quantiles
from pitstats.plans.registry import query
from pitstats.sources.fixtures import rounded, view

N = 64


def r4(column, places=4):
    return rounded(F.col(column) if isinstance(column, str) else column, places)


def quantiles(spark, sf_dir):
    """Sorted embeddings as quantile forecasts, with an outcome near their middle."""
    df = view(spark, sf_dir, "embeddings")
    q = F.array_sort(F.transform("embedding", lambda v: v.cast("double")))
    middle = F.aggregate(q, F.lit(0.0), lambda a, v: a + v) / F.size(q)
    return df.select("vec_id", F.col("label").cast("long").alias("class"), q.alias("q"), (middle + F.col("label") / 100.0).alias("y"))


QUANT = """
    qa as (select vec_id, label::bigint as class, list_sort(list_transform(embedding, lambda v: v::double)) as q from embeddings),
    qu as (select vec_id, class, q, list_sum(q) / len(q) + class / 100.0::double as y from qa)"""


@query("quantile_contract", f"with {QUANT} select class, count(*) as n, count(*) filter (where q <> list_sort(q)) as n_bad from qu group by class")
def quantile_contract(spark, sf_dir):
    rising = F.forall(F.sequence(F.lit(2), F.size("q")), lambda i: F.element_at("q", i) >= F.element_at("q", i - 1))
    return quantiles(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"), F.count_if(~rising).alias("n_bad"))


@query("crps", f"""
    with {QUANT}, l as (select vec_id, class, i, case when y >= q[i] then (i / 65.0::double) * (y - q[i]) else (1 - i / 65.0::double) * (q[i] - y) end as l from qu, range(1, 65) t(i)),
    c as (select vec_id, class, 2 * (sum(l) + (max(case when i = 1 then l end) + max(case when i = 64 then l end)) / 2) / 65 as crps from l group by vec_id, class)
    select vec_id, round(crps, 6) as crps from c""")
def crps(spark, sf_dir):
    return quantiles(spark, sf_dir).select("vec_id", r4(dist.crps(F.col("q"), F.col("y"), N), 6).alias("crps"))


UNEVEN = [0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98]
_UNEVEN_W = dist.weights(UNEVEN)
FORMS = f"""
    un as (select vec_id, y, [q[2], q[7], q[16], q[32], q[48], q[58], q[63]] as q, {UNEVEN} as tau, {_UNEVEN_W} as w from qu),
    fl as (select vec_id, 2 * sum(w[i] * case when y >= q[i] then tau[i] * (y - q[i]) else (1 - tau[i]) * (q[i] - y) end) as crps,
        2 * sum(w[i] * case when greatest(y, 0.0::double) >= greatest(q[i], 0.0::double) then tau[i] * (greatest(y, 0.0::double) - greatest(q[i], 0.0::double)) else (1 - tau[i]) * (greatest(q[i], 0.0::double) - greatest(y, 0.0::double)) end) as above from un, range(1, 8) t(i) group by vec_id),
    nz as (select vec_id, (q[48] - q[16]) / 1.35::double as s, (y - q[32]) / ((q[48] - q[16]) / 1.35::double) as z from qu),
    nt as (select *, 1 / (1 + 0.2316419::double * abs(z)) as t, exp(-z * z / 2) * 0.3989422804014327::double as d from nz),
    nn as (select *, d * t * (0.319381530::double + t * (-0.356563782::double + t * (1.781477937::double + t * (-1.821255978::double + t * 1.330274429::double)))) as up from nt)"""


@query("crps_forms", f"""
    with {QUANT}, {FORMS}
    select fl.vec_id, round(fl.crps, 6) as crps, round(fl.above, 6) as above, round(s * (z * (2 * case when z >= 0 then 1 - up else up end - 1) + 2 * d - 0.5641895835477563::double), 6) as normal
    from fl join nn using (vec_id)""")
def crps_forms(spark, sf_dir):
    """On an uneven grid; threshold-weighted; and of the normal forecast with the same median and quartiles."""
    rows = quantiles(spark, sf_dir)
    at = lambda i: F.element_at("q", i)
    few, y = F.array(*(at(i) for i in (2, 7, 16, 32, 48, 58, 63))), F.col("y")
    return rows.select(
        "vec_id", r4(dist.crps(few, y, UNEVEN), 6).alias("crps"), r4(dist.crps_above(few, y, UNEVEN, 0.0), 6).alias("above"),
        r4(dist.crps_normal(at(32), (at(48) - at(16)) / 1.35, y), 6).alias("normal"),
    )


#: Forecasts with an atom: quantiles and outcomes below 0 are moved to 0; every fifth outcome lies above all quantiles.
ATOMS = """
    qz as (select vec_id, class, list_transform(q, lambda v: greatest(v, 0.0::double)) as q, case when vec_id % 5 = 0 then q[64] + 0.01::double when vec_id % 5 = 1 then 0.0::double when vec_id % 5 = 2 then q[40] else greatest(y, 0.0::double) end as y from qu),
    qh as (select *, len(list_filter(q, lambda v: v <= y)) as hi, list_position(q, y) as lo from qz),
    qf as (select vec_id, class, lo, hi, y, case when y < q[1] then greatest(0.0::double, 1 / 65.0::double - (q[1] - y) / greatest(q[2] - q[1], 1e-9::double) / 65.0::double)
        when y > q[64] then least(1.0::double, 64 / 65.0::double + (y - q[64]) / greatest(q[64] - q[63], 1e-9::double) / 65.0::double)
        when hi = 64 then 64 / 65.0::double else (hi + (y - q[hi]) / (q[hi + 1] - q[hi])) / 65.0::double end as f from qh),
    qp as (select vec_id, class, y, f, case when coalesce(lo, 0) > 0 then lo / 65.0::double else f end as fm, ('0x' || substr(md5('12|' || vec_id), 1, 12))::bigint / 281474976710656.0::double as u from qf)"""


def atoms(spark, sf_dir):
    q = F.col("q")
    y = F.when(F.col("vec_id") % 5 == 0, F.element_at("q", 64) + 0.01).when(F.col("vec_id") % 5 == 1, 0.0).when(F.col("vec_id") % 5 == 2, F.element_at("q", 40))
    rows = quantiles(spark, sf_dir).withColumn("y", y.otherwise(F.greatest("y", F.lit(0.0))))
    return rows.withColumn("q", F.transform(q, lambda v: F.greatest(v, F.lit(0.0))))


@query("cdf_interp", f"with {QUANT}, {ATOMS} select vec_id, round(f, 6) as upper, round(fm, 6) as lower, round(0.8::double * f + (1 - 0.8::double) * (y >= 0)::int, 6) as mixed from qp")
def cdf_interp(spark, sf_dir):
    q, y = F.col("q"), F.col("y")
    return atoms(spark, sf_dir).select(
        "vec_id", r4(dist.cdf(q, y, N), 6).alias("upper"), r4(dist.cdf_before(q, y, N), 6).alias("lower"), r4(dist.mixed_cdf(q, y, N, F.lit(0.8)), 6).alias("mixed")
    )


@query("pit", f"""
    with {QUANT}, {ATOMS}, b as (select class, least(floor((fm + u * greatest(f - fm, 0)) * 10), 9)::bigint as bin from qp),
    c as (select class, bin, count(*) as n from b group by class, bin), t as (select class, sum(n) as total from c group by class)
    select class, bin, n::bigint as n, round(sum((n - total / 10.0::double) * (n - total / 10.0::double) / (total / 10.0::double)) over (partition by class) + (10 - count(*) over (partition by class)) * (total / 10.0::double), 4) as chi2 from c join t using (class)""")
def pit(spark, sf_dir):
    """Decile counts of the randomised transform and their chi-square against equal counts, per class."""
    u = portable_uniform(F.lit(12), F.col("vec_id"))
    p = atoms(spark, sf_dir).select("class", dist.pit(F.col("q"), F.col("y"), N, u).alias("pit"))
    bins = p.groupBy("class", F.least(F.floor(F.col("pit") * 10), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("class")
    expected = F.sum("n").over(whole) / 10.0
    off = F.col("n") - F.col("expected")
    out = bins.withColumn("expected", expected)
    chi2 = F.sum(off * off / F.col("expected")).over(whole) + (10 - F.count("*").over(whole)) * F.col("expected")
    return out.select("class", "bin", "n", r4(chi2).alias("chi2"))


@query("quantile_interp", f"""
    with {QUANT}, u as (select vec_id, q, ('0x' || substr(md5('3|' || vec_id), 1, 12))::bigint / 281474976710656.0::double as u from qu),
    a as (select vec_id, q, greatest(1.0, least(64.0, u * 65)) as a from u)
    select vec_id, round(q[floor(a)::int] + (a - floor(a)) * (q[least(floor(a)::int + 1, 64)] - q[floor(a)::int]), 6) as draw from a""")
def quantile_interp_(spark, sf_dir):
    u = portable_uniform(F.lit(3), F.col("vec_id"))
    return quantiles(spark, sf_dir).select("vec_id", r4(quantile_interp(F.col("q"), u), 6).alias("draw"))


@query("coverage", f"""
    with {QUANT} select class, count(*) as n, round(avg(case when y >= q[7] and y <= q[58] then 1.0::double else 0.0::double end), 6) as covered,
        round(avg((q[58] - q[7]) + 10.0::double * (greatest(q[7] - y, 0) + greatest(y - q[58], 0))), 5) as score from qu group by class""")
def coverage(spark, sf_dir):
    low, high, y = F.element_at("q", 7), F.element_at("q", 58), F.col("y")
    return quantiles(spark, sf_dir).groupBy("class").agg(
        F.count("*").alias("n"), r4(F.avg(dist.covered(low, high, y).cast("double")), 6).alias("covered"), r4(F.avg(dist.interval_score(low, high, y, 0.2)), 5).alias("score")
    )


@query("pod_moments", f"""
    with {QUANT}, m as (select vec_id, 0.25::double + 0.05::double * class as p, (list_sum(q) + (q[1] + q[64]) / 2) / 65 as a, (list_sum(list_transform(q, lambda v: v * v)) + (q[1] * q[1] + q[64] * q[64]) / 2) / 65 as b from qu)
    select vec_id, round(p * a, 6) as mean, round(p * b - p * a * p * a, 6) as variance from m""")
def pod_moments(spark, sf_dir):
    mean, variance = dist.moments(F.col("q"), 0.25 + 0.05 * F.col("class"), N)
    return quantiles(spark, sf_dir).select("vec_id", r4(mean, 6).alias("mean"), r4(variance, 6).alias("variance"))


@query("evor", f"""
    with {QUANT}, e as (select vec_id, list_transform(q, lambda v: greatest(v - 0.05::double, 0.0::double)) as e from qu)
    select vec_id, round(0.9::double * (list_sum(e) + (e[1] + e[64]) / 2) / 65, 6) as evor from e""")
def evor(spark, sf_dir):
    return quantiles(spark, sf_dir).select("vec_id", r4(0.9 * dist.excess(F.col("q"), F.lit(0.05), N), 6).alias("evor"))


def newton_sql(rows: str, by: str, steps: int = 25) -> str:
    """SQL of `steps` Newton steps of a logistic regression of y on x (columns of `rows`) per `by`; the last is `newton`."""
    same = ", ".join(f"r.{c}" for c in by.split(", "))
    ctes = [f"nb0 as (select {by}, 0.0::double as c0, 0.0::double as c1 from {rows} group by {by})"]
    for i in range(1, steps + 1):
        ctes.append(f"""nb{i} as (select {by}, (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as d0, (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as d1, c0 + d0 as c0, c1 + d1 as c1 from (
            select {by}, any_value(c0) as c0, any_value(c1) as c1, sum(y - p) as g0, sum((y - p) * x) as g1, sum(p * (1 - p)) as h00, sum(p * (1 - p) * x) as h01, sum(p * (1 - p) * x * x) as h11
            from (select {same}, r.x, r.y, b.c0, b.c1, 1 / (1 + exp(-greatest(-35, least(35, b.c0 + b.c1 * r.x)))) as p from {rows} r join nb{i - 1} b using ({by})) group by {by}))""")
    done = "case when abs(d0) <= 1e-8 and abs(d1) <= 1e-8 then"
    return ",\n".join([*ctes, f"newton as (select {by}, {done} c0 end as c0, {done} c1 end as c1 from nb{steps})"])


@query("brier_log_loss", f"""
    with lx as (select class, ln(p / (1 - p)) as x, o::double as y from fx_prob), {newton_sql("lx", "class")},
    s as (select class, count(*) as n, round(avg((p - o) * (p - o)), 6) as brier, round(avg(-(o * ln(least(0.999999, greatest(0.000001, p))) + (1 - o) * ln(1 - least(0.999999, greatest(0.000001, p))))), 6) as log_loss from fx_prob group by class)
    select s.*, round(newton.c1, 5) as slope, round(newton.c0, 5) as level from s join newton using (class)""")
def brier_log_loss(spark, sf_dir):
    """With the slope and level of a logistic regression of outcomes on the forecasts' log odds: 1 and 0 where calibrated."""
    rows, p, o = view(spark, sf_dir, "fx_prob"), F.col("p"), F.col("o")
    scores = rows.groupBy("class").agg(F.count("*").alias("n"), r4(F.avg(dist.brier(p, o)), 6).alias("brier"), r4(F.avg(dist.log_loss(p, o)), 6).alias("log_loss"))
    line = dist.calibration(rows, "p", "o", ["class"])
    return scores.join(line, "class").select("class", scores["n"], "brier", "log_loss", r4("slope", 5).alias("slope"), r4("level", 5).alias("level"))


@query("reliability", """
    with b as (select greatest(ceil(p * 10), 1)::bigint as bin, count(*) as n, avg(p) as mean_p, avg(o) as s from fx_prob group by 1)
    select bin, n, round(mean_p, 6) as mean_p, round(s, 6) as observed,
        round((s + 3.8414588206941227 / (2 * n)) / (1 + 3.8414588206941227 / n) - 1.959963984540054 / (1 + 3.8414588206941227 / n) * sqrt(s * (1 - s) / n + 3.8414588206941227 / (4.0 * n * n)), 5) as low from b""")
def reliability(spark, sf_dir):
    out = dist.reliability(view(spark, sf_dir, "fx_prob"), "p", "o", 10, [])
    return out.select("bin", "n", r4("mean_p", 6).alias("mean_p"), r4("observed", 6).alias("observed"), r4("low", 5).alias("low"))


@query("corp")
def corp(spark, sf_dir):
    """Brier = miscalibration - discrimination + uncertainty, by isotonic recalibration."""
    df = view(spark, sf_dir, "fx_prob").select("p", F.col("o").cast("double").alias("o"))
    fitted = fit.isotonic(df, "p", "o").transform(df)
    base = df.agg(F.avg("o").alias("m"))
    rows = fitted.crossJoin(base)
    score = lambda p: F.avg(dist.brier(p, F.col("o")))
    return rows.agg(
        r4(score(F.col("p")) - score(F.col("fitted")), 6).alias("mcb"), r4(score(F.col("m")) - score(F.col("fitted")), 6).alias("dsc"), r4(score(F.col("m")), 6).alias("unc")
    )


#: Edges of the bands of a projection and the least number of rows of a merged group.
EDGES, LEAST = [50.0, 100.0, 150.0, 200.0, 250.0, 300.0], 200


def _merged(by: str, based: str) -> str:
    """SQL of bands `bd` merged into groups `tb` (classes by `by`), from the top down as the operator does."""
    on = " and ".join(f"r.{c} = n.{c}" for c in by.split(", "))
    return f"""
    bd as (select *, 1 + {" + ".join(f"(proj >= {e})::int" for e in EDGES)} as band from {based}),
    nb as (select {by}, b.band, count(bd.e) as n from (select distinct {by} from bd) c cross join (select unnest(range(1, {len(EDGES) + 2})) as band) b left join bd using ({by}, band) group by {by}, b.band),
    walk as (select {by}, band, 1 as grp, n as acc from nb where band = {len(EDGES) + 1}
        union all select {", ".join(f"n.{c}" for c in by.split(", "))}, n.band, case when r.acc < {LEAST} then r.grp else r.grp + 1 end, case when r.acc < {LEAST} then r.acc + n.n else n.n end
        from walk r join nb n on {on} and n.band = r.band - 1),
    lw as (select {by}, case when acc < {LEAST} and grp > 1 then grp - 1 else grp end as top from walk where band = 1),
    og as (select {by}, band, least(grp, top) as grp from walk join lw using ({by})),
    tb as (select *, min(band) over (partition by {by}, grp) as band_lo, max(band) over (partition by {by}, grp) as band_hi from og)"""


BASED = "based as (select k, gi, season, position, proj, actual, actual - proj as e from fx_proj where proj is not null and season < 2000)"


@query("quantile_table", f"""
    with recursive {BASED}, {_merged("position", "based")}
    select bd.position, tb.band_lo::bigint as band_lo, tb.band_hi::bigint as band_hi, count(*) as n, round(stddev_samp(e), 3) as sd, round(quantile_cont(e, 0.1), 3) as q1, round(quantile_cont(e, 0.5), 3) as q5, round(quantile_cont(e, 0.9), 3) as q9
    from bd join tb using (position, band) group by bd.position, tb.band_lo, tb.band_hi""")
def quantile_table(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_proj").where("proj is not null and season < 2000").withColumn("e", F.col("actual") - F.col("proj"))
    t = dist.residual_bands(rows, ["position"], "e", "proj", EDGES, 9, LEAST)
    return t.select(
        "position", *(F.col(c).cast("long").alias(c) for c in ("band_lo", "band_hi", "n")), r4("sd", 3).alias("sd"), *(r4(F.col("q")[i], 3).alias(f"q{i + 1}") for i in (0, 4, 8))
    )


@query("quantile_apply", f"""
    with recursive {BASED}, {_merged("position", "based")},
    t as (select bd.position, tb.grp, quantile_cont(e, 0.5) as q5, quantile_cont(e, 0.9) as q9 from bd join tb using (position, band) group by bd.position, tb.grp),
    fl as (select position, min(actual) as floor from based group by position),
    r as (select k, gi, position, proj, 1 + {" + ".join(f"(proj >= {e})::int" for e in EDGES)} as band from fx_proj where season >= 2000 and proj is not null)
    select r.k, r.gi, round(greatest(r.proj + t.q5, fl.floor), 3) as q50, round(greatest(r.proj + t.q9, fl.floor), 3) as q90
    from r left join tb using (position, band) left join t on t.position = r.position and t.grp = tb.grp left join fl on fl.position = r.position""")
def quantile_apply(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_proj").where("proj is not null").withColumn("e", F.col("actual") - F.col("proj"))
    t = dist.residual_bands(rows.where("season < 2000"), ["position"], "e", "proj", EDGES, 9, LEAST)
    out = dist.apply_bands(rows.where("season >= 2000"), t, ["position"], "proj", EDGES)
    return out.select("k", "gi", r4(F.col("q")[4], 3).alias("q50"), r4(F.col("q")[8], 3).alias("q90"))


@query("pods", f"""
    with recursive {BASED}, {_merged("position", "based")},
    t as (select bd.position, tb.grp, quantile_cont(e, {[round(i / 10, 1) for i in range(1, 10)]}) as q from bd join tb using (position, band) group by bd.position, tb.grp),
    fl as (select position, min(actual) as floor from based group by position),
    r as (select k, gi, position, proj, case when c2 >= 8 then 0.95::double when c2 >= 4 then 0.8::double else 0.5::double end as p_active, 1 + {" + ".join(f"(proj >= {e})::int" for e in EDGES)} as band from fx_proj where season >= 2000 and proj is not null),
    p as (select r.k, r.gi, r.p_active, list_transform(t.q, lambda v: greatest(r.proj + v, fl.floor)) as q from r join tb using (position, band) join t on t.position = r.position and t.grp = tb.grp join fl on fl.position = r.position)
    select k, gi, p_active, round(q[1], 3) as q10, round(q[5], 3) as q50, round(q[9], 3) as q90, round((list_sum(q) + (q[1] + q[9]) / 2) / 10, 3) as mean_active, round(p_active * (list_sum(q) + (q[1] + q[9]) / 2) / 10, 3) as mean from p""")
def pods(spark, sf_dir):
    """Forecasts as quantiles given activity, the probability of activity, and the mean."""
    rows = view(spark, sf_dir, "fx_proj").where("proj is not null").withColumn("e", F.col("actual") - F.col("proj"))
    t = dist.residual_bands(rows.where("season < 2000"), ["position"], "e", "proj", EDGES, 9, LEAST)
    p = F.when(F.col("c2") >= 8, 0.95).when(F.col("c2") >= 4, 0.8).otherwise(0.5)
    out = dist.apply_bands(rows.where("season >= 2000"), t, ["position"], "proj", EDGES).where("q is not null").withColumn("p_active", p)
    out = dist.with_mean(out, "q", "p_active", 9)
    return out.select("k", "gi", "p_active", *(r4(F.col("q")[i], 3).alias(f"q{10 * i + 10}") for i in (0, 4, 8)), r4("mean_active", 3).alias("mean_active"), r4("mean", 3).alias("mean"))


@query("dev_scoring", f"""
    with recursive rs as (select k, gi, season, position, proj, actual, actual - proj as e from fx_proj where proj is not null),
    be as (select s.season, r.position, r.proj, r.actual, r.e from rs r join (select distinct season from rs) s on r.season < s.season), {_merged("season, position", "be")},
    t as (select bd.season, bd.position, tb.grp, quantile_cont(e, {[round(i / 20, 2) for i in range(1, 20)]}) as q from bd join tb using (season, position, band) group by bd.season, bd.position, tb.grp),
    fl as (select season, position, min(actual) as floor from be group by season, position),
    sc as (select r.season, r.position, r.k, r.gi, r.actual as y, list_transform(t.q, lambda v: greatest(r.proj + v, fl.floor)) as q
        from (select *, 1 + {" + ".join(f"(proj >= {e})::int" for e in EDGES)} as band from rs) r join tb using (season, position, band)
        join t on t.season = r.season and t.position = r.position and t.grp = tb.grp join fl on fl.season = r.season and fl.position = r.position),
    l as (select season, position, k, gi, i, case when y >= q[i] then (i / 20.0::double) * (y - q[i]) else (1 - i / 20.0::double) * (q[i] - y) end as l from sc, range(1, 20) g(i)),
    c as (select season, position, k, gi, 2 * (sum(l) + (max(case when i = 1 then l end) + max(case when i = 19 then l end)) / 2) / 20 as crps from l group by season, position, k, gi)
    select c.season, c.position, count(*) as n, round(avg(c.crps), 4) as crps, round(avg(case when sc.y >= sc.q[2] and sc.y <= sc.q[18] then 1.0::double else 0.0::double end), 4) as coverage
    from c join sc using (season, position, k, gi) group by c.season, c.position""")
def dev_scoring(spark, sf_dir):
    """CRPS and 80% coverage of the banded residual quantiles, each season from all earlier ones.

    A row counts in the bands of each later season; the first season has nothing before it and is not scored.
    """
    rows = view(spark, sf_dir, "fx_proj").where("proj is not null").withColumn("e", F.col("actual") - F.col("proj"))
    # a row for each season
    seasons = F.broadcast(rows.select(F.col("season").alias("later")).distinct())
    earlier = rows.join(seasons, F.col("season") < F.col("later")).drop("season").withColumnRenamed("later", "season")
    t = dist.residual_bands(earlier, ["season", "position"], "e", "proj", EDGES, 19, LEAST)
    scored = dist.apply_bands(rows, t, ["season", "position"], "proj", EDGES).where("q is not null")
    return scored.groupBy("season", "position").agg(
        F.count("*").alias("n"), r4(F.avg(dist.crps(F.col("q"), F.col("actual"), 19))).alias("crps"),
        r4(F.avg(dist.covered(F.col("q")[1], F.col("q")[17], F.col("actual")).cast("double"))).alias("coverage"),
    )


#: Captures with the day's last value `final` and hours left to the cutoff.
REVISED = """
    f as (select k, day, max_by(v, (ts, event_id)) as final from fx_captures group by k, day),
    r as (select c.k, c.day, c.ts, c.event_id, c.v, f.final, f.final - c.v as d, case when 18 - hour(c.ts) <= 0 then 'after' when 18 - hour(c.ts) <= 6 then '0-6' when 18 - hour(c.ts) <= 12 then '6-12' else '12+' end as bin from fx_captures c join f on f.k = c.k and f.day = c.day)"""


def _revised(spark, sf_dir):
    caps = view(spark, sf_dir, "fx_captures")
    final = caps.groupBy("k", "day").agg(F.max_by("v", F.struct("ts", "event_id")).alias("final"))
    lead = 18 - F.hour("ts")
    bin_ = F.when(lead <= 0, "after").when(lead <= 6, "0-6").when(lead <= 12, "6-12").otherwise("12+")
    return caps.join(final, ["k", "day"]).withColumn("bin", bin_)


@query("revision_study", f"""
    with {REVISED}, m as (select bin, count(*) as n, count(distinct day) as n_days, avg(d) as drift, var_samp(d) as variance, count(*) filter (where final < v / 2) as n_halved,
        avg(case when final <= 5 then 1.0::double else 0.0::double end) filter (where v > 5) as share_zero from r group by bin),
    c as (select r.bin, r.k, sum(r.d - m.drift) as u, sum((r.d - m.drift) * (r.d - m.drift) - m.variance) as w from r join m using (bin) group by r.bin, r.k),
    e as (select bin, sqrt(sum(u * u)) as su, sqrt(sum(w * w)) as sw from c group by bin)
    select m.bin, n, n_days, round(drift, 4) as drift, round(drift - 1.96 * su / n, 4) as drift_low, round(drift + 1.96 * su / n, 4) as drift_high, round(variance, 3) as variance, n_halved, round(share_zero, 5) as share_zero,
        round(case when n_days >= 4 and abs(drift) > 1.96 * su / n then drift else 0 end, 4) as adopted_drift, round(case when n_days >= 4 and variance > 1.96 * sw / n then variance else 0 end, 3) as adopted_spread from m join e using (bin)""")
def revision_study(spark, sf_dir):
    """Per time left: drift of captures to the final value with its interval, transitions to (nearly) nothing, and what of
    drift and spread is adopted."""
    out = dist.revisions(_revised(spark, sf_dir), ["bin"], "k", "day", "v", "final", 5.0, 4)
    return out.select(
        "bin", "n", "n_days", *(r4(c).alias(c) for c in ("drift", "drift_low", "drift_high")), r4("variance", 3).alias("variance"), "n_halved", r4("share_zero", 5).alias("share_zero"),
        r4("adopted_drift").alias("adopted_drift"), r4("adopted_spread", 3).alias("adopted_spread"),
    )


@query("revision_martingale", f"""
    with {REVISED}, p as (select k, v, final, lead(v) over (partition by k, day order by ts, event_id) as nx from r),
    q as (select k, nx - v as a, final - nx as b from p where nx is not null),
    m as (select count(*) as n, avg(a) as ma, avg(b) as mb, sqrt(var_pop(a)) as sa, sqrt(var_pop(b)) as sb, covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) as rho, covar_pop(a, b) / var_pop(a) as slope from q),
    i as (select q.k, sum((a - ma) / sa * (b - mb) / sb - rho / 2 * ((a - ma) / sa * (a - ma) / sa + (b - mb) / sb * (b - mb) / sb)) as u from q, m group by q.k)
    select m.n as pairs, round(rho, 5) as cor, round(rho - 1.96 * se / n, 5) as cor_low, round(rho + 1.96 * se / n, 5) as cor_high, round(slope, 5) as slope, abs(rho) > 1.96 * se / n as predictable from m, (select sqrt(sum(u * u)) as se from i)""")
def revision_martingale(spark, sf_dir):
    """Whether one revision tells the next: correlation of a capture's revision with what is still to come, by entity."""
    out = dist.martingale(_revised(spark, sf_dir), "k", ["k", "day"], ["ts", "event_id"], "v", "final")
    return out.select("pairs", *(r4(c, 5).alias(c) for c in ("cor", "cor_low", "cor_high", "slope")), "predictable")


@query("persistence", """
    with e as (select k, season, week, actual - proj as e, lead(actual - proj) over (partition by k, season order by week) as e2 from fx_proj where proj is not null)
    select season, count(*) as n, round(corr(e, e2), 5) as r, round(regr_slope(e2, e), 5) as slope from e where e2 is not null group by season""")
def persistence(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_proj").where("proj is not null").select("k", "season", "week", (F.col("actual") - F.col("proj")).alias("e"))
    pairs = joins.pair_with_next(rows, ["k", "season"], "week", ["e"])
    return pairs.groupBy("season").agg(F.count("*").alias("n"), r4(F.corr("e", "next_e"), 5).alias("r"), r4(F.regr_slope("next_e", "e"), 5).alias("slope"))


DRAWS = """
    dr as (select g.team, g.gi, g.k, sim, g.pts * (0.5::double + ('0x' || substr(md5('11|' || g.k || '|' || g.gi || '|' || sim), 1, 12))::bigint / 281474976710656.0::double) as x from fx_games g, range(1, 51) s(sim)),
    tot as (select gi, team, sim, sum(x) as t from dr group by gi, team, sim), act as (select gi, team, sum(pts) as a from fx_games group by gi, team)"""


@query("scenario_draws", f"with {DRAWS} select gi, k, count(*) as n, round(avg(x), 4) as mean from dr group by gi, k")
def scenario_draws(spark, sf_dir):
    return _draws(spark, sf_dir).groupBy("gi", "k").agg(F.count("*").alias("n"), r4(F.avg("x")).alias("mean"))


def _draws(spark, sf_dir):
    """Draws keyed by entity, month and simulation: adding an entity or a month never changes another's."""
    games = view(spark, sf_dir, "fx_games").select("team", "k", "gi", "pts")
    sims = games.select("*", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("sim"))
    return sims.withColumn("x", F.col("pts") * (0.5 + portable_uniform(F.lit(11), F.col("k"), F.col("gi"), F.col("sim"))))


@query("sum_distribution", f"""
    with {DRAWS} select t.gi, t.team, round(avg(t.t), 3) as mean, round(quantile_cont(t.t, 0.1), 3) as q10, round(quantile_cont(t.t, 0.9), 3) as q90, avg(case when t.t <= a.a then 1.0::double else 0.0::double end) as pit
    from tot t join act a on a.gi = t.gi and a.team = t.team group by t.gi, t.team""")
def sum_distribution(spark, sf_dir):
    totals = _draws(spark, sf_dir).groupBy("gi", "team", "sim").agg(F.sum("x").alias("t"))
    actual = view(spark, sf_dir, "fx_games").groupBy("gi", "team").agg(F.sum("pts").alias("a"))
    return totals.join(actual, ["gi", "team"]).groupBy("gi", "team").agg(
        r4(F.avg("t"), 3).alias("mean"), r4(F.percentile("t", 0.1), 3).alias("q10"), r4(F.percentile("t", 0.9), 3).alias("q90"), F.avg((F.col("t") <= F.col("a")).cast("double")).alias("pit")
    )


@query("sd_match", f"""
    with {DRAWS}, s as (select gi, scale / 10.0::double as scale, stddev_samp(t.m + (t.t - t.m) * scale / 10.0::double) as sd from (select gi, team, sim, t, avg(t) over (partition by gi, team) as m from tot) t, range(5, 16) g(scale) group by gi, scale)
    select gi, scale, round(sd, 4) as sd from s""")
def sd_match(spark, sf_dir):
    totals = _draws(spark, sf_dir).groupBy("gi", "team", "sim").agg(F.sum("x").alias("t"))
    scaled = totals.withColumn("m", F.avg("t").over(Window.partitionBy("gi", "team"))).select("*", F.explode(F.sequence(F.lit(5), F.lit(15))).alias("g"))
    return scaled.groupBy("gi", (F.col("g") / 10.0).alias("scale")).agg(r4(F.stddev_samp(F.col("m") + (F.col("t") - F.col("m")) * F.col("g") / 10.0)).alias("sd"))


# --- leakage -------------------------------------------------------------------------------------------------------


@query("corrupt_from", "select k, gi, case when gi >= 199801 then -targets - 1009 else targets end as targets, case when gi >= 199801 then 'x_' || position else position end as position from fx_games")
def corrupt_from(spark, sf_dir):
    return leakage.corrupt_from(view(spark, sf_dir, "fx_games").select("k", "gi", "targets", "position"), "gi", 199801, ["k"])


def _honest(rows, history):
    states = history.select("k", "gi", windows.trailing_mean("pts", ["k"], ["gi"], 3).alias("roll3"))
    return joins.asof_strict(rows, states, ["k"], "gi", ["roll3"])


def _planted(rows, history):
    return _honest(rows, history).join(history.select("k", "gi", F.col("pts").alias("same_month")), ["k", "gi"], "left")


@query("leak_check", """
    select 200006 as cutoff, c.col as "column", count(*) as n, count(*) filter (where c.col = 'same_month' and g.k is not null) as n_changed from fx_targets t left join fx_games g on g.k = t.k and g.gi = t.gi, (values ('roll3'), ('same_month')) c(col) where t.gi = 200006 group by c.col
    union all select 200102, c.col, count(*), count(*) filter (where c.col = 'same_month' and g.k is not null) from fx_targets t left join fx_games g on g.k = t.k and g.gi = t.gi, (values ('roll3'), ('same_month')) c(col) where t.gi = 200102 group by c.col""")
def leak_check(spark, sf_dir):
    """The honest feature doesn't move, the planted one does."""
    games = view(spark, sf_dir, "fx_games").select("k", "gi", "pts")
    targets = view(spark, sf_dir, "fx_targets").select("k", "gi")
    leakage.leak_gate(leakage.leak_check(targets, games, _honest, ["k", "gi"], "gi", [200006], ["k"]))
    return leakage.leak_check(targets, games, _planted, ["k", "gi"], "gi", [200006, 200102], ["k"])


# --- horizons and value --------------------------------------------------------------------------------------------


@query("levels", """
    with a as (select k, season, week, gi, proj, avg(actual) over (partition by k order by gi rows between 4 preceding and 1 preceding) as l4 from fx_proj)
    select k, gi, proj as cur, round(l4, 4) as avg4, round(coalesce((proj + l4) / 2, proj, l4), 4) as blend from a""")
def levels(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("gi").rowsBetween(-4, -1)
    df = view(spark, sf_dir, "fx_proj").withColumn("l4", F.avg("actual").over(w))
    return df.select("k", "gi", F.col("proj").alias("cur"), r4("l4").alias("avg4"), r4(F.coalesce((F.col("proj") + F.col("l4")) / 2, "proj", "l4")).alias("blend"))


ALLOWED = "al as (select (team + gi) % 25 as opp, season as season, gi as gi, sum(pts) as points, count(*) as games from fx_games group by (team + gi) % 25, season, gi)"


@query("opponent_factor", f"""
    with {ALLOWED}, lg as (select season, gi, sum(points) as lp, sum(games) as ln from al group by season, gi),
    lm as (select season, gi, sum(lp) over w / sum(ln) over w as mean from lg window w as (partition by season order by gi range between unbounded preceding and 1 preceding)),
    o as (select opp, season, gi, sum(points) over w as p, sum(games) over w as g from al window w as (partition by opp, season order by gi range between unbounded preceding and 1 preceding))
    select opp, gi, round(coalesce((p / mean + 20) / (g + 20), 1.0::double), 5) as factor from o join lm using (season, gi)""")
def opponent_factor(spark, sf_dir):
    allowed = view(spark, sf_dir, "fx_games").groupBy(((F.col("team") + F.col("gi")) % 25).alias("opp"), "season", "gi").agg(F.sum("pts").alias("points"), F.count("*").alias("games"))
    return value.opponent_factor(allowed, ["opp"], "season", "gi", 20.0).select("opp", "gi", r4("factor", 5).alias("factor"))


HORIZON = """
    hz as (select a.k, a.position, a.season, a.week, b.week as target, case when b.week - a.week <= 2 then '1-2' when b.week - a.week <= 5 then '3-5' else '6+' end as bucket, a.proj as level, b.actual as y
      from fx_proj a join fx_proj b on b.k = a.k and b.season = a.season and b.week > a.week where a.proj is not null)"""


def _horizon(spark, sf_dir):
    base = view(spark, sf_dir, "fx_proj")
    rows = base.where("proj is not null").select("k", "position", "season", "week", F.col("proj").alias("level"))
    later = joins.horizon_expand(rows, base.select("k", "season", "week"), ["k", "season"], "week")
    outcome = base.select("k", "season", F.col("week").alias("target"), F.col("actual").alias("y"))
    d = F.col("target") - F.col("week")
    return later.join(outcome, ["k", "season", "target"]).withColumn("bucket", F.when(d <= 2, "1-2").when(d <= 5, "3-5").otherwise("6+"))


@query("ros_fit", f"with {HORIZON} select position, bucket, count(*) as n, round(regr_intercept(y, level), 3) as a, round(regr_slope(y, level), 5) as b from hz where season < 2000 group by position, bucket")
def ros_fit(spark, sf_dir):
    return _horizon(spark, sf_dir).where("season < 2000").groupBy("position", "bucket").agg(F.count("*").alias("n"), r4(F.regr_intercept("y", "level"), 3).alias("a"), r4(F.regr_slope("y", "level"), 5).alias("b"))


@query("ros_fit_quadratic", f"""
    with {HORIZON}, h as (select position, bucket, y, level as x, level * level as z from hz where season < 2000),
    c as (select position, bucket, count(*) as n, avg(x) as mx, avg(z) as mz, avg(y) as my, var_pop(x) as xx, var_pop(z) as zz, covar_pop(x, z) as xz, covar_pop(x, y) as xy, covar_pop(z, y) as zy from h group by position, bucket),
    b as (select *, (xy * zz - zy * xz) / (xx * zz - xz * xz) as b, (zy * xx - xy * xz) / (xx * zz - xz * xz) as c from c where n >= 20 and xx * zz - xz * xz > 0.000000001)
    select position, bucket, n, round(my - b * mx - c * mz, 3) as a, round(b, 5) as b, round(c * 1000, 5) as c from b""")
def ros_fit_quadratic(spark, sf_dir):
    """Level and its square, with a thousandth's unit of the second slope."""
    rows = _horizon(spark, sf_dir).where("season < 2000").withColumn("z", F.col("level") * F.col("level"))
    return fit.two_slopes(rows, ["position", "bucket"], "level", "z", "y", 20).select(
        "position", "bucket", "n", r4("a", 3).alias("a"), r4("b", 5).alias("b"), r4(F.col("c") * 1000, 5).alias("c")
    )


#: Per position and bucket, from all earlier seasons: the probability of activity from the log of the level, and the line
#: of the active rows.
TWO_STAGE = f"""{HORIZON}, h as (select *, y >= level / 2 as active, ln(greatest(level, 0.1::double)) as x from hz),
    es as (select s.season, h.position, h.bucket, h.x, h.level, h.y as points, case when h.active then 1.0::double else 0.0::double end as y from h join (select distinct season from h) s on h.season < s.season),
    {newton_sql("es", "season, position, bucket")},
    tf as (select season, position, bucket, avg(y) as share, regr_intercept(points, level) filter (where y = 1) as a, regr_slope(points, level) filter (where y = 1) as b from es group by season, position, bucket)"""


@query("ros_fit_two_stage", f"""
    with {TWO_STAGE}
    select h.season, h.position, h.bucket, count(*) as n, round(avg(coalesce(1 / (1 + exp(-(n.c0 + n.c1 * h.x))), tf.share)), 4) as p_active, round(avg(coalesce(1 / (1 + exp(-(n.c0 + n.c1 * h.x))), tf.share) * greatest(tf.a + tf.b * h.level, 0)), 3) as forecast, round(avg(h.y), 3) as actual
    from h join newton n using (season, position, bucket) join tf using (season, position, bucket) group by h.season, h.position, h.bucket""")
def ros_fit_two_stage(spark, sf_dir):
    """Each season from all earlier ones: the probability of activity given the level (the share of active rows where that
    has no finite fit), times the line of the active rows."""
    rows = _horizon(spark, sf_dir).withColumns({"active": (F.col("y") >= F.col("level") / 2).cast("double"), "x": F.ln(F.greatest("level", F.lit(0.1)))})
    by = ["season", "position", "bucket"]
    past = fit.earlier_seasons(rows.select(*by, "x", "level", "y", "active"))
    odds = fit.grouped_logit(past, by, ["x"], "active").select(*by, "coef")
    played = F.when(F.col("active") == 1, F.col("y"))
    line = past.groupBy(*by).agg(F.avg("active").alias("share"), F.regr_intercept(played, "level").alias("a"), F.regr_slope(played, "level").alias("b"))
    scored = rows.join(odds, by).join(line, by).withColumn("p", F.coalesce(fit.logistic(F.col("coef"), [F.col("x")]), "share"))
    expected = F.col("p") * F.greatest(F.col("a") + F.col("b") * F.col("level"), F.lit(0.0))
    return scored.groupBy(*by).agg(F.count("*").alias("n"), r4(F.avg("p")).alias("p_active"), r4(F.avg(expected), 3).alias("forecast"), r4(F.avg("y"), 3).alias("actual"))


#: Runs of weeks without a gap: how many weeks a row's run goes on, whether it then ended within the season, and from
#: these, for all earlier seasons, the product-limit share of runs that last through a lead.
SURVIVAL = """
    lw as (select season, max(week) as last from fx_proj group by season),
    ri as (select k, season, position, week, least(floor(coalesce(proj, 0) / 100), 3)::bigint as band, week - row_number() over (partition by k, season order by week) as island from fx_proj),
    rn as (select ri.season, position, band, max(week) over (partition by k, ri.season, island) - week as r, max(week) over (partition by k, ri.season, island) < lw.last as ended from ri join lw using (season)),
    rc as (select s.season, position, band, r, count(*) as c, count(*) filter (where ended) as d from rn join (select distinct season from rn) s on rn.season < s.season group by s.season, position, band, r),
    rl as (select g.season, g.position, g.band, l.lead, coalesce(sum(rc.c) filter (where rc.r >= l.lead), 0) + coalesce(sum(rc.d) filter (where rc.r = l.lead - 1), 0) as n, coalesce(sum(rc.d) filter (where rc.r = l.lead - 1), 0) as d
        from (select distinct season, position, band from rc) g cross join (select unnest(range(1, 12)) as lead) l left join rc using (season, position, band) group by g.season, g.position, g.band, l.lead),
    sv as (select *, exp(sum(ln(greatest(1 - d / nullif(n, 0), 1e-12::double))) over (partition by season, position, band order by lead)) as alive from rl where n > 0)"""


def _runs(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_proj").select("k", "season", "position", "week", F.least(F.floor(F.coalesce("proj", F.lit(0.0)) / 100), F.lit(3)).cast("long").alias("band"))
    return value.runs(rows, ["k", "season"], "season", "week")


@query("activity_survival", f"with {SURVIVAL} select season, position, band, lead, n::bigint as at_risk, d::bigint as ended, round(alive, 5) as alive from sv")
def activity_survival(spark, sf_dir):
    """Share of runs of weeks that go on through a lead, by position and band of the level, from all earlier seasons."""
    alive = value.survival(_runs(spark, sf_dir), ["season", "position", "band"], 11, "season")
    return alive.select("season", "position", "band", "lead", "at_risk", "ended", r4("alive", 5).alias("alive"))


@query("ros_forecast", f"""
    with {HORIZON}, {SURVIVAL},
    fe as (select s.season, position, bucket, y, level from hz join (select distinct season from hz) s on hz.season < s.season),
    f as (select season, position, bucket, regr_intercept(y, level) as a, regr_slope(y, level) as b from fe group by season, position, bucket),
    t as (select p.k, p.season, p.position, p.week, w.week as target, w.week - p.week as lead, p.proj as level, least(floor(p.proj / 100), 3)::bigint as band, case when w.week - p.week <= 2 then '1-2' when w.week - p.week <= 5 then '3-5' else '6+' end as bucket, coalesce(o.actual, 0) as y
        from fx_proj p join (select distinct season, week from fx_proj) w on w.season = p.season and w.week > p.week left join fx_proj o on o.k = p.k and o.season = p.season and o.week = w.week where p.proj is not null)
    select k, season, week, count(*) as n, round(sum(sv.alive), 4) as active, round(sum(sv.alive * greatest(f.a + f.b * level, 0)), 3) as forecast, round(sum(y), 3) as actual
    from t join f using (season, position, bucket) join sv using (season, position, band, lead) group by k, season, week""")
def ros_forecast(spark, sf_dir):
    """Each season from all earlier ones: over the weeks left, played or not, the share of runs that go on so long times
    the line of played weeks. `active` is the expected number of played weeks."""
    base = view(spark, sf_dir, "fx_proj")
    by = ["season", "position", "bucket"]
    past = fit.earlier_seasons(_horizon(spark, sf_dir).select(*by, "y", "level"))
    line = past.groupBy(*by).agg(F.regr_intercept("y", "level").alias("a"), F.regr_slope("y", "level").alias("b"))
    alive = value.survival(_runs(spark, sf_dir), ["season", "position", "band"], 11, "season")
    rows = base.where("proj is not null").select("k", "season", "position", "week", F.col("proj").alias("level"), F.least(F.floor(F.col("proj") / 100), F.lit(3)).cast("long").alias("band"))
    weeks = F.broadcast(base.select("season", F.col("week").alias("target")).distinct())  # a row for each week of a season
    ahead = rows.join(weeks, "season").where("target > week").withColumn("lead", F.col("target") - F.col("week"))
    outcome = base.select("k", "season", F.col("week").alias("target"), F.col("actual").alias("y"))
    ahead = ahead.join(outcome, ["k", "season", "target"], "left").withColumn("bucket", F.when(F.col("lead") <= 2, "1-2").when(F.col("lead") <= 5, "3-5").otherwise("6+"))
    scored = ahead.join(line, by).join(alive.select("season", "position", "band", "lead", "alive"), ["season", "position", "band", "lead"])
    points = F.col("alive") * F.greatest(F.col("a") + F.col("b") * F.col("level"), F.lit(0.0))
    return scored.groupBy("k", "season", "week").agg(
        F.count("*").alias("n"), r4(F.sum("alive")).alias("active"), r4(F.sum(points), 3).alias("forecast"), r4(F.sum(F.coalesce("y", F.lit(0.0))), 3).alias("actual")
    )


@query("waiver_calib", f"with {HORIZON}, w as (select position, k, season, week, level, avg(y) as y from hz where target - week <= 4 group by position, k, season, week, level) select position, count(*) as n, round(regr_slope(y, level), 5) as b from w group by position")
def waiver_calib(spark, sf_dir):
    near = _horizon(spark, sf_dir).where(F.col("target") - F.col("week") <= 4)
    means = near.groupBy("position", "k", "season", "week", "level").agg(F.avg("y").alias("y"))
    return means.groupBy("position").agg(F.count("*").alias("n"), r4(F.regr_slope("y", "level"), 5).alias("b"))


@query("components_fit", f"with {HORIZON} select position, bucket, count(*) as n, round(case when count(*) >= 20 then avg(y) else 0 end, 3) as mean_active, round(avg(case when y > level / 2 then 1.0::double else 0.0::double end), 5) as kept from hz group by position, bucket")
def components_fit(spark, sf_dir):
    n = F.count("*")
    kept = F.avg((F.col("y") > F.col("level") / 2).cast("double"))
    return _horizon(spark, sf_dir).groupBy("position", "bucket").agg(n.alias("n"), r4(F.when(n >= 20, F.avg("y")).otherwise(0.0), 3).alias("mean_active"), r4(kept, 5).alias("kept"))


SLOTS = {"BUILDING": 10, "MACHINERY": 8, "AUTOMOBILE": 8}
FLEX = ["BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD"]
STARTED = """
    r1 as (select k, gi, season, position, coalesce(proj, 0) as v, coalesce(proj, 0) > 0 and row_number() over (partition by gi, position order by coalesce(proj, 0) desc, k) <= case position when 'BUILDING' then 10 when 'MACHINERY' then 8 when 'AUTOMOBILE' then 8 else 0 end as own from fx_proj),
    r2 as (select *, not own and v > 0 and position in ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD') as may from r1),
    st as (select *, case when own then position when may and row_number() over (partition by gi, may order by v desc, k) <= 12 then 'flex' end as slot from r2),
    bs as (select gi, case when position in ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD') then 'flex' else position end as g, max(case when slot is null then v end) as repl from st group by 1, 2)"""


def _started(spark, sf_dir):
    weekly = view(spark, sf_dir, "fx_proj").select("k", "gi", "season", "position", F.coalesce("proj", F.lit(0.0)).alias("v"))
    return value.starters(weekly, "gi", "position", "v", "k", SLOTS, 12, FLEX)


@query("starter_allocation", f"with {STARTED} select k, gi, slot from st where slot is not null")
def starter_allocation(spark, sf_dir):
    return _started(spark, sf_dir).where("starter").select("k", "gi", "slot")


@query("baselines", f"with {STARTED} select distinct st.gi, st.position, round(coalesce(bs.repl, 0), 4) as replacement from st join bs on bs.gi = st.gi and bs.g = case when st.position in ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD') then 'flex' else st.position end")
def baselines(spark, sf_dir):
    return value.baselines(_started(spark, sf_dir), "gi", "position", "v", FLEX).select("gi", "position", r4("replacement").alias("replacement"))


VOR = f"""{STARTED}, vr as (select st.season, st.k, st.position, sum(v - coalesce(repl, 0)) as vor, sum(greatest(v - coalesce(repl, 0), 0)) as vp, sum(case when slot is not null then v - coalesce(repl, 0) else 0 end) as vas, count(*) as periods
      from st join bs on bs.gi = st.gi and bs.g = case when st.position in ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD') then 'flex' else st.position end group by st.season, st.k, st.position)"""


def _vor(spark, sf_dir):
    started = _started(spark, sf_dir)
    return value.over_replacement(started, value.baselines(started, "gi", "position", "v", FLEX), "gi", "position", "v", ["season", "k"])


@query("vor", f"with {VOR} select season, k, position, round(vor, 3) as vor, round(vp, 3) as vor_plus, round(vas, 3) as vas, periods from vr")
def vor(spark, sf_dir):
    return _vor(spark, sf_dir).select("season", "k", "position", *(r4(c, 3).alias(c) for c in ("vor", "vor_plus", "vas")), "periods")


@query("scarcity", f"with {VOR} select season, position, count(*) as n, round(max(vor), 3) as elite, count(*) filter (where vor > 0) as n_above, round(quantile_cont(vor, 0.5), 3) as median from vr group by season, position")
def scarcity(spark, sf_dir):
    counts = F.count("*").alias("n"), F.max("vor").alias("elite"), F.count_if(F.col("vor") > 0).alias("n_above")
    out = exact_quantiles(_vor(spark, sf_dir).select("season", "position", "vor"), ["season", "position"], "vor", [0.5], *counts)
    return out.select("season", "position", "n", r4("elite", 3).alias("elite"), "n_above", r4(F.col("q")[0], 3).alias("median"))


#: Weeks of a season that are its regular part, and how many flex slots there are.
REGULAR, FLEX_SLOTS = 9, 12


def _seated(source: str, out: str) -> str:
    """SQL of the starting set of `source` (gi, k, position, v), as `starters` chooses it."""
    own = " ".join(f"when '{p}' then {n}" for p, n in SLOTS.items())
    flex = ", ".join(f"'{p}'" for p in FLEX)
    return f"""
    {out}1 as (select *, v > 0 and row_number() over (partition by gi, position order by v desc, k) <= case position {own} else 0 end as own from {source}),
    {out}2 as (select *, not own and v > 0 and position in ({flex}) as may from {out}1),
    {out} as (select *, own or (may and row_number() over (partition by gi, may order by v desc, k) <= {FLEX_SLOTS}) as seated, case when position in ({flex}) then 'flex' else position end as g from {out}2)"""


#: Every player in every week of a season that they have a row in, with a value of 0 in weeks without one; players whose
#: number leaves 1 when divided by 4 are on no roster.
GRID = f"""
    gr as (select p.k, p.season, p.position, w.week, w.season * 100 + w.week as gi, coalesce(f.proj, 0) as v, f.k is not null as has_game, p.k % 4 <> 1 as rostered
        from (select distinct k, season, position from fx_proj) p join (select distinct season, week from fx_proj) w using (season) left join fx_proj f on f.k = p.k and f.season = p.season and f.week = w.week and f.position = p.position),
    {_seated("gr", "sa")},
    ro as (select gi, k, position, case when rostered then v else 0 end as v from gr),
    {_seated("ro", "sr")},
    bl as (select distinct gr.gi, gr.position, case when position in ({", ".join(f"'{p}'" for p in FLEX)}) then 'flex' else position end as g from gr),
    bs as (select bl.gi, bl.position, coalesce(s.v, 0) as s, coalesce(r.v, 0) as r, coalesce(w.v, 0) as w from bl
        left join (select gi, g, max(v) as v from sa where not seated group by gi, g) s on s.gi = bl.gi and s.g = bl.g
        left join (select sr.gi, sr.g, max(gr.v) as v from sr join gr on gr.gi = sr.gi and gr.k = sr.k and gr.position = sr.position where not gr.rostered group by sr.gi, sr.g) r on r.gi = bl.gi and r.g = bl.g
        left join (select gi, position, max(v) as v from gr where not rostered group by gi, position) w on w.gi = bl.gi and w.position = bl.position)"""


def _grid(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_proj").select("k", "season", "position", "week", F.coalesce("proj", F.lit(0.0)).alias("v"))
    weekly = value.with_byes(rows, ["k", "position"], "season", "week", "v").withColumn("gi", F.col("season") * 100 + F.col("week"))
    return weekly.withColumn("rostered", F.col("k") % 4 != 1)


def _levels(weekly):
    return value.weekly_levels(weekly, "gi", "position", "v", "k", "rostered", SLOTS, FLEX_SLOTS, FLEX)


@query("weekly_levels", f"with {GRID} select gi, position, round(s, 4) as marginal, round(r, 4) as waiver, round(w, 4) as streamer from bs")
def weekly_levels(spark, sf_dir):
    """Per week and position: the best value that doesn't start, the best on no roster in the position's exchange group,
    and the best on no roster at the position itself (the streamer)."""
    return _levels(_grid(spark, sf_dir)).select("gi", "position", *(r4(c).alias(c) for c in ("marginal", "waiver", "streamer")))


@query("player_values", f"""
    with {GRID}, pv as (select gr.*, bs.s, bs.r, v - bs.r as raw, greatest(v - bs.r, 0) as plus, v - bs.s as over_s, v > 0 and v >= bs.s as starts from gr join bs using (gi, position)),
    ag as (select season, k, position, sum(v) as points, count(*) filter (where has_game) as games, coalesce(sum(r) filter (where has_game), 0) as replacement, sum(plus) as vor, sum(raw) as vor_raw, sum(over_s) as vas, count(*) filter (where starts) as starter_weeks,
        coalesce(sum(v) filter (where week <= {REGULAR}), 0) as points_regular, coalesce(sum(plus) filter (where week <= {REGULAR}), 0) as vor_regular, coalesce(sum(v) filter (where week > {REGULAR}), 0) as points_final, coalesce(sum(plus) filter (where week > {REGULAR}), 0) as vor_final,
        string_agg(case when not has_game then week::varchar end, ',' order by week) as byes from pv group by season, k, position)
    select season, k, position, games, starter_weeks, coalesce(byes, '') as byes, {", ".join(f"round({c}, 3) as {c}" for c in ("points", "replacement", "vor", "vor_raw", "vas", "points_regular", "vor_regular", "points_final", "vor_final"))},
        row_number() over (partition by season order by round(vor, 3) desc, round(points, 3) desc, k, position) as overall_rank, row_number() over (partition by season, position order by round(vor, 3) desc, round(points, 3) desc, k) as position_rank from ag""")
def player_values(spark, sf_dir):
    """Value over replacement of each player for the season and its two parts, with weeks off, started weeks and ranks."""
    weekly = _grid(spark, sf_dir)
    sums = value.player_values(weekly, _levels(weekly), "gi", "position", "v", ["season", "k"], "week", {"regular": F.col("week") <= REGULAR, "final": F.col("week") > REGULAR})
    amounts = ("points", "replacement", "vor", "vor_raw", "vas", "points_regular", "vor_regular", "points_final", "vor_final")
    shown = sums.select("season", "k", "position", "games", "starter_weeks", "byes", *(r4(c, 3).alias(c) for c in amounts))
    return value.ranked(shown, "season", "position", [F.desc("vor"), F.desc("points"), F.col("k")])


@query("proportional_pool", f"""
    with {STARTED}, s as (select season, position, count(slot) / cast(sum(count(slot)) over (partition by season) as double) as share from st group by season, position),
    t as (select season, k, position, sum(v) as v, row_number() over (partition by season, position order by sum(v) desc, k) as r from st group by season, k, position)
    select t.season, t.k, t.position, t.r as rank from t join s using (season, position) where t.r <= round(s.share * 150)""")
def proportional_pool(spark, sf_dir):
    started = _started(spark, sf_dir)
    counts = started.groupBy("season", "position").agg(F.count("slot").alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy("season"))
    size = counts.select("season", "position", F.round(share * 150).alias("size"))
    totals = started.groupBy("season", "k", "position").agg(F.sum("v").alias("v"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("season", "position").orderBy(F.desc("v"), "k")).cast("long"))
    return ranked.join(size, ["season", "position"]).where("rank <= size").select("season", "k", "position", "rank")


#: Weeks in which players are valued, the first and last week that horizons are fitted from, rostered players of the
#: league (twice its starters), and the last seasons that no parameter is fitted on.
VALUE_WEEKS, FIT_WEEKS, ROSTERED, CHECK_SEASONS = [3, 6, 9], (3, 9), 2 * (sum(SLOTS.values()) + FLEX_SLOTS), 2
_CLASSES = sorted({*SLOTS, *FLEX})
_H = "case when t.week = p.w then 'h0' when t.week - p.w = 1 then 'h1' when t.week - p.w <= 3 then 'h2_3' when t.week - p.w <= 7 then 'h4_7' else 'h8p' end"
#: Horizons of players valued in a week, and the curves of their expected points (by bucket of the weeks between, with
#: one slope on the opponent for all buckets of a class), fitted on the development seasons.
BACKTEST_FIT = f"""
    pr as (select k, position, season, week, gi, team, proj, actual from fx_proj where position in ({", ".join(f"'{c}'" for c in _CLASSES)})),
    tg as (select distinct team, season, week, opponent from fx_schedule),
    ld as (select max(season) - {CHECK_SEASONS} as last_dev from pr),
    lv as (select p.k, p.position, p.season, p.week as w, p.team, p.proj, p.actual, p.season <= (select last_dev from ld) as dev,
        avg(p.proj) over (partition by p.k, p.position, p.season order by p.week rows between 3 preceding and current row) as lvl from pr p where p.proj > 0),
    wk as (select unnest(range({FIT_WEEKS[0]}, {FIT_WEEKS[1] + 1})) as w),
    gm as (select t.season, wk.w, t.opponent as defense, count(*) filter (where t.week < wk.w) as games from (select distinct season, week, opponent from tg) t cross join wk group by t.season, wk.w, t.opponent),
    al as (select pr.season, wk.w, pr.position, tg.opponent as defense, sum(pr.actual) as allowed from pr join tg on tg.season = pr.season and tg.week = pr.week and tg.team = pr.team join wk on pr.week < wk.w group by pr.season, wk.w, pr.position, tg.opponent),
    gp as (select gm.*, ps.position, coalesce(al.allowed, 0) as allowed from gm cross join (select distinct position from pr) ps left join al on al.season = gm.season and al.w = gm.w and al.defense = gm.defense and al.position = ps.position),
    gl as (select *, sum(allowed) over (partition by season, w, position) / greatest(sum(games) over (partition by season, w, position), 1) as mean from gp),
    op as (select season, w, position, defense, case when mean > 0 then (allowed + 4 * mean) / (games + 4) / mean else 1.0::double end as opp from gl),
    fu as (select p.season, p.w, t.week, p.k, p.position, p.dev, p.proj, p.lvl, p.lvl * (coalesce(op.opp, 1) - 1) as u, coalesce(a.actual, 0) as y, {_H} as bucket
      from lv p semi join tg n on n.season = p.season and n.team = p.team and n.week = p.w join tg t on t.season = p.season and t.team = p.team and t.week >= p.w
      left join op on op.season = p.season and op.w = p.w and op.position = p.position and op.defense = t.opponent
      left join pr a on a.k = p.k and a.position = p.position and a.season = p.season and a.week = t.week where p.w between {FIT_WEEKS[0]} and {FIT_WEEKS[1]}),
    c1 as (select position, bucket, count(*) as n, avg(x) as mx, avg(z) as mz, avg(u) as mu, avg(y) as my, var_pop(x) as xx, var_pop(z) as zz, var_pop(u) as uu, covar_pop(x, z) as xz, covar_pop(x, u) as xu, covar_pop(x, y) as xy,
        covar_pop(z, u) as zu, covar_pop(z, y) as zy, covar_pop(u, y) as uy from (select position, bucket, lvl as x, lvl * lvl as z, u, y from fu where dev and bucket <> 'h0') group by position, bucket),
    c2 as (select *, case when n >= 20 and xx * zz - xz * xz > 1e-9::double * xx * zz then xx * zz - xz * xz end as d from c1),
    c3 as (select *, coalesce((xu * zz - zu * xz) / d, 0) as p, coalesce((zu * xx - xu * xz) / d, 0) as q from c2),
    c4 as (select *, sum(n * (uu - p * xu - q * zu)) over o as ru, sum(n * (uy - p * xy - q * zy)) over o as ry, sum(n * uu) over o as whole from c3 window o as (partition by position)),
    c5 as (select *, case when ru > 1e-9::double * whole then ry / ru else 0 end as g from c4),
    c6 as (select *, coalesce(((xy - g * xu) * zz - (zy - g * zu) * xz) / d, 0) as b, coalesce(((zy - g * zu) * xx - (xy - g * xu) * xz) / d, 0) as c from c5),
    c0 as (select position, 'h0' as bucket, coalesce(regr_intercept(actual, proj), avg(actual)) as a, coalesce(regr_slope(actual, proj), 0) as b, 0.0::double as c, 0.0::double as g
      from lv semi join tg n on n.season = lv.season and n.team = lv.team and n.week = lv.w where dev group by position),
    co as (select position, bucket, round(a, 6 ) as a, round(b, 6 ) as b, round(c, 9) as c, round(g, 6 ) as g from (select * from c0 union all select position, bucket, my - g * mu - b * mx - c * mz, b, c, g from c6)),
    wv as (select fu.season, fu.w, fu.week, fu.season * 10000 + fu.w * 100 + fu.week as gi, fu.k, fu.position, y, greatest(a + b * (case when fu.bucket = 'h0' then proj else lvl end) + c * (case when fu.bucket = 'h0' then proj else lvl end) * (case when fu.bucket = 'h0' then proj else lvl end) + g * u, 0) as v
      from fu left join co on co.position = fu.position and co.bucket = fu.bucket where fu.w in ({", ".join(map(str, VALUE_WEEKS))}))"""

#: The rostered of each season and week, levels (what may take the place of a leaving starter, or the price of entry) and
#: what the three best free players came to, then projected and realized value over replacement.
BACKTEST = f"""{BACKTEST_FIT}, {_seated("wv", "sa").strip()},
    nr as (select season, w, position, round(count(*) / cast(sum(count(*)) over (partition by season, w) as double) * {ROSTERED}) as size from sa where seated group by season, w, position),
    tt as (select season, w, position, k, round(sum(v), 6 ) as v from wv group by season, w, position, k),
    po as (select tt.season, tt.w, tt.position, tt.k from (select *, row_number() over (partition by season, w, position order by v desc, k) as r from tt) tt join nr on nr.season = tt.season and nr.w = tt.w and nr.position = tt.position where r <= size),
    wr as (select wv.*, po.k is not null as rostered from wv left join po on po.season = wv.season and po.w = wv.w and po.position = wv.position and po.k = wv.k),
    rw as (select gi, k, position, v from wr where rostered), {_seated("rw", "sr").strip()},
    cl(position, size, flexes) as (values {", ".join(f"('{c}', {SLOTS.get(c, 0)}, {str(c in FLEX).lower()})" for c in _CLASSES)}),
    sc as (select gi, position, count(*) as n, min(v) as least from sr where seated group by gi, position),
    cn as (select e.gi, cl.*, coalesce(sc.n, 0) as n, sc.least from (select distinct gi from wv) e cross join cl left join sc on sc.gi = e.gi and sc.position = cl.position),
    cv as (select *, sum(case when flexes then greatest(n - size, 0) else 0 end) over (partition by gi) as over_size from cn),
    ex as (select a.gi, a.position as p, b.position as q, a.least, b.n as in_n from cv a join cv b on a.gi = b.gi where a.n > 0 and
        (a.position = b.position or case when b.flexes then a.over_size - (case when a.flexes and a.n > a.size then 1 else 0 end) + (case when b.n >= b.size then 1 else 0 end) <= {FLEX_SLOTS} else b.n < b.size end)),
    fr as (select gi, position, k, v, y from wr where not rostered),
    cm as (select gi, p, q, true as whole from ex union all select gi, position, position, false from cv where n = 0),
    cr as (select cm.gi, cm.p, cm.whole, fr.v, fr.y, row_number() over (partition by cm.gi, cm.p order by fr.v desc, fr.k) as r from cm join fr on fr.gi = cm.gi and fr.position = cm.q),
    fo as (select gi, p, max(v) filter (where whole) as best, avg(y) as mean from cr where r <= 3 group by gi, p),
    en as (select gi, q, min(least) as entry from ex where in_n = 0 group by gi, q),
    le as (select cv.gi, cv.position, case when cv.n > 0 then greatest(fo.best, 0) else coalesce(en.entry, 0) end as level, coalesce(fo.mean, 0) as realized from cv left join fo on fo.gi = cv.gi and fo.p = cv.position left join en on en.gi = cv.gi and en.q = cv.position),
    va as (select case when season <= (select last_dev from ld) then 'dev' else 'check' end as split, season, w, wr.position, k, rostered, round(sum(greatest(v - level, 0)), 6 ) as vor, round(sum(case when v > level then y - realized else 0 end), 6 ) as realized
      from wr join le on le.gi = wr.gi and le.position = wr.position group by season, w, wr.position, k, rostered)"""

_WEEK, _OWN = "split, season, w", "split, season, w, position"
_CALIBRATION = "count(*) as n, avg(vor) as projected, avg(realized) as actual, sum(realized) / nullif(sum(vor), 0) as ratio, regr_slope(realized, vor) as slope"


@query("vor_backtest", f"""
    with {BACKTEST},
    rk as (select *, row_number() over (partition by {_OWN} order by vor desc, k) as r, count(*) filter (where rostered) over (partition by {_OWN}) as held, row_number() over (partition by {_WEEK} order by vor desc, k, position) as first_p, row_number() over (partition by {_WEEK} order by realized desc, k, position) as first_a from va),
    rh as (select {_OWN}, rank() over (partition by {_OWN} order by vor) + (count(*) over (partition by {_OWN}, vor) - 1) / 2.0::double as p, rank() over (partition by {_OWN} order by realized) + (count(*) over (partition by {_OWN}, realized) - 1) / 2.0::double as q from va where rostered),
    rr as (select {_OWN}, case when stddev_pop(p) > 0 and stddev_pop(q) > 0 then corr(p, q) end as spearman from rh group by {_OWN}),
    tp as (select {_OWN}, count(*) filter (where first_p <= 30) as top_projected, count(*) filter (where first_a <= 30) as top_actual from rk group by {_OWN}),
    cw as (select {_OWN}, {_CALIBRATION} from rk where r <= held group by {_OWN}),
    by_week as (select {_OWN}, coalesce(n, 0) as n, projected, actual, ratio, slope, spearman, top_projected, top_actual from tp left join cw using ({_OWN}) left join rr using ({_OWN})),
    nw as (select split, count(distinct season * 100 + w) as weeks from by_week group by split),
    ms as (select split, position, avg(spearman) as spearman, sum(top_projected) / any_value(weeks) as top_projected, sum(top_actual) / any_value(weeks) as top_actual from by_week join nw using (split) group by split, position),
    cs as (select split, position, {_CALIBRATION} from rk where r <= held group by split, position),
    pl as (select split, sum(realized) / nullif(sum(vor), 0) as pooled_ratio from rk where r <= held group by split),
    u as (select *, null::double as pooled_ratio, null::boolean as biased from by_week union all
      select split, null, null, position, coalesce(n, 0), projected, actual, ratio, slope, spearman, top_projected, top_actual, pooled_ratio, abs(ratio / nullif(pooled_ratio, 0) - 1) > 0.25 from ms left join cs using (split, position) left join pl using (split))
    select split, season, w, position, n, {", ".join(f"round({c}, 4) as {c}" for c in ("projected", "actual", "ratio", "slope", "spearman", "top_projected", "top_actual", "pooled_ratio"))}, biased from u""")
def vor_backtest(spark, sf_dir):
    """Players valued in some weeks of each season as a live run would have, from their projections so far and curves of the
    development seasons, against what came of it: value over replacement in weeks projected above it, by what the best
    free players scored. Rows for each season, week and class, and for each split and class (season and w null)."""
    rows = view(spark, sf_dir, "fx_proj").where(F.col("position").isin(*_CLASSES)).select("k", "position", "season", "week", "team", "proj", "actual")
    last = rows.agg(F.max("season")).first()[0]
    dev = F.lit(False) if last is None else F.col("season") <= last - CHECK_SEASONS
    weekly = backtest.weekly_values(rows, view(spark, sf_dir, "fx_schedule").select("season", "week", "team", "opponent"), dev, FIT_WEEKS, VALUE_WEEKS)
    players = backtest.valued(weekly, (SLOTS, FLEX_SLOTS, FLEX), ROSTERED)
    out = backtest.summaries(players, dev, ROSTERED)
    shown = ("projected", "actual", "ratio", "slope", "spearman", "top_projected", "top_actual", "pooled_ratio")
    return out.select("split", "season", "w", "position", "n", *(r4(c).alias(c) for c in shown), "biased")


@query("buy_sell", """
    with s as (select season, k, sum(actual) / nullif(sum(proj), 0) as ratio, count(*) as n from fx_proj where proj is not null group by season, k having count(*) >= 2)
    select season, k, round(ratio, 4) as ratio, case when ratio >= 1.02 then 'buy' when ratio <= 0.9 then 'sell' else 'hold' end as signal from s""")
def buy_sell(spark, sf_dir):
    sums = view(spark, sf_dir, "fx_proj").where("proj is not null").groupBy("season", "k").agg(
        (F.sum("actual") / F.nullif(F.sum("proj"), F.lit(0.0))).alias("ratio"), F.count("*").alias("n")
    ).where("n >= 2")
    return sums.select("season", "k", r4("ratio").alias("ratio"), F.when(F.col("ratio") >= 1.02, "buy").when(F.col("ratio") <= 0.9, "sell").otherwise("hold").alias("signal"))
