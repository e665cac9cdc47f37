"""Queries of checks, joins, aggregations, ranking, set operations, scoring and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitstats.functions import scalars as fn
from pitstats.operators import checks, dedup, features, joins, scoring
from pitstats.operators.quantiles import exact_quantiles
from pitstats.plans.registry import query
from pitstats.sources import documents as docs
from pitstats.sources.fixtures import rounded, view


def r4(column):
    return rounded(F.col(column) if isinstance(column, str) else column, 4)


# --- scans ---------------------------------------------------------------------------------------------------------


@query("scan_pruned", "select season, team, count(*) as n, cast(sum(yards) as bigint) as yards from fx_plays where season in (1996, 1997) and team < 10 group by season, team")
def scan_pruned(spark, sf_dir):
    orders = view(spark, sf_dir, "orders").where("o_orderdate >= date '1996-01-01' and o_orderdate < date '1998-01-01'").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = view(spark, sf_dir, "customer").where("c_nationkey < 10").select("c_custkey", F.col("c_nationkey").cast("long").alias("team"))
    lines = view(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.year("o_orderdate").cast("long").alias("season"), "team").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("yards")
    )


@query("union_by_name", """
    select k, gi, cast(null as varchar) as status, pts from fx_games
    union all select k, null, status, null from fx_reports""")
def union_by_name(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games").select("k", "gi", "pts")
    return games.unionByName(view(spark, sf_dir, "fx_reports").select("k", "status"), allowMissingColumns=True)


@query("scan_parquet", "select season, count(*) as n, cast(sum(receptions) as bigint) as receptions, count(case when season >= 1998 then snap_share end) as n_shares from fx_games group by season")
def scan_parquet(spark, sf_dir):
    """Files of several folders whose columns differ, bound by name: a column that a folder lacks is null."""
    games = view(spark, sf_dir, "fx_games").select("k", "gi", "season", "receptions", "snap_share")
    base = docs.scratch(spark, "many")
    parts = [games.where("season < 1998").drop("snap_share"), games.where("season >= 1998").select("snap_share", "receptions", "season", "gi", "k")]
    paths = [f"{base}/{i}" for i in range(len(parts))]
    for part, path in zip(parts, paths):
        docs.write_once(part, path)
    return docs.read_many(spark, paths).groupBy("season").agg(F.count("*").alias("n"), F.sum("receptions").alias("receptions"), F.count("snap_share").alias("n_shares"))


@query("scan_union_by_name", "select team, count(*) as n, round(sum(disc - tax), 2) as margin from fx_plays where play_type <> 'R' and season >= 1996 group by team")
def scan_union_by_name(spark, sf_dir):
    """A view over all seasons' event files with one filter, queried as SQL."""
    base = docs.scratch(spark, "events")
    docs.write_once(view(spark, sf_dir, "fx_plays").drop("leader"), base, ["season"])
    name = docs.union_view(spark, [base], "play_type <> 'R' and season >= 1996")
    return spark.sql(f"select cast(team as bigint) as team, count(*) as n, round(sum(disc - tax), 2) as margin from {name} group by team")


# --- checks --------------------------------------------------------------------------------------------------------


@query("assert_unique_key", "select b_id, source, count(*) as n from fx_ids group by b_id, source having count(*) > 1")
def assert_unique_key(spark, sf_dir):
    checks.assert_unique_key(view(spark, sf_dir, "fx_games"), ["k", "gi"], "games")
    return checks.duplicated_keys(view(spark, sf_dir, "fx_ids"), ["b_id", "source"])


@query("column_rules", """
    select 'snap_share present' as rule, count(*) filter (where snap_share is null) as n_broken from fx_games
    union all select 'pts in range', count(*) filter (where not (pts >= 0 and pts <= 100)) from fx_games
    union all select 'position allowed', count(*) filter (where position not in ('BUILDING', 'MACHINERY')) from fx_games""")
def column_rules(spark, sf_dir):
    rules = checks.not_missing(["snap_share"]) | checks.in_range("pts", 0, 100) | checks.values_in("position", ["BUILDING", "MACHINERY"])
    return checks.violations(view(spark, sf_dir, "fx_games"), rules)


@query("missingness", """
    with n as (select count(*) as n from fx_proj)
    select c.col as "column", n.n, c.m as n_missing, 100.0::double * c.m / n.n as pct_missing from n, (
      select 'k' as col, count(*) filter (where k is null) as m from fx_proj
      union all select 'gi', count(*) filter (where gi is null) from fx_proj
      union all select 'proj', count(*) filter (where proj is null) from fx_proj
      union all select 'actual', count(*) filter (where actual is null) from fx_proj) c""")
def missingness(spark, sf_dir):
    return checks.missingness(view(spark, sf_dir, "fx_proj").select("k", "gi", "proj", "actual"))


@query("audit_counts", """
    select season, position, count(*) as n, count(*) filter (where proj is null) as n_no_proj,
        count(distinct k) as n_players from fx_proj group by season, position""")
def audit_counts(spark, sf_dir):
    return view(spark, sf_dir, "fx_proj").groupBy("season", "position").agg(
        F.count("*").alias("n"), F.count_if(F.col("proj").isNull()).alias("n_no_proj"), F.count_distinct("k").alias("n_players")
    )


@query("coverage_status", """
    select day, count(*) filter (where s = 'valid') as valid, count(*) filter (where s = 'after cutoff') as late,
        count(*) filter (where s = 'no game') as no_game
    from (select day, case when status = 'Note' then 'no game' when ts >= cutoff then 'after cutoff' else 'valid' end as s from fx_reports)
    group by day""")
def coverage_status(spark, sf_dir):
    reports = view(spark, sf_dir, "fx_reports")
    status = F.when(F.col("status") == "Note", "no game").when(F.col("ts") >= F.col("cutoff"), "after cutoff").otherwise("valid")
    wide = reports.withColumn("s", status).groupBy("day").pivot("s", ["valid", "after cutoff", "no game"]).count()
    return wide.select("day", *(F.coalesce(f"`{a}`", F.lit(0)).alias(b) for a, b in (("valid", "valid"), ("after cutoff", "late"), ("no game", "no_game"))))


@query("cross_source_check", """
    select g.season, count(*) as n, round(avg(case when abs(g.xfp - g.yards) < 0.5 * g.xfp then 1.0 else 0.0 end), 6) as share
    from fx_games g group by g.season""")
def cross_source_check(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games")
    near = (F.abs(F.col("xfp") - F.col("yards")) < 0.5 * F.col("xfp")).cast("double")
    return games.groupBy("season").agg(F.count("*").alias("n"), rounded(F.avg(near), 6).alias("share"))


@query("reproduction_check", """
    with a as (select k, gi, targets, receptions from fx_games where week <= 6),
    b as (select k, gi, case when k % 40 = 0 then targets + 1 else targets end as targets, receptions from fx_games where week >= 3),
    j as (select a.k as ak, b.k as bk, a.targets as t1, b.targets as t2, a.receptions as r1, b.receptions as r2 from a full join b on a.k = b.k and a.gi = b.gi),
    n as (select count(*) filter (where ak is not null and bk is not null) as n_both, count(*) filter (where bk is null) as l,
      count(*) filter (where ak is null) as r, count(*) filter (where ak is not null and bk is not null and t1 <> t2) as t,
      count(*) filter (where ak is not null and bk is not null and r1 <> r2) as rc from j)
    select n_both, 'only_left' as "column", l as n_different from n union all select n_both, 'only_right', r from n
    union all select n_both, 'targets', t from n union all select n_both, 'receptions', rc from n""")
def reproduction_check(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games").select("k", "gi", "week", "targets", "receptions")
    other = games.where("week >= 3").withColumn("targets", F.col("targets") + F.when(F.col("k") % 40 == 0, 1).otherwise(0))
    return checks.compare_tables(games.where("week <= 6"), other, ["k", "gi"], ["targets", "receptions"])


@query("projection_contract", """
    with p as (select k, gi, season, position, case when k % 17 = 1 then null else proj end as proj_raw, k % 29 <> 0 as has_game, case when k % 23 = 0 then 1.2::double when c2 >= 4 then 1.0::double else 0.5::double end as p_active,
        coalesce(proj, 0) * case when k % 13 = 0 then 1.1::double else 1.0::double end as lvl, coalesce(proj, 0) * case when k % 23 = 0 then 1.2::double when c2 >= 4 then 1.0::double else 0.5::double end as proj, case when gi % 7 = 0 then 'guess' else 'current' end as kind from fx_proj)
    select 'unique key' as rule, count(*) - count(distinct (k, gi)) as n_broken from p
    union all select 'present: k', 0 from (select 1) union all select 'present: gi', 0 from (select 1) union all select 'present: position', 0 from (select 1) union all select 'present: proj', count(*) filter (where proj is null) from p
    union all select 'kind allowed', count(*) filter (where kind <> 'current') from p union all select 'proj in range', count(*) filter (where proj < 0 or proj > 400) from p
    union all select 'p_active in range', count(*) filter (where p_active > 1) from p union all select 'no game, no projection', count(*) filter (where not has_game and proj <> 0) from p
    union all select 'proj = p_active * lvl', count(*) filter (where abs(proj - p_active * lvl) > 0.000001) from p""")
def projection_contract(spark, sf_dir):
    """The weekly projection table with planted faults, counted rule by rule."""
    k = F.col("k")
    p = F.when(k % 23 == 0, 1.2).when(F.col("c2") >= 4, 1.0).otherwise(0.5)
    proj = F.coalesce("proj", F.lit(0.0))
    table = view(spark, sf_dir, "fx_proj").select(
        "k", "gi", "position", (k % 29 != 0).alias("has_game"), p.alias("p_active"), (proj * F.when(k % 13 == 0, 1.1).otherwise(1.0)).alias("lvl"), (proj * p).alias("proj"),
        F.when(F.col("gi") % 7 == 0, "guess").otherwise("current").alias("kind"),
    )
    return checks.projection_violations(table, ["k", "gi"], ["position"], ["current"], 400.0)


@query("state_checks", """
    with sides as (select period, home as team, case winner when 'HOME' then 1 else 0 end as w, case winner when 'AWAY' then 1 else 0 end as l, case winner when 'TIE' then 1 else 0 end as t, home_points as pf from fx_matchups
      union all select period, away, case winner when 'AWAY' then 1 else 0 end, case winner when 'HOME' then 1 else 0 end, case winner when 'TIE' then 1 else 0 end, away_points from fx_matchups),
    rec as (select team, cast(sum(w) as bigint) as wins, cast(sum(l) as bigint) as losses, cast(sum(t) as bigint) as ties, round(sum(pf), 2) as points_for from sides group by team)
    select team, wins, losses, ties, points_for, row_number() over (order by wins desc, points_for desc, team) as seed from rec""")
def state_checks(spark, sf_dir):
    def side(team, points, won, lost):
        flag = lambda v: (F.col("winner") == v).cast("long")
        return F.struct(F.col(team).alias("team"), flag(won).alias("w"), flag(lost).alias("l"), flag("TIE").alias("t"), F.col(points).alias("pf"))

    sides = view(spark, sf_dir, "fx_matchups").select(
        F.explode(F.array(side("home", "home_points", "HOME", "AWAY"), side("away", "away_points", "AWAY", "HOME"))).alias("s")
    ).select("s.*")
    records = sides.groupBy("team").agg(
        F.sum("w").alias("wins"), F.sum("l").alias("losses"), F.sum("t").alias("ties"), F.round(F.sum("pf"), 2).alias("points_for")
    )
    # one row per team: a league is small by definition
    seed = F.row_number().over(Window.orderBy(F.desc("wins"), F.desc("points_for"), "team"))
    return records.withColumn("seed", seed.cast("long"))


@query("id_diagnostics", """
    select 'unmatched' as kind, count(*) as n from customer c where not exists (select 1 from fx_ids i where i.source = 'a' and i.b_id = c.c_custkey)
    union all select 'duplicated', count(*) from (select b_id from fx_ids where source = 'a' group by b_id having count(*) > 1)""")
def id_diagnostics(spark, sf_dir):
    ids = view(spark, sf_dir, "fx_ids").where("source = 'a'")
    missing = view(spark, sf_dir, "customer").join(ids, F.col("c_custkey") == F.col("b_id"), "left_anti")
    return missing.agg(F.count("*").alias("n")).select(F.lit("unmatched").alias("kind"), "n").unionByName(
        checks.duplicated_keys(ids, ["b_id"]).agg(F.count("*").alias("n")).select(F.lit("duplicated").alias("kind"), "n")
    )


@query("team_map_check", """
    select team, count(*) as n, round(avg(case when opponent % 5 = team % 5 then 1.0 else 0.0 end), 6) as agreement from fx_schedule
    group by team having count(*) >= 3""")
def team_map_check(spark, sf_dir):
    agree = (F.col("opponent") % 5 == F.col("team") % 5).cast("double")
    return view(spark, sf_dir, "fx_schedule").groupBy("team").agg(F.count("*").alias("n"), rounded(F.avg(agree), 6).alias("agreement")).where("n >= 3")


# --- joins ---------------------------------------------------------------------------------------------------------


@query("safe_left_join", """
    select t.k, t.gi, g.pts, g.k is not null as matched from fx_targets t left join fx_games g on t.k = g.k and t.gi = g.gi""")
def safe_left_join(spark, sf_dir):
    targets = view(spark, sf_dir, "fx_targets").select("k", "gi")
    return joins.safe_left_join(targets, view(spark, sf_dir, "fx_games").select("k", "gi", "pts"), ["k", "gi"])


@query("inner_equi", "select g.position, count(*) as n, count(distinct i.b_id) as n_ids from fx_games g join fx_ids i on g.k = i.a_id where i.source = 'a' group by g.position")
def inner_equi(spark, sf_dir):
    ids = view(spark, sf_dir, "fx_ids").where("source = 'a'").select("a_id", "b_id")
    joined = view(spark, sf_dir, "fx_games").select("k", "position").join(ids, F.col("k") == F.col("a_id"))
    return joined.groupBy("position").agg(F.count("*").alias("n"), F.count_distinct("b_id").alias("n_ids"))


@query("full_outer", """
    select coalesce(p.k, a.k) as k, coalesce(p.gi, a.gi) as gi, coalesce(p.position, a.position) as position, p.proj, a.actual
    from (select * from fx_proj where week <= 8) p full join (select * from fx_proj where week >= 4) a on p.k = a.k and p.gi = a.gi""")
def full_outer(spark, sf_dir):
    base = view(spark, sf_dir, "fx_proj")
    proj = base.where("week <= 8").select("k", "gi", F.col("position").alias("p1"), "proj")
    actual = base.where("week >= 4").select("k", "gi", F.col("position").alias("p2"), "actual")
    return proj.join(actual, ["k", "gi"], "full").select("k", "gi", F.coalesce("p1", "p2").alias("position"), "proj", "actual")


@query("semi_anti", """
    select 'semi' as kind, count(*) as n from fx_games g where exists (select 1 from fx_reports r where r.k = g.k and r.status = 'Out')
    union all select 'anti', count(*) from fx_games g where not exists (select 1 from fx_reports r where r.k = g.k and r.status = 'Out')""")
def semi_anti(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games").select("k")
    out = view(spark, sf_dir, "fx_reports").where("status = 'Out'").select("k")
    return games.join(out, "k", "left_semi").agg(F.count("*").alias("n")).select(F.lit("semi").alias("kind"), "n").unionByName(
        games.join(out, "k", "left_anti").agg(F.count("*").alias("n")).select(F.lit("anti").alias("kind"), "n")
    )


@query("cross_grid", "select n.n_name, w.w as week, t.t as slot from nation n, range(1, 18) w(w), range(3) t(t)")
def cross_grid(spark, sf_dir):
    return view(spark, sf_dir, "nation").select("n_name", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(17).cast("long"))).alias("week")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("slot")
    )


@query("id_crosswalk", r"""
    with cand as (select a_id, b_id, min(name) as name from fx_ids where b_id is not null group by a_id, b_id),
    named as (select c.a_id, c.b_id, coalesce(regexp_replace(regexp_replace(lower(c.name), '[^a-z0-9 ]', '', 'g'), '( jr)+$', '') =
        regexp_replace(regexp_replace(lower(k.c_name), '[^a-z0-9 ]', '', 'g'), '( jr)+$', ''), false) as same
        from cand c left join customer k on k.c_custkey = c.b_id),
    per as (select a_id, count(*) as n, min(b_id) as only_id, count(*) filter (where same) as ns, min(b_id) filter (where same) as by_name from named group by a_id),
    dec as (select a_id, case when n = 1 then only_id when ns = 1 then by_name end as b_id,
        case when n = 1 then 'unanimous' when ns = 1 then 'name' else 'conflict' end as method from per),
    used as (select b_id as u, count(*) as c from dec where b_id is not null group by b_id)
    select a_id, case when coalesce(c, 1) = 1 then b_id end as b_id, case when coalesce(c, 1) > 1 then 'ambiguous' else method end as method
    from dec left join used on u = b_id""")
def id_crosswalk(spark, sf_dir):
    names = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("b_id"), F.col("c_name").alias("name"))
    return joins.id_crosswalk(view(spark, sf_dir, "fx_ids"), names, fn.name_normalise)


@query("provider_cascade", """
    select t.k, t.gi, coalesce(p.v, g.v, 0.0) as v, case when p.v is not null then 'proj' when g.v is not null then 'games' else 'none' end as provider
    from fx_targets t
    left join (select k, gi, proj as v from fx_proj where proj is not null and position in ('BUILDING', 'AUTOMOBILE')) p on p.k = t.k and p.gi = t.gi
    left join (select k, gi, pts as v from fx_games) g on g.k = t.k and g.gi = t.gi""")
def provider_cascade(spark, sf_dir):
    named = lambda df, v, name: df.select("k", "gi", F.col(v).alias("v"), F.lit(name).alias("provider"))
    targets = view(spark, sf_dir, "fx_targets").select("k", "gi")
    proj = view(spark, sf_dir, "fx_proj").where("proj is not null").where(F.col("position").isin("BUILDING", "AUTOMOBILE"))
    wanted = lambda df: df.join(targets, ["k", "gi"], "left_semi")
    return joins.cascade(
        [wanted(named(proj, "proj", "proj")), wanted(named(view(spark, sf_dir, "fx_games"), "pts", "games"))], ["k", "gi"],
        targets.select("k", "gi", F.lit(0.0).alias("v"), F.lit("none").alias("provider")),
    )


@query("universe_union", """
    with u as (select k from fx_games union select k from fx_reports union select a_id from fx_ids where source = 'c')
    select u.k, c.c_name as name, coalesce(g.n, 0) as n_games from u left join customer c on c.c_custkey = u.k
    left join (select k, count(*) as n from fx_games group by k) g on g.k = u.k""")
def universe_union(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games")
    keys = games.select("k").union(view(spark, sf_dir, "fx_reports").select("k")).union(
        view(spark, sf_dir, "fx_ids").where("source = 'c'").select("a_id")
    ).distinct()
    names = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return keys.join(names, "k", "left").join(games.groupBy("k").agg(F.count("*").alias("n")), "k", "left").select(
        "k", "name", F.coalesce("n", F.lit(0)).alias("n_games")
    )


@query("horizon_expand", """
    select g.season, g.week, count(*) as n_rows, cast(sum(t.week - g.week) as bigint) as weeks from fx_games g
    join (select distinct team, season, week from fx_schedule) t on t.team = g.team and t.season = g.season and t.week > g.week
    group by g.season, g.week""")
def horizon_expand(spark, sf_dir):
    schedule = view(spark, sf_dir, "fx_schedule").select("team", "season", "week").distinct()
    games = view(spark, sf_dir, "fx_games").select("k", "team", "season", "week")
    return joins.horizon_expand(games, schedule, ["team", "season"], "week").groupBy("season", "week").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("target") - F.col("week")).alias("weeks")
    )


@query("self_lead_pairs", """
    select season, count(*) as n, count(*) filter (where nw = week + 1) as consecutive from (
      select season, week, lead(week) over (partition by k, season order by week) as nw from fx_games) where nw is not null group by season""")
def self_lead_pairs(spark, sf_dir):
    pairs = joins.pair_with_next(view(spark, sf_dir, "fx_games").select("k", "season", "week"), ["k", "season"], "week", [])
    return pairs.groupBy("season").agg(F.count("*").alias("n"), F.count_if(F.col("next_week") == F.col("week") + 1).alias("consecutive"))


@query("population_pair", """
    with listed as (select distinct k from fx_reports), act as (select distinct k from fx_games where season = 1997)
    select 'listed' as population, count(*) as n, count(a.k) as n_active from listed l left join act a on a.k = l.k
    union all select 'unlisted', count(*), count(a2.k) from (select distinct k from fx_games where season = 1996 and k not in (select k from listed)) u left join act a2 on a2.k = u.k""")
def population_pair(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games")
    listed = view(spark, sf_dir, "fx_reports").select("k").distinct()
    active = games.where("season = 1997").select("k").distinct().withColumn("a", F.lit(1))
    unlisted = games.where("season = 1996").select("k").distinct().join(listed, "k", "left_anti")
    both = listed.withColumn("population", F.lit("listed")).unionByName(unlisted.withColumn("population", F.lit("unlisted")))
    return both.join(active, "k", "left").groupBy("population").agg(F.count("*").alias("n"), F.count("a").alias("n_active"))


# --- aggregations --------------------------------------------------------------------------------------------------


@query("event_rollup", """
    select season, week, team, count(*) filter (where play_type = 'R') as n_returns, count(*) filter (where yards >= 40 and result = 'F') as n_long,
        cast(sum(case when ln = 1 then yards else 0 end) as bigint) as first_yards from fx_plays group by season, week, team""")
def event_rollup(spark, sf_dir):
    return view(spark, sf_dir, "fx_plays").groupBy("season", "week", "team").agg(
        F.count_if(F.col("play_type") == "R").alias("n_returns"), F.count_if((F.col("yards") >= 40) & (F.col("result") == "F")).alias("n_long"),
        F.sum(F.when(F.col("ln") == 1, F.col("yards")).otherwise(0)).alias("first_yards"),
    )


@query("conditional_avg", """
    select team, gi, count(*) as plays, round(cast(sum(case when play_type = 'N' then disc - tax end) as double) / count(case when play_type = 'N' then 1 end), 6) as epa_n,
        round(cast(sum(case when ln <= 2 then yards end) as double) / nullif(count(case when ln <= 2 then 1 end), 0), 6) as early_yards
    from fx_plays group by team, gi having count(case when play_type = 'N' then 1 end) > 0""")
def conditional_avg(spark, sf_dir):
    n = F.col("play_type") == "N"
    return view(spark, sf_dir, "fx_plays").groupBy("team", "gi").agg(
        F.count("*").alias("plays"), rounded(F.avg(F.when(n, F.col("disc") - F.col("tax"))), 6).alias("epa_n"),
        rounded(F.avg(F.when(F.col("ln") <= 2, F.col("yards"))), 6).alias("early_yards"), F.count_if(n).alias("_n"),
    ).where("_n > 0").drop("_n")


@query("group_leader", """
    with s as (select team, gi, leader, count(*) as n, cast(sum(yards) as bigint) as yards from fx_plays group by team, gi, leader)
    select *, row_number() over (partition by team, gi order by n desc, yards desc, leader) = 1 as is_leader from s""")
def group_leader(spark, sf_dir):
    sums = view(spark, sf_dir, "fx_plays").groupBy("team", "gi", "leader").agg(F.count("*").alias("n"), F.sum("yards").alias("yards"))
    w = Window.partitionBy("team", "gi").orderBy(F.desc("n"), F.desc("yards"), "leader")
    return sums.withColumn("is_leader", F.row_number().over(w) == 1)


@query("side_stats", """
    select s.team, s.gi, coalesce(a.r, 0) as returns_for, coalesce(b.r, 0) as returns_against, coalesce(a.y, 0) as yards_for, coalesce(b.y, 0) as yards_against
    from fx_schedule s
    left join (select team, gi, cast(sum(case when play_type = 'R' then 1 else 0 end) as bigint) as r, cast(sum(yards) as bigint) as y from fx_plays group by team, gi) a on a.team = s.team and a.gi = s.gi
    left join (select (team + gi) % 25 as team, gi, cast(sum(case when play_type = 'R' then 1 else 0 end) as bigint) as r, cast(sum(yards) as bigint) as y from fx_plays group by (team + gi) % 25, gi) b on b.team = s.team and b.gi = s.gi""")
def side_stats(spark, sf_dir):
    """One explode attributes each play to both sides; one pivot sums all metrics."""

    def entry(team, metric, value):
        return F.struct(team.alias("team"), F.lit(metric).alias("metric"), value.alias("value"))

    own, other = F.col("team"), (F.col("team") + F.col("gi")) % 25
    returned = (F.col("play_type") == "R").cast("long")
    entries = F.array(
        entry(own, "returns_for", returned), entry(other, "returns_against", returned),
        entry(own, "yards_for", F.col("yards")), entry(other, "yards_against", F.col("yards")),
    )
    names = ["returns_for", "returns_against", "yards_for", "yards_against"]
    wide = view(spark, sf_dir, "fx_plays").select("gi", F.explode(entries).alias("e")).groupBy("e.team", "gi").pivot("e.metric", names).agg(F.sum("e.value"))
    return view(spark, sf_dir, "fx_schedule").select("team", "gi").join(wide, ["team", "gi"], "left").select(
        "team", "gi", *(F.coalesce(n, F.lit(0)).alias(n) for n in names)
    )


@query("sum_by_key", """
    select s.team, s.gi, coalesce(sum(g.targets), 0)::bigint as targets, coalesce(count(g.k), 0) as n_players from fx_schedule s
    left join fx_games g on g.team = s.team and g.gi = s.gi group by s.team, s.gi""")
def sum_by_key(spark, sf_dir):
    sums = view(spark, sf_dir, "fx_games").groupBy("team", "gi").agg(F.sum("targets").alias("t"), F.count("*").alias("n"))
    return view(spark, sf_dir, "fx_schedule").select("team", "gi").join(sums, ["team", "gi"], "left").select(
        "team", "gi", F.coalesce("t", F.lit(0)).alias("targets"), F.coalesce("n", F.lit(0)).alias("n_players")
    )


@query("team_totals_share", """
    select k, gi, case when sum(targets) over w > 0 then round(cast(targets as double) / sum(targets) over w, 6) end as target_share
    from fx_games window w as (partition by team, gi)""")
def team_totals_share(spark, sf_dir):
    total = F.sum("targets").over(Window.partitionBy("team", "gi"))
    return view(spark, sf_dir, "fx_games").select("k", "gi", rounded(fn.safe_ratio(F.col("targets"), total), 6).alias("target_share"))


@query("concentration", """
    select team, gi, round(max(s), 6) as top_share, round(sum(s * s), 6) as herfindahl from (
      select team, gi, cast(targets as double) / sum(targets) over (partition by team, gi) as s from fx_games) group by team, gi""")
def concentration(spark, sf_dir):
    share = F.col("targets") / F.sum("targets").over(Window.partitionBy("team", "gi"))
    return view(spark, sf_dir, "fx_games").withColumn("s", share).groupBy("team", "gi").agg(
        rounded(F.max("s"), 6).alias("top_share"), rounded(F.sum(F.col("s") * F.col("s")), 6).alias("herfindahl")
    )


@query("prev_season", "select k, season + 1 as season, round(avg(pts), 4) as prev_pts, count(*) as prev_games from fx_games group by k, season")
def prev_season(spark, sf_dir):
    means = view(spark, sf_dir, "fx_games").groupBy("k", "season").agg(r4(F.avg("pts")).alias("prev_pts"), F.count("*").alias("prev_games"))
    return means.withColumn("season", F.col("season") + 1)


@query("grouping_pooled", """
    select position, season, count(*) as n, round(avg(abs(actual - proj)), 4) as mae from fx_proj where proj is not null
    group by grouping sets ((position), (position, season))""")
def grouping_pooled(spark, sf_dir):
    df = view(spark, sf_dir, "fx_proj").where("proj is not null").withColumn("e", F.abs(F.col("actual") - F.col("proj")))
    return df.groupingSets([["position"], ["position", "season"]], "position", "season").agg(F.count("*").alias("n"), r4(F.avg("e")).alias("mae"))


@query("distinct_counts", """
    select day, count(distinct k) as n_users, count(distinct event_type) as n_types, count(*) as n from fx_captures group by day""")
def distinct_counts(spark, sf_dir):
    return view(spark, sf_dir, "fx_captures").groupBy("day").agg(
        F.count_distinct("k").alias("n_users"), F.count_distinct("event_type").alias("n_types"), F.count("*").alias("n")
    )


@query("mode_per_group", """
    select k, play_type as mode from (select k, play_type, row_number() over (partition by k order by count(*) desc, play_type) as r from fx_plays group by k, play_type) where r = 1""")
def mode_per_group(spark, sf_dir):
    counts = view(spark, sf_dir, "fx_plays").groupBy("k", F.col("play_type").alias("mode")).count()
    return dedup.first_by(counts, ["k"], [F.desc("count"), "mode"]).select("k", "mode")


@query("quantile_agg", """
    select position, round(quantile_cont(pts, 0.1), 4) as q10, round(quantile_cont(pts, 0.5), 4) as q50, round(quantile_cont(pts, 0.9), 4) as q90,
        round(stddev_samp(pts), 4) as sd from fx_games group by position""")
def quantile_agg(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_games").select("position", "pts")
    out = exact_quantiles(rows, ["position"], "pts", [0.1, 0.5, 0.9], F.stddev_samp("pts").alias("sd"))
    return out.select("position", *(r4(F.col("q")[i]).alias(c) for i, c in enumerate(("q10", "q50", "q90"))), r4("sd").alias("sd"))


@query("regr_agg", """
    select position, count(*) as n, round(regr_slope(actual, proj), 6) as slope, round(regr_intercept(actual, proj), 4) as intercept, round(corr(actual, proj), 6) as r
    from fx_proj where proj is not null group by position""")
def regr_agg(spark, sf_dir):
    return view(spark, sf_dir, "fx_proj").where("proj is not null").groupBy("position").agg(
        F.count("*").alias("n"), rounded(F.regr_slope("actual", "proj"), 6).alias("slope"),
        r4(F.regr_intercept("actual", "proj")).alias("intercept"), rounded(F.corr("actual", "proj"), 6).alias("r"),
    )


# --- ranking and de-duplication ------------------------------------------------------------------------------------


@query("severity_dedup", """
    select k, day, status, event_id from (select *, row_number() over (partition by k, day order by
      case status when 'Out' then 1 when 'Doubtful' then 2 when 'Questionable' then 3 when 'Listed' then 4 else 5 end, ts desc, event_id) as r from fx_reports) where r = 1""")
def severity_dedup(spark, sf_dir):
    reports = view(spark, sf_dir, "fx_reports")
    best = dedup.by_severity(reports, ["k", "day"], "status", ["Out", "Doubtful", "Questionable", "Listed"], [F.desc("ts"), "event_id"])
    return best.select("k", "day", "status", "event_id")


@query("priority_dedup", """
    with p as (select *, case source when 'a' then 1 when 'b' then 2 else 3 end as p from fx_ids),
    m as (select *, min(p) over (partition by b_id) as best from p), n as (select *, count(*) over (partition by b_id) as c from m where p = best)
    select b_id, a_id, source from n where c = 1""")
def priority_dedup(spark, sf_dir):
    order = F.when(F.col("source") == "a", 1).when(F.col("source") == "b", 2).otherwise(3)
    return dedup.unique_best(view(spark, sf_dir, "fx_ids"), ["b_id"], order).select("b_id", "a_id", "source")


@query("slice_max", "select k, max_by(event_id, (ts, event_id)) as event_id, max(ts) as ts from fx_captures group by k")
def slice_max(spark, sf_dir):
    return view(spark, sf_dir, "fx_captures").groupBy("k").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("top_n_by_class", """
    select position, k, gi, rank from (select position, k, gi, row_number() over (partition by position order by pts desc, k, gi) as rank from fx_games)
    where rank <= case position when 'BUILDING' then 30 when 'MACHINERY' then 20 else 10 end""")
def top_n_by_class(spark, sf_dir):
    sizes = F.when(F.col("position") == "BUILDING", 30).when(F.col("position") == "MACHINERY", 20).otherwise(10)
    return dedup.top_n(view(spark, sf_dir, "fx_games"), ["position"], [F.desc("pts"), "k", "gi"], sizes).select("position", "k", "gi", "rank")


@query("top_k_overlap", """
    with r as (select gi, row_number() over (partition by gi order by proj desc, k) as a, row_number() over (partition by gi order by actual desc, k) as b from fx_proj where proj is not null)
    select gi, count(*) filter (where a <= 24 and b <= 24) / 24.0::double as precision from r group by gi""")
def top_k_overlap(spark, sf_dir):
    rank = lambda c: F.row_number().over(Window.partitionBy("gi").orderBy(F.desc(c), "k"))
    df = view(spark, sf_dir, "fx_proj").where("proj is not null").select("gi", rank("proj").alias("a"), rank("actual").alias("b"))
    return df.groupBy("gi").agg((F.count_if((F.col("a") <= 24) & (F.col("b") <= 24)) / 24.0).alias("precision"))


@query("ordered_rank", """
    with s as (select k, position, round(sum(pts), 2) as total, count(*) as n from fx_games group by k, position)
    select k, position, total, row_number() over (partition by position order by total desc, n, k) as class_rank from s""")
def ordered_rank(spark, sf_dir):
    totals = view(spark, sf_dir, "fx_games").groupBy("k", "position").agg(F.round(F.sum("pts"), 2).alias("total"), F.count("*").alias("n"))
    w = Window.partitionBy("position").orderBy(F.desc("total"), "n", "k")
    return totals.select("k", "position", "total", F.row_number().over(w).cast("long").alias("class_rank"))


@query("rank_ties", """
    select gi, k, rank() over (partition by gi order by receptions desc) as r_min,
        row_number() over (partition by gi order by receptions desc, k) as r_first,
        ntile(5) over (partition by gi order by receptions, k) as bin from fx_games""")
def rank_ties(spark, sf_dir):
    w = Window.partitionBy("gi")
    return view(spark, sf_dir, "fx_games").select(
        "gi", "k", F.rank().over(w.orderBy(F.desc("receptions"))).cast("long").alias("r_min"),
        F.row_number().over(w.orderBy(F.desc("receptions"), "k")).cast("long").alias("r_first"),
        F.ntile(5).over(w.orderBy("receptions", "k")).cast("long").alias("bin"),
    )


@query("union_distinct", "select k from fx_games union select k from fx_reports union select a_id from fx_ids")
def union_distinct(spark, sf_dir):
    return view(spark, sf_dir, "fx_games").select("k").union(view(spark, sf_dir, "fx_reports").select("k")).union(view(spark, sf_dir, "fx_ids").select("a_id")).distinct()


@query("setdiff_intersect", """
    select 'missing' as kind, k from (select k from fx_games except select k from fx_reports)
    union all select 'common', k from (select k from fx_games intersect select k from fx_reports)""")
def setdiff_intersect(spark, sf_dir):
    a, b = view(spark, sf_dir, "fx_games").select("k"), view(spark, sf_dir, "fx_reports").select("k")
    return a.subtract(b).select(F.lit("missing").alias("kind"), "k").unionByName(a.intersect(b).select(F.lit("common").alias("kind"), "k"))


@query("pareto_frontier", """
    with s as (select position, k, cast(sum(targets) as bigint) as x, max(receptions) as y from fx_games group by position, k)
    select position, k, x, y from s a where not exists (select 1 from s b where b.position = a.position and b.x >= a.x and b.y >= a.y and (b.x > a.x or b.y > a.y))""")
def pareto_frontier(spark, sf_dir):
    sums = view(spark, sf_dir, "fx_games").groupBy("position", "k").agg(F.sum("targets").alias("x"), F.max("receptions").alias("y"))
    return dedup.pareto(sums, ["position"], "x", "y")


# --- scoring -------------------------------------------------------------------------------------------------------


@query("weighted_score", "select k, gi, round(coalesce(targets, 0) * 0.1::double + coalesce(receptions, 0) * 1.0::double + coalesce(yards, 0) * 0.05::double, 4) as score from fx_games")
def weighted_score(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games")
    return games.select("k", "gi", r4(scoring.weighted_score(games, scoring.WEIGHTS)).alias("score"))


@query("udf_scoring", "select k, gi, round(coalesce(targets, 0) * 0.25::double + coalesce(receptions, 0) * 1.5::double - coalesce(yards, 0) * 0.02::double, 4) as score from fx_games")
def udf_scoring(spark, sf_dir):
    """A scoring system that a user states as YAML: statistic to weight."""
    path = docs.scratch(spark, "rules")
    text = "name: example\nweights:\n  targets: 0.25\n  receptions: 1.5\n  yards: -0.02\n"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    games = view(spark, sf_dir, "fx_games")
    return games.select("k", "gi", r4(scoring.weighted_score(games, scoring.read_weights(spark, path))).alias("score"))


@query("unit_score", """
    select k, gi, position as unit, round(case when position in ('BUILDING', 'MACHINERY') then targets * 0.2::double + receptions * 1.5::double else targets * 0.1::double end, 4) as points from fx_games""")
def unit_score(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games").select("k", "gi", F.col("position").alias("unit"), F.col("targets").cast("double").alias("targets"), F.col("receptions").cast("double").alias("receptions"))
    long = games.unpivot(["k", "gi", "unit"], ["targets", "receptions"], "stat", "value")
    heavy, light = ["BUILDING", "MACHINERY"], ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]
    rows = [(u, "targets", 0.2) for u in heavy] + [(u, "receptions", 1.5) for u in heavy] + [(u, "targets", 0.1) for u in light]
    rules = spark.createDataFrame(rows, "unit string, stat string, weight double")
    return scoring.long_score(long, rules, ["k", "gi", "unit"]).withColumn("points", r4("points"))


@query("clean_stats", "select k, gi, targets, receptions from fx_games where week between 2 and 11 and not (targets = 0 and receptions = 0)")
def clean_stats(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games").where(F.col("week").between(2, 11)).where("not (targets = 0 and receptions = 0)").select("k", "gi", "targets", "receptions")
    checks.assert_rules(games, checks.not_missing(["k", "gi"]) | checks.in_range("targets", 0), "stats")
    return games


@query("two_sides", """
    with g as (select gi, team as h, opponent as a, cast(cents % 15 as double) - 7 as spread, 40 + cast(cents % 20 as double) as total from fx_schedule where home)
    select gi, total, h as team, a as opponent, true as home, spread as team_spread, (total + spread) / 2 as implied_total from g
    union all select gi, total, a, h, false, -spread, (total - spread) / 2 from g""")
def two_sides(spark, sf_dir):
    games = view(spark, sf_dir, "fx_schedule").where("home").select(
        "gi", F.col("team").alias("h"), F.col("opponent").alias("a"), ((F.col("cents") % 15).cast("double") - 7).alias("spread"),
        (40 + (F.col("cents") % 20).cast("double")).alias("total"),
    )
    return scoring.two_sides(games, "h", "a", "spread", "total")


@query("population_flags", """
    select k, gi, proj is not null and proj > 0 as projected, coalesce(snap_share >= 0.3, false) as active,
        row_number() over (partition by gi order by coalesce(proj, -1) desc, k) <= 60 as relevant
    from fx_proj join fx_games using (k, gi)""")
def population_flags(spark, sf_dir):
    df = view(spark, sf_dir, "fx_proj").join(view(spark, sf_dir, "fx_games").select("k", "gi", "snap_share"), ["k", "gi"])
    rank = F.row_number().over(Window.partitionBy("gi").orderBy(F.coalesce("proj", F.lit(-1.0)).desc(), "k"))
    return df.select("k", "gi", joins.matched(F.col("proj") > 0).alias("projected"), joins.matched(F.col("snap_share") >= 0.3).alias("active"), (rank <= 60).alias("relevant"))


@query("split_label", """
    select season, case when season between 1992 and 1994 then 'history' when season between 1995 and 1997 then 'train' when season = 1998 then 'test' else 'unused' end as split, count(*) as n
    from fx_games group by season""")
def split_label(spark, sf_dir):
    label = scoring.split_label("season", {"history": (1992, 1994), "train": (1995, 1997), "test": (1998, 1998)})
    return view(spark, sf_dir, "fx_games").groupBy("season").agg(F.count("*").alias("n")).select("season", label.alias("split"), "n")


@query("model_population", """
    with c as (select season, bool_and(proj is not null) as complete from fx_proj group by season)
    select p.season, count(*) as n from fx_proj p join c using (season) where c.complete or p.proj is not null group by p.season""")
def model_population(spark, sf_dir):
    df = view(spark, sf_dir, "fx_proj")
    complete = df.groupBy("season").agg(F.bool_and(F.col("proj").isNotNull()).alias("complete"))
    return df.join(F.broadcast(complete), "season").where("complete or proj is not null").groupBy("season").agg(F.count("*").alias("n"))


@query("rule_adjust", """
    select k, gi, round(proj + case when coalesce(c2 >= 8, false) then 1.5::double else 0 end + case when coalesce(week = 1, false) then -0.5::double else 0 end, 4) as adjusted from fx_proj""")
def rule_adjust(spark, sf_dir):
    adjusted = scoring.rule_adjust(F.col("proj"), [(F.col("c2") >= 8, 1.5), (F.col("week") == 1, -0.5)])
    return view(spark, sf_dir, "fx_proj").select("k", "gi", r4(adjusted).alias("adjusted"))


@query("group_multiplier", """
    select k, gi, round(proj * case position when 'BUILDING' then 0.9::double when 'MACHINERY' then 1.05::double else 1.0::double end / (1 + exp(-(0.5::double + 0.1::double * c2))), 4) as m from fx_proj""")
def group_multiplier(spark, sf_dir):
    params = spark.createDataFrame([("BUILDING", 0.9), ("MACHINERY", 1.05)], "position string, m double")
    df = view(spark, sf_dir, "fx_proj").join(F.broadcast(params), "position", "left")
    active = 1 / (1 + F.exp(-(0.5 + 0.1 * F.col("c2"))))
    return df.select("k", "gi", r4(F.col("proj") * F.coalesce("m", F.lit(1.0)) * active).alias("m"))


@query("injury_group", """
    select designation, practice, case when injury ilike '%knee%' then 'knee' when injury ilike '%ankle%' then 'leg' when injury ilike '%illness%' then 'illness' else 'other' end as body,
        case when designation = 'Out' then 'out' when designation in ('Doubtful', 'Questionable') and practice = 'full' then 'uncertain, full' when designation in ('Doubtful', 'Questionable') and practice = 'limited' then 'uncertain, limited'
        when designation in ('Doubtful', 'Questionable') then 'uncertain, none' when designation = 'Listed' then 'listed' else 'none' end as grp, count(*) as n
    from fx_details group by all""")
def injury_group(spark, sf_dir):
    """Reports by designation, practice and normalised part of the body, with the group of the first two."""
    unsure, practice = F.col("designation").isin("Doubtful", "Questionable"), F.col("practice")
    grp = (
        F.when(F.col("designation") == "Out", "out").when(unsure & (practice == "full"), "uncertain, full").when(unsure & (practice == "limited"), "uncertain, limited")
        .when(unsure, "uncertain, none").when(F.col("designation") == "Listed", "listed").otherwise("none")
    )
    body = features.body_part(F.col("injury"))
    return view(spark, sf_dir, "fx_details").groupBy("designation", "practice", body.alias("body"), grp.alias("grp")).agg(F.count("*").alias("n"))


@query("kick_tiers", """
    select k, gi, (pts <= 50)::bigint as t1, (pts > 50 and pts <= 100)::bigint as t2, (pts > 100)::bigint as t3 from fx_games""")
def kick_tiers(spark, sf_dir):
    return view(spark, sf_dir, "fx_games").select("k", "gi", *fn.tiers(F.col("pts"), [50, 100], "t"))


@query("prospective_targets", """
    select 'kept' as kind, count(*) as n from fx_proj p join fx_ids i on i.a_id = p.k and i.source = 'a' where p.proj > 0
    union all select 'no id', count(*) from fx_proj p where p.proj > 0 and p.k not in (select a_id from fx_ids where source = 'a')
    union all select 'no projection', count(*) from fx_proj p where p.proj is null or p.proj <= 0""")
def prospective_targets(spark, sf_dir):
    ids = view(spark, sf_dir, "fx_ids").where("source = 'a'").select(F.col("a_id").alias("k"), F.lit(True).alias("hit"))
    kind = F.when(F.col("proj").isNull() | (F.col("proj") <= 0), "no projection").when(F.col("hit").isNull(), "no id").otherwise("kept")
    return view(spark, sf_dir, "fx_proj").join(ids, "k", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("asof_training_rows", "select g.season, count(*) as n from fx_games g where exists (select 1 from fx_schedule s where s.team = g.team and s.gi = g.gi and s.final) group by g.season")
def asof_training_rows(spark, sf_dir):
    final = view(spark, sf_dir, "fx_schedule").where("final").select("team", "gi")
    return view(spark, sf_dir, "fx_games").join(final, ["team", "gi"], "left_semi").groupBy("season").agg(F.count("*").alias("n"))


@query("completed_periods", "select gi, bool_and(final) as done, count(*) as n from fx_schedule group by gi")
def completed_periods(spark, sf_dir):
    return view(spark, sf_dir, "fx_schedule").groupBy("gi").agg(F.bool_and("final").alias("done"), F.count("*").alias("n"))


@query("season_guard", "select season, count(*) as n from fx_games where season between 1995 and 1997 group by season")
def season_guard(spark, sf_dir):
    permitted = spark.createDataFrame([(1995,), (1996,), (1997,)], "season long")
    games = view(spark, sf_dir, "fx_games").where("season between 1995 and 1997")
    return scoring.season_guard(games, "season", permitted).groupBy("season").agg(F.count("*").alias("n"))


# --- scalar functions ----------------------------------------------------------------------------------------------


@query("name_normalise", r"""
    select a_id, source, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g'), '( jr| sr| ii| iii| iv| v)+$', ''), ' +', ' ', 'g')) as norm from fx_ids""")
def name_normalise(spark, sf_dir):
    return view(spark, sf_dir, "fx_ids").select("a_id", "source", fn.name_normalise(F.col("name")).alias("norm"))


@query("team_standardise", "select n_name, case n_name when 'FRANCE' then 'FR' when 'GERMANY' then 'DE' end as code from nation")
def team_standardise(spark, sf_dir):
    return view(spark, sf_dir, "nation").select("n_name", fn.lookup(F.col("n_name"), {"FRANCE": "FR", "GERMANY": "DE"}).alias("code"))


@query("tz_convert", "select event_id, (ts at time zone 'America/New_York') at time zone 'UTC' as utc from fx_captures")
def tz_convert(spark, sf_dir):
    return view(spark, sf_dir, "fx_captures").select("event_id", fn.local_to_utc(F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("utc"))


@query("kickoff_bucket", """
    with l as (select (ts at time zone 'UTC') at time zone 'America/New_York' as t from fx_captures)
    select case when dayofweek(t) = 4 then 'Thu' when dayofweek(t) = 0 and hour(t) < 15 then 'Sun early' when dayofweek(t) = 0 then 'Sun late' when dayofweek(t) = 1 then 'Mon' else 'other' end as slate, count(*) as n from l group by 1""")
def kickoff_bucket(spark, sf_dir):
    return view(spark, sf_dir, "fx_captures").groupBy(fn.slate(F.col("ts").cast("timestamp")).alias("slate")).agg(F.count("*").alias("n"))


@query("season_of_date", "select year(o_orderdate) - (case when month(o_orderdate) < 3 then 1 else 0 end) as season, count(*) as n from orders group by 1")
def season_of_date(spark, sf_dir):
    return view(spark, sf_dir, "orders").groupBy(fn.season_of(F.col("o_orderdate")).alias("season")).agg(F.count("*").alias("n"))


@query("parse_stamps", """
    select event_id, case when event_id % 3 = 2 then null else date_trunc('second', ts) end as t from fx_captures""")
def parse_stamps(spark, sf_dir):
    text = (
        F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
        .when(F.col("event_id") % 3 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).otherwise("soon")
    )
    parsed = view(spark, sf_dir, "fx_captures").withColumn("stamp", text)
    return parsed.select("event_id", fn.parse_stamp(F.col("stamp")).cast("timestamp_ntz").alias("t"))


@query("bands", """
    select k, gi, case when pts >= 200 then 4 when pts >= 100 then 3 when pts >= 50 then 2 else 1 end as band,
        case when week > 0 and week <= 4 then 'early' when week > 4 and week <= 8 then 'mid' when week > 8 and week <= 12 then 'late' end as part from fx_games""")
def bands(spark, sf_dir):
    return view(spark, sf_dir, "fx_games").select(
        "k", "gi", fn.band(F.col("pts"), [50.0, 100.0, 200.0]).alias("band"), fn.cut(F.col("week"), [0, 4, 8, 12], ["early", "mid", "late"]).alias("part")
    )


@query("status_prior", "select status, count(*) as n, min(case status when 'Out' then 0.0::double when 'Doubtful' then 0.05::double when 'Questionable' then 0.7::double else 1.0::double end) as p from fx_reports group by status")
def status_prior(spark, sf_dir):
    p = fn.lookup(F.col("status"), {"Out": 0.0, "Doubtful": 0.05, "Questionable": 0.7}, 1.0)
    return view(spark, sf_dir, "fx_reports").groupBy("status").agg(F.count("*").alias("n"), F.min(p).alias("p"))


@query("horizon_weeks", "select k, gi, 12 - week as n_left, case when week < 9 then 9 - week else 0 end as n_regular from fx_games")
def horizon_weeks(spark, sf_dir):
    left = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda w: w > F.col("week"))
    return view(spark, sf_dir, "fx_games").select(
        "k", "gi", F.size(left).cast("long").alias("n_left"), F.size(F.filter(left, lambda w: w <= 9)).cast("long").alias("n_regular")
    )


@query("shrunk_rate", "select k, round((sum(receptions) + 20 * 0.3::double) / (sum(targets) + 20), 6) as rate from fx_games group by k")
def shrunk_rate(spark, sf_dir):
    return view(spark, sf_dir, "fx_games").groupBy("k").agg(rounded(fn.shrunk_rate(F.sum("receptions"), F.sum("targets"), 0.3, 20), 6).alias("rate"))


@query("id_hash", """
    select c_custkey as k, list_reduce(list_prepend(0::bigint, list_transform(string_split(c_name, ''), lambda c: ord(c)::bigint)), lambda a, c: (a * 31 + c) % 2147483647) as h, sha256(c_name) as digest from customer""")
def id_hash(spark, sf_dir):
    return view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), fn.id_hash(F.col("c_name")).alias("h"), F.sha2("c_name", 256).alias("digest"))
