"""Queries of point-in-time joins, windows and feature assemblies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitstats.operators import features, joins, windows
from pitstats.plans.registry import query
from pitstats.sources.documents import scratch, write_once
from pitstats.sources.fixtures import rounded, view


def r4(column):
    return rounded(F.col(column) if isinstance(column, str) else column, 4)


@query("pit_mae", """
    with st as (select k, gi, avg(pts) over (partition by k order by gi rows between 2 preceding and current row) as roll from fx_games),
    u as (select t.k, t.gi, g.pts as actual, (select max_by(s.roll, s.gi) from st s where s.k = t.k and s.gi < t.gi) as roll
      from fx_targets t join fx_games g on g.k = t.k and g.gi = t.gi)
    select gi, count(*) as n, round(avg(abs(actual - roll)), 4) as mae from u where roll is not null group by gi""")
def pit_mae(spark, sf_dir):
    """The trailing mean of three games, known strictly before each target month, against the month's points."""
    games = view(spark, sf_dir, "fx_games").select("k", "gi", "pts")
    states = games.select("k", "gi", windows.trailing_mean("pts", ["k"], ["gi"], 3).alias("roll"))
    targets = view(spark, sf_dir, "fx_targets").select("k", "gi").join(games, ["k", "gi"])
    known = joins.asof_strict(targets, states, ["k"], "gi", ["roll"]).where("roll is not null")
    return known.groupBy("gi").agg(F.count("*").alias("n"), r4(F.avg(F.abs(F.col("pts") - F.col("roll")))).alias("mae"))


@query("asof_strict", """
    select t.k, t.gi, (select max_by(g.pts, g.gi) from fx_games g where g.k = t.k and g.gi < t.gi) as pts,
        (select max(g.gi) from fx_games g where g.k = t.k and g.gi < t.gi) as state_gi from fx_targets t""")
def asof_strict(spark, sf_dir):
    targets = view(spark, sf_dir, "fx_targets").select("k", "gi")
    return joins.asof_strict(targets, view(spark, sf_dir, "fx_games"), ["k"], "gi", ["pts"], "state_gi")


@query("asof_timestamp", """
    with c as (select distinct k, day, cutoff from fx_reports)
    select c.k, c.day, (select max_by(r.event_id, (r.ts, r.event_id)) from fx_reports r where r.k = c.k and r.ts < c.cutoff) as event_id from c""")
def asof_timestamp(spark, sf_dir):
    reports = view(spark, sf_dir, "fx_reports")
    cutoffs = reports.select("k", "day", "cutoff").distinct()
    return joins.latest_before(reports, cutoffs, ["k"], "ts", "cutoff", ["event_id"], ["event_id"]).select("k", "day", "event_id")


@query("range_join", """
    select team, gi, cast(sum(c) over (partition by team, season order by gi range between unbounded preceding and 1 preceding) as bigint) as before_cents,
        count(*) over (partition by team, season order by gi range between unbounded preceding and 1 preceding) as before_weeks
    from (select team, season, gi, sum(cents) as c from fx_plays group by team, season, gi)""")
def range_join(spark, sf_dir):
    sums = view(spark, sf_dir, "fx_plays").groupBy("team", "season", "gi").agg(F.sum("cents").alias("c"))
    w = windows.before(["team", "season"], "gi")
    return sums.select("team", "gi", F.sum("c").over(w).alias("before_cents"), F.count("*").over(w).alias("before_weeks"))


@query("theta_count", """
    select t.k, t.gi, count(g.gi) as n_before from fx_targets t left join fx_games g on g.k = t.k and g.gi < t.gi group by t.k, t.gi""")
def theta_count(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games").select("k", "gi")
    counted = games.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("gi")).cast("long"))
    known = joins.asof_strict(view(spark, sf_dir, "fx_targets").select("k", "gi"), counted, ["k"], "gi", ["n"])
    return known.select("k", "gi", F.coalesce("n", F.lit(0)).alias("n_before"))


@query("interval_count", """
    with last as (select t.k, t.team, t.gi, (select max(g.gi) from fx_games g where g.k = t.k and g.gi < t.gi) as lg from fx_targets t)
    select k, gi, case when lg is not null then (select count(*) from (select distinct gi as sg from fx_plays) s where s.sg > lg and s.sg < l.gi) end as missed from last l""")
def interval_count(spark, sf_dir):
    """Scheduled months strictly between the last game and the target: a difference of two running counts."""
    months = view(spark, sf_dir, "fx_plays").select("gi").distinct()
    numbered = months.withColumn("i", F.row_number().over(Window.orderBy("gi")).cast("long"))  # one row per month
    games = view(spark, sf_dir, "fx_games").select("k", "gi").join(F.broadcast(numbered), "gi").select("k", "gi", F.col("i").alias("seen"))
    targets = view(spark, sf_dir, "fx_targets").select("k", "gi").join(F.broadcast(numbered), "gi")
    known = joins.asof_strict(targets, games, ["k"], "gi", ["seen"])
    return known.select("k", "gi", (F.col("i") - F.col("seen") - 1).alias("missed"))


@query("vacated_share", """
    with s as (select k, team, gi, cast(targets as double) / sum(targets) over (partition by team, gi) as share from fx_games),
    t as (select t.k, t.team, t.gi, (select max_by(s.share, s.gi) from s where s.k = t.k and s.gi < t.gi) as share,
        not exists (select 1 from fx_games g where g.k = t.k and g.gi = t.gi) as absent from fx_targets t)
    select k, gi, round(sum(case when absent then coalesce(share, 0) else 0 end) over (partition by team, gi) - case when absent then coalesce(share, 0) else 0 end, 4) as vacated from t""")
def vacated_share(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games")
    share = (F.col("targets") / F.sum("targets").over(Window.partitionBy("team", "gi"))).alias("share")
    targets = view(spark, sf_dir, "fx_targets").select("k", "team", "gi")
    known = joins.asof_strict(targets, games.select("k", "gi", share), ["k"], "gi", ["share"])
    played = games.select("k", "gi", F.lit(True).alias("played"))
    gone = F.when(F.col("played").isNull(), F.coalesce("share", F.lit(0.0))).otherwise(0.0)
    known = known.join(played, ["k", "gi"], "left").withColumn("gone", gone)
    return known.select("k", "gi", r4(F.sum("gone").over(Window.partitionBy("team", "gi")) - F.col("gone")).alias("vacated"))


@query("trailing_mean", """
    select k, gi, round(avg(snap_share) over (partition by k order by gi rows between 2 preceding and current row), 4) as m3,
        round(avg(pts) over (partition by k order by gi rows between 7 preceding and current row), 4) as m8 from fx_games""")
def trailing_mean(spark, sf_dir):
    return view(spark, sf_dir, "fx_games").select(
        "k", "gi", r4(windows.trailing_mean("snap_share", ["k"], ["gi"], 3)).alias("m3"), r4(windows.trailing_mean("pts", ["k"], ["gi"], 8)).alias("m8")
    )


@query("trailing_sum_sd", """
    select k, gi, cast(sum(targets) over w8 as bigint) as s8, case when count(pts) over w8 >= 2 then round(stddev_samp(pts) over w8, 3) end as sd8
    from fx_games window w8 as (partition by k order by gi rows between 7 preceding and current row)""")
def trailing_sum_sd(spark, sf_dir):
    return view(spark, sf_dir, "fx_games").select(
        "k", "gi", windows.trailing_sum("targets", ["k"], ["gi"], 8).alias("s8"), rounded(windows.trailing_sd("pts", ["k"], ["gi"], 8), 3).alias("sd8")
    )


@query("ewma", """
    with recursive g as (select k, gi, snap_share as x, row_number() over (partition by k order by gi) as i from fx_games),
    e as (select k, gi, i, coalesce(x, 0) as num, case when x is null then 0.0::double else 1.0::double end as den from g where i = 1
      union all select g.k, g.gi, g.i, e.num * pow(0.5, 1 / 2.0::double) + coalesce(g.x, 0), e.den * pow(0.5, 1 / 2.0::double) + case when g.x is null then 0 else 1 end from e join g on g.k = e.k and g.i = e.i + 1)
    select k, gi, case when den > 0 then round(num / den, 4) end as e2 from e""")
def ewma(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games").select("k", "gi", "snap_share")
    return windows.with_ewma(games, "snap_share", ["k"], ["gi"], 2.0, "e2").select("k", "gi", r4("e2").alias("e2"))


@query("expanding", """
    select k, gi, row_number() over (partition by k order by gi) as career, row_number() over (partition by k, season order by gi) as in_season,
        round(avg(pts) over (partition by k, season order by gi rows unbounded preceding), 4) as season_mean from fx_games""")
def expanding(spark, sf_dir):
    return view(spark, sf_dir, "fx_games").select(
        "k", "gi", F.row_number().over(Window.partitionBy("k").orderBy("gi")).cast("long").alias("career"),
        F.row_number().over(Window.partitionBy("k", "season").orderBy("gi")).cast("long").alias("in_season"),
        r4(F.avg("pts").over(windows.last_rows(["k", "season"], ["gi"], None))).alias("season_mean"),
    )


@query("lag_group", """
    with s as (select team, gi, lag(gi) over (partition by team order by gi) as prev_gi from fx_schedule)
    select g.k, g.gi, s.prev_gi, case when s.prev_gi is null then null else coalesce(p.targets, 0) end as prev_targets
    from fx_games g join s on s.team = g.team and s.gi = g.gi left join fx_games p on p.k = g.k and p.gi = s.prev_gi""")
def lag_group(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games").select("k", "gi", "team", "targets")
    schedule = view(spark, sf_dir, "fx_schedule").select("team", "gi", windows.previous("gi", ["team"], ["gi"]).alias("prev_gi"))
    before = games.select("k", F.col("gi").alias("prev_gi"), F.col("targets").alias("t"))
    joined = games.join(schedule, ["team", "gi"]).join(before, ["k", "prev_gi"], "left")
    return joined.select("k", "gi", "prev_gi", F.when(F.col("prev_gi").isNotNull(), F.coalesce("t", F.lit(0))).alias("prev_targets"))


LEADERS = """
    l as (select team, gi, leader from (select team, gi, leader, row_number() over (partition by team, gi order by count(*) desc, sum(yards) desc, leader) as r
      from fx_plays group by team, gi, leader) where r = 1)"""


def leaders(spark, sf_dir):
    return features.leaders(view(spark, sf_dir, "fx_plays"), ["team", "gi"], "leader", "yards")


@query("changed_flag", f"with {LEADERS} select team, gi, leader, coalesce(leader <> lag(leader) over (partition by team order by gi), false) as changed from l")
def changed_flag(spark, sf_dir):
    return leaders(spark, sf_dir).select("team", "gi", "leader", windows.changed("leader", ["team"], ["gi"]).alias("changed"))


@query("share_same_last4", """
    select k, gi, (select count(*) from unnest(l) x(v) where x.v = week % 3) / cast(len(l) as double) as share from (
      select k, gi, week, list(week % 3) over (partition by k order by gi rows between 3 preceding and current row) as l from fx_games)""")
def share_same_last4(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games").select("k", "gi", (F.col("week") % 3).alias("m"))
    return games.select("k", "gi", windows.share_same("m", ["k"], ["gi"], 4).alias("share"))


@query("streak", """
    with m as (select t.k, t.gi, g.k is not null as played, row_number() over (partition by t.k order by t.gi) as i from fx_targets t left join fx_games g on g.k = t.k and g.gi = t.gi)
    select k, gi, i - 1 - coalesce(max(case when not played then i end) over (partition by k order by i rows between unbounded preceding and 1 preceding), 0) as streak from m""")
def streak(spark, sf_dir):
    played = view(spark, sf_dir, "fx_games").select("k", "gi", F.lit(True).alias("p"))
    rows = view(spark, sf_dir, "fx_targets").select("k", "gi").join(played, ["k", "gi"], "left").withColumn("played", F.coalesce("p", F.lit(False)))
    return windows.with_streak(rows, "played", ["k"], "gi", "streak").select("k", "gi", "streak")


@query("cum_exclusive", """
    select position, gi, round(sum(s) over w, 3) as sum_before, cast(sum(n) over w as bigint) as n_before from (
      select position, gi, sum(pts) as s, count(*) as n from fx_games group by position, gi)
    window w as (partition by position order by gi range between unbounded preceding and 1 preceding)""")
def cum_exclusive(spark, sf_dir):
    sums = view(spark, sf_dir, "fx_games").groupBy("position", "gi").agg(F.sum("pts").alias("s"), F.count("*").alias("n"))
    w = windows.before(["position"], "gi")
    return sums.select("position", "gi", rounded(F.sum("s").over(w), 3).alias("sum_before"), F.sum("n").over(w).alias("n_before"))


@query("carry_forward", """
    select k, gi, last_value(snap_share ignore nulls) over (partition by k order by gi rows unbounded preceding) as carried from fx_games""")
def carry_forward(spark, sf_dir):
    return view(spark, sf_dir, "fx_games").select("k", "gi", windows.carry_forward("snap_share", ["k"], ["gi"]).alias("carried"))


@query("level_avg4", """
    with p as (select k, gi, snap_share > 0.35 as pos, snap_share - 0.35 as x from fx_games),
    m as (select k, gi, case when coalesce(x > 0, false) then avg(x) over (partition by k, coalesce(x > 0, false) order by gi rows between 3 preceding and current row) end as m from p)
    select k, gi, round(last_value(m ignore nulls) over (partition by k order by gi rows unbounded preceding), 4) as level from m""")
def level_avg4(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games").select("k", "gi", (F.col("snap_share") - 0.35).alias("x"))
    return windows.with_level_of_positives(games, "x", ["k"], "gi", 4, "level").select("k", "gi", r4("level").alias("level"))


@query("holm", """
    with p as (select k, season, position, least(1.0::double, 1 / (1 + avg(pts))) as p from fx_games group by k, season, position),
    r as (select *, p * (count(*) over (partition by season, position) - row_number() over (partition by season, position order by p, k) + 1) as raw from p)
    select k, season, round(least(1.0::double, max(raw) over (partition by season, position order by p, k rows unbounded preceding)), 6) as adjusted from r""")
def holm(spark, sf_dir):
    p = view(spark, sf_dir, "fx_games").groupBy("k", "season", "position").agg(F.least(F.lit(1.0), 1 / (1 + F.avg("pts"))).alias("p"))
    return windows.with_holm(p, "p", ["season", "position"], ["k"], "adjusted").select("k", "season", rounded(F.col("adjusted"), 6).alias("adjusted"))


@query("cumprod", """
    select k, gi, round(exp(sum(ln(1 + (case when receptions >= 4 then 0.5::double else -0.2::double end))) over (partition by k order by gi rows unbounded preceding)), 6) as wealth from fx_games""")
def cumprod(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games").select("k", "gi", (1 + F.when(F.col("receptions") >= 4, 0.5).otherwise(-0.2)).alias("bet"))
    return games.select("k", "gi", rounded(windows.cumprod("bet", ["k"], ["gi"]), 6).alias("wealth"))


PLAYER = ["pts", "targets", "receptions", "yards", "target_share", "air_share", "snap_share", "rz", "rz_share", "xfp"]
RECENT = ["pts", "targets", "target_share", "air_share", "snap_share", "xfp", "deep", "rz", "carries", "receptions"]
TRENDS = ["target_share", "snap_share", "xfp"]
M1_MEANS = [f"{v}_{n}" for v in PLAYER for n in (3, 8)]
M2_PARTS = (
    [f"{v}_e{h}" for v in RECENT for h in (2, 6)] + ["pts_1", "targets_2", "targets_4", "pts_sd8", "target_share_sd8"]
    + [f"{r}_16" for r in features.RATES] + ["over_16"] + [f"{v}_trend" for v in TRENDS]
)


@query("pit_player_state", f"""
    select k, gi, season as last_season, {", ".join(f"round(avg({v}) over w{n}, 4) as {v}_{n}" for v in PLAYER for n in (3, 8))},
        row_number() over (partition by k order by gi) as career_games, row_number() over s as season_games, round(avg(pts) over s, 4) as season_pts, round(avg(targets) over s, 4) as season_targets
    from fx_usage window w3 as (partition by k order by gi rows between 2 preceding and current row), w8 as (partition by k order by gi rows between 7 preceding and current row),
        s as (partition by k, season order by gi rows unbounded preceding)""")
def pit_player_state(spark, sf_dir):
    state = features.player_state(view(spark, sf_dir, "fx_usage"), "k", "gi", "season", PLAYER, ["pts", "targets"])
    return state.select("k", "gi", "last_season", *(r4(c).alias(c) for c in M1_MEANS), "career_games", "season_games", r4("season_pts").alias("season_pts"), r4("season_targets").alias("season_targets"))


def _ewma_sql(v: str, h: int) -> str:
    return f"sum({v} * pow(2.0::double, i / {h}.0::double)) over u / nullif(sum(case when {v} is not null then pow(2.0::double, i / {h}.0::double) end) over u, 0)"


STATE_M2 = f"""
    us as (select *, row_number() over (partition by k order by gi) - 1 as i from fx_usage),
    m2 as (select k, gi, week as last_week, {", ".join(f"{_ewma_sql(v, h)} as {v}_e{h}" for v in RECENT for h in (2, 6))}, pts as pts_1,
        avg(targets) over (partition by k order by gi rows between 1 preceding and current row) as targets_2, avg(targets) over (partition by k order by gi rows between 3 preceding and current row) as targets_4,
        case when count(pts) over w8 >= 2 then stddev_samp(pts) over w8 end as pts_sd8, case when count(target_share) over w8 >= 2 then stddev_samp(target_share) over w8 end as target_share_sd8,
        {", ".join(f"(sum(coalesce({x}, 0)) over w16 + {n * prior}::double) / (sum(coalesce({y}, 0)) over w16 + {n}) as {name}_16" for name, (x, y, prior, n) in features.RATES.items())},
        sum(pts - xfp) over w16 / (count(pts - xfp) over w16 + 6) as over_16
      from us window u as (partition by k order by gi rows unbounded preceding), w8 as (partition by k order by gi rows between 7 preceding and current row), w16 as (partition by k order by gi rows between 15 preceding and current row)),
    s2 as (select *, {", ".join(f"{v}_e2 - {v}_e6 as {v}_trend" for v in TRENDS)} from m2)"""


@query("pit_player_state_m2", f"with {STATE_M2} select k, gi, last_week, {', '.join(f'round({c}, 4) as {c}' for c in M2_PARTS)} from s2")
def pit_player_state_m2(spark, sf_dir):
    state = features.player_state_m2(view(spark, sf_dir, "fx_usage"), "k", "gi", RECENT, TRENDS)
    return state.select("k", "gi", "last_week", *(r4(c).alias(c) for c in M2_PARTS))


@query("pit_team_state", """
    select team, gi, round(avg(t) over w, 4) as targets_3, round(avg(n) over w, 4) as plays_3 from (select team, gi, sum(targets) as t, sum(receptions) as n from fx_games group by team, gi)
    window w as (partition by team order by gi rows between 2 preceding and current row)""")
def pit_team_state(spark, sf_dir):
    volume = view(spark, sf_dir, "fx_games").groupBy("team", "gi").agg(F.sum("targets").alias("t"), F.sum("receptions").alias("n"))
    return volume.select("team", "gi", r4(windows.trailing_mean("t", ["team"], ["gi"], 3)).alias("targets_3"), r4(windows.trailing_mean("n", ["team"], ["gi"], 3)).alias("plays_3"))


@query("pit_defense_state", """
    with a as (select (team + gi) % 25 as def, gi, cast(sum(disc - tax) as double) as e, count(*) as n from fx_plays group by 1, 2)
    select def, gi, round((sum(e) over w + 150 * 1.0::double) / (sum(n) over w + 150), 5) as epa_allowed from a window w as (partition by def order by gi rows unbounded preceding)""")
def pit_defense_state(spark, sf_dir):
    allowed = view(spark, sf_dir, "fx_plays").groupBy(((F.col("team") + F.col("gi")) % 25).alias("def"), "gi").agg(
        F.sum(F.col("disc") - F.col("tax")).alias("e"), F.count("*").alias("n")
    )
    w = windows.last_rows(["def"], ["gi"], None)
    return allowed.select("def", "gi", rounded((F.sum("e").over(w) + 150 * 1.0) / (F.sum("n").over(w) + 150), 5).alias("epa_allowed"))


@query("pit_leader_state", f"""
    with {LEADERS}, q as (select leader, gi, cast(sum(disc - tax) as double) as e, count(*) as n from fx_plays group by leader, gi),
    qs as (select leader, gi, (sum(e) over w + 200 * 1.0::double) / (sum(n) over w + 200) as eff from q window w as (partition by leader order by gi rows unbounded preceding)),
    t as (select s.team, s.gi, (select max_by(l.leader, l.gi) from l where l.team = s.team and l.gi < s.gi) as leader from fx_schedule s)
    select t.team, t.gi, t.leader, round((select max_by(qs.eff, qs.gi) from qs where qs.leader = t.leader and qs.gi < t.gi), 5) as eff from t where t.leader is not null""")
def pit_leader_state(spark, sf_dir):
    """Two hops: the team's last leader, then that leader's state, both strictly before the target month."""
    targets = view(spark, sf_dir, "fx_schedule").select("team", "gi")
    last = joins.asof_strict(targets, leaders(spark, sf_dir), ["team"], "gi", ["leader"]).where("leader is not null")
    path = scratch(spark, "leaders")
    write_once(last, path)  # a row for each team and month, read for the plays of those who lead a team too
    last = spark.read.parquet(path)
    plays = view(spark, sf_dir, "fx_plays").join(F.broadcast(last.select("leader").distinct()), "leader", "left_semi")
    own = plays.groupBy("leader", "gi").agg(F.sum(F.col("disc") - F.col("tax")).alias("e"), F.count("*").alias("n"))
    w = windows.last_rows(["leader"], ["gi"], None)
    eff = own.select("leader", "gi", ((F.sum("e").over(w) + 200 * 1.0) / (F.sum("n").over(w) + 200)).alias("eff"))
    return joins.asof_strict(last, eff, ["leader"], "gi", ["eff"]).select("team", "gi", "leader", rounded(F.col("eff"), 5).alias("eff"))


@query("pit_features_m1", """
    with st as (select k, gi, season, avg(pts) over (partition by k order by gi rows between 2 preceding and current row) as roll3,
        avg(pts) over (partition by k, season order by gi rows unbounded preceding) as smean, row_number() over (partition by k order by gi) as career from fx_games),
    t as (select t.k, t.team, t.gi, t.season, (select max(s.gi) from st s where s.k = t.k and s.gi < t.gi) as sg from fx_targets t),
    tv as (select team, gi, avg(x) over (partition by team order by gi rows between 2 preceding and current row) as team3 from (select team, gi, sum(targets) as x from fx_games group by team, gi)),
    ps as (select k, season + 1 as season, avg(pts) as prev from fx_games group by k, season)
    select t.k, t.gi, round(st.roll3, 4) as roll3, case when st.season = t.season then round(st.smean, 4) end as season_mean, coalesce(st.career, 0) as career,
        round(ps.prev, 4) as prev_mean, round((select max_by(tv.team3, tv.gi) from tv where tv.team = t.team and tv.gi < t.gi), 4) as team3
    from t left join st on st.k = t.k and st.gi = t.sg left join ps on ps.k = t.k and ps.season = t.season""")
def pit_features_m1(spark, sf_dir):
    rows = features.feature_rows(view(spark, sf_dir, "fx_targets", True).select("k", "team", "gi", "season"), view(spark, sf_dir, "fx_games", True), unmoved=view(spark, sf_dir, "fx_games"))
    return rows.select("k", "gi", r4("roll3").alias("roll3"), r4("season_mean").alias("season_mean"), "career", r4("prev_mean").alias("prev_mean"), r4("team3").alias("team3"))


def _context(spark, sf_dir):
    """One row per team and month: opponent, home, and what was known of team, opponent and leader strictly before."""
    games = view(spark, sf_dir, "fx_games")
    volume = games.groupBy("team", "gi").agg(F.sum("targets").alias("t"), F.max("targets").alias("top"))
    team = volume.select(
        "team", "gi", windows.trailing_mean("t", ["team"], ["gi"], 8).alias("team_targets_8"),
        F.avg(F.col("top") / F.col("t")).over(windows.last_rows(["team"], ["gi"], 8)).alias("top_share_8"),
    )
    allowed = games.groupBy(((F.col("team") + F.col("gi")) % 25).alias("opponent"), "gi").agg(F.sum("pts").alias("x"))
    defense = allowed.select("opponent", "gi", windows.trailing_mean("x", ["opponent"], ["gi"], 8).alias("allowed_8"))
    leader = pit_leader_state(spark, sf_dir).select("team", "gi", "leader", F.col("eff").alias("leader_eff"))
    rows = view(spark, sf_dir, "fx_schedule").select("team", "gi", "opponent", "home")
    rows = joins.asof_strict(rows, team, ["team"], "gi", ["team_targets_8", "top_share_8"])
    return joins.asof_strict(rows, defense, ["opponent"], "gi", ["allowed_8"]).join(leader, ["team", "gi"], "left")


FEATURES_M2 = ["roll3", "season_mean", "prev_mean", "team3", *M2_PARTS, "team_targets_8", "top_share_8", "allowed_8", "log_pick"]
PLAIN_M2 = ["career", "opponent", "home", "leader", "rest", "age", "experience", "rookie", "undrafted", "no_previous", "no_games"]


@query("pit_features_m2", f"""
    with {LEADERS}, {STATE_M2}, st as (select k, gi, season, avg(pts) over (partition by k order by gi rows between 2 preceding and current row) as roll3,
        avg(pts) over (partition by k, season order by gi rows unbounded preceding) as smean, row_number() over (partition by k order by gi) as career from fx_games),
    t as (select t.*, (select max(s.gi) from st s where s.k = t.k and s.gi < t.gi) as sg from fx_targets t),
    vo as (select team, gi, sum(targets) as t, max(targets) as top from fx_games group by team, gi),
    tv as (select team, gi, avg(t) over (partition by team order by gi rows between 2 preceding and current row) as team3, avg(t) over w as team_targets_8, avg(cast(top as double) / t) over w as top_share_8 from vo window w as (partition by team order by gi rows between 7 preceding and current row)),
    al as (select (team + gi) % 25 as opponent, gi, sum(pts) as x from fx_games group by 1, 2),
    df as (select opponent, gi, avg(x) over (partition by opponent order by gi rows between 7 preceding and current row) as allowed_8 from al),
    cx as (select s.team, s.gi, s.opponent, s.home, (select max_by(l.leader, l.gi) from l where l.team = s.team and l.gi < s.gi) as leader,
        (select max(v.gi) from tv v where v.team = s.team and v.gi < s.gi) as tg, (select max(d.gi) from df d where d.opponent = s.opponent and d.gi < s.gi) as dg from fx_schedule s),
    ps as (select k, season + 1 as season, avg(pts) as prev_mean from fx_games group by k, season),
    j as (select t.k, t.gi, st.roll3, case when st.season = t.season then st.smean end as season_mean, coalesce(st.career, 0) as career, ps.prev_mean, tw.team3, cx.opponent, cx.home, cx.leader, tv.team_targets_8, tv.top_share_8, df.allowed_8,
        case when st.season = t.season then t.week - s2.last_week end as rest, t.season - b.born as age, t.season - b.first_season as experience, coalesce(t.season - b.first_season = 0, false) as rookie, b.pick is null as undrafted,
        ln(coalesce(b.pick, 300)::double) as log_pick, ps.prev_mean is null as no_previous, not coalesce(st.season = t.season, false) as no_games, {", ".join(f"s2.{c}" for c in M2_PARTS)}
      from t left join st on st.k = t.k and st.gi = t.sg left join s2 on s2.k = t.k and s2.gi = t.sg left join ps on ps.k = t.k and ps.season = t.season left join cx on cx.team = t.team and cx.gi = t.gi
      left join tv on tv.team = cx.team and tv.gi = cx.tg left join tv tw on tw.team = t.team and tw.gi = cx.tg left join df on df.opponent = cx.opponent and df.gi = cx.dg left join fx_bio b on b.k = t.k)
    select k, gi, {", ".join(PLAIN_M2)}, {", ".join(f"round({c}, 4) as {c}" for c in FEATURES_M2)} from j""")
def pit_features_m2(spark, sf_dir):
    """The first feature row, the second player state, the context of the team's game, and what is fixed about the player."""
    targets = view(spark, sf_dir, "fx_targets", True).select("k", "team", "gi", "season", "week")
    rows = features.feature_rows(targets, view(spark, sf_dir, "fx_games", True), unmoved=view(spark, sf_dir, "fx_games"))
    state = features.player_state_m2(view(spark, sf_dir, "fx_usage", True), "k", "gi", RECENT, TRENDS)
    out = features.feature_rows_m2(rows, state, _context(spark, sf_dir), view(spark, sf_dir, "fx_bio"))
    return out.select("k", "gi", *PLAIN_M2, *(r4(c).alias(c) for c in FEATURES_M2))


DETAIL = """
    de as (select k, team, day, max_by(designation, (ts, event_id)) as designation, max_by(practice, (ts, event_id)) as practice, max_by(injury, (ts, event_id)) as injury from fx_details where ts < cutoff group by k, team, day),
    sc as (select distinct team, day from fx_details), tg as (select k, sc.team, sc.day from (select distinct k, team from fx_details) p join sc on sc.team = p.team)"""


def _detail(spark, sf_dir):
    """The last report of each player and day before the day's cutoff."""
    last = lambda c: F.max_by(c, F.struct("ts", "event_id")).alias(c)
    rows = view(spark, sf_dir, "fx_details").where("ts < cutoff").groupBy("k", "team", "day").agg(*map(last, ("designation", "practice", "injury")))
    return rows.select("k", "team", "day", "designation", "practice", features.body_part(F.col("injury")).alias("body"))


@query("pit_availability", f"""
    with {DETAIL}, g as (select tg.*, de.designation, de.practice, case when de.injury ilike '%knee%' then 'knee' when de.injury ilike '%ankle%' then 'leg' when de.injury ilike '%illness%' then 'illness' when de.injury is not null then 'other' end as body,
        de.designation is not null as listed, row_number() over (partition by tg.k order by tg.day) as i from tg left join de on de.k = tg.k and de.day = tg.day),
    s as (select *, i - 1 - coalesce(max(case when not listed then i end) over (partition by k order by i rows between unbounded preceding and 1 preceding), 0) as streak, lag(designation) over (partition by k order by i) as previous from g)
    select k, day, coalesce(designation, 'none') as designation, coalesce(practice, 'none') as practice, coalesce(body, 'none') as body, coalesce(previous, 'none') as previous, streak,
        case when listed then 'listed' when exists (select 1 from de where de.team = s.team and de.day = s.day) then 'not_listed' else 'no_team_report' end as report_state from s""")
def pit_availability(spark, sf_dir):
    details = view(spark, sf_dir, "fx_details")
    schedule = details.select("team", "day").distinct()
    targets = details.select("k", "team").distinct().join(schedule, "team").select("k", "team", "day")
    out = features.availability(targets, _detail(spark, sf_dir), schedule)
    return out.select("k", "day", "designation", "practice", "body", "previous", "streak", "report_state")


#: Probability of activity by designation, and what a limited or missing practice takes off: fixed values.
ACTIVE, PRACTICE = {"Out": 0.0, "Doubtful": 0.1, "Questionable": 0.7, "Listed": 0.95, "Note": 0.99}, {"none": 0.5, "limited": 0.9, "full": 1.0}


def _case(column: str, values: dict) -> str:
    return f"case {column} {' '.join(f'when {k!r} then {v}::double' for k, v in values.items())} end"


@query("pit_live_availability", f"""
    with d as (select day, team, max(ts) >= max(cutoff) - interval 6 hour as final from fx_details group by day, team),
    r as (select x.*, d.final from fx_details x join d using (day, team) where x.ts < x.cutoff),
    last as (select k, day, bool_or(final) as final, max_by(designation, (ts, event_id)) as designation, max_by(practice, (ts, event_id)) as practice from r group by k, day),
    lg as (select *, lag(designation) over (partition by k order by day) as previous from last)
    select k, day, case when final then designation else 'none' end as designation, coalesce(previous, 'none') as previous,
        case when final then round({_case("designation", ACTIVE)} * {_case("practice", PRACTICE)}, 4) else 1.0::double end as p_active from lg""")
def pit_live_availability(spark, sf_dir):
    """The target day counts only where the team's final report is out; earlier days feed the lag; status and practice give P(active)."""
    from pitstats.functions.scalars import lookup

    reports = view(spark, sf_dir, "fx_details")
    final = reports.groupBy("day", "team").agg((F.max("ts") >= F.max("cutoff") - F.expr("interval 6 hours")).alias("final"))
    latest = lambda c: F.max_by(c, F.struct("ts", "event_id")).alias(c)
    known = reports.where("ts < cutoff").join(final, ["day", "team"]).groupBy("k", "day").agg(F.bool_or("final").alias("final"), latest("designation"), latest("practice"))
    known = known.withColumn("previous", F.coalesce(windows.previous("designation", ["k"], ["day"]), F.lit("none")))
    p = rounded(lookup(F.col("designation"), ACTIVE) * lookup(F.col("practice"), PRACTICE), 4)
    return known.select(
        "k", "day", F.when(F.col("final"), F.col("designation")).otherwise("none").alias("designation"), "previous", F.when(F.col("final"), p).otherwise(1.0).alias("p_active")
    )


@query("version_asof", """
    with g as (select distinct k, day, cast(day as timestamp) + interval 16 hour as at_time from fx_captures)
    select g.k, g.day, (select max_by(c.v, (c.ts, c.event_id)) from fx_captures c where c.k = g.k and c.ts < g.at_time) as v from g""")
def version_asof(spark, sf_dir):
    """The version of a row committed strictly before two hours ahead of kickoff at 18:00."""
    versions = view(spark, sf_dir, "fx_captures")
    games = versions.select("k", "day").distinct().withColumn("at_time", F.col("day").cast("timestamp_ntz") + F.expr("interval 16 hours"))
    return joins.latest_before(versions, games, ["k"], "ts", "at_time", ["v"], ["event_id"]).select("k", "day", "v")


@query("pit_asof_lines", """
    with v as (select k % 25 as team, ts, event_id, v from fx_captures), g as (select distinct k % 25 as team, day, cast(day as timestamp) + interval 16 hour as at_time from fx_captures),
    a as (select g.team, g.day, (select max_by(v.v, (v.ts, v.event_id)) from v where v.team = g.team and v.ts < g.at_time) as total from g)
    select team, day, true as home, total / 2 as implied from a where total is not null union all select (team + 1) % 25, day, false, total / 2 from a where total is not null""")
def pit_asof_lines(spark, sf_dir):
    versions = view(spark, sf_dir, "fx_captures").select((F.col("k") % 25).alias("team"), "ts", "event_id", "v", "day")
    games = versions.select("team", "day").distinct().withColumn("at_time", F.col("day").cast("timestamp_ntz") + F.expr("interval 16 hours"))
    known = joins.latest_before(versions.drop("day"), games, ["team"], "ts", "at_time", ["v"], ["event_id"]).where("v is not null")
    sides = F.explode(F.array(F.struct(F.col("team").alias("t"), F.lit(True).alias("home")), F.struct(((F.col("team") + 1) % 25).alias("t"), F.lit(False).alias("home"))))
    return known.select("day", (F.col("v") / 2).alias("implied"), sides.alias("s")).select(F.col("s.t").alias("team"), "day", F.col("s.home").alias("home"), "implied")


@query("lineage_window", """
    with st as (select k, gi, avg(pts) over (partition by k order by gi rows between 2 preceding and current row) as roll from fx_games where season >= 1999)
    select t.k, t.gi, round((select max_by(s.roll, s.gi) from st s where s.k = t.k and s.gi < t.gi), 4) as roll from fx_targets t""")
def lineage_window(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games").where("season >= 1999")
    states = games.select("k", "gi", windows.trailing_mean("pts", ["k"], ["gi"], 3).alias("roll"))
    return joins.asof_strict(view(spark, sf_dir, "fx_targets").select("k", "gi"), states, ["k"], "gi", ["roll"]).select("k", "gi", r4("roll").alias("roll"))


@query("study_frame", """
    select p.k, p.gi, p.position, coalesce(g.snap_share >= 0.1, g.receptions > 0) as active, p.proj as base, round(p.actual - p.proj, 4) as residual, coalesce(g.snap_share, 0) as snap_fill
    from fx_proj p join fx_games g on g.k = p.k and g.gi = p.gi where p.proj > 0""")
def study_frame(spark, sf_dir):
    games = view(spark, sf_dir, "fx_games").select("k", "gi", "snap_share", "receptions")
    df = view(spark, sf_dir, "fx_proj").where("proj > 0").join(games, ["k", "gi"])
    return df.select(
        "k", "gi", "position", F.coalesce(F.col("snap_share") >= 0.1, F.col("receptions") > 0).alias("active"), F.col("proj").alias("base"),
        r4(F.col("actual") - F.col("proj")).alias("residual"), F.coalesce("snap_share", F.lit(0.0)).alias("snap_fill"),
    )


@query("info_firewall", "select k, gi, proj, case when gi < 200001 then actual end as actual from fx_proj where gi <= 200001")
def info_firewall(spark, sf_dir):
    return features.visible_at(view(spark, sf_dir, "fx_proj").select("k", "gi", "proj", "actual"), "gi", 200001, outcomes=["actual"])
