"""Derived views over the given tables: the inputs of the registered queries.

Customers stand for players, market segments for positions, nations for teams, months for weeks, line items for plays
and events for captures. Each view is one SQL text that Spark and DuckDB read alike, in whole numbers up to the last
step so that sums don't depend on their order.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitstats.sources.documents import scratch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")

VIEWS = {
    "fx_plays": """
        select l.l_orderkey as ok, l.l_linenumber as ln, o.o_custkey as k, cast(c.c_nationkey as bigint) as team,
            c.c_mktsegment as position, cast(year(o.o_orderdate) as bigint) as season,
            cast(month(o.o_orderdate) as bigint) as week, cast(year(o.o_orderdate) * 100 + month(o.o_orderdate) as bigint) as gi,
            l.l_suppkey as leader, l.l_returnflag as play_type, l.l_linestatus as result,
            cast(l.l_quantity as bigint) as yards, cast(round(l.l_extendedprice * 100) as bigint) as cents,
            cast(round(l.l_discount * 100) as bigint) as disc, cast(round(l.l_tax * 100) as bigint) as tax
        from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey join {customer} c on o.o_custkey = c.c_custkey""",
    "fx_totals": """
        select o_custkey as k, cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint) as gi,
            cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as total, cast(count(*) as bigint) as n_orders
        from {orders} group by o_custkey, year(o_orderdate) * 100 + month(o_orderdate)""",
    "fx_games": """
        select p.k, p.gi, p.season, p.week, p.team, p.position,
            cast(sum(p.cents * (100 - p.disc)) as double) / 10000000 as pts, cast(sum(p.yards) as bigint) as targets,
            cast(count(*) as bigint) as receptions, cast(sum(p.cents) as double) / 100000 as yards,
            cast(max(t.total) as double) / 100000 as xfp,
            case when p.week % 5 = 0 then null else cast(sum(p.tax) as double) / count(*) / 10 end as snap_share
        from {fx_plays} p join {fx_totals} t on p.k = t.k and p.gi = t.gi
        group by p.k, p.gi, p.season, p.week, p.team, p.position""",
    "fx_usage": """
        select g.k, g.gi, g.season, g.week, g.team, g.position, g.pts, g.targets, g.receptions, g.yards, g.xfp, g.snap_share,
            p.rz, p.deep, p.carries, p.air, p.yac, cast(g.targets as double) / t.targets as target_share,
            cast(p.air as double) / nullif(t.air, 0) as air_share, cast(p.rz as double) / nullif(t.rz, 0) as rz_share
        from {fx_games} g
        join (select k, gi, cast(count(case when disc >= 8 then 1 end) as bigint) as rz, cast(count(case when yards >= 40 then 1 end) as bigint) as deep,
                cast(count(case when play_type = 'R' then 1 end) as bigint) as carries, cast(sum(disc) as bigint) as air, cast(sum(tax) as bigint) as yac
            from {fx_plays} group by k, gi) p on p.k = g.k and p.gi = g.gi
        join (select team, gi, cast(sum(yards) as bigint) as targets, cast(count(case when disc >= 8 then 1 end) as bigint) as rz, cast(sum(disc) as bigint) as air
            from {fx_plays} group by team, gi) t on t.team = g.team and t.gi = g.gi""",
    "fx_bio": """
        select cast(c_custkey as bigint) as k, case when c_custkey % 4 = 0 then null else cast(c_custkey % 250 + 1 as bigint) end as pick,
            cast(1960 + c_custkey % 30 as bigint) as born, cast(1990 + c_custkey % 8 as bigint) as first_season
        from {customer}""",
    "fx_schedule": """
        select n.team, m.gi, m.season, m.week, (n.team + m.gi) % 25 as opponent, (n.team + m.gi) % 2 = 0 as home,
            m.gi < mx.last as final, m.cents
        from (select cast(n_nationkey as bigint) as team from {nation}) n
        cross join (select gi, min(season) as season, min(week) as week, cast(sum(cents) as bigint) as cents from {fx_plays} group by gi) m
        cross join (select max(gi) as last from {fx_plays}) mx""",
    "fx_targets": """
        select c.k, c.team, c.position, m.gi, m.season, m.week
        from (select c_custkey as k, cast(c_nationkey as bigint) as team, c_mktsegment as position from {customer}) c
        cross join (select distinct gi, season, week from {fx_plays}) m
        where m.season >= (select max(season) - 1 from {fx_plays})""",
    "fx_proj": """
        select g.k, g.gi, g.season, g.week, g.team, g.position, g.pts as actual,
            case when g.k % 17 = 0 then null else cast(t.total as double) / 100000 end as proj,
            g.targets as c1, g.receptions as c2, g.yards as c3
        from {fx_games} g join {fx_totals} t on g.k = t.k and g.gi = t.gi""",
    "fx_reports": """
        select event_id, user_id as k, cast(ts as date) as day, ts,
            cast(ts as date) + interval '18' hour as cutoff,
            case event_type when 'error' then 'Out' when 'click' then 'Questionable' when 'view' then 'Doubtful'
                when 'signup' then 'Listed' else 'Note' end as status
        from {events}""",
    "fx_details": """
        select event_id, user_id as k, user_id % 25 as team, cast(ts as date) as day, ts, cast(ts as date) + interval '18' hour as cutoff,
            case event_type when 'error' then 'Out' when 'click' then 'Questionable' when 'view' then 'Doubtful' when 'signup' then 'Listed' else 'Note' end as designation,
            case when value < 20 then 'none' when value < 60 then 'limited' else 'full' end as practice,
            case event_id % 4 when 0 then 'left knee' when 1 then 'Knee' when 2 then 'Ankle ' else 'illness' end as injury
        from {events}""",
    "fx_captures": """
        select event_id, user_id as k, ts, cast(ts as date) as day, value as v, event_type from {events}""",
    "fx_ids": """
        select 'a' as source, c_custkey as a_id, case when c_custkey % 50 = 0 then c_custkey + 1 else c_custkey end as b_id, c_name as name from {customer} where c_custkey % 31 <> 0
        union all
        select 'b', c_custkey, case when c_custkey % 97 = 0 then c_custkey - 1 else c_custkey end, c_name from {customer}
        union all
        select 'c', c_custkey, c_custkey, case when c_custkey % 7 = 0 then c_name || ' Jr.' else c_name end from {customer} where c_custkey % 3 <> 0""",
    "fx_prob": """
        select d.doc_id, least(0.99, greatest(0.01, cast(d.n_chars as double) / 8000)) as p, cast(l.quality as bigint) as o,
            d.lang as class, d.source as cluster
        from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    "fx_arms": """
        select season, team as cluster, week, play_type as arm, cast(sum(cents * (100 - disc)) as double) / 10000000 as points
        from {fx_plays} group by season, team, week, play_type""",
    "fx_matchups": """
        select s.gi as period, s.team as home, (s.team + 1 + s.gi % 23) % 25 as away,
            cast(coalesce(h.c, 0) as double) / 10000 as home_points, cast(coalesce(a.c, 0) as double) / 10000 as away_points,
            case when coalesce(h.c, 0) > coalesce(a.c, 0) then 'HOME' when coalesce(h.c, 0) < coalesce(a.c, 0) then 'AWAY' else 'TIE' end as winner
        from {fx_schedule} s
        left join (select team, gi, cast(sum(cents) as bigint) as c from {fx_plays} group by team, gi) h on h.team = s.team and h.gi = s.gi
        left join (select team, gi, cast(sum(cents) as bigint) as c from {fx_plays} group by team, gi) a
            on a.team = (s.team + 1 + s.gi % 23) % 25 and a.gi = s.gi""",
}

#: How Spark derives views with the same rows from less data on the move. Line items are summed per order before they
#: meet anything, orders per customer and month together with their totals; what a view wants of a customer's month
#: is then read from these sums, in whole numbers. Plays meet orders that have met customers, so they are moved once.
#: Rows are moved before they are summed, to `{parts}` partitions that grow in number with the tables and not in size:
#: sums of a whole map task, or of partitions that adaptive execution has joined, outgrow an executor's memory and spill.
#: `m` counts a customer's equal rows and `m_all` all rows of its key, as a join with plays would repeat them.
DERIVED = {
    "fx_months": """
        with p as (
            select ok, sum(cents * (100 - disc)) as net, sum(yards) as yards, count(*) as n, sum(cents) as cents, sum(tax) as tax,
                count(case when disc >= 8 then 1 end) as rz, count(case when yards >= 40 then 1 end) as deep,
                count(case when play_type = 'R' then 1 end) as carries, sum(disc) as air
            from (select /*+ REPARTITION({parts}, ok) */ l_orderkey as ok, l_returnflag as play_type, cast(l_quantity as bigint) as yards, cast(round(l_extendedprice * 100) as bigint) as cents,
                cast(round(l_discount * 100) as bigint) as disc, cast(round(l_tax * 100) as bigint) as tax from {lineitem})
            group by ok
        ), o as (
            select /*+ REPARTITION({parts}, k) */ o_custkey as k, cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint) as gi,
                cast(round(o_totalprice * 100) as bigint) as total, p.*
            from (select /*+ REPARTITION({parts}, o_orderkey) */ o_orderkey, o_custkey, o_orderdate, o_totalprice from {orders}) left join p on p.ok = o_orderkey
        ), g as (
            select k, gi, sum(total) as total, sum(net) as net, sum(yards) as yards, sum(n) as n, sum(cents) as cents, sum(tax) as tax,
                sum(rz) as rz, sum(deep) as deep, sum(carries) as carries, sum(air) as air
            from o group by k, gi
        ), c as (
            select k, team, position, m, sum(m) over (partition by k) as m_all
            from (select c_custkey as k, cast(c_nationkey as bigint) as team, c_mktsegment as position, count(*) as m from {customer} group by all)
        )
        select g.*, gi div 100 as season, gi % 100 as week, team, position, m, m_all from g join c on g.k = c.k where n > 0""",
    "fx_plays": """
        select l.l_orderkey as ok, l.l_linenumber as ln, o.k, o.team, o.position, o.season, o.week, o.gi,
            l.l_suppkey as leader, l.l_returnflag as play_type, l.l_linestatus as result,
            cast(l.l_quantity as bigint) as yards, cast(round(l.l_extendedprice * 100) as bigint) as cents,
            cast(round(l.l_discount * 100) as bigint) as disc, cast(round(l.l_tax * 100) as bigint) as tax
        from (select /*+ REPARTITION({parts}, l_orderkey) */ * from {lineitem}) l join (
            select /*+ REPARTITION({parts}, o_orderkey) */ o_orderkey, o_custkey as k, cast(c_nationkey as bigint) as team, c_mktsegment as position, cast(year(o_orderdate) as bigint) as season,
                cast(month(o_orderdate) as bigint) as week, cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint) as gi
            from {orders} join {customer} on o_custkey = c_custkey) o on l.l_orderkey = o.o_orderkey""",
    "fx_games": """
        select k, gi, season, week, team, position, cast(net * m as double) / 10000000 as pts, yards * m as targets, n * m as receptions,
            cast(cents * m as double) / 100000 as yards, cast(total as double) / 100000 as xfp,
            case when week % 5 = 0 then null else cast(tax * m as double) / (n * m) / 10 end as snap_share
        from {fx_months} where gi is not null""",
    "fx_usage": """
        select g.k, g.gi, g.season, g.week, g.team, g.position, cast(net * m as double) / 10000000 as pts, yards * m as targets, n * m as receptions,
            cast(cents * m as double) / 100000 as yards, cast(total as double) / 100000 as xfp,
            case when week % 5 = 0 then null else cast(tax * m as double) / (n * m) / 10 end as snap_share,
            rz * m_all as rz, deep * m_all as deep, carries * m_all as carries, air * m_all as air, tax * m_all as yac,
            cast(yards * m as double) / t.t_targets as target_share, cast(air * m_all as double) / nullif(t.t_air, 0) as air_share,
            cast(rz * m_all as double) / nullif(t.t_rz, 0) as rz_share
        from {fx_months} g
        join (select team, gi, sum(yards * m) as t_targets, sum(rz * m) as t_rz, sum(air * m) as t_air from {fx_months} group by team, gi) t
            on t.team = g.team and t.gi = g.gi""",
    "fx_proj": """
        select k, gi, season, week, team, position, pts as actual, case when k % 17 = 0 then null else xfp end as proj,
            targets as c1, receptions as c2, yards as c3
        from {fx_games}""",
    "fx_schedule": VIEWS["fx_schedule"].replace("sum(cents)", "sum(cents * m)").replace("{fx_plays}", "{fx_months}"),
    "fx_targets": VIEWS["fx_targets"].replace("{fx_plays}", "{fx_months}"),
    "fx_matchups": VIEWS["fx_matchups"].replace("sum(cents)", "sum(cents * m)").replace("{fx_plays}", "{fx_months}"),
}

#: The same rows lying by player: months and customers are moved before columns are made and months filled in, so that
#: windows and joins by player move nothing more. There are as many partitions of each, and never fewer than Spark would
#: make, which would then move them again.
BY_PLAYER = {
    "fx_games": DERIVED["fx_games"].replace("from {fx_months}", "from (select /*+ REPARTITION({parts}, k) */ * from {fx_months})"),
    "fx_usage": DERIVED["fx_usage"].replace("from {fx_months} g\n", "from (select /*+ REPARTITION({parts}, k) */ * from {fx_months}) g\n").replace("select g.k", "select /*+ BROADCAST(t) */ g.k", 1),
    "fx_targets": DERIVED["fx_targets"].replace("(select c_custkey", "(select /*+ REPARTITION({parts}, k) */ c_custkey").replace("select c.k", "select /*+ BROADCAST(m) */ c.k", 1),
}


def _text(name: str) -> str:
    return DERIVED.get(name) or VIEWS[name]


def _needs(text: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text)) if n != "parts"]


#: Bytes of the tables' files for which one partition is made.
PART_BYTES = 4 << 20
#: Views that several others and most queries read, and where each application has written them for a state of the tables.
WRITTEN = ("fx_plays", "fx_totals", "fx_months")
_places: dict[tuple[str, str, str, str], str] = {}


def forget(application: str | None = None) -> None:
    """Views written by an application, or by any, are derived anew when they are next read."""
    for place in [p for p in _places if application in (None, p[0])]:
        del _places[place]


def _tables(name: str) -> set[str]:
    """The given tables that a view comes from."""
    return {name} if name in TABLES else {t for n in _needs(_text(name)) for t in _tables(n)}


def _state(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, int]:
    """Paths, sizes and times of the files behind a view, as a hash; and their bytes."""
    found, size = [], 0
    for table in sorted(_tables(name)):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            file = files.next()
            found.append(f"{file.getPath()} {file.getLen()} {file.getModificationTime()}")
            size += file.getLen()
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest(), size


def view(spark: SparkSession, sf_dir: str, name: str, by_player: bool = False) -> DataFrame:
    """A given table or a derived view; `by_player` for one of `BY_PLAYER` as it is there.

    The views that all others come from join three tables; an application derives these once for a folder of tables,
    writes them to the shared folder and reads them from there, so that a query's branches don't derive them again.
    Where a file of the tables behind a view has changed, has come or has gone, it is derived anew.
    """
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = BY_PLAYER[name] if by_player else _text(name)
    if by_player:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _state(spark, sf_dir, name)[1] // PART_BYTES)
        text = text.replace("{parts}", str(parts))
    needs = lambda: {n: view(spark, sf_dir, n) for n in _needs(text)}
    if name not in WRITTEN:
        return spark.sql(text, **needs())
    state, size = _state(spark, sf_dir, name)
    place = (spark.sparkContext.applicationId, sf_dir, name, state)
    if place in _places:
        try:
            return spark.read.parquet(_places[place])
        except AnalysisException:  # the shared folder was cleared: derived anew
            del _places[place]
    path = scratch(spark, name)
    spark.sql(text.replace("{parts}", str(max(8, size // PART_BYTES))), **needs()).write.parquet(path)
    _places[place] = path
    return spark.read.parquet(path)


def _order(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for n in names:
        if n in VIEWS and n not in seen:
            _order(tuple(_needs(VIEWS[n])), seen)
            seen.append(n)
    return seen


#: Added before rounding to 3 to 6 places. Many results are means of amounts with few decimals and lie exactly between
#: two rounded values, where engines differ; off the middle none does.
OFF = 0.13731234567


def rounded(column, places: int):
    """A column rounded for comparison."""
    return F.round(column + OFF * 10**-places, places)


def with_views(body: str) -> str:
    """SQL that refers to views by name, with their definitions in front; `round` to 3 to 6 places is as in `rounded`."""
    body = re.sub(r", ([3-6])\)", lambda m: f" + {OFF * 10 ** -int(m[1])!r}::double, {m[1]})", body)
    used = tuple(n for n in VIEWS if re.search(rf"\b{n}\b", body))
    parts = [f"{n} as ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])}\n)" for n in _order(used, [])]
    body = body.strip()
    if not parts:
        return body
    if re.match(r"with\s+recursive\b", body, re.I):
        return "with recursive " + ",\n".join(parts) + ",\n" + body[len("with recursive"):].lstrip()
    if re.match(r"with\b", body, re.I):
        return "with " + ",\n".join(parts) + ",\n" + body[4:].lstrip()
    return "with " + ",\n".join(parts) + "\n" + body
