"""Queries of sources, sinks, archives and official records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitstats.operators import archive, joins
from pitstats.plans.registry import query
from pitstats.sources import documents as docs
from pitstats.sources.fixtures import rounded, view


def r4(column, places=4):
    return rounded(F.col(column) if isinstance(column, str) else column, places)


def _player_documents(spark, sf_dir):
    """Vendor documents in their nested form, per month one for each thousand player numbers, as JSON text made from the
    projections; no document grows with the number of players."""
    rows = view(spark, sf_dir, "fx_proj").where("proj is not null")

    def entry(source, total):
        return F.struct(
            F.col("season").cast("int").alias("seasonId"), F.col("week").cast("int").alias("scoringPeriodId"), F.lit(source).alias("statSourceId"),
            F.lit(1).alias("statSplitTypeId"), F.col(total).alias("appliedTotal"),
            F.create_map(F.lit("53"), F.col("c2").cast("double"), F.lit("58"), F.col("c1").cast("double")).alias("stats"),
        )

    player = F.struct(F.col("k").alias("id"), F.lit("n").alias("fullName"), F.lit(3).alias("position"), F.array(entry(0, "actual"), entry(1, "proj")).alias("stats"))
    return rows.groupBy("gi", F.floor(F.col("k") / 1000)).agg(F.to_json(F.struct(F.collect_list(player).alias("players"))).alias("text"))


@query("scan_json", "select k as id, season, week as period, round(proj, 4) as total from fx_proj where proj is not null")
def scan_json(spark, sf_dir):
    parsed = docs.parse_players(_player_documents(spark, sf_dir), "text", source=1)
    return parsed.select("id", F.col("season").cast("long").alias("season"), F.col("period").cast("long").alias("period"), r4("total").alias("total"))


@query("scan_json_long", """
    select k as id, season, week as period, 'receptions' as stat, cast(c2 as double) as value from fx_proj where proj is not null
    union all select k, season, week, 'targets', cast(c1 as double) from fx_proj where proj is not null""")
def scan_json_long(spark, sf_dir):
    entries = docs.parse_players(_player_documents(spark, sf_dir), "text", source=0)
    return docs.long_stats(entries, {"53": "receptions", "58": "targets"}).select("id", F.col("season").cast("long").alias("season"), F.col("period").cast("long").alias("period"), "stat", "value")


@query("json_state", "select period, home, away, winner, (period // 100 - 1970)::bigint as years from fx_matchups")
def json_state(spark, sf_dir):
    """League documents: a schedule array parsed back into a table, with an instant in milliseconds."""
    games = view(spark, sf_dir, "fx_matchups")
    ms = F.floor(F.col("period") / 100 - 1970) * 365 * 86_400_000 + F.floor((F.floor(F.col("period") / 100) - 1969) / 4) * 86_400_000
    text = games.groupBy("period").agg(F.to_json(F.struct(F.collect_list(F.struct("home", "away", "winner", ms.cast("long").alias("at"))).alias("schedule"))).alias("text"))
    parsed = text.select("period", F.from_json("text", "schedule array<struct<home bigint, away bigint, winner string, at bigint>>").alias("d"))
    rows = parsed.select("period", F.explode_outer("d.schedule").alias("s"))
    return rows.select("period", "s.home", "s.away", "s.winner", (F.year(F.timestamp_millis("s.at")) - 1970).cast("long").alias("years"))


@query("capture_latest", """
    select event_id, event_type, ts, v from fx_captures c where ts = (select max(ts) from fx_captures d where d.event_type = c.event_type and d.ts <= timestamp '2024-01-15 12:00:00')""")
def capture_latest(spark, sf_dir):
    at = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return docs.latest_capture(view(spark, sf_dir, "fx_captures"), "event_type", "ts", at).select("event_id", "event_type", "ts", "v")


@query("scan_captures", "select strftime(day, '%Y-%m-%d') as capture_day, count(*) as n, round(sum(v), 2) as total from fx_captures group by day")
def scan_captures(spark, sf_dir):
    """Captures written by day and read back with the day taken from the path."""
    path = docs.scratch(spark, "captures")
    rows = view(spark, sf_dir, "fx_captures").select("event_id", "v", F.date_format("day", "yyyy-MM-dd").alias("d"))
    docs.write_once(rows, path, ["d"])
    read = docs.read_captures(spark, path, r"d=([0-9-]+)/", "capture_day")
    return read.groupBy("capture_day").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("sink_export", "select season, count(*) as n from fx_games group by season")
def sink_export(spark, sf_dir):
    """The analysis table as Parquet by season, refused a second time, and read back."""
    path = docs.scratch(spark, "export")
    docs.write_once(view(spark, sf_dir, "fx_games"), path, ["season"])
    return spark.read.parquet(path).groupBy(F.col("season").cast("long").alias("season")).agg(F.count("*").alias("n"))


@query("provenance")
def provenance(spark, sf_dir):
    """One row per file of a written table: bytes, and the root of a tree of hashes over its ranges of 64 KB."""
    path = docs.scratch(spark, "provenance")
    docs.write_once(view(spark, sf_dir, "fx_games").repartition(3, "k"), path)
    return archive.hash_tree(spark, path, leaf=1 << 16, pattern="*.parquet")


@query("manifest_append", "select event_type as dataset, event_id as id from fx_captures")
def manifest_append(spark, sf_dir):
    """Captures from an instant on are added to the manifest of all others; the two parts make up the whole table."""
    added = joins.matched(F.col("ts") >= F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    rows = view(spark, sf_dir, "fx_captures").select(F.col("event_type").alias("dataset"), F.col("event_id").alias("id"), added.alias("added"))
    return archive.append_manifest(rows.where("not added").drop("added"), rows.where("added").drop("added"), ["dataset", "id"])


@query("verify_archive", "select 'CHANGED' as status, 1 as n union all select 'unregistered', 1 union all select 'identical', 2")
def verify_archive(spark, sf_dir):
    """Every registered file is hashed again; one registered hash is wrong and one file unregistered."""
    path = docs.scratch(spark, "archive")
    docs.write_once(view(spark, sf_dir, "fx_games").repartition(4, "k"), path)
    manifest = archive.manifest_of(spark, path)
    number = F.row_number().over(Window.orderBy("file"))  # a row per file of the archive
    listed = manifest.withColumn("i", number)
    tampered = listed.where("i <> 2").withColumn("sha256", F.when(F.col("i") == 1, F.reverse("sha256")).otherwise(F.col("sha256")))
    return archive.verify(spark, path, tampered.drop("i")).groupBy("status").agg(F.count("*").alias("n"))


RUNS = """
    runs as (select event_type as model, user_id as k, cast(ts as date) as day, event_id, ts as made, ts - interval 1 hour as seen, cast(cast(ts as date) as timestamp) + interval 18 hour as kickoff, value as pred from events)"""


def _runs(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("model"), F.col("user_id").alias("k"), F.to_date("ts").alias("day"), "event_id", F.col("ts").alias("made"), (F.col("ts") - F.expr("interval 1 hour")).alias("seen"),
        (F.to_date("ts").cast("timestamp_ntz") + F.expr("interval 18 hours")).alias("kickoff"), F.col("value").alias("pred"),
    )


@query("official_record", f"with {RUNS} select model, k, day, event_id, pred from (select *, row_number() over (partition by model, k, day order by made desc, event_id) as r from runs where made < kickoff and seen < kickoff) where r = 1")
def official_record(spark, sf_dir):
    return archive.official(_runs(spark, sf_dir), ["model", "k", "day"], "made", "seen", "kickoff", ["event_id"]).select("model", "k", "day", "event_id", "pred")


@query("score_official", f"""
    with {RUNS}, o as (select * from (select *, row_number() over (partition by model, k, day order by made desc, event_id) as r from runs where made < kickoff) where r = 1),
    last as (select max(day) as d from runs), a as (select user_id as k, cast(ts as date) as day, max(value) as y from events group by 1, 2)
    select model, count(*) as n, round(avg(abs(o.pred - coalesce(a.y, 0))), 4) as mae from o left join a on a.k = o.k and a.day = o.day + 1 where o.day < (select d from last) group by model""")
def score_official(spark, sf_dir):
    """Finished days only; an absent outcome of the next day counts as 0."""
    runs = _runs(spark, sf_dir)
    rows = archive.official(runs, ["model", "k", "day"], "made", "seen", "kickoff", ["event_id"])
    outcome = runs.groupBy("k", F.date_sub("day", 1).alias("day")).agg(F.max("pred").alias("y"))
    last = runs.agg(F.max("day").alias("last"))
    done = rows.crossJoin(last).where("day < last").join(outcome, ["k", "day"], "left")
    return done.groupBy("model").agg(F.count("*").alias("n"), r4(F.avg(F.abs(F.col("pred") - F.coalesce("y", F.lit(0.0))))).alias("mae"))


@query("fingerprint", f"""
    with {RUNS} select model, count(*) as n, round(avg(pred), 4) as mean, case model when 'click' then 'CHANGED' when 'view' then 'unverifiable' else 'identical' end as status from runs group by model""")
def fingerprint(spark, sf_dir):
    """Prints of the predictions against stored ones: one model's were changed in a single row, one has no stored print."""
    runs = _runs(spark, sf_dir)
    first = runs.where("model = 'click'").agg(F.min("event_id").alias("event_id"))
    changed = runs.join(first.withColumn("_first", F.lit(True)), "event_id", "left").withColumn("pred", F.col("pred") + F.when(F.col("_first"), 0.01).otherwise(0.0))
    stored = archive.fingerprint(changed.where("model <> 'view'"), "model", ["k", "event_id"], "pred")
    now = archive.fingerprint(runs, "model", ["k", "event_id"], "pred")
    return archive.compare_prints(now, stored, "model").select("model", "n", r4("mean").alias("mean"), "status")


@query("sink_write_once", "select count(*) as n, true as refused from fx_games")
def sink_write_once(spark, sf_dir):
    """A table that was written can't be written again, and stays as it was."""
    from pyspark.errors import AnalysisException

    path = docs.scratch(spark, "once")
    games = view(spark, sf_dir, "fx_games")
    docs.write_once(games, path)
    try:
        docs.write_once(games.limit(1), path)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.lit(refused).alias("refused"))


@query("ledger_join", """
    with rows as (select distinct user_id as k, cast(ts as date) as day, cast(cast(ts as date) as timestamp) + interval 18 hour as cutoff from events)
    select r.k, r.day, (select min_by(e.event_id, (e.ts, e.event_id)) from events e where e.user_id = r.k and e.ts >= r.cutoff) as event_id from rows r""")
def ledger_join(spark, sf_dir):
    """The outcome of record: the first retrieval at or after each decision's cutoff."""
    e = view(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "ts", "event_id")
    rows = e.select("k", F.to_date("ts").alias("day")).distinct().withColumn("cutoff", F.col("day").cast("timestamp_ntz") + F.expr("interval 18 hours"))
    return archive.next_after(rows, e, ["k"], "ts", "cutoff", ["event_id"]).select("k", "day", "event_id")


@query("coverage_report", f"""
    with {RUNS}, c as (select model, day, count(*) filter (where made < kickoff) as n_before, count(*) filter (where made >= kickoff) as n_late, max(case when made < kickoff then made end) as last_before from runs group by model, day)
    select model, day, n_before, n_late, last_before, coalesce(hour(last_before) >= 12, false) as after_report from c""")
def coverage_report(spark, sf_dir):
    before = F.col("made") < F.col("kickoff")
    c = _runs(spark, sf_dir).groupBy("model", "day").agg(
        F.count_if(before).alias("n_before"), F.count_if(~before).alias("n_late"), F.max(F.when(before, F.col("made"))).alias("last_before")
    )
    return c.select("*", joins.matched(F.hour("last_before") >= 12).alias("after_report"))
