"""Queries of the streaming rules, run over the given events as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitstats.plans.registry import query
from pitstats.sources.documents import scratch
from pitstats.sources.fixtures import rounded, view
from pitstats.streaming import captures


def _result(spark, stream, mode="complete"):
    return captures.run_once(stream, scratch(spark, "streamed"), scratch(spark, "stream"), mode)


@query("stream_ingest", "select event_type, count(*) as n from (select distinct user_id, event_type, ts from events) group by event_type")
def stream_ingest(spark, sf_dir):
    path = scratch(spark, "ingested")
    once = captures.once_each(captures.read_events(spark, sf_dir), ["user_id", "event_type", "ts"])
    captures.write_out(once.select("event_id", "event_type"), path, scratch(spark, "ingest"))
    return spark.read.schema("event_id long, event_type string").parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_late_rows", "select event_type, case when hour(ts) >= 18 then 'late' else 'in time' end as reason, count(*) as n from events group by 1, 2")
def stream_late_rows(spark, sf_dir):
    counted = captures.with_lateness(captures.read_events(spark, sf_dir)).groupBy("event_type", "reason").agg(F.count("*").alias("n"))
    return _result(spark, counted)


@query("stream_last_before_cutoff", "select user_id, cast(ts as date) as day, max_by(event_id, (ts, event_id)) as event_id from events where hour(ts) < 18 group by 1, 2")
def stream_last_before_cutoff(spark, sf_dir):
    return _result(spark, captures.last_before_cutoff(captures.read_events(spark, sf_dir)))


@query("stream_tumbling", "select date_trunc('day', ts)::timestamp as start, count(*) as n, round(sum(value), 2) as total from events group by 1")
def stream_tumbling(spark, sf_dir):
    out = _result(spark, captures.windows_of(captures.read_events(spark, sf_dir), "1 day"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sliding", """
    select date_trunc('day', ts) + interval 6 hour * (hour(ts) // 6 - s) as start, count(*) as n, round(sum(value), 2) as total from events, range(4) t(s) group by 1""")
def stream_sliding(spark, sf_dir):
    out = _result(spark, captures.windows_of(captures.read_events(spark, sf_dir), "1 day", "6 hours"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_slates", """
    with g as (select event_type, ts, coalesce(ts - lag(ts) over (partition by event_type order by ts) >= interval 3 hour, true) as new from events),
    s as (select event_type, ts, sum(case when new then 1 else 0 end) over (partition by event_type order by ts) as i from g)
    select event_type, min(ts) as start, count(*) as n from s group by event_type, i""")
def stream_slates(spark, sf_dir):
    out = _result(spark, captures.slates(captures.read_events(spark, sf_dir)))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_final_only", """
    select e.event_type, count(*) as n from events e where e.event_type <> 'signup' and exists (
        select 1 from events f where f.event_type = 'signup' and f.user_id = e.user_id and f.ts >= e.ts and f.ts <= e.ts + interval 1 day) group by e.event_type""")
def stream_final_only(spark, sf_dir):
    """Events that a sign-up of the same user makes final within a day; the notices are a stream of their own."""
    rows = captures.read_events(spark, sf_dir).where("event_type <> 'signup'").select("event_id", "user_id", "event_type", "ts")
    finals = captures.read_events(spark, sf_dir).where("event_type = 'signup'").select("user_id", "ts")
    kept = _result(spark, captures.final_only(rows, finals, ["user_id"]), "append")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


#: Events of intervals and days that the watermark has passed when the stream ends.
RELEASED = "select * from events where date_trunc('{0}', ts) + interval 1 {0} < (select max(ts) from events) - interval 1 day"


@query("stream_eprocess", f"""
    with ev as ({RELEASED.format("hour")}),
    w as (select event_type, row_number() over (partition by event_type order by ts, event_id) as i, sum(ln(1 + 0.5::double * ((case when value > 50 then 1.0::double else 0.0::double end) - 0.3::double))) over (partition by event_type order by ts, event_id rows unbounded preceding) as lw from ev)
    select event_type, max(i) as n, round(max_by(lw, i), 5) as log_wealth, coalesce(min(case when lw >= ln(20) then i end), 0) as alarm_at from w group by event_type""")
def stream_eprocess(spark, sf_dir):
    """Wealth of a test on hits, from summaries of hours that the watermark releases."""
    hits = captures.read_events(spark, sf_dir).select("event_type", "ts", "event_id", (F.col("value") > 50).cast("double").alias("hit"))
    hours = _result(spark, captures.interval_wealth(hits, 0.3, 0.5), "append")
    out = captures.compose(hours, 20.0)
    return out.select("event_type", "n", rounded(F.col("log_wealth"), 5).alias("log_wealth"), "alarm_at")


@query("stream_adaptive_levels", f"""
    with recursive ev as ({RELEASED.format("day")}),
    d as (select event_type, cast(ts as date) as day, avg(case when value <= 50 then 1.0::double else 0.0::double end) as cov, row_number() over (partition by event_type order by cast(ts as date)) as i from ev group by 1, 2),
    l as (select event_type, day, i, cov, 0.0::double as delta from d where i = 1 union all select d.event_type, d.day, d.i, d.cov, l.delta + 0.05::double * (0.9::double - l.cov) from l join d on d.event_type = l.event_type and d.i = l.i + 1)
    select event_type, day, round(delta, 6) as delta from l""")
def stream_adaptive_levels(spark, sf_dir):
    """Correction of a quantile level by the misses so far, carried as state from day to day."""
    hits = captures.read_events(spark, sf_dir).select("event_type", "ts", (F.col("value") <= 50).cast("double").alias("hit"))
    daily = _result(spark, captures.adaptive_levels(hits, 0.9, 0.05), "append")
    return daily.select("event_type", "day", rounded(F.col("delta"), 6).alias("delta"))


@query("stream_freshness", """
    select event_type, max(ts) as last, case when max(ts) < timestamp '2024-01-31' - interval 3 hour then 'alert' when max(ts) < timestamp '2024-01-31' - interval 20 minute then 'warn' else 'ok' end as level from events group by event_type""")
def stream_freshness(spark, sf_dir):
    last = _result(spark, captures.read_events(spark, sf_dir).groupBy("event_type").agg(F.max("ts").alias("last")))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    level = F.when(F.col("last") < now - F.expr("interval 3 hours"), "alert").when(F.col("last") < now - F.expr("interval 20 minutes"), "warn").otherwise("ok")
    return last.select("event_type", F.col("last").cast("timestamp_ntz").alias("last"), level.alias("level"))
