"""Structured Streaming forms of the cutoff, late-data and drift rules. Each takes and returns a streaming DataFrame.

Batch twins are plain DataFrame operators, so each rule has one meaning in both.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """Events as a file stream, with a UTC event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a glob also matches a table that is one file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def once_each(stream: DataFrame, keys: list[str], delay: str = "40 days") -> DataFrame:
    """Rows whose keys were not seen within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def with_lateness(stream: DataFrame, cutoff_hour: int = 18) -> DataFrame:
    """Rows with the reason for which they are left out: `late` from the day's cutoff on, else `in time`."""
    cutoff = F.date_trunc("day", "ts") + F.expr(f"interval {cutoff_hour} hours")
    return stream.withColumn("reason", F.when(F.col("ts") >= cutoff, "late").otherwise("in time"))


def windows_of(stream: DataFrame, size: str, slide: str | None = None, delay: str = "40 days") -> DataFrame:
    """Counts and sums per event-time window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", delay).groupBy(w).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(
        F.col("window.start").alias("start"), "n", "total"
    )


def last_before_cutoff(stream: DataFrame, cutoff_hour: int = 18, delay: str = "40 days") -> DataFrame:
    """Per entity and day the last value before the cutoff."""
    return (
        with_lateness(stream, cutoff_hour).where("reason = 'in time'").withWatermark("ts", delay)
        .groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
        .select("user_id", F.to_date("w.start").alias("day"), "event_id")
    )


def slates(stream: DataFrame, gap: str = "3 hours", delay: str = "40 days") -> DataFrame:
    """Sessions of events with gaps below `gap`, per kind."""
    return stream.withWatermark("ts", delay).groupBy("event_type", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select(
        "event_type", F.col("session_window.start").alias("start"), "n"
    )


def final_only(stream: DataFrame, finals: DataFrame, keys: list[str], within: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Rows for whose keys a final notice comes at most `within` after them: a stream-stream join on event time.

    `finals` is a stream of its own with `keys` and `ts`. Rows and notices wait for one another in state until the
    watermark says that no partner can come; a notice that arrives later than `delay` is dropped. Rows come out once.
    """
    notices = finals.select(*(F.col(k).alias(f"_final_{k}") for k in keys), F.col("ts").alias("_final_at")).withWatermark("_final_at", delay)
    same = [F.col(k) == F.col(f"_final_{k}") for k in keys]
    near = (F.col("_final_at") >= F.col("ts")) & (F.col("_final_at") <= F.col("ts") + F.expr(f"interval {within}"))
    return stream.withWatermark("ts", delay).join(notices, reduce(Column.__and__, [*same, near]), "left_semi")


def _expired(state, end_ms: int) -> bool:
    """Whether the watermark has passed the end of an interval; if not, the state's timer is set to it."""
    mark = state.getCurrentWatermarkMs()
    if end_ms < mark:
        return True
    state.setTimeoutTimestamp(int(max(end_ms, mark + 1)))
    return False


def interval_wealth(stream: DataFrame, p0: float, bet: float, hours: int = 1, delay: str = "1 day") -> DataFrame:
    """Per kind and interval of event time, once the watermark has passed it: `n` rows, `log`, the sum of their log factors,
    and `record_at`, `record_log`, where the running sum inside the interval rises above all before it.

    Rows of an interval wait in state, so their order of arrival doesn't count; intervals are spread over tasks and
    compose by `compose`. Late rows are dropped.
    """
    size = hours * 3600
    gain, loss = math.log(1 + bet * (1 - p0)), math.log(1 - bet * p0)
    row = np.dtype([("ts", "<i8"), ("id", "<i8"), ("hit", "<f8")])

    def released(key: tuple, data: bytes) -> pd.DataFrame:
        rows = np.sort(np.frombuffer(data, row), order=["ts", "id"])
        total = np.cumsum(np.where(rows["hit"] > 0, gain, loss))
        new = np.flatnonzero(total > np.r_[-np.inf, np.maximum.accumulate(total)[:-1]])
        return pd.DataFrame({"event_type": [key[0]], "start": [key[1]], "n": [len(rows)], "log": [total[-1]], "record_at": [new + 1], "record_log": [total[new]]})

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (data,) = state.get
            state.remove()
            yield released(key, data)
            return
        data = state.get[0] if state.exists else b""
        if _expired(state, (key[1] + size) * 1000):  # these rows are late; what has waited goes out
            if state.exists:
                state.remove()
                yield released(key, data)
            return
        for rows in batches:
            own = np.empty(len(rows), row)
            own["ts"], own["id"], own["hit"] = rows["ts"].astype("int64"), rows["event_id"], rows["hit"]
            data += own.tobytes()
        state.update((data,))

    keyed = stream.withWatermark("ts", delay).withColumn("start", F.floor(F.unix_timestamp("ts") / size) * size)
    out = "event_type string, start long, n long, log double, record_at array<long>, record_log array<double>"
    return keyed.groupBy("event_type", "start").applyInPandasWithState(update, out, "data binary", "append", "EventTimeTimeout")


def compose(intervals: DataFrame, level: float) -> DataFrame:
    """Per kind n, log_wealth and alarm_at (the first row at which the wealth reaches `level`, else 0) over all intervals.

    The running sums are over one row for each interval; the first interval whose records reach the level has the alarm.
    """
    run = Window.partitionBy("event_type").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    at = intervals.withColumns({"_base": F.coalesce(F.sum("log").over(run), F.lit(0.0)), "_seen": F.coalesce(F.sum("n").over(run), F.lit(0))})
    place = F.array_position(F.transform("record_log", lambda v: F.col("_base") + v >= math.log(level)), F.lit(True)).cast("int")
    alarm = F.when(place > 0, F.col("_seen") + F.element_at("record_at", F.greatest(place, F.lit(1))))
    return at.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("log").alias("log_wealth"), F.coalesce(F.min(alarm), F.lit(0)).alias("alarm_at"))


def adaptive_levels(stream: DataFrame, target: float, rate: float, delay: str = "1 day") -> DataFrame:
    """Per kind and day, once the watermark has passed the day: `delta`, the correction of the level before that day.

    After each day the correction moves by `rate` times the target less the day's coverage. Rows have event_type, ts and
    hit (0 or 1). State is the correction and the counts of the days that are not over; late rows are dropped.
    """

    def close(key: tuple, delta: float, days: dict[int, list[float]], mark: int) -> tuple[float, list[tuple]]:
        out = []
        for day in sorted(days):
            if (day + 1) * 86_400_000 >= mark:
                break
            hits, n = days.pop(day)
            out.append((key[0], day, delta, int(n)))
            delta += rate * (target - hits / n)
        return delta, out

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        delta, held = state.get if state.exists else (0.0, "{}")
        days = {int(d): v for d, v in json.loads(held).items()}
        mark = state.getCurrentWatermarkMs()
        delta, out = close(key, delta, days, mark)
        if not state.hasTimedOut:
            for rows in batches:
                for day, own in rows.groupby("day")["hit"]:
                    if (int(day) + 1) * 86_400_000 >= mark:
                        hits, n = days.get(int(day), (0.0, 0))
                        days[int(day)] = [hits + float(own.sum()), n + len(own)]
        state.update((delta, json.dumps(days)))
        if days:
            _expired(state, (min(days) + 1) * 86_400_000)
        yield pd.DataFrame(out, columns=["event_type", "day", "delta", "n"])

    keyed = stream.withWatermark("ts", delay).withColumn("day", F.unix_date(F.to_date("ts")))
    found = keyed.groupBy("event_type").applyInPandasWithState(
        update, "event_type string, day int, delta double, n long", "delta double, days string", "append", "EventTimeTimeout"
    )
    return found.withColumn("day", F.date_from_unix_date("day"))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its result, which each batch writes to Parquet.

    In complete mode a batch holds the whole result and the last one counts; in update mode all rows that were ever
    put out are returned, with the number of their batch. A batch that runs again replaces what it wrote.
    """
    spark, schema, numbers = stream.sparkSession, stream.schema, []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        numbers.append(number)

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not numbers:
        return spark.createDataFrame([], schema)
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{path}/batch={max(numbers)}")
    return spark.read.option("basePath", path).parquet(*(f"{path}/batch={n}" for n in sorted(set(numbers))))


def write_out(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends a stream to Parquet, each row once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
