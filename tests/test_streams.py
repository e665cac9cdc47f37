"""Streams over several files: the same rows for any number of files per trigger and after a restart; late rows dropped."""

import math
import os
import random
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pitstats.streaming import captures

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
KINDS = ("a", "b")


def put(folder, number, rows):
    """A file of (id, user, kind, hours after the start, value), newer than those before it."""
    os.makedirs(f"{folder}/events.parquet", exist_ok=True)
    at = [START + timedelta(hours=h) for *_, h, _ in rows]
    table = pa.table({
        "event_id": pa.array([r[0] for r in rows], pa.int64()), "user_id": pa.array([r[1] for r in rows], pa.int64()), "event_type": [r[2] for r in rows],
        "ts": pa.array([t.replace(tzinfo=None) for t in at], pa.timestamp("us")), "value": pa.array([float(r[4]) for r in rows]),
    })
    path = f"{folder}/events.parquet/part-{number}.parquet"
    pq.write_table(table, path)
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def days(n=10, per_day=40, seed=1):
    """Rows of each day in random order, a file for each two days."""
    r = random.Random(seed)
    rows = [(i, r.randrange(6), r.choice(KINDS), 24 * d + r.random() * 23.9, r.randrange(100)) for d in range(n) for i in range(d * per_day, (d + 1) * per_day)]
    files = [[x for x in rows if 48 * f <= x[3] < 48 * (f + 1)] for f in range(n // 2)]
    for f in files:
        r.shuffle(f)
    return rows, files


def run(spark, folder, name, make, files):
    out, marks = f"{folder}/out-{name}", f"{folder}/check-{name}"
    captures.run_once(make(captures.read_events(spark, str(folder), files)), out, marks, "append")
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")


def wealth(stream):
    return captures.interval_wealth(stream.select("event_type", "ts", "event_id", (F.col("value") > 50).cast("double").alias("hit")), 0.3, 0.5)


def levels(stream):
    return captures.adaptive_levels(stream.select("event_type", "ts", (F.col("value") <= 50).cast("double").alias("hit")), 0.9, 0.05)


def want_wealth(rows, level, until):
    out = {}
    for kind in KINDS:
        own = sorted((h, i, v) for i, _, k, h, v in rows if k == kind and math.floor(h) + 1 < until)
        log, alarm = 0.0, 0
        for n, (_, _, v) in enumerate(own, 1):
            log += math.log(1 + 0.5 * ((v > 50) - 0.3))
            alarm = alarm or (n if log >= math.log(level) else 0)
        out[kind] = (len(own), round(log, 9), alarm)
    return out


def want_levels(rows, until):
    out = {}
    for kind in KINDS:
        delta = 0.0
        for d in range(100):
            own = [v <= 50 for _, _, k, h, v in rows if k == kind and d <= h / 24 < d + 1]
            if own and 24 * (d + 1) < until:
                out[kind, d] = round(delta, 9)
                delta += 0.05 * (0.9 - sum(own) / len(own))
    return out


def levels_of(df):
    return {(r.event_type, (r.day - START.date()).days): round(r.delta, 9) for r in df.collect()}


@pytest.mark.parametrize("files", [1, 5])
def test_released_by_the_watermark(spark, tmp_path, files):
    rows, parts = days()
    for i, part in enumerate(parts):
        put(tmp_path, i, part)
    until = max(r[3] for r in rows) - 24
    got = {r.event_type: (r.n, round(r.log_wealth, 9), r.alarm_at) for r in captures.compose(run(spark, tmp_path, "wealth", wealth, files), 3.0).collect()}
    want = want_wealth(rows, 3.0, until)
    assert got == want and any(v[2] for v in want.values())
    assert levels_of(run(spark, tmp_path, "levels", levels, files)) == want_levels(rows, until)


def test_restart_and_late_rows(spark, tmp_path):
    rows, parts = days()
    for i, part in enumerate(parts[:3]):
        put(tmp_path, i, part)
    run(spark, tmp_path, "wealth", wealth, 1)
    run(spark, tmp_path, "levels", levels, 1)
    late = [(9_000 + i, 1, "a", 1.5, 99) for i in range(50)]  # of the first day, when the watermark is past the fourth
    put(tmp_path, 3, parts[3] + late)
    put(tmp_path, 4, parts[4])
    until = max(r[3] for r in rows) - 24
    got = {r.event_type: (r.n, round(r.log_wealth, 9), r.alarm_at) for r in captures.compose(run(spark, tmp_path, "wealth", wealth, 1), 3.0).collect()}
    assert got == want_wealth(rows, 3.0, until)
    assert levels_of(run(spark, tmp_path, "levels", levels, 1)) == want_levels(rows, until)


def test_finals_are_a_stream(spark, tmp_path):
    # user 1: final in time; 2: final too long after; 3: final before the row; 4: final within a day but arriving after the watermark
    put(tmp_path, 0, [(1, 1, "a", 0.0, 1), (2, 2, "a", 0.0, 1), (3, 3, "a", 5.0, 1), (4, 4, "b", 1.0, 1), (5, 3, "final", 4.0, 1)])
    put(tmp_path, 1, [(6, 1, "final", 20.0, 1), (7, 1, "final", 21.0, 1), (8, 2, "final", 30.0, 1), (9, 9, "a", 200.0, 1), (10, 9, "final", 200.0, 1)])
    put(tmp_path, 2, [(11, 9, "final", 201.0, 1), (12, 9, "a", 230.0, 1)])  # the mark of a batch drops rows from the next but one on
    put(tmp_path, 3, [(13, 4, "final", 2.0, 1), (14, 9, "final", 202.0, 1)])

    def finals(files):
        def make(stream):
            notices = captures.read_events(spark, str(tmp_path), files).where("event_type = 'final'").select("user_id", "ts")
            return captures.final_only(stream.where("event_type <> 'final'").select("event_id", "user_id", "event_type", "ts"), notices, ["user_id"])

        return make

    assert sorted(r.event_id for r in run(spark, tmp_path, "one", finals(1), 1).collect()) == [1, 9]
    assert sorted(r.event_id for r in run(spark, tmp_path, "all", finals(9), 9).collect()) == [1, 4, 9]  # in one batch nothing is late
