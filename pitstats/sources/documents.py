"""Sources and sinks of nested records and captures."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of a player document: which season, period, split and source they are of, and their statistics.
PLAYER = (
    "players array<struct<id bigint, fullName string, position int, stats array<struct<seasonId int, scoringPeriodId int, "
    "statSourceId int, statSplitTypeId int, appliedTotal double, stats map<string,double>>>>>"
)


def parse_players(documents: DataFrame, text: str, source: int, split: int = 1) -> DataFrame:
    """One row per player entry of a source: id, season, period and total; documents that don't parse give none."""
    parsed = documents.select(F.from_json(text, PLAYER).alias("d"))
    players = parsed.select(F.explode("d.players").alias("p"))
    wanted = F.filter("p.stats", lambda s: (s["statSourceId"] == source) & (s["statSplitTypeId"] == split))
    return players.select(F.col("p.id").alias("id"), F.explode(wanted).alias("s")).select(
        "id", F.col("s.seasonId").alias("season"), F.col("s.scoringPeriodId").alias("period"), F.col("s.appliedTotal").alias("total"), F.col("s.stats").alias("stats")
    )


def long_stats(entries: DataFrame, names: dict[str, str]) -> DataFrame:
    """Entries as (id, season, period, stat, value) with named statistics, summed over entries of one period."""
    pairs = F.create_map(*(F.lit(x) for item in names.items() for x in item))
    long = entries.select("id", "season", "period", F.explode("stats").alias("stat_id", "value"))
    return long.select("id", "season", "period", F.try_element_at(pairs, F.col("stat_id")).alias("stat"), "value").where("stat is not null").groupBy(
        "id", "season", "period", "stat"
    ).agg(F.sum("value").alias("value"))


def latest_capture(captures: DataFrame, dataset: str, retrieved_at: str, as_of) -> DataFrame:
    """Per dataset the rows of its latest capture at or before an instant."""
    seen = captures.where(F.col(retrieved_at) <= as_of)
    last = seen.groupBy(dataset).agg(F.max(retrieved_at).alias(retrieved_at))
    return seen.join(last, [dataset, retrieved_at])


def write_once(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Writes a table that must not exist yet."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_captures(spark: SparkSession, path: str, pattern: str, name: str) -> DataFrame:
    """Captures with a column taken from their path by a pattern."""
    df = spark.read.parquet(path)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias(name))


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files of several places bound by column name; columns that some lack are null there."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def union_view(spark: SparkSession, paths: list[str], where: str) -> str:
    """A temporary view over files of several places, bound by name, with a fixed filter; returns its name."""
    name = f"union_{uuid.uuid4().hex}"
    read_many(spark, paths).where(where).createOrReplaceTempView(name)
    return name


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that driver and executors share.

    Without `spark.checkpoint.dir` a local session gets a folder of its own; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/spark-{spark.sparkContext.applicationId}"
    return f"{base}/{name}-{uuid.uuid4().hex}"
