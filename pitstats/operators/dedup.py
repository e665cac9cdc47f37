"""De-duplication, ranking and top-k per group; every order carries a key, so results don't depend on input order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def by_severity(df: DataFrame, keys: list[str], status: str, severity: list[str], latest: list) -> DataFrame:
    """One row per key: the most severe status (unknown ones last), then the latest."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, severity)), F.col(status)), F.lit(0))
    rank = F.when(rank == 0, len(severity) + 1).otherwise(rank)
    return first_by(df, keys, [rank, *latest])


def unique_best(df: DataFrame, keys: list[str], priority: Column) -> DataFrame:
    """The rows of the best priority of each key, where that is one row only."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_p", priority)
    df = df.withColumn("_best", F.min("_p").over(w)).where("_p = _best")
    return df.withColumn("_n", F.count("*").over(w)).where("_n = 1").drop("_p", "_best", "_n")


def top_n(df: DataFrame, by: list[str], order: list, n: int | Column) -> DataFrame:
    """The first n rows of each group, n a number or a column, with their `rank`."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def pareto(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rows that no other row of the group beats: none is at least as good in x and y, and better in one."""
    better = Window.partitionBy(*by).orderBy(F.desc(x))
    df = df.withColumn("_r", F.rank().over(better)).withColumn("_same", F.max(y).over(Window.partitionBy(*by, x)))
    # ranks of equal x are equal, so the frame ends before them
    above = Window.partitionBy(*by).orderBy("_r").rangeBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_above", F.max(y).over(above))
    keep = (F.col(y) == F.col("_same")) & (F.col("_above").isNull() | (F.col(y) > F.col("_above")))
    return df.where(keep).drop("_r", "_same", "_above")
