"""Window expressions of the feature engine. All take the window's keys and order, and stay in one sort per key."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def last_rows(by: list[str], order: list[str], k: int | None):
    """The last k rows of a key, this one included (all so far without k)."""
    start = Window.unboundedPreceding if k is None else 1 - k
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(start, 0)


def trailing_mean(x: str, by: list[str], order: list[str], k: int) -> Column:
    """Mean of the values that are not missing among the last k rows; null without any."""
    return F.avg(x).over(last_rows(by, order, k))


def trailing_sum(x: str, by: list[str], order: list[str], k: int) -> Column:
    """Sum over the last k rows, missing counting as 0."""
    return F.sum(F.coalesce(x, F.lit(0))).over(last_rows(by, order, k))


def trailing_sd(x: str, by: list[str], order: list[str], k: int) -> Column:
    """Sample deviation over the last k rows; null below two values."""
    w = last_rows(by, order, k)
    return F.when(F.count(x).over(w) >= 2, F.greatest(F.stddev_samp(x).over(w), F.lit(0.0)))


def with_ewma(df, x: str, by: list[str], order: list[str], half_life: float, name: str):
    """`df` with the mean of x under weights 0.5 ** (lag / half_life) in rows; missing values are skipped.

    Weights grow from the first row on (2 ** (i / h)), which is safe for 900 half-lives.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    weight = F.pow(F.lit(2.0), (F.row_number().over(w) - 1) / F.lit(half_life))
    df = df.withColumn("_w", F.when(F.col(x).isNotNull(), weight))
    upto = last_rows(by, order, None)
    total = F.sum("_w").over(upto)
    return df.withColumn(name, F.when(total > 0, F.sum(F.col(x) * F.col("_w")).over(upto) / total)).drop("_w")


def before(by: list[str], index: str):
    """All rows of a key with a strictly smaller index."""
    return Window.partitionBy(*by).orderBy(index).rangeBetween(Window.unboundedPreceding, -1)


def carry_forward(x: str, by: list[str], order: list[str]) -> Column:
    """The last known value."""
    return F.last(x, ignorenulls=True).over(last_rows(by, order, None))


def previous(x: str, by: list[str], order: list[str], step: int = 1) -> Column:
    return F.lag(x, step).over(Window.partitionBy(*by).orderBy(*order))


def changed(x: str, by: list[str], order: list[str]) -> Column:
    """Whether the value differs from the one before; false in a key's first row."""
    return F.coalesce(F.col(x) != previous(x, by, order), F.lit(False))


def share_same(x: str, by: list[str], order: list[str], k: int = 4) -> Column:
    """Share of the last k rows, this one included, with this row's value."""
    seen = F.collect_list(x).over(last_rows(by, order, k))
    return F.size(F.filter(seen, lambda v: v == F.col(x))) / F.size(seen)


def with_streak(df, flag: str, by: list[str], order: str, name: str):
    """`df` with the number of flagged rows directly before each row (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(order)
    df = df.withColumn("_i", F.row_number().over(w))
    missed = F.max(F.when(~F.col(flag), F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(name, (F.col("_i") - 1 - F.coalesce(missed, F.lit(0))).cast("long")).drop("_i")


def cumprod(x: str, by: list[str], order: list[str]) -> Column:
    """Running product of positive values."""
    return F.exp(F.sum(F.ln(x)).over(last_rows(by, order, None)))


def with_holm(df, p: str, by: list[str], tie: list[str], name: str):
    """`df` with Holm's step-down adjusted p-values inside each family."""
    family = Window.partitionBy(*by)
    w = family.orderBy(p, *tie)
    df = df.withColumn("_raw", F.col(p) * (F.count("*").over(family) - F.row_number().over(w) + 1))
    return df.withColumn(name, F.least(F.lit(1.0), F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")


def with_level_of_positives(df, x: str, by: list[str], order: str, k: int, name: str):
    """`df` with the mean of the last k positive values up to each row, carried through rows without one.

    Positive rows are averaged among themselves (partitioned by the sign), then carried along.
    """
    df = df.withColumn("_pos", F.coalesce(F.col(x) > 0, F.lit(False)))
    among = F.avg(x).over(last_rows([*by, "_pos"], [order], k))
    df = df.withColumn("_m", F.when(F.col("_pos"), among))
    return df.withColumn(name, carry_forward("_m", by, [order])).drop("_pos", "_m")
