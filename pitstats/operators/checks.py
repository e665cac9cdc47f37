"""Data-quality assertions and audits: one aggregation each, failing loudly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataCheckError(ValueError):
    """A table does not keep its contract."""


def duplicated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique_key(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    first = duplicated_keys(df, keys).limit(1).collect()
    if first:
        raise DataCheckError(f"{what}: key {first[0].asDict()} is not unique")
    return df


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule with the number of rows that break it (null counts as broken), from one pass."""
    counted = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    return counted.unpivot([], list(rules), "rule", "n_broken")


def assert_rules(df: DataFrame, rules: dict[str, Column], what: str = "table") -> DataFrame:
    broken = [r for r in violations(df, rules).collect() if r["n_broken"]]
    if broken:
        raise DataCheckError(f"{what}: " + ", ".join(f"{r['rule']} broken by {r['n_broken']}" for r in broken))
    return df


def not_missing(columns: list[str]) -> dict[str, Column]:
    return {f"{c} present": F.col(c).isNotNull() for c in columns}


def in_range(column: str, low=None, high=None) -> dict[str, Column]:
    """Missing values pass."""
    parts = [F.col(column) >= low] * (low is not None) + [F.col(column) <= high] * (high is not None)
    return {f"{column} in range": F.col(column).isNull() | reduce(lambda a, b: a & b, parts)}


def values_in(column: str, allowed: list) -> dict[str, Column]:
    return {f"{column} allowed": F.col(column).isin(*allowed)}


def missingness(df: DataFrame) -> DataFrame:
    """Per column: rows, missing values and their share, from one pass."""
    n = F.count("*").alias("_n")
    counted = df.agg(n, *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return counted.unpivot(["_n"], df.columns, "column", "n_missing").select(
        "column", F.col("_n").alias("n"), "n_missing", (100.0 * F.col("n_missing") / F.col("_n")).alias("pct_missing")
    )


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per column: rows on both sides and how many differ (nulls are equal); and rows on one side only."""
    left = a.select(*keys, F.struct(*columns).alias("_a"))
    right = b.select(*keys, F.struct(*columns).alias("_b"))
    both = left.join(right, keys, "full")
    there = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    counts = [F.count_if(there & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias(c) for c in columns]
    only = [F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right")]
    out = both.agg(F.count_if(there).alias("n_both"), *only, *counts)
    return out.unpivot(["n_both"], ["only_left", "only_right", *columns], "column", "n_different")


def projection_violations(df: DataFrame, keys: list[str], present: list[str], kinds: list[str], most: float) -> DataFrame:
    """Broken rules of a projection table (keys, has_game, proj, p_active, lvl, kind): rule, n_broken; all in one pass
    but for the key."""
    missing = [c for c in (*keys, *present, "has_game", "proj", "p_active", "lvl", "kind") if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing}")
    rules = {f"present: {c}": F.col(c).isNull() for c in (*keys, *present, "proj")} | {
        "kind allowed": ~F.col("kind").isin(*kinds), "proj in range": ~F.col("proj").between(0, most), "p_active in range": ~F.col("p_active").between(0, 1),
        "no game, no projection": ~F.col("has_game") & (F.col("proj") != 0), "proj = p_active * lvl": F.abs(F.col("proj") - F.col("p_active") * F.col("lvl")) > 1e-6,
    }
    counts = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    long = counts.unpivot([], list(rules), "rule", "n_broken")
    repeated = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_broken"))
    return repeated.select(F.lit("unique key").alias("rule"), "n_broken").unionByName(long)
