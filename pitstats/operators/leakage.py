"""Leakage audits: corrupt everything from a cutoff on, and see whether features of the cutoff's rows move."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Repeated rows of the history for which one partition is made.
ROWS = 250_000


class LeakError(ValueError):
    """A feature depends on rows that it may not see."""


def corrupted(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Other values for columns: numbers turned to their negative less 1,009, flags flipped, text marked; others stay."""
    kinds, out = dict(df.dtypes), {}
    for name in names:
        kind = kinds[name]
        if kind == "boolean":
            out[name] = ~F.col(name)
        elif kind == "string":
            out[name] = F.concat(F.lit("x_"), name)
        elif kind in ("double", "float", "bigint", "int", "smallint", "tinyint") or kind.startswith("decimal"):
            out[name] = (-F.col(name) - 1009).cast(kind)
        else:
            out[name] = F.col(name)
    return out


def corrupt_from(df: DataFrame, index: str, cutoff: int, structural: list[str]) -> DataFrame:
    """`df` with every other column rewritten at and after the cutoff."""
    bad = corrupted(df, [c for c in df.columns if c not in {index, *structural}])
    return df.select(*(F.when(F.col(index) >= cutoff, bad[c]).otherwise(F.col(c)).alias(c) if c in bad else F.col(c) for c in df.columns))


def leak_check_all(
    targets: DataFrame, history: DataFrame, features: Callable[[DataFrame, DataFrame, list[str]], DataFrame], by: list[str], keys: list[str],
    at: str, cutoff: str, structural: list[str], outcomes: list[str],
) -> DataFrame:
    """Per cutoff and feature column: targets, and how many of them changed when what they may not see was corrupted.

    Each cutoff of the targets has a version of the history in which all rows at and after it are rewritten and a late
    row, stamped at the cutoff, is added for each of its targets; the realised `outcomes` of the targets are rewritten
    too. All versions are checked in one pass: `features(targets, history, by)` is called once with the entity's columns
    and once with the version beside them. The history is repeated for each cutoff, and cutoffs are those of a
    calendar, so their list is short. It is moved to its entity's partition before that, and windows and groups by
    entity and version then find all their rows there; partitions grow in number with the repeated rows.
    """
    cuts = [r[0] for r in targets.select(cutoff).distinct().where(F.col(cutoff).isNotNull()).collect()]
    tasks = max(int(history.sparkSession.conf.get("spark.sql.shuffle.partitions")), history.count() * len(cuts) // ROWS)
    history, targets = history.repartition(tasks, *by), targets.repartition(tasks, *by)
    fixed = {*by, at, *structural}
    bad = corrupted(history, [c for c in history.columns if c not in fixed])
    versions = history.withColumn("_version", F.explode(F.array(*map(F.lit, cuts)).cast(f"array<{dict(targets.dtypes)[cutoff]}>")))
    hidden = F.col(at) >= F.col("_version")
    versions = versions.select("_version", *(F.when(hidden, bad[c]).otherwise(F.col(c)).alias(c) if c in bad else c for c in history.columns))
    # a late row for each target, with the corrupted values of one of its entity's rows
    sample = history.groupBy(*by).agg(*(F.max(bad.get(c, F.col(c))).alias(c) for c in history.columns if c not in {*by, at}))
    late = targets.select(*by, F.col(cutoff).alias("_version")).distinct().join(sample, by).withColumn(at, F.col("_version"))
    versions = versions.unionByName(late.select(*versions.columns))
    wrong = targets.withColumns(corrupted(targets, outcomes)).withColumn("_version", F.col(cutoff))
    clean, moved = features(targets, history, by), features(wrong, versions, [*by, "_version"])
    names = [c for c in clean.columns if c not in {*keys, cutoff, *outcomes}]
    both = clean.select(*keys, cutoff, F.struct(*names).alias("_a")).join(moved.select(*keys, F.struct(*names).alias("_b")), keys)
    counts = both.groupBy(cutoff).agg(F.count("*").alias("n"), *(F.count_if(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias(c) for c in names))
    return counts.unpivot([cutoff, "n"], names, "column", "n_changed")


def leak_check(
    targets: DataFrame, history: DataFrame, features: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str], index: str,
    cutoffs: list[int], structural: list[str],
) -> DataFrame:
    """Per cutoff and feature column: rows of the cutoff, and how many changed when the history was corrupted."""
    out = None
    for cutoff in cutoffs:
        rows = targets.where(F.col(index) == cutoff)
        clean, bad = features(rows, history), features(rows, corrupt_from(history, index, cutoff, structural))
        names = [c for c in clean.columns if c not in keys]
        both = clean.select(*keys, F.struct(*names).alias("_a")).join(bad.select(*keys, F.struct(*names).alias("_b")), keys)
        counts = both.agg(F.count("*").alias("n"), *(F.count_if(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias(c) for c in names))
        row = counts.unpivot(["n"], names, "column", "n_changed").withColumn("cutoff", F.lit(cutoff).cast("long"))
        out = row if out is None else out.unionByName(row)
    return out


def leak_gate(report: DataFrame) -> DataFrame:
    """The report of a check in which nothing moved; raises otherwise."""
    bad = report.where("n_changed > 0").limit(5).collect()
    if bad:
        raise LeakError("; ".join(f"{r['column']} at {r['cutoff']}: {r['n_changed']} of {r['n']}" for r in bad))
    return report
