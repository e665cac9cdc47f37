"""Joins with point-in-time semantics.

As-of joins are a union of states and targets under one window instead of a range join: the window's frame ends one
step before the target's index, so only strictly earlier states are seen, and each key is sorted once. Where keys have
few states and several joins follow on the same key, `asof_few` joins on it without moving rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_strict(
    targets: DataFrame, states: DataFrame, by: list[str], index: str, payload: list[str], keep_index_as: str | None = None
) -> DataFrame:
    """Each target with the payload of the latest state of its key whose integer index is strictly smaller.

    Targets keep their rows and columns; without an earlier state the payload is null. Of states with equal key and
    index the greatest payload wins; use `checks.assert_unique_key` where that must not occur.
    """
    extra = [c for c in targets.columns if c not in {*by, index}]
    state = states.select(*by, index, F.struct(F.col(index).alias("_at"), *payload).alias("_state")).where(F.col(index).isNotNull())
    rows = targets.select(*by, index, F.struct(*by, index, *extra).alias("_row"))
    w = Window.partitionBy(*by).orderBy(index).rangeBetween(Window.unboundedPreceding, -1)
    seen = F.max("_state").over(w)
    joined = (
        rows.unionByName(state, allowMissingColumns=True).withColumn("_seen", seen).where(F.col("_row").isNotNull())
    )
    kept = [F.col("_seen._at").alias(keep_index_as)] if keep_index_as else []
    return joined.select("_row.*", *(F.col(f"_seen.{p}").alias(p) for p in payload), *kept)


def asof_few(targets: DataFrame, states: DataFrame, by: list[str], index: str, payload: list[str]) -> DataFrame:
    """As `asof_strict`, for keys that have few states each: a join on the key in which each state holds for the indexes
    after its own and up to the next state's.

    A side that lies by its key already isn't moved, and targets aren't moved with the states of another join.
    """
    states = states.where(F.col(index).isNotNull())
    # of one index the greatest payload comes last; the others hold for no index
    following = F.lead(index).over(Window.partitionBy(*by).orderBy(index, *payload))
    state = states.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col(index).alias("_from"), following.alias("_to"), *(F.col(c).alias(f"_new_{c}") for c in payload))
    holds = (F.col("_from") < F.col(index)) & (F.col("_to").isNull() | (F.col(index) <= F.col("_to")))
    for c in by:
        holds = (F.col(c) == F.col(f"_by_{c}")) & holds
    return targets.join(state, holds, "left").select(*targets.columns, *(F.col(f"_new_{c}").alias(c) for c in payload))


def latest_before(
    records: DataFrame, cutoffs: DataFrame, by: list[str], at: str, cutoff: str, payload: list[str], tie: list[str]
) -> DataFrame:
    """For each (key, cutoff instant) the record of that key with the latest instant strictly before it.

    `tie` orders records of one instant (the greatest wins).
    """
    record = records.select(*by, F.col(at).alias("_t"), F.lit(0).alias("_kind"), F.struct(at, *tie, *[p for p in payload if p not in {at, *tie}]).alias("_rec"))
    rows = cutoffs.select(*by, F.col(cutoff).alias("_t"), F.lit(-1).alias("_kind"), F.struct(*cutoffs.columns).alias("_row"))
    # at one instant the cutoff sorts first, so records of that instant are not before it
    w = Window.partitionBy(*by).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.unionByName(record, allowMissingColumns=True).withColumn("_seen", F.max("_rec").over(w))
    return seen.where(F.col("_row").isNotNull()).select("_row.*", *(F.col(f"_seen.{p}").alias(p) for p in payload))


def safe_left_join(left: DataFrame, right: DataFrame, by: list[str], max_unmatched: float = 1.0) -> DataFrame:
    """Left join onto unique keys; raises where the right side repeats a key or too many rows stay unmatched."""
    repeated = right.groupBy(*by).count().where("count > 1").limit(1).count()
    if repeated:
        raise ValueError(f"right side is not unique by {by}")
    joined = left.join(right.withColumn("_hit", F.lit(True)), by, "left")
    if max_unmatched < 1.0:
        n, missing = joined.agg(F.count("*"), F.count_if(F.col("_hit").isNull())).first()
        if n and missing / n > max_unmatched:
            raise ValueError(f"{missing} of {n} rows unmatched by {by}")
    return joined.withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def pair_with_next(df: DataFrame, by: list[str], order: str, columns: list[str], step: int = 1) -> DataFrame:
    """Each row with its own `step`-th next row of the same key; rows without one are left out."""
    w = Window.partitionBy(*by).orderBy(order)
    following = [F.lead(c, step).over(w).alias(f"next_{c}") for c in [order, *columns]]
    return df.select("*", *following).where(F.col(f"next_{order}").isNotNull())


def horizon_expand(rows: DataFrame, schedule: DataFrame, by: list[str], at: str) -> DataFrame:
    """Each row with every later scheduled period of its key (`by`), as `target`."""
    later = schedule.select(*by, F.col(at).alias("target"))
    return rows.join(later, by).where(F.col("target") > F.col(at))


def id_crosswalk(pairs: DataFrame, names: DataFrame, normalise) -> DataFrame:
    """One row per a_id: the b_id that its sources agree on.

    `pairs`: source, a_id, b_id, name; `names`: b_id, name. One b_id from all sources is accepted; of several, the only
    one whose normalised name equals the reference name; else the id is in conflict. A b_id that several a_ids accept
    is ambiguous for all of them.
    """
    candidates = pairs.where("b_id is not null").groupBy("a_id", "b_id").agg(F.min("name").alias("name"))
    reference = names.select("b_id", F.col("name").alias("ref_name"))
    named = candidates.join(reference, "b_id", "left").withColumn(
        "same", F.coalesce(normalise(F.col("name")) == normalise(F.col("ref_name")), F.lit(False))
    )
    per_id = named.groupBy("a_id").agg(
        F.count("*").alias("n"), F.min("b_id").alias("only"), F.count_if("same").alias("n_same"),
        F.min(F.when(F.col("same"), F.col("b_id"))).alias("by_name"),
    )
    decided = per_id.select(
        "a_id",
        F.when(F.col("n") == 1, F.col("only")).when(F.col("n_same") == 1, F.col("by_name")).alias("b_id"),
        F.when(F.col("n") == 1, "unanimous").when(F.col("n_same") == 1, "name").otherwise("conflict").alias("method"),
    )
    used = F.count("b_id").over(Window.partitionBy("b_id"))
    return decided.withColumn("_used", F.when(F.col("b_id").isNotNull(), used)).select(
        "a_id", F.when(F.coalesce("_used", F.lit(1)) == 1, F.col("b_id")).alias("b_id"),
        F.when(F.coalesce("_used", F.lit(1)) > 1, "ambiguous").otherwise(F.col("method")).alias("method"),
    )


def cascade(providers: list[DataFrame], keys: list[str], default: DataFrame | None = None) -> DataFrame:
    """Rows of the first provider that covers each key; `default` last."""
    ranked = [p.withColumn("_rank", F.lit(i)) for i, p in enumerate([*providers, *([default] if default is not None else [])])]
    out = ranked[0]
    for p in ranked[1:]:
        out = out.unionByName(p)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_rank"))
    return out.withColumn("_first", first).where("_first = 1").drop("_first", "_rank")


def matched(condition: Column) -> Column:
    """A condition that is false, not null, where a side is missing."""
    return F.coalesce(condition, F.lit(False))
