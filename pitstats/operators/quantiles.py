"""Exact quantiles of groups of any size.

Spark's own `percentile` keeps all distinct values of a group in one buffer. Here small groups use it, and groups of more
rows are searched by counts: each wanted rank lies in a bracket of values, a pass counts the rows of each bracket in up
to CELLS cells of equal width together with each cell's least and greatest value, and the cells that hold wanted ranks
are the next brackets. A bracket that holds one value, or few rows, ends the search. No task holds more than CELLS counts
or FINISH values of a bracket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitstats.sources.documents import scratch, write_once

#: Rows up to which a group, or a bracket of one, is settled at once; cells of a bracket.
FINISH, CELLS = 100_000, 4_096


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _joined(left: DataFrame, right: DataFrame, by: list[str], more: list[str] = (), how: str = "inner") -> DataFrame:
    """Joined on `by`, of which nulls are equal, and on `more`; the right side's keys go."""
    keys = [*by, *more]
    renamed = right.select(*(F.col(c).alias(f"_r_{c}") for c in keys), *(c for c in right.columns if c not in keys))
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by] + [F.col(c) == F.col(f"_r_{c}") for c in more]
    return left.join(renamed, reduce(Column.__and__, on), how).drop(*(f"_r_{c}" for c in keys))


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probs: list[float], *aggs: Column, finish: int = FINISH, cells: int = CELLS
) -> DataFrame:
    """by, the aggregates `aggs`, and `q`: the quantiles of `value` at `probs`, linear between neighbouring ranks.

    Null values and NaN are left out of `q`, which is null where no value is left; `aggs` see all rows. Without `by` there
    is one group.
    """
    probs = [float(p) for p in probs]
    if not probs or min(probs) < 0 or max(probs) > 1:
        raise ValueError("probabilities lie between 0 and 1")
    x = F.col(value).cast("double")
    rows = _kept(df.withColumn("_x", F.when(~F.isnan(x), x)).withColumn("_g", F.lit(0)), "quantiles")
    keys = by or ["_g"]
    ends = [F.count("_x").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    grid = F.array(*map(F.lit, probs))
    groups = _kept(rows.groupBy(*keys).agg(*aggs, *ends), "quantile-groups")
    names = [c for c in groups.columns if c not in ("_g", "_n", "_lo", "_hi")]
    large = groups.where(F.col("_n") > finish).select(*keys, "_n", "_lo", "_hi")
    if large.isEmpty():
        return rows.groupBy(*keys).agg(*aggs, F.percentile("_x", grid).alias("q")).select(*names, "q")
    few = _joined(rows.select(*keys, "_x"), groups.where(F.col("_n") <= finish).select(*keys), keys)
    few = few.groupBy(*keys).agg(F.percentile("_x", grid).alias("q"))
    many = _by_counts(rows.select(*keys, "_x").where("_x is not null"), large, keys, probs, finish, cells)
    return _joined(groups, few.unionByName(many), keys, how="left").select(*names, "q")


def _inside(hit: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in cells that hold wanted ranks, with these cells' `_lo`, `_hi`: a row is looked up by its bracket and cell."""
    brackets = wanted.select(*keys, "_from", "_cell", "_lo", "_hi").distinct()
    own = hit.select(*keys, "_x", F.col("_lo").alias("_from"), "_cell")
    return _joined(own, brackets, keys, ["_from", "_cell"]).select(*keys, "_x", "_lo", "_hi")


def _narrowed(counts: DataFrame, wanted: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The wanted ranks in the parts of their brackets (in the order of `at`) that hold them."""
    run = Window.partitionBy(*keys, "_lo").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = counts.withColumn("_end", F.sum("_c").over(run))
    found = _joined(wanted.select(*keys, "_lo", "_pos", "_rank"), parts, keys, ["_lo"])
    found = found.where((F.col("_rank") <= F.col("_end")) & (F.col("_rank") > F.col("_end") - F.col("_c")))
    return found.select(
        *keys, "_pos", F.col("_lo").alias("_from"), F.col(at).alias("_cell"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_rank") - F.col("_end") + F.col("_c")).alias("_rank"), "_c"
    )


def _by_counts(rows: DataFrame, large: DataFrame, keys: list[str], probs: list[float], finish: int, cells: int) -> DataFrame:
    place = lambda p: F.lit(p) * (F.col("_n") - 1)
    sides = [f(place(p)).cast("long") + 1 for p in probs for f in (F.floor, F.ceil)]
    ranks = F.posexplode(F.array(*sides)).alias("_pos", "_rank")
    wanted, found, done = _kept(large.select(*keys, "_n", "_lo", "_hi", ranks), "quantile-ranks"), None, False
    wanted = wanted.select(*keys, "_pos", "_lo", "_hi", "_rank", F.col("_n").alias("_c"))
    hit = _joined(rows, large.select(*keys, "_lo", "_hi"), keys)
    while not done:
        # halves, so that no width is infinite; a monotone function of the value
        share = (F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        cell = F.when(F.col("_hi") / 2 > F.col("_lo") / 2, F.least(F.floor(share * cells), F.lit(cells - 1))).otherwise(0)
        hit = hit.withColumn("_cell", cell.cast("long"))
        counts = hit.groupBy(*keys, "_lo", "_cell").agg(F.count("*").alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
        now = _kept(_narrowed(counts, wanted, keys, "_cell"), "quantile-ranks")
        settled = now.where("_lo = _hi").select(*keys, "_pos", F.col("_lo").alias("_v"))
        found = settled if found is None else found.unionByName(settled)
        wide = F.col("_hi") / 2 > F.col("_lo") / 2
        wanted = now.where("_lo < _hi")
        hit = _inside(hit, wanted, keys)
        done = wanted.where((F.col("_c") > finish) & wide).isEmpty()
    # brackets of few rows, or of neighbouring tiny numbers: their distinct values in order
    values = hit.groupBy(*keys, "_lo", "_x").agg(F.count("*").alias("_c"))
    last = _narrowed(values.withColumn("_least", F.col("_x")).withColumn("_most", F.col("_x")), wanted, keys, "_x")
    found = found.unionByName(last.select(*keys, "_pos", F.col("_lo").alias("_v")))
    by_place = F.map_from_entries(F.collect_list(F.struct("_pos", "_v")))  # two values for each probability
    out = _joined(large, found.groupBy(*keys).agg(by_place.alias("_at")), keys)

    def between(i: int, p: float) -> Column:
        low, high, h = F.col("_at")[2 * i], F.col("_at")[2 * i + 1], place(p)
        return F.when(F.ceil(h) == F.floor(h), low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

    return out.select(*keys, F.array(*(between(i, p) for i, p in enumerate(probs))).alias("q"))
