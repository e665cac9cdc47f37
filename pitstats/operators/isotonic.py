"""Isotonic distributional regression: P(Y <= z | x), falling in x, for many thresholds z at a time.

For one threshold it is the weighted least-squares fit that falls in x. Pooling adjacent violators is associative: blocks
pooled in a part of the x axis can be pooled on with those of the next. Rows are range-partitioned by class and x and cut
into pieces in which rows are pooled; pieces' and then partitions' blocks are merged in order of x, FAN partitions at a
time. A fit is kept on a grid of x of bounded size, so that it can be joined to any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitstats.operators.quantiles import exact_quantiles
from pitstats.sources.documents import scratch, write_once

#: Partitions' blocks that are merged at a time, thresholds that one task merges together, and rows of a piece.
FAN, TOGETHER, PIECE = 32, 64, 200_000


def pooled(low: np.ndarray, high: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks in order of x with weights n and sums s, pooled until their means fall (not strictly: equal means meet).

    Neighbours whose means don't fall end in one block, so a whole run of them is pooled at once, pass after pass, for as
    long as a pass takes a fair share away; what is left is pooled block by block.
    """
    share = 1.0
    while len(n) > 1 and share > 1 / 16:
        first = np.flatnonzero(np.r_[True, s[:-1] * n[1:] > s[1:] * n[:-1]])
        share = 1 - len(first) / len(n)
        if not share:
            return low, high, n, s
        low, high = low[first], high[np.r_[first[1:], len(n)] - 1]
        n, s = np.add.reduceat(n, first), np.add.reduceat(s, first)
    lows, highs, weights, sums = [], [], [], []
    for a, b, w, v in zip(low.tolist(), high.tolist(), n.tolist(), s.tolist()):
        while weights and sums[-1] * w <= v * weights[-1]:
            a, w, v = lows.pop(), w + weights.pop(), v + sums.pop()
            highs.pop()
        lows.append(a)
        highs.append(b)
        weights.append(w)
        sums.append(v)
    return np.array(lows), np.array(highs), np.array(weights), np.array(sums)


def fitted_at(grid: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Block means at grid points: constant within a block, linear between blocks, held at the ends."""
    x, p = np.stack([low, high], axis=1).ravel(), np.repeat(s / n, 2)
    keep = np.r_[True, np.diff(x) > 0]
    return np.interp(grid, x[keep], p[keep])


def _class_schema(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)


def _pieces(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """`by`, `part`, `piece`, and x and y of about so many rows of a class in order; equal x lie in one piece."""
    names = [*by, "part", "piece", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, held, size, key = TaskContext.get().partitionId(), 0, [], 0, None

        def packed(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            lists = [pa.array([v], pa.list_(pa.float64())) for v in (x, y)]
            return pa.RecordBatch.from_arrays([*key, pa.array([part], pa.int32()), pa.array([piece], pa.int32()), *lists], names)

        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in by))) or [()] * batch.num_rows
            cuts = [0, *(i for i in range(1, len(cells)) if cells[i] != cells[i - 1]), len(cells)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                head = [batch.column(c).slice(a, 1) for c in by]
                if held and head != key:
                    yield packed(*map(np.concatenate, zip(*held)))
                    held, size, piece = [], 0, piece + 1
                key = head
                held.append(tuple(batch.column(c).slice(a, b - a).to_numpy() for c in ("x", "y")))
                size += b - a
                if size >= most:
                    x, y = map(np.concatenate, zip(*held))
                    steps = np.flatnonzero(x[1:] > x[:-1])
                    held, at = [(x, y)], steps[-1] + 1 if len(steps) else 0
                    if at:
                        yield packed(x[:at], y[:at])
                        held, size, piece = [(x[at:], y[at:])], len(x) - at, piece + 1
        if held:
            yield packed(*map(np.concatenate, zip(*held)))

    ordered = rows.repartitionByRange(*by, "x").sortWithinPartitions(*by, "x")
    return ordered.mapInArrow(run, f"{_class_schema(rows, by)}, part int, piece int, x array<double>, y array<double>")


def _blocks(rows: DataFrame, axes: DataFrame, by: list[str], most: int) -> DataFrame:
    """`by`, `j` (threshold), `part`, `piece` and packed blocks of each piece; `axes` have a class's thresholds z."""
    names = [*by, "j", "part", "piece", "low", "high", "n", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y, z = (batch.column(c)[i].values.to_numpy() for c in ("x", "y", "z"))
                x, at, times = np.unique(x, return_inverse=True, return_counts=True)
                found = [pooled(x, x, times, np.bincount(at, y <= t, len(x))) for t in z]
                head = [batch.column(c).take(pa.array([i] * len(z))) for c in by]
                own = [batch.column(c).take(pa.array([i] * len(z))) for c in ("part", "piece")]
                lists = [pa.array([b[k].astype(float) for b in found], pa.list_(pa.float64())) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(range(len(z)), pa.int32()), *own, *lists], names)

    # the thresholds meet pieces, not rows
    met = _pieces(rows, by, most).join(axes.select(*by, "z"), by)
    lists = ", ".join(f"{c} array<double>" for c in ("low", "high", "n", "s"))
    return met.mapInArrow(run, f"{_class_schema(rows, by)}, j int, part int, piece int, {lists}")


def fit(df: DataFrame, by: list[str], x: str, y: str, levels: list[float], grid: list[float], piece: int = PIECE) -> DataFrame:
    """One row for each class and cell of its grid: `by`, `k`, the cell's ends `g0`, `g1`, P(Y <= z) there as `f0`, `f1`,
    the thresholds `z` and the class's least outcome `floor`.

    Thresholds are the class's exact quantiles of y at `levels`, grid points those of x at `grid`. Rows with a null x or y
    are left out. Ties in x are one point. A class with one grid point has one cell of no width.
    """
    spark = df.sparkSession
    rows = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    axes = exact_quantiles(rows, by, "y", levels, F.min("y").alias("floor")).withColumn("z", F.array_distinct("q")).drop("q")
    points = exact_quantiles(rows, by, "x", grid).withColumn("g", F.array_distinct("q")).drop("q")
    path = scratch(spark, "isotonic-axes")
    write_once(axes.join(points, by), path)
    axes = spark.read.parquet(path)
    path = scratch(spark, "isotonic-blocks")
    write_once(_blocks(rows, axes, by, piece), path)
    blocks = spark.read.parquet(path)
    keys = _class_schema(rows, by)
    lists = ("low", "high", "n", "s")
    schema = f"{keys}, j int, part int, piece int, " + ", ".join(f"{c} array<double>" for c in lists)

    def merge(own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for j, one in own.sort_values(["j", "part", "piece"]).groupby("j"):
            found = pooled(*(np.concatenate(one[c].tolist()) for c in lists))
            out.append((*(one[c].iloc[0] for c in by), j, int(one["part"].iloc[0]), 0, *found))
        return pd.DataFrame(out, columns=[*by, "j", "part", "piece", *lists])

    last = blocks.agg(F.max("part"), F.max("piece")).first()
    some = F.floor(F.col("j") / TOGETHER).alias("_some")
    if last[1]:
        blocks = blocks.groupBy(*by, "part", some).applyInPandas(merge, schema)
    parts = (last[0] or 0) + 1
    while parts > 1:
        blocks = blocks.groupBy(*by, F.floor(F.col("part") / FAN).alias("_of"), some).applyInPandas(merge, schema)
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        parts = -(-parts // FAN)

    def on_grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(batch.column(c).to_pylist() for c in ("g", *lists)))
            f = [fitted_at(*(np.array(v) for v in row)) for row in columns]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*by, "j"]), pa.array(f, pa.list_(pa.float64()))], [*by, "j", "f"])

    curves = blocks.join(axes.select(*by, "g"), by).mapInArrow(on_grid, f"{keys}, j int, f array<double>")
    # one value for each threshold and grid point of a class: both are bounded
    at = curves.select(*by, "j", F.posexplode("f").alias("k", "p")).groupBy(*by, "k")
    at = at.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "p"))), lambda v: v["p"]).alias("f"))
    low = at.join(axes, by).withColumn("g0", F.col("g")[F.col("k")])
    last = F.size("g") - 1
    high = at.select(*by, (F.col("k") - 1).alias("k"), F.col("f").alias("f1"))
    cells = low.where((F.col("k") < last) | (last == 0)).join(high, [*by, "k"], "left")
    g1 = F.coalesce(F.try_element_at("g", F.col("k") + 2), F.col("g0"))
    return cells.select(*by, "k", "g0", g1.alias("g1"), F.col("f").alias("f0"), F.coalesce("f1", "f").alias("f1"), "z", "floor")


def distribution(rows: DataFrame, cells: DataFrame, by: list[str], x: str) -> DataFrame:
    """`rows` with `f`, P(Y <= z) at x (linear in the grid's cell, held outside), `z` and `floor`; null without a fit."""
    starts = cells.groupBy(*by).agg(F.array_sort(F.collect_list("g0")).alias("_g"))
    held = rows.join(starts, by, "left").withColumn("_k", F.greatest(F.size(F.filter("_g", lambda g: g <= F.col(x))) - 1, F.lit(0)))
    joined = held.drop("_g").join(cells.withColumnRenamed("k", "_k"), [*by, "_k"], "left")
    width = F.col("g1") - F.col("g0")
    w = F.when(width > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(x) - F.col("g0")) / width))).otherwise(0.0)
    between = _once(w, lambda w: F.zip_with("f0", "f1", lambda a, b: a * (1 - w) + b * w))
    return joined.withColumn("f", between).drop("_k", "g0", "g1", "f0", "f1")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once for a row, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def quantile(f: Column, z: Column, tau: float, floor: Column) -> Column:
    """The distribution inverted at a level: linear between thresholds, held at the ends, not below the floor."""

    def inverted(at: Column) -> Column:
        before, here = F.element_at(f, F.greatest(at - 1, F.lit(1))), F.element_at(f, F.greatest(at, F.lit(1)))
        low, high = F.element_at(z, F.greatest(at - 1, F.lit(1))), F.element_at(z, F.greatest(at, F.lit(1)))
        between = low + (tau - before) / F.greatest(here - before, F.lit(1e-12)) * (high - low)
        return F.greatest(floor, F.when(at == 0, F.element_at(z, -1)).when(at == 1, F.element_at(z, 1)).otherwise(between))

    return _once(F.array_position(F.transform(f, lambda v: v >= tau), F.lit(True)).cast("int"), inverted)


def quantiles(f: Column, z: Column, taus: dict[str, float], floor: Column) -> Column:
    """A struct of the distribution inverted at several levels, under their names."""
    return _once(f, lambda own: F.struct(*(quantile(own, z, tau, floor).alias(name) for name, tau in taus.items())))
