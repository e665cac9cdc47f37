"""Evaluation of predictions on identical rows: metrics, paired cluster bootstrap, selection, power."""

from __future__ import annotations

from functools import reduce
from hashlib import md5
from itertools import groupby
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitstats.functions.scalars import portable_uniform
from pitstats.operators.quantiles import exact_quantiles
from pitstats.sources.documents import scratch, write_once


def align(preds: DataFrame, keys: list[str], n_models: int) -> DataFrame:
    """Rows whose key every model predicted (one row per model and key)."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return preds.withColumn("_n", n).where(F.col("_n") == n_models).drop("_n")


def point_metrics(df: DataFrame, by: list[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    """n, MAE, RMSE, bias, median absolute error and correlation per group."""
    e = F.col(pred) - F.col(actual)
    sums = (
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.try_divide(F.covar_pop(actual, pred), F.stddev_pop(actual) * F.stddev_pop(pred)).alias("correlation"),  # null where one doesn't vary
    )
    rows = df.select(*by, actual, pred, F.abs(e).alias("_e"))
    return exact_quantiles(rows, by, "_e", [0.5], *sums).withColumn("median_ae", F.col("q")[0]).drop("q")


def average_rank(x: str, by: list[str]) -> Column:
    """Rank with ties averaged."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def rank_correlation(df: DataFrame, within: list[str], by: list[str], actual: str, pred: str, least: int = 3) -> DataFrame:
    """Mean over groups (`within`) of Spearman's correlation, for groups of at least `least` rows."""
    ranked = df.select(*by, *within, average_rank(actual, by + within).alias("_a"), average_rank(pred, by + within).alias("_p"))
    inner = ranked.groupBy(*by, *within).agg(F.corr("_a", "_p").alias("r"), F.count("*").alias("n")).where(F.col("n") >= least)
    return inner.groupBy(*by).agg(F.avg("r").alias("rank_cor"), F.count("r").alias("n_groups"))


def pairwise_accuracy(
    df: DataFrame, within: list[str], key: str, actual: str, pred: str, by: list[str], large: int = 20_000, blocks: int = 128
) -> DataFrame:
    """Share of pairs inside a group that the predictions order right; ties of predictions count one half.

    All pairs with different actuals count, and `key` is unique in a group; a missing prediction makes a tie. No pair
    is formed: ties come from counts of equal values and pairs in the same order from `concordant`. Groups of more than
    `large` distinct points are cut into blocks by actual and by prediction. A pair in the same order lies in one block
    by actual, or else in one block by prediction, or else in two cells of the grid of both, and is counted there.
    """
    group = [*by, *within]
    known = [F.col(c).isNotNull() for c in [*group, key, actual]]
    points = df.where(reduce(Column.__and__, known)).groupBy(*group, F.col(actual).cast("double").alias("_a"), F.col(pred).cast("double").alias("_p"))
    path = scratch(df.sparkSession, "pairs")
    write_once(points.agg(F.count("*").alias("_c")), path)  # read several times
    points = df.sparkSession.read.parquet(path)
    ordered = points.where("_p is not null")

    def pairs(rows: DataFrame, same: list[str]) -> DataFrame:
        """Pairs of a `by` that agree in `same`."""
        n = rows.groupBy(*group, *same).agg(F.sum("_c").alias("_n"))
        return n.groupBy(*by).agg(F.sum(F.expr("_n * (_n - 1) div 2")).alias("_pairs"))

    def signed(rows: DataFrame, same: list[str], all_: int, half: int) -> DataFrame:
        return pairs(rows, same).select(*by, (F.col("_pairs") * all_).alias("_all"), (F.col("_pairs") * half).alias("_half"), F.lit(0).cast("long").alias("_right"))

    # pairs with different actuals; and, as halves, those with a missing prediction or equal ones
    parts = [signed(points, [], 1, 1), signed(points, ["_a"], -1, -1), signed(ordered, [], 0, -1), signed(ordered, ["_a"], 0, 1)]
    parts += [signed(ordered, ["_p"], 0, 1), signed(ordered, ["_a", "_p"], 0, -1)]
    steps = [(i + 1) / blocks for i in range(blocks - 1)]
    cuts = ordered.groupBy(*group).agg(
        F.count("*").alias("_n"), *(F.array_distinct(F.percentile_approx(c, steps)).alias(f"{c}_cuts") for c in ("_a", "_p"))
    )
    cut = ordered.join(F.broadcast(cuts.where(F.col("_n") > large)), group, "left")

    def block(c: str) -> Column:
        """Values that are a cut have odd blocks of their own, in which no two values differ."""
        # cuts are sorted: how many are smaller is found by halving
        less = lambda at, step: F.when(F.get(f"{c}_cuts", at + step - 1) < F.col(c), at + step).otherwise(at)
        below = F.aggregate(F.array(*(F.lit(1 << i) for i in reversed(range(max(1, (blocks - 1).bit_length()))))), F.lit(0), less)
        return F.when(F.col("_n").isNull(), 0).otherwise(below * 2 + F.coalesce(F.get(f"{c}_cuts", below) == F.col(c), F.lit(False)).cast("int"))

    cut = cut.select(*group, "_a", "_p", "_c", block("_a").alias("_i"), block("_p").alias("_j"), F.col("_n").isNotNull().alias("_large"))
    point = lambda kind, b, x, y: F.struct(F.lit(kind).alias("kind"), b.alias("b"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    i, j = F.col("_i"), F.col("_j")
    places = F.array(
        F.when(i % 2 == 0, point("a", i, F.col("_a"), F.col("_p"))),
        F.when(F.col("_large") & (j % 2 == 0), point("p", j, i, F.col("_p"))),
        F.when(F.col("_large"), point("grid", F.lit(0), i, j)),
    )
    placed = cut.select(*group, F.explode(F.array_compact(places)).alias("_at"), "_c").groupBy(*group, "_at.kind", "_at.b", "_at.x", "_at.y").agg(F.sum("_c").alias("c"))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "_right long"])

    def count(names: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        right = concordant(rows["x"].to_numpy(), rows["y"].to_numpy(), rows["c"].to_numpy())
        return pd.DataFrame([[*names[: len(by)], right]], columns=[*by, "_right"])

    right = placed.groupBy(*group, "kind", "b").applyInPandas(count, schema)
    zero = F.lit(0).cast("long")
    parts.append(right.select(*by, zero.alias("_all"), zero.alias("_half"), "_right"))
    sums = reduce(DataFrame.unionByName, parts).groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("_all", "_half", "_right")))
    return sums.where("_all > 0").select(*by, F.col("_all").alias("n_pairs"), ((F.col("_right") + F.col("_half") * 0.5) / F.col("_all")).alias("accuracy"))


def concordant(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> int:
    """Pairs of points, c times each, of which one has both the smaller x and the smaller y; merged in log2(n) steps."""
    o = np.lexsort((-y, x))  # of equal x the larger y comes first, so that no pair of them counts
    y, c, n = y[o], c[o], len(o)
    rising, total = np.lexsort((-np.arange(n), y)), 0
    for bit in range((n - 1).bit_length()):
        q = rising[np.argsort(rising >> (bit + 1), kind="stable")]
        part, late = q >> (bit + 1), (q >> bit) & 1
        early = np.concatenate(([0], np.cumsum(np.where(late, 0, c[q]))))
        before = early[:-1] - early[np.searchsorted(part, part)]
        total += int((before * c[q] * late).sum())
    return total


def paired_differences(preds: DataFrame, model: str, baseline: str, keys: list[str]) -> DataFrame:
    """Per key: absolute error of the model less that of the baseline."""
    error = F.abs(F.col("pred") - F.col("actual"))
    wide = preds.where(F.col("model").isin(model, baseline)).groupBy(*keys).agg(
        F.max(F.when(F.col("model") == model, error)).alias("_m"), F.max(F.when(F.col("model") == baseline, error)).alias("_b")
    )
    return wide.where("_m is not null and _b is not null").select(*keys, (F.col("_m") - F.col("_b")).alias("d"))


def _numbered(sums: DataFrame, strata: list[str], cluster: str) -> DataFrame:
    """`sums` with `_i`, the place of a cluster in its stratum from 1 on, and `_size`, the stratum's number of clusters.

    Clusters are range-partitioned, and places go on from the counts of the partitions before, so that no stratum has to
    fit one task.
    """
    spark = sums.sparkSession
    known = sums.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in strata], F.lit(True)))
    path = scratch(spark, "clusters")
    write_once(known.repartitionByRange(*strata, cluster).withColumn("_part", F.spark_partition_id()), path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy(*strata, "_part").agg(F.count("*").alias("_here"))
    own = Window.partitionBy(*strata)
    counts = counts.withColumn("_size", F.sum("_here").over(own)).withColumn("_before", F.sum("_here").over(own.orderBy("_part")) - F.col("_here"))
    # a row for each partition and stratum
    placed = rows.join(F.broadcast(counts.drop("_here")), [*strata, "_part"])
    here = F.row_number().over(Window.partitionBy(*strata, "_part").orderBy(cluster))
    return placed.withColumn("_i", here + F.col("_before")).drop("_part", "_before")


#: Clusters of a block; draws of a task, about; repetitions that are drawn together.
BLOCK, DRAWS, REPS = 1 << 16, 2_000_000, 25


def places_of(head: bytes, slots: list[bytes], size: int) -> np.ndarray:
    """Places below `size` that slots draw: `portable_uniform` of the text times the size, whose md5 Spark would convert digit by digit."""
    digests = np.frombuffer(b"".join([md5(head + x, usedforsecurity=False).digest() for x in slots]), np.uint8).reshape(-1, 16)
    high = np.ascontiguousarray(digests[:, :8]).view(">u8").ravel().astype(np.uint64) >> np.uint64(16)
    return np.floor(high.astype(float) / float(1 << 48) * size).astype(np.int64)


def _drawn_sums(numbered: DataFrame, strata: list[str], reps: int, seed: int, block: int) -> DataFrame:
    """`_rep` and the sums `_s`, `_n` over the clusters that it draws.

    Draws meet the sums of clusters in blocks of places. A unit of work are the slots of a block in REPS repetitions; its
    draws are sorted by block and repetition, and each block gets one packed piece, of two bytes a draw.
    """
    keyed = numbered.withColumn("_b", F.floor((F.col("_i") - 1) / block).cast("int"))
    lists = F.array_sort(F.collect_list(F.struct("_i", F.coalesce(F.col("_s").cast("double"), F.lit(0.0)).alias("s"), F.col("_n").alias("n"))))
    path = scratch(numbered.sparkSession, "cluster-blocks")
    packed = keyed.groupBy(*strata, "_b", "_size").agg(lists.alias("_own"))
    write_once(packed.select(*strata, "_b", "_size", F.col("_own.s").alias("_s"), F.col("_own.n").alias("_n")), path)
    blocks = numbered.sparkSession.read.parquet(path)
    work = blocks.select(*strata, "_b", "_size", F.explode(F.sequence(F.lit(1), F.lit(reps), F.lit(REPS))).alias("_first"))
    # units of work are small rows that become many: tasks by their draws, not by their bytes
    pieces_of_work, clusters = blocks.agg(F.count("*"), F.sum(F.size("_n"))).first()
    tasks = min((pieces_of_work or 0) * -(-reps // REPS), -(-(clusters or 0) * reps // (DRAWS)))
    work = work.repartition(max(1, tasks))
    text = F.concat_ws("|", *(F.col(c).cast("string") for c in strata))
    work = work.select(*strata, text.alias("_text"), (F.col("_b").cast("long") * block).alias("_before"), "_size", "_first")
    names = [f"`{c}` {numbered.schema[c].dataType.simpleString()}" for c in strata]

    def run(batches):
        for batch in batches:
            for row, (text, before, size, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_text", "_before", "_size", "_first")))):
                slots = [f"|{text}|{i}".encode() if strata else f"|{i}".encode() for i in range(before + 1, min(before + block, size) + 1)]
                found = []
                for rep in range(first, min(first + REPS, reps + 1)):
                    at = np.sort(places_of(f"{seed}|{rep}".encode(), slots, size))
                    cuts = np.searchsorted(at, np.arange(0, size + block, block))
                    found += [(b, rep, j - i, (at[i:j] % block).astype(np.uint16)) for b, (i, j) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if j > i]
                found.sort(key=lambda f: f[:2])
                rows = []
                for b, own in groupby(found, lambda f: f[0]):
                    _, which, times, local = zip(*own)
                    rows.append((b, np.array(which, np.int32).tobytes(), np.array(times, np.int32).tobytes(), np.concatenate(local).tobytes()))
                head = [batch.column(c).take(pa.array([row] * len(rows))) for c in strata]
                tail = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*head, *tail], [*strata, "_b", "which", "times", "places"])

    pieces = work.mapInArrow(run, ", ".join([*names, "_b int, which binary, times binary, places binary"]))

    def add(own: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        """The block's sums by repetition; a block has its own draws only, about `reps` for each of its clusters."""
        s, n = np.array(of["_s"].iloc[0], float), np.array(of["_n"].iloc[0], np.int64)
        total, count = np.zeros(reps + 1), np.zeros(reps + 1, np.int64)
        for which, times, places in zip(own["which"], own["times"], own["places"]):
            which, times, places = np.frombuffer(which, np.int32), np.frombuffer(times, np.int32), np.frombuffer(places, np.uint16)
            begin = np.cumsum(times) - times
            total[which] += np.add.reduceat(s[places], begin)
            count[which] += np.add.reduceat(n[places], begin)
        return pd.DataFrame({"_rep": np.arange(1, reps + 1), "_s": total[1:], "_n": count[1:]})

    keys = [*strata, "_b"]
    parts = pieces.groupBy(*keys).cogroup(blocks.select(*keys, "_s", "_n").groupBy(*keys)).applyInPandas(add, "_rep int, _s double, _n long")
    return parts.groupBy("_rep").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))


def cluster_bootstrap(df: DataFrame, value: str, strata: list[str], cluster: str, reps: int, seed: int, block: int = BLOCK) -> DataFrame:
    """Mean of `value` and its percentile interval when whole clusters are redrawn within each stratum.

    Rows are first reduced to (stratum, cluster, sum, count). Each repetition draws as many clusters as its stratum
    has, by uniform numbers from the md5 of (seed, repetition, stratum, slot), so results are the same in any engine.
    A block has at most 65,536 clusters.
    """
    path = scratch(df.sparkSession, "cluster-sums")
    write_once(df.groupBy(*strata, cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n")), path)  # read several times
    sums = df.sparkSession.read.parquet(path)
    mean = F.try_divide(F.sum("_s"), F.sum("_n"))
    drawn = _drawn_sums(_numbered(sums, strata, cluster), strata, reps, seed, min(block, BLOCK))
    means = drawn.select("_rep", F.try_divide("_s", "_n").alias("m"))
    point = sums.agg(mean.alias("mean"))
    spread = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg((F.col("m") < 0).cast("double")).alias("share_below"))
    return point.crossJoin(spread)  # one row each


def select_model(metrics: DataFrame, by: list[str], error: str, complexity: str, tie: float = 0.005) -> DataFrame:
    """The simplest model whose error is within `tie` of the lowest, per group."""
    best = F.min(error).over(Window.partitionBy(*by))
    close = metrics.where("true").withColumn("_best", best).where(F.col(error) <= F.col("_best") * (1 + tie))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(complexity, error))
    return close.withColumn("_r", first).where("_r = 1").drop("_best", "_r")


def mde(sd: Column, n: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Smallest difference of means that n clusters with this deviation detect."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.lit(z) * sd / F.sqrt(n)


def bootstrap_p(draws: DataFrame, value: str, by: list[str], margin: float = 0.0) -> DataFrame:
    """One-sided p of (1 + draws at or below the margin) / (1 + draws)."""
    return draws.groupBy(*by).agg(((1 + F.count_if(F.col(value) <= margin)) / (1 + F.count("*"))).alias("p"))


def coverage_p(df: DataFrame, hit: str, by: list[str], cluster: str, nominal: float, reps: int, seed: int) -> DataFrame:
    """Per cell the coverage and its two-sided bootstrap p against the nominal one, whole clusters redrawn in the cell.

    Twice the smaller share of draws on either side of the nominal coverage, (1 + k) / (1 + reps), at most 1.
    """
    sums = df.groupBy(*by, cluster).agg(F.sum(hit).alias("_s"), F.count(hit).alias("_n"))
    w = Window.partitionBy(*by)
    numbered = sums.withColumn("_i", F.row_number().over(w.orderBy(cluster))).withColumn("_size", F.count("*").over(w))
    draws = numbered.select(*by, F.col("_i").alias("_slot"), "_size", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("_rep"))
    u = portable_uniform(F.lit(seed), F.col("_rep"), *(F.col(c) for c in by), F.col("_slot"))
    draws = draws.select(*by, "_rep", (F.floor(u * F.col("_size")) + 1).cast("int").alias("_i"))
    drawn = draws.join(numbered.select(*by, "_i", "_s", "_n"), [*by, "_i"]).groupBy(*by, "_rep").agg((F.sum("_s") / F.sum("_n")).alias("_m"))
    side = lambda c: (1 + F.count_if(c)) / F.lit(1.0 + reps)
    p = drawn.groupBy(*by).agg(F.least(F.lit(1.0), 2 * F.least(side(F.col("_m") <= nominal), side(F.col("_m") >= nominal))).alias("p"))
    return sums.groupBy(*by).agg((F.sum("_s") / F.sum("_n")).alias("cov"), F.sum("_n").alias("n")).join(p, by)


def bootstrap_skill(df: DataFrame, loss: str, base: str, by: list[str], cluster: str, reps: int, seed: int) -> DataFrame:
    """Per group n, the mean losses and the skill 1 - loss / base with its 95% interval, whole clusters redrawn.

    Clusters are reduced to their sums first; uniform numbers are those of `cluster_bootstrap`. A group's interval is over
    its `reps` draws.
    """
    sums = df.groupBy(*by, cluster).agg(F.sum(loss).alias("_s"), F.sum(base).alias("_b"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    numbered = sums.withColumn("_i", F.row_number().over(w.orderBy(cluster))).withColumn("_size", F.count("*").over(w))
    draws = numbered.select(*by, F.col("_i").alias("_slot"), "_size", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("_rep"))
    u = portable_uniform(F.lit(seed), F.col("_rep"), *(F.col(c) for c in by), F.col("_slot"))
    draws = draws.select(*by, "_rep", (F.floor(u * F.col("_size")) + 1).cast("int").alias("_i"))
    skill = 1 - F.try_divide(F.sum("_s"), F.sum("_b"))
    drawn = draws.join(numbered.select(*by, "_i", "_s", "_b"), [*by, "_i"]).groupBy(*by, "_rep").agg(skill.alias("_m"))
    spread = drawn.groupBy(*by).agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high"))
    means = sums.groupBy(*by).agg(F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_n")).alias("loss"), (F.sum("_b") / F.sum("_n")).alias("base"), skill.alias("skill"))
    return means.join(spread, by)


def week_t(df: DataFrame, value: str, week: list[str], by: list[str]) -> DataFrame:
    """Per group the t statistic of the weekly means against 0 and its degrees of freedom; null below two weeks."""
    weeks = df.groupBy(*dict.fromkeys([*by, *week])).agg(F.avg(value).alias("_m"))
    n, sd = F.count("_m"), F.stddev_samp("_m")
    return weeks.groupBy(*by).agg(n.alias("weeks"), F.when((n > 1) & (sd > 0), F.avg("_m") / (sd / F.sqrt(n))).alias("t"), (n - 1).alias("df"))
