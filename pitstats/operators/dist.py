"""Distributional forecasts as arrays of quantiles on a grid of levels, and their scores.

A grid is a list of rising levels between 0 and 1, or a number n for the grid i / (n + 1).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitstats.operators.fit import grouped_logit
from pitstats.operators.quantiles import exact_quantiles


def levels(n: int) -> list[float]:
    return [(i + 1) / (n + 1) for i in range(n)]


def grid_of(grid: int | list[float]) -> list[float]:
    return levels(grid) if isinstance(grid, int) else [float(t) for t in grid]


def weights(grid: int | list[float]) -> list[float]:
    """Of each level by the trapezoid rule, with the tails held at the end quantiles; they sum to 1."""
    tau = grid_of(grid)
    edges = [0.0, *((a + b) / 2 for a, b in zip(tau, tau[1:])), 1.0]
    return [b - a for a, b in zip(edges, edges[1:])]


def _literal(values: list[float]) -> Column:
    return F.array(*map(F.lit, values))


def _weighted(x: Column, grid: int | list[float]) -> Column:
    return F.aggregate(F.zip_with(x, _literal(weights(grid)), lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v)


def band_of(x: Column, edges: list[float]) -> Column:
    """Number of the fixed band of a value: 1 below the first edge, one more from each edge on."""
    return reduce(lambda a, e: a + (x >= e).cast("int"), edges, F.lit(1))


def merged_bands(counts: Column, least: int) -> Column:
    """Group of each band, from the counts of all bands: groups have `least` rows, but where all bands together have fewer.

    From the top band down, a band joins the group above it while that has too few rows; a lowest group with too few
    joins the next one. Groups are numbered from the top.
    """
    step = lambda s, n: F.when(
        s["rows"] < least, F.struct((s["rows"] + n).alias("rows"), s["group"].alias("group"), F.concat(s["of"], F.array(s["group"])).alias("of"))
    ).otherwise(F.struct(n.alias("rows"), (s["group"] + 1).alias("group"), F.concat(s["of"], F.array(s["group"] + 1)).alias("of")))
    start = F.struct(F.lit(0).cast("long").alias("rows"), F.lit(1).alias("group"), F.array().cast("array<int>").alias("of"))
    done = F.aggregate(F.reverse(counts), start, step)
    last = F.when((done["rows"] < least) & (done["group"] > 1), done["group"] - 1).otherwise(done["group"])
    return F.reverse(F.transform(done["of"], lambda g: F.least(g, last)))


def residual_bands(rows: DataFrame, by: list[str], residual: str, x: str, edges: list[float], n: int, least: int) -> DataFrame:
    """Residual quantiles per class and group of bands: band_lo, band_hi, n, sd, q and the class's floor (least outcome).

    Bands are fixed by their edges, so no row needs its rank; small ones are merged until a group has `least` rows. The
    counts are one short array for each class.
    """
    banded = rows.withColumn("band", band_of(F.col(x), edges))
    each = [F.count_if(F.col("band") == i + 1) for i in range(len(edges) + 1)]
    classes = banded.groupBy(*by).agg(F.array(*each).alias("_n"), F.min(F.col(x) + F.col(residual)).alias("floor"))
    classes = classes.select(*by, "floor", merged_bands(F.col("_n"), least).alias("_of"))
    grouped = banded.join(classes, by).withColumn("_group", F.element_at("_of", F.col("band")))
    first, times = F.array_position("_of", F.col("_group")), F.size(F.filter("_of", lambda g: g == F.col("_group")))
    grouped = grouped.withColumn("band_lo", first).withColumn("band_hi", first + times - 1)
    keys = [*by, "band_lo", "band_hi", "floor"]
    more = F.count("*").alias("n"), F.stddev_samp(residual).alias("sd")
    return exact_quantiles(grouped.select(*keys, residual), keys, residual, levels(n), *more)


def apply_bands(rows: DataFrame, table: DataFrame, by: list[str], x: str, edges: list[float]) -> DataFrame:
    """`rows` with `q`: x plus the residual quantiles of its class and band, not below the class's floor; null without any.

    The table has a few rows per class.
    """
    cells = table.select(*by, F.explode(F.sequence("band_lo", "band_hi")).alias("_band"), F.col("q").alias("_q"), "floor")
    joined = rows.withColumn("_band", band_of(F.col(x), edges).cast("long")).join(cells, [*by, "_band"], "left")
    return joined.withColumn("q", F.transform("_q", lambda r: F.greatest(F.col(x) + r, F.col("floor")))).drop("_band", "_q", "floor")


def pinball(q: Column, y: Column, tau: Column) -> Column:
    return F.when(y >= q, tau * (y - q)).otherwise((1 - tau) * (q - y))


def crps(q: Column, y: Column, grid: int | list[float]) -> Column:
    """Twice the mean pinball loss over the grid, with the tails scored at the end quantiles."""
    return 2 * _weighted(F.zip_with(q, _literal(grid_of(grid)), lambda a, t: pinball(a, y, t)), grid)


def crps_above(q: Column, y: Column, grid: int | list[float], threshold: float) -> Column:
    """Threshold-weighted CRPS: of forecast and outcome with all that lies below the threshold moved to it."""
    up = F.transform(q, lambda v: F.greatest(v, F.lit(threshold)))
    return crps(up, F.greatest(y, F.lit(threshold)), grid)


def normal_cdf(z: Column) -> Column:
    """Within 1e-7, by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) * 0.3989422804014327 * tail
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def crps_normal(mean: Column, sd: Column, y: Column) -> Column:
    """Closed form of a normal forecast."""
    z = (y - mean) / sd
    return sd * (z * (2 * normal_cdf(z) - 1) + 2 * F.exp(-z * z / 2) * 0.3989422804014327 - 0.5641895835477563)


def interval_score(low: Column, high: Column, y: Column, alpha: float) -> Column:
    return (high - low) + 2 / alpha * (F.greatest(low - y, F.lit(0.0)) + F.greatest(y - high, F.lit(0.0)))


def covered(low: Column, high: Column, y: Column) -> Column:
    return (y >= low) & (y <= high)


def cdf(q: Column, y: Column, grid: int | list[float]) -> Column:
    """Share of the distribution up to y: linear between quantiles, and outside them at the slope of the end pair.

    Where quantiles are tied the share jumps; at their value it is that of the last.
    """
    tau, at = grid_of(grid), lambda i: F.element_at(_literal(grid_of(grid)), i)
    k = len(tau)
    if k < 2:
        raise ValueError("a grid has two levels at least")
    first, second, last, before = (F.element_at(q, i) for i in (1, 2, -1, -2))
    below = F.size(F.filter(q, lambda v: v <= y))
    low, high = F.greatest(below, F.lit(1)), F.least(below + 1, F.lit(k))
    step = F.element_at(q, high) - F.element_at(q, low)
    inside = at(low) + (y - F.element_at(q, low)) / F.when(step > 0, step) * (at(high) - at(low))
    under = F.greatest(F.lit(0.0), tau[0] - (first - y) / F.greatest(second - first, F.lit(1e-9)) * (tau[1] - tau[0]))
    over = F.least(F.lit(1.0), tau[-1] + (y - last) / F.greatest(last - before, F.lit(1e-9)) * (tau[-1] - tau[-2]))
    return F.when(y < first, under).when(y > last, over).otherwise(F.coalesce(inside, at(low)))


def cdf_before(q: Column, y: Column, grid: int | list[float]) -> Column:
    """The share just below y: at a quantile's value the level of the first of those tied."""
    place = F.array_position(q, y).cast("int")
    return F.when(place > 0, F.element_at(_literal(grid_of(grid)), F.greatest(place, F.lit(1)))).otherwise(cdf(q, y, grid))


def pit(q: Column, y: Column, grid: int | list[float], u: Column) -> Column:
    """Randomised probability integral transform: uniform under calibration even where the distribution jumps."""
    upper, lower = cdf(q, y, grid), cdf_before(q, y, grid)
    return lower + u * F.greatest(upper - lower, F.lit(0.0))


def mixed_cdf(q: Column, y: Column, grid: int | list[float], p: Column) -> Column:
    """Of p times the quantile forecast plus an atom of the rest at 0."""
    return p * cdf(q, y, grid) + (1 - p) * (y >= 0).cast("double")


def moments(q: Column, p: Column, grid: int | list[float]) -> tuple[Column, Column]:
    """Mean and variance of p times the quantile forecast plus an atom at 0."""
    first, second = _weighted(q, grid), _weighted(F.transform(q, lambda v: v * v), grid)
    return p * first, p * second - p * first * p * first


def with_mean(rows: DataFrame, q: str, p: str, grid: int | list[float]) -> DataFrame:
    """Rows of quantiles and a probability with mean_active, the quantiles' mean, and mean, p times it."""
    return rows.withColumn("mean_active", _weighted(F.col(q), grid)).withColumn("mean", F.col(p) * F.col("mean_active"))


def excess(q: Column, level: Column, grid: int | list[float]) -> Column:
    """Mean of what exceeds a level."""
    return _weighted(F.transform(q, lambda v: F.greatest(v - level, F.lit(0.0))), grid)


def brier(p: Column, o: Column) -> Column:
    return (p - o) * (p - o)


def log_loss(p: Column, o: Column, eps: float = 1e-6) -> Column:
    c = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p))
    return -(o * F.ln(c) + (1 - o) * F.ln(1 - c))


def calibration(df: DataFrame, p: str, o: str, by: list[str], eps: float = 1e-6) -> DataFrame:
    """Per group n, and `level` and `slope` of a logistic regression of outcomes on the log odds of the forecasts."""
    c = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), F.col(p)))
    fits = grouped_logit(df.select(*by, F.ln(c / (1 - c)).alias("_x"), o), by, ["_x"], o)
    return fits.select(*by, "n", F.col("coef")[0].alias("level"), F.col("coef")[1].alias("slope"))


def reliability(df: DataFrame, p: str, o: str, bins: int, by: list[str]) -> DataFrame:
    """Per right-closed bin (the first includes 0): count, mean probability, observed share and Wilson's 95% interval."""
    z = 1.959963984540054
    binned = df.withColumn("bin", F.greatest(F.ceil(F.col(p) * bins), F.lit(1)).cast("long"))
    out = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(o).alias("observed"))
    n, s = F.col("n"), F.col("observed")
    middle, spread = (s + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * F.sqrt(s * (1 - s) / n + z * z / (4 * n * n))
    return out.withColumn("low", middle - spread).withColumn("high", middle + spread)


def revisions(rows: DataFrame, by: list[str], cluster: str, period: str, v: str, final: str, nothing: float, least: int) -> DataFrame:
    """Per group: drift of `final` over `v` with a 95% interval, variance, transitions and what is adopted.

    Rows of one cluster are not independent, so errors are those of cluster sums. `share_zero` is the share of rows above
    `nothing` whose final value isn't. Drift and spread are adopted where they are told from 0 and the group has `least`
    periods; else they are 0.
    """
    d = rows.withColumn("_d", F.col(final) - F.col(v))
    ended = F.when(F.col(v) > nothing, (F.col(final) <= nothing).cast("double"))
    means = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_distinct(period).alias("n_days"), F.avg("_d").alias("drift"), F.var_samp("_d").alias("variance"),
        F.count_if(F.col(final) < F.col(v) / 2).alias("n_halved"), F.avg(ended).alias("share_zero"),
    )
    off = F.col("_d") - F.col("drift")
    sums = d.join(means.select(*by, "drift", "variance"), by).groupBy(*by, cluster).agg(F.sum(off).alias("_u"), F.sum(off * off - F.col("variance")).alias("_w"))
    errors = sums.groupBy(*by).agg(F.sqrt(F.sum(F.col("_u") * F.col("_u"))).alias("_su"), F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_sw"))
    reach, spread = 1.96 * F.col("_su") / F.col("n"), 1.96 * F.col("_sw") / F.col("n")
    ready = F.col("n_days") >= least
    return means.join(errors, by).withColumns({
        "drift_low": F.col("drift") - reach, "drift_high": F.col("drift") + reach,
        "adopted_drift": F.when(ready & (F.abs("drift") > reach), F.col("drift")).otherwise(0.0),
        "adopted_spread": F.when(ready & (F.col("variance") > spread), F.col("variance")).otherwise(0.0),
    }).drop("_su", "_sw")


def martingale(rows: DataFrame, cluster: str, by: list[str], order: list[str], v: str, final: str) -> DataFrame:
    """Correlation of each revision (a value to the next of its series) with what the series still moves after it.

    In an efficient series it is 0. The interval is from the clusters' sums of the correlation's influence function.
    """
    following = F.lead(v).over(Window.partitionBy(*by).orderBy(*order))
    pairs = rows.withColumn("_next", following).where("_next is not null").select(cluster, (F.col("_next") - F.col(v)).alias("_a"), (F.col(final) - F.col("_next")).alias("_b"))
    m = pairs.agg(
        F.count("*").alias("pairs"), F.avg("_a").alias("_ma"), F.avg("_b").alias("_mb"), F.stddev_pop("_a").alias("_sa"), F.stddev_pop("_b").alias("_sb"), F.covar_pop("_a", "_b").alias("_ab"),
    ).withColumns({"cor": F.try_divide("_ab", F.col("_sa") * F.col("_sb")), "slope": F.try_divide("_ab", F.col("_sa") * F.col("_sa"))})
    # one row of means
    z = pairs.join(F.broadcast(m)).withColumns({"_za": F.try_divide(F.col("_a") - F.col("_ma"), F.col("_sa")), "_zb": F.try_divide(F.col("_b") - F.col("_mb"), F.col("_sb"))})
    influence = F.col("_za") * F.col("_zb") - F.col("cor") / 2 * (F.col("_za") * F.col("_za") + F.col("_zb") * F.col("_zb"))
    by_cluster = z.groupBy(cluster).agg(F.sum(influence).alias("_u"))
    error = by_cluster.agg(F.sqrt(F.sum(F.col("_u") * F.col("_u"))).alias("_se"))
    reach = 1.96 * F.col("_se") / F.col("pairs")
    return m.join(F.broadcast(error)).select(
        "pairs", "cor", (F.col("cor") - reach).alias("cor_low"), (F.col("cor") + reach).alias("cor_high"), "slope", (F.abs("cor") > reach).alias("predictable")
    )
