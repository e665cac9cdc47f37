"""Rolling-origin fits from sufficient statistics: every prediction sees strictly earlier rows, without a loop."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitstats.operators import windows
from pitstats.sources.documents import scratch, write_once


def sufficient(df: DataFrame, by: list[str], index: str, x: str, y: str) -> DataFrame:
    """n and the sums of x, y, xx and xy per group and period."""
    return df.groupBy(*by, index).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"),
        F.sum(F.col(x) * F.col(y)).alias("sxy"),
    )


def rolling_line(df: DataFrame, by: list[str], index: str, x: str, y: str, least: int) -> DataFrame:
    """Per group and period: intercept `a` and slope `b` of y on x over all strictly earlier periods.

    Below `least` rows, or with constant x, the line is a = 0, b = 1.
    """
    w = windows.before(by, index)
    sums = sufficient(df, by, index, x, y)
    before = sums.select(*by, index, *(F.sum(c).over(w).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")))
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    b = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread
    fits = (F.coalesce("n", F.lit(0)) >= least) & (spread > 1e-9)
    line = before.withColumn("b", F.when(fits, b).otherwise(1.0))
    return line.select(
        *by, index, F.coalesce("n", F.lit(0)).alias("n_before"),
        F.when(fits, (F.col("sy") - F.col("b") * F.col("sx")) / F.col("n")).otherwise(0.0).alias("a"), "b",
    )


def rolling_predict(df: DataFrame, by: list[str], index: str, x: str, y: str, least: int) -> DataFrame:
    """`df` with `pred`, from the line of each row's group over strictly earlier periods."""
    line = rolling_line(df, by, index, x, y, least).drop("n_before")
    return df.join(line, [*by, index]).withColumn("pred", F.col("a") + F.col("b") * F.col(x)).drop("a", "b")


def rate_table(df: DataFrame, levels: list[str], outcome: str, least: int) -> DataFrame:
    """Mean outcome for each prefix of the levels (all, first, first two, ...), with the rows behind it."""
    sets = [levels[:i] for i in range(len(levels) + 1)]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, levels)).agg(
        F.grouping_id().alias("_level"), F.avg(outcome).alias("rate"), F.count("*").alias("n")
    ).where((F.col("n") >= least) | (F.col("_level") == (1 << len(levels)) - 1))


def apply_rates(df: DataFrame, table: DataFrame, levels: list[str], name: str = "p") -> DataFrame:
    """The rate of the longest prefix of levels that the table has. The table is a parameter table."""
    found = []
    for depth in range(len(levels), -1, -1):
        mark = (1 << (len(levels) - depth)) - 1
        part = table.where(F.col("_level") == mark).select(*levels[:depth], F.col("rate").alias(f"_r{depth}"))
        df = df.join(F.broadcast(part), levels[:depth], "left") if depth else df.crossJoin(F.broadcast(part))
        found.append(F.col(f"_r{depth}"))
    return df.withColumn(name, F.coalesce(*found)).drop(*(f"_r{d}" for d in range(len(levels) + 1)))


def normal_equations(df: DataFrame, predictors: list[str], y: str, weight: Column | None = None):
    """Coefficients (intercept first) of weighted least squares: one aggregation, one small solve on the driver."""
    import numpy as np

    w = weight if weight is not None else F.lit(1.0)
    columns = [F.lit(1.0), *(F.col(p) for p in predictors)]
    k = len(columns)
    entries = [F.sum(w * columns[i] * columns[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]
    row = df.where(" and ".join(f"{c} is not null" for c in [*predictors, y])).agg(
        *entries, *(F.sum(w * columns[i] * F.col(y)).alias(f"y{i}") for i in range(k))
    ).first()
    xx = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    return np.linalg.lstsq(xx, np.array([row[f"y{i}"] for i in range(k)], float), rcond=None)[0]


def naive(df: DataFrame, key: str, index: str, season: str, y: str, size: int) -> DataFrame:
    """`df` with `pred`: the mean of the last games strictly before, else of last season."""
    earlier = Window.partitionBy(key).orderBy(index).rowsBetween(-size, -1)
    last = df.groupBy(key, (F.col(season) + 1).alias(season)).agg(F.avg(y).alias("_last"))
    return df.withColumn("_roll", F.avg(y).over(earlier)).join(last, [key, season], "left").withColumn(
        "pred", F.coalesce("_roll", "_last")
    ).drop("_roll", "_last")


def ratio_params(df: DataFrame, group: str, y: str, base: str, least: int) -> DataFrame:
    """Half of sum(y) / sum(base) - 1 per group, rounded to two places; groups below `least` rows are pooled."""
    sizes = F.count("*").over(Window.partitionBy(group))
    pooled = df.withColumn("_g", F.when(sizes >= least, F.col(group)).otherwise("pooled"))
    return pooled.groupBy(F.col("_g").alias("group")).agg(
        F.count("*").alias("n"), F.round((F.sum(y) / F.sum(base) - 1) / 2, 2).alias("m")
    )


def ml_linear(df: DataFrame, features: list[str], y: str, elastic: float = 0.0, penalty: float = 0.0):
    """Median imputation, standardisation and (elastic-net) least squares as one ML pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    filled = [f"{f}_filled" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
        LinearRegression(featuresCol="_x", labelCol=y, predictionCol="pred", elasticNetParam=elastic, regParam=penalty),
    ]
    return Pipeline(stages=stages).fit(df)


def ml_boosted(df: DataFrame, features: list[str], y: str, depth: int = 3, rounds: int = 10):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    filled = [f"{f}_filled" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_x"),
        GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="pred", maxDepth=depth, maxIter=rounds, seed=1),
    ]
    return Pipeline(stages=stages).fit(df)


def ml_logit(df: DataFrame, features: list[str], y: str):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stages = [VectorAssembler(inputCols=features, outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=y)]
    return Pipeline(stages=stages).fit(df)


def isotonic(df: DataFrame, x: str, y: str, increasing: bool = True):
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol=x, labelCol=y, predictionCol="fitted", isotonic=increasing).fit(df)


def two_slopes(df: DataFrame, by: list[str], x: str, z: str, y: str, least: int) -> DataFrame:
    """Per group of `least` rows and more: n, intercept `a` and slopes `b`, `c` of y on x and z, from sums alone.

    Groups in which x and z tell the same have no row.
    """
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(x).alias("_mx"), F.avg(z).alias("_mz"), F.avg(y).alias("_my"), F.var_pop(x).alias("_xx"), F.var_pop(z).alias("_zz"),
        F.covar_pop(x, z).alias("_xz"), F.covar_pop(x, y).alias("_xy"), F.covar_pop(z, y).alias("_zy"),
    )
    d = F.col("_xx") * F.col("_zz") - F.col("_xz") * F.col("_xz")
    fits = sums.where((F.col("n") >= least) & (d > 1e-9))
    fits = fits.withColumn("b", (F.col("_xy") * F.col("_zz") - F.col("_zy") * F.col("_xz")) / d).withColumn("c", (F.col("_zy") * F.col("_xx") - F.col("_xy") * F.col("_xz")) / d)
    return fits.select(*by, "n", (F.col("_my") - F.col("b") * F.col("_mx") - F.col("c") * F.col("_mz")).alias("a"), "b", "c")


def bucket_curves(df: DataFrame, by: list[str], bucket: str, x: str, u: str, y: str, least: int) -> DataFrame:
    """Per group and bucket n, intercept `a` and slopes `b`, `c` of y on x and its square, and the slope `g` on u that all
    buckets of a group share: least squares of all buckets together, from sums alone.

    What is left of u and y beside the buckets' own curves gives g; the curves are then those of y - g * u. A bucket with
    fewer than `least` rows, or in which x and its square tell the same, has its mean as curve; g is 0 where curves tell u.
    """
    names = ("x", "z", "u", "y")
    rows = df.select(*by, bucket, F.col(x).alias("_x"), (F.col(x) * F.col(x)).alias("_z"), F.col(u).alias("_u"), F.col(y).alias("_y"))
    pairs = [(a, b) for i, a in enumerate(names[:3]) for b in names[i:]]
    sums = rows.groupBy(*by, bucket).agg(
        F.count("*").alias("n"), *(F.avg(f"_{a}").alias(f"_m{a}") for a in names),
        *((F.var_pop(f"_{a}") if a == b else F.covar_pop(f"_{a}", f"_{b}")).alias(f"_{a}{b}") for a, b in pairs),
    )
    c = lambda name: F.col(f"_{name}")
    d = c("xx") * c("zz") - c("xz") * c("xz")
    sums = sums.withColumn("_d", F.when((F.col("n") >= least) & (d > 1e-9 * c("xx") * c("zz")), d))
    slope = lambda own, to, to_other: F.coalesce((to * own - to_other * c("xz")) / c("d"), F.lit(0.0))
    sums = sums.withColumn("_p", slope(c("zz"), c("xu"), c("zu"))).withColumn("_q", slope(c("xx"), c("zu"), c("xu")))
    left = lambda to, by_x, by_z: F.sum(F.col("n") * (to - c("p") * by_x - c("q") * by_z)).over(Window.partitionBy(*by))
    whole = F.sum(F.col("n") * c("uu")).over(Window.partitionBy(*by))
    sums = sums.withColumns({"_ru": left(c("uu"), c("xu"), c("zu")), "_ry": left(c("uy"), c("xy"), c("zy")), "_all": whole})
    sums = sums.withColumn("g", F.when(c("ru") > 1e-9 * c("all"), c("ry") / c("ru")).otherwise(0.0))
    own_x, own_z = c("xy") - F.col("g") * c("xu"), c("zy") - F.col("g") * c("zu")
    sums = sums.withColumn("b", slope(c("zz"), own_x, own_z)).withColumn("c", slope(c("xx"), own_z, own_x))
    return sums.select(*by, bucket, "n", (c("my") - F.col("g") * c("mu") - F.col("b") * c("mx") - F.col("c") * c("mz")).alias("a"), "b", "c", "g")


def grouped_logit(df: DataFrame, by: list[str], features: list[str], y: str, most: int = 25, close: float = 1e-8) -> DataFrame:
    """`by`, `n` and `coef` (intercept, then one for each feature) of a logistic regression per group, by Newton's method.

    A pass over the rows gives all groups' gradients and Hessians as sums; the steps are solved for all groups at a time
    and kept in the shared folder, so that passes don't repeat one another. Passes end when no coefficient moves by more
    than `close`. Rows with a null are left out; `coef` is null where a coefficient still moves after `most` passes (outcomes
    that are all alike, or that a feature separates, have no finite fit) or features don't tell rows apart.
    """
    spark = df.sparkSession
    x = [F.lit(1.0), *(F.col(f"x{i}") for i in range(len(features)))]
    rows = df.select(*by, *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)), F.col(y).cast("double").alias("y")).na.drop(
        subset=["y", *(f"x{i}" for i in range(len(features)))]
    )
    path = scratch(spark, "logit-rows")
    write_once(rows, path)
    rows = spark.read.parquet(path)
    m = len(x)
    coefs = rows.groupBy(*by).agg(F.count("*").alias("n")).select(*by, "n", F.array(*[F.lit(0.0)] * m).alias("coef"), F.lit(1.0).alias("step"))
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]

    def solve(batches):
        for own in batches:
            steps = []
            for coef, g, h in zip(own["coef"], own["_g"], own["_h"]):
                full = np.zeros((m, m))
                for (i, j), v in zip(pairs, h):
                    full[i, j] = full[j, i] = v
                try:
                    step = np.linalg.solve(full, np.array(g)) if np.linalg.cond(full) < 1e14 else None
                except np.linalg.LinAlgError:
                    step = None
                new = None if step is None else np.array(coef) + step * min(1.0, 20.0 / max(1e-300, np.abs(step).max()))
                steps.append((None, 0.0) if new is None else (new.tolist(), float(np.abs(step).max())))
            yield own[[*by, "n"]].assign(coef=[c for c, _ in steps], step=[v for _, v in steps])

    for number in range(most + 1):
        path = scratch(spark, "logit-coefs")
        write_once(coefs, path)
        coefs = spark.read.parquet(path)
        moving = coefs.where((F.col("step") > close) & F.col("coef").isNotNull())
        if number == most or moving.isEmpty():
            break
        eta = sum((F.col("coef")[i] * v for i, v in enumerate(x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), eta))))
        scored = rows.join(moving.select(*by, "n", "coef"), by).withColumn("p", p)
        g = F.array(*(F.sum((F.col("y") - F.col("p")) * v) for v in x))
        h = F.array(*(F.sum(F.col("p") * (1 - F.col("p")) * x[i] * x[j]) for i, j in pairs))
        sums = scored.groupBy(*by, "n", "coef").agg(g.alias("_g"), h.alias("_h"))
        moved = sums.mapInPandas(solve, f"{keys}, n long, coef array<double>, step double")
        coefs = moved.unionByName(coefs.where((F.col("step") <= close) | F.col("coef").isNull()))
    return coefs.select(*by, "n", F.when(F.col("step") <= close, F.col("coef")).alias("coef"))


def logistic(coef, values: list):
    """Probability of a fitted logistic regression from its coefficients and the features' columns."""
    eta = sum((coef[i + 1] * v for i, v in enumerate(values)), coef[0])
    return 1 / (1 + F.exp(-eta))


def earlier_seasons(rows: DataFrame, season: str = "season") -> DataFrame:
    """Each row once for every later season, which `season` then names: the rows that a fit for that season may see."""
    # a row for each season
    later = F.broadcast(rows.select(F.col(season).alias("_later")).distinct())
    return rows.join(later, F.col(season) < F.col("_later")).drop(season).withColumnRenamed("_later", season)
