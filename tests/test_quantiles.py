"""Exact quantiles by counts against sorting, on ties, outliers, tiny numbers and nulls."""

import math
import random

import numpy as np
import pytest

from pitstats.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


def groups():
    r = random.Random(3)
    tied = [float(r.choice([1, 1, 1, 2, 3])) for _ in range(900)]
    skewed = [r.lognormvariate(0, 4) * r.choice([-1, 1]) for _ in range(1500)]
    wild = [r.choice([1e308, -1e308, 0.0, 5e-324, 1e-323, 1e-300, 1.5, math.nextafter(1.5, 2)]) for _ in range(700)]
    return {"tied": tied, "skewed": skewed, "wild": wild, "small": [3.0, 1.0, 2.0], "one": [7.5] * 400, None: [float(i) for i in range(300)]}


@pytest.mark.parametrize("finish,cells", [(20, 8), (100, 64), (100_000, 4_096)])
def test_equal_to_sorting(spark, finish, cells):
    data = groups()
    rows = [(k, v, 2.0) for k, vs in data.items() for v in vs] + [("small", None, 5.0), ("small", float("nan"), 5.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(6)
    from pyspark.sql import functions as F

    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", PROBS, F.count("*").alias("rows"), F.sum("w").alias("w"), finish=finish, cells=cells).collect()}
    assert set(got) == {*data, "none"}
    assert got["none"]["q"] is None and got["none"]["rows"] == 1 and got["small"]["w"] == 16.0
    for k, vs in data.items():
        s = sorted(vs)
        want = []
        for p in PROBS:
            h = p * (len(s) - 1)
            a, b = s[math.floor(h)], s[math.ceil(h)]
            want.append(a if math.floor(h) == math.ceil(h) else (math.ceil(h) - h) * a + (h - math.floor(h)) * b)
        assert np.allclose(got[k]["q"], want, rtol=1e-15, atol=0), k


def test_one_group_of_the_whole_table(spark):
    df = spark.range(10_001).selectExpr("id * 0.5 as v")
    assert exact_quantiles(df, [], "v", [0.5, 0.25], finish=50, cells=16).collect()[0]["q"] == [2500.0, 1250.0]
    assert exact_quantiles(df.limit(0), ["v"], "v", [0.5]).collect() == []
    with pytest.raises(ValueError):
        exact_quantiles(df, [], "v", [1.5])
