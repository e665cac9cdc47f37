"""Record scoring and rule-based adjustments: generated expressions, no Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default weights of the example scoring; any mapping of column to weight is accepted.
WEIGHTS = {"targets": 0.1, "receptions": 1.0, "yards": 0.05}


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A small YAML file that Spark can read."""
    import yaml

    return yaml.safe_load("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def read_weights(spark: SparkSession, path: str) -> dict[str, float]:
    """The `weights` of a scoring file: statistic to weight."""
    weights = read_yaml(spark, path).get("weights") or {}
    bad = [k for k, w in weights.items() if isinstance(w, bool) or not isinstance(w, (int, float))]
    if bad or not weights:
        raise ValueError(f"{path}: no weights, or not numbers: {bad}")
    return {k: float(w) for k, w in weights.items()}


def weighted_score(df: DataFrame, weights: dict[str, float], strict: bool = True) -> Column:
    """Sum of weight times statistic; a missing value counts as 0, a missing column is an error (or 0)."""
    absent = [c for c in weights if c not in df.columns]
    if absent and strict:
        raise ValueError(f"no column {absent}")
    used = [F.coalesce(F.col(c), F.lit(0)) * F.lit(w) for c, w in weights.items() if c not in absent]
    return reduce(lambda a, b: a + b, used, F.lit(0.0))


def long_score(stats: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Points from long statistics (keys, unit, stat, value) and a rules table (unit, stat, weight).

    Only rules of a row's own unit count; the rules are a small parameter table.
    """
    joined = stats.join(F.broadcast(rules), ["unit", "stat"], "left")
    return joined.groupBy(*keys).agg(F.sum(F.coalesce(F.col("value") * F.col("weight"), F.lit(0.0))).alias("points"))


def two_sides(games: DataFrame, home: str, away: str, spread: str, total: str) -> DataFrame:
    """Each game as two team rows: sign-flipped spread and implied total."""

    def side(team: str, other: str, sign: int, is_home: bool) -> Column:
        s = F.col(spread) * sign
        return F.struct(
            F.col(team).alias("team"), F.col(other).alias("opponent"), F.lit(is_home).alias("home"), s.alias("team_spread"),
            ((F.col(total) + s) / 2).alias("implied_total"),
        )

    keep = [c for c in games.columns if c not in {home, away, spread}]
    both = F.explode(F.array(side(home, away, 1, True), side(away, home, -1, False)))
    return games.select(*keep, both.alias("_s")).select(*keep, "_s.*")


def rule_adjust(base: Column, rules: list[tuple[Column, float]]) -> Column:
    """Base plus the amounts of all rules that apply."""
    return reduce(lambda a, r: a + F.when(F.coalesce(r[0], F.lit(False)), r[1]).otherwise(0.0), rules, base)


def split_label(season: str, splits: dict[str, tuple[int, int]]) -> Column:
    """Name of the inclusive season range; 'unused' outside all."""
    out = None
    for name, (low, high) in splits.items():
        hit = F.col(season).between(low, high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unused")


def season_guard(df: DataFrame, season: str, permitted: DataFrame) -> DataFrame:
    """`df` where every season is permitted for the role; raises otherwise."""
    bad = df.select(season).distinct().join(F.broadcast(permitted), season, "left_anti").limit(5).collect()
    if bad:
        raise ValueError(f"seasons not permitted: {[r[0] for r in bad]}")
    return df
