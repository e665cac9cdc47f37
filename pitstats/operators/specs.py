"""Named model specifications and providers: callables that a user adds, found by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitstats.operators import fit, joins

#: name -> callable(rows, **settings) that returns the rows with `pred`.
SPECS: dict[str, Callable[..., DataFrame]] = {}
#: name -> callable(context) that returns keys and values.
PROVIDERS: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {}


def spec(name: str):
    def keep(function):
        SPECS[name] = function
        return function

    return keep


def provider(name: str):
    def keep(function):
        PROVIDERS[name] = function
        return function

    return keep


@spec("vendor")
def _vendor(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pred", F.col("proj"))


@spec("line")
def _line(rows: DataFrame, least: int = 50) -> DataFrame:
    return fit.rolling_predict(rows, ["position"], "gi", "proj", "actual", least)


@spec("naive")
def _naive(rows: DataFrame, size: int = 8) -> DataFrame:
    return fit.naive(rows, "k", "gi", "season", "actual", size)


def predictions(rows: DataFrame, registry: dict[str, dict]) -> DataFrame:
    """Long predictions of all registered models: id -> {type, settings}."""
    out = None
    for name, entry in registry.items():
        if entry["type"] not in SPECS:
            raise KeyError(f"{name}: no specification {entry['type']!r}")
        part = SPECS[entry["type"]](rows, **entry.get("settings", {})).select(F.lit(name).alias("model"), "k", "gi", "actual", "pred")
        out = part if out is None else out.unionByName(part)
    return out.where("pred is not null")


def cascade_of(names: list[str], context: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first named provider that covers each key."""
    return joins.cascade([PROVIDERS[n](context).withColumn("provider", F.lit(n)) for n in names], keys)
