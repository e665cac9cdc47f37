"""All registered queries of the analytics operators and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitstats.sources.fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_PLANS = ("relational", "temporal", "evaluation", "forecasts", "studies", "records", "streams")


def query(name: str, sql: str | None = None):
    """Registers a query under `name`, with SQL over the derived views where SQL can express it."""

    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = with_views(sql)
        return function

    return keep


def _load() -> None:
    for name in _PLANS:
        importlib.import_module(f"pitstats.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLE


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["pit_mae"](spark, sf_dir)
