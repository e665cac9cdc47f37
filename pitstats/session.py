"""Session factory with the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "pitstats", master: str | None = None, **conf) -> SparkSession:
    """A session in UTC with ANSI arithmetic and adaptive execution on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
