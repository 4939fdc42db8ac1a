"""Session factory: UTC, AQE, and shuffle sizing left to the deployment."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "cairn", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session; `conf` keys use `__` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
