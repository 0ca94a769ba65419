"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "kalends", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; the master and sizes come from the environment unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
