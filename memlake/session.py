"""The session that the library is made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(name: str = "memlake", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` has more settings, with _ for the dots of their names."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
