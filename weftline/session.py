"""Sessions with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "weftline", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; conf adds or replaces settings.

    Shuffle partitions and broadcast limits are left to the cluster.
    """
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
