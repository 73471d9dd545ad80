"""A session with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "pagemill", **options: str) -> SparkSession:
    """UTC, adaptive execution and Arrow on; further options by their Spark names with `__` for dots."""
    builder = SparkSession.builder.appName(name)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for key, value in {**fixed, **{k.replace("__", "."): v for k, v in options.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
