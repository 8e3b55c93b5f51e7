"""A Spark session with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidemark", **more: str) -> SparkSession:
    """Naive timestamps mean UTC; plans are re-optimised at run time, with skewed joins split."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | more
    return builder.config(map=settings).getOrCreate()
