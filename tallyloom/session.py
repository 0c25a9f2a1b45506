"""Session settings that the results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Weeks are UTC weeks; adaptive execution coalesces small shuffles and splits skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tallyloom", **extra: str) -> SparkSession:
    """A session with ``SETTINGS``; the master and sizes come from the caller or the cluster."""
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **extra}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def pin(spark: SparkSession) -> SparkSession:
    """Set on a session of the caller's what results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
