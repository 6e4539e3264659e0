"""The Spark session for this library."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "ridgeline", **conf: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution, which deletes checkpoints that nothing refers to; ``conf`` adds settings."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
