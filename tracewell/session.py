"""Session settings the engine's results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tracewell", **conf: str) -> SparkSession:
    """A session with timestamps in UTC and adaptive execution; ``conf`` adds or overrides settings."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
