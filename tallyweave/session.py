"""A session with the settings the operators expect."""

from pyspark.sql import SparkSession


def session(app: str = "tallyweave", **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, ANSI arithmetic; ``settings`` override (underscores stand for dots)."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
    }
    for key, value in (defaults | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
