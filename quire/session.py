"""The session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str, **settings: str) -> SparkSession:
    """A session in UTC with ANSI mode and adaptive execution; settings are added as they are."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        b = b.config(key, value)
    return b.getOrCreate()
