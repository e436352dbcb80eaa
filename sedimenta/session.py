"""A session with the engine's defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "sedimenta", **options: str) -> SparkSession:
    """Checked arithmetic, UTC, Arrow and adaptive plans; `options` override with __ for dots."""
    conf = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    conf |= {k.replace("__", "."): v for k, v in options.items()}
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()
