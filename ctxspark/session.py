"""Session with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "ctxspark", **settings: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; other settings by keyword with __ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if "SPARK_MASTER" in os.environ:
        builder = builder.master(os.environ["SPARK_MASTER"])
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
