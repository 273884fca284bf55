"""Spark sessions for the engine: UTC, ANSI mode, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """The active session with the engine's settings; on a cluster the master comes from the launcher."""
    builder = SparkSession.builder.config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()
