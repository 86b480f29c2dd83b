"""A session with the settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution; ANSI stays on, so jobs use try_ functions where input may be malformed."""
    builder = SparkSession.builder.appName("caseweave")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
