"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "tallygrove", master: str | None = None, **extra: str) -> SparkSession:
    """The active session, or a new one: adaptive plans, UTC; on a cluster the master and sizes come from spark-submit."""
    if (active := SparkSession.getActiveSession()) is not None:
        return active
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": os.environ.get("SHUFFLE_PARTITIONS", "8") if master else "1000",
    } | extra
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
