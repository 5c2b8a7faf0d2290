"""A session with the engine's defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "quern", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """AQE on, UTC, Arrow on; two shuffle partitions a core in local mode, AQE's coalescing elsewhere."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions or 2 * (os.cpu_count() or 4)),
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
