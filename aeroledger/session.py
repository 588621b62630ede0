"""Session settings the jobs are written for.

Nothing in the library depends on them for right results; they only spell out
the adaptive features (skew splitting, partition coalescing) that the plans
rely on for speed.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot tail number or a hot null key may hold a third of the fact: let AQE
    # split it even where that costs one more shuffle downstream.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Longer generated methods are never compiled by the JVM; the wide stages
    # (raw flights, fact build) run about twice as fast with this limit.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "aeroledger", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session; ``extra`` overrides any of the settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
