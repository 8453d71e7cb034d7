"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tidewater", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """UTC, ANSI casts, AQE and Arrow; cluster settings stay with the launcher."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
