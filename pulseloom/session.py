"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "pulseloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """UTC, adaptive execution with skew handling; a cluster's own master and sizes unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
