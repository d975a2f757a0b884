"""Sinks: Parquet or CSV, partitioned by window, manifests, registries, resumable writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, fmt: str = "parquet", partitions: tuple[str, ...] = ()) -> None:
    """Overwrites just the partitions that df holds."""
    writer = df.write.mode("overwrite").format(fmt).option("header", True)
    if partitions:
        writer = writer.partitionBy(*partitions).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def upsert(registry: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The registry with the rows of `rows` instead of those with equal keys."""
    return registry.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def next_id(log: DataFrame, column: str, prefix: str) -> str:
    """The identifier after the largest `prefix_NNN` of an append-only log."""
    last = log.agg(F.max(F.regexp_extract(column, rf"^{prefix}_(\d+)$", 1).try_cast("int"))).first()[0]
    return f"{prefix}_{(last or 0) + 1:03d}"


def pending(keys: DataFrame, done: DataFrame | None, on: list[str]) -> DataFrame:
    """Keys that an earlier, interrupted run has not written yet."""
    return keys if done is None else keys.join(done.select(*on).distinct(), on, "left_anti")


def conform(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """The given columns in order: (type, default) each; missing ones get the default, values that don't parse become NULL."""
    return df.select(*(F.col(c).try_cast(kind).alias(c) if c in df.columns else F.lit(default).cast(kind).alias(c) for c, (kind, default) in columns.items()))


def window_manifest(edges: DataFrame, keys: tuple[str, ...] = ("hashtag", "window_end")) -> DataFrame:
    """What each window's graph holds: influencers, audience, edges, total weight."""
    return edges.groupBy(*keys).agg(
        F.count_distinct("source").alias("n_influencers"),
        F.count_distinct("target").alias("n_audience"),
        F.count(F.lit(1)).alias("n_edges"),
        F.sum("weight").alias("total_weight"),
    )


def migrate_projection(edges: DataFrame) -> DataFrame:
    """Nodes (id, degree) rebuilt from an edge list without a node table."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def latest(registry: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return registry.withColumn("__n", n).where("__n = 1").drop("__n")


def saved(spark: SparkSession, path: str) -> DataFrame | None:
    """A table if it is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None
