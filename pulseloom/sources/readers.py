"""Sources: CSV (plain or gzip), Parquet, partitioned windows, embeddings, optional tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import normal_tag


def _schema(*fields: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType()}
    return T.StructType([T.StructField(f.split(":")[0], kinds[f.split(":")[1]]) for f in fields])


SCHEMAS = {
    "hashtags_by_post": _schema("timestamp_utc:s", "epoch_seconds:l", "username:s", "post_id:s", "shortcode:s", "hashtag:s"),
    "comments": _schema("post_id:s", "shortcode:s", "author:s", "commenter:s", "comment_epoch:l"),
    "tags": _schema("post_id:s", "shortcode:s", "author:s", "tagged_user:s", "post_epoch:l"),
    "attributes": _schema("username:s", "category:s", "followers:d", "followees:d", "posts:d"),
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, by an explicit schema or one of SCHEMAS; without any, types are inferred from all rows. Missing files raise."""
    reader = spark.read.option("header", True).option("multiLine", False)
    if isinstance(schema, str):
        schema = SCHEMAS[schema]
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).option("samplingRatio", 1.0).csv(path)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """post_id, shortcode, author, hashtag, post_epoch of a hashtags_by_post file."""
    rows = read_csv(spark, path, "hashtags_by_post")
    return rows.select("post_id", "shortcode", F.col("username").alias("author"), F.lower("hashtag").alias("hashtag"), F.col("epoch_seconds").alias("post_epoch"))


def read_keyed_files(spark: SparkSession, path: str, key: str = "hashtag") -> DataFrame:
    """Parquet files of a folder, with the file stem as the key."""
    rows = spark.read.parquet(path)
    return rows.withColumn(key, F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[A-Za-z0-9]+)*$", 1))


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """A table written by window: `hashtag=.../window_end=...` folders become columns."""
    return spark.read.option("basePath", path).parquet(path)


def master_list(tags: DataFrame, column: str = "hashtag", first: int | None = None) -> DataFrame:
    """Distinct normalised tags, in order; the first n of them on request."""
    out = tags.where(F.col(column).isNotNull()).select(normal_tag(F.col(column)).alias("hashtag")).distinct().orderBy("hashtag")
    return out.limit(first) if first else out


def platform_totals(given: DataFrame | None, fallback: DataFrame) -> DataFrame:
    """(date, total_posts_day): from a table that has a date and a posts column under one of the usual names, else from `fallback`."""
    if given is not None:
        names = {c.lower(): c for c in given.columns}
        day = next((names[c] for c in ("date", "day") if c in names), None)
        posts = next((names[c] for c in ("posts", "total_posts", "n_posts") if c in names), None)
        if day and posts:
            return given.select(F.col(day).cast("date").alias("date"), F.col(posts).cast("double").alias("total_posts_day"))
    return fallback.select("date", F.col("total_posts_day").cast("double").alias("total_posts_day"))


def graph_edges(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Undirected weighted edges u < v, one for each pair; weight 1 where the table has none. Of parallel edges the largest weight stays."""
    w = F.col(weight).cast("double") if weight in edges.columns else F.lit(1.0)
    keys = [c for c in ("hashtag", "window_end") if c in edges.columns]
    pairs = edges.where(F.col("source") != F.col("target")).select(*keys, F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), w.alias("w"))
    return pairs.groupBy(*keys, "u", "v").agg(F.max("w").alias("w"))


def discover(table: DataFrame, keys: tuple[str, ...] = ("hashtag", "window_end")) -> DataFrame:
    """The tags and windows that a partitioned table holds; reads partition names alone."""
    return table.select(*keys).distinct()


def guarded(edges: DataFrame, min_nodes: int = 1, keys: tuple[str, ...] = ("hashtag", "window_end")) -> DataFrame:
    """Edges of graphs with at least min_nodes nodes."""
    ends = edges.select(*keys, F.explode(F.array("u", "v")).alias("id")).groupBy(*keys).agg(F.count_distinct("id").alias("__n"))
    return edges.join(ends.where(F.col("__n") >= min_nodes).select(*keys), list(keys), "left_semi")


def read_embeddings(spark: SparkSession, path: str, column: str = "embedding") -> DataFrame:
    """Node vectors as array<double>, with how many influencers and audience rows each group holds where a partition column says so."""
    rows = spark.read.parquet(path)
    return rows.withColumn(column, F.col(column).cast("array<double>"))
