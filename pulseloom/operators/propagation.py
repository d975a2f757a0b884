"""First adoption, exposures, propagation edges and their daily snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch_day

EXPOSURE = ["hashtag", "A", "B", "exposure_epoch", "post_epoch", "post_id", "shortcode", "exposure_type"]


def first_adoption(posts: DataFrame) -> DataFrame:
    """(user, hashtag, first_post_epoch)."""
    return posts.groupBy(F.col("author").alias("user"), F.lower("hashtag").alias("hashtag")).agg(F.min("post_epoch").alias("first_post_epoch"))


def comment_exposures(posts: DataFrame, comments: DataFrame, clamp_hours: int = 360) -> DataFrame:
    """An author of a tagged post exposes its commenters, at the comment's time but no later than `clamp_hours` after the post; 0 means the post's time."""
    held = comments.where(F.col("commenter").isNotNull() & (F.col("commenter") != F.col("author")))
    when = F.col("post_epoch") if clamp_hours == 0 else F.least("comment_epoch", F.col("post_epoch") + F.lit(clamp_hours * 3600))
    both = posts.join(held, ["post_id", "shortcode", "author"])
    return both.select("hashtag", F.col("author").alias("A"), F.col("commenter").alias("B"), when.alias("exposure_epoch"), "post_epoch", "post_id", "shortcode", F.lit("comment").alias("exposure_type"))


def tag_exposures(posts: DataFrame, tags: DataFrame) -> DataFrame:
    """An author exposes the users tagged in a post, at the post's time."""
    held = tags.where(F.col("tagged_user").isNotNull() & (F.col("tagged_user") != F.col("author")))
    both = posts.join(held, ["post_id", "shortcode", "post_epoch", "author"])
    return both.select("hashtag", F.col("author").alias("A"), F.col("tagged_user").alias("B"), F.col("post_epoch").alias("exposure_epoch"), "post_epoch", "post_id", "shortcode", F.lit("tag").alias("exposure_type"))


def exposures(posts: DataFrame, comments: DataFrame | None, tags: DataFrame | None, clamp_hours: int = 360) -> DataFrame:
    """Both kinds, or the one that is given."""
    parts = [comment_exposures(posts, comments, clamp_hours)] * (comments is not None) + ([tag_exposures(posts, tags)] if tags is not None else [])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*EXPOSURE)


def propagation_edges(exposed: DataFrame, adoption: DataFrame) -> DataFrame:
    """A to B, where B adopted the tag strictly after an exposure by A. The earliest exposure stays; of several types the first by name."""
    a = adoption.select(F.col("user").alias("A"), "hashtag", F.col("first_post_epoch").alias("A_adopt_epoch"))
    b = adoption.select(F.col("user").alias("B"), "hashtag", F.col("first_post_epoch").alias("B_adopt_epoch"))
    late = exposed.join(b, ["B", "hashtag"]).where(F.col("B_adopt_epoch") > F.col("exposure_epoch"))
    kinds = late.groupBy("hashtag", "A", "B", "B_adopt_epoch").agg(F.min("exposure_epoch").alias("first_exposure_epoch"), F.min("exposure_type").alias("exposure_type"))
    return kinds.join(a, ["A", "hashtag"]).select("hashtag", "A", "B", "first_exposure_epoch", "A_adopt_epoch", "B_adopt_epoch", "exposure_type")


def daily_snapshots(edges: DataFrame) -> DataFrame:
    """(hashtag, adopt_day, new_edges, new_adopters, cum_edges)."""
    by_day = edges.groupBy("hashtag", epoch_day(F.col("B_adopt_epoch")).alias("adopt_day")).agg(F.count(F.lit(1)).alias("new_edges"), F.count_distinct("B").alias("new_adopters"))
    running = Window.partitionBy("hashtag").orderBy("adopt_day").rowsBetween(Window.unboundedPreceding, 0)
    return by_day.withColumn("cum_edges", F.sum("new_edges").over(running))
