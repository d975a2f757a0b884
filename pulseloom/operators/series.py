"""Platform totals and normalised, smoothed daily series per tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch_day, per_mille, ratio


def platform_activity(posts: DataFrame) -> DataFrame:
    """(date, total_mentions, total_posts, unique_authors, unique_hashtags) over all tags."""
    return posts.groupBy(epoch_day(F.col("post_epoch")).alias("date")).agg(
        F.count(F.lit(1)).alias("total_mentions"),
        F.count_distinct("post_id").alias("total_posts"),
        F.count_distinct("author").alias("unique_authors"),
        F.count_distinct("hashtag").alias("unique_hashtags"),
    )


def platform_comments(comments: DataFrame) -> DataFrame:
    return comments.groupBy(epoch_day(F.col("comment_epoch")).alias("date")).agg(F.count(F.lit(1)).alias("total_comments"))


def posts_per_day(posts: DataFrame) -> DataFrame:
    """(date, total_posts_day): the fallback without platform totals."""
    return posts.groupBy(epoch_day(F.col("post_epoch")).alias("date")).agg(F.count_distinct("post_id").alias("total_posts_day"))


def mentions_daily(posts: DataFrame) -> DataFrame:
    return posts.groupBy("hashtag", epoch_day(F.col("post_epoch")).alias("date")).agg(F.count(F.lit(1)).alias("mentions"))


def comments_daily(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """(hashtag, date, total_comments): a comment counts once for each tag of its post."""
    tagged = posts.select("post_id", "hashtag").distinct()
    return comments.join(tagged, "post_id").groupBy("hashtag", epoch_day(F.col("comment_epoch")).alias("date")).agg(F.count(F.lit(1)).alias("total_comments"))


def moving_average(value: str, rows: int = 15, key: str = "hashtag", day: str = "date") -> Column:
    """Mean of the last rows of a sparse series: rows, not days."""
    return F.avg(value).over(Window.partitionBy(key).orderBy(day).rowsBetween(1 - rows, 0))


def normalised_mentions(daily: DataFrame, totals: DataFrame, per: int = 1000, rows: int = 15) -> DataFrame:
    """Mentions for each post and for each `per` posts of the platform on that day, and its moving average."""
    both = daily.join(totals.withColumn("total_posts_day", F.col("total_posts_day").cast("double")), "date", "left")
    share = both.withColumn("mentions_per_post", ratio(F.col("mentions").cast("double"), F.col("total_posts_day")))
    scaled = share.withColumn(f"mentions_per_{per}posts", F.col("mentions_per_post") * F.lit(float(per)))
    return scaled.withColumn(f"mentions_per_{per}posts_ma7", moving_average(f"mentions_per_{per}posts", rows)).select("hashtag", "date", "mentions", "total_posts_day", "mentions_per_post", f"mentions_per_{per}posts", f"mentions_per_{per}posts_ma7")


def normalised_comments(daily: DataFrame, totals: DataFrame, rows: int = 15) -> DataFrame:
    both = daily.join(totals.withColumnRenamed("total_comments", "total_comments_platform"), "date", "left")
    scaled = both.withColumn("norm_platform", per_mille(F.col("total_comments").cast("double"), F.col("total_comments_platform").cast("double")))
    return scaled.withColumn("smoothed_norm_platform", moving_average("norm_platform", rows)).select("hashtag", "date", "total_comments", "total_comments_platform", "norm_platform", "smoothed_norm_platform")


def tag_frequency(posts: DataFrame, top: int = 200) -> DataFrame:
    """The most frequent tags, ties by name."""
    return posts.groupBy("hashtag").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "hashtag").limit(top)


def combined_daily(mentions: DataFrame, comments: DataFrame) -> DataFrame:
    """(hashtag, date, mentions, comments): full outer by day, a missing side is 0; repeated days add up."""
    m = mentions.groupBy("hashtag", "date").agg(F.sum("mentions").alias("mentions"))
    c = comments.groupBy("hashtag", "date").agg(F.sum("total_comments").alias("comments"))
    return m.join(c, ["hashtag", "date"], "full").select("hashtag", "date", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("comments", F.lit(0)).alias("comments"))
