"""Stratified splits and folds by tag. Ranks come from md5 of tag and seed, so any engine gives the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def burst_rates(samples: DataFrame) -> DataFrame:
    """(hashtag, n_samples, n_bursts, rate)."""
    y = F.col("label").cast("double")
    return samples.groupBy("hashtag").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("label").cast("long").alias("n_bursts"), F.avg(y).alias("rate"))


def mean_rates(datasets: list[DataFrame]) -> DataFrame:
    """(hashtag, rate): the mean over datasets of a tag's rate, each dataset counting once."""
    rows = burst_rates(datasets[0]).select("hashtag", "rate")
    for d in datasets[1:]:
        rows = rows.unionByName(burst_rates(d).select("hashtag", "rate"))
    return rows.groupBy("hashtag").agg(F.avg("rate").alias("rate"))


def strat_bins(rates: DataFrame) -> DataFrame:
    """rates with a bin: one for fewer than two distinct rates, equal widths for fewer than four, else quartiles; where quartile edges coincide, three equal widths."""
    stats = rates.agg(F.count_distinct("rate").alias("__d"), F.min("rate").alias("__lo"), F.max("rate").alias("__hi"), F.percentile("rate", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"))
    both = rates.crossJoin(F.broadcast(stats))  # one row
    q = [F.col("__lo"), *(F.col("__q")[i] for i in range(3)), F.col("__hi")]
    clean = (q[0] < q[1]) & (q[1] < q[2]) & (q[2] < q[3]) & (q[3] < q[4])

    def equal(n: Column) -> Column:
        place = F.ceil((F.col("rate") - q[0]) / ((q[4] - q[0]) / n)) - 1
        return F.greatest(F.lit(0), F.least(place, n - 1)).cast("int")

    quart = sum(((F.col("rate") > q[i]).cast("int") for i in (1, 2, 3)), F.lit(0))
    few = F.when(F.col("__d") == 2, equal(F.lit(2))).otherwise(equal(F.lit(3)))
    place = F.when(F.col("__d") < 2, F.lit(0)).when(F.col("__d") < 4, few).when(clean, quart).otherwise(equal(F.lit(3)))
    return both.withColumn("bin", place.cast("int")).drop("__d", "__lo", "__hi", "__q")


def merge_rare_bins(binned: DataFrame, least: int = 2) -> DataFrame:
    """Bins with fewer tags than `least` go to the larger bin with the nearest median rate. There are four bins at most."""
    stats = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.percentile("rate", 0.5).alias("mid"))
    rare = stats.where(F.col("n") < least).select(F.col("bin").alias("from"), F.col("mid").alias("m"))
    good = stats.where(F.col("n") >= least).select(F.col("bin").alias("to"), "mid")
    near = F.row_number().over(Window.partitionBy("from").orderBy(F.abs(F.col("mid") - F.col("m")), "to"))
    moves = rare.crossJoin(good).withColumn("r", near).where("r = 1").select("from", "to")
    return binned.join(F.broadcast(moves), F.col("bin") == F.col("from"), "left").withColumn("bin", F.coalesce("to", "bin")).drop("from", "to")


def tag_rank(binned: DataFrame, seed: int = 42) -> DataFrame:
    """binned with the tag's rank (from 0) and the size of its bin."""
    own = Window.partitionBy("bin")
    rank = F.row_number().over(own.orderBy(F.md5(F.concat("hashtag", F.lit(str(seed)))), "hashtag")) - 1
    return binned.withColumn("rank", rank).withColumn("size", F.count(F.lit(1)).over(own))


def group_split(binned: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """(hashtag, bin, split): tags of each bin dealt to train, val and test in these shares."""
    place = (F.col("rank") + 0.5) / F.col("size")
    split = F.when(place < train, "train").when(place < train + val, "val").otherwise("test")
    return tag_rank(binned, seed).select("hashtag", "bin", split.alias("split"))


def group_folds(binned: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """(hashtag, bin, fold): each tag is in exactly one test fold."""
    return tag_rank(binned, seed).select("hashtag", "bin", (F.col("rank") % folds).cast("int").alias("fold"))


def split_summary(samples: DataFrame, assignment: DataFrame, by: str = "split") -> DataFrame:
    """Tags, samples, bursts and burst rate of each split."""
    both = samples.join(assignment.select("hashtag", by), "hashtag")
    return both.groupBy(by).agg(F.count_distinct("hashtag").alias("n_hashtags"), F.count(F.lit(1)).alias("n_samples"), F.sum("label").cast("long").alias("n_bursts"), F.avg(F.col("label").cast("double")).alias("burst_rate"))
