"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

1. Each row gets a number of its own and the numbered rows are written to the
   shared folder. Whatever rows hold, their numbers differ, so copies of one row
   are spread like any others and none of the steps below has a hot key. Rows
   fall into partitions by a hash of the number; the partitions are counted.
2. The matrix of how many rows go from each partition to each shard is drawn
   from the multivariate hypergeometric law with these row sums and the exact
   shard sizes as column sums. That is all the driver holds: partitions x shards
   integers, bounded by `max_partitions`.
3. Each partition is permuted locally, by a seeded hash; the matrix cuts the
   permuted rows into runs, one for each shard (exchange).
4. Each shard is permuted again, by another hash. A shard may be far larger
   than a task, so it is ordered in buckets of the hash's leading bits whose
   counts give each bucket its first slot.

Everything on rows is DataFrame functions; the hashes of the written numbers
stand for random numbers, so a task that runs again gives the same rows the same
places. The seed and the layout of the input files decide the result.

Cases: null text counts one byte and has the checksum of the empty text; rows
that agree in all columns have places of their own; fewer rows than shards leave
shards empty; an empty table gives no rows; columns of the input may have any
names but those of the two new ones.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table


@dataclass(frozen=True)
class ShuffleConfig:
    shards: int = 16
    seed: int = 20_240_501
    rows_per_task: int = 250_000
    min_partitions: int = 256
    max_partitions: int = 1 << 16


def _stirling_error(n: float) -> float:
    """log(n!) less Stirling's formula, without cancellation."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n / n) / n / n) / n / n) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation near x = mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    out, power, j = (x - mean) * v, 2 * x * v, 1
    while True:
        power *= v * v
        more = out + power / (2 * j + 1)
        if more == out:
            return out
        out, j = more, j + 1


def _log_binomial(k: int, n: int, p: float) -> float:
    """Log probability of k of n at p, as a saddle point expansion: exact to rounding at any size."""
    if k == 0:
        return n * math.log1p(-p)
    if k == n:
        return n * math.log(p)
    error = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k)
    return error - _deviance(k, n * p) - _deviance(n - k, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * k * (n - k)))


def log_chance(k: int, good: int, bad: int, draws: int) -> float:
    """Log probability of k good items among `draws`."""
    p = draws / (good + bad)
    return _log_binomial(k, good, p) + _log_binomial(draws - k, bad, p) - _log_binomial(draws, good + bad, p)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good items among `draws` without replacement: the inverse of the distribution, walked outward from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    peak = math.exp(log_chance(mode, good, bad, draws))
    u = rng.random() - peak
    a = b = mode
    pa = pb = peak
    while u > 0 and (a > low or b < high):
        if b < high:
            pb *= (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1))
            b += 1
            u -= pb
            if u <= 0:
                return b
        if a > low:
            pa *= a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            u -= pa
            if u <= 0:
                return a
        if pa < 1e-300 and pb < 1e-300:
            break  # what rounding left over
    return mode


def communication_matrix(rng: random.Random, rows: list[int], columns: list[int]) -> list[list[int]]:
    """Counts with the given sums, as a uniform assignment of all items would have them."""
    assert sum(rows) == sum(columns)
    left, out = list(columns), []
    for n in rows:
        rest, own = sum(left), []
        for k, room in enumerate(left):
            got = hypergeometric(rng, room, rest - room, n)
            rest -= room
            n -= got
            left[k] -= got
            own.append(got)
        out.append(own)
    return out


def shard_sizes(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def spread(spark: SparkSession, docs: DataFrame, cfg: ShuffleConfig = ShuffleConfig()) -> DataFrame:
    """docs with __shard (int) and __slot (long): a uniform permutation into shards whose sizes differ by one at most."""
    base = scratch(spark, "shuffle")
    docs.select(F.struct("*").alias("__doc"), F.monotonically_increasing_id().alias("__row")).write.parquet(base)
    keyed = spark.read.parquet(base).withColumn("__h", F.xxhash64(F.lit(cfg.seed), "__row"))
    total = keyed.count()
    parts = min(cfg.max_partitions, max(cfg.min_partitions, -(-total // cfg.rows_per_task)))
    keyed = keyed.withColumn("__p", F.pmod("__h", F.lit(parts)).cast("int"))
    counts = [0] * parts
    for p, n in keyed.groupBy("__p").agg(F.count(F.lit(1))).collect():
        counts[p] = n
    matrix = communication_matrix(random.Random(cfg.seed), counts, shard_sizes(total, cfg.shards))
    ends = [(p, [sum(own[: k + 1]) for k in range(cfg.shards)]) for p, own in enumerate(matrix)]
    cuts = F.broadcast(spark.createDataFrame(ends, "__q int, __ends array<long>"))  # partitions x shards integers: a proven bound
    local = F.row_number().over(Window.partitionBy("__p").orderBy(F.xxhash64(F.lit(cfg.seed + 1), "__h"), "__row")) - 1
    # With a full partition's rows in permuted order, run k of the matrix goes to shard k.
    dealt = keyed.withColumn("__r", local).join(cuts, F.col("__p") == F.col("__q")).withColumn("__shard", F.size(F.filter("__ends", lambda end: end <= F.col("__r"))))
    buckets = 1 << max(4, math.ceil(math.log2(max(1, total / cfg.shards / cfg.rows_per_task))))
    dealt = dealt.withColumn("__h", F.xxhash64(F.lit(cfg.seed + 2), "__h")).withColumn("__b", F.pmod(F.shiftright("__h", 40), F.lit(buckets)).cast("int")).drop("__p", "__q", "__r", "__ends")
    first = dealt.groupBy("__shard", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    first = first.select(F.col("__shard").alias("__s"), F.col("__b").alias("__c"), F.coalesce(before, F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy("__shard", "__b").orderBy("__h", "__row")) - 1
    placed = dealt.withColumn("__w", within).join(first, (F.col("__shard") == F.col("__s")) & (F.col("__b") == F.col("__c")))
    return placed.select("__doc.*", "__shard", (F.col("__first") + F.col("__w")).alias("__slot"))


def op7_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = spread(spark, sized)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
