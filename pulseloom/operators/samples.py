"""Samples: features of a window with the label of the next one, and their completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["hashtag", "window_end"]
PREFIXES = ("ts_", "net_", "emb_", "attr_", "gae_")


def join_families(families: dict[str, DataFrame], enabled: tuple[str, ...] | None = None, how: str = "inner") -> DataFrame:
    """The enabled feature tables side by side (all by default; the first is the base); a column that an earlier one has too gets its family's name as suffix."""
    names = [n for n in families if enabled is None or n in enabled]
    if not names:
        raise ValueError("no feature family is enabled")
    out = families[names[0]]
    for name in names[1:]:
        other = families[name]
        cells = [F.col(c).alias(f"{c}_{name}" if c in out.columns else c) for c in other.columns if c not in KEYS]
        out = out.join(other.select(*KEYS, *cells), KEYS, how)
    return out


def presence(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many keys are in both tables, only left or only right."""
    both = left.select(*KEYS, F.lit(1).alias("l")).join(right.select(*KEYS, F.lit(1).alias("r")), KEYS, "full")
    return both.agg(F.sum((F.col("l").isNotNull() & F.col("r").isNotNull()).cast("int")).alias("n_both"), F.sum(F.col("r").isNull().cast("int")).alias("n_left"), F.sum(F.col("l").isNull().cast("int")).alias("n_right"))


def next_label_samples(features: DataFrame, labels: DataFrame, label: str, gap_days: int = 30) -> DataFrame:
    """Features with the label of the first label window strictly later, kept if it ends exactly gap_days later.

    One sort by tag over features and labels together instead of a range join.
    """
    f = features.select("hashtag", "window_end", F.lit(1).alias("side"), F.lit(None).cast("int").alias("y"))
    l = labels.where(F.col(label).isNotNull()).select("hashtag", "window_end", F.lit(0).alias("side"), F.col(label).cast("int").alias("y"))  # noqa: E741
    line = f.unionByName(l).withColumn("d", F.datediff("window_end", F.lit("1970-01-01").cast("date")))
    later = Window.partitionBy("hashtag").orderBy("d").rangeBetween(1, Window.unboundedFollowing)
    nearest = F.min(F.when(F.col("side") == 0, F.struct("d", "window_end", "y"))).over(later)
    found = line.withColumn("next", nearest).where("side = 1").select("hashtag", "window_end", F.col("next.window_end").alias("next_window_end"), F.datediff("next.window_end", "window_end").alias("gap_days"), F.col("next.y").alias("label"))
    return features.join(found.where(F.col("gap_days") == gap_days), KEYS)


def completeness(samples: DataFrame, prefixes: tuple[str, ...] = PREFIXES, enough: float = 0.95) -> DataFrame:
    """samples with the share of known feature columns and whether that is enough."""
    columns = [c for c in samples.columns if c.startswith(prefixes)]
    known = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    share = known.cast("double") / F.lit(float(max(1, len(columns))))
    return samples.withColumn("feature_coverage", share).withColumn("has_all_data", share >= enough)


def feature_columns(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, prefixes: tuple[str, ...] = PREFIXES) -> list[str]:
    """Numeric columns with a feature prefix that match an include pattern (if any are given) and no exclude pattern."""
    import re

    kinds = {"int", "bigint", "double", "float", "boolean", "smallint", "tinyint"}
    names = [c for c, k in df.dtypes if c.startswith(prefixes) and k in kinds]
    if include:
        names = [c for c in names if any(re.search(p, c) for p in include)]
    return [c for c in names if not any(re.search(p, c) for p in exclude or [])]


def dataset_version(samples: DataFrame, version: str) -> DataFrame:
    """One row about a dataset: tags, samples, features by prefix, burst rate, complete rows."""
    counts = {f"n_{p.rstrip('_')}_features": sum(c.startswith(p) for c in samples.columns) for p in PREFIXES}
    return samples.agg(
        F.lit(version).alias("version"),
        F.count_distinct("hashtag").alias("n_hashtags"),
        F.count(F.lit(1)).alias("n_samples"),
        F.lit(sum(counts.values())).alias("n_features"),
        F.round(F.avg(F.col("label").cast("double")), 6).alias("burst_rate"),
        F.sum(F.col("has_all_data").cast("int")).alias("n_complete"),
        *(F.lit(n).alias(name) for name, n in counts.items()),
    )
