"""Rolling windows (end - width, end] that start at a key's first day and step on.

Days find their windows by arithmetic on ordinals, so an event joins its
overlapping windows by an explode, never by a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extents(df: DataFrame, key: str = "hashtag", day: str = "date") -> DataFrame:
    return df.groupBy(key).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def window_ends(df: DataFrame, width: int = 90, step: int = 30, key: str = "hashtag", day: str = "date") -> DataFrame:
    """(key, window_start, window_end): ends at first day + width, and every `step` days up to the last day."""
    span = F.datediff("last_day", "first_day")
    ordinals = F.sequence(F.lit(0), F.floor((span - width) / step).cast("int"))
    each = extents(df, key, day).where(span >= width).select(key, "first_day", F.explode(ordinals).alias("k"))
    end = F.expr(f"date_add(first_day, {width} + {step} * k)")
    return each.select(key, F.date_sub(end, width).alias("window_start"), end.alias("window_end"))


def assign_windows(df: DataFrame, width: int = 90, step: int = 30, key: str = "hashtag", day: str = "date", ends: DataFrame | None = None) -> DataFrame:
    """df with window_end: a row for each window that holds its day; the key's very first day is in none, as starts are exclusive. ends: extents from elsewhere."""
    bounds = ends if ends is not None else extents(df, key, day)
    n = F.datediff(F.col(day), F.col("first_day"))
    low = F.greatest(F.lit(0), F.ceil((n - width) / step)).cast("int")
    high = F.least(F.ceil(n / step) - 1, F.floor((F.datediff("last_day", "first_day") - width) / step)).cast("int")
    # sequence() counts down where its bounds are crossed; those rows go first.
    placed = df.join(bounds, key).withColumn("__low", low).withColumn("__high", high).where("__low <= __high")
    each = placed.withColumn("__k", F.explode(F.sequence("__low", "__high")))
    return each.withColumn("window_end", F.expr(f"date_add(first_day, {width} + {step} * __k)")).drop("__low", "__high", "__k", "first_day", "last_day")


def next_window(windows: DataFrame, step: int = 30, key: str = "hashtag") -> DataFrame:
    """windows with the next existing end, the gap in days and whether the gap is one step."""
    after = F.lead("window_end").over(Window.partitionBy(key).orderBy("window_end"))
    with_next = windows.withColumn("next_window_end", after).withColumn("next_window_gap_days", F.datediff("next_window_end", "window_end"))
    return with_next.withColumn("has_next_window", F.col("next_window_end").isNotNull()).withColumn("is_contiguous", F.coalesce(F.col("next_window_gap_days") == step, F.lit(False)))


def within(day: Column, start: Column, end: Column, closed: bool = False) -> Column:
    """(start, end], or [start, end] for the closed kind."""
    return (day >= start if closed else day > start) & (day <= end)
