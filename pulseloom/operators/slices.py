"""Window slices: aggregates and date-ordered arrays of a tag's series in each window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import day_text
from .windows import assign_windows, extents, next_window, window_ends


def slice_rows(series: DataFrame, width: int = 30, step: int = 30, bounds: DataFrame | None = None) -> DataFrame:
    """The series' rows with the window that each is in."""
    return assign_windows(series, width, step, ends=bounds)


def slice_aggregates(series: DataFrame, value: str, name: str, width: int = 30, step: int = 30) -> DataFrame:
    """Sum, mean (0 without rows) and count of a value in every window of a tag; windows without rows are there too."""
    ends = window_ends(series, width, step)
    inside = slice_rows(series, width, step).groupBy("hashtag", "window_end").agg(F.sum(value).alias("s"), F.avg(F.col(value).cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return ends.join(inside, ["hashtag", "window_end"], "left").select(
        "hashtag", "window_end", "window_start",
        F.coalesce("s", F.lit(0)).alias(f"{name}_sum"), F.coalesce("m", F.lit(0.0)).alias(f"{name}_mean"), F.coalesce("n", F.lit(0)).alias(f"{name}_count"),
    )


def slice_arrays(series: DataFrame, value: str, name: str, width: int = 30, step: int = 30) -> DataFrame:
    """Parallel arrays of dates and values, by date."""
    inside = slice_rows(series, width, step).groupBy("hashtag", "window_end").agg(F.array_sort(F.collect_list(F.struct("date", F.col(value).alias("v")))).alias("x"))
    return inside.select("hashtag", "window_end", F.transform("x", lambda x: day_text(x["date"])).alias(f"{name}_dates"), F.transform("x", lambda x: x["v"]).alias(f"{name}_values"))


def window_slices(mentions: DataFrame, comments: DataFrame, width: int = 30, step: int = 30) -> DataFrame:
    """One row for each tag and window with raw, normalised and smoothed arrays, sums and means of both metrics, and the next window."""
    bounds = extents(mentions)
    ends = next_window(window_ends(mentions, width, step), step).withColumn("window_size_days", F.lit(width))
    variants = (
        (mentions, "mentions", (("raw", "mentions"), ("norm", "mentions_per_1000posts"), ("smooth", "mentions_per_1000posts_ma7"))),
        (comments, "comments", (("raw", "total_comments"), ("norm", "norm_platform"), ("smooth", "smoothed_norm_platform"))),
    )
    out = ends
    for series, metric, columns in variants:
        rows = slice_rows(series, width, step, bounds)
        packed = rows.groupBy("hashtag", "window_end").agg(F.array_sort(F.collect_list(F.struct("date", *(F.col(c).alias(v) for v, c in columns)))).alias("x"))
        cells = []
        for v, _ in columns:
            values = F.col("x").getField(v)
            mean = F.aggregate(F.filter(values, lambda y: y.isNotNull()), F.lit(0.0), lambda a, y: a + y.cast("double"), lambda a: F.try_divide(a, F.size(values).cast("double")))
            cells += [F.transform("x", lambda x: day_text(x["date"])).alias(f"{metric}_{v}_dates"), values.alias(f"{metric}_{v}_{'counts' if v == 'raw' else 'values'}"), F.coalesce(mean, F.lit(0.0)).alias(f"{metric}_{v}_mean")]
            if v == "raw":
                cells += [F.aggregate(values, F.lit(0).cast("long"), lambda a, y: a + y).alias(f"{metric}_raw_sum"), F.size(values).alias(f"{metric}_raw_count")]
        part = packed.select("hashtag", "window_end", *cells, F.lit(True).alias(f"has_{metric}_data"))
        out = out.join(part, ["hashtag", "window_end"], "left").withColumn(f"has_{metric}_data", F.coalesce(f"has_{metric}_data", F.lit(False)))
    return out
