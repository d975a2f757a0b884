"""Change points and burst labels of label windows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import assign_windows, window_ends


def pelt(values: np.ndarray, penalty: float, min_size: int = 7, jump: int = 5) -> list[int]:
    """Positions at which a segmentation of least squared error, plus `penalty` for each change, begins a new segment.

    Candidates are multiples of `jump`. One that is worse at t than a start at t
    is pruned, but not before a segment from t may end: at t + min_size.
    """
    n = len(values)
    s1, s2 = np.r_[0.0, np.cumsum(values)], np.r_[0.0, np.cumsum(values * values)]

    def cost(a: np.ndarray, b: int) -> np.ndarray:
        return s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / (b - a)

    ends = [t for t in range(jump * math.ceil(min_size / jump), n, jump) if t >= min_size] + [n]
    best, back = {0: 0.0}, {}
    alive, doomed = [0], {}
    for t in ends:
        alive = [a for a in alive if t - doomed.get(a, t) < min_size]
        some = np.array([a for a in alive if t - a >= min_size], int)
        if not len(some):
            best[t], back[t] = math.inf, 0
            alive.append(t)
            continue
        total = np.array([best[a] for a in some]) + cost(some, t) + penalty
        k = int(total.argmin())
        best[t], back[t] = float(total[k]), int(some[k])
        for a in some[total > best[t] + penalty].tolist():
            doomed.setdefault(a, t)
        alive.append(t)
    out, t = [], n
    while t > 0:
        t = back[t]
        if t > 0:
            out.append(t)
    return out[::-1]


def change_points(series: DataFrame, value: str, penalty: float | str = "bic", min_size: int = 7, jump: int = 5, key: str = "hashtag", day: str = "date") -> DataFrame:
    """(hashtag, cp_date): days that begin a new level of a tag's whole series. A penalty given as text means ln(n); series of 14 rows or fewer have none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        v = pdf["v"].to_numpy(float)
        at = pelt(v, math.log(len(v)) if isinstance(penalty, str) else float(penalty), min_size, jump) if len(v) > 14 else []
        return pdf.iloc[at][[key, day]].rename(columns={day: "cp_date"})

    rows = series.select(key, day, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    return rows.groupBy(key).applyInPandas(run, f"{key} string, cp_date date")


def window_means(series: DataFrame, value: str, width: int = 30, step: int = 30, coverage: int = 9) -> DataFrame:
    """Windows with at least `coverage` rows, the mean of a value in them and in the `width` days before (0 without rows)."""
    v = F.col(value).cast("double")
    inside = assign_windows(series, width, step).groupBy("hashtag", "window_end").agg(F.avg(v).alias("mean_now"), F.count(F.lit(1)).alias("n_rows"))
    ends = window_ends(series, width, step)
    # The days before a window are the window that ends at its start, of a grid that begins one width earlier.
    bounds = series.groupBy("hashtag").agg(F.date_sub(F.min("date"), width).alias("first_day"), F.max("date").alias("last_day"))
    earlier = assign_windows(series, width, step, ends=bounds).groupBy("hashtag", F.col("window_end").alias("window_start")).agg(F.avg(v).alias("mean_before"))
    both = ends.join(inside, ["hashtag", "window_end"]).where(F.col("n_rows") >= coverage).join(earlier, ["hashtag", "window_start"], "left")
    return both.select("hashtag", "window_end", "window_start", "n_rows", "mean_now", F.coalesce("mean_before", F.lit(0.0)).alias("mean_before"))


def burst_labels(means: DataFrame, points: DataFrame, metric: str, abs_jump: float = 10.0, rel_jump: float = 1.0) -> DataFrame:
    """A window bursts if a change point lies inside (start, end], the mean rises by abs_jump and to at least 1 + rel_jump of the previous one; from 0, the ratio is infinite."""
    # A tag has few windows and change points, so this stays far smaller than its series.
    found = means.join(points, "hashtag").where((F.col("cp_date") > F.col("window_start")) & (F.col("cp_date") <= F.col("window_end"))).groupBy("hashtag", "window_end").agg(F.count(F.lit(1)).alias("n_cp"))
    both = means.join(found, ["hashtag", "window_end"], "left")
    jump = F.col("mean_now") - F.col("mean_before")
    ratio = F.when(F.col("mean_before") > 0, F.col("mean_now") / F.col("mean_before")).otherwise(F.lit(float("inf")))
    has = F.col("n_cp").isNotNull()
    label = (has & (jump >= abs_jump) & (ratio >= 1 + rel_jump)).cast("int")
    return both.select("hashtag", "window_end", "window_start", label.alias(f"label_{metric}"), has.alias(f"has_cp_inside_boundary_{metric}"), jump.alias(f"jump_absolute_{metric}"), ratio.alias(f"jump_ratio_{metric}"), F.col("mean_now").alias(f"mean_current_{metric}"), F.col("mean_before").alias(f"mean_previous_{metric}"))


def label_summary(labels: DataFrame, columns: list[str]) -> DataFrame:
    """Windows of each tag and the percentage of bursts."""
    return labels.groupBy("hashtag").agg(F.count(F.lit(1)).alias("n_windows"), *(F.round(F.avg(F.col(c).cast("double")) * 100, 6).alias(f"pct_{c}") for c in columns))


def near_boundary(windows: DataFrame, points: DataFrame, guard_days: int = 7) -> DataFrame:
    """The older rule: whether a change point lies within guard_days of the window's start."""
    close = F.abs(F.datediff("cp_date", "window_start")) <= guard_days
    found = windows.select("hashtag", "window_end", "window_start").join(points, "hashtag").where(close).groupBy("hashtag", "window_end").agg(F.count(F.lit(1)).alias("n"))
    return windows.select("hashtag", "window_end").join(found, ["hashtag", "window_end"], "left").select("hashtag", "window_end", F.col("n").isNotNull().alias("has_cp_near_boundary"))
