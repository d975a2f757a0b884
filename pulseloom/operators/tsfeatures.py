"""Time-series features of a metric in each window, in one aggregation over the
rows of all windows; only the peak count needs a vectorised kernel on the values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import divide, pearson

KEYS = ["hashtag", "window_end"]
ZERO = 0.01

#: Feature names by family; a column is ts_<metric>_<name>.
FAMILIES = {
    "level_dispersion": ["mean_raw", "std_raw", "median_raw", "cv_raw", "mean_log", "std_log"],
    "growth_acceleration": ["growth_7_14", "mean_last7", "mean_prev7"],
    "trend": ["slope_30", "trend_r2"],
    "peak_detection": ["peak_ratio", "n_peaks", "peak_position", "max_raw"],
    "percentiles": ["p25", "p50", "p75", "p90", "iqr"],
    "recency": ["recency_ratio", "mean_first7"],
    "sparsity": ["pct_zero", "n_nonzero_days", "max_zero_streak"],
    "volatility": ["volatility_diff", "volatility_diff_recent7"],
    "autocorrelation": ["acf1", "acf3", "acf7"],
    "changepoint": ["recent_cp_flag", "last_cp_jump"],
}


def peak_count(values: np.ndarray, prominence: float) -> int:
    """Local maxima (a plateau counts once, ends never) that rise at least `prominence` above the higher of their two bases."""
    n, found, i = len(values), 0, 1
    while i < n - 1:
        j = i
        while j + 1 < n and values[j + 1] == values[i]:
            j += 1
        if values[i - 1] < values[i] and j + 1 < n and values[j + 1] < values[i]:
            bases = []
            for step, at in ((-1, i), (1, j)):
                low, k = values[i], at
                while 0 <= k < n and values[k] <= values[i]:
                    low = min(low, values[k])
                    k += step
                bases.append(low)
            found += values[i] - max(bases) >= prominence
        i = j + 1
    return int(found)


def peaks(values: Column, mean: Column, min_prominence: float = 1.5) -> Column:
    """Peaks of an array column whose prominence is at least mean * (min_prominence - 1)."""

    @F.pandas_udf("long")
    def count(v: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([peak_count(np.asarray(x, float), float(y) * (min_prominence - 1)) for x, y in zip(v, m, strict=True)])

    return count(values, mean)


def positioned(rows: DataFrame, value: str, keys: list[str] = KEYS, day: str = "date") -> DataFrame:
    """keys, v, pos (from 1), n and the values 1, 3 and 7 rows before."""
    order = Window.partitionBy(*keys).orderBy(day)
    v = F.col(value).cast("double")
    out = rows.select(*keys, day, v.alias("v"), F.row_number().over(order).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"), *(F.lag(v, k).over(order).alias(f"l{k}") for k in (1, 3, 7)))
    zero = F.col("v") < ZERO
    run = F.col("pos") - F.row_number().over(Window.partitionBy(*keys, zero).orderBy(day))
    return out.withColumn("run", F.count(F.lit(1)).over(Window.partitionBy(*keys, zero, run))).withColumn("run", F.when(zero, F.col("run")).otherwise(0))


def _mean_at(first: int, last: int) -> Column:
    return F.coalesce(F.avg(F.when(F.col("pos").between(first, last), F.col("v"))), F.lit(0.0))


def features(rows: DataFrame, value: str, metric: str, families: tuple[str, ...] = tuple(FAMILIES)[:-1], keys: list[str] = KEYS, day: str = "date") -> DataFrame:
    """keys and ts_<metric>_<feature>; positions are rows of the sparse series. Windows that are too short for a family have NULL there."""
    v, n = F.col("v"), F.max("n")
    std, mean, top = F.stddev_pop("v"), F.avg("v"), F.max("v")
    diff = v - F.col("l1")
    # The last seven rows have six differences; of fewer rows all count.
    late = F.when((F.col("n") < 7) | (F.col("pos") > F.col("n") - 6), diff)
    q = F.percentile("v", F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75, 0.9))))

    def acf(k: int) -> Column:
        pair = F.col(f"l{k}").isNotNull()
        value = F.coalesce(pearson(F.when(pair, v), F.when(pair, F.col(f"l{k}"))), F.lit(0.0))
        return F.when(n >= 8, value)

    cells = {
        "mean_raw": mean, "std_raw": std, "median_raw": F.percentile("v", 0.5), "cv_raw": divide(std, mean), "mean_log": F.log1p(mean), "std_log": F.log1p(std),
        "growth_7_14": F.when(n >= 14, divide(_mean_at(24, 30) - _mean_at(17, 23), _mean_at(17, 23))), "mean_last7": F.when(n >= 14, _mean_at(24, 30)), "mean_prev7": F.when(n >= 14, _mean_at(17, 23)),
        "slope_30": F.when(n >= 2, F.coalesce(F.when(std > 0, F.regr_slope(v, F.col("pos").cast("double") - 1)), F.lit(0.0))), "trend_r2": F.when(n >= 2, F.coalesce(F.when(std > 0, F.regr_r2(v, F.col("pos").cast("double") - 1)), F.lit(0.0))),
        "peak_ratio": divide(top, mean, 1.0), "peak_position": F.min_by("pos", F.struct(-v, F.col("pos"))).cast("double") / n, "max_raw": top,
        "p25": q[0], "p50": q[1], "p75": q[2], "p90": q[3], "iqr": q[2] - q[0],
        "recency_ratio": F.when(n >= 14, divide(_mean_at(24, 30), _mean_at(1, 7), 1.0)), "mean_first7": F.when(n >= 14, _mean_at(1, 7)),
        "pct_zero": F.sum((v < ZERO).cast("int")).cast("double") / n, "n_nonzero_days": F.sum((v >= ZERO).cast("int")), "max_zero_streak": F.max("run"),
        "volatility_diff": F.when(n >= 2, F.stddev_pop(diff)), "volatility_diff_recent7": F.when(n >= 2, F.stddev_pop(late)),
        "acf1": acf(1), "acf3": acf(3), "acf7": acf(7),
    }
    wanted = [f for family in families if family != "changepoint" for f in FAMILIES[family]]
    packed = [F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("__x"), mean.alias("__m")] if "n_peaks" in wanted else []
    out = positioned(rows, value, keys, day).groupBy(*keys).agg(*(cells[f].alias(f"ts_{metric}_{f}") for f in wanted if f != "n_peaks"), *packed)
    if packed:
        out = out.withColumn(f"ts_{metric}_n_peaks", peaks(F.col("__x.v"), F.col("__m"))).drop("__x", "__m")
    return out.select(*keys, *(f"ts_{metric}_{f}" for f in wanted))


def changepoint_features(windows: DataFrame, labels: DataFrame, metric: str) -> DataFrame:
    """Whether a change point lies inside the window, and the jump, from the label table."""
    own = labels.select(*KEYS, F.col(f"has_cp_inside_boundary_{metric}").cast("int").alias("__f"), F.col(f"jump_absolute_{metric}").alias("__j"))
    both = windows.select(*KEYS).join(own, KEYS, "left")
    return both.select(*KEYS, F.coalesce("__f", F.lit(0)).alias(f"ts_{metric}_recent_cp_flag"), F.coalesce("__j", F.lit(0.0)).alias(f"ts_{metric}_last_cp_jump"))
