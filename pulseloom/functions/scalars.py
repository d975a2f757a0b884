"""Scalar expressions: guarded ratios, epochs, tags and missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, else NULL."""
    return F.when(b > 0, a / b)


def divide(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, and `default` for a zero divisor."""
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def per_mille(a: Column, b: Column, per: float = 1000.0, eps: float = 1e-9) -> Column:
    """a for each `per` of b, with an epsilon instead of a guard."""
    return a / (b + F.lit(eps)) * F.lit(per)


def finite(a: Column, default: float = 0.0) -> Column:
    """NULL, NaN and infinities become `default`."""
    return F.when(a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")), F.lit(default)).otherwise(a)


def normal_tag(tag: Column) -> Column:
    """Lower case, no surrounding blanks, no leading #."""
    return F.ltrim(F.trim(F.lower(tag)), F.lit("#"))


def tag_filter(df: DataFrame, tags: list[str], column: str = "hashtag", contains: bool = False) -> DataFrame:
    """Rows of the given tags; an empty list keeps all. contains: by regular expression within the tag."""
    if not tags:
        return df
    if contains:
        return df.where(F.lower(column).rlike("|".join(t.lower() for t in tags)))
    return df.where(F.lower(column).isin([t.lower() for t in tags]))


def day_epoch(day: Column) -> Column:
    """Seconds from 1970 to a date's start, in whatever session zone."""
    return F.datediff(day.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * F.lit(86400)


def epoch_day(seconds: Column) -> Column:
    """The UTC date of epoch seconds, in whatever session zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / F.lit(86400)).cast("int"))


def to_seconds(df: DataFrame, column: str) -> DataFrame:
    """Epoch column in seconds: milliseconds if the median, read as milliseconds, is later than 1980 while read as seconds it would lie beyond year 9999."""
    median = df.agg(F.percentile_approx(column, 0.5)).first()[0]
    if median is not None and median > 253_402_300_799:
        return df.withColumn(column, F.floor(F.col(column) / 1000).cast("long"))
    return df


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL for a constant side."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")
