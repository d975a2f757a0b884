"""Evaluation of scored predictions: curves, thresholds, tolerant matching, error kinds.

A prediction row has hashtag, window_end, label, a score and y_pred. Curves count
distinct scores first, so they cost one small sort however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import divide


def _d(c: Column) -> Column:
    return c.cast("double")


def score_counts(pred: DataFrame, score: str, label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """Positives and negatives of each distinct score."""
    return pred.groupBy(*keys, F.col(score).alias("s")).agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))


def running(counts: DataFrame, sums: dict[str, Column], keys: tuple[str, ...] = (), descending: bool = False, ranges: int = 256) -> DataFrame:
    """counts with each sum of `sums` over the rows before and up to each row, by s.

    Scores are dealt to about `ranges` ranges by approximate quantiles, which are
    taken once and fixed; each range sums its own rows, and the sums of the ranges
    before it are added. So no task holds all distinct scores.
    """
    bounds = sorted(set(counts.select(F.col("s").cast("double").alias("s")).approxQuantile("s", [i / ranges for i in range(1, ranges)], 0.5 / ranges)))
    # A score's range is the number of bounds below it; missing scores come first, NaN last, as in Spark's order.
    place = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col("s").cast("double"))), F.lit(0)) if bounds else F.lit(0)
    rows = counts.withColumns({"__b": place, **{f"__v_{c}": x for c, x in sums.items()}})
    by = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    before = Window.partitionBy(*keys).orderBy(by("__b")).rowsBetween(Window.unboundedPreceding, -1)
    part = rows.groupBy(*keys, "__b").agg(*(F.sum(f"__v_{c}").alias(f"__v_{c}") for c in sums))
    part = part.select(*keys, "__b", *(F.coalesce(F.sum(f"__v_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums))
    inside = Window.partitionBy(*keys, "__b").orderBy(by("s")).rowsBetween(Window.unboundedPreceding, 0)
    full = rows.join(part, [*keys, "__b"])
    full = full.withColumns({c: F.sum(f"__v_{c}").over(inside) + F.col(f"__o_{c}") for c in sums})
    return full.drop("__b", *(f"__v_{c}" for c in sums), *(f"__o_{c}" for c in sums))


def roc_auc(pred: DataFrame, score: str, label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve; tied scores count half."""
    c = running(score_counts(pred, score, label, keys), {"upto": F.col("neg")}, keys)
    c = c.withColumn("w", _d(F.col("pos")) * (_d(F.col("upto")) - _d(F.col("neg")) / 2))
    total = _d(F.sum("pos")) * _d(F.sum("neg"))
    return c.groupBy(*keys).agg(F.when(total > 0, F.sum("w") / total).alias("roc_auc"))


def average_precision(pred: DataFrame, score: str, label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """Steps of recall times precision, from the highest score; ties are one step."""
    c = running(score_counts(pred, score, label, keys), {"tp": F.col("pos"), "n": F.col("pos") + F.col("neg")}, keys, descending=True)
    return c.groupBy(*keys).agg(F.when(F.sum("pos") > 0, F.sum(_d(F.col("pos")) * _d(F.col("tp")) / _d(F.col("n"))) / _d(F.sum("pos"))).alias("average_precision"))


def confusion(label: str = "label", pred: str = "y_pred") -> dict[str, Column]:
    y, p = F.col(label), F.col(pred)
    return {name: F.coalesce(F.sum(((y == a) & (p == b)).cast("long")), F.lit(0)) for name, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))}


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1, accuracy and more; 0 where undefined."""
    tp, fp, fn, tn = map(_d, (tp, fp, fn, tn))
    recall, spec = divide(tp, tp + fn), divide(tn, tn + fp)
    return {"precision": divide(tp, tp + fp), "recall": recall, "f1": divide(2 * tp, 2 * tp + fp + fn), "accuracy": divide(tp + tn, tp + fp + fn + tn), "youden": recall + spec - 1, "balanced_accuracy": (recall + spec) / 2}


def classification_report(pred: DataFrame, keys: tuple[str, ...] = (), label: str = "label", y_pred: str = "y_pred") -> DataFrame:
    c = pred.groupBy(*keys).agg(*(v.alias(k) for k, v in confusion(label, y_pred).items()))
    r = rates(*(F.col(k) for k in ("tp", "fp", "fn", "tn")))
    return c.withColumns({k: r[k] for k in ("precision", "recall", "f1", "accuracy")})


def threshold_curve(pred: DataFrame, score: str, points: list[float], label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates at each threshold (score >= t predicts 1): the grid joins distinct scores by cumulative counts, not rows."""
    grid = sorted(points)
    # The number of grid points that a score reaches; each threshold's counts are then suffix sums of at most len(grid) + 1 buckets.
    place = sum(((F.col(score) >= t).cast("int") for t in grid), F.lit(0))
    buckets = pred.groupBy(*keys, place.alias("b")).agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    each = buckets.withColumn("g", F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.lit(i + 1).alias("i")) for i, t in enumerate(grid)))))
    over = F.col("b") >= F.col("g.i")

    def total(c: str, inside: Column) -> Column:
        return F.sum(F.when(inside, F.col(c)).otherwise(0)).cast("long")

    counts = each.groupBy(*keys, F.col("g.threshold").alias("threshold")).agg(total("pos", over).alias("tp"), total("neg", over).alias("fp"), total("pos", ~over).alias("fn"), total("neg", ~over).alias("tn"))
    return counts.withColumns(rates(*(F.col(k) for k in ("tp", "fp", "fn", "tn"))))


def best_threshold(curve: DataFrame, objective: str = "f1", keys: tuple[str, ...] = (), constraint: tuple[str, float] | None = None) -> DataFrame:
    """The first threshold at which the objective is largest, among those that meet `constraint` (metric, minimum); no row if none does."""
    held = curve.where(F.col(constraint[0]) >= constraint[1]) if constraint else curve
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round(objective, 12)), "threshold")
    return held.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def averaged_threshold(pred: DataFrame, score: str, points: list[float], fold: str = "fold", objective: str = "f1") -> DataFrame:
    """The mean of the folds' best thresholds."""
    best = best_threshold(threshold_curve(pred, score, points, keys=(fold,)), objective, (fold,))
    return best.agg(F.avg("threshold").alias("threshold"), F.count(F.lit(1)).alias("n_folds"))


def pr_area(pred: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Trapezoid area under precision over recall, with the start at recall 0 and precision 1; null without rows."""
    c = running(score_counts(pred, score, label), {"tp": F.col("pos"), "n": F.col("pos") + F.col("neg")}, descending=True)
    # The point before a row's follows from the row itself: its own counts are taken off.
    pos, tp, n = _d(F.col("pos")), _d(F.col("tp")), _d(F.col("n"))
    n0 = n - pos - _d(F.col("neg"))
    area = pos * (tp / n + F.when(n0 > 0, (tp - pos) / n0).otherwise(1.0)) / 2
    points = F.count(F.lit(1))
    return c.agg(F.when(points > 0, divide(F.sum(area), F.sum(pos))).alias("pr_area"), points.alias("n_points"))


def _near(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "hashtag")


def relaxed_matches(pred: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """pred with the tolerant kind: a burst with a positive prediction within `before` months earlier or `after` months later counts as TP, and those predictions are no errors.

    match_type is exact, before or after; of several bursts the latest decides.
    Windows of one tag are few, so the self-join stays linear in rows.
    """
    rows = pred.select("hashtag", "window_end", "label", "y_pred")
    bursts = rows.where("label = 1").select("hashtag", F.col("window_end").alias("burst"))
    hits = rows.where("y_pred = 1").select("hashtag", F.col("window_end").alias("hit"))
    near = _near(bursts, hits).where((F.col("hit") >= F.add_months("burst", -before)) & (F.col("hit") <= F.add_months("burst", after)))
    kind = F.when(F.col("hit") == F.col("burst"), "exact").when(F.col("hit") < F.col("burst"), "before").otherwise("after")
    by_hit = near.groupBy("hashtag", F.col("hit").alias("window_end")).agg(F.max(F.struct("burst", kind.alias("k"))).alias("m")).select("hashtag", "window_end", F.col("m.k").alias("match_type"))
    found = near.select("hashtag", F.col("burst").alias("window_end"), F.lit(True).alias("found")).distinct()
    out = rows.join(by_hit, ["hashtag", "window_end"], "left").join(found, ["hashtag", "window_end"], "left")
    kind = F.when((F.col("y_pred") == 1) & F.col("match_type").isNotNull(), "TP").when(F.col("y_pred") == 1, "FP").when((F.col("label") == 1) & F.col("found").isNull(), "FN").otherwise("TN")
    return out.select("hashtag", "window_end", "label", "y_pred", F.coalesce("match_type", F.lit("none")).alias("match_type"), kind.alias("relaxed_type"))


def _gaps(rows: DataFrame, others: DataFrame, days: int) -> DataFrame:
    """rows with whether one of `others` (hashtag, other) is 1..days later, and earlier."""
    d = F.datediff("other", "window_end")
    seen = rows.join(others, "hashtag", "left").groupBy("hashtag", "window_end").agg(F.max(d.between(1, days).cast("int")).alias("later"), F.max(d.between(-days, -1).cast("int")).alias("earlier"))
    return seen.fillna(0, ["later", "earlier"])


def false_positives(pred: DataFrame, days: int = 60) -> DataFrame:
    """Each false positive: too_early (a burst follows within `days`), else too_late (one came before), else totally_wrong."""
    rows = pred.where("label = 0 and y_pred = 1").select("hashtag", "window_end")
    bursts = pred.where("label = 1").select("hashtag", F.col("window_end").alias("other"))
    kind = F.when(F.col("later") == 1, "too_early").when(F.col("earlier") == 1, "too_late").otherwise("totally_wrong")
    return _gaps(rows, bursts, days).select("hashtag", "window_end", kind.alias("error_type"))


def false_negatives(pred: DataFrame, days: int = 60) -> DataFrame:
    """Each false negative: predicted too_early, else too_late, else total_miss."""
    rows = pred.where("label = 1 and y_pred = 0").select("hashtag", "window_end")
    hits = pred.where("y_pred = 1").select("hashtag", F.col("window_end").alias("other"))
    kind = F.when(F.col("earlier") == 1, "too_early").when(F.col("later") == 1, "too_late").otherwise("total_miss")
    return _gaps(rows, hits, days).select("hashtag", "window_end", kind.alias("error_type"))


def longest_run(df: DataFrame, flag: Column, key: str = "hashtag", order: str = "window_end") -> DataFrame:
    """(key, longest): the longest run of consecutive rows that meet a condition."""
    n, m = F.row_number().over(Window.partitionBy(key).orderBy(order)), F.row_number().over(Window.partitionBy(key, "f").orderBy(order))
    runs = df.select(key, order, flag.alias("f")).withColumn("i", n - m).where("f").groupBy(key, "i").agg(F.count(F.lit(1)).alias("n"))
    return df.select(key).distinct().join(runs.groupBy(key).agg(F.max("n").alias("longest")), key, "left").select(key, F.coalesce("longest", F.lit(0)).alias("longest"))


def per_tag(pred: DataFrame) -> DataFrame:
    """Report of each tag with its days and its longest run of bursts."""
    span = pred.groupBy("hashtag").agg(F.count(F.lit(1)).alias("n"), F.datediff(F.max("window_end"), F.min("window_end")).alias("span_days"))
    run = longest_run(pred, F.col("label") == 1).withColumnRenamed("longest", "max_consecutive")
    return classification_report(pred, ("hashtag",)).join(span, "hashtag").join(run, "hashtag")


def macro_summary(report: DataFrame, metrics: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """Mean and sample deviation over tags, and totals."""
    return report.agg(*(x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))), *(F.sum(c).alias(f"total_{c}") for c in ("tp", "fp", "fn", "tn")))


def categories(df: DataFrame, column: str) -> DataFrame:
    """Counts of a column's values with percentages."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def diverse_pick(scored: DataFrame, score: str, per_key: int = 2, total: int = 10, key: str = "hashtag", order: str = "window_end") -> DataFrame:
    """The best rows by score, at most per_key of a tag and `total` in all."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), order))
    return scored.withColumn("__r", rank).where(F.col("__r") <= per_key).drop("__r").orderBy(F.desc(score), key, order).limit(total)


def quality_pick(metrics: DataFrame, score: str = "test_auc", size: str = "n_nodes", above: float = 0.7, least: int = 3000, most: int = 5000, per_key: int = 2, total: int = 10) -> DataFrame:
    """The best windows for a closer look: a score over `above` and a size in least..most; quality weighs the score by 0.5, log10(size) / 4 by 0.3 and 1 - size / 2000 by 0.2."""
    n = _d(F.col(size))
    good = metrics.where((F.col(score) > above) & F.col(size).between(least, most))
    return diverse_pick(good.withColumn("quality", F.round(F.col(score) * 0.5 + F.log10(n) / 4 * 0.3 + (1 - n / 2000) * 0.2, 9)), "quality", per_key, total)


def spearman(df: DataFrame, x: str, y: str, keys: list[str], least: int = 11) -> DataFrame:
    """Rank correlation with average ranks for ties, in groups of at least `least` rows."""

    def rank(c: str) -> Column:
        w = Window.partitionBy(*keys)
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(w.partitionBy(*keys, c)) - 1) / 2.0

    ranked = df.select(*keys, rank(x).alias("a"), rank(y).alias("b"))
    value = F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), value.alias("rho")).where(F.col("n") >= least)
