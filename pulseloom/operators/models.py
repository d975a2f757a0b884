"""Classifiers over feature columns: baselines, class weights, pipelines, nested folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite
from .evaluate import average_precision, averaged_threshold, classification_report, roc_auc
from .splits import group_folds

GRID = [round(0.10 + 0.01 * i, 2) for i in range(81)]


def prepared(samples: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """Missing and infinite features become 0; rows carry balanced class weights n / (2 n_c)."""
    clean = samples.withColumns({c: finite(F.col(c).cast("double")) for c in columns})
    totals = clean.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    weights = totals.crossJoin(totals.agg(F.sum("__n").alias("__t"))).select(F.col(label).alias("__y"), (F.col("__t") / (2.0 * F.col("__n"))).alias("weight"))
    return clean.join(F.broadcast(weights), F.col(label) == F.col("__y")).drop("__y")


def class_weights(samples: DataFrame, label: str = "label") -> DataFrame:
    return prepared(samples, [], label).groupBy(label).agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


def estimator(name: str, seed: int = 42):
    """An estimator of the registry; boosting libraries all map to gradient-boosted trees."""
    from pyspark.ml import classification as C

    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    made = {
        "logistic_regression": lambda: C.LogisticRegression(maxIter=100, regParam=0.01, **common),
        "decision_tree": lambda: C.DecisionTreeClassifier(maxDepth=5, minInstancesPerNode=10, seed=seed, **common),
        "random_forest": lambda: C.RandomForestClassifier(numTrees=50, maxDepth=5, minInstancesPerNode=5, seed=seed, **common),
        "gradient_boosting": lambda: C.GBTClassifier(maxIter=20, maxDepth=3, seed=seed, **common),
    }
    for alias in ("xgboost", "lightgbm", "catboost"):
        made[alias] = made["gradient_boosting"]
    return made[name]()


MODELS = ("majority", "random", "logistic_regression", "decision_tree", "random_forest", "gradient_boosting")


def fit(train: DataFrame, columns: list[str], name: str, seed: int = 42):
    """A fitted pipeline over balanced weights; logistic regression on standardised columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    scaled = name == "logistic_regression"
    stages = [VectorAssembler(inputCols=columns, outputCol="raw" if scaled else "features")]
    if scaled:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    return Pipeline(stages=[*stages, estimator(name, seed)]).fit(prepared(train, columns))


def fit_predict(train: DataFrame, test: DataFrame, columns: list[str], name: str, seed: int = 42) -> DataFrame:
    """test's hashtag, window_end, label with y_pred_proba and y_pred."""
    keys = [c for c in ("hashtag", "window_end", "label") if c in test.columns]
    if name in ("majority", "random"):
        base = train.agg(F.avg(F.col("label").cast("double"))).first()[0] or 0.0
        proba = F.lit(base) if name == "majority" else F.rand(seed)
        out = test.select(*keys, proba.alias("y_pred_proba"))
        limit = 0.5 if name == "majority" else 1.0 - base
        return out.withColumn("y_pred", (F.col("y_pred_proba") >= limit).cast("int"))
    from pyspark.ml.functions import vector_to_array

    model = fit(train, columns, name, seed)
    clean = test.withColumns({c: finite(F.col(c).cast("double")) for c in columns})
    out = model.transform(clean).withColumn("y_pred_proba", F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)))  # one class in training: never a burst
    return out.select(*keys, "y_pred_proba", (F.col("y_pred_proba") >= 0.5).cast("int").alias("y_pred"))


def prediction_types(pred: DataFrame) -> DataFrame:
    """pred with TP, FP, FN or TN."""
    y, p = F.col("label") == 1, F.col("y_pred") == 1
    return pred.withColumn("prediction_type", F.when(y & p, "TP").when(~y & p, "FP").when(y, "FN").otherwise("TN"))


def nested_cv(samples: DataFrame, folds: DataFrame, columns: list[str], name: str, outer: int = 5, inner: int = 3) -> DataFrame:
    """One row for each outer fold (hashtag, bin, fold): AUC, average precision and the report at the mean of the inner folds' best thresholds.

    The outer fold's training tags are dealt to `inner` folds within their bins.
    Each is scored by a model fitted to the others, so no threshold is chosen on
    rows that its model has seen; 0.5 where no inner fold has rows.

    What models and metrics read is computed once and kept by the executors, so
    that the driver never holds a plan of more than one fit or one fold's metrics.
    """
    folds = folds.localCheckpoint()
    both = samples.join(folds.select("hashtag", "fold"), "hashtag").localCheckpoint()
    out = None
    for k in range(outer):
        train, test = both.where(F.col("fold") != k), both.where(F.col("fold") == k)
        dealt = group_folds(folds.where(F.col("fold") != k).select("hashtag", "bin"), inner).select("hashtag", F.col("fold").alias("__inner"))
        own = train.join(dealt, "hashtag").localCheckpoint()
        scored = None
        for i in range(inner):
            part = fit_predict(own.where(F.col("__inner") != i), own.where(F.col("__inner") == i), columns, name).withColumn("fold", F.lit(i)).localCheckpoint()
            scored = part if scored is None else scored.unionByName(part)
        limit = averaged_threshold(scored, "y_pred_proba", GRID).first()["threshold"]
        limit = 0.5 if limit is None else limit
        pred = fit_predict(train, test, columns, name).withColumn("y_pred", (F.col("y_pred_proba") >= limit).cast("int")).localCheckpoint()
        row = roc_auc(pred, "y_pred_proba").crossJoin(average_precision(pred, "y_pred_proba")).crossJoin(classification_report(pred))
        row = row.select(F.lit(k).alias("fold"), F.lit(name).alias("model"), F.lit(limit).alias("threshold"), "roc_auc", "average_precision", "precision", "recall", "f1").localCheckpoint()
        out = row if out is None else out.unionByName(row)
    return out


def fold_summary(folds: DataFrame) -> DataFrame:
    metrics = ("roc_auc", "average_precision", "precision", "recall", "f1")
    return folds.groupBy("model").agg(*(x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))))


def normalised_predictions(pred: DataFrame) -> DataFrame:
    """Predictions under the engine's names: label (or y_true), y_pred derived from the prediction type where it is missing."""
    out = pred.withColumnRenamed("y_true", "label") if "label" not in pred.columns else pred
    if "y_pred" not in out.columns:
        out = out.withColumn("y_pred", F.col("prediction_type").isin("TP", "FP").cast("int"))
    return out


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def importances(spark, model, columns: list[str]) -> DataFrame:
    """(feature, importance) of a fitted pipeline: impurity of trees, or the absolute coefficients."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return spark.createDataFrame([(c, float(x)) for c, x in zip(columns, values, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")
