"""Boosted-tree classifier over pair features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labels
from .features import FEATURES


def weighted(labelled: DataFrame) -> DataFrame:
    """The rows with balanced class weights (two of them, so the join is by broadcast)."""
    return labelled.join(F.broadcast(labels.class_weights(labelled).select("label", "weight")), "label")


def classifier(features: tuple[str, ...] = FEATURES, rounds: int = 300, depth: int = 4, rate: float = 0.05, min_leaf: int = 5, balanced: bool = True, seed: int = 42) -> Pipeline:
    """300 trees of up to 16 leaves with balanced weights; rounds=200, depth=3, balanced=False is the smaller variant (M-1, M-2)."""
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=min_leaf, seed=seed)
    if balanced:
        trees = trees.setWeightCol("weight")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), trees])


def fit(labelled: DataFrame, **options) -> PipelineModel:
    """Fit on rows with FEATURES and label. The rows are read once per tree level, so they are cached while it runs."""
    rows = weighted(labelled).persist()
    try:
        return classifier(**options).fit(rows)
    finally:
        rows.unpersist()


def score(model: PipelineModel, rows: DataFrame, column: str = "score") -> DataFrame:
    """The rows with the probability of a match (M-4)."""
    out = model.transform(rows).withColumn(column, vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def calibrated(scored: DataFrame, labelled: DataFrame) -> DataFrame:
    """Scores made into calibrated probabilities by isotonic regression on labelled scores (X-14)."""
    rows = labelled.select(F.col("label").cast("double").alias("label"), F.col("score").cast("double").alias("feature"))
    fitted = IsotonicRegression(featuresCol="feature", labelCol="label").fit(VectorAssembler(inputCols=["feature"], outputCol="vector").transform(rows).drop("feature").withColumnRenamed("vector", "feature"))
    vector = VectorAssembler(inputCols=["score"], outputCol="feature").transform(scored)
    return fitted.transform(vector).withColumn("score", F.col("prediction")).drop("feature", "prediction")


def out_of_fold(labelled: DataFrame, folds: int = 4, features: tuple[str, ...] = FEATURES, seed: int = 42, **options) -> DataFrame:
    """The rows with `oof_score`, each scored by a model that has not seen its source-1 id (X-10)."""
    fold = F.least(F.floor(labels.hash_share(F.col("source1_entity_id"), seed) * folds), F.lit(folds - 1)).cast("int")
    rows, out = labelled.withColumn("_fold", fold), None
    for k in range(folds):
        part = score(fit(rows.where(F.col("_fold") != k), features=features, **options), rows.where(F.col("_fold") == k), "oof_score")
        out = part if out is None else out.unionByName(part)
    return out.drop("_fold")
