"""Gradient-boosted trees over feature columns, and isotonic calibration of what they say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREES = 20
DEPTH = 3
SEED = 11


def _vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features").transform(df)


class Boosted:
    """A fitted ensemble, or a constant where the labelled rows have one class or none."""

    def __init__(self, features: Sequence[str], model: GBTClassificationModel | None, constant: float = 0.0):
        self.features, self.model, self.constant = list(features), model, constant

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Adds the probability of label 1."""
        if self.model is None:
            return df.withColumn(name, F.lit(float(self.constant)))
        scored = self.model.transform(_vector(df, self.features))
        return scored.withColumn(name, vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def fit_boosted(train: DataFrame, features: Sequence[str], label: str) -> Boosted:
    """Learns from all rows of ``train``; ``label`` is 0 or 1."""
    by_label = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two rows
    if len(by_label) < 2:
        return Boosted(features, None, next(iter(by_label), 0))
    trees = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED)
    return Boosted(features, trees.fit(_vector(train, features).select("_features", F.col(label).cast("double").alias("_label"))))


def fit_isotonic(rows: DataFrame, score: str, label: str) -> list[tuple[float, float]]:
    """Corners (score, calibrated) of a rising curve; empty without rows.

    Scores are rounded to thousandths and counted first, so the curve is fitted to at most 1,001 rows.
    """
    counted = rows.groupBy(F.round(score, 3).alias("_score")).agg(F.avg(F.col(label).cast("double")).alias("_label"), F.count("*").cast("double").alias("_weight"))
    counted = counted.coalesce(1)
    if not counted.head(1):
        return []
    fitted = IsotonicRegression(featuresCol="_score", labelCol="_label", weightCol="_weight").fit(counted)
    return list(zip(map(float, fitted.boundaries.toArray()), map(float, fitted.predictions.toArray())))


def calibrated(score: Column, corners: list[tuple[float, float]]) -> Column:
    """The curve at ``score``: straight between corners, flat beyond them; the score itself without corners."""
    if not corners:
        return score
    out = F.lit(corners[0][1])
    for (x0, y0), (x1, y1) in zip(corners, corners[1:]):
        slope = (y1 - y0) / (x1 - x0) if x1 > x0 else 0.0
        out = F.when(score >= x1, F.lit(y1)).when(score > x0, F.lit(y0) + (score - x0) * slope).otherwise(out) if y1 != y0 else out
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))
