"""Models that are trained here: page scorer, utility predictor, clusters."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tessera.operators.retrieval import DIGITS


def fit_scorer(rows: DataFrame, features: list[str], label: str = "label", weight: str | None = None) -> PipelineModel:
    """Logistic regression on scaled features; null features count as 0."""
    estimator = LogisticRegression(featuresCol="scaled", labelCol=label, regParam=0.01, maxIter=50, **({"weightCol": weight} if weight else {}))
    stages = [VectorAssembler(inputCols=features, outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True), estimator]
    return Pipeline(stages=stages).fit(rows.fillna(0.0, features))


def score(model: PipelineModel, rows: DataFrame, features: list[str], name: str = "score") -> DataFrame:
    """``rows`` with the probability of the positive class."""
    out = model.transform(rows.fillna(0.0, features)).withColumn(name, F.round(vector_to_array("probability")[1], DIGITS))
    return out.select(*rows.columns, name)


def feature_weights(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, weight of the scaled features, heaviest first."""
    weights = [(f, float(w)) for f, w in zip(features, model.stages[-1].coefficients.toArray())]
    return rows.sparkSession.createDataFrame(weights, "feature string, weight double").orderBy(F.desc(F.abs("weight")), "feature")


def clusters(vectors: DataFrame, k: int = 12, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and cluster: k-means of L2-normalised vectors."""
    rows = vectors.select(id_col, array_to_vector(F.col(vector_col).cast("array<double>")).alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="features").transform(rows)
    return KMeans(k=k, seed=seed, maxIter=20).fit(unit).transform(unit).select(id_col, F.col("prediction").alias("cluster"))
