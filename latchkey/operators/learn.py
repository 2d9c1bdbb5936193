"""A learned router."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchkey.functions import policy as P
from latchkey.operators.routing import NAMES

COLUMNS = (*NAMES, *(f"intent_{n}" for n, _ in P.INTENTS), "likely_hop_count", "freshness")


def feature_vectors(features: DataFrame) -> DataFrame:
    """Features as one vector of 23 columns in a fixed order."""
    f = features.withColumns({f"intent_{n}": (F.col("intent") == n).cast("double") for n, _ in P.INTENTS}).withColumn("freshness", F.col("freshness_required").cast("double"))
    return VectorAssembler(inputCols=list(COLUMNS), outputCol="features").transform(f)


def train_router(vectors: DataFrame, seed: int = 1729):
    """A forest over (features, label, train), fitted on rows with ``train``."""
    steps = [StringIndexer(inputCol="label", outputCol="target", handleInvalid="keep"), RandomForestClassifier(featuresCol="features", labelCol="target", numTrees=40, maxDepth=5, seed=seed)]
    return Pipeline(stages=steps).fit(vectors.where("train"))


def predict(model, vectors: DataFrame) -> DataFrame:
    """Adds ``predicted`` (the class's name) and ``confidence``."""
    names = F.array(*map(F.lit, [*model.stages[0].labels, "?"]))
    p = model.transform(vectors)
    return p.withColumns({"predicted": F.element_at(names, F.col("prediction").cast("int") + 1), "confidence": F.round(F.array_max(vector_to_array("probability")), 6)})


def importances(model, spark) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in zip(COLUMNS, model.stages[1].featureImportances.toArray(), strict=True)], "feature string, importance double")
