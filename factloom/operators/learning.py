"""Features and marginals to a classifier: sparse vectors, soft labels, predictions."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(matrix: DataFrame, size: int, row: str = "row") -> DataFrame:
    """One sparse vector a row of a (row, col, value) matrix."""
    @F.udf(VectorUDT())
    def build(cells):
        return Vectors.sparse(size, {c["col"]: c["value"] for c in cells}) if cells else SparseVector(size, [], [])

    cells = matrix.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cells"))
    return cells.select(row, build("cells").alias("features"))


def soft_rows(features: DataFrame, marginals: DataFrame, key: str = "row") -> DataFrame:
    """A row a class with the class's probability as its weight: what a cross entropy on soft labels weighs.

    ``marginals`` has the key and ``p``, the probability of class 1, or an array of all classes' probabilities.
    """
    p = F.col("p") if marginals.schema["p"].dataType.typeName() == "array" else F.array(1 - F.col("p"), F.col("p"))
    joined = features.join(marginals.select(key, p.alias("p")), key)
    return joined.select(key, "features", F.posexplode("p").alias("label", "weight")).where("weight > 0").withColumn("label", F.col("label").cast("double"))


def hard_rows(features: DataFrame, gold: DataFrame, key: str = "row") -> DataFrame:
    """As ``soft_rows``, for labels that are certain (column ``label``)."""
    return features.join(gold, key).select(key, "features", F.col("label").cast("double"), F.lit(1.0).alias("weight"))


def fit(rows: DataFrame, regularisation: float = 0.0, iterations: int = 100) -> LogisticRegressionModel:
    return LogisticRegression(weightCol="weight", regParam=regularisation, maxIter=iterations).fit(rows)


def predict(model: LogisticRegressionModel, features: DataFrame, key: str = "row", threshold: float = 0.5) -> DataFrame:
    """Class probabilities, and class 1 where its own reaches the threshold (the likeliest class if there are more than two)."""
    scored = model.transform(features).select(key, vector_to_array("probability").alias("probability"), "prediction")
    if model.numClasses == 2:
        return scored.select(key, "probability", (F.col("probability")[1] >= threshold).cast("int").alias("prediction"))
    return scored.select(key, "probability", F.col("prediction").cast("int").alias("prediction"))
