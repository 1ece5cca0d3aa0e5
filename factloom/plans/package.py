"""A trained pipeline as a folder: a JSON description, the key table and the model; no pickles."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession

from factloom.operators import keys, learning


@dataclass
class PipelineSpec:
    """What has to be known to rebuild the plan: classes with their values and nullable arguments, and the stages' settings.

    ``stages`` names functions of a registry, so that code is looked up and never stored.
    """

    mention_classes: dict[str, dict[str, Any]] = field(default_factory=dict)
    candidate_classes: dict[str, dict[str, Any]] = field(default_factory=dict)
    stages: dict[str, str] = field(default_factory=dict)
    settings: dict[str, Any] = field(default_factory=dict)


STAGES: dict[str, Callable[..., DataFrame]] = {}


def stage(name: str):
    """Registers a function under a name that a stored pipeline can refer to."""
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        STAGES[name] = f
        return f

    return register


def declare(known: dict[str, dict[str, Any]], name: str, spec: dict[str, Any]) -> dict[str, Any]:
    """Declares a class; declaring it again alike gives the known one, otherwise it is an error."""
    values = spec.setdefault("values", [True, False])
    if spec.setdefault("cardinality", len(values)) != len(values):
        raise ValueError("cardinality and values differ")
    if any(v is None or (isinstance(v, int) and not isinstance(v, bool)) for v in values):
        raise ValueError("values are neither null nor plain integers")
    if known.setdefault(name, spec) != spec:
        raise ValueError(f"{name} is declared otherwise already")
    return known[name]


@dataclass
class Package:
    spec: PipelineSpec
    key_table: DataFrame
    model: LogisticRegressionModel

    def save(self, path: str) -> None:
        os.makedirs(path, exist_ok=True)
        with open(os.path.join(path, "pipeline.json"), "w") as file:
            json.dump(asdict(self.spec), file)
        self.key_table.write.mode("overwrite").parquet(os.path.join(path, "keys"))
        self.model.write().overwrite().save(os.path.join(path, "model"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Package:
        with open(os.path.join(path, "pipeline.json")) as file:
            spec = PipelineSpec(**json.load(file))
        return cls(spec, spark.read.parquet(os.path.join(path, "keys")), LogisticRegressionModel.load(os.path.join(path, "model")))

    def predict(self, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Documents through the stages named candidates and features, to candidates with their probabilities."""
        found = STAGES[self.spec.stages["candidates"]](docs)
        rows = STAGES[self.spec.stages["features"]](found)
        size = self.model.numFeatures
        cells = rows.join(keys.numbered(self.key_table), "key").select("candidate_id", "col", "value")
        bare = found.select("candidate_id").distinct()
        made = bare.join(learning.vectors(cells, size, "candidate_id"), "candidate_id", "left")
        empty = learning.vectors(bare.limit(0).selectExpr("candidate_id", "0 as col", "0.0 as value"), size, "candidate_id")
        return learning.predict(self.model, made.where("features is not null").unionByName(empty), "candidate_id", threshold)
