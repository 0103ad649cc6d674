"""Stacks: prediction vectors of many models as the features of the next model."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ordstack.constants import ROW_ID
from ordstack.models.jobs import Result
from ordstack.operators.combine import append_features, stack

# How many base models each stack has.
STACK_SIZES = {
    "esb0": 2, "esb1": 7, "esb2": 9, "esb3": 10, "esb4": 13, "esb5": 14, "esb6": 15, "esb7": 16,
    "esb8": 20,
}
SECOND_LEVEL_SIZES = {"esb_esb1": 3, "esb_esb2": 6, "esb_esb3": 3}


def stack_models(label: DataFrame, preds: dict[str, DataFrame], members: Sequence[str]) -> DataFrame:
    """Stack of the named members, in the given order; an unknown member raises."""
    absent = [m for m in members if m not in preds]
    if absent:
        raise ValueError(f"no predictions of {absent}")
    return stack(label, {m: preds[m] for m in members})


def stack_with_probabilities(stacked: DataFrame, probabilities: DataFrame) -> DataFrame:
    """A stack followed by the class-probability columns."""
    return append_features(stacked, probabilities)


@dataclass
class PredictionStore:
    """Predictions of fitted models below ``root``, each kept under its model, feature set and parameters.

    ``get`` reads what is there and fits only what is absent, so stacks that share members fit them once,
    also in a later application. A table counts as there once its writer has committed it.
    """

    spark: SparkSession
    root: str
    fitted: list[str] = field(default_factory=list)

    def path(self, model: str, features: str, params: dict[str, object]) -> str:
        said = json.dumps([model, features, params], sort_keys=True, default=str)
        return f"{self.root.rstrip('/')}/{model}-{features}-{hashlib.sha256(said.encode()).hexdigest()[:16]}"

    def _there(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)

    def get(
        self, model: str, features: str, params: dict[str, object], fit: Callable[[], Result]
    ) -> DataFrame:
        """``(row_id, prediction)``: out of fold for train rows, the fold mean for test rows."""
        path = self.path(model, features, params)
        if not self._there(path):
            made = fit()
            both = made.oof.select(ROW_ID, "prediction").unionByName(made.test.select(ROW_ID, "prediction"))
            both.write.mode("overwrite").parquet(path)
            self.fitted.append(model)
        return self.spark.read.parquet(path)
