"""Saving and loading fitted pipelines, with a card that tells what they were trained on."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class ModelCard:
    """How a model was trained: enough to prepare other rows alike, and to tell which rows of a table it has seen.

    `keys`, `shares` and `seed` are the keyed split's, of which the first part was for training; without keys the split followed
    the layout of the table and cannot be told again. `finite` are the columns that must be finite in every row; None means that other values
    become zero. `data` names the version of the training table.
    """

    label: str
    features: list[str]
    keys: list[str] | None = None
    shares: list[float] = field(default_factory=lambda: [1.0])
    seed: int = 0
    finite: list[str] | None = None
    data: str | None = None


def save_pipeline(model: PipelineModel, path: str, card: ModelCard | None = None) -> str:
    """Store the model, and its card beside its stages."""
    model.write().overwrite().save(path)
    if card is not None:
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(asdict(card)),)], "card string").coalesce(1).write.mode("overwrite").text(f"{path}/card")
    return path


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_card(spark: SparkSession, path: str) -> ModelCard:
    """The card of a stored model; an error that Spark raises if it has none."""
    return ModelCard(**json.loads(spark.read.text(f"{path}/card", wholetext=True).first()["value"]))


def write_metadata(spark: SparkSession, path: str | None, estimator: Estimator, model: str, facts: dict, without: Sequence[str] = ()) -> str:
    """What a stored classification model says of itself, with the settings of its estimator but those named `without`; written to `path` if there is one."""
    settings = [{p.name: v for p, v in found.items() if p.name not in without} for found in (estimator._paramMap, estimator._defaultParamMap)]
    about = {
        "class": f"org.apache.spark.ml.classification.{model}", "timestamp": time.time_ns() // 1_000_000, "sparkVersion": spark.version, "uid": estimator.uid,
        "paramMap": settings[0], "defaultParamMap": settings[1], **facts,
    }
    text = json.dumps(about)
    if path is not None:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return text
