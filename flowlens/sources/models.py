"""Saved models and which of them serves a dataset."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from flowlens.operators.scoring import Detector
from flowlens.sources.storage import exists

CLASS_SCHEMA = "class_id int, class_name string"

# Model folder names, in order of preference.
PREFERENCE = {
    "unsw": {"binary": ["unsw_gbt_binary", "unsw_rf_binary"], "multiclass": ["unsw_multiclass"]},
    "cicids2017": {"binary": ["rf_binary"], "multiclass": ["rf_multiclass_improved", "rf_multiclass"]},
    "cicids2018": {"binary": ["rf_binary"], "multiclass": ["rf_multiclass_improved", "rf_multiclass"]},
}


def save_model(model: PipelineModel, folder: str, name: str) -> str:
    path = f"{folder.rstrip('/')}/{name}"
    model.write().overwrite().save(path)
    return path


def choose_model(spark: SparkSession, folder: str, names: list[str]) -> str | None:
    """The first of ``names`` stored in ``folder``."""
    return next((n for n in names if exists(spark, f"{folder.rstrip('/')}/{n}")), None)


def load_model(spark: SparkSession, folder: str, names: list[str]) -> PipelineModel | None:
    """The first model of ``names`` that exists, or None. A damaged one raises."""
    name = choose_model(spark, folder, names)
    return None if name is None else PipelineModel.load(f"{folder.rstrip('/')}/{name}")


def save_classes(spark: SparkSession, folder: str, name: str, class_names: dict[int, str]) -> None:
    """Store the class names a multiclass model was trained with beside it."""
    rows = spark.createDataFrame(list(class_names.items()), CLASS_SCHEMA)
    rows.coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}_classes")


def load_classes(spark: SparkSession, folder: str, name: str) -> dict[int, str] | None:
    path = f"{folder.rstrip('/')}/{name}_classes"
    if not exists(spark, path):
        return None
    return {r["class_id"]: r["class_name"] for r in spark.read.schema(CLASS_SCHEMA).json(path).collect()}


def load_detector(spark: SparkSession, folder: str, source: str, policy="default", threshold: float | None = None,
                  class_space: str | dict | None = None) -> Detector:
    """Models and detection mode of a flow source. UNSW runs the cascade, CIC both stages
    side by side. Class names are those stored with the multiclass model, unless others
    are asked for."""
    wanted, unsw = PREFERENCE[source], source == "unsw"
    multiclass = choose_model(spark, folder, wanted["multiclass"])
    stored = load_classes(spark, folder, multiclass) if multiclass else None
    return Detector(
        binary=load_model(spark, folder, wanted["binary"]),
        multiclass=load_model(spark, folder, wanted["multiclass"]),
        cascade=unsw, class_space=class_space or stored or ("unsw" if unsw else "cic_unified"),
        policy=policy, threshold=threshold)
