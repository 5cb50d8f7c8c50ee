"""Scoring and alert enrichment, shared unchanged by batch jobs and streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions import detection as D
from flowlens.schemas import CLASS_NAMES

BINARY, MULTI = "binary_", "multiclass_"


@dataclass
class Detector:
    """What a detection run needs: two optional models and how to read their output.

    ``cascade`` keeps the second stage for rows the first calls an attack; otherwise
    both stages answer independently. ``class_space`` (a key of ``CLASS_NAMES``, or the names
    by id) must be the one the multiclass model was trained in. ``split`` is explained at
    ``score_cascade``.
    """

    binary: PipelineModel | None = None
    multiclass: PipelineModel | None = None
    cascade: bool = True
    class_space: str | dict[int, str] = "unsw"
    policy: str | dict = "default"
    threshold: float | None = None
    split: bool = False


def _drop_model_columns(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[prefix + c for c in ("features", "scaled_features", "rawPrediction", "probability")])


def score_binary(df: DataFrame, model: PipelineModel | None, threshold: float | None = None) -> DataFrame:
    """Add ``binary_prediction`` (-1 without a model) and ``prediction_score``, the
    probability of the predicted class."""
    if model is None:
        return df.withColumn("binary_prediction", F.lit(D.NO_MODEL)).withColumn(
            "prediction_score", F.lit(None).cast("double"))
    scored = model.transform(df)
    probability = vector_to_array(F.col(BINARY + "probability"))
    scored = scored.withColumn("prediction_score", F.array_max(probability))
    if threshold is not None:
        scored = apply_threshold(scored, threshold, probability[1])
    return _drop_model_columns(scored, BINARY)


def apply_threshold(df: DataFrame, threshold: float, score: Column, output: str = "binary_prediction") -> DataFrame:
    """Call an attack from ``threshold`` upwards instead of the likelier class."""
    return df.withColumn(output, F.when(score >= threshold, 1.0).otherwise(0.0))


def score_multiclass(df: DataFrame, model: PipelineModel | None) -> DataFrame:
    if model is None:
        return df.withColumn("multiclass_prediction", F.lit(D.NO_MODEL))
    return _drop_model_columns(model.transform(df), MULTI)


def cascade_predictions(df: DataFrame, raw: str = "multiclass_prediction") -> DataFrame:
    """Force class 0 where the binary stage says normal; -1 and null fall through."""
    return df.withColumn("multiclass_prediction", D.cascade(F.col("binary_prediction"), F.col(raw)))


def score_cascade(df: DataFrame, binary: PipelineModel | None, multiclass: PipelineModel | None,
                  threshold: float | None = None, split: bool = False) -> DataFrame:
    """Binary stage, then class of the attacks.

    Both stages run in one pass over the rows. With ``split`` the second model only
    sees rows not called normal, at the price of reading the input once per side;
    worth it when the second model costs far more than the scan.
    """
    first = score_binary(df, binary, threshold)
    if multiclass is None or not split:
        both = score_multiclass(first, multiclass)
        return both if multiclass is None else cascade_predictions(both)
    normal = F.coalesce(F.col("binary_prediction") == 0.0, F.lit(False))
    return score_multiclass(first.where(~normal), multiclass).unionByName(
        first.where(normal).withColumn("multiclass_prediction", F.lit(0.0)))


def score_parallel(df: DataFrame, binary: PipelineModel | None, multiclass: PipelineModel | None,
                   threshold: float | None = None) -> DataFrame:
    return score_multiclass(score_binary(df, binary, threshold), multiclass)


def enrich(df: DataFrame, class_space: str | dict[int, str] = "unsw", policy="default",
           clock: Column | None = None) -> DataFrame:
    """Add attack_type, is_attack, severity and processed_at to scored rows.

    ``clock`` replaces the current time, for replays that must repeat exactly.
    """
    names = CLASS_NAMES[class_space] if isinstance(class_space, str) else class_space
    kind = D.attack_type(F.col("multiclass_prediction"), names)
    flag = D.is_attack(F.col("binary_prediction"))
    return (
        df.withColumn("attack_type", kind)
        .withColumn("is_attack", flag)
        .withColumn("severity", D.severity(F.col("attack_type"), F.col("is_attack"), policy))
        .withColumn("processed_at", F.current_timestamp() if clock is None else clock)
        .drop("features", "scaled_features")
    )


def score_and_enrich(df: DataFrame, detector: Detector, clock: Column | None = None) -> DataFrame:
    if detector.cascade:
        scored = score_cascade(df, detector.binary, detector.multiclass, detector.threshold, detector.split)
    else:
        scored = score_parallel(df, detector.binary, detector.multiclass, detector.threshold)
    return enrich(scored, detector.class_space, detector.policy, clock)


def detection_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """Rows processed, attacks, rate and severity counts per group, one pass."""
    attack = F.col("is_attack")

    def of(level):
        return F.count_if(attack & (F.col("severity") == level))

    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(attack).alias("attacks"),
        of("HIGH").alias("high"), of("MEDIUM").alias("medium"), of("LOW").alias("low"),
    ).withColumn("detection_rate", F.coalesce(F.try_divide("attacks", "processed"), F.lit(0.0)))


def attacks_by_type(scored: DataFrame) -> DataFrame:
    return scored.where("is_attack").groupBy("attack_type").agg(F.count(F.lit(1)).alias("count"))
