"""Classifier metrics as aggregations.

Every class metric starts from the confusion counts, so the predictions are read
once and what follows works on (classes x classes) rows. The areas start from one
row per distinct score.
"""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import DataFrame, Window, functions as F

from flowlens.operators.lookup import small_copy
from flowlens.operators.ordering import range_splits, running_totals
from flowlens.sources.storage import materialize

MAX_CLASSES = 1_000


def confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows (label, prediction, count) for the pairs that occur."""
    return predictions.groupBy(F.col(label).cast("double").alias("label"),
                               F.col(prediction).cast("double").alias("prediction")).agg(
        F.count(F.lit(1)).alias("count"))


def confusion_normalized(predictions: DataFrame, label: str = "label", prediction: str = "prediction",
                         max_classes: int = MAX_CLASSES) -> DataFrame:
    """Full matrix over the union of true and predicted classes; each row sums to 1 or is 0."""
    counts = small_copy(confusion(predictions, label, prediction), max_classes**2)
    if counts is None:
        raise ValueError(f"more than {max_classes} classes: use confusion(), which lists the occurring pairs only")
    classes = counts.select(F.explode(F.array("label", "prediction")).alias("c")).agg(
        F.array_sort(F.collect_set("c")).alias("classes"))
    cells = classes.select(F.explode("classes").alias("label"), "classes").select(
        "label", F.explode("classes").alias("prediction"))
    filled = cells.join(F.broadcast(counts), ["label", "prediction"], "left").withColumn(
        "count", F.coalesce("count", F.lit(0)))
    row_total = F.sum("count").over(Window.partitionBy("label"))
    return filled.withColumn("share", F.coalesce(F.try_divide(F.col("count"), row_total), F.lit(0.0)))


def per_class_accuracy(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = F.count_if(F.col(prediction).cast("double") == F.col(label).cast("double"))
    return predictions.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("total"), hit.alias("correct")
    ).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 4)).orderBy("label")


def _class_scores(counts: DataFrame) -> DataFrame:
    """Per class: support, predicted, correct, precision, recall, f1 (0 where undefined)."""
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("count").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0).alias("correct")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("count").alias("predicted"),
                 F.lit(0).cast("bigint").alias("correct")),
    )).alias("s")).select("s.*")
    totals = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "correct")])
    zero = F.lit(0.0)
    return totals.select(
        "*",
        F.coalesce(F.try_divide("correct", "predicted"), zero).alias("precision"),
        F.coalesce(F.try_divide("correct", "support"), zero).alias("recall"),
        F.coalesce(F.try_divide(F.lit(2) * F.col("correct"), F.col("support") + F.col("predicted")), zero).alias("f1"),
    )


def recall_band(recall):
    """low below 0.5, medium below 0.8, else high."""
    return F.when(recall < 0.5, "low").when(recall < 0.8, "medium").otherwise("high")


def classification_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per-class rows, then accuracy, macro average and weighted average."""
    scores = _class_scores(confusion(predictions, label, prediction))
    per_class = scores.select(F.col("class").cast("int").cast("string").alias("entry"),
                              "precision", "recall", "f1", "support")
    total = F.sum("support")
    accuracy = F.sum("correct") / total

    def weighted(name):
        return (F.sum(F.col(name) * F.col("support")) / total).alias(name)

    rows = scores.agg(
        F.struct(F.lit("accuracy").alias("entry"), accuracy.alias("precision"), accuracy.alias("recall"),
                 accuracy.alias("f1"), total.alias("support")).alias("a"),
        F.struct(F.lit("macro avg").alias("entry"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support")).alias("m"),
        F.struct(F.lit("weighted avg").alias("entry"), weighted("precision"), weighted("recall"), weighted("f1"),
                 total.alias("support")).alias("w"),
    ).select(F.explode(F.array("a", "m", "w")).alias("r")).select("r.*")
    return per_class.unionByName(rows)


def multiclass_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, f1, weighted_precision, weighted_recall."""
    scores = _class_scores(confusion(predictions, label, prediction))
    total = F.sum("support")
    return scores.agg(
        (F.sum("correct") / total).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("weighted_recall"),
    )


def _score_steps(predictions: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score, highest first, with the totals above it.

    The counts are written once: the cuts are taken over distinct scores, so that a score
    many rows share doesn't use up the ranges, and the totals read the same rows.
    """
    keyed = predictions.where(F.col(score).isNotNull()).select(
        (-F.col(score).cast("double")).alias("key"), (F.col(label).cast("double") == 1.0).alias("hit"))
    steps = keyed.groupBy("key").agg(F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    steps = materialize(steps, "score_steps")
    return running_totals(steps, "key", ["pos", "neg"], range_splits(steps, "key"))


def _roc_area(steps: DataFrame):
    ranked = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2))
    return F.try_divide(ranked, F.sum("pos") * F.sum("neg"))


def _pr_area(steps: DataFrame):
    hits, seen = F.col("pos_before") + F.col("pos"), F.col("pos_before") + F.col("neg_before")
    precision = hits / (seen + F.col("pos") + F.col("neg"))
    before = F.when(seen == 0, precision).otherwise(F.try_divide(F.col("pos_before"), seen))
    return F.try_divide(F.sum(F.col("pos") * (precision + before) / 2), F.sum("pos"))


def binary_areas(predictions: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: exact areas under the ROC and precision-recall curves, ties handled."""
    steps = _score_steps(predictions, label, score)
    return steps.agg(_roc_area(steps).alias("auc_roc"), _pr_area(steps).alias("auc_pr"))


def auc_roc(predictions: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return binary_areas(predictions, label, score).select("auc_roc")


def auc_pr(predictions: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return binary_areas(predictions, label, score).select("auc_pr")


def evaluator_metrics(predictions: DataFrame, label: str, prediction: str = "prediction",
                      raw: str | None = "rawPrediction") -> dict[str, float]:
    """The same metrics from MLlib's evaluators; areas only when ``raw`` is given."""
    multi = MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction)
    found = {ours: multi.evaluate(predictions, {multi.metricName: theirs}) for ours, theirs in (
        ("accuracy", "accuracy"), ("f1", "f1"), ("weighted_precision", "weightedPrecision"),
        ("weighted_recall", "weightedRecall"))}
    if raw is not None:
        binary = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw, numBins=0)
        found["auc_roc"] = binary.evaluate(predictions, {binary.metricName: "areaUnderROC"})
        found["auc_pr"] = binary.evaluate(predictions, {binary.metricName: "areaUnderPR"})
    return found
