"""MLlib classifiers trained as whole pipelines.

Assembler, scaler and classifier are fitted and saved together, so a served model
always sees features prepared as in training. Each pipeline writes its own column
names (``<prefix>prediction`` and so on), which lets two models score one frame.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.operators.evaluation import binary_areas, multiclass_metrics
from flowlens.schemas import MODEL_PRESETS

CLASSIFIERS = {"lr": LogisticRegression, "rf": RandomForestClassifier, "gbt": GBTClassifier}
METRICS = ["accuracy", "f1", "weighted_precision", "weighted_recall", "auc_roc", "auc_pr"]


def train(df: DataFrame, kind: str, features, label: str, weight: str | None = None, prefix: str = "",
          preset: str | None = None, invalid: str = "keep", **params) -> PipelineModel:
    """Fit ``kind`` (lr, rf or gbt) on ``features``.

    ``features`` is a list of numeric columns, or the name of a vector column, which is
    then scaled and used as it is. ``params`` override the named preset.
    """
    settings = {**(MODEL_PRESETS[preset] if preset else {}), **params}
    stages, vector = [], features
    if not isinstance(features, str):
        vector = prefix + "features"
        stages.append(VectorAssembler(inputCols=list(features), outputCol=vector, handleInvalid=invalid))
    scaled = prefix + "scaled_features"
    stages.append(StandardScaler(inputCol=vector, outputCol=scaled, withMean=True, withStd=True))
    classifier = (CLASSIFIERS[kind](featuresCol=scaled, labelCol=label, **settings)
                  .setPredictionCol(prefix + "prediction").setRawPredictionCol(prefix + "rawPrediction")
                  .setProbabilityCol(prefix + "probability"))
    stages.append(classifier if weight is None else classifier.setWeightCol(weight))
    return Pipeline(stages=stages).fit(df)


def train_lr(df, features, label="binary_label", weight="sample_weight", prefix="", preset="lr", **params):
    return train(df, "lr", features, label, weight, prefix, preset, **params)


def train_rf_binary(df, features, label="binary_label", weight="sample_weight", prefix="",
                    preset="rf_binary_cic", **params):
    return train(df, "rf", features, label, weight, prefix, preset, **params)


def train_gbt_binary(df, features, label="binary_label", weight="sample_weight", prefix="",
                     preset="gbt_binary_cic", **params):
    return train(df, "gbt", features, label, weight, prefix, preset, **params)


def train_rf_multiclass(df, features, label="unified_label", weight="multiclass_weight", prefix="",
                        preset="rf_multiclass_cic", **params):
    return train(df, "rf", features, label, weight, prefix, preset, **params)


def positive_score(df: DataFrame, prefix: str = "", output: str = "score") -> DataFrame:
    """Probability of class 1, the score the areas are computed from."""
    return df.withColumn(output, vector_to_array(F.col(prefix + "probability"))[1])


def evaluate(model: PipelineModel, test: DataFrame, label: str, prefix: str = "", binary: bool = True) -> DataFrame:
    """One row of held-out metrics. Scored rows are kept while both aggregations read them."""
    scored = model.transform(test)
    kept = [F.col(label).cast("double").alias("label"), F.col(prefix + "prediction").alias("prediction")]
    if not binary:
        return _one_row(test.sparkSession, multiclass_metrics(scored.select(*kept)).first().asDict())
    scored = positive_score(scored, prefix).select(*kept, "score").persist()
    try:
        row = {**multiclass_metrics(scored).first().asDict(), **binary_areas(scored).first().asDict()}
    finally:
        scored.unpersist()
    return _one_row(test.sparkSession, row)


def _one_row(spark: SparkSession, metrics: dict[str, float]) -> DataFrame:
    names = [m for m in METRICS if m in metrics]
    schema = T.StructType([T.StructField(m, T.DoubleType()) for m in names])
    return spark.createDataFrame([tuple(metrics[m] for m in names)], schema)


def compare_weighted(train_df: DataFrame, test: DataFrame, features, label: str = "binary_label",
                     weight: str = "sample_weight", preset: str = "lr", kind: str = "lr", **params) -> DataFrame:
    """The same model with and without class weights, one row of metrics each."""
    rows = []
    for name, column in (("unweighted", None), ("weighted", weight)):
        model = train(train_df, kind, features, label, column, preset=preset, **params)
        rows.append(evaluate(model, test, label).select(F.lit(name).alias("model"), "*"))
    return rows[0].unionByName(rows[1])


def results_table(spark: SparkSession, results: dict[str, DataFrame], train_rows: int, test_rows: int) -> DataFrame:
    """Long form (model, metric, value, train_rows, test_rows) of one-row metric frames."""
    long = None
    for name, metrics in results.items():
        columns = [c for c in metrics.columns if c != "model"]
        part = metrics.select(F.lit(name).alias("model"), *columns).unpivot("model", columns, "metric", "value")
        long = part if long is None else long.unionByName(part)
    return long.withColumn("train_rows", F.lit(train_rows).cast("bigint")).withColumn(
        "test_rows", F.lit(test_rows).cast("bigint"))


def model_comparison(results: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Table model x metric from the long form."""
    return results.groupBy("model").pivot("metric", metrics).agg(F.first("value", ignorenulls=True))


def metric_deltas(results: DataFrame, before: str, after: str) -> DataFrame:
    """Rows (metric, before, after, delta) for two models of the long form."""
    wide = results.where(F.col("model").isin(before, after)).groupBy("metric").pivot("model", [before, after]).agg(
        F.first("value"))
    return wide.select("metric", F.col(f"`{before}`").alias("before"), F.col(f"`{after}`").alias("after"),
                       (F.col(f"`{after}`") - F.col(f"`{before}`")).alias("delta"))


def feature_importance(spark: SparkSession, model: PipelineModel, names: list[str] | None = None,
                       k: int | None = 20) -> DataFrame:
    """Features by falling importance, named from the assembler unless ``names`` is given."""
    weights = model.stages[-1].featureImportances
    if names is None:
        vectors = [s for s in model.stages if isinstance(s, VectorAssembler)]
        names = vectors[0].getInputCols() if vectors else [f"feature_{i}" for i in range(weights.size)]
    rows = [(name, float(weight)) for name, weight in zip(names, weights.toArray())]
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])
    ranked = spark.createDataFrame(rows, schema).orderBy(F.desc("importance"), "feature")
    return ranked if k is None else ranked.limit(k)
