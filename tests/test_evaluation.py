import random

import pytest
from frames import rows
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from flowlens.operators import aggregates as agg
from flowlens.operators import evaluation as ev
from flowlens.operators import models as mo
from flowlens.operators.scoring import BINARY
from flowlens.schemas import MODEL_PRESETS
from flowlens.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def predictions(spark):
    rng = random.Random(5)
    data = []
    for _ in range(3000):
        truth = float(rng.choice([0, 0, 0, 2, 3]))
        guess = truth if rng.random() < 0.7 else float(rng.choice([0, 1, 2, 3]))
        y = float(truth > 0)
        score = min(1.0, max(0.0, round(0.3 * y + rng.random() * 0.7, 2)))  # many ties
        data.append((truth, guess, y, score, Vectors.dense([1 - score, score])))
    return spark.createDataFrame(data, ["label", "prediction", "y", "score", "rawPrediction"]).cache()


def test_metrics_equal_mllib(predictions):
    ours = ev.multiclass_metrics(predictions).first().asDict()
    theirs = ev.evaluator_metrics(predictions, "label", raw=None)
    assert ours == pytest.approx(theirs, abs=1e-12)


def test_areas_equal_mllib(predictions):
    ours = ev.binary_areas(predictions, "y", "score").first().asDict()
    theirs = ev.evaluator_metrics(predictions, "y")
    assert ours["auc_roc"] == pytest.approx(theirs["auc_roc"], abs=1e-9)
    assert ours["auc_pr"] == pytest.approx(theirs["auc_pr"], abs=1e-9)


def test_areas_of_one_class_are_undefined(spark):
    df = spark.createDataFrame([(0.0, 0.1), (0.0, 0.2)], "label double, score double")
    assert rows(ev.binary_areas(df)) == [(None, None)]


def test_perfect_and_constant_scores(spark):
    perfect = spark.createDataFrame([(0.0, 0.1), (0.0, 0.2), (1.0, 0.8), (1.0, 0.9)], "label double, score double")
    assert rows(ev.binary_areas(perfect)) == [(1.0, 1.0)]
    constant = perfect.withColumn("score", F.lit(0.5))
    assert rows(ev.binary_areas(constant)) == [(0.5, 0.5)]


def test_confusion_matrix(predictions):
    counts = {(r["label"], r["prediction"]): r["count"] for r in ev.confusion(predictions).collect()}
    assert sum(counts.values()) == 3000
    full = ev.confusion_normalized(predictions).collect()
    assert len(full) == 16  # class 1 is never true, its row is empty
    sums = {}
    for r in full:
        sums[r["label"]] = sums.get(r["label"], 0) + r["share"]
        assert r["count"] == counts.get((r["label"], r["prediction"]), 0)
    assert sums == pytest.approx({0.0: 1.0, 1.0: 0.0, 2.0: 1.0, 3.0: 1.0})
    with pytest.raises(ValueError, match="classes"):
        ev.confusion_normalized(predictions, max_classes=2)


def test_report(predictions):
    report = {r["entry"]: r for r in ev.classification_report(predictions).collect()}
    assert set(report) == {"0", "1", "2", "3", "accuracy", "macro avg", "weighted avg"}
    assert report["1"]["support"] == 0 and report["1"]["recall"] == 0.0
    accuracy = predictions.where("label = prediction").count() / 3000
    assert report["accuracy"]["f1"] == pytest.approx(accuracy)
    assert report["weighted avg"]["recall"] == pytest.approx(accuracy)
    assert sum(report[c]["support"] for c in "0123") == 3000
    per_class = {r["label"]: r for r in ev.per_class_accuracy(predictions).collect()}
    assert per_class[2.0]["accuracy"] == pytest.approx(report["2"]["recall"], abs=5e-5)


def test_recall_bands(spark):
    df = spark.createDataFrame([(0.49,), (0.5,), (0.79,), (0.8,)], "r double").coalesce(1)
    assert rows(df.select(ev.recall_band(F.col("r")))) == [("low",), ("medium",), ("medium",), ("high",)]


def test_distributions(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "label string, p int")
    assert rows(agg.class_distribution(df)) == [("a", 2, 50.0), (None, 1, 25.0), ("b", 1, 25.0)]
    assert sum(r["count"] for r in agg.distribution_2d(df, "label", "p").collect()) == 4
    matrix = {r["label"]: (r["1"], r["2"]) for r in agg.distribution_matrix(df, "label", "p", [1, 2]).collect()}
    assert matrix == {"a": (1, 1), "b": (1, 0), None: (1, 0)}
    assert agg.dataset_summary(df, "x").first().asDict() == {
        "dataset": "x", "total_rows": 4, "total_columns": 2, "first_columns": "label, p"}
    assert {tuple(r) for r in agg.prediction_distribution(df, "p").collect()} == {(1, 3), (2, 1)}


# Models ------------------------------------------------------------------

@pytest.fixture(scope="module")
def training(spark):
    rng = random.Random(1)
    data = []
    for i in range(400):
        y = float(i % 4 == 0)
        data.append((rng.gauss(2 * y, 1), rng.gauss(0, 1), 5.0, y, 1.0 + 2 * y))
    return spark.createDataFrame(data, ["signal", "noise", "constant", "binary_label", "sample_weight"]).cache()


FEATURES = ["signal", "noise", "constant"]


@pytest.mark.parametrize("kind, options", [
    ("lr", {"maxIter": 20}), ("rf", {"numTrees": 5, "maxDepth": 3, "seed": 1}),
    ("gbt", {"maxIter": 3, "maxDepth": 2, "seed": 1})])
def test_saved_models_predict_the_same(spark, folder, training, kind, options):
    model = mo.train(training, kind, FEATURES, "binary_label", "sample_weight", prefix=BINARY, **options)
    save_model(model, folder, "model")
    again = load_model(spark, folder, ["absent", "model"])
    columns = ["signal", "binary_prediction", "binary_probability"]
    assert rows(model.transform(training), *columns) == rows(again.transform(training), *columns)
    assert load_model(spark, folder, ["absent"]) is None
    metrics = mo.evaluate(model, training, "binary_label", BINARY).first()
    assert metrics["auc_roc"] > 0.85


def test_refit_with_a_seed_repeats(training):
    a, b = (mo.train_rf_binary(training, FEATURES, numTrees=5, maxDepth=3) for _ in range(2))
    assert rows(a.transform(training), "prediction") == rows(b.transform(training), "prediction")


def test_importance_names_come_from_the_assembler(spark, training):
    model = mo.train_rf_binary(training, FEATURES, numTrees=5, maxDepth=3)
    found = rows(mo.feature_importance(spark, model, k=2))
    assert found[0][0] == "signal" and len(found) == 2
    assert {name for name, _ in rows(mo.feature_importance(spark, model, k=None))} == set(FEATURES)


def test_weighting_raises_recall_of_the_rare_class(spark, training):
    weighted = mo.train_lr(training, FEATURES, maxIter=20).transform(training)
    plain = mo.train_lr(training, FEATURES, weight=None, maxIter=20).transform(training)
    hits = "binary_label = 1 and prediction = 1"
    assert weighted.where(hits).count() > plain.where(hits).count()


def test_results_and_deltas(spark, training):
    model = mo.train_lr(training, FEATURES, maxIter=5)
    metrics = mo.evaluate(model, training, "binary_label")
    table = mo.results_table(spark, {"old": metrics, "new": metrics.withColumn("f1", F.col("f1") + 0.1)}, 300, 100)
    assert table.columns == ["model", "metric", "value", "train_rows", "test_rows"] and table.count() == 12
    wide = mo.model_comparison(table)
    assert wide.columns == ["model", *mo.METRICS]
    deltas = {r["metric"]: r["delta"] for r in mo.metric_deltas(table, "old", "new").collect()}
    assert deltas["f1"] == pytest.approx(0.1) and deltas["accuracy"] == 0.0


@pytest.mark.parametrize("name", sorted(MODEL_PRESETS))
def test_presets_are_accepted(name):
    kind = name.split("_")[0]
    classifier = mo.CLASSIFIERS[kind](**MODEL_PRESETS[name])
    for parameter, value in MODEL_PRESETS[name].items():
        assert classifier.getOrDefault(parameter) == value
