import pytest
from frames import rows
from pyspark.sql import functions as F

from flowlens.functions import detection as D
from flowlens.operators import models as mo
from flowlens.operators import scoring as sc
from flowlens.schemas import CLASS_NAMES, SEVERITY_POLICIES

CASES = [(0.0, 4.0), (1.0, 0.0), (1.0, 9.0), (-1.0, -1.0), (None, None), (1.0, 42.0)]


@pytest.fixture
def predicted(spark):
    return spark.createDataFrame([(i, b, m) for i, (b, m) in enumerate(CASES)],
                                 "i int, binary_prediction double, multiclass_prediction double").coalesce(1)


def test_cascade(predicted):
    found = sc.enrich(sc.cascade_predictions(predicted), clock=F.lit("2024-01-01").cast("timestamp"))
    assert rows(found, "multiclass_prediction", "attack_type", "is_attack", "severity") == [
        (0.0, "Normal", False, "NONE"), (0.0, "Normal", True, "LOW"), (9.0, "Worms", True, "HIGH"),
        (-1.0, "Unknown", False, "NONE"), (None, "Unknown", False, "NONE"), (42.0, "Unknown", True, "LOW")]


def test_parallel_keeps_the_type_of_non_attacks(predicted):
    found = sc.enrich(predicted)
    assert rows(found, "attack_type", "is_attack", "severity")[0] == ("DoS", False, "MEDIUM")
    assert found.where("processed_at is null").count() == 0


@pytest.mark.parametrize("space", sorted(CLASS_NAMES))
def test_every_class_has_its_name(spark, space):
    names = CLASS_NAMES[space]
    df = spark.createDataFrame([(float(k), v) for k, v in names.items()], "p double, name string")
    assert df.where(D.attack_type(F.col("p"), names) != F.col("name")).count() == 0


@pytest.mark.parametrize("policy", sorted(SEVERITY_POLICIES))
def test_every_listed_type_has_its_level(spark, policy):
    rules = SEVERITY_POLICIES[policy]
    data = [(kind, level, attack) for level, kinds in rules["levels"] for kind in kinds for attack in (True, False)]
    data += [("Odd", rules["fallback"], True), ("Odd", "NONE", False), (None, rules["fallback"], True)]
    df = spark.createDataFrame(data, "kind string, level string, attack boolean")
    assert df.where(D.severity(F.col("kind"), F.col("attack"), policy) != F.col("level")).count() == 0


def test_own_policy(spark):
    df = spark.createDataFrame([("X", True)], "kind string, attack boolean")
    policy = {"levels": [("HIGH", ["X"])], "fallback": "LOW"}
    assert rows(df.select(D.severity(F.col("kind"), F.col("attack"), policy))) == [("HIGH",)]


@pytest.fixture(scope="module")
def detector(spark):
    data = [(float(i % 10), float(i % 3), float(i % 10 > 4), float(i % 10 if i % 10 > 4 else 0)) for i in range(300)]
    train = spark.createDataFrame(data, ["a", "b", "binary_label", "multiclass_label"])
    binary = mo.train(train, "gbt", ["a", "b"], "binary_label", prefix=sc.BINARY, maxIter=3, maxDepth=3, seed=1)
    multi = mo.train(train, "rf", ["a", "b"], "multiclass_label", prefix=sc.MULTI, numTrees=5, maxDepth=5, seed=1)
    return sc.Detector(binary, multi), train


def test_two_models_on_one_frame(detector):
    models, train = detector
    found = sc.score_and_enrich(train, models)
    assert not [c for c in found.columns if c.endswith(("features", "rawPrediction", "probability"))]
    assert found.where("binary_prediction <> binary_label").count() == 0
    assert found.where("binary_prediction = 0 and multiclass_prediction <> 0").count() == 0
    assert found.where("prediction_score < 0.5 or prediction_score > 1").count() == 0
    assert found.where("is_attack and attack_type = 'Worms' and severity <> 'HIGH'").count() == 0


def test_split_cascade_equals_the_plain_one(detector):
    models, train = detector
    columns = ["a", "b", "binary_prediction", "multiclass_prediction"]
    plain = sc.score_cascade(train, models.binary, models.multiclass)
    split = sc.score_cascade(train, models.binary, models.multiclass, split=True)
    assert sorted(rows(plain, *columns)) == sorted(rows(split, *columns))


def test_without_models(detector):
    _, train = detector
    found = sc.score_and_enrich(train, sc.Detector())
    assert found.select("binary_prediction", "multiclass_prediction", "is_attack", "severity", "attack_type").distinct(
    ).collect() == [(-1.0, -1.0, False, "NONE", "Unknown")]


def test_threshold(detector):
    models, train = detector
    all_attacks = sc.score_binary(train, models.binary, threshold=0.0)
    assert all_attacks.where("binary_prediction = 0").count() == 0
    none = sc.score_binary(train, models.binary, threshold=1.01)
    assert none.where("binary_prediction = 1").count() == 0


def test_summary(predicted):
    scored = sc.enrich(sc.cascade_predictions(predicted)).withColumn("batch_id", F.lit(1))
    found = sc.detection_summary(scored, ["batch_id"]).first().asDict()
    assert found == {"batch_id": 1, "processed": 6, "attacks": 3, "high": 1, "medium": 0, "low": 2,
                     "detection_rate": 0.5}
