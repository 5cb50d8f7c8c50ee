import pytest
from frames import rows
from pyspark.sql import functions as F

from flowlens.functions import labels as L
from flowlens.operators import labeling as la
from flowlens.operators.lookup import join_lookup, small_copy
from flowlens.schemas import UNIFIED_LABELS_2017, UNIFIED_LABELS_2018, UNSW_LABELS


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "label string").coalesce(1)


def test_standard_label_trims_spaces_only(spark):
    df = la.standardize_label(frame(spark, [" Bot ", " Bot\t", None]))
    assert rows(df) == [("bot",), ("bot\t",), (None,)]


def test_binary_label(spark):
    df = la.add_binary_label(frame(spark, ["BENIGN", "Normal", "DDoS", None]))
    assert [r["binary_label"] for r in df.collect()] == [0, 0, 1, 1]
    exact = frame(spark, ["BENIGN", "Benign", None]).select(L.exact_binary_label(F.col("label"), "BENIGN"))
    assert rows(exact) == [(0,), (1,), (1,)]


def test_label_text(spark):
    df = spark.createDataFrame([(0, "x"), (1, "dos"), (None, "worms")], "label int, attack_cat string").coalesce(1)
    assert [r["label_text"] for r in la.add_label_text(df).collect()] == ["normal", "dos", "worms"]
    assert [r["label_text"] for r in la.add_label_text(df.drop("label")).collect()] == ["x", "dos", "worms"]


def test_blank_category_is_normal(spark):
    df = spark.createDataFrame([(" Fuzzers ",), ("  ",), ("",), (None,)], "attack_cat string").coalesce(1)
    assert rows(la.normalize_attack_cat(df)) == [("Fuzzers",), ("Normal",), ("Normal",), ("Normal",)]


@pytest.mark.parametrize("dataset, classes", [
    ("cicids2017", UNIFIED_LABELS_2017), ("cicids2018", UNIFIED_LABELS_2018), ("unsw", UNSW_LABELS)])
def test_every_label_is_found_in_any_case(spark, dataset, classes):
    spelled = [(label, class_id) for label, class_id in classes.items()]
    spelled += [(f" {label.lower()} ", class_id) for label, class_id in classes.items()]
    df = spark.createDataFrame(spelled, "label string, expected int")
    assert la.map_labels(df, dataset).where("unified_label <> expected").count() == 0


def test_label_dashes_and_defaults(spark):
    df = frame(spark, ["Web Attack – XSS", "Web Attack � XSS", "Web Attack - XSS", "something", None])
    assert [r["unified_label"] for r in la.map_labels(df, "cicids2017").collect()] == [4, 4, 4, 8, 8]
    assert [r["unified_label"] for r in la.map_labels(df, "unsw").collect()] == [0] * 5
    assert [r["unified_label"] for r in la.map_labels(df, "unsw", default=-1).collect()] == [-1] * 5


def test_unsw_training_labels(spark):
    df = spark.createDataFrame([("Backdoors",), (None,), ("Worms ",), ("Odd",)], "attack_cat string").coalesce(1)
    assert rows(la.prepare_unsw_labels(df)) == [("Backdoors", 3.0, 1.0), ("Normal", 0.0, 0.0), ("Worms", 9.0, 1.0),
                                                ("Odd", 0.0, 1.0)]


def test_weight_schemes(spark):
    df = frame(spark, ["a"] * 6 + ["b"] * 2 + ["c"])
    inverse = {r["label"]: r["weight"] for r in la.class_weights(df).collect()}
    assert inverse == {"a": 1.0, "b": 3.0, "c": 6.0}
    root = {r["label"]: r["weight"] for r in la.class_weights(df, scheme="sqrt").collect()}
    assert root["b"] == pytest.approx((9 / (3 * 2)) ** 0.5)
    two = {r["label"]: r["weight"] for r in la.class_weights(df, scheme="sqrt2").collect()}
    assert two["c"] == pytest.approx((9 / 2) ** 0.5)
    with pytest.raises(ValueError):
        la.class_weights(df, scheme="cubic")


def test_inverse_weights_balance_the_classes(spark):
    df = frame(spark, ["a"] * 7 + ["b"] * 3 + [None])
    assert {r["weight"] * r["count"] for r in la.class_weights(df).collect()} == {7.0}


def test_attached_weights(spark):
    df = frame(spark, ["a", "a", "b", "c", None])
    weights = la.class_weights(df).where(F.col("label") != "c")
    found = {r["label"]: r["sample_weight"] for r in la.attach_weights(df, weights).collect()}
    assert found == {"a": 1.0, "b": 2.0, "c": 1.0, None: 1.0}
    strict = {r["label"]: r["sample_weight"] for r in la.attach_weights(df, weights, default=None).collect()}
    assert strict == {"a": 1.0, "b": 2.0, "c": None, None: None}


def test_lookup_past_its_bound_still_joins(spark):
    left = spark.range(100).withColumn("k", F.col("id") % 10)
    table = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert small_copy(table, 9) is None
    assert small_copy(table, 10).count() == 10
    small, large = join_lookup(left, table, "k"), join_lookup(left, table, "k", max_rows=3)
    assert sorted(rows(small)) == sorted(rows(large))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_harmonize_shares_sorted_columns(spark):
    a = spark.createDataFrame([(1, "BENIGN", 2.0, "x"), (2, "DoS Hulk", 3.0, "y")], ["z", "label", "f", "only_a"])
    b = spark.createDataFrame([(5.0, "Bot", 3), (6.0, "Benign", 4)], ["f", "label", "z"])
    merged = la.harmonize({"cicids2017": a, "cicids2018": b})
    assert merged.columns == ["dataset_source", "f", "label", "unified_label", "z", "multiclass_weight"]
    assert sorted(rows(merged, "z", "unified_label", "dataset_source", "multiclass_weight")) == [
        (1, 0, "cicids2017", 1.0), (2, 1, "cicids2017", 2.0), (3, 6, "cicids2018", 2.0), (4, 0, "cicids2018", 1.0)]
