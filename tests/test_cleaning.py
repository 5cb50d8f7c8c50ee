import math

import pytest
from frames import rows
from pyspark.sql import functions as F

from flowlens.functions.numeric import finite
from flowlens.operators import cleaning as cl
from flowlens.operators import columns as co

NAN, INF = float("nan"), float("inf")
VALUES = [1.0, None, NAN, INF, -INF, 4.0]


@pytest.fixture
def dirty(spark):
    return spark.createDataFrame([(i, v, "x", v) for i, v in enumerate(VALUES)],
                                 "id int, v double, text string, label double").coalesce(1)


def test_finite_keeps_only_numbers(dirty):
    assert rows(dirty.select(finite(F.col("v")))) == [(1.0,), (None,), (None,), (None,), (None,), (4.0,)]


@pytest.mark.parametrize("policy, expected", [
    ("null", [1.0, None, None, None, None, 4.0]),
    ("zero", [1.0, 0.0, 0.0, 0.0, 0.0, 4.0]),
    ("mean", [1.0, 2.5, 2.5, 2.5, 2.5, 4.0]),
    ("drop", [1.0, 4.0]),
])
def test_policies(dirty, policy, expected):
    found = cl.mask_numeric(dirty, ["v"], policy)
    assert [r["v"] for r in found.orderBy("id").collect()] == expected


def test_label_columns_are_left_alone(dirty):
    found = [r["label"] for r in cl.mask_numeric(dirty).orderBy("id").collect()]
    assert found[1] is None and math.isnan(found[2]) and found[3] == INF


def test_mean_of_an_empty_column_is_zero(spark):
    df = spark.createDataFrame([(None,), (NAN,)], "v double")
    assert rows(cl.mask_numeric(df, ["v"], "mean")) == [(0.0,), (0.0,)]


def test_integers_are_not_tested_for_nan(spark):
    df = spark.createDataFrame([(1,), (None,)], "n int")
    assert rows(cl.mask_numeric(df, policy="zero")) == [(1,), (0,)]


def test_unknown_policy(dirty):
    with pytest.raises(ValueError):
        cl.mask_numeric(dirty, ["v"], "median")
    with pytest.raises(ValueError):
        cl.impute(dirty, "median")


def test_impute_strategies(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None)], "v double, s string")
    assert rows(cl.impute(df, "drop")) == [(1.0, "a")]
    assert rows(cl.impute(df, "fill_zero")) == [(1.0, "a"), (0.0, "b"), (3.0, None)]
    assert rows(cl.impute(df, "fill_mean")) == [(1.0, "a"), (2.0, "b"), (3.0, None)]


def test_missing_profile_counts_null_and_nan(dirty):
    found = {r["column_name"]: (r["missing"], r["total_rows"]) for r in cl.missing_profile(dirty).collect()}
    assert found == {"id": (0, 6), "v": (2, 6), "text": (0, 6)}


def test_sparse_columns_need_more_than_the_threshold(spark):
    df = spark.createDataFrame([(1.0, None, None), (2.0, None, None), (3.0, 1.0, None), (4.0, 1.0, None)],
                               "a double, half double, label double")
    assert cl.sparse_columns(df, 0.5) == []
    assert cl.sparse_columns(df, 0.49) == ["half"]
    assert cl.drop_sparse_columns(df, 0.49).columns == ["a", "label"]


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert cl.sparse_columns(df) == []
    assert {r["missing_ratio"] for r in cl.missing_profile(df).collect()} == {0.0}


def test_low_variance(spark):
    df = spark.createDataFrame([(5.0, 0.0, 1.0), (5.0, 0.1, 9.0), (5.0, 0.2, 2.0)],
                               "same double, close double, wide double")
    assert cl.drop_low_variance(df, 0.01).columns == ["close", "wide"]  # variance of close is exactly 0.01
    assert cl.drop_low_variance(df, 0.02).columns == ["wide"]


def test_duplicates_with_nan_and_null(spark):
    df = spark.createDataFrame([(NAN, None), (NAN, None), (1.0, "a"), (1.0, "a"), (1.0, "b")], "v double, s string")
    assert cl.deduplicate(df).count() == 3
    report = cl.duplicate_report(df).first()
    assert (report["total_rows"], report["distinct_rows"], report["removed_rows"]) == (5, 3, 2)
    assert report["removed_ratio"] == pytest.approx(0.4)
    assert cl.duplicate_report(df.limit(0)).first()["removed_ratio"] == 0.0


@pytest.mark.parametrize("raw, batch, stream", [
    ("Flow Bytes/s", "flow_bytes_s", "Flow_Bytes_per_s"),
    (" Label", "label", "Label"),
    ("Fwd Header Length.1", "fwd_header_length_1", "Fwd_Header_Length_dot_1"),
    ("__a  b__", "a_b", "__a__b__"),
])
def test_names(raw, batch, stream):
    assert co.batch_name(raw) == batch
    assert co.stream_name(raw) == stream


def test_name_collisions_are_errors(spark):
    df = spark.createDataFrame([(1, 2)], ["a b", "a_b"])
    with pytest.raises(ValueError, match="collide"):
        co.clean_names_batch(df)


def test_identifiers_and_features(spark):
    df = spark.createDataFrame([(1, "x", 2.0, 3, 0, 1.0, 0.0)],
                               ["id", "srcip", "dur", "spkts", "label", "sample_weight", "proto_indexed"])
    assert co.drop_identifiers(df, "unsw").columns == ["dur", "spkts", "label", "sample_weight", "proto_indexed"]
    assert co.feature_columns(df) == ["dur", "spkts"]
    assert co.final_projection(df, ["dur"], ["label", "absent"]).columns == ["dur", "label"]


def test_schema_diff(spark):
    a, b = spark.createDataFrame([(1, 2, 3)], ["z", "y", "a"]), spark.createDataFrame([(1, 2)], ["z", "b"])
    assert co.schema_diff(a, b) == {"common": ["z"], "left_only": ["a", "y"], "right_only": ["b"]}
    assert rows(co.schema_diff_table(spark, a, b)) == [("z", "common"), ("a", "left_only"), ("y", "left_only"),
                                                       ("b", "right_only")]
