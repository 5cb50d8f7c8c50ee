"""Every registered query against its SQL twin, on the smallest scale factor."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_returns_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["timestamp", "count", "high_severity_count"]
    assert df.count() > 0


# Operators that run Python per row or pair every row with every other.
UNWANTED = ["BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct",
            "BroadcastNestedLoopJoin"]


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - set(entry.LLM_ORACLES)))
def test_matches_sql(spark, connection, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [operator for operator in UNWANTED if operator in plan]
    assert compare(df, connection, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["train_lr", "train_rf_binary", "train_gbt_binary"])
def test_binary_models_separate_the_classes(spark, name):
    metrics = entry.queries()[name](spark, SF).first()
    assert 0.7 < metrics["auc_roc"] <= 1.0
    assert 0.0 < metrics["accuracy"] <= 1.0


def test_multiclass_model_beats_guessing(spark):
    assert entry.queries()["train_rf_multiclass"](spark, SF).first()["accuracy"] > 0.25


def test_model_tables(spark):
    assert [r["model"] for r in entry.queries()["compare_weighted"](spark, SF).collect()] == ["unweighted", "weighted"]
    importance = entry.queries()["feature_importance"](spark, SF).collect()
    values = [r["importance"] for r in importance]
    assert len(values) == 20 and values == sorted(values, reverse=True)
    comparison = entry.queries()["model_comparison"](spark, SF)
    assert {r["model"] for r in comparison.collect()} == {"rf", "gbt"}


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["alert_timeline"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [GreaterThanOrEqual(ts,2024-01-01T00:00), IsNotNull(ts)]" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_no_window_over_all_rows(spark):
    """Orders over whole tables are cut into ranges: an unkeyed window sees aggregated rows only."""
    for name in ("auc_roc", "auc_pr", "stratified_split"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        for part in plan.split("Exchange SinglePartition")[1:]:
            assert "Aggregate" in part.splitlines()[1]


def test_suite_reports_every_model(spark):
    results = entry.queries()["train_suite"](spark, SF).collect()
    values = {(r["model"], r["metric"]): r["value"] for r in results}
    assert len(results) == 6 + 6 + 4
    assert values["unsw_gbt_binary", "auc_roc"] > 0.7 and values["unsw_multiclass", "accuracy"] > 0.25
    assert {(r["train_rows"] + r["test_rows"]) for r in results} != {0}


def test_stream_and_batch_detection_agree(spark):
    stream = {tuple(r) for r in entry.queries()["stream_detect"](spark, SF).collect()}
    batch = {tuple(r) for r in entry.queries()["batch_detect"](spark, SF).collect()}
    assert stream == batch and stream


def test_duplicate_headers_are_written_by_many_tasks(spark, tmp_path):
    """No task sorts or writes the whole table."""
    copy = f"{tmp_path}/sf"
    spark.read.parquet(f"{SF}/lineitem.parquet").repartition(4).write.parquet(f"{copy}/lineitem.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    try:
        df = entry.queries()["read_flow_csv_duplicate_headers"](spark, copy)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(df.inputFiles()) == 4 and df.count() == spark.read.parquet(f"{copy}/lineitem.parquet").count()
