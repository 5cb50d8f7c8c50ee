"""Queries that check trained models, detections and sessions by what SQL can state of them.

Learned values differ from SQL's; row counts by class, agreement of two ways to the same
figure, and bounds don't. Each query runs its operator over the whole table and returns those.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from flowlens.operators import alerts as al, evaluation as ev, features as fe, models as mo, scoring as sc, sessions as se
from flowlens.plans import fixtures as fx
from flowlens.plans.catalog import (
    KEY, SMALL_BOOST, SMALL_FOREST, _replay, _unsw_rows, stored_alerts, training_rows, unsw_detector)
from flowlens.schemas import CLASS_NAMES, SESSION_EVENT_SCHEMA, UNSW_FEATURES
from flowlens.sources import alert_table as at, flows as fl, models as sm, storage as st
from flowlens.streaming import detect as de

QUERIES: dict[str, Callable] = {}


def query(make: Callable) -> Callable:
    QUERIES[make.__name__] = make
    return make


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Both sides of the training rows, written once: each fit reads its side many times."""
    train, test = training_rows(spark, sf)
    return st.materialize(train.drop("embedding"), "train"), st.materialize(test.drop("embedding"), "test")


def _report(spark, sf, fit: Callable[[DataFrame], PipelineModel], label: str, binary: bool = True) -> DataFrame:
    """Rows of each class on both sides; whether MLlib's evaluators find the reported metrics again in
    stored predictions; whether the model is better than a guess."""
    train, test = _sides(spark, sf)
    model = fit(train)
    reported = mo.evaluate(model, test, label, binary=binary).first().asDict()
    stored = st.materialize(model.transform(test).select(label, "prediction", "probability"), "scored")
    again = ev.evaluator_metrics(stored, label, raw="probability" if binary else None)
    same = again.keys() == reported.keys() and all(abs(again[m] - reported[m]) < 1e-6 for m in reported)
    better = reported["auc_roc"] > 0.6 if binary else reported["accuracy"] > 0.2
    rows = train.select(label, F.lit(True).alias("trains")).unionByName(test.select(label, F.lit(False).alias("trains")))
    return rows.groupBy(F.col(label).alias("class")).agg(
        F.count_if("trains").alias("train_rows"), F.count_if(~F.col("trains")).alias("test_rows")
    ).withColumns({"as_reported": F.lit(same), "beats_guess": F.lit(better)})


@query
def train_lr_checked(spark, sf):
    return _report(spark, sf, lambda rows: mo.train_lr(rows, "vector"), "binary_label")


@query
def train_rf_binary_checked(spark, sf):
    return _report(spark, sf, lambda rows: mo.train_rf_binary(rows, "vector", **SMALL_FOREST), "binary_label")


@query
def train_gbt_binary_checked(spark, sf):
    return _report(spark, sf, lambda rows: mo.train_gbt_binary(rows, "vector", **SMALL_BOOST), "binary_label")


@query
def train_rf_multiclass_checked(spark, sf):
    return _report(spark, sf, lambda rows: mo.train_rf_multiclass(rows, "vector", **SMALL_FOREST), "unified_label", False)


@query
def model_comparison_checked(spark, sf):
    """Weighted against unweighted training: every value of the long form stands in the wide one, and the
    deltas are their differences."""
    train, test = _sides(spark, sf)
    both = mo.compare_weighted(train, test, "vector", maxIter=5)
    parts = {name: both.where(F.col("model") == name) for name in ("unweighted", "weighted")}
    long = mo.results_table(spark, parts, train.count(), test.count())
    wide = mo.model_comparison(long).unpivot("model", mo.METRICS, "metric", "in_table")
    deltas = mo.metric_deltas(long, "unweighted", "weighted")
    value = F.col("value")
    side = F.when(F.col("model") == "weighted", F.col("after")).otherwise(F.col("before"))
    difference = F.abs(F.col("after") - F.col("before") - F.col("delta")) < 1e-12
    return long.join(wide, ["model", "metric"]).join(deltas, "metric").select(
        "model", "metric", value.between(0, 1).alias("in_range"),
        ((F.col("in_table") == value) & (side == value) & difference).alias("agrees"), "train_rows", "test_rows")


@query
def feature_importance_checked(spark, sf):
    """All features; their shares lie in 0 to 1 and add up to 1."""
    train, _ = _sides(spark, sf)
    found = mo.feature_importance(spark, mo.train_rf_binary(train, "vector", **SMALL_FOREST), k=None)
    total = F.sum("importance").over(Window.partitionBy())  # one row per feature
    return found.select("feature", F.col("importance").between(0, 1).alias("in_range"),
                        (F.abs(total - 1) < 1e-6).alias("adds_up"))


@query
def score_binary_checked(spark, sf):
    """Every held-out row: the score belongs to the likelier class, a threshold of 0 calls all attacks, one
    above 1 none, and without a model the prediction is -1."""
    train, test = _sides(spark, sf)
    model = mo.train_gbt_binary(train, "vector", prefix=sc.BINARY, **SMALL_BOOST)
    scored = sc.score_binary(test, model)
    for name, threshold in (("low", 0.0), ("high", 1.1)):
        cut = sc.score_binary(test, model, threshold).select("vec_id", F.col("binary_prediction").alias(name))
        scored = scored.join(cut, "vec_id")
    bare = sc.score_binary(test, None).select("vec_id", F.col("binary_prediction").alias("bare"))
    likelier = F.col("binary_prediction").isin(0.0, 1.0) & F.col("prediction_score").between(0.5, 1.0)
    return scored.join(bare, "vec_id").select(
        "vec_id", likelier.alias("likelier"), (F.col("low") == 1.0).alias("all_attacks"),
        (F.col("high") == 0.0).alias("no_attacks"), (F.col("bare") == -1.0).alias("no_model"))


@query
def saved_model_checked(spark, sf):
    """Every held-out row scores the same with a model that was saved and loaded."""
    train, test = _sides(spark, sf)
    model, folder = mo.train_rf_binary(train, "vector", **SMALL_FOREST), st.scratch_path(spark, "models")
    sm.save_model(model, folder, "rf_binary")
    sm.save_classes(spark, folder, "rf_binary", CLASS_NAMES["unsw"])
    names = sm.load_classes(spark, folder, "rf_binary") == CLASS_NAMES["unsw"]
    loaded = sm.load_model(spark, folder, ["missing", "rf_binary"])

    def of(fitted, name):
        return fitted.transform(test).select(
            "vec_id", F.struct("prediction", vector_to_array("probability")).alias(name))
    return of(model, "a").join(of(loaded, "b"), "vec_id").select(
        "vec_id", (F.col("a") == F.col("b")).alias("same"), F.lit(names).alias("class_names"))


DETECTED = ["attack_type", "severity", "binary_prediction", "multiclass_prediction", "prediction_score"]


@query
def stream_detect_checked(spark, sf):
    """Messages sent and parsed, and distinct alerts that the stream and the batch job give unequally often."""
    _, test = _unsw_rows(spark, sf)
    messages = fl.flows_to_json(test.select("id", *UNSW_FEATURES), producer_id=1)
    detector = unsw_detector(spark, sf)
    path, log = st.scratch_path(spark, "alerts"), st.scratch_path(spark, "sessions")
    de.run_detection(spark, _replay(spark, messages, 3), "unsw", detector, [de.alert_sink(path, "live")], "live", log,
                     every=None)
    batch = st.materialize(de.detect(messages, "unsw", detector).select(*DETECTED, "is_attack"), "detected")
    signed = batch.where("is_attack").select(*DETECTED, F.lit(1).alias("n")).unionByName(
        at.read_alerts(spark, path).select(*DETECTED, F.lit(-1).alias("n")))
    unequal = signed.groupBy(*DETECTED).agg(F.sum("n").alias("n")).where("n <> 0")
    return unequal.agg(F.count(F.lit(1)).alias("unequal")).select(
        F.lit(messages.count()).cast("bigint").alias("sent"), F.lit(batch.count()).cast("bigint").alias("parsed"), "unequal")


# Sessions and tables -----------------------------------------------------

@query
def session_lifecycle(spark, sf):
    """Every session registered, and those of even number ended, by one call each."""
    log = st.scratch_path(spark, "sessions")
    for row in fx.session_log(spark, sf).orderBy("event_at", F.desc("event")).collect():  # two rows per session at most
        if row["event"] == se.REGISTERED:
            at.register_session(spark, log, row["session_id"], row["metadata"], row["event_at"])
        else:
            at.end_session(spark, log, row["session_id"], row["event_at"])
    at.end_session(spark, log, "never-registered")
    return se.session_states(at.read_session_log(spark, log)).select(
        "session_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "ended_at")], "status",
        F.col("metadata")["data_source"].alias("data_source"))


@query
def delete_all_sessions(spark, sf):
    """What deleting everything reports, and what is left."""
    path, log = stored_alerts(spark, sf), st.scratch_path(spark, "sessions")
    events = fx.session_log(spark, sf)
    events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SESSION_EVENT_SCHEMA.fields]).write.parquet(log)
    gone = at.delete_all_sessions(spark, path, log)
    alerts, sessions = at.read_alerts(spark, path).count(), at.read_session_log(spark, log).count()
    return spark.createDataFrame([(gone["alerts_deleted"], gone["sessions_deleted"], alerts, sessions)],
                                 "alerts_deleted long, sessions_deleted long, alerts_left long, events_left long")


@query
def compact_alerts(spark, sf):
    """Alerts stored once, and those of one session once more, of which every day is compacted."""
    path = stored_alerts(spark, sf)
    at.append_alerts(al.alert_filter(fx.alerts(spark, sf).where("is_attack"), session_id="sess2"), path, "sess2")
    at.compact_alerts(spark, path, datetime.min, datetime.max)
    return at.read_alerts(spark, path).select("event_id", "severity", "attack_type", "session_id", "alert_date", "batch_id")


@query
def index_many_categories(spark, sf):
    """Key columns, whose values grow with the table, as categories."""
    return fe.index_by_rank(fx.flows(spark, sf), ["l_orderkey", "service"]).select(
        *KEY, "l_orderkey_indexed", "service_indexed")


@query
def read_processed(spark, sf):
    """All flows written as a processed table and read again."""
    path = st.scratch_path(spark, "processed")
    fl.write_processed(fx.flows(spark, sf).select(*KEY, "bytes", "service", "label"), path, 4)
    return fl.read_processed(spark, path)


@query
def enrich_now(spark, sf):
    """Scored rows stamped with the time of the run."""
    scored = sc.enrich(sc.cascade_predictions(fx.scored_flows(spark, sf)), "unsw")
    return scored.select("event_id", (F.col("processed_at") == F.current_timestamp()).alias("stamped"), "severity")


__all__ = ["QUERIES"]
