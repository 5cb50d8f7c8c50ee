"""Every registered query: name to function (spark, sf_dir) to DataFrame."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.functions.detection import attack_type
from flowlens.operators import (
    aggregates as agg,
    alerts as al,
    cleaning as cl,
    columns as co,
    evaluation as ev,
    features as fe,
    labeling as la,
    models as mo,
    rollups as ro,
    scoring as sc,
    sessions as se,
    splits as sp,
)
from flowlens.plans import fixtures as fx, preprocess as pp, training as tr
from flowlens.schemas import CLASS_NAMES, UNSW_FEATURES, csv_schema
from flowlens.sources import alert_counts as ac, alert_table as at, distinct_table as dt, flows as fl, storage as st, streams as ss
from flowlens.streaming import detect as de, messages as me

NOW = datetime(2024, 1, 31)
ALERT_VIEW = ["event_id", "processed_at", "attack_type", "severity", "session_id"]
KEY = fx.FLOW_KEY

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


# Alerts ------------------------------------------------------------------

@query
def recent_alerts(spark, sf):
    return al.recent_alerts(fx.alerts(spark, sf), 100, severity="high", tie_break="event_id").select(*ALERT_VIEW)


@query
def recent_alerts_session(spark, sf):
    found = al.recent_alerts(fx.alerts(spark, sf), 50, attack_type="DoS", tie_break="event_id",
                             current_session="sess3")
    return found.select(*ALERT_VIEW)


@query
def alert_time_range(spark, sf):
    return al.alert_time_range(fx.alerts(spark, sf), datetime(2024, 1, 10), datetime(2024, 1, 12)).select(*ALERT_VIEW)


@query
def alert_search(spark, sf):
    return al.alert_search(fx.alerts(spark, sf), "SESS1", severity="medium", date_from=datetime(2024, 1, 5),
                           date_to=datetime(2024, 1, 25)).select(*ALERT_VIEW)


@query
def relative_range(spark, sf):
    return al.relative_range(fx.alerts(spark, sf), "7d", NOW).select(*ALERT_VIEW)


@query
def alert_page(spark, sf):
    return al.page(fx.alerts(spark, sf), "attack_type", "asc", 3, 50).select(*ALERT_VIEW)


@query
def alert_page_deep(spark, sf):
    """A page far down the list, read without passing over the rows before it."""
    return al.page(fx.alerts(spark, sf), "severity", "desc", 19, 50, shallow=100).select(*ALERT_VIEW)


@query
def alert_page_count(spark, sf):
    return al.page_count(fx.alerts(spark, sf), 50)


@query
def top_attack_types(spark, sf):
    return al.top_attack_types(fx.alerts(spark, sf), 10)


@query
def top_sources(spark, sf):
    return al.top_sources(fx.alerts(spark, sf), 10)


@query
def alert_statistics(spark, sf):
    """Some types are null, some are stored as Unknown; the map comes as text in the order of its keys."""
    kind = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, "Unknown").otherwise(
        F.col("attack_type"))
    found = al.alert_statistics(fx.alerts(spark, sf).withColumn("attack_type", kind), 24, NOW)
    entries = F.sort_array(F.transform(F.map_entries("by_attack_type"),
                                       lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return found.withColumn("by_attack_type", F.concat_ws(",", entries))


@query
def alert_type_counts(spark, sf):
    return al.alert_type_counts(fx.alerts(spark, sf), 24, NOW)


@query
def alert_timeline(spark, sf):
    return al.alert_timeline(fx.alerts(spark, sf), 24 * 30, 60, NOW)


@query
def alert_timeline_odd_bins(spark, sf):
    return al.alert_timeline(fx.alerts(spark, sf), 24 * 30, 7, NOW, session_id="sess3")


@query
def alert_metrics(spark, sf):
    return rounded(al.alert_metrics(fx.alerts(spark, sf), "7d", NOW), "avg_confidence")


@query
def alert_metrics_custom(spark, sf):
    """Metrics of a range with both ends given."""
    found = al.alert_metrics(fx.alerts(spark, sf), "custom", start=datetime(2024, 1, 10), end=datetime(2024, 1, 20))
    return rounded(found, "avg_confidence")


@query
def top_attacks(spark, sf):
    return rounded(al.top_attacks(fx.alerts(spark, sf), "30d", 10, NOW), "bar")


@query
def attack_share(spark, sf):
    return rounded(al.attack_share(fx.alerts(spark, sf), "30d", 4, NOW), "percent")


@query
def activity_series(spark, sf):
    return al.activity_series(fx.alerts(spark, sf), "24h", NOW)


@query
def activity_series_30d(spark, sf):
    return al.activity_series(fx.alerts(spark, sf), "30d", NOW)


@query
def severity_trend(spark, sf):
    return al.severity_trend(fx.alerts(spark, sf), "7d", NOW)


@query
def session_statistics(spark, sf):
    return al.session_statistics(fx.alerts(spark, sf), "30d", 10, NOW)


@query
def alert_count(spark, sf):
    return al.alert_count(fx.alerts(spark, sf), datetime(2024, 1, 20), "high")


@query
def recent_count(spark, sf):
    return al.recent_count(fx.alerts(spark, sf), 600, NOW)


@query
def severity_distribution(spark, sf):
    return al.severity_distribution(fx.alerts(spark, sf), 24 * 7, NOW)


@query
def traffic_totals(spark, sf):
    return al.traffic_totals(fx.alerts(spark, sf))


@query
def traffic_split(spark, sf):
    return al.traffic_split(fx.alerts(spark, sf))


@query
def export_alerts(spark, sf):
    return at.export_alerts(fx.alerts(spark, sf), 1000, severity="MEDIUM", tie_break="event_id")


# Sessions and the stored alert table -------------------------------------

def stored_alerts(spark: SparkSession, sf: str) -> str:
    path = st.scratch_path(spark, "alerts")
    at.write_alert_table(fx.alerts(spark, sf).where("is_attack"), path)
    return path


@query
def sessions(spark, sf):
    return se.sessions(fx.session_log(spark, sf), 20).drop("metadata")


@query
def active_sessions(spark, sf):
    return se.sessions(fx.session_log(spark, sf), 10, active_only=True).drop("metadata")


@query
def session_info(spark, sf):
    return se.session_info(fx.session_log(spark, sf), "sess4").drop("metadata")


@query
def delete_session(spark, sf):
    """Alerts left in the stored table after one session was deleted."""
    path = stored_alerts(spark, sf)
    at.clear_session_alerts(spark, path, "sess4")
    return at.read_alerts(spark, path).select(*ALERT_VIEW, "alert_date")


@query
def delete_old_alerts(spark, sf):
    """Alerts left in the stored table after a clean-up whose cutoff falls inside a day."""
    path = stored_alerts(spark, sf)
    at.delete_old_alerts(spark, path, 10, datetime(2024, 1, 30, 13, 30))
    return at.read_alerts(spark, path).select(*ALERT_VIEW, "alert_date")


LATER = datetime(2024, 1, 30, 13, 37)  # inside a bin


def counted_alerts(spark, sf):
    """Counts and alerts after two loads, a direct insert, a deleted session and a clean-up that cuts a bin."""
    path, counts = st.scratch_path(spark, "alerts"), st.scratch_path(spark, "counts")
    rows = fx.alerts(spark, sf).where("is_attack")
    for batch in (0, 1):
        at.write_alert_table(rows.where((F.col("event_id") % 2 == batch) & (F.col("session_id") != "sess5")), path, batch)
    ac.recount_days(spark, path, counts, datetime(2023, 1, 1), datetime(2025, 1, 1))
    for again in (False, True):  # the second call replaces the first
        ac.write_counted_batch(rows.where("session_id = 'sess5'"), path, counts, "sess5", 7, F.col("processed_at"), replayed=again)
    ac.clear_session(spark, path, counts, "sess4")
    ac.delete_old(spark, path, counts, 10, datetime(2024, 1, 30, 13, 30))
    return ac.read_counts(spark, counts), at.read_alerts(spark, path)


@query
def alert_statistics_rollup(spark, sf):
    found = ro.alert_statistics_rollup(*counted_alerts(spark, sf), 7 * 24, LATER)
    entries = F.sort_array(F.transform(F.map_entries("by_attack_type"),
                                       lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return found.withColumn("by_attack_type", F.concat_ws(",", entries))


@query
def severity_trend_rollup(spark, sf):
    return ro.severity_trend_rollup(*counted_alerts(spark, sf), "30d", LATER)


@query
def alert_timeline_rollup(spark, sf):
    return ro.alert_timeline_rollup(*counted_alerts(spark, sf), 5 * 24, 360, LATER)


@query
def alert_page_rollup(spark, sf):
    """A deep page found in the counts: severity, then time."""
    return ro.alert_page_rollup(*counted_alerts(spark, sf), "severity", "desc", 7, 50).select(*ALERT_VIEW)


@query
def alert_page_rollup_types(spark, sf):
    """The same by type, upwards, in one session."""
    return ro.alert_page_rollup(*counted_alerts(spark, sf), "attack_type", "asc", 3, 20, session_id="sess5").select(*ALERT_VIEW)


@query
def alert_search_rollup(spark, sf):
    """Text found in the counts' dictionary of types, sessions and severities."""
    kept = counted_alerts(spark, sf)
    medium = ro.alert_search_rollup(*kept, "dos", severity="medium", date_from=datetime(2024, 1, 25))
    return ro.alert_search_rollup(*kept, "S1").union(medium).select(*ALERT_VIEW)


@query
def append_alerts(spark, sf):
    """One session's alerts inserted into the stored table a second time."""
    path = stored_alerts(spark, sf)
    again = al.alert_filter(fx.alerts(spark, sf).where("is_attack"), session_id="sess2")
    at.append_alerts(again, path, "sess2")
    return at.read_alerts(spark, path).groupBy("session_id", "batch_id").agg(F.count(F.lit(1)).alias("count"))


# Scoring -----------------------------------------------------------------

SCORED_VIEW = ["event_id", "binary_prediction", "multiclass_prediction", "attack_type", "is_attack", "severity"]


@query
def score_cascade(spark, sf):
    return sc.cascade_predictions(fx.scored_flows(spark, sf)).select(
        "event_id", "binary_prediction", "multiclass_prediction")


@query
def score_parallel(spark, sf):
    return fx.parallel_alerts(spark, sf).select(*SCORED_VIEW)


@query
def enrich(spark, sf):
    return fx.alerts(spark, sf).select(*SCORED_VIEW)


@query
def severity_policies(spark, sf):
    """Severity of the same alerts under the other two policies."""
    scored = fx.scored_flows(spark, sf)
    graded = sc.enrich(scored, "unsw", "graded", F.col("processed_at"))
    return sc.enrich(graded.withColumnRenamed("severity", "graded"), "cic_legacy", "simulation",
                     F.col("processed_at")).select("event_id", "attack_type", "graded", "severity")


@query
def apply_threshold(spark, sf):
    scored = fx.scored_flows(spark, sf)
    return sc.apply_threshold(scored, 0.05, F.col("prediction_score")).groupBy("binary_prediction").agg(
        F.count(F.lit(1)).alias("count"))


@query
def detection_summary(spark, sf):
    return rounded(sc.detection_summary(fx.alerts(spark, sf), ["session_id"]), "detection_rate")


@query
def attacks_by_type(spark, sf):
    return sc.attacks_by_type(fx.alerts(spark, sf))


# Cleaning ----------------------------------------------------------------

CLEAN_VIEW = [*KEY, "flow_rate", "sparse_col"]
DIRTY = ["flow_rate", "sparse_col"]


@query
def clean_zero(spark, sf):
    return cl.mask_numeric(fx.flows(spark, sf), DIRTY, "zero").select(*CLEAN_VIEW)


@query
def clean_mean(spark, sf):
    return rounded(cl.mask_numeric(fx.flows(spark, sf), DIRTY, "mean").select(*CLEAN_VIEW), *DIRTY)


@query
def clean_drop(spark, sf):
    return cl.mask_numeric(fx.flows(spark, sf), ["flow_rate"], "drop").select(*CLEAN_VIEW)


@query
def impute_drop(spark, sf):
    return cl.impute(fx.flows(spark, sf), "drop").select(*KEY, "sparse_col", "service", "label")


def doubled_flows(spark, sf):
    """Every flow twice. The copies are written differently so that they cannot be told
    apart by their values but are not optimised away as the same plan."""
    rows = fx.flows(spark, sf)
    return rows.unionByName(rows.withColumn("proto", F.upper("proto")))


@query
def deduplicate(spark, sf):
    """All flows twice, without their keys: many rows occur more than twice."""
    return cl.deduplicate(doubled_flows(spark, sf).drop("l_orderkey", "l_partkey", "l_suppkey", "bytes"))


@query
def deduplicate_increment(spark, sf):
    """All flows in three batches that overlap, the second written twice."""
    path, flows = st.scratch_path(spark, "distinct"), fx.flows(spark, sf)
    for n in (0, 1, 1, 2):
        batch = flows.where((F.col("l_orderkey") % 3).isin(n, (n + 1) % 3))
        dt.append_distinct(batch.drop("l_orderkey", "l_partkey", "l_suppkey", "bytes"), path, n)
    return dt.read_distinct(spark, path)


@query
def duplicate_report(spark, sf):
    return rounded(cl.duplicate_report(doubled_flows(spark, sf).drop("l_orderkey", "l_suppkey", "bytes")),
                   "removed_ratio")


@query
def missing_profile(spark, sf):
    return rounded(cl.missing_profile(fx.flows(spark, sf)), "missing_ratio")


@query
def drop_sparse_columns(spark, sf):
    return cl.drop_sparse_columns(fx.flows(spark, sf).drop("flow_rate", "service"), 0.5)


@query
def drop_low_variance(spark, sf):
    return cl.drop_low_variance(fx.flows(spark, sf).drop("flow_rate", "sparse_col", "service"), 0.01)


@query
def clean_names(spark, sf):
    """Columns with the odd names of the raw files, after both cleanings."""
    raw = fx.flows(spark, sf).select(
        F.col("pkts").alias(" Total Fwd Packets"), F.col("bytes").alias("Flow Bytes/s"),
        F.col("jitter").alias("Fwd Header Length.1"), F.col("label").alias(" Label"))
    batch = co.clean_names_batch(raw)
    stream = co.clean_names_stream(raw)
    return batch.groupBy(*batch.columns[:1]).agg(
        F.max("flow_bytes_s").alias("flow_bytes_s"), F.max("fwd_header_length_1").alias("fwd_header_length_1")
    ).withColumn("stream_names", F.lit(",".join(stream.columns)))


# Labels and weights ------------------------------------------------------

@query
def standardize_label(spark, sf):
    return la.standardize_label(fx.flows(spark, sf)).groupBy("label").agg(F.count(F.lit(1)).alias("count"))


@query
def binary_label(spark, sf):
    labelled = la.add_binary_label(la.standardize_label(fx.flows(spark, sf)))
    return labelled.select(*KEY, "label", "binary_label")


@query
def label_text(spark, sf):
    rows = fx.flows(spark, sf).select(
        *KEY, F.when(F.col("label") == "BENIGN", 0).otherwise(1).alias("label"), F.col("service").alias("attack_cat"))
    return la.add_label_text(rows)


@query
def normalize_attack_cat(spark, sf):
    rows = fx.flows(spark, sf).select(*KEY, F.concat(F.lit(" "), "service", F.lit(" ")).alias("attack_cat"))
    return la.normalize_attack_cat(rows).groupBy("attack_cat").agg(F.count(F.lit(1)).alias("count"))


@query
def map_labels(spark, sf):
    rows = la.map_labels(fx.flows(spark, sf), "cicids2017")
    return la.map_labels(rows, "cicids2018", output="label_2018").select(*KEY, "label", "unified_label", "label_2018")


@query
def prepare_unsw_labels(spark, sf):
    rows = fx.alerts(spark, sf).select("event_id", F.nullif("attack_type", F.lit("DoS")).alias("attack_cat"))
    return la.prepare_unsw_labels(rows)


def _weights(spark, sf, scheme):
    return rounded(la.class_weights(la.standardize_label(fx.flows(spark, sf)), scheme=scheme), "weight")


@query
def class_weights_inverse(spark, sf):
    return _weights(spark, sf, "inverse")


@query
def class_weights_sqrt(spark, sf):
    return _weights(spark, sf, "sqrt")


@query
def class_weights_sqrt2(spark, sf):
    return _weights(spark, sf, "sqrt2")


@query
def attach_weights(spark, sf):
    rows = la.standardize_label(fx.flows(spark, sf)).select(*KEY, "label")
    weights = la.class_weights(rows).where(F.col("label") != "bot")
    plain = la.attach_weights(rows, weights)
    return rounded(la.attach_weights(plain, weights, output="strict_weight", default=None),
                   "sample_weight", "strict_weight")


@query
def harmonize(spark, sf):
    merged = la.harmonize(fx.flow_pair(spark, sf))
    return rounded(merged.select(*KEY, "label", "unified_label", "dataset_source", "multiclass_weight"),
                   "multiclass_weight")


@query
def harmonized_metadata(spark, sf):
    merged = la.harmonize(fx.flow_pair(spark, sf))
    found = agg.harmonized_metadata(merged, CLASS_NAMES["cic_unified"])
    return rounded(found.select(
        "unified_label", "class_name", "class_rows", "weight",
        *[F.coalesce(F.try_element_at("rows_by_source", F.lit(n)), F.lit(0)).alias(f"rows_{n}")
          for n in ("cicids2017", "cicids2018")]), "weight")


@query
def counts_by_source(spark, sf):
    return agg.counts_by_source(la.union_harmonized(fx.flow_pair(spark, sf)))


@query
def union_flows(spark, sf):
    """One dataset lacks a column: it is filled with nulls."""
    pair = fx.flow_pair(spark, sf)
    return fl.union_flows(list(pair.values()), drop=["service"], on_mismatch="null").select(
        *KEY, "jitter", "sparse_col", "label")


# Aggregates --------------------------------------------------------------

@query
def class_distribution(spark, sf):
    return rounded(agg.class_distribution(fx.flows(spark, sf)), "percent")


@query
def distribution_2d(spark, sf):
    return agg.distribution_2d(fx.flows(spark, sf), "label", "proto")


@query
def distribution_matrix(spark, sf):
    return agg.distribution_matrix(fx.flows(spark, sf), "label", "proto", ["F", "O"])


@query
def column_summary(spark, sf):
    return rounded(agg.column_summary(fx.flows(spark, sf), "bytes"), "mean", "stddev", "q25", "q50", "q75", digits=4)


@query
def column_summary_tied(spark, sf):
    """Quartiles of a column with few distinct values."""
    return rounded(agg.column_summary(fx.flows(spark, sf), "jitter"), "mean", "stddev", "q25", "q50", "q75")


@query
def dataset_summary(spark, sf):
    return agg.dataset_summary(fx.flows(spark, sf), "flows")


@query
def dataset_metadata(spark, sf):
    rows = la.standardize_label(fx.flows(spark, sf))
    return rounded(agg.dataset_metadata(rows, la.class_weights(rows), fx.FLOW_FEATURES), "weight")


@query
def distinct_labels(spark, sf):
    return agg.distinct_labels(la.standardize_label(fx.flows(spark, sf)))


# Features and splits -----------------------------------------------------

@query
def index_categories(spark, sf):
    return fe.index_categories(fx.flows(spark, sf), ["proto", "service"]).select(
        *KEY, "proto", "service", "proto_indexed", "service_indexed")


@query
def standardize_features(spark, sf):
    rows = fe.standardize(cl.mask_numeric(fx.flows(spark, sf), policy="zero"), ["flow_rate", "bytes", "jitter", "const_col"])
    z = vector_to_array("scaled_features")
    return rows.select(*KEY, *[F.round(z[i], 6).alias(f"z{i}") for i in range(4)])


@query
def assemble_features(spark, sf):
    """Rows with null or NaN are skipped; infinities stay."""
    rows = fe.assemble(fx.flows(spark, sf), ["pkts", "flow_rate", "bytes"])
    v = vector_to_array("features")
    return rows.select(*KEY, *[v[i].alias(f"f{i}") for i in range(3)])


@query
def feature_columns(spark, sf):
    rows = fx.flows(spark, sf)
    return rows.agg(F.count(F.lit(1)).alias("rows")).withColumn("features", F.lit(",".join(co.feature_columns(rows))))


def _sides(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query
def hash_split(spark, sf):
    return _sides(*sp.hash_split(fx.flows(spark, sf).select(*KEY, "label"), KEY))


@query
def stratified_split(spark, sf):
    return _sides(*sp.stratified_split(fx.flows(spark, sf).select(*KEY, "label"), "label", KEY, 0.8))


@query
def hash_sample(spark, sf):
    return sp.hash_sample(fx.flows(spark, sf).select(*KEY, "label"), KEY, 0.15)


def _lacking_split(spark, sf):
    train, test = sp.hash_split(fx.flows(spark, sf).select(*KEY, "label"), KEY)
    return train.where(F.col("label") != " Bot"), test


@query
def missing_classes(spark, sf):
    return sp.missing_classes(*_lacking_split(spark, sf))


@query
def rebalance_missing(spark, sf):
    return _sides(*sp.rebalance_missing(*_lacking_split(spark, sf), KEY))


@query
def shuffled_head(spark, sf):
    """The same rows whatever the partitioning; only their number is checked by SQL."""
    rows = fl.shuffled_head(fx.flows(spark, sf).select(*KEY, "label"), KEY, 500)
    return rows.agg(F.count(F.lit(1)).alias("rows"))


# Messages, files ---------------------------------------------------------

@query
def flows_to_json(spark, sf):
    """Messages of all flows, parsed back."""
    rows = fx.flows(spark, sf).select(*KEY, "flow_rate", "sparse_col", "service", "label")
    messages = fl.flows_to_json(rows, "service", producer_id=7, clock=F.lit(NOW))
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in (*KEY, "flow_rate", "sparse_col")]
                          + [T.StructField(c, T.StringType()) for c in ("service", "label")]
                          + [T.StructField("producer_id", T.IntegerType())])
    return me.parse_flow_json(messages, schema)


def _props_messages(spark, sf):
    """Event properties as messages; those of error events lost their first character."""
    broken = F.col("event_type") == "error"
    return fx.table(spark, sf, "events").select(
        "event_id", F.when(broken, F.expr("substring(props, 2)")).otherwise(F.col("props")).alias("value"))


PROPS = T.StructType([T.StructField("k", T.DoubleType())])


@query
def parse_flow_json(spark, sf):
    return me.parse_flow_json(_props_messages(spark, sf), PROPS).select("event_id", "k")


@query
def rejected_flow_json(spark, sf):
    return me.rejected_flow_json(_props_messages(spark, sf), PROPS)


@query
def read_flow_csv(spark, sf):
    """All flows written as two CSV files sets with different headers and read back by name."""
    folder = st.scratch_path(spark, "csv")
    rows = fx.flows(spark, sf)
    rows.where("proto = 'F'").write.option("header", True).csv(f"{folder}/a")
    rows.where("proto = 'O'").select(*reversed(rows.columns)).drop("jitter").write.option("header", True).csv(f"{folder}/b")
    found = fl.read_flow_csv(spark, [f"{folder}/a", f"{folder}/b", f"{folder}/absent"], rows.schema, drop=["const_col"])
    return found.select(*KEY, "flow_rate", "bytes", "jitter", "proto", "service")


@query
def read_flow_csv_headerless(spark, sf):
    """All flows as headerless files in the 49-column raw layout, read back by position."""
    folder = st.scratch_path(spark, "csv")
    rows = fx.flows(spark, sf)
    filled = {"sport": "l_orderkey", "dsport": "l_partkey", "dur": "bytes", "sbytes": "l_suppkey",
              "spkts": "pkts", "service": "service", "attack_cat": "label"}
    schema = csv_schema("unsw_raw")
    rows.select(*[(F.col(filled[f.name]) if f.name in filled else F.lit(0)).cast("string").alias(f.name)
                  for f in schema.fields]).write.csv(folder)
    return fl.read_flow_csv(spark, folder, schema, header=False).select(
        "sport", "dsport", "dur", "sbytes", "spkts", "service", "label")


@query
def verify_written(spark, sf):
    path = st.scratch_path(spark, "flows")
    rows = fx.flows(spark, sf)
    fl.write_processed(rows, path)
    return fl.verify_written(spark, path, rows.count())


# Evaluation --------------------------------------------------------------

@query
def confusion(spark, sf):
    return ev.confusion(fx.predictions(spark, sf))


@query
def confusion_normalized(spark, sf):
    return rounded(ev.confusion_normalized(fx.predictions(spark, sf)), "share")


@query
def per_class_accuracy(spark, sf):
    return ev.per_class_accuracy(fx.predictions(spark, sf))


@query
def classification_report(spark, sf):
    return rounded(ev.classification_report(fx.predictions(spark, sf)), "precision", "recall", "f1")


@query
def multiclass_metrics(spark, sf):
    metrics = ev.multiclass_metrics(fx.predictions(spark, sf))
    return rounded(metrics, *metrics.columns)


@query
def auc_roc(spark, sf):
    return rounded(ev.auc_roc(fx.predictions(spark, sf), "binary_label"), "auc_roc")


@query
def auc_pr(spark, sf):
    return rounded(ev.auc_pr(fx.predictions(spark, sf), "binary_label"), "auc_pr")


@query
def prediction_distribution(spark, sf):
    return agg.prediction_distribution(fx.predictions(spark, sf), label="label")


# Models (no SQL twin) ----------------------------------------------------

def training_rows(spark, sf):
    """Embeddings as features. The table's own labels are unrelated to them, so the class is
    the position of the largest of the first ten dimensions; class 0 is normal traffic."""
    first = F.slice("embedding", 1, 10)
    rows = fx.table(spark, sf, "embeddings").select(
        "vec_id", "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"),
        (F.array_position(first, F.array_max(first)) - 1).cast("double").alias("unified_label"))
    rows = rows.withColumn("binary_label", F.when(F.col("unified_label") == 0, 0.0).otherwise(1.0))
    weighted = la.attach_weights(rows, la.class_weights(rows, "binary_label", "sqrt2"), "binary_label")
    weighted = la.attach_weights(weighted, la.class_weights(rows, "unified_label", "sqrt"), "unified_label",
                                 "multiclass_weight")
    return sp.hash_split(weighted, ["vec_id"])


SMALL_FOREST = {"numTrees": 20, "maxDepth": 5}
SMALL_BOOST = {"maxIter": 5, "maxDepth": 3}


@query
def train_lr(spark, sf):
    train, test = training_rows(spark, sf)
    return mo.evaluate(mo.train_lr(train, "vector"), test, "binary_label")


@query
def train_rf_binary(spark, sf):
    train, test = training_rows(spark, sf)
    return mo.evaluate(mo.train_rf_binary(train, "vector", **SMALL_FOREST), test, "binary_label")


@query
def train_gbt_binary(spark, sf):
    train, test = training_rows(spark, sf)
    return mo.evaluate(mo.train_gbt_binary(train, "vector", **SMALL_BOOST), test, "binary_label")


@query
def train_rf_multiclass(spark, sf):
    train, test = training_rows(spark, sf)
    model = mo.train_rf_multiclass(train, "vector", **SMALL_FOREST)
    return mo.evaluate(model, test, "unified_label", binary=False)


@query
def compare_weighted(spark, sf):
    train, test = training_rows(spark, sf)
    return mo.compare_weighted(train, test, "vector", maxIter=20)


@query
def feature_importance(spark, sf):
    train, _ = training_rows(spark, sf)
    return mo.feature_importance(spark, mo.train_rf_binary(train, "vector", **SMALL_FOREST), k=20)


@query
def model_comparison(spark, sf):
    train, test = training_rows(spark, sf)
    results = {"rf": mo.train_rf_binary(train, "vector", **SMALL_FOREST),
               "gbt": mo.train_gbt_binary(train, "vector", **SMALL_BOOST)}
    rows = {name: mo.evaluate(model, test, "binary_label") for name, model in results.items()}
    return mo.model_comparison(mo.results_table(spark, rows, train.count(), test.count()))


@query
def train_suite(spark, sf):
    """The models UNSW flows are served with, trained, saved and evaluated."""
    category = attack_type(F.col("unified_label"), CLASS_NAMES["unsw"])
    train, test = (rows.withColumn("attack_cat", category) for rows in _unsw_rows(spark, sf))
    train, test = tr.unsw_training_rows(train.where("attack_cat <> 'Generic'"), test, ["vec_id"])
    return tr.train_suite(train, test, UNSW_FEATURES, "unsw", st.scratch_path(spark, "models"), {
        "unsw_rf_binary": SMALL_FOREST, "unsw_gbt_binary": SMALL_BOOST, "unsw_multiclass": SMALL_FOREST})


# Pipelines and streams ---------------------------------------------------

FLOW_RECIPE = pp.Recipe("flows", drop=("l_orderkey", "l_partkey", "l_suppkey"), categories=("proto", "service"))
MEAN_RECIPE = pp.Recipe("flows_mean", drop=FLOW_RECIPE.drop, categories=FLOW_RECIPE.categories,
                        replace_categories=True, exact_normal="BENIGN", weight_on="binary_label",
                        imputation="mean", sparse_threshold=None)


def _prepared_columns(prepared: pp.Prepared, *others: str) -> DataFrame:
    """The prepared table with its scaled vector as plain columns."""
    z = vector_to_array("scaled_features")
    return prepared.table.select(
        *[F.round(c, 6).alias(c) for c in prepared.features], "label", "binary_label", *others,
        F.round("sample_weight", 6).alias("sample_weight"),
        *[F.round(z[i], 6).alias(f"z_{name}") for i, name in enumerate(prepared.features)])


@query
def preprocess(spark, sf):
    """The whole preprocessing of flows that all occur twice."""
    return _prepared_columns(pp.preprocess(doubled_flows(spark, sf), FLOW_RECIPE), "proto_indexed", "service_indexed")


@query
def preprocess_mean(spark, sf):
    """The variant that fills with means, indexes in place and weights attack against normal."""
    return _prepared_columns(pp.preprocess(doubled_flows(spark, sf), MEAN_RECIPE))


def _replay(spark, messages: DataFrame, files: int | None = None) -> DataFrame:
    """Messages written as JSON lines and read again as a stream; ``files`` spreads them over so many
    files without regard to time, each a micro-batch."""
    folder = st.scratch_path(spark, "messages")
    values = messages.select("value")
    (values if files is None else values.repartition(files, F.xxhash64("value"))).write.text(folder)
    return ss.read_flow_stream_files(spark, folder, None if files is None else 1)


PREDICTION_MESSAGE = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in
     ("event_id", "binary_prediction", "multiclass_prediction", "prediction_score")]
    + [T.StructField("processed_at", T.TimestampType()), T.StructField("source_ip", T.StringType())])


def _prediction_bodies(scored, *others: str):
    body = F.to_json(F.struct(*[F.col(f.name).cast("timestamp").alias(f.name) if f.name == "processed_at"
                                else F.col(f.name) for f in PREDICTION_MESSAGE.fields]))
    return scored.select(*others, body.alias("value"))


def _replayed_predictions(spark, sf, files: int | None = None):
    stream = _replay(spark, _prediction_bodies(fx.scored_flows(spark, sf)), files)
    parsed = me.parse_flow_json(stream, PREDICTION_MESSAGE)
    return sc.enrich(sc.cascade_predictions(parsed), "unsw", clock=F.col("processed_at"))


@query
def stream_alerts(spark, sf):
    """All events replayed as a stream into the alert table, which is then read."""
    path = st.scratch_path(spark, "alerts")
    query_ = de.write_alert_stream(_replayed_predictions(spark, sf), path, "replay",
                                   st.scratch_path(spark, "checkpoint"), every=None)
    query_.awaitTermination()
    return at.read_alerts(spark, path).select(
        F.col("event_id").cast("bigint").alias("event_id"), "attack_type", "severity", "source_ip", "session_id",
        "alert_date")


@query
def stream_timeline(spark, sf):
    """Hourly bins after a replay in several micro-batches that are out of order."""
    enriched = _replayed_predictions(spark, sf, 4)
    path = st.scratch_path(spark, "timeline")
    de.write_timeline(enriched, path, st.scratch_path(spark, "checkpoint"), column="processed_at",
                      every=None).awaitTermination()
    return de.read_timeline(spark, path).select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "count", "high_severity_count")


@query
def stream_rejects(spark, sf):
    """Messages that a running detection can't parse: all events' properties hold none of its fields."""
    path = st.scratch_path(spark, "rejects")
    messages = fx.table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", F.to_json(F.struct(F.col("event_id").cast("double").alias("id"))))
        .otherwise(F.col("props")).alias("value"))
    de.write_rejects(_replay(spark, messages, 3), "unsw", path, st.scratch_path(spark, "checkpoint"),
                     every=None).awaitTermination()
    return spark.read.parquet(path).groupBy("value").agg(F.count(F.lit(1)).alias("messages"))


@query
def stream_timeline_updates(spark, sf):
    """Hourly bins kept in one row each, after a replay in several micro-batches that are out of order."""
    enriched = _replayed_predictions(spark, sf, 4)
    path = st.scratch_path(spark, "timeline")
    de.write_timeline_updates(enriched, path, st.scratch_path(spark, "checkpoint"), column="processed_at",
                              every=None).awaitTermination()
    return de.read_timeline_updates(spark, path).select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "count", "high_severity_count")


@query
def stream_redelivered(spark, sf):
    """All events as messages, a third of them delivered again, half before and half after a restart; each alert is
    stored once."""
    folder, path, checkpoint = (st.scratch_path(spark, n) for n in ("messages", "alerts", "checkpoint"))
    bodies = _prediction_bodies(fx.scored_flows(spark, sf), "event_id")
    for again in (F.col("event_id") % 6 == 0, F.col("event_id") % 6 == 3):
        first = F.col("event_id") % 2 == 0 if not st.exists(spark, folder) else F.col("event_id") % 2 == 1
        sent = bodies.where(first).withColumn("again", F.lit(0)).unionByName(
            bodies.where(again).withColumn("again", F.lit(1)))
        sent.repartition(2, F.xxhash64("value", "again")).select("value").write.mode("append").text(folder)
        parsed = me.parse_flow_json(ss.read_flow_stream_files(spark, folder, 1), PREDICTION_MESSAGE)
        once = de.drop_redelivered(parsed, ["event_id"], "kafka_timestamp")
        scored = sc.enrich(sc.cascade_predictions(once), "unsw", clock=F.col("processed_at"))
        de.write_alert_stream(scored, path, "replay", checkpoint, every=None).awaitTermination()
    return at.read_alerts(spark, path).select(
        F.col("event_id").cast("bigint").alias("event_id"), "attack_type", "severity", "source_ip", "session_id",
        "alert_date")


@query
def stream_accounting(spark, sf):
    """Messages of a run by batch: sent, parsed and rejected, their sums, and whether each batch adds up. Those of
    error events are broken. No model is given, so nothing is an attack."""
    checkpoint = st.scratch_path(spark, "checkpoint")
    broken = F.col("event_type") == "error"
    value = F.to_json(F.struct(F.col("event_id").cast("double").alias("id"), F.col("value").alias("dur")))
    messages = fx.table(spark, sf, "events").select(F.when(broken, F.substring(value, 2, 9)).otherwise(value).alias("value"))
    de.run_detection(spark, _replay(spark, messages, 3), "unsw", sc.Detector(), [], "replay", checkpoint=checkpoint,
                     every=None)
    found = de.read_accounts(spark, f"{checkpoint}-accounts")
    stored = de.read_rejects(spark, f"{checkpoint}-rejects").groupBy("batch_id").agg(F.count(F.lit(1)).alias("stored"))
    return found.join(stored, "batch_id", "left").agg(
        F.sum("sent").alias("sent"), F.sum("parsed").alias("parsed"), F.sum("rejected").alias("rejected"),
        F.sum("attacks").alias("attacks"), F.sum("stored").alias("stored"),
        F.bool_and((F.col("sent") == F.col("parsed") + F.col("rejected"))
                   & (F.col("rejected") == F.coalesce("stored", F.lit(0)))).alias("adds_up"))


@query
def read_alerts_mixed_columns(spark, sf):
    """Two batches, of which the later has no source_ip; the column stays."""
    path = st.scratch_path(spark, "alerts")
    rows = fx.alerts(spark, sf).where("is_attack").drop("alert_date", "batch_id")
    early = F.col("processed_at") < F.lit(datetime(2024, 1, 15))
    at.write_alert_table(rows.where(early), path, 0)
    at.write_alert_table(rows.where(~early).drop("source_ip"), path, 1)
    return at.read_alerts(spark, path).select("event_id", "attack_type", "source_ip")


def _csv_rows(spark, sf):
    return fx.flows(spark, sf).select(*KEY, "bytes", "jitter", "service")


@query
def read_flow_csv_unknown_columns(spark, sf):
    """Numeric and text columns that no schema lists keep their values and get their types."""
    folder = st.scratch_path(spark, "csv")
    _csv_rows(spark, sf).withColumnRenamed("bytes", "Tot Bytes").write.option("header", True).csv(folder)
    found = fl.read_flow_csv(spark, folder, T.StructType([T.StructField("pkts", T.IntegerType())]))
    kinds = dict(found.dtypes)
    return found.select(*[F.col(k).cast("bigint").alias(k) for k in KEY], F.col("Tot Bytes").alias("tot_bytes"), "service",
                        F.lit(",".join(kinds[c] for c in ("pkts", "Tot Bytes", "service"))).alias("kinds"))


@query
def read_flow_csv_exact_types(spark, sf):
    """Long ids and codes with leading zeros that no schema lists come back as they were written."""
    folder = st.scratch_path(spark, "csv")
    rows = fx.flows(spark, sf).select(*KEY, (F.lit(1700000000123456789) + F.col("l_orderkey")).alias("flow_id"),
                                      F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("code"), "flow_rate")
    rows.write.option("header", True).csv(folder)
    found = fl.read_flow_csv(spark, folder, T.StructType([]))
    kinds = dict(found.dtypes)
    return found.select(*KEY, "flow_id", "code", "flow_rate",
                        F.lit(",".join(kinds[c] for c in ("flow_id", "code", "flow_rate"))).alias("kinds"))


@query
def read_flow_csv_rejects(spark, sf):
    """Lines with a word in a number's place, a value too many or too few are set apart, the others kept."""
    folder = st.scratch_path(spark, "csv")
    turn = F.col("l_orderkey") % 40
    values = [F.when(turn == 0, "xx").otherwise(F.col("l_partkey").cast("string")), F.col("l_suppkey").cast("string")]
    line = F.concat_ws(",", F.col("l_orderkey").cast("string"), *values, F.col("pkts").cast("string"))
    line = F.when(turn == 1, F.concat(line, F.lit(",7"))).when(turn == 2, F.substring_index(line, ",", 3)).otherwise(line)
    fx.flows(spark, sf).select(line.alias("value")).write.text(folder)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in KEY])
    kept, rejects = fl.read_flow_csv_checked(spark, folder, schema, header=False)
    return kept.select(F.lit("kept").alias("side"), F.concat_ws(",", *KEY).alias("line")).union(
        rejects.select(F.lit("rejected"), "line")).groupBy("side", "line").agg(F.count("*").alias("lines"))


@query
def read_flow_csv_duplicate_headers(spark, sf):
    """A header that comes twice: the second becomes ``.1``."""
    folder = st.scratch_path(spark, "csv")
    rows = _csv_rows(spark, sf)
    lines = F.concat_ws(",", *[F.col(c).cast("string") for c in KEY], F.col("bytes").cast("string"),
                        F.col("jitter").cast("string"))
    # Every task writes the header and its lines: a writer of columns refuses equal names, one of whole lines doesn't see them.
    rows.select(lines.alias(",".join([*KEY, "Load", "Load"]))).write.options(header=True, sep="\t").csv(f"{folder}/whole")
    found = fl.read_flow_csv(spark, f"{folder}/whole", T.StructType([]))
    return found.select(*[F.col(k).cast("bigint").alias(k) for k in KEY], F.col("Load").alias("load_0"),
                        F.col("`Load.1`").alias("load_1"))


@query
def read_flow_csv_mixed_folder(spark, sf):
    """Files of one folder with their columns in another order."""
    folder = st.scratch_path(spark, "csv")
    rows = _csv_rows(spark, sf)
    rows.where("l_orderkey % 2 = 0").write.option("header", True).csv(f"{folder}/all/a")
    rows.where("l_orderkey % 2 = 1").select(*reversed(rows.columns)).write.option("header", True).csv(f"{folder}/all/b")
    return fl.read_flow_csv(spark, f"{folder}/all", rows.schema).select(*rows.columns)


@query
def rebalance_small_fraction(spark, sf):
    return _sides(*sp.rebalance_missing(*_lacking_split(spark, sf), KEY, fraction=0.004))


def _unsw_rows(spark, sf):
    """Embeddings under the names of the UNSW features."""
    train, test = training_rows(spark, sf)

    def named(rows):
        return rows.select("*", F.col("vec_id").cast("double").alias("id"),
                           *[F.col("embedding")[i].cast("double").alias(name) for i, name in enumerate(UNSW_FEATURES)])
    return named(train), named(test)


def unsw_detector(spark, sf) -> sc.Detector:
    train, _ = _unsw_rows(spark, sf)
    binary = mo.train_gbt_binary(train, UNSW_FEATURES, prefix=sc.BINARY, **SMALL_BOOST)
    multiclass = mo.train_rf_multiclass(train, UNSW_FEATURES, prefix=sc.MULTI, **SMALL_FOREST)
    return sc.Detector(binary, multiclass)


@query
def stream_detect(spark, sf):
    """Held-out rows replayed as JSON through both models of the cascade."""
    _, test = _unsw_rows(spark, sf)
    messages = fl.flows_to_json(test.select("id", *UNSW_FEATURES), producer_id=1)
    path, log = st.scratch_path(spark, "alerts"), st.scratch_path(spark, "sessions")
    de.run_detection(spark, _replay(spark, messages), "unsw", unsw_detector(spark, sf),
                     [de.alert_sink(path, "live")], "live", log, every=None)
    found = at.read_alerts(spark, path)
    return al.top_attacks(found, "24h", 20).select("attack_type", "count", "high", "medium", "low")


@query
def batch_detect(spark, sf):
    """The same rows and models as a batch job."""
    _, test = _unsw_rows(spark, sf)
    messages = fl.flows_to_json(test.select("id", *UNSW_FEATURES), producer_id=1)
    found = de.detect(messages, "unsw", unsw_detector(spark, sf)).where("is_attack")
    return al.top_attacks(found, "24h", 20).select("attack_type", "count", "high", "medium", "low")


__all__ = ["QUERIES", "NOW"]
