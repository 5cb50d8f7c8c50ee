"""Flow, alert and prediction tables derived from the generic test tables.

The rules give every class, severity, dirty value and duplicate the operators have
to deal with; each table has as many rows as the table it comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.functions.labels import class_lookup
from flowlens.operators.scoring import cascade_predictions, enrich
from flowlens.schemas import UNIFIED_LABELS_2017

FLOW_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "pkts"]
FLOW_FEATURES = ["pkts", "flow_rate", "bytes", "jitter"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(column: Column, cases: dict, other) -> Column:
    return F.coalesce(*[F.when(column == value, result) for value, result in cases.items()], F.lit(other))


def scored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored flow per event: a binary prediction, a class and a score."""
    events = table(spark, sf_dir, "events")
    kinds = {"view": 0.0, "signup": 1.0, "error": 3.0, "purchase": 4.0}
    user = F.col("user_id")
    return events.select(
        "event_id", F.col("ts").alias("processed_at"),
        F.concat(F.lit("10.0.0."), user.cast("string")).alias("source_ip"),
        F.concat(F.lit("sess"), (user % 10).cast("string")).alias("session_id"),
        F.when(F.col("value") < 10, 0.0).otherwise(1.0).alias("binary_prediction"),
        _choose(F.col("event_type"), kinds, 7.0).alias("multiclass_prediction"),
        (F.col("value") / 500).alias("prediction_score"),
    )


def _enriched(scored: DataFrame) -> DataFrame:
    return enrich(scored, "unsw", clock=F.col("processed_at"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored flows after the cascade, attacks and others."""
    return _enriched(cascade_predictions(scored_flows(spark, sf_dir)))


def parallel_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with both stages independent."""
    return _enriched(scored_flows(spark, sf_dir))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw flows with non-finite values, gaps, a constant column and padded labels."""
    part = F.col("l_partkey")
    rate = (F.when(part % 83 == 0, F.lit(float("nan"))).when(part % 89 == 0, F.lit(float("inf")))
            .when(part % 91 == 0, F.lit(float("-inf"))).when(part % 97 == 0, F.lit(None))
            .otherwise(F.col("l_quantity")))
    label = (F.when(part % 100 == 0, " Bot").when(part % 100 < 6, "PortScan")
             .when(part % 100 < 16, "DDoS").otherwise("BENIGN"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").alias("pkts"), rate.alias("flow_rate"),
        F.col("l_extendedprice").alias("bytes"), F.col("l_discount").alias("jitter"), F.lit(5.0).alias("const_col"),
        F.when(part % 3 == 0, F.col("l_tax")).alias("sparse_col"), F.col("l_linestatus").alias("proto"),
        F.when(part % 7 != 0, F.col("l_returnflag")).alias("service"), label.alias("label"))


def flow_pair(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two datasets whose schemas differ by one column each, together all flows."""
    everything = flows(spark, sf_dir)
    return {
        "cicids2017": everything.where(F.col("proto") == "F").drop("jitter"),
        "cicids2018": everything.where(F.col("proto") != "F").drop("sparse_col"),
    }


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and binary predictions for every flow, right for most; class 1 is predicted
    but never true, and scores repeat across rows."""
    rows = flows(spark, sf_dir)
    label = class_lookup(F.col("label"), UNIFIED_LABELS_2017, 8).cast("double")
    supplier = F.col("l_suppkey")
    guess = F.when(supplier % 7 == 0, 0.0).when(supplier % 11 == 0, 1.0).otherwise(F.col("label"))
    score = F.col("bytes") / 100000 + F.when(F.col("label") > 0, 0.2).otherwise(0.0) - F.col("jitter")
    return (rows.select(*FLOW_KEY, "bytes", "jitter", label.alias("label"))
            .select(*FLOW_KEY, "label", guess.alias("prediction"), score.alias("score"),
                    F.when(F.col("label") > 0, 1.0).otherwise(0.0).alias("binary_label")))


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered at a session's first alert; those of even number end at their last."""
    spans = alerts(spark, sf_dir).groupBy("session_id").agg(
        F.min("processed_at").alias("first"), F.max("processed_at").alias("last"))
    ends = F.col("session_id").substr(5, 10).cast("int") % 2 == 0
    events = F.array_compact(F.array(
        F.struct(F.lit("registered").alias("event"), F.col("first").alias("event_at")),
        F.when(ends, F.struct(F.lit("ended").alias("event"), F.col("last").alias("event_at")))))
    return spans.select("session_id", F.explode(events).alias("e")).select(
        "session_id", "e.event", "e.event_at",
        F.create_map(F.lit("data_source"), F.lit("unsw")).alias("metadata"))
