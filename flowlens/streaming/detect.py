"""Streaming detection: one plan from message to alert, several sinks behind it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.operators.alerts import BIN_ORIGIN
from flowlens.operators.cleaning import mask_numeric
from flowlens.operators.columns import clean_names_stream, stream_name
from flowlens.operators.scoring import Detector, score_and_enrich
from flowlens.schemas import ALERT_SEVERITIES, CIC_FEATURES, UNSW_FEATURES, stream_schema
from flowlens.sources import alert_counts, alert_table
from flowlens.sources.storage import exists, scratch_path
from flowlens.streaming.messages import (
    accepted_flows, is_accepted, parse_flow_json, rejected_flow_json, rejected_messages, route_flow_json)

EVENT_TIME = "kafka_timestamp"
WATERMARK = "30 seconds"
ALERT_TRIGGER, CONSOLE_TRIGGER = "3 seconds", "2 seconds"
CONSOLE_COLUMNS = ["is_attack", "attack_type", "severity", "processed_at"]

BatchSink = Callable[[DataFrame, int], None]


def stream_features(source: str) -> list[str]:
    names = UNSW_FEATURES if source == "unsw" else CIC_FEATURES
    return [stream_name(n) for n in names]


def watermark(df: DataFrame, column: str = EVENT_TIME, delay: str = WATERMARK) -> DataFrame:
    """Bounds the state of time windows that follow; without one it changes nothing."""
    return df.withWatermark(column, delay)


def prepare_features(df: DataFrame, source: str) -> DataFrame:
    """Model column names, and 0 for null, NaN and infinite features."""
    renamed = clean_names_stream(df)
    return mask_numeric(renamed, [c for c in stream_features(source) if c in renamed.columns], "zero")


def detect(messages: DataFrame, source: str, detector: Detector, delay: str | None = WATERMARK,
           clock: Column | None = None) -> DataFrame:
    """Scored and enriched flows of a message frame, batch or streaming."""
    parsed = parse_flow_json(messages, stream_schema(source))
    if delay is not None and parsed.isStreaming:
        parsed = watermark(parsed, delay=delay)
    return score_and_enrich(prepare_features(parsed, source), detector, clock)


# Sinks -------------------------------------------------------------------

def alert_sink(path: str, session_id: str, clock: Column | None = None, severities=ALERT_SEVERITIES,
               counts: str | None = None) -> BatchSink:
    """Store the alerts of each micro-batch in the alert table, and their counts where ``counts`` names a folder.
    A severity policy with levels of its own names them in ``severities``. Only the first batch of a run, or one after a failure,
    can have been tried before."""
    begun, done = -1, -2

    def write(batch: DataFrame, batch_id: int) -> None:
        nonlocal begun, done
        fresh = begun == done and batch_id > done
        begun = batch_id
        if counts is None:
            alert_table.write_alert_batch(batch, path, session_id, batch_id, clock, severities, replayed=not fresh)
        else:
            alert_counts.write_counted_batch(batch, path, counts, session_id, batch_id, clock, severities, not fresh)
        done = batch_id
    return write


def alert_messages(df: DataFrame) -> DataFrame:
    """Attacks as the JSON of an alert topic."""
    fields = [EVENT_TIME, "is_attack", "attack_type", "severity", "processed_at"]
    return df.where("is_attack").select(F.to_json(F.struct(*fields)).alias("value"))


def kafka_alert_sink(servers: str, topic: str) -> BatchSink:
    """Publish the alerts of each micro-batch. Needs the Kafka connector."""
    def write(batch: DataFrame, batch_id: int) -> None:
        alert_messages(batch).write.format("kafka").option("kafka.bootstrap.servers", servers).option(
            "topic", topic).save()
    return write


def console_sink(rows: int = 20) -> BatchSink:
    def write(batch: DataFrame, batch_id: int) -> None:
        shown = [c for c in CONSOLE_COLUMNS if c in batch.columns]
        batch.select(*shown).show(rows, truncate=False)
    return write


def fan_out(sinks: list[BatchSink]) -> BatchSink:
    """Give one scored batch to every sink; it is scored once. A failing sink fails the batch,
    which the stream then repeats."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if len(sinks) == 1:
            sinks[0](batch, batch_id)
            return
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()
    return write


def _trigger(every: str | None) -> dict:
    return {"availableNow": True} if every is None else {"processingTime": every}


def start_sinks(df: DataFrame, sinks: list[BatchSink], checkpoint: str,
                every: str | None = ALERT_TRIGGER) -> StreamingQuery:
    """One streaming query for all sinks. ``every=None`` drains the source and stops."""
    return (df.writeStream.foreachBatch(fan_out(sinks)).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start())


def write_console(df: DataFrame, every: str | None = CONSOLE_TRIGGER, checkpoint: str | None = None) -> StreamingQuery:
    """Spark's console sink with the display columns."""
    shown = [c for c in CONSOLE_COLUMNS if c in df.columns]
    writer = df.select(*shown).writeStream.outputMode("append").format("console").option(
        "truncate", "false").option("numRows", "20")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**_trigger(every)).start()


def write_alert_stream(df: DataFrame, path: str, session_id: str, checkpoint: str,
                       every: str | None = ALERT_TRIGGER, clock: Column | None = None) -> StreamingQuery:
    return start_sinks(df, [alert_sink(path, session_id, clock)], checkpoint, every)


def write_alert_stream_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str,
                             every: str | None = ALERT_TRIGGER) -> StreamingQuery:
    """Alerts to a topic. Needs the Kafka connector."""
    return (alert_messages(df).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("topic", topic).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start())


# Timeline ----------------------------------------------------------------

def stream_timeline(alerts: DataFrame, interval_minutes: int = 60, column: str = EVENT_TIME,
                    delay: str = WATERMARK) -> DataFrame:
    """Alert counts per fixed-width bin, kept up to date as alerts arrive.

    The watermark closes a bin and frees its state; later alerts for it are dropped, and open bins
    are not given out in append mode. ``write_timeline`` and ``read_timeline`` lose neither.
    """
    return _binned(watermark(alerts, column, delay), interval_minutes, column)


def _binned(alerts: DataFrame, interval_minutes: int, column: str) -> DataFrame:
    offset = int(BIN_ORIGIN.timestamp()) % (interval_minutes * 60)
    start = {"startTime": f"{offset} seconds"} if offset else {}
    bins = F.window(column, f"{interval_minutes} minutes", **start)
    return (alerts.where("is_attack").groupBy(bins.alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("severity") == "HIGH").alias("high_severity_count"))
            .select(F.col("bin.start").alias("timestamp"), "count", "high_severity_count"))


def timeline_sink(path: str, interval_minutes: int = 60, column: str = EVENT_TIME) -> BatchSink:
    """Counts per bin of each micro-batch, in a folder of its own that a repeated batch replaces."""
    def write(batch: DataFrame, batch_id: int) -> None:
        _binned(batch, interval_minutes, column).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def write_timeline(alerts: DataFrame, path: str, checkpoint: str, interval_minutes: int = 60, column: str = EVENT_TIME,
                   every: str | None = ALERT_TRIGGER) -> StreamingQuery:
    """Keep the timeline of a stream under ``path``. No watermark: a late alert adds to its bin."""
    return start_sinks(alerts, [timeline_sink(path, interval_minutes, column)], checkpoint, every)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """All bins written so far, open ones among them, summed over the micro-batches."""
    parts = spark.read.schema("timestamp timestamp, count long, high_severity_count long").parquet(path)
    return parts.groupBy("timestamp").agg(F.sum("count").alias("count"),
                                          F.sum("high_severity_count").alias("high_severity_count"))


TIMELINE_SCHEMA = "timestamp timestamp, count long, high_severity_count long, bin_day date"


def upsert_timeline(spark: SparkSession, path: str, changed: DataFrame) -> None:
    """Put bins in the place of those with the same timestamp. Only the days of ``changed`` are rewritten, each
    as one file, so files grow with days and not with calls."""
    new = changed.withColumn("bin_day", F.to_date("timestamp"))
    if exists(spark, path):
        kept = spark.read.schema(TIMELINE_SCHEMA).option("basePath", path).parquet(path)
        days = new.select("bin_day").distinct()
        new = (kept.join(days, "bin_day", "left_semi").join(new.select("timestamp"), "timestamp", "left_anti")
               .unionByName(new))
    (new.repartition("bin_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bin_day").parquet(path))


def write_timeline_updates(alerts: DataFrame, path: str, checkpoint: str, interval_minutes: int = 60,
                           column: str = EVENT_TIME, every: str | None = ALERT_TRIGGER) -> StreamingQuery:
    """Keep one row per bin under ``path``, by an aggregation in update mode.

    The state holds the whole counts of every bin; a micro-batch gives out those it changed, and they replace
    the stored ones. A repeated batch therefore changes nothing. There is no watermark: the state is as large
    as the timeline, one row per bin, and an alert that comes late, by however much, adds to its bin.
    """
    def upsert(changed: DataFrame, batch_id: int) -> None:
        changed.persist()  # or the state would be computed once for each use
        try:
            upsert_timeline(changed.sparkSession, path, changed)
        finally:
            changed.unpersist()

    return (_binned(alerts, interval_minutes, column).writeStream.foreachBatch(upsert).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start())


def read_timeline_updates(spark: SparkSession, path: str) -> DataFrame:
    """The bins that ``write_timeline_updates`` keeps."""
    if not exists(spark, path):
        return spark.createDataFrame([], TIMELINE_SCHEMA).drop("bin_day")
    return spark.read.schema(TIMELINE_SCHEMA).parquet(path).drop("bin_day")


# Redelivery --------------------------------------------------------------

def drop_redelivered(messages: DataFrame, keys: list[str], arrival: str = "timestamp",
                     within: str = "1 hour") -> DataFrame:
    """The first delivery of each message, from a source that may deliver again.

    A message is the same if its ``keys`` are and its ``arrival`` lies no more than ``within`` after the first
    one's; the state holds the keys of that time. Arrival must be the source's own clock, which runs nearly in
    order: rows that are ``within`` behind the newest are dropped. A message with a null among its keys is
    the same as another only if all its columns are equal, offsets among them.
    """
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in messages.columns])))
    unkeyed = F.when(F.greatest(F.lit(False), *[F.col(k).isNull() for k in keys]), whole)
    return (watermark(messages, arrival, within).withColumn("_unkeyed", unkeyed)
            .dropDuplicatesWithinWatermark([*keys, "_unkeyed"]).drop("_unkeyed"))


# Rejects -----------------------------------------------------------------

def write_rejects(messages: DataFrame, source: str, path: str, checkpoint: str,
                  every: str | None = ALERT_TRIGGER) -> StreamingQuery:
    """Append the messages that ``detect`` leaves out, as they came, to a Parquet folder."""
    rejected = rejected_flow_json(messages, stream_schema(source))
    return (rejected.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**_trigger(every)).start())


# Run ---------------------------------------------------------------------

ACCOUNT_SCHEMA = "batch_id long, sent long, parsed long, rejected long, attacks long, high_severity long"


def routing_sink(source: str, detector: Detector, sinks: list[BatchSink], rejects: str, accounts: str,
                 clock: Column | None = None) -> BatchSink:
    """Take a micro-batch of routed messages apart: broken ones to ``rejects``, the others scored to the sinks.

    The batch is read and parsed once. Every output has a folder per batch, which a repeated batch replaces.
    ``accounts`` gets one row per batch: the messages it sent, parsed and rejected, counted by the job that
    writes the rejects, and its attacks and high alerts.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            counted = Observation()
            seen = batch.observe(counted, F.count(F.lit(1)).alias("sent"), F.count_if(is_accepted()).alias("parsed"),
                                 F.count_if(~is_accepted()).alias("rejected"))
            rejected_messages(seen).write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")
            flows = prepare_features(accepted_flows(batch), source)
            scored = score_and_enrich(flows, detector, clock)

            def account(scored: DataFrame, batch_id: int) -> None:
                row = scored.agg(F.count_if("is_attack").alias("attacks"),
                                 F.count_if(F.col("is_attack") & (F.col("severity") == "HIGH")).alias("high_severity"))
                totals = [F.lit(batch_id).cast("long").alias("batch_id")] + [
                    F.lit(counted.get[c]).cast("long").alias(c) for c in ("sent", "parsed", "rejected")]
                row.select(*totals, "attacks", "high_severity").coalesce(1).write.mode("overwrite").parquet(
                    f"{accounts}/batch_id={batch_id}")

            fan_out([*sinks, account])(scored, batch_id)
        finally:
            batch.unpersist()
    return write


def read_accounts(spark: SparkSession, accounts: str) -> DataFrame:
    """One row per micro-batch that ``run_detection`` finished."""
    if not exists(spark, accounts):
        return spark.createDataFrame([], ACCOUNT_SCHEMA)
    return spark.read.schema(ACCOUNT_SCHEMA).option("basePath", accounts).parquet(accounts)


def read_rejects(spark: SparkSession, rejects: str, columns: str = "value string, timestamp timestamp") -> DataFrame:
    """The messages that ``run_detection`` set apart, with the number of their micro-batch."""
    columns = f"{columns}, batch_id long"
    if not exists(spark, rejects):
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).option("basePath", rejects).parquet(rejects)


def run_detection(spark: SparkSession, messages: DataFrame, source: str, detector: Detector, sinks: list[BatchSink],
                  session_id: str, session_log: str | None = None, checkpoint: str | None = None,
                  every: str | None = ALERT_TRIGGER, clock: Column | None = None,
                  rejects: str | None = None, accounts: str | None = None) -> StreamingQuery:
    """Run detection until the source is drained (``every=None``) or the query is stopped.

    The session is registered before the first batch and ended afterwards, also when
    the query fails or the run is interrupted. One query reads the source: messages that can't be parsed go to
    the folder ``rejects``, the counts of each micro-batch to ``accounts``, by default beside the checkpoint.
    A sink that fails, the one of the rejects among them, fails the batch and ends the run.
    """
    if session_log:
        alert_table.register_session(spark, session_log, session_id, {"data_source": source})
    checkpoint = checkpoint or scratch_path(spark, f"detect-{session_id}")
    sink = routing_sink(source, detector, sinks, rejects or f"{checkpoint}-rejects",
                        accounts or f"{checkpoint}-accounts", clock)
    query = None
    try:
        query = start_sinks(route_flow_json(messages, stream_schema(source)), [sink], checkpoint, every)
        query.awaitTermination()
        return query
    finally:
        if query is not None and query.isActive:
            query.stop()
        if session_log:
            alert_table.end_session(spark, session_log, session_id)
