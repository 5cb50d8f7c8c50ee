"""The stored alert table and the session log beside it.

Layout: ``alert_date=D/session_id=S/batch_id=B``.

* Reading a period opens and even lists the folders of its days only.
* A micro-batch owns its folders: writing it again first removes what an earlier
  attempt left, on whatever day, so replays add nothing.
* Writers stage their files apart from each other, so sessions can write at once.
* Whole days and whole sessions are deleted as folders; only the day that holds a
  cutoff is rewritten.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.functions.moments import in_utc, moment
from flowlens.operators import sessions as S
from flowlens.operators.alerts import recent_alerts
from flowlens.schemas import ALERT_SCHEMA, ALERT_SEVERITIES, EXPORT_COLUMNS, SESSION_EVENT_SCHEMA
from flowlens.sources.storage import delete, delete_all, delete_matching, exists, matching, move, side_by_side

ALERT_COLUMNS = ["is_attack", "attack_type", "severity", "binary_prediction", "multiclass_prediction",
                 "prediction_score", "processed_at", "kafka_timestamp"]
CONTEXT_COLUMNS = ["event_id", "proto", "service", "state", "source_ip", "destination_ip",
                   "Source_IP", "Destination_IP"]
PARTITIONS = ["alert_date", "session_id", "batch_id"]
DIRECT_BATCH, COMPACTED = -1, -2
STAGED = "_compaction"  # in the table's folder, not read as data


def alert_rows(scored: DataFrame, severities=ALERT_SEVERITIES) -> DataFrame:
    """Attacks only, with the columns an alert keeps.

    Addresses get one lower-case name. A row without ``processed_at`` or with an
    unknown severity fails the job.
    """
    context = [F.col(c).alias(c.lower() if c.lower().endswith("_ip") else c)
               for c in CONTEXT_COLUMNS if c in scored.columns]
    attacks = scored.where("is_attack").select(*[c for c in ALERT_COLUMNS if c in scored.columns], *context)
    valid = F.col("processed_at").isNotNull() & F.col("severity").isin(severities)
    return attacks.withColumn("severity", F.when(valid, F.col("severity")).otherwise(
        F.raise_error(F.lit("alert without a time or with an unknown severity"))))


def _safe_id(session_id: str) -> str:
    """Session ids become folder names and glob patterns, so they must be plain."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", session_id):
        raise ValueError(f"not a usable session id: {session_id!r}")
    return session_id


def _located(alerts: DataFrame, session_id: str, batch_id: int, clock) -> DataFrame:
    return (alerts.withColumn("inserted_at", F.current_timestamp() if clock is None else clock)
            .withColumn("alert_date", F.to_date("processed_at"))
            .withColumn("session_id", F.lit(_safe_id(session_id)))
            .withColumn("batch_id", F.lit(batch_id).cast("bigint")))


def located_alerts(scored: DataFrame, session_id: str, batch_id: int, clock=None,
                   severities=ALERT_SEVERITIES) -> DataFrame:
    """The alerts of one micro-batch with the columns of its place in the table."""
    return _located(alert_rows(scored, severities), session_id, batch_id, clock)


def replace_partitions(rows: DataFrame, path: str) -> None:
    """Replace exactly the partitions that ``rows`` fill. The files are staged in a folder
    of this job's own and moved when all tasks are done."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def write_alert_batch(scored: DataFrame, path: str, session_id: str, batch_id: int, clock=None,
                      severities=ALERT_SEVERITIES, replayed: bool = True) -> None:
    """Write the alerts of one micro-batch; writing the same batch again replaces it.

    Looking for what an earlier attempt left lists all days: a caller that knows of none says
    so with ``replayed=False``.
    """
    rows = located_alerts(scored, session_id, batch_id, clock, severities)
    if replayed:
        delete_matching(scored.sparkSession, f"{path}/alert_date=*/session_id={session_id}/batch_id={batch_id}")
    replace_partitions(rows, path)


def write_alert_table(alerts: DataFrame, path: str, batch_id: int = 0) -> None:
    """Bulk load of alerts that already name their session. The rebalance hint gathers
    each session and day into few files and splits those that hold too much for one task."""
    rows = alerts.withColumn("batch_id", F.lit(batch_id).cast("bigint")).withColumn(
        "alert_date", F.to_date("processed_at"))
    replace_partitions(rows.hint("rebalance", "alert_date", "session_id"), path)


def append_alerts(alerts: DataFrame, path: str, session_id: str, clock=None) -> None:
    """Insert ready-made alerts outside any stream. An empty frame adds no rows."""
    rows = alerts.drop(*PARTITIONS, "inserted_at")
    _located(rows, session_id, DIRECT_BATCH, clock).write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def _day(value: datetime) -> str:
    return in_utc(value).strftime("%Y-%m-%d")


def _stored_schema(spark: SparkSession, path: str, days: list[str]) -> T.StructType | None:
    """Columns of all files of the days, from their footers; None if no file is left."""
    try:
        return spark.read.option("mergeSchema", True).option("basePath", path).parquet(*days).schema if days else None
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
    return None


def _with_partitions(schema: T.StructType) -> T.StructType:
    """Partition types are stated: session ids such as 00123456 or 1234e567 must stay text."""
    kept = [f for f in schema.fields if f.name not in PARTITIONS]
    parts = [T.StructField("alert_date", T.DateType()), T.StructField("session_id", T.StringType()),
             T.StructField("batch_id", T.LongType())]
    return T.StructType(kept + parts)


def read_alerts(spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None,
                schema: T.StructType | None = None) -> DataFrame:
    """The alert table, or the days from ``since`` to ``until`` of it; empty if there are none.

    The bounds only choose the day folders to list. Batches may differ in their optional
    columns: the footers of all files are read for them, and a batch without one has nulls.
    ``schema`` (the stored columns) saves that pass.
    """
    days = [p for p in matching(spark, f"{path}/alert_date=*")
            if (since is None or p.rsplit("=", 1)[1] >= _day(since))
            and (until is None or p.rsplit("=", 1)[1] <= _day(until))]
    schema = schema or _stored_schema(spark, path, days)
    if not days or schema is None:
        return spark.createDataFrame([], schema or ALERT_SCHEMA)
    return spark.read.option("basePath", path).schema(_with_partitions(schema)).parquet(*days)


def export_alerts(alerts: DataFrame, limit: int = 1000, severity: str | None = None,
                  attack_type: str | None = None, **options) -> DataFrame:
    """The newest matching alerts in the columns of an export file."""
    newest = recent_alerts(alerts, limit, severity, attack_type, **options)
    return newest.withColumn("prediction", F.col("binary_prediction")).select(*EXPORT_COLUMNS)


def write_export(export: DataFrame, path: str, fmt: str = "json") -> None:
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown export format {fmt!r}")
    writer = export.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)


# Deletion ----------------------------------------------------------------

def clear_session_alerts(spark: SparkSession, path: str, session_id: str) -> int:
    """Delete a session's alerts and return how many there were. Other sessions' files stay as they are."""
    if not session_id:
        return 0
    folders = f"{path}/alert_date=*/session_id={_safe_id(session_id)}"
    gone = _stored_rows(spark, path, matching(spark, folders))
    delete_matching(spark, folders)
    return gone


def _stored_rows(spark: SparkSession, path: str, folders: list[str]) -> int:
    """Rows under some folders of the table, from the Parquet footers."""
    if not folders:
        return 0
    return spark.read.option("basePath", path).schema(T.StructType()).parquet(*folders).count()


def delete_all_alerts(spark: SparkSession, path: str) -> int:
    gone = _stored_rows(spark, path, matching(spark, f"{path}/alert_date=*"))
    delete(spark, path)
    return gone


def delete_old_alerts(spark: SparkSession, path: str, days: int = 30, now: datetime | None = None) -> int:
    """Delete alerts older than ``days`` and return how many there were.

    Days before the cutoff go as folders, later days are not looked at, and on the
    cutoff's own day only the batches that lie on both sides of it are rewritten.
    Running it again finishes an interrupted run.
    """
    cutoff = in_utc(now or datetime.now(timezone.utc)) - timedelta(days=days)
    expired = [p for p in matching(spark, f"{path}/alert_date=*") if p.rsplit("=", 1)[1] < _day(cutoff)]
    gone = _stored_rows(spark, path, expired)
    delete_all(spark, expired)

    day = read_alerts(spark, path, cutoff, cutoff)
    old = F.col("processed_at") < moment(cutoff, day.schema["processed_at"].dataType)
    batches = day.groupBy(*PARTITIONS).agg(
        F.count_if(old).alias("old"), F.count(F.lit(1)).alias("rows")).where("old > 0").persist()
    gone += batches.agg(F.coalesce(F.sum("old"), F.lit(0))).first()[0]
    mixed = batches.where("old < rows").select(*PARTITIONS)
    replace_partitions(day.where(~old).join(mixed, PARTITIONS, "left_semi"), path)
    emptied = batches.where("old = rows").select(*PARTITIONS).toLocalIterator()  # one row per folder to delete
    while some := list(islice(emptied, 1_000)):
        delete_all(spark, ["/".join([path, *(f"{c}={row[c]}" for c in PARTITIONS)]) for row in some])
    batches.unpersist()
    return gone


# Compaction --------------------------------------------------------------

def compact_alerts(spark: SparkSession, path: str, since: datetime, until: datetime) -> None:
    """Gather the batches of whole days into few files per day and session, sorted by severity, type and time.

    The sort gives Parquet narrow value ranges per row group, so a filter on severity or type skips
    most of them. The new files and the list of folders they replace are staged first. The exchange is
    no transaction: a reader may meanwhile find a batch twice, and after an interruption until the next
    call, which first finishes what an earlier one began. Batches that arrive meanwhile stay as they are.
    For days that no replay writes to any more, one call at a time.
    """
    _finish_compaction(spark, path)
    folders = [f for f in matching(spark, f"{path}/alert_date=*/session_id=*/batch_id=*")
               if _day(since) <= f.rsplit("/", 3)[1].split("=", 1)[1] <= _day(until)]
    schema = _stored_schema(spark, path, folders)
    if schema is None:
        return
    found = spark.read.option("basePath", path).schema(_with_partitions(schema)).parquet(*folders)
    (found.withColumn("batch_id", F.lit(COMPACTED).cast("bigint")).hint("rebalance", "alert_date", "session_id")
     .sortWithinPartitions(*PARTITIONS, "severity", "attack_type", "processed_at")
     .write.mode("overwrite").partitionBy(*PARTITIONS).parquet(f"{path}/{STAGED}/rows"))
    replaced = spark.createDataFrame([(f,) for f in folders], "value string")  # one row per folder
    replaced.coalesce(1).write.mode("overwrite").text(f"{path}/{STAGED}/replaced")
    _finish_compaction(spark, path)


def _finish_compaction(spark: SparkSession, path: str) -> None:
    """Put staged files in their place; without a complete list of what they replace, forget them."""
    staged = f"{path}/{STAGED}"
    if exists(spark, f"{staged}/replaced/_SUCCESS"):
        def place(source: str) -> None:
            target = "/".join([path, *source.rsplit("/", 3)[1:]])
            delete(spark, target)  # of an earlier compaction, whose rows are among the staged ones
            move(spark, source, target)

        side_by_side(place, matching(spark, f"{staged}/rows/alert_date=*/session_id=*/batch_id={COMPACTED}"))
        replaced = (r["value"] for r in spark.read.text(f"{staged}/replaced").toLocalIterator())
        delete_all(spark, [f for f in replaced if not f.endswith(f"/batch_id={COMPACTED}")])
    delete(spark, staged)


# Sessions ----------------------------------------------------------------

def _append_event(spark: SparkSession, log_path: str, session_id: str, event: str,
                  metadata: dict | None = None, at: datetime | None = None) -> None:
    row = (session_id, event, at or datetime.now(timezone.utc), metadata)
    spark.createDataFrame([row], SESSION_EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(log_path)


def read_session_log(spark: SparkSession, log_path: str) -> DataFrame:
    if not exists(spark, log_path):
        return spark.createDataFrame([], SESSION_EVENT_SCHEMA)
    return spark.read.schema(SESSION_EVENT_SCHEMA).parquet(log_path)


def register_session(spark: SparkSession, log_path: str, session_id: str | None = None,
                     metadata: dict | None = None, at: datetime | None = None) -> str:
    session_id = session_id or S.new_session_id()
    _append_event(spark, log_path, session_id, S.REGISTERED, metadata or {}, at)
    return session_id


def end_session(spark: SparkSession, log_path: str, session_id: str, at: datetime | None = None) -> bool:
    """Mark a session as ended; False if it is not known."""
    if not session_id or S.session_info(read_session_log(spark, log_path), session_id).isEmpty():
        return False
    _append_event(spark, log_path, session_id, S.ENDED, at=at)
    return True


def delete_session(spark: SparkSession, path: str, log_path: str, session_id: str,
                   at: datetime | None = None) -> dict:
    """Delete a session and its alerts."""
    if not session_id:
        raise ValueError("no session id")
    known = not S.session_info(read_session_log(spark, log_path), session_id).isEmpty()
    gone = clear_session_alerts(spark, path, session_id)
    if known:
        _append_event(spark, log_path, session_id, S.DELETED, at=at)
    return {"session_id": session_id, "alerts_deleted": gone, "session_deleted": known}


def delete_all_sessions(spark: SparkSession, path: str, log_path: str) -> dict:
    """Delete every alert and every session."""
    count = S.session_states(read_session_log(spark, log_path)).count()
    gone = delete_all_alerts(spark, path)
    delete(spark, log_path)
    return {"alerts_deleted": gone, "sessions_deleted": count}
