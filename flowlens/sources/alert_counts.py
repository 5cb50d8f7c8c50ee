"""Maintained counts beside the alert table: alerts by time bin, severity, type, session and batch.

They have the table's own layout, ``alert_date=D/session_id=S/batch_id=B``, so a replayed batch replaces its
counts and a deleted day or session takes its own along. Each function here changes both, the alerts first; running
it again finishes an interrupted call. ``operators/rollups.py`` reads reports from them.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions.moments import in_utc
from flowlens.operators.alerts import TIME
from flowlens.schemas import ALERT_SEVERITIES
from flowlens.sources import alert_table as at
from flowlens.sources.storage import delete, delete_all, delete_matching, matching

BIN_MINUTES = 60


def counts_of(alerts: DataFrame, minutes: int = BIN_MINUTES) -> DataFrame:
    """Stored alerts counted; the time is the start of the bin. Minutes must divide a day."""
    if 24 * 60 % minutes:
        raise ValueError(f"bins of {minutes} minutes don't divide a day")
    keys = [*at.PARTITIONS, "severity", "attack_type"]
    return (alerts.groupBy(F.window(TIME, f"{minutes} minutes").alias("bin"), *keys)
            .agg(F.count(F.lit(1)).alias("n")).select(F.col("bin.start").alias(TIME), *keys, "n"))


def read_counts(spark: SparkSession, counts: str, since: datetime | None = None,
                until: datetime | None = None) -> DataFrame:
    """The counts of the days from ``since`` to ``until``."""
    found = at.read_alerts(spark, counts, since, until)
    return found if "n" in found.columns else found.withColumn("n", F.lit(0).cast("bigint"))  # no day at all


def write_counted_batch(scored: DataFrame, path: str, counts: str, session_id: str, batch_id: int, clock=None,
                        severities=ALERT_SEVERITIES, replayed: bool = True, minutes: int = BIN_MINUTES) -> None:
    """``write_alert_batch`` and its counts, from one pass over ``scored``."""
    rows = scored.persist()
    try:
        at.write_alert_batch(rows, path, session_id, batch_id, clock, severities, replayed)
        if replayed:
            delete_matching(scored.sparkSession, f"{counts}/alert_date=*/session_id={session_id}/batch_id={batch_id}")
        located = at.located_alerts(rows, session_id, batch_id, clock, severities)
        at.replace_partitions(counts_of(located, minutes), counts)
    finally:
        rows.unpersist()


def recount_days(spark: SparkSession, path: str, counts: str, since: datetime, until: datetime,
                 minutes: int = BIN_MINUTES) -> None:
    """Count whole days anew from their alerts: after bulk loads, direct inserts and compaction."""
    first, last = (in_utc(t).strftime("%Y-%m-%d") for t in (since, until))
    delete_all(spark, [p for p in matching(spark, f"{counts}/alert_date=*") if first <= p.rsplit("=", 1)[1] <= last])
    at.replace_partitions(counts_of(at.read_alerts(spark, path, since, until), minutes), counts)


def clear_session(spark: SparkSession, path: str, counts: str, session_id: str) -> int:
    """``clear_session_alerts`` for both."""
    gone = at.clear_session_alerts(spark, path, session_id)
    if session_id:
        delete_matching(spark, f"{counts}/alert_date=*/session_id={session_id}")
    return gone


def delete_old(spark: SparkSession, path: str, counts: str, days: int = 30, now: datetime | None = None,
               minutes: int = BIN_MINUTES) -> int:
    """``delete_old_alerts`` for both: whole days as folders, the cutoff's own day counted anew."""
    now = in_utc(now or datetime.now(timezone.utc))
    cutoff = now - timedelta(days=days)
    gone = at.delete_old_alerts(spark, path, days, now)
    day = cutoff.strftime("%Y-%m-%d")
    delete_all(spark, [p for p in matching(spark, f"{counts}/alert_date=*") if p.rsplit("=", 1)[1] < day])
    recount_days(spark, path, counts, cutoff, cutoff, minutes)
    return gone


def compact(spark: SparkSession, path: str, counts: str, since: datetime, until: datetime,
            minutes: int = BIN_MINUTES) -> None:
    """``compact_alerts``, and one set of counts per day and session in place of one per batch."""
    at.compact_alerts(spark, path, since, until)
    recount_days(spark, path, counts, since, until, minutes)


def delete_everything(spark: SparkSession, path: str, counts: str) -> int:
    gone = at.delete_all_alerts(spark, path)
    delete(spark, counts)
    return gone
