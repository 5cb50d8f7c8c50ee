"""Sessions as an append-only event log; the current state is derived from it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

REGISTERED, ENDED, DELETED = "registered", "ended", "deleted"


def new_session_id() -> str:
    return str(uuid.uuid4())[:8]


def session_states(log: DataFrame) -> DataFrame:
    """One row per live session: started_at, ended_at, status, metadata.

    Events before the latest deletion of a session no longer count.
    """
    at = F.col("event_at")

    def latest(event):
        return F.max(F.when(F.col("event") == event, at))

    first = F.min(F.when(F.col("event") == REGISTERED, at))
    metadata = F.max_by("metadata", F.when(F.col("event") == REGISTERED, at))
    states = log.groupBy("session_id").agg(
        first.alias("started_at"), latest(ENDED).alias("ended_at"), latest(DELETED).alias("_deleted_at"),
        latest(REGISTERED).alias("_registered_at"), metadata.alias("metadata"))
    alive = F.col("_deleted_at").isNull() | (F.col("_registered_at") > F.col("_deleted_at"))
    restarted = F.col("_deleted_at").isNotNull()
    ended = F.when(~restarted | (F.col("ended_at") > F.col("_deleted_at")), F.col("ended_at"))
    return states.where(F.col("_registered_at").isNotNull() & alive).select(
        "session_id", F.when(restarted, F.col("_registered_at")).otherwise(F.col("started_at")).alias("started_at"),
        ended.alias("ended_at"), F.when(ended.isNull(), "active").otherwise("ended").alias("status"), "metadata")


def sessions(log: DataFrame, limit: int = 10, active_only: bool = False) -> DataFrame:
    """Most recently started sessions."""
    found = session_states(log)
    if active_only:
        found = found.where(F.col("status") == "active")
    return found.orderBy(F.desc("started_at"), "session_id").limit(limit)


def session_info(log: DataFrame, session_id: str) -> DataFrame:
    """One row, or none for an unknown session."""
    return session_states(log.where(F.col("session_id") == session_id))
