"""Alert queries: filters, top lists, statistics and time series.

``now`` is a datetime, an ISO text or a Column; it defaults to the current time.
Where the table carries the partition column ``alert_date``, every time bound is
also stated on it, so whole days are skipped before any file is opened.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.moments import moment
from flowlens.operators.ordering import seek_page

TIME, DAY = "processed_at", "alert_date"
UNKNOWN = "Unknown"
RANGE_HOURS = {"1h": 1, "6h": 6, "24h": 24, "7d": 7 * 24, "30d": 30 * 24}
# Range to (bucket minutes, buckets before the open one).
SERIES = {"1h": (5, 12), "6h": (30, 12), "24h": (60, 24), "7d": (24 * 60, 7), "30d": (48 * 60, 15)}
# Bins of any width start here, not at the Unix epoch.
BIN_ORIGIN = datetime(2000, 1, 1, tzinfo=timezone.utc)


def _moment(df: DataFrame, value) -> Column:
    return moment(value, df.schema[TIME].dataType)


def _hours_before(moment: Column, hours: float) -> Column:
    return moment - F.expr(f"INTERVAL '{int(hours * 60)}' MINUTE")


def _every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _from(df: DataFrame, start: Column) -> list[Column]:
    return [F.col(TIME) >= start] + ([F.col(DAY) >= F.to_date(start)] if DAY in df.columns else [])


def _until(df: DataFrame, end: Column) -> list[Column]:
    return [F.col(TIME) <= end] + ([F.col(DAY) <= F.to_date(end)] if DAY in df.columns else [])


def _number(weight: str | None = None) -> Column:
    """Number of alerts; rows that stand for several name their number in a column ``weight``."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def _tally(level: str, weight: str | None = None) -> Column:
    hit = F.col("severity") == level
    return F.count_if(hit) if weight is None else F.sum(F.when(hit, F.col(weight)).otherwise(F.lit(0)))


def _levels(weight: str | None = None) -> list[Column]:
    """high, medium and low, where low is everything else."""
    high, medium = _tally("HIGH", weight), _tally("MEDIUM", weight)
    return [high.alias("high"), medium.alias("medium"), (_number(weight) - high - medium).alias("low")]


# Filters -----------------------------------------------------------------

def alert_filter(alerts: DataFrame, severity: str | None = None, attack_type: str | None = None,
                 session_id: str | None = None, current_session: str | None = None,
                 session_only: bool = True) -> DataFrame:
    """All given conditions. With ``session_only`` the current session applies unless another is named."""
    session = session_id or (current_session if session_only else None)
    wanted = []
    if session:
        wanted.append(F.col("session_id") == session)
    if severity:
        wanted.append(F.col("severity") == severity.upper())
    if attack_type:
        wanted.append(F.col("attack_type") == attack_type)
    return alerts.where(_every(wanted))


def alert_time_range(alerts: DataFrame, start, end=None, **session) -> DataFrame:
    """Alerts from ``start`` to ``end`` (default now), both included, newest first.

    All alerts of a micro-batch share one time. Ordering equal times by a hash of the
    row lets the sort spread them over tasks.
    """
    bounds = _from(alerts, _moment(alerts, start)) + _until(alerts, _moment(alerts, end))
    spread = F.xxhash64(*[F.col(c) for c in alerts.columns])
    return alert_filter(alerts, **session).where(_every(bounds)).orderBy(F.desc(TIME), spread)


def alert_search(alerts: DataFrame, text: str | None = None, severity: str | None = None,
                 attack_type: str | None = None, session_id: str | None = None,
                 date_from=None, date_to=None) -> DataFrame:
    """Case-insensitive text in type, session or severity, and any of the exact filters."""
    found = alert_filter(alerts, severity, attack_type, session_id)
    if text:
        hits = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
                for c in ("attack_type", "session_id", "severity")]
        found = found.where(reduce(lambda a, b: a | b, hits))
    bounds = ([] if date_from is None else _from(alerts, _moment(alerts, date_from))) + (
        [] if date_to is None else _until(alerts, _moment(alerts, date_to)))
    return found.where(_every(bounds))


def relative_range(alerts: DataFrame, period: str = "24h", now=None, start=None, end=None) -> DataFrame:
    """Alerts of the last ``1h``, ``6h``, ``24h``, ``7d`` or ``30d``, or ``custom`` from start to end.

    A custom range without a start is everything, one without an end is open.
    """
    if period == "custom":
        if start is None:
            return alerts
        upper = [] if end is None else _until(alerts, _moment(alerts, end))
        return alerts.where(_every(_from(alerts, _moment(alerts, start)) + upper))
    if period not in RANGE_HOURS:
        raise ValueError(f"unknown period {period!r}")
    hours = RANGE_HOURS[period]
    return alerts.where(_every(_from(alerts, _hours_before(_moment(alerts, now), hours))))


def _last_hours(alerts: DataFrame, hours: float, now, **session) -> DataFrame:
    since = _hours_before(_moment(alerts, now), hours)
    return alert_filter(alerts, **session).where(_every(_from(alerts, since)))


# Lists -------------------------------------------------------------------

def recent_alerts(alerts: DataFrame, limit: int = 100, severity: str | None = None,
                  attack_type: str | None = None, tie_break: str | None = None, **session) -> DataFrame:
    """The newest alerts; ``tie_break`` orders equal times."""
    order = [F.desc(TIME)] + ([F.desc(tie_break)] if tie_break else [])
    return alert_filter(alerts, severity, attack_type, **session).orderBy(*order).limit(limit)


def page(alerts: DataFrame, sort: str = TIME, order: str = "desc", number: int = 1, size: int = 50,
         tie_break: str = "event_id", **options) -> DataFrame:
    """Page ``number`` (from 1) of the alerts sorted by any column; ``tie_break`` must be unique."""
    keys = [sort] if sort == tie_break else [sort, tie_break]
    return seek_page(alerts, keys, order == "desc", (number - 1) * size, size, **options)


def page_count(alerts: DataFrame, size: int = 50) -> DataFrame:
    return alerts.agg(F.count(F.lit(1)).alias("total_rows")).withColumn(
        "total_pages", F.ceil(F.col("total_rows") / F.lit(size)))


def top_attack_types(alerts: DataFrame, n: int = 10) -> DataFrame:
    return (alerts.groupBy("attack_type").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "attack_type").limit(n))


def top_sources(alerts: DataFrame, n: int = 10) -> DataFrame:
    return (alerts.where("is_attack").groupBy("source_ip").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "source_ip").limit(n))


# Statistics --------------------------------------------------------------

def alert_type_counts(alerts: DataFrame, hours: float = 24, now=None, weight: str | None = None, **session) -> DataFrame:
    """Alerts per type of the last hours, most frequent first."""
    return (_last_hours(alerts, hours, now, **session).groupBy("attack_type")
            .agg(_number(weight).alias("count")).orderBy(F.desc("count"), "attack_type"))


def alert_statistics(alerts: DataFrame, hours: float = 24, now=None, weight: str | None = None, **session) -> DataFrame:
    """One row, zeros when nothing matches: totals by severity, the types as a map, the period."""
    kind = F.coalesce("attack_type", F.lit(UNKNOWN)).alias("attack_type")  # a null and a stored "Unknown" are one
    by_type = _last_hours(alerts, hours, now, **session).groupBy(kind).agg(
        _number(weight).alias("n"), *[_tally(level, weight).alias(level[0].lower()) for level in ("HIGH", "MEDIUM", "LOW")])
    total = {"total_alerts": "n", "high_severity": "h", "medium_severity": "m", "low_severity": "l"}
    types = F.map_from_entries(F.collect_list(F.struct("attack_type", "n")))
    return by_type.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in total.items()], types.alias("by_attack_type"),
    ).withColumn("time_period_hours", F.lit(hours)).withColumn("since", _hours_before(_moment(alerts, now), hours))


def alert_timeline(alerts: DataFrame, hours: float = 24, interval_minutes: int = 60, now=None,
                   weight: str | None = None, **session) -> DataFrame:
    """Counts per fixed-width bin, oldest first; empty bins are absent."""
    width = interval_minutes * 60
    offset = int(BIN_ORIGIN.timestamp()) % width
    start = {"startTime": f"{offset} seconds"} if offset else {}
    bins = F.window(TIME, f"{interval_minutes} minutes", **start)
    return (
        _last_hours(alerts, hours, now, **session).groupBy(bins.alias("bin"))
        .agg(_number(weight).alias("count"), _tally("HIGH", weight).alias("high_severity_count"))
        .select(F.col("bin.start").alias("timestamp"), "count", "high_severity_count").orderBy("timestamp")
    )


def timeline_interval(hours: float) -> int:
    """Bin width the overview uses for a range."""
    return 15 if hours <= 6 else 60


def alert_metrics(alerts: DataFrame, period: str = "24h", now=None, **bounds) -> DataFrame:
    """One row: alerts, high ones, distinct types, mean confidence (a missing one counts as 0)."""
    return relative_range(alerts, period, now, **bounds).agg(
        F.count(F.lit(1)).alias("total_alerts"), _tally("HIGH").alias("high_severity"),
        F.count_distinct(F.coalesce("attack_type", F.lit(UNKNOWN))).alias("attack_types"),
        F.coalesce(F.avg(F.coalesce("prediction_score", F.lit(0.0))), F.lit(0.0)).alias("avg_confidence"))


def top_attacks(alerts: DataFrame, period: str = "24h", n: int = 10, now=None, **bounds) -> DataFrame:
    """Most frequent types with severity counts; ``bar`` is the share of the top type's count."""
    kind = F.coalesce("attack_type", F.lit(UNKNOWN)).alias("attack_type")
    best = (relative_range(alerts, period, now, **bounds).groupBy(kind)
            .agg(F.count(F.lit(1)).alias("count"), *_levels()).orderBy(F.desc("count"), "attack_type").limit(n))
    return best.withColumn("bar", F.col("count") / F.max("count").over(Window.partitionBy()))  # n rows


def attack_share(alerts: DataFrame, period: str = "24h", n: int = 8, now=None, **bounds) -> DataFrame:
    """Most frequent types with their percentage of the rows shown."""
    kind = F.coalesce("attack_type", F.lit(UNKNOWN)).alias("attack_type")
    best = (relative_range(alerts, period, now, **bounds).groupBy(kind)
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "attack_type").limit(n))
    shown = F.sum("count").over(Window.partitionBy())  # n rows
    return best.withColumn("percent", F.lit(100.0) * F.col("count") / shown)


def _series(alerts: DataFrame, period: str, now, measures: list[Column], **bounds) -> DataFrame:
    """Measures per bucket counted back from ``now``; empty buckets hold zeros and the
    last one is open-ended."""
    if period != "custom" and period not in SERIES:
        raise ValueError(f"unknown period {period!r}")
    minutes, steps = SERIES["24h" if period == "custom" else period]
    first = _hours_before(_moment(alerts, now), minutes * steps / 60)
    elapsed = F.unix_micros(F.col(TIME).cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    slot = F.least(F.floor(elapsed / F.lit(minutes * 60 * 1_000_000)), F.lit(steps).cast("bigint"))
    counted = (relative_range(alerts, period, now, **bounds).withColumn("_slot", slot).where("_slot >= 0")
               .groupBy("_slot").agg(*measures))
    spine = alerts.sparkSession.range(steps + 1).withColumnRenamed("id", "_slot")
    at = first + F.make_dt_interval(mins=(F.col("_slot") * minutes).cast("int"))
    names = [c for c in counted.columns if c != "_slot"]
    # ``counted`` has at most steps + 1 rows.
    return spine.join(F.broadcast(counted), "_slot", "left").select(
        at.alias("bucket_start"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names]).orderBy("bucket_start")


def activity_series(alerts: DataFrame, period: str = "24h", now=None, weight: str | None = None, **bounds) -> DataFrame:
    return _series(alerts, period, now, [_number(weight).alias("count")], **bounds)


def severity_trend(alerts: DataFrame, period: str = "24h", now=None, weight: str | None = None, **bounds) -> DataFrame:
    return _series(alerts, period, now, _levels(weight), **bounds)


def session_statistics(alerts: DataFrame, period: str = "24h", n: int = 10, now=None, **bounds) -> DataFrame:
    """Busiest sessions with severity counts and first and last alert."""
    session = F.coalesce("session_id", F.lit(UNKNOWN)).alias("session_id")
    return (relative_range(alerts, period, now, **bounds).groupBy(session)
            .agg(F.count(F.lit(1)).alias("count"), *_levels(), F.min(TIME).alias("first_seen"),
                 F.max(TIME).alias("last_seen"))
            .orderBy(F.desc("count"), "session_id").limit(n))


def alert_count(alerts: DataFrame, since=None, severity: str | None = None, **session) -> DataFrame:
    found = alert_filter(alerts, severity, **session)
    if since is not None:
        found = found.where(_every(_from(alerts, _moment(alerts, since))))
    return found.agg(F.count(F.lit(1)).alias("count"))


def recent_count(alerts: DataFrame, minutes: int = 5, now=None, **session) -> DataFrame:
    """One row: all alerts and those of the last minutes."""
    since = _moment(alerts, now) - F.expr(f"INTERVAL '{minutes}' MINUTE")
    return alert_filter(alerts, **session).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(TIME) >= since).alias("recent"))


def severity_distribution(alerts: DataFrame, hours: float | None = 24, now=None, **session) -> DataFrame:
    chosen = alert_filter(alerts, **session) if hours is None else _last_hours(alerts, hours, now, **session)
    return chosen.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


def traffic_totals(scored: DataFrame) -> DataFrame:
    """One row over all scored flows: events, attacks, high severity, normal."""
    return scored.agg(
        F.count(F.lit(1)).alias("events"), F.count_if("is_attack").alias("attacks"),
        _tally("HIGH").alias("high_severity"), F.count_if(~F.col("is_attack")).alias("normal"))


def traffic_split(scored: DataFrame) -> DataFrame:
    return scored.groupBy("is_attack").agg(F.count(F.lit(1)).alias("count"))


# Deletion as a filter ----------------------------------------------------

def without_session(alerts: DataFrame, session_id: str) -> DataFrame:
    return alerts.where(~F.col("session_id").eqNullSafe(F.lit(session_id)))


def retained_alerts(alerts: DataFrame, days: float = 30, now=None) -> DataFrame:
    """Alerts that a clean-up keeps: those not older than ``days``."""
    return alerts.where(_every(_from(alerts, _hours_before(_moment(alerts, now), days * 24))))
