"""Alert reports from maintained counts, with stored alerts read only where a period cuts a bin.

A report of ``operators/alerts.py`` is given weighted rows in place of alerts: a count for every bin that lies
wholly inside or outside each of its time buckets, and single alerts of weight 1 for the bins that an edge falls into.
Reports therefore equal those over all alerts; they read rows by bins, types and sessions, not by alerts.
``now`` is a datetime, by default the present.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from flowlens.functions.moments import in_utc, literal, moment
from flowlens.operators import alerts as al
from flowlens.operators.ordering import seek_page, weighted_span

WEIGHT = "n"
SORTED = (al.TIME, "severity", "attack_type", "session_id")
MAX_VALUES = 1_000  # of a column in a pushed list; with more, its texts are searched row by row
KEPT = [al.TIME, "severity", "attack_type", "session_id", WEIGHT]


def _start(value: datetime, minutes: int) -> datetime:
    """Start of the bin that holds a point in time."""
    return value - (value - datetime(1970, 1, 1, tzinfo=timezone.utc)) % timedelta(minutes=minutes)


def weighted_rows(counts: DataFrame, alerts: DataFrame, edges: list[datetime], minutes: int = 60) -> DataFrame:
    """Counts, and the alerts of the bins that hold an edge after their start."""
    kept = KEPT + [al.DAY] * (al.DAY in counts.columns and al.DAY in alerts.columns)  # days are skipped by it
    opened = sorted({_start(e, minutes) for e in edges if _start(e, minutes) != e})
    if not opened:
        return counts.select(*kept)
    kind = alerts.schema[al.TIME].dataType

    def inside(start: datetime):
        span = (F.col(al.TIME) >= moment(start, kind)) & (F.col(al.TIME) < moment(start + timedelta(minutes=minutes), kind))
        return span & (F.col(al.DAY) == F.lit(start.date())) if al.DAY in alerts.columns else span

    whole = ~F.col(al.TIME).isin([moment(start, counts.schema[al.TIME].dataType) for start in opened])
    single = alerts.where(reduce(lambda a, b: a | b, map(inside, opened)))  # at most one bin per edge
    return counts.where(whole).select(*kept).unionByName(
        single.withColumn(WEIGHT, F.lit(1).cast("bigint")).select(*kept))


def _since(now: datetime | None, hours: float) -> tuple[datetime, datetime]:
    now = in_utc(now or datetime.now(timezone.utc))
    return now, now - timedelta(minutes=int(hours * 60))


def alert_statistics_rollup(counts: DataFrame, alerts: DataFrame, hours: float = 24, now: datetime | None = None,
                            minutes: int = 60, **session) -> DataFrame:
    now, since = _since(now, hours)
    return al.alert_statistics(weighted_rows(counts, alerts, [since], minutes), hours, now, weight=WEIGHT, **session)


def alert_type_counts_rollup(counts: DataFrame, alerts: DataFrame, hours: float = 24, now: datetime | None = None,
                             minutes: int = 60, **session) -> DataFrame:
    now, since = _since(now, hours)
    return al.alert_type_counts(weighted_rows(counts, alerts, [since], minutes), hours, now, weight=WEIGHT, **session)


def alert_timeline_rollup(counts: DataFrame, alerts: DataFrame, hours: float = 24, interval_minutes: int = 60,
                          now: datetime | None = None, minutes: int = 60, **session) -> DataFrame:
    """The interval must be a multiple of the counts' bins and divide a day or be days."""
    if interval_minutes % minutes or (24 * 60 % interval_minutes and interval_minutes % (24 * 60)):
        raise ValueError(f"{interval_minutes} minutes don't fit bins of {minutes}")
    now, since = _since(now, hours)
    rows = weighted_rows(counts, alerts, [since], minutes)
    return al.alert_timeline(rows, hours, interval_minutes, now, weight=WEIGHT, **session)


def _bucket_edges(period: str, now: datetime | None) -> tuple[datetime, list[datetime]]:
    if period not in al.SERIES:
        raise ValueError(f"unknown period {period!r}")
    width, steps = al.SERIES[period]
    now, first = _since(now, width * steps / 60)
    return now, [first + timedelta(minutes=width * i) for i in range(steps + 1)]


def severity_trend_rollup(counts: DataFrame, alerts: DataFrame, period: str = "24h", now: datetime | None = None,
                          minutes: int = 60) -> DataFrame:
    now, edges = _bucket_edges(period, now)
    return al.severity_trend(weighted_rows(counts, alerts, edges, minutes), period, now, weight=WEIGHT)


def activity_series_rollup(counts: DataFrame, alerts: DataFrame, period: str = "24h", now: datetime | None = None,
                           minutes: int = 60) -> DataFrame:
    now, edges = _bucket_edges(period, now)
    return al.activity_series(weighted_rows(counts, alerts, edges, minutes), period, now, weight=WEIGHT)


# Lists -------------------------------------------------------------------

def alert_page_rollup(counts: DataFrame, alerts: DataFrame, sort: str = al.TIME, order: str = "desc", number: int = 1,
                      size: int = 50, tie_break: str = "event_id", minutes: int = 60, **filters) -> DataFrame:
    """Page ``number`` (from 1) of the alerts sorted by a counted column, then time, then the unique ``tie_break``.

    The counts tell which values and bins hold the page, and how many alerts come before them, so only
    alerts of these are read, by pushed filters; no alert outside is shuffled or sorted. ``filters`` are those
    of ``alert_filter``.
    """
    if sort not in SORTED:
        raise ValueError(f"alerts are not counted by {sort!r}")
    keys = list(dict.fromkeys([sort, al.TIME]))
    counts, alerts = al.alert_filter(counts, **filters), al.alert_filter(alerts, **filters)
    groups, offset = counts.groupBy(*keys).agg(F.sum(WEIGHT).alias(WEIGHT)), (number - 1) * size
    span = weighted_span(groups, keys, WEIGHT, order == "desc", offset, size)
    if span is None:
        return alerts.limit(0)
    before, low, high = span
    found = alerts.where(_within(alerts, keys, low, high, minutes))
    return seek_page(found, list(dict.fromkeys([*keys, tie_break])), order == "desc", offset - before, size)


def _within(alerts: DataFrame, keys: list[str], low, high, minutes: int):
    """From the start of the lowest key's bin to the end of the highest key's, with what is implied for single columns."""
    def bounds(row, later):
        values = [literal(row[k], alerts.schema[k].dataType) for k in keys]
        return [*values[:-1], values[-1] + F.expr(f"INTERVAL '{later}' MINUTE")]

    lower, upper = bounds(low, 0), bounds(high, minutes)
    of_rows, least, end = (F.struct(*[c.alias(k) for k, c in zip(keys, columns)])
                           for columns in (map(F.col, keys), lower, upper))
    tests = (of_rows >= least) & (of_rows < end)
    sort = keys[0]
    if len(keys) > 1 and low[sort] is not None and high[sort] is not None:
        tests &= F.col(sort).between(lower[0], upper[0])
    if low[sort] == high[sort] or len(keys) == 1:
        tests &= (F.col(al.TIME) >= lower[-1]) & (F.col(al.TIME) < upper[-1])
        if al.DAY in alerts.columns:
            tests &= F.col(al.DAY).between(F.to_date(lower[-1]), F.to_date(upper[-1]))
    return tests


def alert_search_rollup(counts: DataFrame, alerts: DataFrame, text: str, max_values: int = MAX_VALUES,
                        **options) -> DataFrame:
    """``alert_search`` by a dictionary: the counts name all values, those with the text become pushed lists.

    A column with more than ``max_values`` such values is searched in its rows, with the same result.
    """
    if not text:
        return al.alert_search(alerts, text, **options)
    columns, wanted = ["attack_type", "session_id", "severity"], text.lower()
    hits = []
    for name in columns:  # as many rows as a column has matching values, and no more than the bound
        values = counts.select(name).distinct().where(F.contains(F.lower(name), F.lit(wanted))).limit(max_values + 1).collect()
        if len(values) > max_values:
            hits.append(F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lit(wanted)))
        elif values:
            hits.append(F.col(name).isin([v[0] for v in values]))
    return al.alert_search(alerts, None, **options).where(reduce(or_, hits, F.lit(False)))
