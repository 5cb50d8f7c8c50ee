"""Points in time as literals, independent of the driver's own time zone."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F, types as T


def in_utc(value: datetime) -> datetime:
    """A datetime without a zone is taken as UTC, the zone of the session."""
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)


def moment(value, data_type: T.DataType) -> Column:
    """``value`` (datetime, ISO text, Column, or None for now) in the type of the time column."""
    if value is None:
        value = F.current_timestamp()
    elif isinstance(value, datetime):
        value = F.lit(in_utc(value))
    return (value if isinstance(value, Column) else F.lit(value)).cast(data_type)


def literal(value, data_type: T.DataType) -> Column:
    """A collected value as a literal that compares equal to where it came from."""
    if isinstance(value, datetime) and isinstance(data_type, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(data_type)
    return F.lit(value).cast(data_type)
