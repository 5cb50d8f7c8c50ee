"""Expressions that make dirty numeric columns safe to aggregate and assemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FLOATING = (T.FloatType, T.DoubleType)
PLUS_INF = float("inf")


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    skip = {name.lower() for name in exclude}
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name.lower() not in skip]


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, FLOATING)


def quoted(name: str) -> Column:
    """Column reference that survives dots, slashes and spaces in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(column: Column) -> Column:
    """NaN and both infinities become null; anything else is kept."""
    return F.when(~F.isnan(column) & (F.abs(column) != F.lit(PLUS_INF)), column)


def finite_or_null(df: DataFrame, name: str) -> Column:
    """``finite`` for floating columns; integers cannot hold NaN and pass through."""
    return finite(quoted(name)) if is_floating(df, name) else quoted(name)


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN where the type can hold it."""
    column = quoted(name)
    return column.isNull() | F.isnan(column) if is_floating(df, name) else column.isNull()
