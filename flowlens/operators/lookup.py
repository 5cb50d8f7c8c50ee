"""Joins against small tables that are derived from the data.

Nothing guarantees that such a table is small, so its row count is checked before
it is broadcast. Past the bound the same join runs as an ordinary shuffle join,
where adaptive execution splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_LOOKUP_ROWS = 100_000


def small_copy(table: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame | None:
    """The table as a literal relation, or None if it has more than ``max_rows`` rows.

    Runs the plan behind ``table`` once, so later uses do not scan its input again.
    """
    head = table.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return None
    return table.sparkSession.createDataFrame(head, schema=table.schema)


def join_lookup(df: DataFrame, table: DataFrame, on, how: str = "left",
                max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    small = small_copy(table, max_rows)
    return df.join(table if small is None else F.broadcast(small), on, how)
