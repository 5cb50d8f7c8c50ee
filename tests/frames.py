"""Helpers that several test modules import; fixtures are in conftest.py."""


def rows(df, *columns):
    """Rows as tuples, in the frame's order."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
