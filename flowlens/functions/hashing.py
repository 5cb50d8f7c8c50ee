"""Row-keyed hashes. A row's bucket depends on its key alone, never on partitioning,
task order or a re-run, so splits and samples survive lost executors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def row_key(columns: list[str]) -> Column:
    """Text key of a row; null parts are kept apart from empty ones."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])


def hash32(key: Column, seed: int | None = None) -> Column:
    """Unsigned 32-bit integer from the md5 of the key (and the seed, if any)."""
    text = key if seed is None else F.concat(key, F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def percent_bucket(key: Column, seed: int | None = None) -> Column:
    """0 to 99."""
    return hash32(key, seed) % 100
