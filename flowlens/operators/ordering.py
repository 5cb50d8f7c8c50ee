"""Running totals, order statistics and deep pages over a global order.

A window without a partition key would sort everything in one task. These helpers
cut the order into ranges first, so each task sees one range and only per-range
totals (a bounded number of rows) meet in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.moments import literal
from flowlens.sources.storage import materialize

SHALLOW_ROWS = 10_000
MAX_RANGES = 10_000  # bounds the per-range rows that reach the driver


def range_count(df: DataFrame) -> int:
    """Four ranges per shuffle partition, so that hashing the ranges to tasks evens out."""
    return min(4 * max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), MAX_RANGES)


def range_splits(df: DataFrame, key: str, ranges: int | None = None) -> list[float]:
    """Bucketizer splits that hold about the same number of rows. One pass, no shuffle."""
    ranges = ranges or range_count(df)
    probabilities = [i / ranges for i in range(1, ranges)]
    cuts = df.approxQuantile(key, probabilities, 0.5 / ranges)
    inner = sorted(set(cuts)) or [0.0]
    return [float("-inf"), *inner, float("inf")]


def running_totals(values: DataFrame, key: str, measures: list[str], splits: list[float]) -> DataFrame:
    """Add ``<measure>_before``: the measure summed over all smaller keys.

    ``values`` has one row per distinct, non-null key of type double.
    """
    ranged = Bucketizer(splits=splits, inputCol=key, outputCol="_range", handleInvalid="keep").transform(values)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_range").agg(*[F.sum(m).alias(m) for m in measures])
        .select("_range", *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_{m}_start") for m in measures])
    )
    within = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: len(splits) bounds the broadcast. Every range is in ``starts``; a
    # left join adds no null test to one side only, so both sides share one aggregation.
    return ranged.join(F.broadcast(starts), "_range", "left").select(
        *values.columns,
        *[(F.col(f"_{m}_start") + F.coalesce(F.sum(m).over(within), F.lit(0))).alias(f"{m}_before")
          for m in measures],
    )


def numbered(df: DataFrame, order: list[Column], output: str) -> DataFrame:
    """Add the row's number (from 0) in the order of ``order``, which must have no ties.

    Rows are spread over tasks by ranges of the order and written, so that a task that runs again
    finds the same ranges; one count per task gives where its numbers begin.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(  # one row per task that wrote
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.join(starts, "_part").select(*df.columns, number.alias(output))


def _struct_key(columns: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def _order(columns: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in columns]


def _between(df: DataFrame, keys: list[str], low, high) -> Column:
    """Rows whose key tuple lies within [low, high].

    The bounds on the first key alone are implied, but unlike the comparison of the
    whole tuple they can be pushed to the scan.
    """
    def bound(row):
        return [literal(row[k], df.schema[k].dataType) for k in keys]

    def tuple_of(columns):
        return F.struct(*[c.alias(k) for k, c in zip(keys, columns)])

    first, lower, upper = F.col(keys[0]), bound(low), bound(high)
    exact = _struct_key(keys).between(tuple_of(lower), tuple_of(upper))
    if low[keys[0]] is None or high[keys[0]] is None:
        return exact
    return first.between(lower[0], upper[0]) & exact


def key_ranges(df: DataFrame, keys: list[str], descending: bool, ranges: int) -> list:
    """Rows (rows, low, high) of disjoint key ranges in sort order, one per range."""
    parts = df.select(*keys).repartitionByRange(ranges, *_order(keys, descending))
    key = _struct_key(keys)
    stats = parts.groupBy(F.spark_partition_id().alias("_part")).agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    return stats.orderBy("_part").collect()


def weighted_span(weights: DataFrame, keys: list[str], weight: str, descending: bool, offset: int, size: int,
                  ranges: int | None = None):
    """(rows before, lowest key, highest key) of the groups that hold rows ``offset`` to ``offset + size``.

    ``weights`` has one row per key with its number of rows. Its order is cut into ranges again and again until
    the page's groups are found; one small row per range reaches the driver. None if the rows end before.
    """
    ranges, before, last = ranges or range_count(weights), 0, None
    while True:
        parts = weights.repartitionByRange(ranges, *_order(keys, descending))
        key = _struct_key(keys)
        stats = parts.groupBy(F.spark_partition_id().alias("_part")).agg(
            F.sum(weight).alias("n"), F.count(F.lit(1)).alias("groups"), F.min(key).alias("low"), F.max(key).alias("high"))
        seen, wanted, first = before, [], None
        for row in stats.orderBy("_part").collect():
            if seen + row["n"] > offset and seen < offset + size:
                first = seen if first is None else first
                wanted.append(row)
            seen += row["n"]
        if not wanted:
            return None
        before, groups = first, sum(row["groups"] for row in wanted)
        ends = (wanted[-1], wanted[0]) if descending else (wanted[0], wanted[-1])
        low, high = ends[0]["low"], ends[1]["high"]
        if groups == len(wanted) or groups == last:
            return before, low, high
        weights, last = weights.where(_between(weights, keys, low, high)), groups


def seek_page(df: DataFrame, keys: list[str], descending: bool, offset: int, size: int,
              shallow: int = SHALLOW_ROWS, ranges: int | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` of the order given by ``keys``.

    The keys together must be unique. Offsets up to ``shallow`` run as one top-k.
    A deeper page first finds the key range it starts in, from one small row per
    range, and then reads that range only; the skipped rows never leave the executors.
    """
    ranges = ranges or range_count(df)
    if offset > shallow:
        stats = key_ranges(df, keys, descending, ranges)
        seen, wanted = 0, []
        for row in stats:
            if seen + row["n"] > offset and seen < offset + size:
                wanted.append((seen, row))
            seen += row["n"]
        if not wanted:
            return df.limit(0)
        skipped = wanted[0][0]
        tests = [_between(df, keys, row["low"], row["high"]) for _, row in wanted]
        narrowed = df.where(reduce(lambda a, b: a | b, tests))
        inside = sum(row["n"] for _, row in wanted)
        if offset - skipped > shallow and inside < seen:
            return seek_page(narrowed, keys, descending, offset - skipped, size, shallow, ranges)
        df, offset = narrowed, offset - skipped
    return df.orderBy(*_order(keys, descending)).offset(offset).limit(size)
