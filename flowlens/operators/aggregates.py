"""Distributions and summaries of flow and prediction tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F, types as T

from flowlens.functions.numeric import quoted
from flowlens.operators.ordering import range_splits, running_totals

#: Rank error of the sketch that brackets percentiles, as a part of all rows.
RANK_ERROR = 0.001


def class_distribution(df: DataFrame, column: str = "label") -> DataFrame:
    """Count and percent per class, most frequent first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    share = F.lit(100.0) * F.col("count") / F.sum("count").over(Window.partitionBy())  # one row per class
    return counts.withColumn("percent", share).orderBy(F.desc("count"), column)


def distribution_2d(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.groupBy(first, second).agg(F.count(F.lit(1)).alias("count"))


def distribution_matrix(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """``distribution_2d`` as a matrix; naming the column values saves a pass to find them."""
    return df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)


def distinct_labels(df: DataFrame, column: str = "label") -> DataFrame:
    return df.select(column).distinct()


def counts_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset_source").agg(F.count(F.lit(1)).alias("count"))


def dataset_summary(df: DataFrame, name: str) -> DataFrame:
    """One row: dataset, rows, columns and the first ten column names."""
    shown = ", ".join(df.columns[:10]) + ("..." if len(df.columns) > 10 else "")
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        F.lit(name).alias("dataset"), "total_rows",
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"), F.lit(shown).alias("first_columns"))


def dataset_metadata(df: DataFrame, weights: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """One row per class: class, rows, weight, and the table's rows and features."""
    return weights.select(
        F.col(label).cast("string").alias("class_label"), F.col("count").alias("class_rows"), "weight",
        F.sum("count").over(Window.partitionBy()).alias("total_rows"),  # one row per class
        F.lit(len(features)).cast("bigint").alias("total_features"),
        F.lit(", ".join(features)).alias("feature_columns"),
    )


def harmonized_metadata(merged: DataFrame, class_names: dict[int, str]) -> DataFrame:
    """One row per unified class of a harmonised table: name, rows, weight, rows by source."""
    by_source = merged.groupBy("unified_label", "dataset_source").agg(
        F.count(F.lit(1)).alias("n"), F.max("multiclass_weight").alias("weight"))
    names = F.create_map(*[F.lit(v) for entry in class_names.items() for v in entry])
    return by_source.groupBy("unified_label").agg(
        F.sum("n").alias("class_rows"), F.max("weight").alias("weight"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("dataset_source", "n")))).alias("rows_by_source"),
    ).withColumn("class_name", F.coalesce(F.try_element_at(names, F.col("unified_label")), F.lit("Unknown")))


def exact_percentiles(df: DataFrame, column: str, fractions: list[float]) -> list[float | None]:
    """Interpolated percentiles without gathering the column in one buffer.

    Equal values are counted first, then running totals over value ranges tell which
    values sit at the wanted positions. Null and NaN are left out.
    """
    values = df.select(quoted(column).cast("double").alias("value")).where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    return _percentiles(values, values.count(), fractions)


def _brackets(values: DataFrame, total: int, fractions: list[float], wanted: list[int]) -> list[tuple]:
    """Disjoint value ranges (low, high, rows below, rows up to high) that hold the wanted positions.

    A sketch gives them, a count proves them; if a position lies outside, one range holds everything.
    """
    ends = sorted({max(0.0, f - 2 * RANK_ERROR) for f in fractions} | {min(1.0, f + 2 * RANK_ERROR) for f in fractions})
    value = dict(zip(ends, values.approxQuantile("value", ends, RANK_ERROR)))
    spans = sorted((value[max(0.0, f - 2 * RANK_ERROR)], value[min(1.0, f + 2 * RANK_ERROR)]) for f in fractions)
    merged = []
    for low, high in spans:
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    c = F.col("value")
    counts = values.agg(*[count for low, high in merged for count in (F.count_if(c < low), F.count_if(c <= high))]).first()
    found = [(low, high, counts[2 * i], counts[2 * i + 1]) for i, (low, high) in enumerate(merged)]
    held = all(any(below <= p < upto for _, _, below, upto in found) for p in wanted)
    return found if held else [(float("-inf"), float("inf"), 0, total)]


def _percentiles(values: DataFrame, total: int, fractions: list[float]) -> list[float | None]:
    """Only the rows in narrow value ranges around the percentiles are shuffled."""
    if total == 0:
        return [None] * len(fractions)
    positions = [fraction * (total - 1) for fraction in fractions]
    wanted = sorted({p for position in positions for p in (int(position), min(int(position) + 1, total - 1))})
    brackets = _brackets(values, total, fractions, wanted)
    inside = reduce(lambda a, b: a | b, [F.col("value").between(low, high) for low, high, _, _ in brackets])
    counted = values.where(inside).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counted, "value", ["n"], range_splits(counted, "value"))
    at, earlier = {}, 0  # position among the rows inside
    for _, _, below, upto in brackets:
        at |= {p: p - below + earlier for p in wanted if below <= p < upto}
        earlier += upto - below
    found = placed.agg(*[F.max(F.when((F.col("n_before") <= at[p]) & (F.col("n_before") + F.col("n") > at[p]),
                                      F.col("value"))) for p in wanted]).first()
    value = dict(zip(wanted, found))
    return [value[int(p)] + (value[min(int(p) + 1, total - 1)] - value[int(p)]) * (p - int(p)) for p in positions]


def column_summary(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """count, mean, stddev, min, quartiles, max of one column, as one row.

    ``exact=False`` takes the quartiles from Spark's quantile sketch in the same pass.
    """
    values = df.select(quoted(column).cast("double").alias("value"))
    c, quartiles, names = F.col("value"), [0.25, 0.5, 0.75], ["q25", "q50", "q75"]
    stats = [F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("stddev"),
             F.min(c).alias("min"), F.max(c).alias("max")]
    order = ["count", "mean", "stddev", "min", *names, "max"]
    if not exact:
        sketch = values.agg(*stats, F.percentile_approx(c, quartiles, 10_000).alias("_q"))
        return sketch.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]).select(*order)
    row = values.agg(*stats, F.count_if(~F.isnan(c)).alias("_n")).first().asDict()
    row |= zip(names, _percentiles(values.where(c.isNotNull() & ~F.isnan(c)), row["_n"], quartiles))
    schema = T.StructType([T.StructField(n, T.LongType() if n == "count" else T.DoubleType()) for n in order])
    return df.sparkSession.createDataFrame([tuple(row[n] for n in order)], schema)


def prediction_distribution(predictions: DataFrame, prediction: str = "prediction",
                            label: str | None = None) -> DataFrame:
    """Rows per predicted class; with ``label``, also how many of them are right."""
    extra = [] if label is None else [F.count_if(F.col(prediction) == F.col(label)).alias("agreeing")]
    return predictions.groupBy(prediction).agg(F.count(F.lit(1)).alias("count"), *extra)
