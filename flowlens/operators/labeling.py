"""Class ids, class weights and the harmonised label space of several datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from flowlens.functions import labels as L
from flowlens.operators.columns import tag_source
from flowlens.operators.lookup import join_lookup
from flowlens.schemas import UNIFIED_LABELS_2017, UNIFIED_LABELS_2018, UNSW_LABELS

# Dataset to (label list, id of a label in no list).
LABEL_SPACES = {
    "cicids2017": (UNIFIED_LABELS_2017, 8),
    "cicids2018": (UNIFIED_LABELS_2018, 8),
    "unsw": (UNSW_LABELS, 0),
}


def standardize_label(df: DataFrame, column: str = "label") -> DataFrame:
    return df.withColumn(column, L.standard_label(F.col(column))) if column in df.columns else df


def add_binary_label(df: DataFrame, column: str = "label", normal_values=("benign", "normal"),
                     output: str = "binary_label") -> DataFrame:
    return df.withColumn(output, L.binary_label(F.col(column), normal_values))


def add_label_text(df: DataFrame) -> DataFrame:
    """``label_text`` from a 0/1 label and its category, or from the category alone."""
    text = L.label_text(F.col("label"), F.col("attack_cat")) if "label" in df.columns else F.col("attack_cat")
    return df.withColumn("label_text", text)


def normalize_attack_cat(df: DataFrame, column: str = "attack_cat") -> DataFrame:
    return df.withColumn(column, L.normal_when_blank(F.col(column)))


def map_labels(df: DataFrame, dataset: str, column: str = "label", output: str = "unified_label",
               default: int | None = None) -> DataFrame:
    classes, fallback = LABEL_SPACES[dataset]
    return df.withColumn(output, L.class_lookup(F.col(column), classes, fallback if default is None else default))


def prepare_unsw_labels(df: DataFrame) -> DataFrame:
    """Category, double binary label and double class id used to train the UNSW models."""
    named = map_labels(normalize_attack_cat(df), "unsw", "attack_cat", "multiclass_label")
    return named.withColumn("multiclass_label", F.col("multiclass_label").cast("double")).withColumn(
        "binary_label", L.exact_binary_label(F.col("attack_cat"), "Normal").cast("double"))


def class_weights(df: DataFrame, label: str = "label", scheme: str = "inverse",
                  output: str = "weight") -> DataFrame:
    """One row per class: label, count, weight.

    ``inverse`` is max/count; ``sqrt`` is sqrt(total / (classes * count)); ``sqrt2``
    the same with two classes whatever the data holds.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    everything = Window.partitionBy()  # one row per class
    total = F.sum("count").over(everything)
    if scheme == "inverse":
        weight = F.max("count").over(everything) / F.col("count")
    elif scheme == "sqrt":
        weight = F.sqrt(total / (F.count(F.lit(1)).over(everything) * F.col("count")))
    elif scheme == "sqrt2":
        weight = F.sqrt(total / (F.lit(2) * F.col("count")))
    else:
        raise ValueError(f"unknown weight scheme {scheme!r}")
    return counts.withColumn(output, weight)


def attach_weights(df: DataFrame, weights: DataFrame, label: str = "label", output: str = "sample_weight",
                   default: float | None = 1.0) -> DataFrame:
    """Weight of each row's class, in place of an earlier one. Classes without a weight get
    ``default``, or null."""
    df = df.drop(output)
    table = weights.select(F.col(label), F.col("weight").alias(output))
    joined = join_lookup(df, table, label)
    value = F.col(output) if default is None else F.coalesce(F.col(output), F.lit(default))
    return joined.select(*df.columns, value.alias(output))


def align_columns(frames: list[DataFrame]) -> list[DataFrame]:
    """The columns all frames share, in one sorted order."""
    common = reduce(lambda a, b: [c for c in a if c in set(b)], [sorted(f.columns) for f in frames])
    return [f.select(*common) for f in frames]


def union_harmonized(datasets: dict[str, DataFrame], column: str = "label") -> DataFrame:
    """Datasets in the unified label space, tagged by source, reduced to shared columns."""
    labelled = [tag_source(map_labels(df, name, column), name) for name, df in datasets.items()]
    return reduce(DataFrame.unionByName, align_columns(labelled))


def harmonize(datasets: dict[str, DataFrame], column: str = "label") -> DataFrame:
    """``union_harmonized`` with ``multiclass_weight`` per unified class."""
    merged = union_harmonized(datasets, column)
    return attach_weights(merged, class_weights(merged, "unified_label"), "unified_label", "multiclass_weight")
