"""Column names, identifier removal, feature selection, schema comparison."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.functions.numeric import numeric_columns
from flowlens.schemas import IDENTIFIER_COLUMNS, NON_FEATURE_COLUMNS


def batch_name(name: str) -> str:
    """Lower case letters, digits and single underscores."""
    return re.sub(r"_+", "_", re.sub(r"[^\w]", "_", name)).strip("_").lower()


def stream_name(name: str) -> str:
    """Name a served model expects; the case is kept."""
    return name.strip().replace(" ", "_").replace("/", "_per_").replace(".", "_dot_")


def _rename(df: DataFrame, rule) -> DataFrame:
    names = [rule(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"column names collide after cleaning: {clashes}")
    return df.toDF(*names)


def clean_names_batch(df: DataFrame) -> DataFrame:
    return _rename(df, batch_name)


def clean_names_stream(df: DataFrame) -> DataFrame:
    return _rename(df, stream_name)


def drop_identifiers(df: DataFrame, dataset_or_columns) -> DataFrame:
    """Drop addresses, ids and clock columns; absent ones are ignored."""
    if isinstance(dataset_or_columns, str):
        dataset_or_columns = IDENTIFIER_COLUMNS[dataset_or_columns]
    return df.drop(*dataset_or_columns)


def feature_columns(df: DataFrame, exclude=()) -> list[str]:
    """Every numeric column that is not a label, weight, id or category index."""
    return [c for c in numeric_columns(df, [*NON_FEATURE_COLUMNS, *exclude]) if not c.endswith("_indexed")]


def final_projection(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Features followed by those of ``keep`` that exist."""
    return df.select(*features, *[c for c in keep if c in df.columns and c not in features])


def tag_source(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("dataset_source", F.lit(name))


def schema_diff(left: DataFrame, right: DataFrame) -> dict[str, list[str]]:
    a, b = set(left.columns), set(right.columns)
    return {"common": sorted(a & b), "left_only": sorted(a - b), "right_only": sorted(b - a)}


def schema_diff_table(spark: SparkSession, left: DataFrame, right: DataFrame) -> DataFrame:
    """``schema_diff`` as rows (column_name, side)."""
    rows = [(name, side) for side, names in schema_diff(left, right).items() for name in names]
    schema = T.StructType([T.StructField("column_name", T.StringType()), T.StructField("side", T.StringType())])
    return spark.createDataFrame(rows, schema)
