"""Duplicates, missing and non-finite values, sparse and constant columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens.functions.numeric import finite_or_null, is_missing, numeric_columns, quoted

LABEL_COLUMNS = ("label", "attack_cat")


def column_means(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Mean of the finite values of every column, in one pass."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(finite_or_null(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def mask_numeric(df: DataFrame, columns: list[str] | None = None, policy: str = "zero",
                 means: dict[str, float | None] | None = None) -> DataFrame:
    """Replace null, NaN and infinite values in one projection.

    ``null`` leaves them as null, ``zero`` writes 0, ``mean`` writes the mean of the
    finite values (taken here unless ``means`` is given), ``drop`` removes the rows.
    """
    columns = numeric_columns(df, LABEL_COLUMNS) if columns is None else columns
    if policy not in ("null", "zero", "mean", "drop"):
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "mean" and means is None:
        means = column_means(df, columns)

    def masked(name):
        value = finite_or_null(df, name)
        if policy == "zero":
            value = F.coalesce(value, F.lit(0).cast(df.schema[name].dataType))
        elif policy == "mean":  # a column without any value has no mean: 0
            value = F.coalesce(value.cast("double"), F.lit(float(means.get(name) or 0.0)))
        return value.alias(name)

    wanted = set(columns)
    result = df.select(*[masked(c) if c in wanted else quoted(c) for c in df.columns])
    return result.dropna(subset=columns) if policy == "drop" else result


def impute(df: DataFrame, strategy: str, columns: list[str] | None = None) -> DataFrame:
    """``drop`` rows with any null (in every column unless some are named),
    ``fill_zero`` or ``fill_mean`` the numeric ones."""
    if strategy == "drop":
        return df.dropna(subset=columns)
    if strategy not in ("fill_zero", "fill_mean"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return mask_numeric(df, columns, strategy.removeprefix("fill_"))


def deduplicate(df: DataFrame) -> DataFrame:
    """Distinct rows. Copies collapse before the shuffle, so a row that makes up a
    third of the input costs one shuffled row per task."""
    return df.dropDuplicates()


def duplicate_report(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows, removed rows and their ratio, in one pass."""
    copies = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
    ).withColumn("removed_rows", F.col("total_rows") - F.col("distinct_rows")).withColumn(
        "removed_ratio", F.coalesce(F.try_divide("removed_rows", "total_rows"), F.lit(0.0)))


def _profile_row(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(is_missing(df, c)).alias(f"_n{i}") for i, c in enumerate(columns)],
    )


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows (column_name, missing, total_rows, missing_ratio); one pass for all columns."""
    columns = [c for c in df.columns if c.lower() not in LABEL_COLUMNS] if columns is None else columns
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("missing"))
                        for i, c in enumerate(columns)])
    return (
        _profile_row(df, columns)
        .select("_rows", F.explode(entries).alias("e"))
        .select("e.column_name", "e.missing", F.col("_rows").alias("total_rows"),
                F.coalesce(F.try_divide("e.missing", "_rows"), F.lit(0.0)).alias("missing_ratio"))
    )


def sparse_columns(df: DataFrame, threshold: float = 0.5) -> list[str]:
    """Columns missing in more than ``threshold`` of the rows; label columns are exempt."""
    columns = [c for c in df.columns if c.lower() not in LABEL_COLUMNS]
    row = _profile_row(df, columns).first()
    total = row["_rows"]
    return [c for i, c in enumerate(columns) if total and row[f"_n{i}"] / total > threshold]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold))


def low_variance_columns(df: DataFrame, threshold: float = 0.01, exclude=()) -> list[str]:
    """Numeric columns whose sample variance (of finite values) is below ``threshold``."""
    columns = numeric_columns(df, [*LABEL_COLUMNS, "sample_weight", "binary_label", *exclude])
    if not columns:
        return []
    row = df.agg(*[F.var_samp(finite_or_null(df, c)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[i] is not None and row[i] < threshold]


def drop_low_variance(df: DataFrame, threshold: float = 0.01, exclude=()) -> DataFrame:
    return df.drop(*low_variance_columns(df, threshold, exclude))
