"""Category indexes, feature vectors and scaling."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from flowlens.operators.lookup import join_lookup
from flowlens.operators.ordering import numbered
from flowlens.sources.storage import materialize

MAX_CATEGORIES = 100_000


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column_name, value, count) for all columns in one pass; nulls left out."""
    return (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], columns, "column_name", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    )


def fit_category_index(df: DataFrame, columns: list[str], suffix: str = "_indexed",
                       max_categories: int = MAX_CATEGORIES) -> StringIndexerModel | PipelineModel:
    """Most frequent value first, ties by value; unseen and null values come last.

    Counting is a grouped aggregation. Only the category lists reach the driver, and
    a column with more than ``max_categories`` values is refused instead of collected:
    ``index_by_rank`` takes any number. Several columns give a pipeline of one model each:
    lists handed to one model are filled up to the longest with nulls, which then count as
    categories and can't be written to a table.
    """
    ordered = category_counts(df, columns).orderBy("column_name", F.desc("count"), "value")
    rows = ordered.limit(max_categories * len(columns) + 1).collect()
    labels = {c: [r["value"] for r in rows if r["column_name"] == c] for c in columns}
    too_many = [c for c in columns if len(labels[c]) > max_categories]
    if too_many or len(rows) > max_categories * len(columns):
        raise ValueError(f"more than {max_categories} categories in {too_many or columns}")
    models = [StringIndexerModel.from_labels(labels[c], inputCol=c, outputCol=c + suffix, handleInvalid="keep")
              for c in columns]
    return models[0] if len(models) == 1 else PipelineModel(models)


def category_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column_name, value, rank) with the indexes of ``fit_category_index``, for any number of values."""
    order = [F.col("column_name"), F.desc("count"), F.col("value")]
    ranked = numbered(category_counts(df, columns), order, "_number")
    first = ranked.groupBy("column_name").agg(F.min("_number").alias("_first"))  # one row per column
    return ranked.join(F.broadcast(first), "column_name").select(
        "column_name", "value", (F.col("_number") - F.col("_first")).cast("double").alias("rank"))


def index_by_rank(df: DataFrame, columns: list[str], ranks: DataFrame | None = None, suffix: str = "_indexed") -> DataFrame:
    """``index_categories`` by joins: no list of values on the driver, and no bound on their number.

    Unseen and null values get the number of known ones.
    """
    ranks = materialize(category_ranks(df, columns) if ranks is None else ranks, "category_ranks")
    known = {r["column_name"]: r["n"] for r in ranks.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = df
    for c in columns:
        values = ranks.where(F.col("column_name") == c).select(F.col("value").alias("_value"), F.col("rank").alias(c + suffix))
        found = join_lookup(found, values, F.col(c).cast("string") == F.col("_value")).drop("_value")
    return found.na.fill({c + suffix: float(known.get(c, 0)) for c in columns})


def index_categories(df: DataFrame, columns: list[str], model: StringIndexerModel | PipelineModel | None = None,
                     replace: bool = False) -> DataFrame:
    """Add ``<column>_indexed``, or with ``replace`` put the index in the column's place."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    indexed = (model or fit_category_index(df, columns)).transform(df)
    if not replace:
        return indexed
    return indexed.select(*[F.col(c + "_indexed").alias(c) if c in columns else F.col(c) for c in df.columns])


def assembler(columns: list[str], invalid: str = "skip", output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid=invalid)


def assemble(df: DataFrame, columns: list[str], invalid: str = "skip", output: str = "features") -> DataFrame:
    """``skip`` drops rows with null or NaN, ``keep`` turns null into NaN, ``error`` raises."""
    return assembler(columns, invalid, output).transform(df)


def fit_scaler(train: DataFrame, columns: list[str], invalid: str = "skip", features: str = "features",
               output: str = "scaled_features") -> PipelineModel:
    """Assembler and z-score scaler fitted on ``train``; apply it to any split."""
    vector = assembler(columns, invalid, features)
    scaler = StandardScaler(inputCol=features, outputCol=output, withMean=True, withStd=True)
    return PipelineModel([vector, scaler.fit(vector.transform(train))])


def standardize(df: DataFrame, columns: list[str], train: DataFrame | None = None, **options) -> DataFrame:
    return fit_scaler(df if train is None else train, columns, **options).transform(df)
