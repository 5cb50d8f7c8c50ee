"""Preprocessing of a raw flow table into a training table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions.labels import binary_label, exact_binary_label
from flowlens.operators import aggregates, cleaning, columns, features, labeling
from flowlens.schemas import CLASS_NAMES
from flowlens.sources.flows import read_dataset, read_processed, verify_written, write_metadata, write_processed
from flowlens.sources.storage import materialize


@dataclass(frozen=True)
class Recipe:
    """What differs between datasets and variants. All column names are cleaned ones.

    drop                identifier columns to leave out
    categories          text columns to index; with ``replace_categories`` the index
                        takes the column's place and is a feature
    label               the class column weights and metadata refer to
    normal_values       labels of normal traffic, in any case
    exact_normal        instead: the one label of normal traffic, to the letter; labels
                        are then kept as they are
    weight_on           column whose classes are weighted, by default ``label``
    imputation          what missing and non-finite numbers become: zero or mean
    sparse_threshold    drop columns missing in more than this share; None keeps all
    """

    name: str
    drop: tuple = ()
    categories: tuple = ()
    replace_categories: bool = False
    label: str = "label"
    normal_values: tuple = ("benign",)
    exact_normal: str | None = None
    weight_on: str | None = None
    imputation: str = "zero"
    sparse_threshold: float | None = 0.5


_MEAN = {"imputation": "mean", "sparse_threshold": None, "weight_on": "binary_label"}

RECIPES = {
    "cicids2017": Recipe("cicids2017"),
    "cicids2018": Recipe("cicids2018", drop=("flow_id", "src_ip", "src_port", "dst_ip", "timestamp")),
    "unsw": Recipe("unsw", drop=("srcip", "dstip", "stime", "ltime", "id"),
                   categories=("proto", "service", "state"), label="label_text",
                   normal_values=("normal", "benign")),
}
# Variants that fill with the mean and weight attack against normal.
RECIPES |= {
    "cicids2017_mean": replace(RECIPES["cicids2017"], name="cicids2017_mean", exact_normal="BENIGN", **_MEAN),
    "cicids2018_mean": replace(RECIPES["cicids2018"], name="cicids2018_mean", exact_normal="Benign", **_MEAN),
    "unsw_mean": replace(RECIPES["unsw"], name="unsw_mean", replace_categories=True, **_MEAN),
}


@dataclass
class Prepared:
    """Result of ``preprocess``: the table, its class weights, features and scaler."""

    table: DataFrame
    weights: DataFrame
    features: list[str]
    scaler: PipelineModel


def name_and_index(raw: DataFrame, recipe: Recipe) -> DataFrame:
    """Cleaned names, identifiers dropped, categories indexed by their raw frequency."""
    df = columns.drop_identifiers(columns.clean_names_batch(raw), list(recipe.drop))
    return features.index_categories(df, list(recipe.categories), replace=recipe.replace_categories)


def clean_flows(named: DataFrame, recipe: Recipe) -> DataFrame:
    """Label text, then duplicates out, then non-finite values to null. No job runs."""
    if "attack_cat" in named.columns:
        labelled = labeling.add_label_text(labeling.standardize_label(named, "attack_cat"))
    elif recipe.exact_normal is not None:
        labelled = named
    else:
        labelled = labeling.standardize_label(named, "label")
    return cleaning.mask_numeric(cleaning.deduplicate(labelled), policy="null")


def add_labels(df: DataFrame, recipe: Recipe) -> DataFrame:
    """``binary_label`` always; a numeric ``label`` where the data has one beside its category."""
    if recipe.label == "label_text" and "label" in df.columns:
        return df.withColumn("label", F.col("label").cast("int")).withColumn("binary_label", F.col("label"))
    source = F.col(recipe.label)
    if recipe.exact_normal is not None:
        return df.withColumn("binary_label", exact_binary_label(source, recipe.exact_normal))
    labelled = df.withColumn("binary_label", binary_label(source, recipe.normal_values))
    return labelled.withColumn("label", F.col("binary_label")) if recipe.label == "label_text" else labelled


def preprocess(raw: DataFrame, dataset: str | Recipe) -> Prepared:
    """Clean, de-duplicate, impute, label, weight and scale.

    The de-duplicated rows are stored once in the shared folder. Every later pass
    (missing profile or means, class counts, scaler) reads its own columns from that
    copy instead of repeating the scan and the full-row shuffle.
    """
    recipe = RECIPES[dataset] if isinstance(dataset, str) else dataset
    df = materialize(clean_flows(name_and_index(raw, recipe), recipe), f"clean-{recipe.name}")
    if recipe.sparse_threshold is not None:
        df = cleaning.drop_sparse_columns(df, recipe.sparse_threshold)
    filled = add_labels(cleaning.mask_numeric(df, policy=recipe.imputation), recipe)
    weight_on = recipe.weight_on or recipe.label
    weights = labeling.class_weights(filled, weight_on)
    weighted = labeling.attach_weights(filled, weights, weight_on)
    names = columns.feature_columns(weighted)
    scaler = features.fit_scaler(filled, names)
    table = columns.final_projection(scaler.transform(weighted), names, [
        "label", "binary_label", "sample_weight", "features", "scaled_features", "label_text", "attack_cat",
        *[c + "_indexed" for c in recipe.categories]])
    return Prepared(table, weights, names, scaler)


def write_prepared(prepared: Prepared, folder: str, name: str, partitions: int | None = None) -> None:
    """Table, class description and scaler under ``folder``."""
    base = f"{folder.rstrip('/')}/{name}"
    write_processed(prepared.table, f"{base}_preprocessed.parquet", partitions)
    weighted_column = prepared.weights.columns[0]
    write_metadata(aggregates.dataset_metadata(prepared.table, prepared.weights, prepared.features, weighted_column),
                   f"{base}_metadata")
    prepared.scaler.write().overwrite().save(f"{base}_scaler")


def preprocess_folder(spark: SparkSession, source: str, target: str, recipe: str) -> Prepared:
    """Read a published dataset from CSV, preprocess it and store the result."""
    prepared = preprocess(read_dataset(spark, source, recipe.removesuffix("_mean")), recipe)
    write_prepared(prepared, target, recipe)
    return prepared


def harmonize_processed(spark: SparkSession, folder: str, target: str, files: int | None = None) -> DataFrame:
    """Unite the processed CIC tables of both years, store table and description, verify the rows."""
    tables = {name: read_processed(spark, f"{folder.rstrip('/')}/{name}_preprocessed.parquet")
              for name in ("cicids2017", "cicids2018")}
    merged = labeling.harmonize(tables)
    path = f"{target.rstrip('/')}/cicids_merged_harmonized"
    write_processed(merged, path, files)
    stored = read_processed(spark, path)
    write_metadata(aggregates.harmonized_metadata(stored, CLASS_NAMES["cic_unified"]), f"{path}_metadata")
    expected = sum(t.count() for t in tables.values())  # from the Parquet footers
    if not verify_written(spark, path, expected).first()["verified"]:
        raise RuntimeError(f"{path} does not hold {expected} rows")
    return stored
