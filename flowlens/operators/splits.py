"""Train/test splits and samples that depend on row keys, not on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.hashing import hash32, percent_bucket, row_key
from flowlens.operators.lookup import join_lookup
from flowlens.sources.storage import materialize


def hash_split(df: DataFrame, key: list[str], train_percent: int = 80,
               seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    bucket = percent_bucket(row_key(key), seed)
    return df.where(bucket < train_percent), df.where(bucket >= train_percent)


def random_split(df: DataFrame, weights=(0.8, 0.2), seed: int = 42) -> list[DataFrame]:
    """Spark's own split; its outcome changes with the partitioning of the input."""
    return df.randomSplit(list(weights), seed)


def random_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Spark's own sample; its outcome changes with the partitioning of the input."""
    return df.sample(fraction=fraction, seed=seed)


def hash_sample(df: DataFrame, key: list[str], fraction: float, seed: int | None = None) -> DataFrame:
    """About ``fraction`` of the rows, the same ones on every run."""
    return df.where(hash32(row_key(key), seed) < int(fraction * 2**32))


def _same_class(label: str, table: DataFrame) -> tuple[DataFrame, Column]:
    """The class table under another name, and the null-safe match with ``label``."""
    return table.withColumnRenamed(label, "_class"), F.col(label).eqNullSafe(F.col("_class"))


def cut_rows(df: DataFrame, label: str, key: list[str], fraction: float, seed: int | None = None,
             bits: int = 16) -> DataFrame:
    """(label, _hash, _key, _n, _need): the keys whose hash is that at which their class is cut.

    Counting the first ``bits`` of the hashes finds the slice that holds a class's cut; only this slice's
    rows are kept, a row per key, and their next bits counted, until all 32 are known. What is left are
    keys of one hash per class. ``_need`` is the number of rows to take from them; ``_n`` the rows of a key.
    """
    pool = df.select(label, row_key(key).alias("_key")).select(
        label, "_key", hash32(F.col("_key"), seed).alias("_hash"), F.lit(1).cast("bigint").alias("_n"))
    need, shift = F.floor(F.lit(fraction) * F.sum("_n").over(Window.partitionBy(label))), 32
    while shift:
        first, shift = shift == 32, max(shift - bits, 0)
        slice_of = F.shiftright("_hash", shift)
        carried = [] if first else [F.first("_need").alias("_need")]
        slices = (
            pool.groupBy(label, slice_of.alias("_cut")).agg(F.sum("_n").alias("_n"), *carried)
            .withColumn("_upto", F.sum("_n").over(Window.partitionBy(label).orderBy("_cut")))
            .withColumn("_need", need if first else F.col("_need"))
        )
        cut = slices.where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need"))
                           ).select(label, "_cut", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need"))
        inside = join_lookup(pool.drop("_need"), *_same_class(label, cut)).where(slice_of == F.col("_cut"))
        pool = inside.groupBy(label, "_hash", "_key").agg(F.sum("_n").alias("_n"), F.first("_need").alias("_need"))
        if first:  # later rounds read one part in 2**bits
            pool = materialize(pool, "cut")
    return pool


def mark_stratified(df: DataFrame, label: str, key: list[str], fraction: float = 0.8,
                    seed: int | None = None, bits: int = 16, output: str = "is_train") -> DataFrame:
    """Mark exactly floor(fraction * n) rows of each class, lowest hashes first.

    Ranking a class in one window would put its rows in one task. ``cut_rows`` selects the keys of
    the one hash at which a class is cut; these alone are ranked, and all rows are then compared
    with the last key taken. Rows with the same key stay on the same side.
    """
    marked = df.withColumn("_key", row_key(key)).withColumn("_hash", hash32(F.col("_key"), seed))
    by_hash = Window.partitionBy(label).orderBy("_hash", "_key")
    last = (
        cut_rows(df, label, key, fraction, seed, bits)
        .withColumn("_before", F.sum("_n").over(by_hash) - F.col("_n"))
        .where(F.col("_before") < F.col("_need"))
        .groupBy(label).agg(F.max(F.struct("_hash", "_key")).alias("_last"))
    )
    side = F.coalesce(F.struct("_hash", "_key") <= F.col("_last"), F.lit(False))
    return join_lookup(marked, *_same_class(label, last)).withColumn(output, side).select(*df.columns, output)


def stratified_split(df: DataFrame, label: str, key: list[str], fraction: float = 0.8,
                     seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    marked = mark_stratified(df, label, key, fraction, seed)
    return (marked.where("is_train").drop("is_train"), marked.where("not is_train").drop("is_train"))


def missing_classes(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Classes of ``test`` that ``train`` lacks; null counts as a class."""
    present, match = _same_class(label, train.select(label).distinct())
    return join_lookup(test.select(label).distinct(), present, match, "left_anti")


def rebalance_missing(train: DataFrame, test: DataFrame, key: list[str], label: str = "label",
                      fraction: float = 0.5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Move ``fraction`` of the test rows of every missing class to train.

    Whether a row moves follows from its class and key, so both results come from
    one marked frame and no row is compared with another.
    """
    lacking, match = _same_class(label, missing_classes(train, test, label).withColumn("_lacking", F.lit(True)))
    chosen = hash32(row_key(key), seed) < int(fraction * 2**32)
    moves = F.coalesce(F.col("_lacking"), F.lit(False)) & chosen
    marked = join_lookup(test, lacking, match).withColumn("_moves", moves)
    moved = marked.where("_moves").select(*test.columns)
    return train.unionByName(moved), marked.where("not _moves").select(*test.columns)
