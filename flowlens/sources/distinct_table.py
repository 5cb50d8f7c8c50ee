"""A stored table of distinct rows that grows by batches.

A batch's folder ``batch_id=B`` holds the rows that no other batch held when it was written, each beside two 64-bit
hashes of the whole row. A new batch is compared with the stored hashes, 16 bytes a row, so neither the stored rows
nor their columns are read or shuffled again. Writing a batch again replaces its folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.functions.numeric import quoted
from flowlens.operators.cleaning import deduplicate
from flowlens.sources.storage import matching

HASHES = ["_row_hash1", "_row_hash2"]


def with_hashes(rows: DataFrame) -> DataFrame:
    """Rows with a 128-bit hash of all columns. Nulls are named apart, since a hash function skips them;
    both zeros are one value and so are all NaNs, as they are to ``deduplicate``."""
    def value(field: T.StructField):
        column = quoted(field.name)
        return column + F.lit(0.0).cast(field.dataType) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else column

    gaps = F.concat(F.lit(""), *[F.when(quoted(c).isNull(), "1").otherwise("0") for c in rows.columns])
    parts = [gaps, *map(value, rows.schema.fields)]
    return rows.select("*", F.xxhash64(*parts).alias(HASHES[0]), F.xxhash64(F.lit("second"), *parts).alias(HASHES[1]))


def deduplicate_increment(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The distinct rows whose hash ``stored`` lacks, with their hashes.

    ``stored`` needs the two hash columns only. It has each hash once, so a row that makes up a third of the
    new rows is one row per task when it is shuffled, and one row when it meets the stored ones.
    """
    return with_hashes(deduplicate(rows)).join(stored.select(*HASHES), HASHES, "left_anti")


def append_distinct(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the rows that no other batch of the table holds as batch ``batch_id``."""
    spark = rows.sparkSession
    others = [p for p in matching(spark, f"{path}/batch_id=*") if p.rsplit("=", 1)[1] != str(batch_id)]
    hashes = T.StructType([T.StructField(c, T.LongType()) for c in HASHES])
    stored = spark.read.schema(hashes).parquet(*others) if others else spark.createDataFrame([], hashes)
    deduplicate_increment(rows, stored).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_distinct(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the table, without their hashes and batch."""
    return spark.read.parquet(path).drop(*HASHES, "batch_id")
