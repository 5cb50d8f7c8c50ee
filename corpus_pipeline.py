"""A corpus from raw documents to shards: five stages, each written and read again.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns the documents it
keeps. All but the last return the columns of ``documents``. Any stage takes empty tables, null
texts, repeated rows and extra columns as its operator documents them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.llm import decontaminate, mixing, reshard, similar, toxicity
from flowlens.llm.shared import scratch_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that shares 0.8 or more of its five-word shingles.

    Groups are what SimHash links, with the looser pairs that MinHash adds, confirmed on the shingles.
    """
    return similar.keep_first_similar(docs, words=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their size, shard and slot, from the rewritten files."""
    return reshard.resharded_files(docs).withColumn("size", reshard.text_bytes(F.col("text")))


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("mixing", mix_sources), ("sharding", shard)]

#: SQL can't express the classifier, the draws and the flow.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
