"""What several operators of this package need: tables, kept copies, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.sources.storage import materialize, scratch_path

__all__ = ["components", "fold_case", "hash128", "materialize", "scratch_path", "table"]

#: The white space that all text contracts use, as characters.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_case(text: Column) -> Column:
    """A to Z in lower case; all other letters stay."""
    return F.translate(text, UPPER, LOWER)


def hash128(*columns: Column | str) -> list[Column]:
    """Two independently seeded 64-bit hashes: equal for equal values, and for nothing else in practice."""
    return [F.xxhash64(*columns).alias("__h1"), F.xxhash64(F.lit("second"), *columns).alias("__h2")]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is its smallest reachable node.

    Alternates the large-star and small-star steps: neighbours are re-hung on the smallest
    one until every edge points from a node to the smallest node of its component. Nodes are
    longs. Each step is a grouped minimum and a join on the same key, so a node with very many
    neighbours is one row per task in the first and split by adaptive execution in the second.
    Each step is written to the shared folder, so a lost executor repeats one step at most.
    Only two sums per round come to the driver.
    """
    def star(pairs: DataFrame, emit: Column) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        joined = pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))
        return joined.select(F.explode(emit).alias("e")).select("e.a", "e.b").where("a != b").distinct()

    def pair(a: str, b: str) -> Column:
        return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where("a != b").distinct(), "edges")
    seen = mark(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, F.when(F.col("v") > F.col("u"), F.array(pair("v", "m"))))
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        now = materialize(star(down, F.array(pair("v", "m"), pair("u", "m"))), "edges")
        seen, last = mark(now), seen
        if seen == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
