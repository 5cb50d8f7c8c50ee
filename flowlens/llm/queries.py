"""The registered queries opN_<name>: each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.llm import (
    chat, decontaminate, ego_join, hard_negatives, line_dedup, mixing, rank_bpe, reshard, simhash, token_alignment,
    token_ids, toxicity, warc,
)
from flowlens.llm.shared import materialize, scratch_path, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_digests(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = "</s>[INST] ok [/INST]"  # a text made of the template's own marks
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)],
                                  "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted_files(chat.log_of(conversations.union(extra))))


def op5_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reshard.resharded_files(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", reshard.text_bytes(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "old_shard")


def op6_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.resolve_revisits(table(spark, sf_dir, "pages")), path)
    return warc.resolved_records(warc.read_archives(spark, path, with_payload=False)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = rank_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")
    return rank_bpe.decode(encoded).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_alignment.align(table(spark, sf_dir, "documents"))
    digests = aligned.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    return token_alignment.rate(materialize(digests, "aligned")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_simhash, op3_token_ids, op4_chat, op5_reshard, op6_ego_join, op7_toxicity, op8_cube_mix,
    op9_line_dedup, op10_warc, op11_rank_bpe, op12_hard_negatives, op13_token_alignment)}
