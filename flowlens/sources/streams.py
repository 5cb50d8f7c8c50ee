"""Streaming sources of flow messages: files for replay, Kafka for live traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_flow_stream_files(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Replay JSON lines as a stream of (value, timestamp); the time is the file's."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select("value", F.col("_metadata.file_modification_time").alias("timestamp"))


def kafka_source_options(servers: str, topic: str, starting: str = "latest",
                         max_per_trigger: int | None = None) -> dict[str, str]:
    """Options of the Kafka source. ``max_per_trigger`` limits the intake."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": "false",
        "kafka.fetch.min.bytes": "1",
        "kafka.fetch.max.wait.ms": "100",
    }
    if max_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def read_flow_stream_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "latest",
                           max_per_trigger: int | None = None) -> DataFrame:
    """Messages of one topic. Needs Spark's Kafka connector on the class path."""
    options = kafka_source_options(servers, topic, starting, max_per_trigger)
    return spark.readStream.format("kafka").options(**options).load()


def write_messages_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Batch write of (key, value) rows to a topic. Needs the Kafka connector."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
