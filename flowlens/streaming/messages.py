"""JSON flow messages to typed rows, in batch and streaming alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _parsed(schema: T.StructType) -> Column:
    """The message as an array of one struct. As an array element it can be tested
    field by field while the text is parsed once."""
    return F.array(F.from_json(F.col("value").cast("string"), schema))


def _holds_data(schema: T.StructType):
    return lambda message: F.greatest(F.lit(False), *[message[f.name].isNotNull() for f in schema.fields])


def _source_columns(messages: DataFrame) -> list[Column]:
    return [F.col(c).alias("kafka_timestamp" if c == "timestamp" else c)
            for c in messages.columns if c not in ("key", "value")]


def parse_flow_json(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """Fields of the message beside the source's other columns; ``timestamp`` of the source
    becomes ``kafka_timestamp``. Keys outside ``schema`` are ignored, and messages that hold
    none of its fields (broken lines among them) are left out: see ``rejected_flow_json``."""
    return messages.select(F.inline(F.filter(_parsed(schema), _holds_data(schema))), *_source_columns(messages))


#: Column that carries the parsed message, an empty array if nothing of it could be used.
PARSED = "_parsed"


def route_flow_json(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """The messages with what ``parse_flow_json`` makes of them, parsed once for both of the next two."""
    return messages.withColumn(PARSED, F.filter(_parsed(schema), _holds_data(schema)))


def accepted_flows(routed: DataFrame) -> DataFrame:
    """The rows of ``parse_flow_json``."""
    return routed.select(F.inline(PARSED), *_source_columns(routed.drop(PARSED)))


def rejected_messages(routed: DataFrame) -> DataFrame:
    """The rows of ``rejected_flow_json``. A null message has a null in place of the array."""
    return routed.where(~is_accepted()).drop(PARSED)


def is_accepted() -> Column:
    return F.coalesce(F.size(PARSED), F.lit(0)) > 0


def rejected_flow_json(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """The messages ``parse_flow_json`` leaves out, as they came."""
    return messages.where(~F.exists(_parsed(schema), _holds_data(schema)))
