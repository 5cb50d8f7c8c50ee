"""A table that grows by overlapping batches holds what deduplicating all of them gives."""

from collections import Counter

from frames import rows

from flowlens.operators.cleaning import deduplicate
from flowlens.sources import distinct_table as dt

SCHEMA = "a string, `b.c` string, x double, n long"
NAN = float("nan")


def as_text(df):
    return Counter(tuple(str(v) for v in r) for r in rows(df))


def test_overlapping_batches_equal_deduplicate_of_all(spark, folder):
    path = f"{folder}/table"
    batches = [
        [("p", None, 1.0, 1), (None, "p", 1.0, 1), ("p", None, 1.0, 1), ("", None, None, None), (None, None, None, None)],
        [("p", None, 1.0, 1), ("q", "", NAN, 2), ("q", "", 0.0, 2), (None, "", None, None)] + [("hot", "h", 2.0, 3)] * 500,
        [],
        [("q", "", NAN, 2), ("q", "", -0.0, 2), ("hot", "h", 2.0, 3), ("pq", "", 0.5, 2), ("p", "q", 0.5, 2)],
    ]
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    everything = frames[0]
    for n, frame in enumerate(frames):
        everything = everything.union(frame)
        dt.append_distinct(frame, path, n)
        dt.append_distinct(frame, path, n)  # a repeated batch replaces itself
    found, expected = dt.read_distinct(spark, path), deduplicate(everything)
    assert as_text(found) == as_text(expected) and found.columns == expected.columns
    dt.append_distinct(frames[0], path, 0)  # also long after
    assert as_text(dt.read_distinct(spark, path)) == as_text(expected)


def test_only_hashes_of_stored_rows_are_read(spark, folder):
    path = f"{folder}/table"
    dt.append_distinct(spark.range(100).selectExpr("id", "id % 7 as k"), path, 0)
    stored = spark.read.parquet(path)
    new = dt.deduplicate_increment(spark.range(50, 150).selectExpr("id", "id % 7 as k"), stored)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    scans = [s for s in new._jdf.queryExecution().explainString(mode).splitlines() if "ReadSchema" in s]
    assert scans == ["ReadSchema: struct<_row_hash1:bigint,_row_hash2:bigint>"]
    assert sorted(rows(new, "id")) == [(n,) for n in range(100, 150)]
