import random

import numpy as np
import pytest
from frames import rows
from pyspark.sql import functions as F

from flowlens.operators import aggregates as agg
from flowlens.operators import alerts as al
from flowlens.operators import features
from flowlens.operators.aggregates import exact_percentiles
from flowlens.operators.ordering import numbered, range_splits, running_totals, seek_page


def hot_values(n, seed=7):
    """A third of the values are one number."""
    rng = random.Random(seed)
    return [0.25 if rng.random() < 0.34 else round(rng.gauss(0, 5), 3) for _ in range(n)]


def test_running_totals_equal_a_global_window(spark):
    values = hot_values(3000)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    counted = df.groupBy("v").agg(F.count("*").alias("n"))
    found = {r["v"]: r["n_before"] for r in running_totals(counted, "v", ["n"], range_splits(df, "v", 9)).collect()}
    ordered = sorted(values)
    assert found == {v: ordered.index(v) for v in set(values)}


@pytest.mark.parametrize("values", [[3.0], [2.0] * 50, [1.0, 2.0], hot_values(2001)])
def test_exact_percentiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    fractions = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    assert agg.exact_percentiles(df, "v", fractions) == pytest.approx(list(np.quantile(values, fractions)))


def test_percentiles_of_nothing(spark):
    assert agg.exact_percentiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_approximate_summary(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    exact, sketch = agg.column_summary(df, "v").first(), agg.column_summary(df, "v", exact=False).first()
    assert (exact["q25"], exact["q50"], exact["q75"]) == (250.0, 500.0, 750.0)
    assert sketch["q50"] == pytest.approx(500.0, abs=1.0)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("offset", [0, 7, 150, 333, 695, 700, 5000])
def test_seek_page_equals_sorting(spark, descending, offset):
    rng = random.Random(3)
    data = [(i, None if i % 11 == 0 else rng.choice(["hot", "hot", "a", "b", "c"])) for i in range(700)]
    df = spark.createDataFrame(data, "id bigint, kind string").repartition(5)
    key = lambda r: ((r[1] is not None, r[1] or ""), r[0])
    expected = sorted(data, key=key, reverse=descending)[offset:offset + 10]
    found = seek_page(df, ["kind", "id"], descending, offset, 10, shallow=20, ranges=4)
    assert rows(found) == expected


def test_page_across_two_ranges(spark):
    df = spark.range(1000).withColumnRenamed("id", "event_id")
    for number in range(1, 25):
        found = rows(al.page(df, "event_id", "asc", number, 41, shallow=10, ranges=6))
        start = (number - 1) * 41
        assert found == [(i,) for i in range(start, min(start + 41, 1000))]


def test_page_count(spark):
    df = spark.range(101)
    assert rows(al.page_count(df, 50)) == [(101, 3)]


def test_equal_values_leave_the_ranges_to_the_others(spark):
    """99 % zeros: cuts are taken over distinct values, so the rest still spreads over many ranges."""
    df = spark.range(200_000).select(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(0).cast("double").alias("score"),
                                     (F.col("id") % 300 == 0).cast("double").alias("label"))
    distinct = df.select("score").distinct()
    assert len(range_splits(distinct, "score", 800)) > 700
    found = exact_percentiles(df, "score", [0.0, 0.5, 0.99, 0.995, 1.0])
    values = [r[0] for r in df.select("score").orderBy("score").collect()]
    assert found == pytest.approx(list(np.quantile(values, [0.0, 0.5, 0.99, 0.995, 1.0])))


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i % 3) for i in range(1000)], "a int, b int").repartition(7)
    found = numbered(df, [F.col("b").desc(), F.col("a")], "n").orderBy("n").collect()
    assert [r["n"] for r in found] == list(range(1000))
    assert [(r["b"], r["a"]) for r in found] == sorted(((r["b"], r["a"]) for r in found), key=lambda k: (-k[0], k[1]))


def test_ranks_of_categories(spark):
    df = spark.createDataFrame([("x", 1), ("y", 1), ("y", 2), (None, None), ("a", 2)], "s string, n int")
    ranks = features.category_ranks(df, ["s", "n"])
    assert {tuple(r) for r in ranks.collect()} == {("s", "y", 0.0), ("s", "a", 1.0), ("s", "x", 2.0), ("n", "1", 0.0), ("n", "2", 1.0)}
    other = spark.createDataFrame([("new", 2), (None, 7), ("x", None)], "s string, n int")
    assert rows(features.index_by_rank(other, ["s", "n"], ranks).orderBy("n_indexed", "s_indexed"), "s_indexed", "n_indexed") == [
        (3.0, 1.0), (2.0, 2.0), (3.0, 2.0)]
    assert rows(features.index_by_rank(df.limit(0), ["s"])) == []
