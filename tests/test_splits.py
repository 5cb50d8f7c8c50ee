import hashlib
from collections import Counter

import pytest
from frames import rows
from pyspark.sql import functions as F

from flowlens.functions.hashing import hash32, row_key
from flowlens.operators import features as fe
from flowlens.operators import splits as sp


def numbered(spark, n=2000):
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "rare")
                                 .otherwise(F.concat(F.lit("c"), (F.col("id") % 4).cast("string"))).alias("label"))


def test_hash_is_the_md5_prefix(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string").coalesce(1)
    found = [r[0] for r in df.select(hash32(row_key(["a", "b"]))).collect()]
    assert found == [int(hashlib.md5(k).hexdigest()[:8], 16) for k in (b"1|\\N", b"2|x")]


def test_hash_split_is_a_partition_and_repeats(spark):
    df = numbered(spark)
    train, test = sp.hash_split(df, ["id"])
    a, b = {r["id"] for r in train.collect()}, {r["id"] for r in test.collect()}
    assert not a & b and len(a | b) == 2000 and 1500 < len(a) < 1700
    again, _ = sp.hash_split(df.repartition(7), ["id"])
    assert {r["id"] for r in again.collect()} == a


@pytest.mark.parametrize("bits", [2, 8, 16])
def test_stratified_split_is_exact_per_class(spark, bits):
    df = numbered(spark).unionByName(spark.createDataFrame([(9000, "single"), (9001, None), (9002, None)], "id bigint, label string"))
    total = Counter(r["label"] for r in df.collect())
    marked = sp.mark_stratified(df, "label", ["id"], 0.8, bits=bits)
    assert marked.columns == ["id", "label", "is_train"] and marked.count() == 2003
    taken = Counter(r["label"] for r in marked.where("is_train").collect())
    assert taken == {c: int(0.8 * n) for c, n in total.items() if int(0.8 * n)}


def test_stratified_split_keeps_copies_together(spark):
    df = spark.createDataFrame([(1, "a")] * 40 + [(i, "a") for i in range(2, 62)], "id bigint, label string")
    train, test = sp.stratified_split(df, "label", ["id"], 0.5)
    assert train.count() + test.count() == 100
    assert not {r["id"] for r in train.collect()} & {r["id"] for r in test.collect()}


def test_hash_sample(spark):
    df = numbered(spark, 10000)
    assert 1300 < sp.hash_sample(df, ["id"], 0.15).count() < 1700
    assert sp.hash_sample(df, ["id"], 1.0).count() == 10000
    assert sp.hash_sample(df, ["id"], 0.0).count() == 0
    ids = {r["id"] for r in sp.hash_sample(df, ["id"], 0.15, seed=1).collect()}
    assert ids != {r["id"] for r in sp.hash_sample(df, ["id"], 0.15, seed=2).collect()}


def test_missing_classes_and_rebalance(spark):
    train = spark.createDataFrame([(i, "a") for i in range(50)], "id bigint, label string")
    test = spark.createDataFrame([(100 + i, "new" if i % 2 else None if i % 10 == 0 else "a") for i in range(400)],
                                 "id bigint, label string")
    assert {r["label"] for r in sp.missing_classes(train, test).collect()} == {"new", None}
    bigger, smaller = sp.rebalance_missing(train, test, ["id"])
    a, b = {r["id"] for r in bigger.collect()}, {r["id"] for r in smaller.collect()}
    assert not a & b and len(a) + len(b) == 450
    moved = bigger.where("id >= 100")
    assert moved.where("label = 'a'").count() == 0
    assert 70 < moved.where("label = 'new'").count() < 130
    assert moved.where("label is null").count() > 0


def test_nothing_missing_moves_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, label string")
    bigger, smaller = sp.rebalance_missing(df, df.withColumn("id", F.col("id") + 10), ["id"])
    assert bigger.count() == 2 and smaller.count() == 2


def test_category_index(spark):
    df = spark.createDataFrame([("tcp",), ("udp",), ("udp",), ("arp",), (None,)], "proto string").coalesce(1)
    model = fe.fit_category_index(df, ["proto"])
    assert model.labelsArray == [("udp", "arp", "tcp")] or [list(x) for x in model.labelsArray] == [["udp", "arp", "tcp"]]
    unseen = spark.createDataFrame([("udp",), ("icmp",), (None,)], "proto string").coalesce(1)
    assert [r["proto_indexed"] for r in fe.index_categories(unseen, ["proto"], model).collect()] == [0.0, 3.0, 3.0]
    assert rows(fe.index_categories(df, ["proto", "absent"], replace=True)) == [(2.0,), (0.0,), (0.0,), (1.0,), (3.0,)]
    with pytest.raises(ValueError, match="categories"):
        fe.fit_category_index(df, ["proto"], max_categories=2)


def test_category_indexes_of_columns_with_unequal_numbers_of_values(spark, folder):
    df = spark.createDataFrame([("tcp", "http"), ("tcp", "dns"), (None, "ssh"), ("udp", None)],
                               "proto string, service string").coalesce(1)
    indexed = fe.index_categories(df, ["proto", "service"])
    indexed.write.parquet(f"{folder}/t")
    assert rows(spark.read.parquet(f"{folder}/t").select("proto_indexed", "service_indexed")) == [
        (0.0, 1.0), (0.0, 0.0), (2.0, 2.0), (1.0, 3.0)]


def test_assemble_and_scale(spark):
    df = spark.createDataFrame([(1, 2.0), (3, 2.0), (None, 2.0)], "a int, b double").coalesce(1)
    assert fe.assemble(df, ["a", "b"]).count() == 2
    assert fe.assemble(df, ["a", "b"], "keep").count() == 3
    scaled = fe.standardize(df, ["a", "b"]).collect()
    assert [list(r["scaled_features"]) for r in scaled] == [[pytest.approx(-0.5**0.5), 0.0], [pytest.approx(0.5**0.5), 0.0]]
    test = spark.createDataFrame([(5, 7.0)], "a int, b double")
    other = fe.standardize(test, ["a", "b"], train=df).first()
    assert list(other["scaled_features"]) == [pytest.approx(3 / 2**0.5), 0.0]


def test_cut_rows_stay_few_with_coarse_digits(spark):
    """One class of a million rows, four bits a round: only the keys of one hash are left to rank."""
    df = spark.range(1_000_000).select("id", F.lit("a").alias("label"))
    pool = sp.cut_rows(df, "label", ["id"], 0.3, bits=4).collect()
    assert 1 <= len(pool) <= 10 and len({r["_hash"] for r in pool}) == 1
    marked = sp.mark_stratified(df, "label", ["id"], 0.3, bits=4)
    assert marked.where("is_train").count() == 300_000
    assert rows(marked.where("is_train").agg(F.sum("id"))) == rows(
        sp.mark_stratified(df, "label", ["id"], 0.3).where("is_train").agg(F.sum("id")))


@pytest.mark.parametrize("bits", [5, 16, 32])
def test_cut_by_rounds_equals_ranking(spark, bits):
    """Classes of all sizes, a null one, repeated keys; hashes of keys with the smallest places first."""
    table = [(i % 700, None if i % 7 == 0 else f"c{i % 7 % 4}") for i in range(3000)] + [(1, "single")]
    df = spark.createDataFrame(table, "id bigint, label string")
    keyed = df.withColumn("h", sp.hash32(sp.row_key(["id"])))
    by_class = {}
    for r in keyed.collect():
        by_class.setdefault(r["label"], []).append((r["h"], str(r["id"])))
    expected = {}
    for label, of in by_class.items():
        of.sort()
        taken = of[: int(0.6 * len(of))]
        expected[label] = sum(k <= taken[-1] for k in of) if taken else 0
    marked = sp.mark_stratified(df, "label", ["id"], 0.6, bits=bits).where("is_train").groupBy("label").count()
    assert dict(rows(marked)) == {c: n for c, n in expected.items() if n}
    assert sp.mark_stratified(df.limit(0), "label", ["id"], 0.6, bits=bits).count() == 0
