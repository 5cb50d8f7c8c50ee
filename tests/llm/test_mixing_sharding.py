"""Cube-method mixing and resharding: their laws, and targets against plain arithmetic."""

import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from flowlens.llm.mixing import flight, land, mix, mixed_documents, targets
from flowlens.llm.reshard import place_blocks, reshard, resharded_files, transport


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total, excess = sum(weight[s] for s in open_), 0.0
        for s in sorted(open_, key=names.index):
            target[s] += left * weight[s] / total
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                excess += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
        left = excess
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1_000, "c": 10, "d": 0, None: 70}, {"x": 5}, {"a": 0, "b": 0},
    {f"s{n}": (n * 37) % 101 for n in range(25)}])
def test_targets_match_resharing(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in targets(frame).collect()}
    assert found == pytest.approx(slow_targets(sizes))


def test_flight_keeps_sums_and_expectation():
    size = [float(n * 7 % 13 + 1) for n in range(300)]
    import random
    rng = random.Random(2)
    taken = [0.0] * 300
    for _ in range(60):
        out = flight(size, [0.3] * 300, lambda _: rng.random())
        assert sum(out) == pytest.approx(90) and sum(s * p for s, p in zip(size, out)) == pytest.approx(0.3 * sum(size))
        assert sum(0 < p < 1 for p in out) <= 2
        done = land(size, out)
        assert set(done) <= {0.0, 1.0}
        taken = [t + d for t, d in zip(taken, done)]
    assert 0.2 < sum(t / 60 for t in taken[:150]) / 150 < 0.4


def test_mix_laws(spark, documents, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = [(d, t, "hot" if d % 3 else s) for d, t, s in rows]
    rows += [(10_000 + n, f"word{n} " * (n % 17), None) for n in range(40)] + [(20_000, None, "n"), (20_001, "", "n")]
    rows += [(30_000, "a b c", "twice")] * 2
    docs = documents(*rows)
    found = mix(docs).collect()
    assert len(found) == len(rows)
    words = {(d, s): len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for d, t, s in rows}
    sizes = {}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words[d, s]
    wanted = slow_targets(sizes)
    for r in found:
        assert r["size"] == words[r["doc_id"], r["source"]] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]]) and 0 <= r["copies"] <= 2
    for s in sizes:
        mine = [r for r in found if r["source"] == s]
        most = max(r["size"] for r in mine) * (2 if s == "twice" else 1)
        assert abs(sum(r["size"] * r["copies"] for r in mine) - wanted[s]) <= most + 1e-6
    again = mix(docs.repartition(3)).collect()
    key = lambda rs: sorted((r["doc_id"], r["copies"]) for r in rs)
    assert key(found) == key(again)
    taken = mixed_documents(docs.withColumn("copies", F.lit("mine")))
    assert taken.columns == [*docs.columns, "copies"]
    assert sorted(r["doc_id"] for r in taken.collect()) == sorted(r["doc_id"] for r in found for _ in range(r["copies"]))


def test_mix_levels_and_empty_tables(documents, monkeypatch):
    from flowlens.llm import mixing
    monkeypatch.setattr(mixing, "BLOCK", 8)
    docs = documents(*[(n, "w " * (n % 5 + 1), "a" if n % 4 else "b") for n in range(700)])
    found = mix(docs, weights=(3, 1)).collect()
    for s in "ab":
        mine = [r for r in found if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 5
    assert mix(documents()).count() == 0 and mixed_documents(documents()).count() == 0


def test_transport_moves_the_least():
    for supply, demand in (([5, 3], [2, 2, 4]), ([0, 9, 0], [3, 3, 3]), ([4, 4], [4, 4]), ([1, 2, 3], [6])):
        flow = transport(supply, demand)
        assert [sum(x for (i, _), x in flow.items() if i == k) for k in range(len(supply))] == supply
        assert [sum(x for (_, j), x in flow.items() if j == k) for k in range(len(demand))] == demand
        # The least: all but what both sides of a shard number have in common.
        moved = sum(x for (i, j), x in flow.items() if i != j)
        assert moved == sum(supply) - sum(min(a, b) for a, b in itertools.zip_longest(supply, demand, fillvalue=0))


def test_blocks_stay_where_they_can():
    blocks = [(s, b, 0, 10) for s in range(2) for b in range(40)]
    placed = place_blocks(blocks, 2, 4)
    loads = [sum(10 for x in placed.values() if x == j) for j in range(4)]
    assert loads == [200] * 4 and sum(1 for (s, _, _), j in placed.items() if s == j) == 40


def check_layout(rows, found, shards=8):
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in found) == sorted(
        (d is None, d, t) for d, t in rows) if all(t is not None for _, t in rows) else len(found) == len(rows)
    load = [0] * shards
    for j in range(shards):
        mine = [r for r in found if r["shard"] == j]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        load[j] = sum(len((r["text"] or "").encode()) + 1 for r in mine)
    return load


def test_layout_laws(documents):
    rows = [(n, f"text {n} " * (n % 50 + 1)) for n in range(3_000)] + [(5_000 + n, "same") for n in range(1_500)]
    rows += [(9_000, None), (9_001, ""), (1, rows[1][1])]
    docs = documents(*rows).withColumn("slot", F.lit("mine"))
    out = resharded_files(docs)
    found = out.collect()
    load = check_layout(rows, found)
    assert max(load) - min(load) < 0.02 * sum(load)
    assert out.columns == [*docs.columns[:-1], "shard", "slot", "old_shard"]
    assert {zlib.crc32(r["text"].encode()) for r in found if r["doc_id"] == 17} == {zlib.crc32(rows[17][1].encode())}
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in resharded_files(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in found}


def test_moderate_groups_share_a_shard(documents):
    rows = [(n, f"text {n % 2_000} " * 10) for n in range(6_000)]
    place = {}
    for r in reshard(documents(*rows)).rows.collect():
        place.setdefault(r["text"], set()).add(r["shard"])
    assert max(map(len, place.values())) == 1


def test_untouched_shards_keep_their_files(documents, folder, spark):
    rows = [(n, "x" * 9) for n in range(800)]
    same = reshard(documents(*rows), 4, 4, old_shard=F.col("doc_id") % 4)
    assert same.touched == []
    check_layout(rows, same.rows.collect(), 4)


def test_empty_layout(documents):
    assert resharded_files(documents()).count() == 0
