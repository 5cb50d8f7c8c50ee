"""The vector join against all pairs, and the pipeline against its operators one by one."""

import sys
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
from compare import compare, oracle_connection
from flowlens.llm import ego_join

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))


def brute(rows, cosine=0.93):
    ok = {}
    for vec, values, label in rows:
        if vec is None or label is None or not values or any(v is None or not np.isfinite(v) for v in values) or not any(values):
            continue
        ok[vec] = (label, np.array(values, np.float64))
    links = {v: set() for v in ok}
    for a in ok:
        for b in ok:
            (la, x), (lb, y) = ok[a], ok[b]
            if a < b and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[a].add(b)
                links[b].add(a)
    label = {v: v for v in ok}
    changed = True
    while changed:
        changed = False
        for a in ok:
            for b in links[a]:
                if label[b] < label[a]:
                    label[a], changed = label[b], True
    return {v: (len(links.get(v, ())), label.get(v, v), label.get(v, v) == v) for v in {r[0] for r in rows if r[0] is not None}}


def test_links_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ego_join, "BLOCK", 16)
    monkeypatch.setattr(ego_join, "LEAF", 4)
    rng = np.random.default_rng(0)
    rows, centres = [], rng.normal(size=(12, 16))
    for n in range(500):
        noise = rng.normal(size=16) * (0.35 if n % 3 else 0.05)
        rows.append((n, (centres[n % 12 if n % 2 else 0] + noise).astype("float32").tolist(), n % 3))
    same = rows[4][1]
    rows += [(1_000 + n, same, 1) for n in range(70)] + [(2_000, None, 1), (2_001, [0.0] * 16, 1), (2_002, [1.0] * 8, 1),
             (2_003, [float("nan")] + [1.0] * 15, 1), (2_004, [None] + [1.0] * 15, 1), (2_005, [float("inf")] * 16, 1),
             (2_006, same, None), (2_007, [2 * x for x in same], 1), (2_008, [], 1), (2_009, [3.0] * 8, 1), (1_000, same, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = ego_join.near_vectors(frame.repartition(6)).collect()
    expected = brute(rows)
    assert len(found) == len(expected)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == expected


def test_no_vectors(spark):
    assert ego_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_queries_match_sql(spark, tables, name):
    assert compare(entry.queries()[name](spark, tables), oracle_connection(tables), entry.oracle_sql()[name]) is None


def test_pipeline_stages(spark, tables, documents):
    import corpus_pipeline as cp
    from flowlens.llm import decontaminate, similar, toxicity

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    out = cp.run(spark, tables).collect()
    model = toxicity.train(docs, labels)
    left = [r for r in docs.collect() if model.scores([r["text"]], {})[0] < 0.5]
    sets = {r["doc_id"]: similar.word_shingles(r["text"]) for r in left}
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                if label[b] < label[a] and (len(x & y) >= 0.8 * len(x | y) if x or y else True):
                    label[a], changed = label[b], True
    left = [r for r in left if label[r["doc_id"]] == r["doc_id"]]
    matcher = decontaminate.Matcher(decontaminate.Index(items))
    left = {r["doc_id"]: r["text"] for r in left if not matcher.matches([r["text"]])[0]}
    assert {r["doc_id"] for r in out} <= set(left) and all(left[r["doc_id"]] == r["text"] for r in out)
    times = [sum(1 for r in out if r["doc_id"] == d) for d in left]
    assert max(times) <= 2
    words = sum(len(t.split()) for t in left.values())
    assert abs(sum(len(r["text"].split()) for r in out) - 1.5 * words) < 0.02 * words + 400
    for j in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == j) == list(range(sum(r["shard"] == j for r in out)))
    assert len(cp.STAGES) == 5
    hard = documents((1, None), (2, ""), (1, None), (None, "a b"), (3, "word " * 30_000))
    for empty in (hard, documents()):
        kept = empty
        for _, stage in cp.STAGES:
            kept = stage(spark, kept, tables)
        assert kept.count() <= 2 * empty.count()
