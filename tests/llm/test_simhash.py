"""SimHash fingerprints and components against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from flowlens.llm.shared import components
from flowlens.llm.simhash import _link, fingerprint_edges, keep_first, near_duplicates, text_fingerprint


def slow_fingerprint(text):
    words = []
    for part in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
            {c: " " for c in range(9, 14)}).split(" "):
        words += [part] if part else []
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) > 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def closure(values, bits=4):
    """Smallest id of each id's component; values: id to number."""
    ids = sorted(values)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(values[a] ^ values[b]).count("1") <= bits and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprint_and_spark_hash_agree(spark):
    texts = ["", None, "A b", "one two three four", "one two three four FIVE six\x0bSeven é É", " \t\n", "x " * 9_000]
    for t in texts:
        assert text_fingerprint(t) == slow_fingerprint(t)
    assert spark.range(1).select(F.xxhash64(F.lit("a b"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b", 42)


def test_components_match_brute_force(documents, tables, spark):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    rng = random.Random(1)
    base = "".join(chr(97 + rng.randrange(26)) if rng.random() < 0.8 else " " for _ in range(3_000))
    near = [(1_000 + n, base[: 40 * n] + " changed " + base[40 * n + 5:]) for n in range(12)]
    rows += near + [(2_000, ""), (2_001, None), (2_002, " \n"), (1_000, near[0][1])]
    found = near_duplicates(documents(*rows)).collect()
    values = {d: text_fingerprint(t) for d, t in rows}
    label = closure(values)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == sorted(
        (d, f"{text_fingerprint(t):016x}", label[d]) for d, t in rows)


def test_random_fingerprints_lose_no_link(spark):
    rng = random.Random(3)
    values = {}
    for centre in range(6):  # groups both under and over the size that is searched breadth-first
        value = rng.getrandbits(64)
        for n in range(60 if centre < 2 else 8):
            values[len(values)] = value
            for _ in range(rng.randrange(5)):
                value ^= 1 << rng.randrange(64)
    distinct = {v: i for i, v in sorted(values.items(), reverse=True)}
    signed = [(v - (1 << 64) if v >> 63 else v, i) for v, i in distinct.items()]
    frame = spark.createDataFrame(signed, "fingerprint long, rep long")
    found = {r["node"]: r["component"] for r in components(fingerprint_edges(frame)).collect()}
    label = closure({i: v for v, i in distinct.items()})
    assert {i: found.get(i, i) for i in label} == label


def test_large_keys_give_a_forest():
    values = np.arange(200, dtype=np.int64)  # any two differ in eight bits at most
    left, right = _link(np.zeros(200, np.int64), values, values, 4)
    assert len(left) == 199


def test_components_of_a_path_and_no_edges(spark):
    path = spark.createDataFrame([(n, n + 1) for n in range(40)] + [(7, 7), (100, 101)], "a long, b long")
    assert {tuple(r) for r in components(path).collect()} == {(n, 0) for n in range(41)} | {(100, 100), (101, 100)}
    assert components(path.limit(0)).count() == 0


def test_one_of_each_group_stays(documents):
    docs = documents((5, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (9, "other words stand here now"),
                     (None, "a b c d e f"), (None, None)).withColumn("fingerprint", F.lit(1))
    kept = keep_first(docs)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 9, None, None]
    assert kept.columns == docs.columns
    assert keep_first(documents()).count() == 0
    assert near_duplicates(documents()).count() == 0
