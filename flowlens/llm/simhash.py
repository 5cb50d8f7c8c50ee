"""SimHash near-duplicates by pigeonhole blocks.

Equal fingerprints are merged first. The 64 bits are cut into six blocks; fingerprints that
differ in at most four bits agree in at least two blocks, so every such pair meets under one
of the fifteen pairs of blocks. Rows are joined on these keys by sorting each partition, and
Hamming distances are verified inside a key. A key with many fingerprints gives the edges of a
spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.shared import components, materialize

WIDTHS = (11, 11, 11, 11, 10, 10)
#: Keys with more fingerprints are searched breadth-first instead of pair by pair.
SMALL_KEY = 32


def text_fingerprint(text: str | None, words: int = 4) -> int:
    """The fingerprint as an unsigned number; 0 for a text without words."""
    parts = (text or "").encode().lower().split()  # on bytes, both touch ASCII only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    digest = xxhash.xxh64_digest
    spans = zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1:].tolist())
    total, n = np.zeros(64, np.int64), 0
    hashes = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in spans]), np.uint8).reshape(-1, 8)
    for at in range(0, len(hashes), 65_536):
        total += np.unpackbits(hashes[at:at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
        n = len(hashes)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _fingerprint(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))],
                                             names=["doc_id", "fingerprint"])
    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fingerprint as a signed long) per row; null and wordless texts have fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _fingerprint(words), "doc_id long, fingerprint long")


def _link(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between fingerprints of one key that differ in at most ``bits`` bits; keys are sorted and whole."""
    fp = fp.view(np.uint64)  # bits of negative numbers are not counted as they lie
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.array([], int)
    sizes = np.diff(np.append(starts, len(key)))
    left, right = [], []
    last = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL_KEY), sizes))
    for step in range(1, SMALL_KEY):
        at = at[at + step < last[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= bits]
        left.append(rep[near])
        right.append(rep[near + step])
    for s, n in zip(starts[sizes > SMALL_KEY], sizes[sizes > SMALL_KEY]):
        # What has been reached needs no second look, so groups of close copies shrink at once.
        others, ids = fp[s:s + n], rep[s:s + n]
        while len(others):
            first, queue = ids[0], [others[0]]
            others, ids = others[1:], ids[1:]
            while queue and len(others):
                near = np.bitwise_count(others ^ queue.pop()) <= bits
                if near.any():
                    left.append(np.full(near.sum(), first))
                    right.append(ids[near])
                    queue.extend(others[near])
                    others, ids = others[~near], ids[~near]
    none = np.array([], np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _edges(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, fp, rep):
            a, b = _link(key, fp, rep, bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        key = fp = rep = np.array([], np.int64)
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            key, fp, rep = (np.concatenate(x) for x in zip((key, fp, rep), new))
            cut = np.searchsorted(key, key[-1]) if len(key) else 0  # the last key may go on
            if cut:
                yield out(key[:cut], fp[:cut], rep[:cut])
                key, fp, rep = key[cut:], fp[cut:], rep[cut:]
        yield out(key, fp, rep)
    return run


def fingerprint_edges(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (a, b) that connect all of ``distinct(fingerprint, rep)`` within ``bits`` differing bits."""
    if bits > len(WIDTHS) - 2:
        raise ValueError(f"two of {len(WIDTHS)} blocks agree for certain only up to {len(WIDTHS) - 2} bits")
    ends = np.cumsum(WIDTHS)
    masks = [((1 << w) - 1) << int(e - w) for w, e in zip(WIDTHS, ends)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    fp = F.col("fingerprint")
    keys = F.array(*[F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(signed[i] | signed[j])))
                     for n, (i, j) in enumerate(combinations(range(len(WIDTHS)), 2))])
    return (distinct.select(F.explode(keys).alias("key"), "fingerprint", "rep")
            .repartition("key").sortWithinPartitions("key", "fingerprint").mapInArrow(_edges(bits), "a long, b long"))


def near_duplicates(docs: DataFrame, bits: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    ``fingerprint`` is 16 hex digits. Documents are linked if their fingerprints differ in at most
    ``bits`` bits, and ``component_id`` is the smallest ``doc_id`` that links lead to. Null, empty and
    wordless texts have fingerprint zero and are linked like any other. Repeated rows share everything.
    A row without ``doc_id`` links with nothing and has no component. An empty table gives an empty one.
    Other columns are left out.
    """
    marked = materialize(fingerprints(docs, words), "fingerprints")
    distinct = marked.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    found = components(fingerprint_edges(distinct, bits))
    classes = distinct.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("fingerprint").alias("__fp"), F.coalesce("component", "rep").alias("component_id"))
    joined = marked.join(classes, F.col("fingerprint") == F.col("__fp"), "left")
    return joined.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, bits: int = 4, words: int = 4) -> DataFrame:
    """One document of each group, that with the smallest ``doc_id``; all columns of ``docs``.

    Of repeated rows one stays. Rows without ``doc_id`` belong to no group and all stay.
    """
    first = (near_duplicates(docs, bits, words).where("doc_id = component_id")
             .select(F.col("doc_id").alias("__kept")).distinct())
    kept = docs.join(first, F.col("doc_id") == F.col("__kept"), "left_semi").dropDuplicates(["doc_id"])
    return kept.union(docs.where("doc_id is null"))
