"""Near copies by SimHash, confirmed by exact shingle overlap.

Two texts are alike if they share 0.8 or more of their different word shingles (Jaccard). Candidates are
what SimHash links: fingerprints that differ in at most BITS bits, found by op2's pigeonhole blocks. Texts at
0.8 differ in three to some twenty of 64 bits, for which such blocks become too short to select anything, so
MinHash adds the looser pairs: BANDS keys of ROWS minima each. Every pair of either is confirmed on the
shingles themselves; the hashes decide only what is compared.

Texts with equal shingles are merged first, and keys of one text are left out. Each key gives a forest of
the texts whose minima leave a similarity of 0.8 possible; what these forests and SimHash's connect is a cluster. A cluster
is cut into blocks of bounded size, and each two of its blocks meet in a cell, which compares its texts by
their shingles and gives a forest of the links it finds: no step gives all pairs, however large a group is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.shared import components, materialize
from flowlens.llm.simhash import fingerprint_edges, text_fingerprint

#: Bits in which fingerprints of four-word shingles that SimHash links may differ.
BITS = 4
#: At a similarity of 0.8 no band agrees with a probability of (1 - 0.8 ** 4) ** 24 = 3e-6.
BANDS, ROWS = 24, 4
MINIMA = BANDS * ROWS
#: Standard errors by which equal minima may fall short of the similarity.
SLACK = 5.0
#: Shingles that are hashed to minima at once.
CHUNK = 2_048
#: Texts and characters of a block of a cluster, on average.
BLOCK_TEXTS, BLOCK_CHARS = 1_000, 8_000_000

_RANDOM = np.random.default_rng(64)
_TIMES = _RANDOM.integers(0, 1 << 64, MINIMA, np.uint64, endpoint=False) | np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 64, MINIMA, np.uint64, endpoint=False)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_shingles(text: str | None, words: int = 5) -> set[bytes]:
    """Different runs of ``words`` words as op2's fingerprint cuts them; a shorter text is one, none has none."""
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def similarity_of(a: str | None, b: str | None, words: int = 5) -> float:
    x, y = word_shingles(a, words), word_shingles(b, words)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        some = hashes[at:at + CHUNK]
        np.minimum(least, (_TIMES[:, None] * some + _PLUS[:, None]).min(axis=1), out=least)
    return least


def _sketch(words: int):
    def one(text: str | None):
        fingerprint = int(np.uint64(text_fingerprint(text)).view(np.int64))
        hashes = np.sort(np.array([xxhash.xxh64_intdigest(s) for s in word_shingles(text, words)], np.uint64))
        if not len(hashes):
            return b"", b"", [], fingerprint
        least = minima(hashes)
        keys = [int.from_bytes(xxhash.xxh64_digest(least[i:i + ROWS].tobytes(), n), "big", signed=True)
                for n, i in enumerate(range(0, MINIMA, ROWS))]
        return xxhash.xxh3_128_digest(hashes.tobytes()), ((least * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes(), keys, fingerprint

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, sign, keys, prints = zip(*[one(t.as_py()) for t in batch.column(1)]) if len(batch) else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(same, pa.binary()), pa.array(sign, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(prints, pa.int64())],
                names=["doc_id", "same", "sign", "keys", "fingerprint"])
    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(places where a key begins, columns) of whole keys; batches are sorted by their first column."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1) if pa.types.is_binary(c.type)
               else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(batch):
            continue
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        cut = np.searchsorted(held[0], held[0][-1])  # the last key may go on
        if cut:
            yield _starts(held[0][:cut]), [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held is not None:
        yield _starts(held[0]), held


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key others have too."""
    for starts, (key, rep) in _by_key(batches):
        sizes = np.diff(np.append(starts, len(key)))
        many = np.repeat(sizes > 1, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(rep[many])], names=["key", "rep"])


def forest(sign: np.ndarray, rep: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs that span what ``least`` equal minima connect."""
    found = []
    while len(rep):
        queue, sign, rep = [(rep[0], sign[0])], sign[1:], rep[1:]
        while queue and len(rep):
            at, mine = queue.pop()
            near = (sign == mine).sum(axis=1) >= least
            if near.any():
                found += [(at, b) for b in rep[near]]
                queue += zip(rep[near], sign[near])
                sign, rep = sign[~near], rep[~near]
    return found


class Shingled:
    """Texts of a cell as sets of shingle hashes, numbered so that one text is compared with many at once."""

    def __init__(self, texts: list[str | None], words: int) -> None:
        sets = [np.array([xxhash.xxh64_intdigest(s) for s in word_shingles(t, words)], np.uint64) for t in texts]
        self.sizes = np.array([len(s) for s in sets])
        names, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        self.sets = np.split(numbers, np.cumsum(self.sizes)[:-1])
        self.mine = np.zeros(len(names), np.int64)

    def similarities(self, one: int, others: np.ndarray) -> np.ndarray:
        """Shares of different shingles that text ``one`` has in common with each of ``others``; sets aren't empty."""
        self.mine[self.sets[one]] = 1
        starts = np.cumsum(self.sizes[others]) - self.sizes[others]
        both = np.add.reduceat(self.mine[np.concatenate([self.sets[n] for n in others])], starts)
        self.mine[self.sets[one]] = 0
        return both / (self.sizes[one] + self.sizes[others] - both)


def links(texts: list[str | None], sign: np.ndarray, words: int, similarity: float, enough: float) -> list[tuple[int, int]]:
    """Places of pairs that span what a similarity of ``similarity`` connects; only texts with ``enough`` equal
    minima are compared."""
    cell = Shingled(texts, words)
    found, left = [], np.flatnonzero(cell.sizes > 0)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.flatnonzero((sign[left] == sign[at]).sum(axis=1) >= enough)
            if len(near):
                near = near[cell.similarities(at, left[near]) >= similarity - 1e-12]
                found += [(at, n) for n in left[near]]
                queue += left[near].tolist()
                left = np.delete(left, near)
    return found


def _cells(words: int, similarity: float, enough: float):
    def edges(rows: list[dict]) -> pa.RecordBatch:
        sign = np.frombuffer(b"".join(r["sign"] for r in rows), np.uint8).reshape(len(rows), -1)
        found = links([r["text"] for r in rows], sign, words, similarity, enough)
        return pa.RecordBatch.from_pydict({"a": pa.array([min(rows[x]["rep"], rows[y]["rep"]) for x, y in found], pa.int64()),
                                           "b": pa.array([max(rows[x]["rep"], rows[y]["rep"]) for x, y in found], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["cell"] != held[0]["cell"]:
                    yield edges(held)
                    held = []
                held.append(row)
        if held:
            yield edges(held)
    return run


def _pairs(find):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, columns in _by_key(batches):
            found = []
            for s, e in zip(starts, np.append(starts[1:], len(columns[0]))):
                found += find(*[c[s:e] for c in columns[1:]])
            ends = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1, initial=1 << 62)), pa.array(ends.max(axis=1, initial=-1 << 62))],
                                             names=["a", "b"])
    return run


def simhash_edges(distinct: DataFrame) -> DataFrame:
    """(a, b): forests of what SimHash links among the texts of ``distinct(rep, fingerprint)``."""
    prints = distinct.groupBy("fingerprint").agg(F.min("rep").alias("first"))
    equal = distinct.join(prints, "fingerprint").where("rep != first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    return equal.union(fingerprint_edges(prints.select("fingerprint", F.col("first").alias("rep")), BITS))


def similar_edges(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b): ids of rows of ``docs`` that are alike, connecting all groups; rows without ``doc_id`` have none."""
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    marked = materialize(named.mapInArrow(
        _sketch(words), "doc_id long, same binary, sign binary, keys array<long>, fingerprint long"), "sketches")
    least = F.min(F.struct("doc_id", "sign", "keys", "fingerprint")).alias("m")
    distinct = materialize(marked.groupBy("same").agg(least).select(
        "same", F.col("m.doc_id").alias("rep"), "m.sign", "m.keys", "m.fingerprint"), "distinct")
    equal = marked.select("same", "doc_id").join(distinct.select("same", "rep"), "same").where("doc_id != rep").select(
        F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    shared = materialize(distinct.select(F.explode("keys").alias("key"), "rep").repartition("key").sortWithinPartitions("key")
                         .mapInArrow(_shared, "key long, rep long"), "shared")
    hits = materialize(shared.join(distinct.select("rep", "sign"), "rep").select("key", "rep", "sign"), "hits")
    near = materialize(simhash_edges(distinct.where("sign != X''").select("rep", "fingerprint")), "near")
    wanted_texts = shared.select(F.col("rep").alias("doc_id")).union(near.select("a")).union(near.select("b")).distinct()
    texts = materialize(named.join(wanted_texts, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    wanted = MINIMA * similarity
    enough = wanted - SLACK * (wanted * (1 - similarity)) ** 0.5
    possible = (hits.repartition("key").sortWithinPartitions("key", "rep")
                .mapInArrow(_pairs(lambda rep, sign: forest(sign, rep, enough)), "a long, b long"))
    clusters = components(near.union(possible).distinct()).withColumnRenamed("node", "rep")
    members = materialize(distinct.select("rep", "sign").join(clusters, "rep")
                          .join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep"), "members")
    blocks = members.groupBy("component").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum(F.coalesce(F.length("text"), F.lit(0))) / BLOCK_CHARS)).alias("blocks"))
    # The cells of a block are those it shares with each other block; a cluster of one block has one cell.
    placed = members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    partners = F.when(F.col("blocks") > 1, F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                                                    lambda n: n != F.col("block"))).otherwise(F.array("block"))
    celled = placed.select("component", "block", "rep", "sign", "text", F.explode(partners).alias("partner")).select(
        F.xxhash64("component", F.least("block", "partner"), F.greatest("block", "partner")).alias("cell"), "rep", "sign", "text")
    found = materialize(celled.repartition("cell").sortWithinPartitions("cell", "rep").mapInArrow(
        _cells(words, similarity, enough), "a long, b long"), "links")
    return equal.union(found)


def keep_first_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group, that with the smallest ``doc_id``; all columns of ``docs``.

    Documents are linked if they share ``similarity`` or more of their different shingles of ``words`` words
    (A to Z in any case), and links of links are one group. Null, empty and wordless texts are alike. Of
    repeated rows one stays. Rows without ``doc_id`` belong to no group and all stay.
    """
    later = components(similar_edges(docs, words, similarity)).where("node != component").select(
        F.col("node").alias("__node"))
    kept = docs.where("doc_id is not null").join(later, F.col("doc_id") == F.col("__node"), "left_anti")
    return kept.dropDuplicates(["doc_id"]).union(docs.where("doc_id is null"))
