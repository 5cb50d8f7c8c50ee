"""Which tokens of one tokenizer stand for which of another, text by text and over the corpus.

Texts are encoded by a byte-level tokenizer (A) and a piece model (B), a block of them at a time. Per
block everything is Arrow: token lists are flattened beside their parent indices, byte lengths summed up
inside each document, and the ends of A joined with those of B on document and end. Where both end, a group
ends, and its two last tokens are a link. Partial counts of the linked id pairs leave each block once; Spark
merges them and hands each block the counts of its own pairs back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from flowlens.llm.token_ids import Encoder

#: Bytes of text in a block, and of the steps a block is aligned in; a longer text is one of its own.
BLOCK, STEP = 4_000_000, 500_000
#: Spellings whose ids in A a worker keeps; with both models' tables that is some 120 MB.
WORDS_KEPT = 250_000
ALIGNED = ("part int, block int, doc_id long, n_a long, n_b long, groups string, links array<int>, "
           "pairs array<struct<a: int, b: int, n: long>>")


def public_files() -> tuple[str, str]:
    """Where the vocabulary of A and the model of B lie on this machine."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letter a byte-level vocabulary writes for each byte: visible Latin-1 as itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, and the bytes and decimal digits of every id."""

    def __init__(self, a_file: str, b_file: str) -> None:
        from sentencepiece import SentencePieceProcessor
        self.a, self.b = Encoder(a_file, WORDS_KEPT), SentencePieceProcessor(model_file=b_file)
        letters, words = byte_letters(), self.a.tokenizer.get_vocab()
        names = {n: word for word, n in words.items()}
        self.a_bytes = pa.array([bytes(letters.get(c, 0) for c in names.get(n, "")) for n in range(max(names) + 1)],
                                pa.large_binary())
        self.b_bytes = pa.array([self._piece(n) for n in range(self.b.get_piece_size())], pa.large_binary())
        self.sizes = [np.asarray(pc.binary_length(table)) for table in (self.a_bytes, self.b_bytes)]
        # The parts a written alignment is made of: an id and what stands after it.
        self.written = pa.array([f"{n}{mark}" for table, marks in ((self.a_bytes, ",|"), (self.b_bytes, (",", ";", "")))
                                 for mark in marks for n in range(len(table))], pa.large_string())

    def _piece(self, n: int) -> bytes:
        piece = self.b.id_to_piece(n)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(n) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Token lists of space + text by A, and of text by B, which sets a space before it; none for empty texts."""
        ids, stops = self.a.encode_flat([" " + t if t else "" for t in texts])
        a = pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), pa.array(ids.astype(np.int32)))
        rows = iter(self.b.encode([t for t in texts if t], num_threads=1) if any(texts) else [])
        return a, lists([next(rows) if t else [] for t in texts])


@lru_cache(1)
def _tokenizers(a_file: str, b_file: str) -> Tokenizers:
    """One a Python worker."""
    return Tokenizers(a_file, b_file)


def lists(rows: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.fromiter(chain.from_iterable(rows), np.int32, ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _joined(table: pa.Array, ids: pa.ListArray) -> tuple[memoryview, np.ndarray]:
    """The bytes of all tokens one after another, and where each row's begin and end."""
    found = table.take(ids.flatten())
    ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, found.offset * 8) if len(found) else np.zeros(1, np.int64)
    return memoryview(found.buffers()[2] or b"").cast("B"), ends[np.asarray(ids.offsets)]


def spelled(both: list[tuple[pa.Array, pa.ListArray]], texts: list[str]) -> np.ndarray:
    """Whether the tokens of a row spell space + text in A and in B; false for empty texts."""
    wanted = [b" " + t.encode() if t else b"" for t in texts]
    right = np.array([bool(t) for t in texts], bool)
    whole, ends = b"".join(wanted), np.cumsum([0, *map(len, wanted)])
    for table, ids in both:
        data, at = _joined(table, ids)
        if np.array_equal(at, ends) and data[:ends[-1]] == whole:
            continue  # all rows at once
        right &= np.fromiter((data[x:y] == w for x, y, w in zip(at, at[1:], wanted)), bool, len(wanted))
    return right


def without(ids: pa.ListArray, kept: np.ndarray) -> pa.ListArray:
    """``ids`` with empty lists where ``kept`` is false."""
    if kept.all():
        return ids
    empty = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], pa.int32()))
    return pa.concat_arrays([ids, empty]).take(pa.array(np.where(kept, np.arange(len(ids)), len(ids))))


def ends(ids: pa.ListArray, sizes: np.ndarray, name: str) -> pa.Table:
    """(doc, end, name) of every token: its row, the byte offset in that row where it ends, and its place."""
    flat, parents = ids.flatten(), pc.list_parent_indices(ids)
    total = np.cumsum(sizes[np.asarray(flat)], dtype=np.int64)
    starts = np.concatenate([[0], total])[np.asarray(ids.offsets)[:-1]]  # bytes of all rows before
    return pa.table({"doc": parents, "end": total - starts[np.asarray(parents)], name: np.arange(len(flat))})


def links_of(a: pa.ListArray, b: pa.ListArray, sizes: list[np.ndarray]) -> pa.Table:
    """(doc, a, b) of every link, places among all tokens of A and of B, in order."""
    joined = ends(a, sizes[0], "a").join(ends(b, sizes[1], "b"), ["doc", "end"], join_type="inner", use_threads=False)
    return joined.select(["doc", "a", "b"]).sort_by("a").combine_chunks()


def written_groups(known: Tokenizers, a: pa.ListArray, b: pa.ListArray, at_a: np.ndarray, at_b: np.ndarray) -> pa.StringArray:
    """Per row ``a1,a2|b1;a3|b2,b3``: the ids of A and B between one common end and the next."""
    ids_a, ids_b = np.asarray(a.flatten(), np.int64), np.asarray(b.flatten(), np.int64)
    many_a, many_b = len(known.a_bytes), len(known.b_bytes)
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[at_a] = last_b[at_b] = True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    # A token of A has the tokens of B in earlier groups before it, one of B those of A up to its own group.
    parts = np.zeros(len(ids_a) + len(ids_b), np.int64)
    parts[np.arange(len(ids_a)) + np.concatenate([[0], at_b + 1])[group_a]] = ids_a + many_a * last_a
    mark = last_b.astype(np.int64)
    row_ends = np.asarray(b.offsets)
    mark[row_ends[1:][np.diff(row_ends) > 0] - 1] = 2  # nothing after the last group of a row
    parts[np.arange(len(ids_b)) + (at_a + 1)[group_b]] = 2 * many_a + many_b * mark + ids_b
    text = known.written.take(pa.array(parts))
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1) if len(text) else np.zeros(1, np.int64)
    rows = offsets[np.asarray(a.offsets) + row_ends].astype(np.int32)
    return pa.StringArray.from_buffers(len(a), pa.py_buffer(rows), text.buffers()[2] if len(text) else pa.py_buffer(b""))


def align_step(known: Tokenizers, texts: list[str]) -> tuple[pa.Table, np.ndarray]:
    """(n_a, n_b, groups, n_links) per text, and the id pair of every link in order: A's id times B's ids, plus B's."""
    a, b = known.encode(texts)
    right = spelled([(known.a_bytes, a), (known.b_bytes, b)], texts)
    a, b = without(a, right), without(b, right)
    links = links_of(a, b, known.sizes)
    at_a, at_b = np.asarray(links["a"]), np.asarray(links["b"])
    pairs = np.asarray(a.flatten(), np.int64)[at_a] * len(known.b_bytes) + np.asarray(b.flatten(), np.int64)[at_b]
    rows = pa.table({"n_a": pc.list_value_length(a).cast(pa.int64()), "n_b": pc.list_value_length(b).cast(pa.int64()),
                     "groups": written_groups(known, a, b, at_a, at_b),
                     "n_links": np.bincount(np.asarray(links["doc"]), minlength=len(texts))})
    return rows, pairs


def align_block(known: Tokenizers, texts: list[str], step: int = STEP) -> dict[str, pa.Array]:
    """n_a, n_b, groups and links (numbers of id pairs) per text, and pairs with their counts in the first row."""
    done = [align_step(known, texts[at:stop]) for at, stop in cuts([len(t) for t in texts], step)]
    rows = pa.concat_tables([table for table, _ in done]).combine_chunks()
    pair = pa.array(np.concatenate([pairs for _, pairs in done])).dictionary_encode()
    counts = pa.table({"pair": pair.indices}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
    names, many_b = np.asarray(pair.dictionary), len(known.b_bytes)
    entries = pa.StructArray.from_arrays(
        [pa.array((names // many_b).astype(np.int32)), pa.array((names % many_b).astype(np.int32)),
         counts["count_all"].combine_chunks().cast(pa.int64())], ["a", "b", "n"])
    first = pa.array(np.minimum(np.arange(len(texts) + 1), 1) * len(entries), pa.int32())
    per_row = pa.array(np.cumsum(np.append(0, rows["n_links"])), pa.int32())
    return {**{name: rows[name].combine_chunks() for name in ("n_a", "n_b", "groups")},
            "links": pa.ListArray.from_arrays(per_row, pair.indices), "pairs": pa.ListArray.from_arrays(first, entries)}


def cuts(sizes, most: int) -> list[tuple[int, int]]:
    """Runs of rows, each cut after the row that reaches the next multiple of ``most``."""
    total = np.cumsum(np.asarray(sizes, np.int64))
    stops = np.flatnonzero(np.diff(total // most, append=-1)) + 1
    return list(zip([0, *stops], stops))


def _align(a_file: str, b_file: str, block: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, number = _tokenizers(a_file, b_file), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, stop in cuts(pc.binary_length(batch.column(1)).fill_null(0), block):
                some = batch.slice(at, stop - at)
                found = align_block(known, [t or "" for t in some.column(1).to_pylist()], step)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(some), part), pa.int32()),
                    "block": pa.array(np.full(len(some), number), pa.int32()), "doc_id": some.column(0), **found})
                number += 1
    return run


def align(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, block: int = BLOCK,
          step: int = STEP) -> DataFrame:
    """Token counts and aligned groups of each text, and its links as numbers into the pairs of its block.

    ``groups`` writes the ids as ``a1,a2|b1;a3|b2,b3``: a group ends where a token of A and one of B end at the
    same byte. Null and empty texts, and texts that the tokens of A or B don't spell, have no tokens, an empty
    ``groups`` and no links. Each row is aligned for itself, repeated rows and null ids too. An empty table gives
    an empty one. Columns other than doc_id and text aren't read. Write the result before using it more than
    once: the pairs of a block, which stand in its first row, are known by ``part`` and ``block``, and
    computing it anew may cut other blocks.
    """
    public = public_files() if not (a_file and b_file) else ("", "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_align(a_file or public[0], b_file or public[1], block, step), ALIGNED)


def _partial_counts(aligned: DataFrame) -> DataFrame:
    """(part, block, place, a, b, n): how often a pair is linked in a block."""
    return (aligned.where(F.size("pairs") > 0).select("part", "block", F.posexplode("pairs").alias("place", "pair"))
            .select("part", "block", "place", "pair.a", "pair.b", "pair.n"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best) of every id pair linked in the written result of ``align``; best: none is linked
    oftener with this id of B. A window holds the pairs of one id of B, at most as many as A has ids."""
    totals = _partial_counts(aligned).groupBy("a", "b").agg(F.sum("n").alias("count"))
    return totals.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def _rate(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    order = pc.sort_indices(pairs["place"])
    links = docs["links"].combine_chunks()
    places = links.flatten()
    each = pa.table({"row": pc.list_parent_indices(links), "count": pairs["count"].take(order).take(places),
                     "best": pairs["best"].take(order).take(places).cast(pa.int64())})
    sums = each.group_by("row", use_threads=False).aggregate([("count", "sum"), ("best", "sum")])
    out = {name: np.zeros(len(docs), np.int64) for name in ("count_sum", "best_sum")}
    for name, values in out.items():
        values[np.asarray(sums["row"])] = np.asarray(sums[name])
    kept = docs.drop_columns(["part", "block", "links"])
    return kept.append_column("n_best", pa.array(out["best_sum"])).append_column("count_sum", pa.array(out["count_sum"]))


def rate(aligned: DataFrame) -> DataFrame:
    """The written result of ``align`` with what its links count over the whole corpus.

    n_links and n_groups are the common ends in a row, n_best its links whose pair is its B id's most frequent
    one (ties count), count_sum the counts of its links' pairs added up. A block meets the counts of its own
    pairs only. Other columns of ``aligned`` stay.
    """
    marks = _partial_counts(aligned).join(pair_counts(aligned), ["a", "b"]).select(
        F.col("part").alias("in_part"), F.col("block").alias("in_block"), "place", "count", "best")
    rows = aligned.drop("pairs").withColumn("n_links", F.size("links").cast("long")).withColumn("n_groups", F.col("n_links"))
    kept = rows.drop("part", "block", "links")
    schema = kept.schema.add("n_best", "long").add("count_sum", "long")
    return rows.groupBy("part", "block").cogroup(marks.groupBy("in_part", "in_block")).applyInArrow(_rate, schema)
