"""Token ids of whole documents in compressed, checksummed files.

Documents are sorted by id, encoded, and cut into segments of whole documents. A segment is a
row of a Parquet file: the ids of its documents, their token counts, and the blocks of the
range coder (id_coder). Starts are counted from the totals of the partitions, so no task sees
all documents.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from flowlens.llm.id_coder import BLOCK, decode, encode
from flowlens.llm.shared import scratch_path

END = 0
#: Spellings with known ids that a worker keeps; when there are more, those that were met in one step only go.
WORDS_KEPT = 800_000
#: Bytes of text that are cut and looked up at a time; a longer text is one step.
STEP = 8_000_000
#: Kinds of bytes: ASCII white space and controls, ASCII letters, other visible ASCII, parts of other characters.
WHITE, LETTER, SIGN, WIDE = range(4)
KINDS = np.array([WHITE if b < 33 or b == 127 else WIDE if b > 127 else LETTER if chr(b).isalpha() else SIGN
                  for b in range(256)], np.uint8)
#: First bytes of the characters among which Unicode has white space.
MAYBE_WHITE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
#: A spelling that can be encoded beside others: a space or line break or none, then no more ASCII white space or
#: controls, and neither first nor last a character that may be white space of another kind.
VISIBLE = rb"(?:[!-~]|[\xc3-\xdf][\x80-\xbf]|[\xe4-\xef][\x80-\xbf]{2}|[\xf0-\xf7][\x80-\xbf]{3})"
SIMPLE = re.compile(rb"[ \n]?" + VISIBLE + rb"(?:[^\x00-\x20\x7f]*" + VISIBLE + rb")?")
SEGMENT = "part int, segment long, doc_ids array<long>, lengths array<long>, n_tokens long, blocks binary"


def public_vocabulary() -> str:
    """Where the byte-level vocabulary lies on this machine."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
    from tokenizers import Tokenizer
    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True  # their strings in a text are ordinary text
    return loaded


class Encoder:
    """Encodes texts with a byte-level tokenizer, a spelling once per worker.

    Such a tokenizer splits before white space that follows something visible, and between a letter and a sign
    or digit, whatever else stands there, so the pieces between can be encoded alone. The pieces of many texts
    are found, numbered and replaced by their ids as arrays; only new spellings reach the tokenizer.
    """

    def __init__(self, path: str, kept: int | None = None) -> None:
        self.tokenizer, self.kept = _tokenizer(path), kept
        # In a vocabulary of this kind a space is written as the letter G with a dot above.
        words = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(words.values()) + 1, bool)
        self.spaced[[n for w, n in words.items() if w.startswith("\u0120")]] = True
        self.break_ = self._ids(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        """The ids of spelling ``n`` are ``ids[at[n]:at[n + 1]]``; ``met`` counts the steps that had it."""
        self.known: dict[bytes, int] = {}
        self.ids, self.at, self.met = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _forget_rare(self, room: int) -> None:
        """Keep the spellings met in several steps, or none if these fill half of the room too."""
        often = self.met > 1
        if 2 * often.sum() > room:
            return self._forget()
        size = np.diff(self.at)
        self.ids, self.met = self.ids[np.repeat(often, size)], np.zeros(often.sum(), np.int64)
        self.at = np.concatenate([[0], np.cumsum(size[often])])
        place = np.cumsum(often) - 1
        self.known = {s: int(place[n]) for s, n in self.known.items() if often[n]}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _numbers(self, spellings: list[bytes]) -> np.ndarray:
        """The numbers of spellings, those of new ones after all others."""
        room = self.kept or WORDS_KEPT
        if len(self.known) > room:
            self._forget_rare(room)
        numbers = np.fromiter(map(self.known.get, spellings, repeat(-1)), np.int64, len(spellings))
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            self._learn([spellings[n] for n in unknown])
            numbers[unknown] = [self.known[spellings[n]] for n in unknown]
        self.met[numbers] += 1  # spellings differ, so no number is there twice
        return numbers

    def _learn(self, new: list[bytes]) -> None:
        """Ids of new spellings, encoded many at a time with a space or line break before each and cut there."""
        kinds = [[], [], [], []]
        for s in new:
            kinds[(0 if s[0] == 32 else 1 if s[0] == 10 else 2) if SIMPLE.fullmatch(s) else 3].append(s)
        later, begin, inner, odd = kinds  # a line break may stand before an inner one: nothing looks back
        ids, sizes = [self.ids], [np.diff(self.at)]
        for some, mark, kept in ((later, b"", True), (begin, b"", True), (inner, b"\n", False)):
            for at in range(0, len(some), 1_000):
                part = some[at:at + 1_000]
                found = self._ids([(mark + mark.join(part)).decode()])[0]
                marks = self.spaced[found] if some is later else found == self.break_[0]
                starts = np.flatnonzero(marks)
                if len(starts) != len(part):
                    raise ValueError("the vocabulary doesn't begin a token at every single space and line break")
                ids.append(found if kept else found[~marks])
                sizes.append(np.diff(starts, append=len(found)) - (not kept))
        for at in range(0, len(odd), 100):
            found = self._ids([s.decode() for s in odd[at:at + 100]])
            ids += found
            sizes.append(np.array([len(f) for f in found]))
        self.met = np.append(self.met, np.zeros(len(new), np.int64))
        self.known.update(zip(chain(later, begin, inner, odd), range(len(self.known), len(self.known) + len(new))))
        self.ids = np.concatenate(ids)
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with END after them."""
        ids, ends = self.encode_flat(texts)
        out = np.full(len(ids) + len(texts), END, np.uint32)
        stops = ends + np.arange(len(texts)) + 1
        inside = np.ones(len(out), bool)
        inside[stops - 1] = False
        out[inside] = ids
        return np.split(out, stops[:-1]) if texts else []

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's end."""
        lines = [t.encode() for t in texts]
        stops = np.cumsum([len(b) for b in lines], dtype=np.int64)
        whole = b"".join(lines)
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        starts = _cuts(np.frombuffer(whole, np.uint8), stops)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(np.append(starts, len(whole))), pa.py_buffer(whole)]).dictionary_encode()
        number = self._numbers(pieces.dictionary.to_pylist())
        begin, size = self.at[number], self.at[number + 1] - self.at[number]
        piece = pieces.indices.to_numpy()
        size = size[piece]
        after = np.cumsum(size)
        ids = self.ids[np.repeat(begin[piece] - after + size, size) + np.arange(after[-1])]
        return ids, np.append(0, after)[np.searchsorted(starts, stops)]


def _cuts(data: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where pieces of ``data`` begin: at each text (``stops`` are the ends), and at safe places inside."""
    kind = KINDS[data]
    white = np.zeros(len(data), bool)
    white[1:] = (kind[1:] == WHITE) & (kind[:-1] != WHITE)
    wide = np.flatnonzero(white[1:] & (kind[:-1] == WIDE))  # of these, those that may be white space are kept whole
    begin = np.maximum(wide[:, None] - np.arange(1, 3), 0)
    white[1:][wide[MAYBE_WHITE[data[begin]].any(axis=1)]] = False
    white[1:] |= (kind[1:] == SIGN) & (kind[:-1] == LETTER)
    white[0] = True
    white[stops[stops < len(data)]] = True
    return np.flatnonzero(white)


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One a Python worker, which runs several tasks: later tasks know the words of earlier ones."""
    return Encoder(path)


def _write(vocabulary: str, segment_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(vocabulary), TaskContext.get().partitionId()
        schema = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                            ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("blocks", pa.binary())])
        number, docs, ids, held = 0, [], [], 0

        def out():
            lengths = [len(i) for i in ids]
            return pa.RecordBatch.from_pylist([{
                "part": part, "segment": number, "doc_ids": docs, "lengths": lengths, "n_tokens": sum(lengths),
                "blocks": encode(np.concatenate(ids))}], schema)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            # Steps of about STEP bytes, cut after the text that reaches them.
            size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            ends = np.flatnonzero(np.diff(size // STEP, append=-1)) + 1
            for at, end in zip([0, *ends], ends):
                some = [t or "" for t in texts.slice(at, end - at).to_pylist()]
                for name, found in zip(names[at:end], encoder.encode(some)):
                    docs.append(name)
                    ids.append(found)
                    held += len(found)
                    if held >= segment_tokens:
                        yield out()
                        number, docs, ids, held = number + 1, [], [], 0
        if docs:
            yield out()
    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, segment_tokens: int = BLOCK) -> None:
    """Write the ids of all texts of ``docs`` under ``path``, in ascending ``doc_id`` order.

    A null text is empty and has the end id only. Repeated rows are documents of their own, rows of one
    id stand together, null ids first. Parts follow each other in the order of their numbers, segments of
    a part likewise. An empty table gives files without rows. Other columns are left out.
    """
    ordered = (docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
               .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text"))
    (ordered.mapInArrow(_write(vocabulary or public_vocabulary(), segment_tokens), SEGMENT)
     .write.option("compression", "none").parquet(path))


def _read(use: Callable[[dict, np.ndarray], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n] for c in batch.schema.names}
                data = row.pop("blocks").as_buffer()
                row = {c: v.as_py() for c, v in row.items()}
                ids = decode(bytes(data))
                if len(ids) != row["n_tokens"]:
                    raise ValueError(f"segment {row['part']}/{row['segment']} has {len(ids)} ids, not {row['n_tokens']}")
                yield use(row, ids)
    return run


def _digest(row: dict, ids: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(row["lengths"])
    starts = ends - row["lengths"]
    little = ids.astype("<u4")
    return pa.RecordBatch.from_pydict({
        "part": pa.array([row["part"]] * len(ends), pa.int32()), "segment": pa.array([row["segment"]] * len(ends), pa.int64()),
        "doc_id": pa.array(row["doc_ids"], pa.int64()), "inside": pa.array(starts, pa.int64()),
        "n_tokens": pa.array(row["lengths"], pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(little[a:b]) for a, b in zip(starts, ends)], pa.int64())})


def _split(row: dict, ids: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(row["lengths"])
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(row["doc_ids"], pa.int64()),
        "ids": pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(ids.astype(np.int32)))})


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, ids) per document, end id included."""
    return spark.read.parquet(path).mapInArrow(_read(_split), "doc_id long, ids array<int>")


def document_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the decoded files."""
    files = spark.read.schema(SEGMENT).parquet(path)
    # Token counts are columns of the files: no block is decoded for the starts.
    counts = files.select("part", "segment", "n_tokens")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("t"))  # one row per task that wrote
    parts = parts.select("part", F.coalesce(F.sum("t").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    begins = (counts.join(parts, "part")
              .select("part", "segment", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("begin")))
    found = files.mapInArrow(_read(_digest), "part int, segment long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return found.join(begins, ["part", "segment"]).select(
        "doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``document_digests`` of files of its own in the shared folder."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, vocabulary)
    return document_digests(docs.sparkSession, path)
