"""Byte-level BPE by a rank file: texts to ids with the tiktoken library, ids back to bytes.

The library matches a split pattern over the whole text and merges bytes inside each match. Its
matcher needs memory per character of a text and gives up on long runs of white space, so long texts
are cut first, at places where a match ends whatever surrounds them, and long white space is handed
over as the one match it is. Ids are then those of the uncut text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: Characters of a text that are handed to the library at once, if a cut can be found.
CHUNK = 16_384
#: White space from this length on is encoded as a match of its own.
LONG_RUN = 256
#: Unicode's White_Space, which the pattern's \s stands for.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_WHITE = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")
#: A visible character before white space, a letter or number before an ASCII sign, or ASCII letters beside digits. No match goes
#: over such a place and none looks back; only white space looks ahead, and it ends before a visible character.
SAFE = re.compile(rf"(?<=\S)(?=[{WHITE}])|(?<=[^\W_])(?=[!-/:-@\[-`{{-~])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def public_ranks() -> str:
    """Where the rank file lies on this machine."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def public_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


@lru_cache(2)
def load(ranks: str, pattern: str):
    """The library's encoding for a rank file: lines of a token in base64 and its rank."""
    import tiktoken
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_pieces(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """``text`` in pieces of ``chunk`` characters or less, cut at safe places only; longer where there is none."""
    at = 0
    while len(text) - at > chunk:
        # The last safe place in the second half of the chunk, else the first one after it.
        places = [m.start() for m in SAFE.finditer(text, at + chunk // 2, at + chunk + 1) if m.start() > at]
        cut = places[-1] if places else next((m.start() for m in SAFE.finditer(text, at + chunk)), len(text))
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def encode_text(encoding, text: str, chunk: int = CHUNK) -> list[int]:
    """Ids of a text of any length."""
    if len(text) < LONG_RUN:
        return encoding.encode_ordinary(text)
    ids, at = [], 0
    for run in LONG_WHITE.finditer(text):
        # The pattern takes a run as one match, but for its last character if visible text follows.
        end = run.end() if run.end() == len(text) else run.end() - 1
        for piece in safe_pieces(text[at:run.start()], chunk):
            ids += encoding.encode_ordinary(piece)
        ids += encoding._encode_single_piece(text[run.start():end])
        at = end
    for piece in safe_pieces(text[at:] if at else text, chunk):
        ids += encoding.encode_ordinary(piece)
    return ids


def _mapped(df: DataFrame, column: str, into: str, kind: T.DataType, convert: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``df`` with column ``into`` made from ``column``, batch by batch; other columns pass unread."""
    if df.columns.count(column) != 1:
        raise ValueError(f"one column named {column} is needed")
    kept = [n for n, name in enumerate(df.columns) if name != into]
    places = [f"c{n}" for n in range(len(df.columns))]  # names that clash would be lost in Arrow
    source = df.columns.index(column)
    schema = T.StructType([T.StructField(places[n], df.schema[n].dataType) for n in kept] + [T.StructField("made", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + [convert(batch.column(source))],
                                             [places[n] for n in kept] + ["made"])

    return df.toDF(*places).mapInArrow(run, schema).toDF(*[df.columns[n] for n in kept], into)


def encode(df: DataFrame, column: str = "text", into: str = "ids", ranks: str | None = None,
           pattern: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``df`` and the token ids of ``column``, an array of ints, as ``into``.

    A null text is encoded like an empty one, as no ids. Each row is encoded for itself: repeated rows
    give the same ids each, an empty table gives an empty one. Strings of special tokens are ordinary text.
    A column already named ``into`` is replaced, other columns pass unchanged, whatever their names.
    """
    ranks, pattern = ranks or public_ranks(), pattern or public_pattern()

    def convert(texts: pa.Array) -> pa.Array:
        encoding = load(ranks, pattern)
        found, ends = [], [0]
        for text in texts:
            ids = encode_text(encoding, text.as_py() or "", chunk)
            found.append(np.array(ids, np.int32))
            ends.append(ends[-1] + len(ids))
        flat = np.concatenate(found) if found else np.array([], np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    return _mapped(df, column, into, T.ArrayType(T.IntegerType()), convert)


def decode(df: DataFrame, column: str = "ids", into: str = "data", ranks: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """``df`` and the bytes that the ids in ``column`` stand for, as ``into``.

    Bytes, not a text: a token may end inside a character. A null array and null ids in it give no
    bytes; an id that the ranks don't have is an error. Other columns as in ``encode``.
    """
    ranks, pattern = ranks or public_ranks(), pattern or public_pattern()

    def convert(ids: pa.Array) -> pa.Array:
        encoding = load(ranks, pattern)
        return pa.array([encoding.decode_bytes(row.values.drop_null().to_numpy().tolist() if row.is_valid else [])
                         for row in ids], pa.binary())

    return _mapped(df, column, into, T.BinaryType(), convert)
