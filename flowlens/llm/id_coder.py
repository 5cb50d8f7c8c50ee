"""Range coder for token ids with mixed adaptive predictions.

A block starts from an empty model, carries a checksum and can be read without the others.
Inside a block the ids are cut into streams that are coded side by side, one array element
per stream, with one model that learns from all of them.

The orders 2 and 1 predict the id that last followed the same two ids, or the same id; order 0
predicts by the counts of all ids so far. The three predictions are mixed by weights that the
model learns for each state of the two contexts' confidence. An id takes the part of the range
that the first prediction holding it has in the mix. All state is integer, so a reader repeats
the writer's state exactly.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Streams of a block at most, ids of a stream at least, and ids of a block at most.
STREAMS, LEAST, BLOCK = 4096, 256, 1 << 22
TOP, RENEW = 1 << 48, 1 << 32
#: Slots of the order-2 table, and steps between two renewals of counts and weights.
SLOTS, RENEWAL = 1 << 16, 32
STATES = 512


class _Writer:
    """48-bit ranges of all streams, renewed 16 bits at a time."""

    def __init__(self, streams: int) -> None:
        self.low, self.range = np.zeros(streams, np.int64), np.full(streams, TOP, np.int64)
        self.many = np.zeros(streams, np.int64)
        #: Words given so far: their streams, their places in these, and the words.
        self.given: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.carries: list[tuple[np.ndarray, np.ndarray]] = []

    def narrow(self, below: np.ndarray, part: np.ndarray) -> None:
        self.low += below
        over = self.low >= TOP
        if over.any():  # a carry into the last word given, settled at the end
            stream = np.flatnonzero(over)
            self.carries.append((stream, self.many[stream] - 1))
            self.low &= TOP - 1
        self.range = part
        small = np.flatnonzero(part < RENEW)
        if len(small):
            low, places = self.low[small], self.many[small]
            self.given.append((small, places, low >> 32))
            self.many[small] = places + 1
            self.low[small] = (low & (RENEW - 1)) << 16
            part[small] <<= 16

    def finish(self) -> tuple[np.ndarray, bytes]:
        """Words of each stream, and all streams' words one after another."""
        every = np.arange(len(self.many))
        self.given += [(every, self.many + n, (self.low >> s) & 0xFFFF) for n, s in enumerate((32, 16, 0))]
        many = self.many + 3
        begin = np.cumsum(many) - many
        streams, places, words_given = (np.concatenate(parts) for parts in zip(*self.given))
        words = np.empty(many.sum(), np.int32)
        words[begin[streams] + places] = words_given
        for stream, word in self.carries:
            words[begin[stream] + word] += 1
        while (over := np.flatnonzero(words >> 16)).size:  # a carry never leaves its stream
            words[over] &= 0xFFFF
            words[over - 1] += 1
        return many, words.astype("<u2").tobytes()


class _Reader:
    """The same ranges; ``low`` is the distance of the code from the low end."""

    def __init__(self, words: np.ndarray, many: np.ndarray) -> None:
        self.words = np.concatenate([words.astype(np.int64), [0]])
        self.at = np.cumsum(many) - many
        self.low = (self.words[self.at] << 32) | (self.words[self.at + 1] << 16) | self.words[self.at + 2]
        self.at += 3
        self.range = np.full(len(many), TOP, np.int64)

    def narrow(self, below: np.ndarray, part: np.ndarray) -> None:
        self.low -= below
        self.range = part
        small = part < RENEW
        if small.any():
            np.copyto(self.low, (self.low << 16) | self.words.take(self.at, mode="clip"), where=small)
            np.copyto(part, part << 16, where=small)
            self.at += small


class _Model:
    def __init__(self, streams: int, alphabet: int) -> None:
        self.alphabet, self.bits = alphabet, 16 if alphabet <= 1 << 14 else 18
        # A context's entry is the predicted id times 16 plus its confidence; 0 is none yet.
        self.order1, self.order2 = np.zeros(alphabet, np.int64), np.zeros(SLOTS, np.int64)
        self.last, self.context = np.zeros(streams, np.int64), np.zeros(streams, np.int64)
        self.counts = np.zeros(alphabet, np.int64)
        self.outcomes = np.zeros((STATES, 3), np.int64)
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []
        self.renewed, self.step_number = 0, 0
        self.renew()

    def renew(self) -> None:
        """Mix weights and order-0 parts from all that was coded."""
        for ids, outcome in self.seen:
            self.counts += np.bincount(ids, minlength=self.alphabet)
            self.outcomes += np.bincount(outcome, minlength=3 * STATES).reshape(STATES, 3)
        self.seen, self.renewed = [], self.step_number
        room = (1 << self.bits) - self.alphabet
        parts = 1 + self.counts * room // max(1, int(self.counts.sum()))
        parts[parts.argmax()] += (1 << self.bits) - int(parts.sum())
        self.below0 = np.concatenate([[0], np.cumsum(parts)])
        self.parts0 = parts
        self.symbol0 = np.repeat(np.arange(self.alphabet), parts)
        weighed = self.outcomes * 32 + np.array([1, 1, 30])
        self.mix = weighed * (65536 - 3 * 64) // weighed.sum(axis=1, keepdims=True) + 64
        self.weight2, self.weight1 = self.mix[:, 0].copy(), self.mix[:, 1].copy()

    def step(self, coder: _Writer | _Reader, ids: np.ndarray | None) -> np.ndarray:
        """Code the next id of every stream."""
        entry2, entry1 = self.order2.take(self.context), self.order1.take(self.last)
        guess2, guess1, sure2, sure1 = entry2 >> 4, entry1 >> 4, entry2 & 15, entry1 & 15
        state = (sure2 << 5) | (sure1 << 1) | (guess1 == guess2)
        weight2, weight1 = self.weight2.take(state), self.weight1.take(state)
        both, unit = weight2 + weight1, coder.range >> 16
        if ids is None:
            right2 = coder.low < weight2 * unit
            other = coder.low >= both * unit
        else:
            right2 = ids == guess2
            other = ~right2 & (ids != guess1)
        # In the mix the order-2 prediction lies first, order 1 next, order 0 takes the rest.
        below = np.where(other, both, np.where(right2, 0, weight2))
        part = np.where(other, 65536 - both, np.where(right2, weight2, weight1))
        coder.narrow(below * unit, part * unit)
        unit = coder.range >> self.bits
        if ids is None:
            # Exact: the quotient is under 2^18 and the divisor under 2^32.
            found = self.symbol0.take((coder.low / unit).astype(np.int64), mode="clip")
            ids = np.where(other, found, np.where(right2, guess2, guess1))
        coder.narrow(np.where(other, self.below0.take(ids) * unit, 0), np.where(other, self.parts0.take(ids) * unit, coder.range))
        self.seen.append((ids, state * 3 + np.where(other, 2, ~right2)))
        # A right prediction grows surer, a wrong one less sure, and is replaced when it is not sure at all.
        for table, at, entry, guess, sure in ((self.order2, self.context, entry2, guess2, sure2),
                                              (self.order1, self.last, entry1, guess1, sure1)):
            right = guess == ids
            table[at] = np.where(right, np.minimum(entry + 2, (guess << 4) + 14),
                                 np.where(sure < 2, (ids << 4) + 1, entry - ((sure + 1) >> 1)))
        self.context = (self.last * 40503 + ids * 30011) % SLOTS
        self.last = ids
        self.step_number += 1
        if self.step_number >= min(2 * self.renewed, self.renewed + RENEWAL):
            self.renew()
        return ids


_HEADER = struct.Struct("<IIIII")  # ids, streams, alphabet bytes, code bytes, crc32 of the ids


def _encode_block(ids: np.ndarray) -> bytes:
    found = np.bincount(ids)
    alphabet = np.flatnonzero(found)
    dense = (np.cumsum(found > 0) - 1)[ids]
    streams = min(STREAMS, -(-len(ids) // LEAST))
    steps = -(-len(ids) // streams)
    laid = np.zeros(streams * steps, np.int64)
    laid[:len(ids)] = dense
    laid = np.ascontiguousarray(laid.reshape(streams, steps).T)
    writer, model = _Writer(streams), _Model(streams, len(alphabet))
    for row in laid:
        model.step(writer, row)
    many, code = writer.finish()
    code = many.astype("<u4").tobytes() + code
    letters = zlib.compress(np.diff(alphabet, prepend=0).astype("<u4").tobytes())
    return _HEADER.pack(len(ids), streams, len(letters), len(code), zlib.crc32(ids.astype("<u4").tobytes())) + letters + code


def encode(ids: np.ndarray) -> bytes:
    """Blocks of at most BLOCK ids, one after another."""
    ids = np.asarray(ids, np.int64)
    return b"".join(_encode_block(ids[n:n + BLOCK]) for n in range(0, len(ids), BLOCK))


def decode(data: bytes) -> np.ndarray:
    """The ids; every block is compared with its checksum."""
    at, found = 0, [np.array([], np.uint32)]
    while at < len(data):
        count, streams, letters, size, crc = _HEADER.unpack_from(data, at)
        at += _HEADER.size
        alphabet = np.cumsum(np.frombuffer(zlib.decompress(data[at:at + letters]), "<u4").astype(np.int64))
        at += letters
        many = np.frombuffer(data, "<u4", streams, at).astype(np.int64)
        words = np.frombuffer(data, "<u2", (size - 4 * streams) // 2, at + 4 * streams)
        at += size
        reader, model = _Reader(words, many), _Model(streams, len(alphabet))
        rows = [model.step(reader, None) for _ in range(-(-count // streams))]
        ids = alphabet[np.stack(rows).T.reshape(-1)[:count]].astype("<u4")
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block doesn't have the ids of its checksum")
        found.append(ids)
    return np.concatenate(found)
