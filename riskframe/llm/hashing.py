"""Words of Arrow text columns and their 64-bit hashes, by numpy over the bytes of many documents at once.

A word is a run of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``, which in UTF-8 is the same as a run of such
characters. Hashes depend on the bytes alone, so every task and every retry gets the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 2**64)
WINDOW = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Upper-case ASCII letters as lower-case ones.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The lowest k bytes of a lane.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_places = mix(np.arange(1, 1 << 10, dtype=np.uint64) * np.uint64(BASE))


def _place_keys(n: int) -> np.ndarray:
    """A number for each of the first ``n`` lanes of a word."""
    global _places
    if len(_places) < n:
        _places = mix(np.arange(1, 2 * n, dtype=np.uint64) * np.uint64(BASE))
    return _places[:n]


@dataclass
class Words:
    """Words of a run of documents: byte spans, the first word of each document and, at the end, their number."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document, by its place in the run, of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def lanes(self, table: np.ndarray | None = None) -> "Lanes":
        """The bytes of each word, eight at a time; ``table`` replaces bytes first."""
        return Lanes.of(self.data if table is None else table[self.data], self.starts, self.ends)

    def hashes(self, table: np.ndarray | None = None) -> np.ndarray:
        """One number per word, from its lanes and their places in it, each mixed before they are added up."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lanes = self.lanes(table)
        mixed = mix(lanes.values ^ _place_keys(int(lanes.number.max()))[lanes.place])
        sums = mixed if len(mixed) == len(self.starts) else np.add.reduceat(mixed, lanes.first)
        return mix(sums + (self.ends - self.starts).astype(np.uint64) * np.uint64(BASE))


@dataclass
class Lanes:
    """Eight bytes each of a run of words: their values, the first lane and the number of lanes of each word."""

    values: np.ndarray
    place: np.ndarray
    first: np.ndarray
    number: np.ndarray

    @staticmethod
    def of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> "Lanes":
        number = (ends - starts + 7) >> 3
        upto = np.cumsum(number)
        first = upto - number
        place = np.arange(upto[-1]) - np.repeat(first, number)
        at = np.repeat(starts, number) + 8 * place
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        every = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
        values = every[at] & MASKS[np.minimum(np.repeat(ends, number) - at, 8)]
        return Lanes(values, place, first, number)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, ends, data = column.buffers()
    if not len(column) or data is None or not data.size:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def split_words(column: pa.Array) -> Words:
    data, at = text_bytes(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(column) + 1, np.int64))
    space = SPACE[data]
    edge = np.ones(len(data) + 1, bool)  # a document or a space before the byte
    edge[1:] = space
    edge[at] = True
    edge[-1] = True
    starts = np.flatnonzero(~space & edge[:-1])
    after = np.ones(len(data) + 1, bool)
    after[:-1] = space
    after[at] = True
    ends = np.flatnonzero(~space & after[1:]) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of ``size`` consecutive values from each place; the last ``size - 1`` places have none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= WINDOW
        out += hashes[k : k + n]
    return mix(out)


def window_starts(words: Words, size: int) -> np.ndarray:
    """Places of the windows that lie within one document."""
    left = np.repeat(words.first[1:], words.counts()) - np.arange(len(words.starts))
    return np.flatnonzero(left >= size)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about ``most`` bytes of text, so that arrays over bytes stay small.

    A single longer text is a run of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end
