"""Token ids of many texts at once: each distinct run of white space and word is encoded once per worker.

Byte-level vocabularies split a text at every start of white space before a word, except that the last space of a run
joins the word; and at every change from a letter or digit to punctuation that ends a word. So the ids of a text are
those of its units: the white space before a word together with the word, the punctuation after it, the white space at
the end. Texts with white space beyond ``\\x20`` and ``\\x09``-``\\x0D`` are one unit.
Units are known by their bytes; a 64-bit hash only finds the equal ones of a batch, which are then compared.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from riskframe.llm import hashing

OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: First bytes of the UTF-8 forms of those characters.
LEADS = np.zeros(256, bool)
LEADS[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[33:127] = True
PUNCTUATION &= ~ALNUM


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] places, then the same for the next start."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def units(column: pa.Array) -> hashing.Words:
    words = hashing.split_words(column)
    data = words.data
    _, at = hashing.text_bytes(column)
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        cut[words.ends] = True
        # A single line break before a word, and ASCII punctuation at the end of a word, stand by themselves: fewer units.
        after_break = words.starts[words.starts > 1]
        after_break = after_break[(data[after_break - 1] != 32) & hashing.SPACE[data[after_break - 1]]]
        cut[after_break[~hashing.SPACE[data[after_break - 2]]]] = True
        marks = np.flatnonzero(ALNUM[data[:-1]] & PUNCTUATION[data[1:]]) + 1
        others = np.append(np.flatnonzero(~PUNCTUATION[data]), len(data))
        after = others[np.searchsorted(others, marks)]
        cut[marks[(after == len(data)) | hashing.SPACE[data[np.minimum(after, len(data) - 1)]]]] = True
        odd = [i for i in np.unique(np.searchsorted(at, np.flatnonzero(LEADS[data]), "right") - 1).tolist() if OTHER_SPACE.search(column[i].as_py())]
        for i in odd:
            cut[at[i] : at[i + 1]] = False
        cut[at] = True
    cut[0] = False
    ends = np.flatnonzero(cut)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
    return hashing.Words(data, starts, ends, np.searchsorted(starts, at))


def distinct(parts: hashing.Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of units that stand for all equal ones, and for each unit the place in that list of the one like it.

    Units of one hash are compared with the one that stands for them; any that differ stand for themselves.
    """
    _, sample, inverse = np.unique(parts.hashes(), return_index=True, return_inverse=True)
    lanes = parts.lanes()
    like = sample[inverse]
    length = parts.ends - parts.starts
    same = length == length[like]
    checked = np.flatnonzero(same)
    number = lanes.number[checked]
    own, other = spread(lanes.first[checked], number), spread(lanes.first[like[checked]], number)
    differ = lanes.values[own] != lanes.values[other]
    same[np.repeat(checked, number)[differ]] = False
    odd = np.flatnonzero(~same)
    inverse[odd] = len(sample) + np.arange(len(odd))
    return np.concatenate([sample, odd]), inverse


class Encoder:
    """Ids of text columns, with the ids of the units seen so far. At most ``most`` units are kept."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 600_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, keys: list[bytes], texts: list[str]) -> None:
        lists = self.encode(texts)
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        total, n = int(lengths.sum()), len(self.slot)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(lists) > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        self.pool[self.used : self.used + total] = np.fromiter((i for x in lists for i in x), np.int32, total)
        self.begin[n : n + len(lists)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(lists)] = lengths
        self.used += total
        self.slot.update(zip(keys, range(n, n + len(lists))))

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the n + 1 offsets."""
        parts = units(column)
        if not len(parts.starts):
            return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
        sample, inverse = distinct(parts)
        if len(self.slot) + len(sample) > self.most or self.used > 8 * self.most:
            self.clear()
        raw = parts.data.tobytes()
        keys = [raw[a:b] for a, b in zip(parts.starts[sample].tolist(), parts.ends[sample].tolist())]
        new = [key for key in keys if key not in self.slot]
        if new:
            self._add(new, [key.decode("utf-8", "replace") for key in new])
        slots = np.fromiter(map(self.slot.__getitem__, keys), np.int64, len(keys))[inverse]
        lengths = self.length[slots]
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])[parts.first]
        return self.pool[spread(self.begin[slots], lengths)], offsets
