"""Words of a text and their 64-bit hashes, for operators that work on arrays of hashes inside tasks.

Words are runs of bytes other than the space and the control characters 9 to 13; ``bytes.split()`` cuts at exactly these.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_BASE = 0x2545F4914F6CDD1D
_MASK = (1 << 64) - 1
#: Bytes of text that are hashed at once; a longer text makes a group of its own.
GROUP = 1 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scrambles 64-bit values (splitmix64); another seed gives an independent function."""
    x = x + np.uint64((2 * int(seed) + 1) * _STEP & _MASK)
    x ^= x >> np.uint64(30)
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MARKS = _SPACE.copy()                               # everything in ASCII but letters and digits
_MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
_BYTE = mix(np.arange(256, dtype=np.uint64), 5)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, kept up to ``GROUP``."""

    kept = None

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        make = lambda m: (_powers(_BASE, m), _powers(pow(_BASE, -1, 1 << 64), m))
        if n > GROUP:
            return make(n)
        if cls.kept is None:
            cls.kept = make(GROUP)
        return cls.kept


class Words(NamedTuple):
    """The words of some texts: hashes, the first and last byte (exclusive) of each in ``data``; text i has the words ends[i] to ends[i + 1].
    ``total`` are the running hash sums of the bytes."""

    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    total: np.ndarray

    def prefixes(self, words: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the first ``length`` bytes of the given words, which have to be that long."""
        first = self.first[words]
        return mix((self.total[first + length] - self.total[first]) * _Powers.of(len(self.data))[1][first], 100 + length)

    def text_words(self, i: int) -> slice:
        return slice(int(self.ends[i]), int(self.ends[i + 1]))


def grouped_words(texts: pa.Array, lower: bool = False, letters: bool = False, ends: np.ndarray | None = None) -> Iterator[tuple[int, Words]]:
    """(number of the first text, words) for groups of neighbouring texts; a null is an empty text, ``lower`` turns A-Z to a-z. With ``letters``
    words also end at every ASCII mark; ``ends`` tells for each of the 256 bytes whether words end there instead."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP, "right")) - 1)
        to = min(to, len(texts))
        yield at, _words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower, ends if ends is not None else _MARKS if letters else _SPACE)
        at = to


def _words(data: np.ndarray, bounds: np.ndarray, lower: bool, space: np.ndarray) -> Words:
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), none, none, np.zeros(len(bounds), np.int64), data, np.zeros(1, np.uint64))
    inside = ~space[data]
    before = np.empty(n, bool)                       # whether the byte before belongs to the same text and is no space
    before[0] = False
    before[1:] = inside[:-1]
    cuts = bounds[1:-1]
    before[cuts[cuts < n]] = False
    first = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    last = np.flatnonzero(inside & ~after) + 1
    power, inverse = _Powers.of(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * power[:n], out=total[1:])
    hashes = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64), 7)
    return Words(hashes, first, last, np.searchsorted(first, bounds), data, total)


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbouring words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = mix(words[:n], width)
    for k in range(1, width):
        h += words[k : k + n]
        h = mix(h)
    return h


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
