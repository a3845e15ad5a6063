"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A word is a run of digits, ASCII letters (lower-cased) and characters beyond ASCII; in UTF-8 every
byte of the latter is 0x80 or more, so bytes can be classified one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = True
IS_WORD[128:] = True
#: bytes.translate table: words in lower case, everything else a blank
BLANKED = bytes(int(LOWER[i]) if IS_WORD[i] else 32 for i in range(256))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: bytes of texts that are worked on at a time; the temporaries of a task are a few dozen times this
SLICE = 1 << 17
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        made = []
        for b in (_BASE, _INVERSE):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit keys over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair, from prefix sums: the same run, the same hash."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


@dataclass
class Words:
    """Words of rows lo..hi of a batch. start and end are byte offsets in ``data``; words of row i
    are those from first[i] to first[i + 1]."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def hashes(self) -> np.ndarray:
        return run_hashes(LOWER[self.data].astype(np.uint64) + np.uint64(1), self.start, self.end)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j of the slice in lower case, one blank between."""
        return b" ".join(bytes(LOWER[self.data[a:b]]) for a, b in zip(self.start[i:j], self.end[i:j]))


def byte_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, bounds) for runs of rows of about ``limit`` bytes, one row at least."""
    binary = column.cast(pa.large_binary()).fill_null(b"")
    n = len(binary)
    if not n:
        return
    _, offsets, data = binary.buffers()
    at = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_slices(column: pa.Array, limit: int = SLICE) -> Iterator[Words]:
    """Null counts as empty text."""
    for lo, hi, data, bounds in byte_slices(column, limit):
        inside = IS_WORD[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | cut[1:-1]
        closes[:-1] &= ~inside[1:] | cut[1:-1]
        start = np.flatnonzero(opens)
        yield Words(lo, hi, data, bounds, start, np.flatnonzero(closes) + 1, np.searchsorted(start, bounds))
