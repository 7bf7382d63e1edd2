"""Words and shingles of whole text columns, a batch at a time, in numpy.

All functions work on the UTF-8 bytes of an Arrow string column: one buffer, no Python object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
# Fixed odd constants of the splitmix64 finaliser.
MIX = (U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit value of each 64-bit value (splitmix64)."""
    x = x + MIX[0]
    x = (x ^ (x >> U64(30))) * MIX[1]
    x = (x ^ (x >> U64(27))) * MIX[2]
    return x ^ (x >> U64(31))


def lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lowered()
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def slices(column: pa.Array, most: int = 1 << 22):
    """Pieces (first row, bytes, offsets) of a string column of about ``most`` bytes; null is empty.

    Working on a few MB at a time bounds memory whatever the batch holds; one text is never cut.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """The words of a piece: byte bounds, the row each belongs to, and a 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray):
        self.bytes = LOWER[data]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~breaks[self.bytes]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        step = np.diff(inside)
        starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        # A word also ends where its text ends.
        joined = np.unique(cut[(inside[cut] == 1) & (inside[cut + 1] == 1)])
        if len(joined):
            starts, stops = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([stops, joined]))
        self.starts, self.stops = starts, stops
        self.row = np.searchsorted(offsets, starts, "right") - 1
        self.counts = np.bincount(self.row, minlength=len(offsets) - 1) if len(starts) else np.zeros(len(offsets) - 1, np.int64)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        """Sum over a word's bytes of a random value per (byte, place), mixed with the length."""
        if not len(self.starts):
            return np.zeros(0, U64)
        sizes = self.stops - self.starts
        at = np.repeat(self.starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        place = at - np.repeat(self.starts, sizes)
        values = mixed(self.bytes[at].astype(U64) + (place.astype(U64) << U64(8)))
        sums = np.add.reduceat(values, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        return mixed(sums ^ sizes.astype(U64))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of ``size`` words from each word on, and whether they lie within one text."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, bool)
        out = np.zeros(n, U64)
        for k in range(size):
            out += self.hashes[k : k + n] * mixed(np.array([k + 1], U64))[0]
        return mixed(out), self.row[:n] == self.row[size - 1 :]
