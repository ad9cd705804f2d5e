"""Word shingles of whole texts as 64-bit hashes, vectorised over many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import CHUNK_BYTES, mix64, text_chunks

_P = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Distinct ``width``-word shingles: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``.

    A text of fewer words has one shingle, its whole sequence; a text without
    words has none. Word hashes are polynomials over the bytes, taken from one
    running sum per chunk; a shingle combines the hashes of its words in order.
    """

    def __init__(self, width: int = 5):
        self.width = width
        self._size = 0

    def _tables(self, n: int) -> None:
        if n > self._size:
            self._size = max(n, CHUNK_BYTES + 1024)
            self._up, self._down = _powers(_P, self._size), _powers(_P_INV, self._size)

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and the number of words before each text's start."""
        solid = ~_SPACE[data]
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        self._tables(len(data) + 1)
        first, last = solid.copy(), solid.copy()
        inner = offsets[1:-1]
        edge = np.zeros(len(data) + 1, bool)
        edge[inner] = True
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * self._up[: len(data)], out=sums[1:])
        words = mix64((sums[end + 1] - sums[start]) * self._down[start] + (end - start).astype(np.uint64))
        return words, np.searchsorted(start, offsets)

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text, in row order."""
        w = self.width
        for first, last, data, offsets in text_chunks(column):
            words, at = self._words(data, offsets)
            full = np.zeros(max(0, len(words) - w + 1), np.uint64)
            for j in range(w):
                full = full * _STEP + words[j : j + len(full)]
            full = mix64(full)
            for i in range(last - first):
                lo, hi = at[i], at[i + 1]
                if hi - lo >= w:
                    yield np.unique(full[lo : hi - w + 1])
                elif hi > lo:
                    x = np.uint64(0)
                    with np.errstate(over="ignore"):
                        for h in words[lo:hi]:
                            x = x * _STEP + h
                    yield mix64(np.array([x ^ np.uint64(hi - lo)], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)
