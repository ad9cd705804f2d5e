"""Words of many texts at once, and 128 bits of hash for each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mix64

#: A-Z lower-cased, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SOLID, BLANK, STOP = range(3)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def byte_kinds(blanks: bytes, stops: bytes = b"") -> np.ndarray:
    """For each byte: part of a word, between words, or between pieces."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(blanks)], kinds[list(stops)] = BLANK, STOP
    return kinds


@dataclass
class Words:
    """Words of a chunk: bytes (lower-cased), begin and end of each, its text, its piece (rising over the chunk), and hashes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    piece: np.ndarray
    hashes: tuple[np.ndarray, ...]


class WordReader:
    """Splits chunks of texts into words; keeps its tables of powers from chunk to chunk."""

    def __init__(self, kinds: np.ndarray, n_hashes: int = len(_BASES)):
        self.kinds, self._powers = kinds, [(np.ones(1, np.uint64),) * 2 for _ in _BASES[:n_hashes]]

    def _tables(self, i: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers[i][0]) < n:
            up, down = np.full((2, n), _BASES[i], np.uint64)
            down[:] = pow(_BASES[i], -1, 1 << 64)
            up[0] = down[0] = 1
            self._powers[i] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        return self._powers[i]

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """The hashes of the bytes start:end, each a polynomial read off a running sum."""
        found, raised = [], data.astype(np.uint64) + np.uint64(1)
        for i in range(len(self._powers)):
            up, down = self._tables(i, len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(raised * up[: len(data)], out=sums[1:])
            found.append(mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
        return tuple(found)

    def read(self, raw: np.ndarray, offsets: np.ndarray) -> Words:
        """The words of the texts raw[offsets[i]:offsets[i + 1]]; none reaches over a text's end."""
        data, kind = LOWER[raw], self.kinds[raw]
        solid = kind == SOLID
        first, last = solid.copy(), solid.copy()
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        text = np.searchsorted(offsets, start, "right") - 1
        return Words(data, start, end, text, np.cumsum(kind == STOP)[start] + text, self.hashes(data, start, end))
