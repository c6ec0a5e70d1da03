"""Vectorised hashes of words and of byte ranges over many texts at once.

Sums of products wrap at 2**64. Every byte or word first passes through a random
table or a mixer, so that the low bits of a hash depend on its whole range.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(7))
BYTE = _RNG.integers(0, 2**63, (2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
IS_GAP = np.zeros(256, bool)
IS_GAP[[9, 10, 11, 12, 13, 32]] = True

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of base k and of its inverse."""
    have = _POWERS.get(k)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 20)
        base = BASES[k]
        steps = [np.full(size, b, np.uint64) for b in (base, pow(base, -1, 2**64))]
        for s in steps:
            s[0] = 1
            np.multiply.accumulate(s, out=s)
        _POWERS[k] = have = (steps[0], steps[1])
        if size > 1 << 23:  # one very long text: not worth keeping
            del _POWERS[k]
    return have[0][:n], have[1][:n]


class Ranges:
    """Hashes of any ranges of one array of 64-bit values."""

    def __init__(self, values: np.ndarray, k: int):
        up, self.down = powers(k, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - begin).astype(np.uint64)
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + length * np.uint64(0xA24BAED4963EE407))


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the text it belongs to."""
    solid = ~IS_GAP[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | cut[1:-1]
    end = solid
    end[:-1] &= ~solid[1:] | cut[1:-1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begin, end, np.searchsorted(off, begin, "right") - 1


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Ranges(BYTE[0][raw], 0)(begin, end)
