"""A minimal perfect hash over fixed keys: n different keys get the slots 0 to n - 1.

Keys are rows of whole numbers. A level has two bits a key that is left: keys that are alone at their hashed place set it,
the others go on to the next level with another hash. A key's slot is the number of bits set before its own. Keys that
were not among those built with get any slot, so callers compare the key stored at it (``find``).
"""

from __future__ import annotations

import numpy as np

_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def mixed(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit number of each row of ``keys`` (unsigned)."""
    h = np.full(len(keys), seed * int(_MIX[2]) % (1 << 64), np.uint64)
    for j in range(keys.shape[1]):
        h = (h ^ keys[:, j]) * _MIX[j % 3]
        h ^= h >> np.uint64(32)
        h *= _MIX[(j + 1) % 3]
        h ^= h >> np.uint64(29)
    return h


class PerfectHash:
    """``keys`` (n, width), each row once; ``self.keys`` are in the order of their slots."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        left, slot, used = np.arange(n), np.empty(n, np.int64), 0
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        while len(left):
            size = -(-2 * len(left) // 8) * 8
            at = (mixed(keys[left], len(self.levels) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little")
            before = used + np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1]])
            self.levels.append((size, bits, before))
            single = alone[at]
            slot[left[single]] = self._rank(bits, before, at[single])
            used += int(alone.sum())
            left = left[~single]
        self.keys = np.empty_like(keys)
        self.keys[slot] = keys

    @staticmethod
    def _rank(bits: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        byte, bit = at >> 3, (at & 7).astype(np.uint8)
        return before[byte] + np.bitwise_count(bits[byte] & ((np.uint8(1) << bit) - np.uint8(1)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that are not stored."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, bits, before) in enumerate(self.levels):
            if not len(left):
                break
            at = (mixed(keys[left], level + 1) % np.uint64(size)).astype(np.int64)
            there = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
            out[left[there]] = self._rank(bits, before, at[there])
            left = left[~there]
        some = np.flatnonzero(out >= 0)
        out[some[(self.keys[out[some]] != keys[some]).any(axis=1)]] = -1
        return out
