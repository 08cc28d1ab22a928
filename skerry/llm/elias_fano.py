"""Elias-Fano coding of non-decreasing integers: low bits packed, high bits in unary, sampled select."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQB")
SAMPLE = 256
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(values: np.ndarray) -> bytes:
    """``values``: non-decreasing, not negative. About 2 + log2(universe / count) bits a value."""
    v = np.asarray(values, np.uint64)
    n, u = len(v), int(v[-1]) + 1 if len(v) else 0
    low_bits = max(0, (u // n).bit_length() - 1) if n else 0
    low = b""
    if low_bits:
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    high[at] = 1
    samples = at[::SAMPLE].astype("<u4").tobytes()
    return _HEAD.pack(n, u, low_bits) + samples + low + np.packbits(high, bitorder="little").tobytes()


class EliasFano:
    """Reads what ``encode`` wrote; ``select(i)`` touches one sample and the high bits after it."""

    def __init__(self, data: bytes):
        self.n, self.universe, self.low_bits = _HEAD.unpack_from(data)
        k = -(-self.n // SAMPLE)
        a = _HEAD.size
        b = a + 4 * k
        c = b + -(-self.n * self.low_bits // 8)
        self.samples = np.frombuffer(data, "<u4", k, a)
        self.low = np.frombuffer(data, np.uint8, c - b, b)
        self.high = np.frombuffer(data, np.uint8, -1, c)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th value (from 0)."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        rest = i % SAMPLE + 1
        byte = at // 8
        first = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (ones := int(_POPCOUNT[first])) < rest:
            rest -= ones
            byte += 1
            first = int(self.high[byte])
        for bit in range(8):
            rest -= first >> bit & 1
            if not rest:
                break
        low = 0
        for j in range(self.low_bits):
            p = i * self.low_bits + j
            low |= (int(self.low[p // 8]) >> (p % 8) & 1) << j
        return (byte * 8 + bit - i) << self.low_bits | low

    def select_range(self, a: int, b: int) -> np.ndarray:
        """The values a to b - 1, as int64: reads the high bits between the samples around them, and their low bits."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        if a == b:
            return np.empty(0, np.int64)
        first = a // SAMPLE
        begin = int(self.samples[first]) // 8
        last = -(-b // SAMPLE)
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        ones = 8 * begin + np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little"))
        skip = int(np.searchsorted(ones, int(self.samples[first]))) + a - first * SAMPLE
        high = ones[skip : skip + b - a] - np.arange(a, b)
        out = high.astype(np.int64) << self.low_bits
        if self.low_bits:
            at = a * self.low_bits
            bits = np.unpackbits(self.low[at // 8 : -(-b * self.low_bits // 8)], bitorder="little")[at % 8 :][: (b - a) * self.low_bits].reshape(b - a, -1)
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out

    def all(self) -> np.ndarray:
        """Every value, as int64."""
        return self.select_range(0, self.n)
