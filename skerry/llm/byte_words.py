"""Words of many texts at once, as ranges in one array of bytes, and checksums of such ranges."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together.
BATCH_BYTES = 3 << 20
#: Ranges longer than this go through zlib one by one.
_LONG = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, _TABLE >> 1 ^ np.uint32(0xEDB88320), _TABLE >> 1)


def slices(batch: pa.RecordBatch, text: int, limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in pieces of whole rows of about ``limit`` bytes of text, with their texts (null: empty)."""
    texts = [t or b"" for t in batch.column(text).cast(pa.large_binary()).to_pylist()]
    ends = np.cumsum([len(t) for t in texts])
    a = 0
    while a < len(texts):
        done = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(a, b - a), texts[a:b]
        a = b


def words(texts: list[bytes], in_word: np.ndarray, between: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lowered, first byte, end, text) of the words: longest runs of bytes that ``in_word`` has.

    ``between`` is one byte that is in no word; it stands after each text.
    """
    data = LOWER[np.frombuffer(between.join([*texts, b""]) or between, np.uint8)]
    ok = np.concatenate([[False], in_word[data], [False]])
    start, end = np.flatnonzero(ok[1:] & ~ok[:-1]), np.flatnonzero(ok[:-1] & ~ok[1:])
    return data, start, end, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The crc32 of each range of ``data``; with ``before`` it goes on from those checksums."""
    size = end - start
    state = (np.zeros(len(start), np.uint32) if before is None else before.astype(np.uint32)) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-size, kind="stable")
    at, c = start[order], state[order]
    long = int(np.searchsorted(-size[order], -_LONG, side="left"))
    live = np.searchsorted(-size[order], -np.arange(_LONG), side="left")
    for p in range(_LONG):
        k = int(live[p])
        if k == long:
            break
        c[long:k] = _TABLE[(c[long:k] ^ data[at[long:k] + p]) & np.uint32(255)] ^ c[long:k] >> np.uint32(8)
    c ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        c[i] = zlib.crc32(data[at[i] : end[order[i]]].tobytes(), int(c[i]))
    out = np.empty(len(start), np.uint32)
    out[order] = c
    return out
