"""First digits of md5 over many short texts at once: the hash that SQL has, a step for whole arrays at a time."""

from __future__ import annotations

import numpy as np

_TURN = [np.uint32(x) for x in [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4]
_SINE = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _first_word(words: list[np.ndarray | None]) -> np.ndarray:
    """The first 32 bits of md5 over one block: 16 words of it, each an array over texts; None for zeros."""
    n = len(words[0])
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, h = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        a += _SINE[i]
        if (w := words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16]) is not None:
            a += w
        np.left_shift(a, _TURN[i], out=f)
        np.right_shift(a, np.uint32(32) - _TURN[i], out=h)
        f |= h
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (a + _START[0]).byteswap()


def starts(head: bytes, first: int, end: int, after: bytes = b"") -> list[tuple[np.ndarray, int]]:
    """Blocks that begin with ``head``, a number from ``first`` (1 at least) to ``end`` - 1 and ``after``, and how long that is; one a length."""
    out, head_ = [], np.frombuffer(head, np.uint8)
    for digits in range(len(str(first)), len(str(end)) + 1):
        x = np.arange(max(first, 10 ** (digits - 1)), min(end, 10**digits))
        if len(x):
            block, at = np.zeros((len(x), 64), np.uint8), len(head) + digits
            block[:, : len(head)] = head_
            for j in range(digits):
                block[:, len(head) + j] = x // 10 ** (digits - 1 - j) % 10 + 48
            block[:, at : at + len(after)] = np.frombuffer(after, np.uint8)
            out.append((block, at + len(after)))
    return out


def messages(size: int, numbers: np.ndarray) -> np.ndarray:
    """(numbers, 64): blocks with room for a head of ``size`` bytes, then one of ``numbers`` (any whole numbers) and md5's ending."""
    text = np.ascontiguousarray(numbers.astype("S20"))
    if size + 20 > 55:
        raise ValueError("texts of more than 55 bytes")
    end = size + np.char.str_len(text)
    block = np.zeros((len(text), 64), np.uint8)
    block[:, size : size + 20] = text.view(np.uint8).reshape(-1, 20)
    block[np.arange(len(text)), end] = 0x80
    block[:, 56], block[:, 57] = end * 8 & 255, end * 8 >> 8
    return block


def headed_words(blocks: np.ndarray, heads: list[bytes]) -> np.ndarray:
    """(heads, numbers): the number of the first 8 digits of md5 of each head, all of one size, and number. ``blocks``: as of ``messages``."""
    each = np.repeat(blocks[None], len(heads), axis=0)
    each[:, :, : len(heads[0])] = np.frombuffer(b"".join(heads), np.uint8).reshape(len(heads), 1, -1)
    w = np.ascontiguousarray(each.reshape(-1, 64).view("<u4").T)
    return _first_word([x if x.any() else None for x in w] if len(w[0]) else list(w)).reshape(len(heads), len(blocks))


def md5_words(blocks: list[tuple[np.ndarray, int]], tail: bytes) -> np.ndarray:
    """The number of the first 8 digits of md5 for each of ``starts`` followed by ``tail`` (texts of 55 bytes at most)."""
    out, rest = [], np.frombuffer(tail + b"\x80", np.uint8)
    for block, at in blocks:
        if at + len(tail) > 55:
            raise ValueError("texts of more than 55 bytes")
        block[:, at:56] = 0
        block[:, at : at + len(rest)] = rest
        block[:, 56], block[:, 57] = (at + len(tail)) * 8 & 255, (at + len(tail)) * 8 >> 8
        w, used = block.view("<u4"), -(-(at + len(rest)) // 4)
        out.append(_first_word([np.ascontiguousarray(w[:, j]) if j < used or j == 14 else None for j in range(16)]))
    return np.concatenate(out)
