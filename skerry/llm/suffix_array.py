"""Suffix arrays by two-stage sorting, to a bounded depth, and their adjacent common prefixes.

A text is an array of symbols 1 to 255 in which 0 ends each string. Suffixes that are smaller than their successor
(type B) are sorted directly; all others (type A) follow from one scan over the buckets of first symbols: a suffix that
is in its place puts the one before it, if of type A, at the end of what its bucket holds so far.
"""

from __future__ import annotations

import numpy as np


def big_words(text: np.ndarray, depth: int) -> np.ndarray:
    """At each place the 8 symbols from there on as one number, the first symbol highest; zeros follow the text."""
    w = np.concatenate([text, np.zeros(depth + 16, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        w[:-step] = w[:-step] << np.uint64(8 * step) | w[step:]
    return w


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Type B: the suffix is smaller than the one that starts a symbol later."""
    n = len(text)
    rises = np.zeros(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    same = np.zeros(n, bool)
    same[:-1] = text[:-1] == text[1:]
    decided = np.minimum.accumulate(np.where(same, n - 1, np.arange(n))[::-1])[::-1]
    return rises[decided]


def sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols; ties are refined 8 symbols at a time."""
    first = words[places]
    order = np.argsort(first)
    places, first = places[order], first[order]
    starts = np.ones(len(places), bool)
    starts[1:] = first[1:] != first[:-1]
    for at in range(8, depth, 8):
        group = np.cumsum(starts) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(tied):
            break
        w = words[places[tied] + at]
        o = np.argsort(w)
        rank = np.empty(len(o), np.uint64)
        rank[o] = np.cumsum(np.concatenate([[False], w[o][1:] != w[o][:-1]]))
        o = np.argsort(group[tied].astype(np.uint64) << np.uint64(32) | rank)
        places[tied], w = places[tied][o], w[o]
        starts[tied[1:]] |= w[1:] != w[:-1]
    return places


def two_stage(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """All suffixes of ``text`` (which ends in 0), in order of their first ``depth`` symbols or up to a 0."""
    words = big_words(text, depth) if words is None else words
    small = smaller_than_next(text)
    ends = text == 0
    large = ~small & ~ends
    direct = sort_directly(np.flatnonzero(small & ~ends), words, depth)
    cuts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def scan(placed: np.ndarray, own: int) -> np.ndarray:
        """Deals what precedes ``placed`` to the buckets; gives back what goes to the bucket ``own`` itself."""
        before = placed - 1
        before = before[before >= 0]
        before = before[large[before]]
        symbol = text[before]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        at = np.concatenate([[0], np.flatnonzero(np.diff(symbol)) + 1, [len(symbol)]])
        mine = before[:0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if a < b and symbol[a] == own:
                mine = before[a:b]
            elif a < b:
                waiting[symbol[a]].append(before[a:b])
        return mine

    for c in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        if c == 0:
            placed = np.flatnonzero(ends)
            out.append(placed)
            scan(placed, 0)
            continue
        induced = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        waiting[c] = []
        while len(induced):
            out.append(induced)
            induced = scan(induced, c)
        placed = direct[cuts[c] : cuts[c + 1]]
        if len(placed):
            out.append(placed)
            scan(placed, c)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefixes(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in ``order`` how many symbols it shares with the one before it, ``depth`` at most (first: 0)."""
    shared = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for at in range(0, depth, 8):
        x = words[order[alive] + at] ^ words[order[alive - 1] + at]
        apart = x != 0
        gone, y = alive[apart], x[apart]
        equal = np.zeros(len(gone), np.int64)
        for t in range(1, 8):
            equal += y >> np.uint64(64 - 8 * t) == 0
        shared[gone] = np.minimum(at + equal, depth)
        alive = alive[~apart]
    shared[alive] = depth
    return shared
