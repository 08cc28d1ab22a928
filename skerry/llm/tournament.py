"""Merging sorted runs by a tournament tree of losers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def merged(runs: Sequence[Sequence], stop: int | None = None) -> Iterator[tuple[int, int]]:
    """(run, place in it) of the items of all runs in ascending order, at most ``stop`` of them; ties by run.

    Each run ascends. A node keeps the run that lost there, so an item costs one match a level.
    """
    k = len(runs)
    left = sum(map(len, runs)) if stop is None else min(stop, sum(map(len, runs)))
    if not left:
        return
    at = [0] * k
    # a run without items left loses to every other
    head = [(0, r[0], i) if len(r) else (1, None, i) for i, r in enumerate(runs)]
    loser, won = [0] * k, [0] * k + list(range(k))
    beats = lambda a, b: head[a][0] < head[b][0] or head[a][0] == head[b][0] == 0 and head[a][1:] < head[b][1:]
    for node in range(k - 1, 0, -1):
        a, b = won[2 * node], won[2 * node + 1]
        won[node], loser[node] = (b, a) if beats(b, a) else (a, b)
    best = won[1] if k > 1 else 0
    while True:
        yield best, at[best]
        left -= 1
        if not left:
            return
        at[best] += 1
        run = runs[best]
        head[best] = (0, run[at[best]], best) if at[best] < len(run) else (1, None, best)
        node = (k + best) // 2
        while node:
            if beats(loser[node], best):
                best, loser[node] = loser[node], best
            node //= 2
