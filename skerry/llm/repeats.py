"""Operator 4: removal of byte strings that an earlier document holds, by suffix arrays.

A string of ``length`` bytes (a window) is repeated if it also starts in a document with a smaller doc_id; every byte that a
repeated window covers goes. Windows stay within a document and are judged on the input.

The corpus is never sorted as one array: windows that can be equal are brought together first. Each window is keyed by
the least hash among its byte grams of ``GRAM`` bytes, so equal windows have equal keys, and neighbouring windows mostly
share one; a run of windows with one key is a segment.

1. Texts are dealt into groups by doc_id and stored once, as a table bucketed by group, which the later steps join
   without shuffling texts again.
2. Each group says which keys it has, once each, and how many segments. Keys that two groups have, or two documents of
   a group, are shared; those of more than ``HOT`` segments in all are hot.
   Whether a key is hot is said once for all groups that have it.
3. Of its segments with shared keys each group says the content (a hash of their text), once each, with the least
   doc_id, to a share by content. Where a smaller doc_id has an equal segment, all its windows are repeated. The others
   give their text, so each different text counts once.
4. Segment texts meet by key. A task joins them, each ended by a 0, sorts the suffixes in two stages, and the adjacent
   common prefixes say which windows are equal; the least doc_id of each class decides. Segments of hot keys are dealt
   by single windows (a hash of each) instead; of equal ones each group gives only those of its least doc_id, so that a
   window has at most a row for each group of about 8 MB, however many documents and surroundings hold it.
5. Repeated windows go back to the groups as byte ranges.

Keys are 64-bit hashes that only bring windows together. Segments count as equal texts by a content hash of 128 bits
over all their bytes (two among 10^11 different segments collide with a probability under 10^-16); all else compares
bytes.

Defined results: a null text counts as empty; rows with a null doc_id are kept whole and make nothing else go; rows
with equal doc_id do not count as earlier to each other; texts shorter than ``length`` are kept whole; an empty table
gives no rows. Input columns keep their names, and all but ``text`` their values; ``text`` is what is left (null stays
null; a character cut in two becomes U+FFFD). Added columns replace any of their names: ``repeat_kept`` (the bytes left),
``repeat_spans`` (ranges of bytes removed) and ``repeat_bytes`` (the text's size).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm.common import forget, give_back, new_path, parts, table, text_or_empty, written
from skerry.llm.suffix_array import big_words, common_prefixes, two_stage

LENGTH, GRAM = 50, 24
LONGEST, HOT = 64, 400
TASK_BYTES, GROUPS = 32 << 20, 4
SORT_BYTES = 1 << 18
_STEP = 1 << 18
_C = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
_SPANS = "array<struct<start:bigint,end:bigint>>"


def _words(data: np.ndarray) -> np.ndarray:
    w = data.astype(np.uint64)
    for step in (1, 2, 4):
        w[:-step] |= w[step:] << np.uint64(8 * step)
    return w


def _mixed(a: np.ndarray, *more: np.ndarray) -> np.ndarray:
    h = a * _C[0]
    for i, x in enumerate(more):
        h ^= h >> np.uint64(31)
        h += x
        h *= _C[(i + 1) % 3]
    h ^= h >> np.uint64(29)
    h *= _C[1]
    h ^= h >> np.uint64(32)
    return h


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, windows, key) of the segments of joined texts that lie at ``starts`` to ``ends``."""
    n = len(data)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(starts, ends - length + 1), 1)
    np.add.at(change, ends, -1)
    usable = np.cumsum(change[:n]) == 0
    span = length - gram + 1  # grams in a window
    at, count, key = [], [], []
    for a in range(0, n - length + 1, _STEP):
        b = min(n - length + 1, a + _STEP)  # windows a to b
        w = _words(data[a : min(n, b + length + 8)])
        grams = b - a + span - 1
        h = _mixed(w[:grams], *(w[o : o + grams] for o in range(8, gram - 8, 8)), w[gram - 8 : gram - 8 + grams])
        least, wide = h, 1
        while 2 * wide <= span:
            least = np.minimum(least[: len(least) - wide], least[wide:])
            wide *= 2
        if wide < span:
            least = np.minimum(least[: b - a], least[span - wide : span - wide + b - a])
        least, ok = least[: b - a], usable[a:b]
        first = ok.copy()
        first[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
        stop = ok.copy()
        stop[:-1] &= (least[1:] != least[:-1]) | ~ok[1:]
        i, j = np.flatnonzero(first), np.flatnonzero(stop) + 1
        if len(i) and (j - i).max() > LONGEST:
            pieces = -(-(j - i) // LONGEST)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            i, j = np.repeat(i, pieces) + LONGEST * nth, np.repeat(j, pieces)
            j = np.minimum(i + LONGEST, j)
        at.append(i + a)
        count.append(j - i)
        key.append(least[i])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(at), np.concatenate(count), np.concatenate(key)


def _joined(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, and the n + 1 places where they begin and the last ends."""
    sizes = np.zeros(len(texts) + 1, np.int64)
    data = []
    at = 1
    for chunk in texts.chunks:
        chunk = chunk.cast(pa.large_binary())
        off = np.frombuffer(chunk.buffers()[1], np.int64, len(chunk) + 1, 8 * chunk.offset)
        sizes[at : at + len(chunk)] = np.diff(off)
        at += len(chunk)
        data.append(np.frombuffer(chunk.buffers()[2], np.uint8, off[-1] - off[0], off[0]) if off[-1] > off[0] else np.empty(0, np.uint8))
    return np.concatenate(data) if data else np.empty(0, np.uint8), np.cumsum(sizes)


def _group(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(bytes, places, doc_id of each text, text of each segment, (place, windows, key))."""
    data, off = _joined(rows.column("_bytes"))
    docs = rows.column("_doc").to_numpy()
    at, count, key = segments(data, off[:-1], off[1:])
    return data, off, docs, np.searchsorted(off, at, side="right") - 1, (at, count, key)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers begin, and each number's run."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _blobs(x: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in np.split(x, at[1:])] if len(x) else [], pa.binary())


def _say_keys(shares: int):
    """Keys and how many segments have them, to each key's share."""

    def run(rows: pa.Table) -> pa.Table:
        keys, count = np.unique(_group(rows)[4][2], return_counts=True)
        share = (keys % np.uint64(shares)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        keys, share, count = keys[order], share[order], count[order].astype(np.uint32)
        at, _ = _runs(share)
        group = rows.column("_group")[0].as_py()
        return pa.table({"share": pa.array(share[at], pa.int32()), "_group": pa.array([group] * len(at), pa.int32()), "keys": _blobs(keys, at), "counts": _blobs(count, at)})

    return run


def _find_shared(hot: int):
    """Keys that two groups have, and whether they are hot, back to their groups."""

    def run(rows: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b, np.uint64) for b in rows.column("keys").to_pylist()]
        groups = np.repeat(rows.column("_group").to_numpy(), [len(b) for b in blobs])
        keys, count = np.concatenate(blobs), np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint32)
        order = np.argsort(keys)
        keys, groups, count = keys[order], groups[order], count[order]
        _, run = _runs(keys)
        again = np.bincount(run)[run] > 1
        wide = (np.bincount(run, count) > hot)[run]
        keys, groups, wide = keys[again], groups[again], wide[again]
        order = np.argsort(groups, kind="stable")
        keys, groups, wide = keys[order], groups[order], wide[order]
        at, _ = _runs(groups)
        return pa.table({"_group": pa.array(groups[at], pa.int32()), "keys": _blobs(keys, at), "hot": _blobs(wide, at)})

    return run


_SEGMENTS = "_group int, row long, doc long, at long, windows int, key long, text binary, hot boolean"
_NAMES = ["_group", "row", "doc", "at", "windows", "key", "text", "hot"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
_SAID = "share int, _group int, contents binary, more binary, docs binary, at binary"
_IS_HOT = np.uint32(1 << 31)


def _say_contents(length: int, shares: int, hot: int):
    """Shared segments by content: (content of two numbers, doc_id, index in the group and whether the key is hot) to the content's share; those that an equal one in the group makes repeated to a share of the group's own."""

    def run(rows: pa.Table, shared: pa.Table) -> pa.Table:
        give_back()
        data, _, docs, row, (at, count, key) = _group(rows)
        known, wide = np.frombuffer(b"".join(shared.column("keys").to_pylist()), np.uint64), np.frombuffer(b"".join(shared.column("hot").to_pylist()), bool)
        order = np.argsort(known)
        known, wide = known[order], wide[order]
        doc = docs[row]
        order = np.argsort(key)
        begin, nth = _runs(key[order])
        many, is_hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
        if len(key):
            d = doc[order]
            many[order] = (np.minimum.reduceat(d, begin) < np.maximum.reduceat(d, begin))[nth]
            is_hot[order] = (np.bincount(nth) > hot)[nth]
            if len(known):
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                there = known[place] == key
                many |= there
                is_hot = np.where(there, wide[place], is_hot)  # of keys that other groups have too, all groups say the same
        pick = np.flatnonzero(many)
        doc, index = doc[pick], pick.astype(np.uint32) | is_hot[pick] * _IS_HOT
        own, more = _content(data, at[pick], count[pick] + length - 1)
        order = np.lexsort((doc, more, own))
        new = np.ones(len(order), bool)
        new[1:] = (more[order[1:]] != more[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        later = doc[order] > doc[order[lead]]
        say = order[~later]  # equal segments of one document speak each for itself
        share = (own[say] % np.uint64(shares)).astype(np.int64)
        say, share = say[by := np.argsort(share, kind="stable")], share[by]
        cuts, _ = _runs(share)
        split = lambda x: [v.tobytes() for v in np.split(x, cuts[1:])] if len(x) else []
        group = (rows if rows.num_rows else shared).column("_group")[0].as_py()
        cols = [share[cuts].tolist() + [shares + group], [group] * (len(cuts) + 1), split(own[say]) + [b""], split(more[say]) + [b""], split(doc[say]) + [b""], split(index[say]) + [index[order[later]].tobytes()]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 2 + [pa.binary()] * 4, strict=True)], names=["share", "_group", "contents", "more", "docs", "at"])

    return run


def _choose(shares: int):
    """Back to the groups, by index: segments that speak for their text (kind 1) and those that are repeated (0)."""

    def run(rows: pa.Table) -> pa.Table:
        names = ["_group", "kind", "at"]
        if rows.column("share")[0].as_py() >= shares:
            return pa.table([rows.column("_group"), pa.array([bytes(len(b) // 4) for b in rows.column("at").to_pylist()], pa.binary()), rows.column("at")], names=names)
        joined = lambda c, t: np.concatenate([np.frombuffer(b, t) for b in rows.column(c).to_pylist()])
        own, more, doc, at = (joined(c, t) for c, t in (("contents", np.uint64), ("more", np.uint64), ("docs", np.int64), ("at", np.uint32)))
        group = np.repeat(rows.column("_group").to_numpy(), [len(b) // 8 for b in rows.column("docs").to_pylist()])
        order = np.lexsort((doc, more, own))
        own, more, at, group, doc = own[order], more[order], at[order], group[order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (own[1:] != own[:-1]) | (more[1:] != more[:-1])
        kind = doc == doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        order = np.argsort(group, kind="stable")
        group, kind, at = group[order], kind[order].astype(np.uint8), at[order]
        cuts, _ = _runs(group)
        return pa.table([pa.array(group[cuts], pa.int32()), _blobs(kind, cuts), _blobs(at, cuts)], names=names)

    return run


def _give_segments(length: int):
    """The texts of the segments that speak, and byte ranges (null text; ``windows`` of them) of repeated ones."""

    def run(rows: pa.Table, chosen: pa.Table) -> pa.Table:
        give_back()
        data, off, docs, row, (at, count, key) = _group(rows)
        kinds = np.frombuffer(b"".join(chosen.column("kind").to_pylist()), np.uint8)
        picks = np.frombuffer(b"".join(chosen.column("at").to_pylist()), np.uint32)
        of = lambda use: np.sort((picks[use] & ~_IS_HOT).astype(np.int64))
        gone, plain, hot = of(kinds == 0), of((kinds == 1) & (picks < _IS_HOT)), of((kinds == 1) & (picks >= _IS_HOT))
        # neighbours become one range
        new = np.ones(len(gone), bool)
        new[1:] = (at[gone[1:]] > at[gone[:-1]] + count[gone[:-1]]) | (row[gone[1:]] != row[gone[:-1]])
        first = gone[new]
        last = gone[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(gone) - 1]])] if len(gone) else gone
        place, of_place, own, later, of_later = _single(data, hot, at, count, key, docs[row], length)
        use = np.concatenate([plain, of_place])
        start = np.concatenate([at[plain], place, at[first], later])
        windows = np.concatenate([count[plain], np.ones(len(place), np.int64), at[last] + count[last] - at[first], np.ones(len(later), np.int64)])
        texts = [data[a : a + c + length - 1].tobytes() for a, c in zip(start[: len(use)].tolist(), windows[: len(use)].tolist(), strict=True)]
        ids = np.concatenate([use, first, of_later])
        group = (rows if rows.num_rows else chosen).column("_group")[0].as_py()
        settled = start[len(use) :].astype(np.uint64)
        keys = np.concatenate([key[plain], own, _mixed(settled + np.uint64(group))]).view(np.int64)  # ranges meet nobody: dealt evenly
        is_hot = np.zeros(len(ids), bool)
        is_hot[len(plain) : len(use)] = True
        cols = [np.full(len(ids), group), rows.column("_row").to_numpy()[row[ids]], docs[row[ids]], start - off[row[ids]], windows, keys, texts + [None] * (len(ids) - len(use)), is_hot]
        return pa.table([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)

    return run


def _eight(data: np.ndarray) -> np.ndarray:
    """The number of 8 bytes that begins at each place."""
    return np.ndarray(max(0, len(data) - 7), "<u8", np.ascontiguousarray(data), 0, (1,))


def _content(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text of ``size`` bytes (8 or more) at ``at``."""
    out, more = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    eight = _eight(data)
    for a in range(0, len(at), 1 << 15):
        p, n = at[a : a + (1 << 15)], size[a : a + (1 << 15)]
        w, v = out[a : a + (1 << 15)], more[a : a + (1 << 15)]
        w += n.astype(np.uint64)
        for o in range(0, int(n.max(initial=0)), 8):
            live = np.flatnonzero(n > o)
            bytes8 = eight[p[live] + np.minimum(o, n[live] - 8)]  # the last word ends with the text
            h = (w[live] ^ bytes8) * _C[0]
            w[live] = (h ^ h >> np.uint64(32)) * _C[1] + np.uint64(o)
            h = (v[live] + bytes8) * _C[2]
            v[live] = (h ^ h >> np.uint64(29)) * _C[0] ^ np.uint64(o)
    return out, more


def _single(data: np.ndarray, hot: np.ndarray, at: np.ndarray, count: np.ndarray, key: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, segment, hash) of the windows of hot segments that speak, those of the least doc_id in the group, and (place, segment) of the others."""
    n = count[hot]
    of = np.repeat(hot, n)
    place = at[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    own, _ = _content(data, place, np.full(len(place), length))
    order = np.lexsort((doc[of], own))
    of, place, own = of[order], place[order], own[order]
    new = np.ones(len(of), bool)
    new[1:] = own[1:] != own[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))
    later = doc[of] > doc[of[lead]]
    eight = _eight(data)
    for o in (*range(0, length - 8, 8), length - 8):  # windows of one hash whose bytes differ speak for themselves
        later &= eight[place + o] == eight[place[lead] + o]
    return place[~later], of[~later], own[~later], place[later], of[later]


def repeated_windows(texts: list[bytes], windows: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, end) of the runs of repeated windows among segment texts that hold all equals of each other."""
    joined = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8) + np.uint8(1)  # UTF-8 has no 255: it becomes the end, 0
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(sizes) - sizes
    words = big_words(joined, length)
    order = two_stage(joined, length, words)
    shared = common_prefixes(order, words, length)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(joined)) - begin[owner]
    is_window = at < windows[owner]
    kind = np.cumsum(shared < length)  # suffixes equal in ``length`` symbols
    use = is_window[order]
    place, kind = order[use], kind[use]
    gone = np.zeros(len(joined), bool)
    if len(place):
        start, nth = _runs(kind)
        doc = docs[owner[place]]
        gone[place] = doc > np.minimum.reduceat(doc, start)[nth]
    first = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]))
    last = np.flatnonzero(gone & ~np.concatenate([gone[1:], [False]]))
    return owner[first], at[first], at[last] + length


def _decide(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bytes_held = 0

        def ranges(group, row, a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(row, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["_group", "row", "start", "end"])

        def settle(rows: pa.Table) -> pa.RecordBatch:
            texts = rows.column("text").to_pylist()
            text, a, b = repeated_windows(texts, rows.column("windows").to_numpy(), rows.column("doc").to_numpy(), length)
            at = rows.column("at").to_numpy()[text]
            return ranges(rows.column("_group").to_numpy()[text], rows.column("row").to_numpy()[text], at + a, at + b)

        last = None
        for batch in batches:
            settled = batch.filter(pc.is_null(batch.column("text")))
            if settled.num_rows:
                a = settled.column("at").to_numpy()
                yield ranges(settled.column("_group"), settled.column("row"), a, a + settled.column("windows").to_numpy() + length - 1)
            batch = batch.filter(pc.is_valid(batch.column("text")))
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            at, _ = _runs(key)
            size = np.cumsum([len(t) for t in batch.column("text").to_pylist()])
            cut, done = 0, 0
            for a in at.tolist():
                now = bytes_held + int(size[a - 1] if a else 0) - done
                if now >= SORT_BYTES and not (a == 0 and last == key[0]):
                    if a > cut:
                        held.append(batch.slice(cut, a - cut))
                    yield settle(pa.Table.from_batches(held))
                    held, bytes_held, cut, done = [], 0, a, int(size[a - 1] if a else 0)
            held.append(batch.slice(cut))
            bytes_held += int(size[-1]) - done
            last = key[-1]
        if held:
            yield settle(pa.Table.from_batches(held))
        held.clear()
        give_back()

    return run


def _cut_out(rows: pa.Table, ranges: pa.Table) -> pa.Table:
    give_back()
    data, off = _joined(rows.column("_bytes"))
    row_at = {r: i for i, r in enumerate(rows.column("_row").to_pylist())}
    begin = off[[row_at[r] for r in ranges.column("row").to_pylist()]] if ranges.num_rows else np.empty(0, np.int64)
    change = np.zeros(len(data) + 1, np.int64)
    if ranges.num_rows:
        np.add.at(change, begin + ranges.column("start").to_numpy(), 1)
        np.add.at(change, begin + ranges.column("end").to_numpy(), -1)
    gone = np.cumsum(change[:-1]) > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    beside = np.concatenate([[False], gone, [False]])
    first = np.flatnonzero(gone & (edge[:-1] | ~beside[:-2]))
    last = np.flatnonzero(gone & (edge[1:] | ~beside[2:])) + 1
    owner = np.searchsorted(off, first, side="right") - 1
    upto = np.concatenate([[0], np.cumsum(~gone)])[off]
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows.num_rows, [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data[~gone])]).cast(pa.binary())
    pairs = pa.StructArray.from_arrays([pa.array(first - off[owner], pa.int64()), pa.array(last - off[owner], pa.int64())], ["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows.num_rows + 1)), pa.int32()), pairs)
    return pa.table({"rest": rows.column("rest"), "_null": rows.column("_null"), "repeat_kept": kept, "repeat_spans": spans, "repeat_bytes": pa.array(np.diff(off), pa.int64())})


def _removed(slim: DataFrame, dealt: DataFrame, name: str, tasks: int, length: int) -> DataFrame:
    """The steps above over ``dealt``, whose texts become the table ``name``: rest, _null, repeat_kept, repeat_spans, repeat_bytes."""
    spark = slim.sparkSession
    dealt.repartition(tasks, "_group").write.option("compression", "zstd").option("path", new_path(spark, "texts")).bucketBy(tasks, "_group").saveAsTable(name)
    texts = spark.table(name)
    bare = texts.select("_group", "_row", "_doc", "_bytes")
    said = bare.groupBy("_group").applyInArrow(_say_keys(tasks), "share int, _group int, keys binary, counts binary")
    shared = written(said.groupBy("share").applyInArrow(_find_shared(HOT), "_group int, keys binary, hot binary"), "shared")
    said = bare.groupBy("_group").cogroup(shared.groupBy("_group")).applyInArrow(_say_contents(length, tasks, HOT), _SAID)
    chosen = written(said.groupBy("share").applyInArrow(_choose(tasks), "_group int, kind binary, at binary"), "chosen")
    forget(shared, shuffles=True)
    given = bare.groupBy("_group").cogroup(chosen.groupBy("_group")).applyInArrow(_give_segments(length), _SEGMENTS)
    met = given.repartition(tasks, "key").sortWithinPartitions("key")
    ranges = written(met.mapInArrow(_decide(length), "_group int, row long, start long, end long"), "ranges")
    forget(chosen, shuffles=True)
    shape = T.StructType([texts.schema["rest"], texts.schema["_null"], T.StructField("repeat_kept", T.BinaryType()), *spark.createDataFrame([], f"repeat_spans {_SPANS}, repeat_bytes long").schema.fields])
    cut = texts.select("_group", "_row", "_bytes", "_null", "rest").groupBy("_group").cogroup(ranges.groupBy("_group")).applyInArrow(_cut_out, shape)
    alone = slim.where(F.col("_doc").isNull()).select("rest", "_null", F.col("_bytes").alias("repeat_kept"), F.expr(f"CAST(array() AS {_SPANS})").alias("repeat_spans"), F.octet_length("_bytes").cast("long").alias("repeat_bytes"))
    out = written(cut.unionByName(alone), "kept")
    forget(ranges, texts, shuffles=True)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (doc_id, text, any others) without repeats, and ``repeat_kept``, ``repeat_spans``, ``repeat_bytes``; a stored table."""
    spark = docs.sparkSession
    docs = docs.drop("repeat_kept", "repeat_spans", "repeat_bytes")
    rest = [c for c in docs.columns if c != "text"]
    size = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    tasks = max(parts(spark), -(-size // TASK_BYTES))
    groups = GROUPS * tasks
    whole = F.col("doc_id").cast("long")
    slim = docs.select(F.struct(*rest).alias("rest"), whole.alias("_doc"), F.encode(text_or_empty(), "UTF-8").alias("_bytes"), F.col("text").isNull().alias("_null"))
    dealt = slim.where(F.col("_doc").isNotNull()).select("*", F.pmod(F.xxhash64("_doc"), F.lit(groups)).cast("int").alias("_group"), F.monotonically_increasing_id().alias("_row"))
    name = f"repeats_{uuid.uuid4().hex}"
    try:
        out = _removed(slim, dealt, name, tasks, length)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    text = F.when(~F.col("_null"), F.expr("make_valid_utf8(CAST(repeat_kept AS STRING))"))
    return out.select(*[text.alias("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns], "repeat_kept", "repeat_spans", "repeat_bytes")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` as they are without repeated strings, with the same columns, whatever their names; n_chars follows the text."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    out = remove_repeats(rows, length)
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.col("repeat_bytes") - F.length("repeat_kept")
    return out.select("doc_id", F.col("repeat_bytes").alias("n_bytes"), removed.cast("long").alias("n_removed"), F.size("repeat_spans").cast("long").alias("n_spans"), F.sha2("repeat_kept", 256).alias("kept_sha256"))
