"""Encoding with the ``tokenizers`` library, by words that are encoded once per worker.

Both vocabularies split a text before they merge, and no token reaches over white space into the next word. A text's
ids are therefore its words' ids in order; at byte level a space belongs to the word after it and a line feed is a
token of its own. A worker keeps the ids of every word of up to ``WIDEST`` bytes that it has met, at most
``MEMO_WORDS``, in arrays (``WordTable``): the words themselves are compared, 8 bytes a number, never hashes alone.
Longer words and those beyond the table's room are encoded anew in each batch. Byte-level texts with other white space
than single spaces and line feeds between words are encoded whole.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from skerry.llm.common import give_back

MEMO_WORDS = 1 << 20
WIDEST = 24
#: New words are encoded as lines of so many, since a call of the library costs more than a word.
LINE_WORDS = 64
#: Bytes of text in a batch.
BATCH_BYTES = 3 << 20
_SPACE, _FEED = 32, 10
_ODD = re.compile(r"[^\S \n]|[\x1c-\x1f]")
#: First bytes of characters beyond ASCII that can be white space.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_OTHER = np.zeros(256, bool)
_OTHER[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordTable:
    """Words of up to ``WIDEST`` bytes and a kind (how a word starts), each with a run of ids in ``pool``.

    Open addressing over three numbers of 8 bytes and one of length and kind; look-ups take all words of a batch at once.
    """

    def __init__(self, room: int = MEMO_WORDS):
        self.room, self.n = room, 0
        size = 1 << (2 * room).bit_length()
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.slot = np.full(size, -1, np.int32)
        self.words = np.zeros((room, 3), np.uint64)
        self.meta = np.zeros(room, np.uint8)
        self.at = np.zeros(room, np.int64)
        self.count = np.zeros(room, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _home(self, k: np.ndarray, meta: np.ndarray) -> np.ndarray:
        h = (k[:, 0] ^ meta.astype(np.uint64)) * _MIX
        h = (h ^ h >> np.uint64(29) ^ k[:, 1]) * _MIX
        h = (h ^ h >> np.uint64(31) ^ k[:, 2]) * _MIX
        return ((h ^ h >> np.uint64(32)) * _MIX >> self.shift).astype(np.int64)

    def find(self, k: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Each word's row, or -1."""
        last = len(self.slot) - 1
        place = self._home(k, meta)
        row = self.slot[place]
        out = np.full(len(row), -1, np.int32)
        left = np.flatnonzero(row >= 0)
        row, place = row[left], place[left]
        while len(left):
            same = (self.words[row, 0] == k[left, 0]) & (self.meta[row] == meta[left])
            same &= (self.words[row, 1] == k[left, 1]) & (self.words[row, 2] == k[left, 2])
            out[left[same]] = row[same]
            left, place = left[~same], place[~same] + 1 & last
            row = self.slot[place]
            live = row >= 0
            left, place, row = left[live], place[live], row[live]
        return out

    def put(self, k: np.ndarray, meta: np.ndarray, ids: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        """Words that the table lacks, each once, as many as there is room for; their runs of ``ids``."""
        n = min(len(at), self.room - self.n)
        if n <= 0:
            return
        k, meta, at, count = k[:n], meta[:n], at[:n], count[:n]
        total = int(count.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = _runs_of(ids, at, count)
        rows = np.arange(self.n, self.n + n, dtype=np.int32)
        self.words[rows], self.meta[rows], self.count[rows] = k, meta, count
        self.at[rows] = self.used + np.cumsum(count) - count
        self.n, self.used = self.n + n, self.used + total
        last = len(self.slot) - 1
        place = self._home(k, meta)
        while len(rows):  # of words that want one place the last stays there, the others move on
            free = self.slot[place] < 0
            self.slot[place[free]] = rows[free]
            lost = self.slot[place] != rows
            rows, place = rows[lost], place[lost] + 1 & last


def _runs_of(ids: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that begin at ``at``, one after the other."""
    ends = np.cumsum(count)
    return ids[np.repeat(at - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the texts' bytes, each with a line feed after it, 24 zeros at the end; n + 1 places where they begin)."""
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    n = len(texts)
    begin = off - off[0] + np.arange(n + 1)
    data = np.zeros(len(raw) + n + WIDEST, np.uint8)
    live = np.ones(len(raw) + n, bool)
    live[begin[1:] - 1] = False
    data[: len(raw) + n][live] = raw
    data[begin[1:] - 1] = _FEED
    return data, begin


class WordEncoder:
    """``encode(texts)`` gives the ids of texts, one after the other, and how many each has; without special tokens."""

    def __init__(self, name: str, path: str | None = None):
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        self.byte_level = self.tokenizer.normalizer is None
        # for lines of words that are letters only: no split but at the mark, no white space to fold
        self.letters = Tokenizer(self.tokenizer.model)
        apart = pre_tokenizers.Split("\n", "isolated") if self.byte_level else pre_tokenizers.Split(" ", "removed")
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([apart, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if not self.byte_level:
            self.letters.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        # what stands between the words of a line
        self.mark = "\n" if self.byte_level else f" {self._long_word()} "
        self.mark_id = self.tokenizer.encode(self.mark, add_special_tokens=False).ids[0]
        self.stops = {c: e.ids[0] for c in ".," if len((e := self.tokenizer.encode(c, add_special_tokens=False)).ids) == 1}
        self.line_feed = self._ids(self.tokenizer.encode("\n", add_special_tokens=False))
        self.table = WordTable(MEMO_WORDS)

    @staticmethod
    def _ids(encoding) -> np.ndarray:
        return np.array(encoding.ids, np.uint32)

    def _long_word(self) -> str:
        """The longest word that is a token: hardly ever in a text, and words that give it are encoded alone."""
        words = (w.removesuffix("</w>") for w in self.tokenizer.get_vocab(with_added_tokens=False) if w.endswith("</w>"))
        return max((w for w in words if w.isascii() and w.isalpha()), key=lambda w: (len(w), w))

    def _encode_words(self, words: list[str], before: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place, count): the run of each word, encoded with ``before`` in front of it."""
        # a full stop or comma after a letter is a token of its own
        last = np.array([self.stops.get(w[-1], 0) if len(w) > 1 and w[-2].isalpha() else 0 for w in words], np.uint32)
        number: dict[str, int] = {}
        nth = np.array([number.setdefault(w[:-1] if e else w, len(number)) for w, e in zip(words, last.tolist(), strict=True)])
        stems = list(number)
        plain = np.array([w.isalpha() and w.lower().isalpha() for w in stems])
        at, count, flat, used = np.zeros(len(stems), np.int64), np.zeros(len(stems), np.int64), [], 0
        for tokenizer, some in ((self.letters, np.flatnonzero(plain)), (self.tokenizer, np.flatnonzero(~plain))):
            for a in range(0, len(some), 256 * LINE_WORDS):
                part = some[a : a + 256 * LINE_WORDS]
                lines = [[stems[i] for i in part[b : b + LINE_WORDS].tolist()] for b in range(0, len(part), LINE_WORDS)]
                coded = [self._ids(e) for e in tokenizer.encode_batch_fast([self.mark.join([before + w for w in x]) for x in lines], add_special_tokens=False)]
                ids = np.concatenate(coded)
                stop = np.cumsum([len(c) for c in coded])
                marks = np.flatnonzero(ids == self.mark_id)
                good = np.bincount(np.searchsorted(stop, marks, side="right"), minlength=len(lines)) == [len(x) - 1 for x in lines]
                ends = np.sort(np.concatenate([marks[good[np.searchsorted(stop, marks, side="right")]], stop[good]]), kind="stable")
                # a line ends where the next begins; a mark lies between two words
                from_ = np.sort(np.concatenate([marks[good[np.searchsorted(stop, marks, side="right")]] + 1, (stop - [len(c) for c in coded])[good]]), kind="stable")
                clear = np.repeat(good, [len(x) for x in lines])
                at[part[clear]], count[part[clear]] = used + from_, ends - from_
                flat.append(ids)
                used += len(ids)
                alone = part[~clear]  # a word in their line gives the mark's id itself
                for i, e in zip(alone.tolist(), self.tokenizer.encode_batch_fast([before + stems[i] for i in alone.tolist()], add_special_tokens=False), strict=True):
                    flat.append(self._ids(e))
                    at[i], count[i] = used, len(flat[-1])
                    used += len(flat[-1])
        at, count = at[nth], count[nth]
        ids = np.concatenate(flat)
        if not last.any():
            return ids, at, count
        stopped = np.flatnonzero(last)
        whole = np.zeros(int(count[stopped].sum()) + len(stopped), np.uint32)
        ends = np.cumsum(count[stopped] + 1) - 1
        body = np.ones(len(whole), bool)
        body[ends] = False
        whole[body], whole[ends] = _runs_of(ids, at[stopped], count[stopped]), last[stopped]
        count[stopped] += 1
        at[stopped] = len(ids) + ends + 1 - count[stopped]
        return np.concatenate([ids, whole]), at, count

    def _whole(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Byte-level texts that are not words with one space or line feed between them."""
        odd = _OTHER[data[: begin[-1]]]
        edge = (data[: begin[-1]] == _SPACE) | (data[: begin[-1]] == _FEED)
        odd[1:] |= edge[1:] & edge[:-1]
        odd[begin[:-1]] |= edge[begin[:-1]]
        ends = begin[1:] - 1
        odd[ends] = (np.diff(begin) > 1) & edge[np.maximum(ends - 1, 0)]
        count = np.add.reduceat(odd, begin[:-1]) if len(begin) > 1 else np.empty(0)
        leads = np.unique(np.searchsorted(begin, np.flatnonzero(_LEADS[data[: begin[-1]]]), side="right") - 1)
        for i in leads.tolist():
            if not count[i] and _ODD.search(data[begin[i] : begin[i + 1] - 1].tobytes().decode()):
                count[i] = 1
        return count > 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids as unsigned 32-bit numbers, how many of them each text has). ``texts``: strings without nulls."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        data, begin = _bytes_of(texts)
        whole = self._whole(data, begin) if self.byte_level else np.zeros(len(texts), bool)
        apart = (data[: begin[-1]] == _SPACE) | (data[: begin[-1]] == _FEED)
        stops = np.flatnonzero(apart)
        starts = np.concatenate([[0], stops[:-1] + 1])
        owner = np.searchsorted(begin, starts, side="right") - 1
        size = stops - starts
        use = (size > 0) & ~whole[owner]
        starts, size, owner = starts[use], size[use], owner[use]
        kind = np.zeros(len(starts), np.uint8)
        feed = np.zeros(len(starts), bool)
        if self.byte_level:
            first = starts == begin[owner]
            feed = ~first & (data[starts - 1] == _FEED)
            kind = (first | feed).astype(np.uint8)  # 1: without a space before it
        ids, at, count = self._look_up(data, starts, size, kind)
        if feed.any():  # a line feed is a token before the word
            ids = np.concatenate([ids, self.line_feed])
            n = np.arange(len(feed)) + np.cumsum(feed)
            wide_at, wide_count = np.full(len(feed) + int(feed.sum()), len(ids) - len(self.line_feed)), np.full(len(feed) + int(feed.sum()), len(self.line_feed))
            wide_at[n], wide_count[n] = at, count
            wide_owner = np.repeat(owner, 1 + feed)
            at, count, owner = wide_at, wide_count, wide_owner
        if whole.any():
            picks = np.flatnonzero(whole)
            coded = [self._ids(e) for e in self.tokenizer.encode_batch_fast([data[begin[i] : begin[i + 1] - 1].tobytes().decode() for i in picks.tolist()], add_special_tokens=False)]
            sizes = np.array([len(c) for c in coded])
            at, count, owner = np.concatenate([at, len(ids) + np.cumsum(sizes) - sizes]), np.concatenate([count, sizes]), np.concatenate([owner, picks])
            ids = np.concatenate([ids, *coded])
            order = np.argsort(owner, kind="stable")
            at, count, owner = at[order], count[order], owner[order]
        count = count.astype(np.int64)
        return _runs_of(ids, at, count), np.bincount(owner, count, len(texts)).astype(np.int64)

    def _look_up(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place, count): where in ``ids`` each word's run lies."""
        table = self.table
        eight = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
        short = size <= WIDEST
        k = np.zeros((len(starts), 3), np.uint64)
        k[:, 0] = eight[starts] & _MASKS[np.minimum(size, 8)]
        for j in (1, 2):
            more = np.flatnonzero(size > 8 * j)
            k[more, j] = eight[starts[more] + 8 * j] & _MASKS[np.minimum(size[more] - 8 * j, 8)]
        meta = (np.minimum(size, WIDEST).astype(np.uint8) << 1) | kind
        row = np.full(len(starts), -1, np.int32)
        if short.all():
            row = table.find(k, meta)
        else:
            row[short] = table.find(k[short], meta[short])
        miss = np.flatnonzero(row < 0)
        at, count = table.at[row], table.count[row]
        if not len(miss):
            return table.pool, at, count
        # the words that the table lacks, each once
        raw = data.tobytes()
        number: dict[tuple[bytes, int], int] = {}
        nth = np.array([number.setdefault((raw[a : a + n], x), len(number)) for a, n, x in zip(starts[miss].tolist(), size[miss].tolist(), kind[miss].tolist(), strict=True)])
        lead = np.empty(len(number), np.int64)
        lead[nth[::-1]] = miss[::-1]
        new_at, new_count, pools, used = np.zeros(len(lead), np.int64), np.zeros(len(lead), np.int64), [table.pool[: table.used]], table.used
        for which, before in ((0, " " if self.byte_level else ""), (1, "")):
            mine = np.flatnonzero(kind[lead] == which)
            if len(mine):
                some = set(mine.tolist()) if len(mine) < len(lead) else None
                ids, a, n = self._encode_words([w.decode() for i, (w, _) in enumerate(number) if some is None or i in some], before)
                new_at[mine], new_count[mine] = used + a, n
                pools.append(ids)
                used += len(ids)
        at[miss], count[miss] = new_at[nth], new_count[nth]
        ids = np.concatenate(pools)
        fits = np.flatnonzero(short[lead])
        table.put(k[lead[fits]], meta[lead[fits]], ids, new_at[fits], new_count[fits])
        return ids, at, count

    def rest(self) -> None:
        """A task has ended: freed memory goes back, the table stays for the worker's next task."""
        give_back()


_ENCODERS: dict[tuple[str, str | None], WordEncoder] = {}


def encoder(name: str, path: str | None = None) -> WordEncoder:
    """One encoder per Python worker."""
    if (name, path) not in _ENCODERS:
        _ENCODERS[name, path] = WordEncoder(name, path)
    return _ENCODERS[name, path]


def with_end(ids: np.ndarray, count: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and counts of ``WordEncoder.encode`` with ``end_id`` after each text."""
    count = count + 1
    ends = np.cumsum(count) - 1
    out = np.full(len(ids) + len(count), end_id, np.uint32)
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body] = ids
    return out, count


def binaries(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The numbers' bytes as binary values that end at ``ends``."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(numbers.tobytes())])


def batches(texts: pa.Array, max_bytes: int = BATCH_BYTES):
    """Index ranges of at most ``max_bytes`` bytes (one text at least)."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + max_bytes, side="right")))
        yield start, stop
        start = stop
