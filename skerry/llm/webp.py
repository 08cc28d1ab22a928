"""Lossless WebP: a decoder for the whole format and an encoder for grey payloads.

The decoder reads prefix codes (simple and coded lengths, one group or a group a block), literals, back-references and
the colour cache, and inverts predictor, cross-colour, subtract-green and palette transforms. Pixels are ARGB in one
unsigned 32-bit number each. In an image of one group of codes, what a symbol is and where the next begins is looked up
for all bit places of a piece at once; then the places are followed. Images of several groups go pixel by pixel.

The encoder writes code lengths from the histogram and back-references of ``SHORTEST`` pixels and more. Up to 16 shades
become a palette of packed indices; others are literals under subtract-green, after the left or top predictor where the
histogram of its residuals is cheaper.
"""

from __future__ import annotations

import functools
import heapq
from array import array

import numpy as np

#: Fixed values of the format: the order of code length codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Nearby pixels by distance code: by distance, then higher rows, then columns from the right.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))
MAX_SIDE = 1 << 14
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD
LONGEST_CODE, LONGEST_MATCH, SHORTEST = 15, 4096, 6
#: Bytes of a piece whose bit places are looked up at once.
PIECE = 1 << 14
#: Samples by which a predictor is chosen.
_TRIED = 4096


class Bits:
    """Reads bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        a = self.at
        self.at = a + n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends too early")
        return int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)



_REVERSED: dict[int, np.ndarray] = {}


def _reversed(width: int) -> np.ndarray:
    """Each number of ``width`` bits with its bits in the other order."""
    if width not in _REVERSED:
        out = np.zeros(1 << width, np.int64)
        for i in range(width):
            out |= (np.arange(1 << width) >> i & 1) << (width - 1 - i)
        _REVERSED[width] = out
    return _REVERSED[width]


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols by code, their lengths): shorter codes first, then smaller symbols."""
    used = np.flatnonzero(lengths)
    symbols = used[np.argsort(lengths[used], kind="stable")]
    return symbols, lengths[symbols]


class Code:
    """A canonical prefix code as tables of the next ``longest`` bits: the symbol, and how many bits it takes."""

    def __init__(self, lengths: np.ndarray):
        symbols, sizes = canonical(lengths)
        if not len(symbols):
            raise ValueError("a prefix code without symbols")
        if len(symbols) == 1:  # one symbol takes no bits
            self.longest, self.symbol, self.size = 0, symbols, np.zeros(1, np.int64)
            return
        self.longest = int(sizes[-1])
        spans = 1 << (self.longest - sizes)
        if spans.sum() != 1 << self.longest:
            raise ValueError("an incomplete or overfull prefix code")
        order = _reversed(self.longest)
        self.symbol, self.size = np.repeat(symbols, spans)[order], np.repeat(sizes, spans)[order]

    def read(self, bits: Bits) -> int:
        ahead = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 4], "little") >> (bits.at & 7) & ((1 << self.longest) - 1)
        bits.read(int(self.size[ahead]))
        return int(self.symbol[ahead])


_ALONE: dict[int, Code] = {}


def _alone(symbol: int) -> Code:
    """The code of one symbol, which takes no bits."""
    if symbol not in _ALONE:
        lengths = np.zeros(symbol + 1, np.int64)
        lengths[symbol] = 1
        _ALONE[symbol] = Code(lengths)
    return _ALONE[symbol]


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        second = bits.read(8) if two else first
        if max(first, second) >= alphabet:
            raise ValueError("a symbol beyond the alphabet")
        if first == second:
            return _alone(first)
        lengths = np.zeros(256, np.int64)
        lengths[[first, second]] = 1
        return Code(lengths)
    return Code(_read_lengths(bits, alphabet))


@functools.lru_cache(64)
def _code_of_lengths(n: int, sent: int) -> Code:
    """The code of code lengths whose first ``n`` lengths, of 3 bits each, are ``sent``."""
    own = np.zeros(19, np.int64)
    for i in range(n):
        own[LENGTH_ORDER[i]] = sent >> 3 * i & 7
    return Code(own)


def _read_lengths(bits: Bits, alphabet: int) -> np.ndarray:
    lengths = np.zeros(alphabet, np.int64)
    n = 4 + bits.read(4)
    code = _code_of_lengths(n, bits.read(3 * n))
    left = alphabet
    if bits.read(1):
        n = 2 + 2 * bits.read(3)
        left = 2 + bits.read(n)
        if left > alphabet:
            raise ValueError("more code lengths than symbols")
    # all that can follow as one number, from which bits are taken at the low end
    symbols, sizes, mask = code.symbol.tolist(), code.size.tolist(), (1 << code.longest) - 1
    most = 14 * min(left, alphabet)
    ahead = int.from_bytes(bits.data[bits.at >> 3 : (bits.at + most + 7 >> 3) + 1], "little") >> (bits.at & 7)
    out: list[int] = []
    used, last = 0, 8
    while len(out) < alphabet and left:
        left -= 1
        k = ahead & mask
        s, n = symbols[k], sizes[k]
        ahead >>= n
        used += n
        if s < 16:
            out.append(s)
            last = s or last
            continue
        value, base, n = (last, 3, 2) if s == 16 else (0, 3, 3) if s == 17 else (0, 11, 7)
        out += [value] * (base + (ahead & ((1 << n) - 1)))
        ahead >>= n
        used += n
    bits.read(used)
    if len(out) > alphabet:
        raise ValueError("a run beyond the alphabet")
    lengths[: len(out)] = out
    return lengths


def _number(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB pixels in rows, as uint32."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache that is too large")
    block, groups, owner = 0, 1, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        wide = -(-width >> block)
        owner = _read_image(bits, wide, -(-height >> block), False) >> 8 & 0xFFFF
        groups = int(owner.max()) + 1
    codes = [[_read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    count = width * height
    first = codes[0]
    if owner is None:
        return _read_pieces(bits, first, cache_bits, count, width)
    out: list[int] = []
    cache = [0] * (1 << cache_bits)
    fresh = 0  # pixels that the cache has not seen yet begin here
    while len(out) < count:
        at = len(out)
        g = codes[int(owner[(at // width >> block) * wide + (at % width >> block)])]
        s = g[0].read(bits)
        if s < 256:
            red, blue, alpha = g[1].read(bits), g[2].read(bits), g[3].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length = _number(bits, s - 256)
            far = int(_distance(np.array([_number(bits, g[4].read(bits))]), width)[0])
            if far > at or at + length > count:
                raise ValueError("a back-reference beyond the image")
            for _ in range(length):
                out.append(out[-far])
        else:
            out.append(cache[s - 280])
        if cache_bits:
            for p in out[fresh:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            fresh = len(out)
    return np.array(out, np.uint32)


_NEAR_GAPS: dict[int, np.ndarray] = {}


def _near_gaps(width: int) -> np.ndarray:
    """Pixels back of the distance codes 1 to 120."""
    if width not in _NEAR_GAPS:
        _NEAR_GAPS[width] = np.array([max(1, x + y * width) for x, y in NEAR])
    return _NEAR_GAPS[width]


def _distance(code: np.ndarray, width: int) -> np.ndarray:
    """Pixels back, by distance code."""
    return np.where(code > 120, code - 120, _near_gaps(width)[np.minimum(code, 120) - 1])


#: How many more bits a length or distance has, by prefix.
_EXTRA = np.array([max(0, (p - 2) >> 1) for p in range(40)])


def _value(prefix: np.ndarray, more: np.ndarray) -> np.ndarray:
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << _EXTRA[prefix]) + more + 1)


_SHIFTS = np.arange(8, dtype=np.uint32)


def _read_pieces(bits: Bits, codes: list[Code], cache_bits: int, count: int, width: int) -> np.ndarray:
    """The pixels of an image of one group of codes."""
    green, red, blue, alpha, far = codes
    data = np.frombuffer(bits.data + bytes(32), np.uint8)
    four, eight = np.ndarray(len(data) - 3, "<u4", data, 0, (1,)), np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    ahead = lambda at, n: (eight[at >> 3] >> (at & 7).astype(np.uint64)).astype(np.int64) & ((1 << n) - 1)
    others = [(c, shift) for c, shift in ((red, 16), (blue, 0), (alpha, 24)) if c.longest]
    plain = sum(int(c.symbol[0]) << shift for c, shift in ((red, 16), (blue, 0), (alpha, 24)) if not c.longest)
    backs = (green.symbol >= 256) & (green.symbol < 280)
    any_back, mask = bool(backs.any()), np.uint32((1 << green.longest) - 1)
    symbols, pixels, lengths, distances, have = [], [], [], [], 0
    if green.longest == 0 and not others and green.symbol[0] < 256:  # one colour, no bits
        return np.full(count, plain | int(green.symbol[0]) << 8, np.uint32)
    while have < count:
        if bits.at >= 8 * len(bits.data):
            raise ValueError("the image ends too early")
        first = bits.at >> 3  # places are counted from this byte
        stop = min(len(bits.data), first + PIECE)
        limit = 8 * (stop - first)
        low = ((four[first:stop, None] >> _SHIFTS) & mask).ravel().astype(np.intp)
        then = green.size[low]
        then += np.arange(limit)
        if others:
            literal = np.flatnonzero(green.symbol[low] < 256)
            place = then[literal] + 8 * first
            for c, _ in others:
                place = place + c.size[ahead(place, c.longest)]
            then[literal] = place - 8 * first
        back = np.flatnonzero(backs[low]) if any_back else ()
        if len(back):
            more = then[back] + _EXTRA[green.symbol[low[back]] - 256] + 8 * first
            at_far = ahead(more, far.longest)
            then[back] = more + far.size[at_far] + _EXTRA[far.symbol[at_far]] - 8 * first
        # followed four symbols at a time; places beyond the piece lead to themselves
        then = np.concatenate([then, np.arange(limit, limit + 64)])
        two = then[then]
        follow, walk, p = memoryview(two[two]), array("q"), bits.at & 7
        push = walk.append
        while p < limit:
            push(p)
            p = follow[p]
        walk = np.frombuffer(walk, np.int64)
        seen = np.stack([walk, then[walk], two[walk], then[two[walk]]], axis=1).ravel()
        seen = seen[seen < limit]
        low = low[seen]
        symbol, here = green.symbol[low], seen + 8 * first
        length, gap = np.ones(len(seen), np.int64), np.zeros(len(seen), np.int64)
        pixel = (symbol << 8) | plain
        if others:
            lit = np.flatnonzero(symbol < 256)
            place = here[lit] + green.size[low[lit]]
            for c, shift in others:
                at_c = ahead(place, c.longest)
                pixel[lit] |= c.symbol[at_c] << shift
                place = place + c.size[at_c]
        back = np.flatnonzero((symbol >= 256) & (symbol < 280)) if any_back else ()
        if len(back):
            place = here[back] + green.size[low[back]]
            prefix = symbol[back] - 256
            n = _EXTRA[prefix]
            length[back] = _value(prefix, ahead(place, 32) & ((1 << n) - 1))
            place = place + n
            at_far = ahead(place, far.longest)
            prefix, place = far.symbol[at_far], place + far.size[at_far]
            gap[back] = _distance(_value(prefix, ahead(place, 32) & ((1 << _EXTRA[prefix]) - 1)), width)
        ends = np.cumsum(length) + have
        use = min(int(np.searchsorted(ends, count)) + 1, len(ends))  # symbols until the image is full
        symbols.append(symbol[:use])
        pixels.append(pixel[:use])
        lengths.append(length[:use])
        distances.append(gap[:use])
        if ends[use - 1] > count:
            raise ValueError("a back-reference beyond the image")
        have = int(ends[use - 1])
        bits.at = int(then[seen[use - 1]]) + 8 * first
    if bits.at > 8 * len(bits.data):
        raise ValueError("the image ends too early")
    symbol, pixel, length, gap = (np.concatenate(x) for x in (symbols, pixels, lengths, distances))
    at = np.cumsum(length) - length
    if cache_bits and (symbol >= 280).any():
        return _with_cache(symbol, pixel, length, gap, cache_bits)
    out = np.zeros(count, np.uint32)
    lit = symbol < 256
    out[at[lit]] = pixel[lit]
    back = np.flatnonzero(~lit)
    if (gap[back] > at[back]).any():
        raise ValueError("a back-reference beyond the image")
    raw = bytearray(out.tobytes())
    for a, n, d in zip((4 * at[back]).tolist(), (4 * length[back]).tolist(), (4 * gap[back]).tolist(), strict=True):
        if d >= n:
            raw[a : a + n] = raw[a - d : a - d + n]
        else:
            raw[a : a + n] = (raw[a - d : a] * (n // d + 1))[:n]
    return np.frombuffer(raw, np.uint32)


def _with_cache(symbol: np.ndarray, pixel: np.ndarray, length: np.ndarray, gap: np.ndarray, cache_bits: int) -> np.ndarray:
    out: list[int] = []
    cache = [0] * (1 << cache_bits)
    fresh = 0
    for s, p, n, d in zip(symbol.tolist(), pixel.tolist(), length.tolist(), gap.tolist(), strict=True):
        if s >= 280:
            for q in out[fresh:]:  # the cache has every pixel before
                cache[(CACHE_FACTOR * q & 0xFFFFFFFF) >> (32 - cache_bits)] = q
            fresh = len(out)
            out.append(cache[s - 280])
        elif s < 256:
            out.append(p)
        else:
            if d > len(out):
                raise ValueError("a back-reference beyond the image")
            for _ in range(n):
                out.append(out[-d])
    return np.array(out, np.uint32)


def _channels(p: np.ndarray) -> np.ndarray:
    """Alpha, red, green, blue as int64, along a last axis."""
    return p[..., None].astype(np.int64) >> np.array([24, 16, 8, 0]) & 255


def _joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predicted(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    half = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0])
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode in (6, 7):
        return half(left, corner if mode == 6 else top)
    if mode in (8, 9):
        return half(corner, top) if mode == 8 else half(top, right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        return left if abs(top - corner).sum() < abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = half(left, top)
    return np.clip(mean + np.trunc((mean - corner) / 2).astype(np.int64), 0, 255)


def _undo_predictor(p: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width = p.shape
    c = _channels(p)
    only = int(modes.flat[0]) if (modes == modes.flat[0]).all() else -1
    if only in (1, 2):  # sums along rows, or down columns
        c[0, 0] += [255, 0, 0, 0]
        c[0] = np.cumsum(c[0], axis=0)
        if only == 2:
            return _joined(np.cumsum(c, axis=0))
        c[:, 0] = np.cumsum(c[:, 0], axis=0)
        c[1:] = np.cumsum(c[1:], axis=1)
        return _joined(c)
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = c[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                guess = c[y - 1, 0]
            else:
                right = c[y - 1, x + 1] if x + 1 < width else c[y, 0]
                guess = _predicted(int(modes[y >> block, x >> block]), c[y, x - 1], c[y - 1, x], right, c[y - 1, x - 1])
            c[y, x] = c[y, x] + guess & 255
    return _joined(c)


def _signed(v: np.ndarray) -> np.ndarray:
    v = v & 255
    return v - 256 * (v > 127)


def _undo_cross_colour(p: np.ndarray, elements: np.ndarray, block: int) -> np.ndarray:
    c = _channels(p)
    e = _channels(elements)[np.arange(p.shape[0])[:, None] >> block, np.arange(p.shape[1])[None] >> block]
    move = lambda t, v: _signed(t) * _signed(v) >> 5
    red = c[..., 1] + move(e[..., 3], c[..., 2]) & 255
    blue = c[..., 3] + move(e[..., 2], c[..., 2]) + move(e[..., 1], red) & 255
    return _joined(np.stack([c[..., 0], red, c[..., 2], blue], axis=-1))


def _undo_palette(p: np.ndarray, palette: np.ndarray, pack: int, width: int) -> np.ndarray:
    index = (p >> 8 & 255).astype(np.int64)
    if pack:
        per, size = 1 << pack, 8 >> pack
        index = (index[:, :, None] >> size * np.arange(per) & ((1 << size) - 1)).reshape(p.shape[0], -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width) of a lossless WebP file, ARGB as uint32."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("no lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless WebP image")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("unknown version")
    undo, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            shape = (-(-height >> block), -(-wide >> block))
            undo.append((kind, _read_image(bits, shape[1], shape[0], False).reshape(shape), block, wide))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            palette = _joined(np.cumsum(_channels(_read_image(bits, n, 1, False)), axis=0))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, palette, pack, wide))
            wide = -(-wide >> pack)
        else:
            undo.append((kind, None, 0, wide))
    p = _read_image(bits, wide, height, True).reshape(height, wide)
    for kind, what, n, wide in reversed(undo):
        if kind == PREDICTOR:
            p = _undo_predictor(p, what >> 8 & 15, n)
        elif kind == CROSS_COLOUR:
            p = _undo_cross_colour(p, what, n)
        elif kind == PALETTE:
            p = _undo_palette(p, what, n, wide)
        else:
            green = p >> 8 & 255
            p = p & 0xFF00FF00 | (p >> 16) + green << 16 & 0xFF0000 | (p + green) & 255
    return p


class Writer:
    """Collects (value, bits) pairs, lowest bit first: few at a time in ``put``, then arrays of at most 64 bits a value."""

    def __init__(self):
        self.head, self.n = 0, 0
        self.arrays: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, *pairs: tuple[int, int]) -> None:
        for v, n in pairs:
            self.head |= v << self.n
            self.n += n

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """After all that ``put`` writes."""
        self.arrays.append((values, sizes))

    def bytes(self) -> bytes:
        bits = [np.unpackbits(np.frombuffer(self.head.to_bytes(self.n + 7 >> 3, "little"), np.uint8), count=self.n, bitorder="little")]
        for values, sizes in self.arrays:
            begin = np.cumsum(sizes) - sizes
            each = (np.arange(int(sizes.sum())) - np.repeat(begin, sizes)).astype(np.uint64)
            bits.append((np.repeat(values, sizes) >> each & np.uint64(1)).astype(np.uint8))
        return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of a prefix code for the counts, none over ``longest``; 1 for a symbol that is alone."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    weight = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        above = [0] * (2 * len(used) - 1)
        node = len(used)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            above[a[1]] = above[b[1]] = node
            heapq.heapreplace(heap, (a[0] + b[0], node))
            node += 1
        depth = [0] * node
        for i in range(node - 2, -1, -1):
            depth[i] = depth[above[i]] + 1
        if max(depth[: len(used)]) <= longest:
            lengths[used] = depth[: len(used)]
            return lengths
        weight = [w // 2 + 1 for w in weight]  # flatter until it fits


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's code, in the order in which its bits are written."""
    symbols, sizes = canonical(lengths)
    out = np.zeros(len(lengths), np.uint64)
    if len(symbols) > 1:
        top = int(sizes[-1])
        spans = 1 << (top - sizes)
        out[symbols] = _reversed(top)[np.cumsum(spans) - spans]
    return out


#: One code for all lists of code lengths, by how often the symbols come: runs and the middle lengths most.
_OWN = code_lengths(np.array([40, 1, 2, 6, 10, 16, 20, 20, 20, 16, 10, 6, 4, 3, 2, 2, 10, 30, 10]), 7)
_LENGTHS_OF_LENGTHS = [(int(_OWN[i]), 3) for i in LENGTH_ORDER]
_LENGTH_WORDS = list(zip(code_words(_OWN).tolist(), _OWN.tolist(), strict=True))


def _one_symbol(symbol: int) -> list[tuple[int, int]]:
    return [(1, 1), (0, 1), (int(symbol > 1), 1), (symbol, 8 if symbol > 1 else 1)]


def put_code(w: Writer, lengths: np.ndarray) -> None:
    """A code's lengths: one or two symbols plainly, others run by run under a code of their own."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        first = int(used[0]) if len(used) else 0
        wide = int(first > 1)
        w.put((1, 1), (int(len(used) == 2), 1), (wide, 1), (first, 8 if wide else 1), *([(int(used[1]), 8)] if len(used) == 2 else []))
        return
    upto = int(used[-1]) + 1
    runs: list[tuple[int, int, int]] = []  # symbol, more bits, how many
    edges = np.flatnonzero(np.diff(lengths[:upto])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), upto], strict=True):
        value, n = int(lengths[a]), b - a
        if value:
            runs.append((value, 0, 0))
            n -= 1
        while n:
            if not value and n >= 11:
                k = min(n, 138)
                runs.append((18, k - 11, 7))
            elif n >= 3:
                k = min(n, 10 if not value else 6)
                runs.append((16 if value else 17, k - 3, 2 if value else 3))
            else:
                k = 1
                runs.append((value, 0, 0))
            n -= k
    w.put((0, 1), (15, 4), *_LENGTHS_OF_LENGTHS)
    if upto < len(lengths):  # how many follow, at least 2
        k = max(1, -(-max(1, (len(runs) - 2).bit_length()) // 2))
        w.put((1, 1), (k - 1, 3), (len(runs) - 2, 2 * k))
    else:
        w.put((0, 1))
    w.put(*[p for s, more, bits in runs for p in (_LENGTH_WORDS[s], (more, bits))])


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = values.astype(np.int64) - 1
    top = np.zeros(len(v), np.int64)
    big = v >= 4
    top[big] = np.frexp(v[big].astype(float))[1] - 1
    n = np.where(big, top - 1, 0)
    return np.where(big, 2 * top + (v >> n & 1), v), np.where(big, v & ((1 << n) - 1), 0), n


_FEW = 1 << 13
_FEW_PREFIXED = _prefixed(np.arange(1, _FEW))


def _sent(lengths: np.ndarray) -> tuple[int, int]:
    """What ``put_code`` writes, as one number and its bits."""
    w = Writer()
    put_code(w, lengths)
    return w.head, w.n


def prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, more bits, how many) of lengths or distance codes."""
    if len(values) and values.max() >= _FEW:
        return _prefixed(values)
    return tuple(x[values - 1] for x in _FEW_PREFIXED)


def matches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of back-references to the last equal ``SHORTEST`` samples, taken greedily."""
    none = np.empty(0, np.int64)
    n = len(x) - SHORTEST + 1
    if n < 2:
        return none, none, none
    padded = np.concatenate([x.astype(np.uint8), np.zeros(8, np.uint8)])
    key = np.ndarray(n, "<u8", padded, 0, (1,)) & np.uint64((1 << 8 * SHORTEST) - 1)
    mixed = key * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort((mixed >> np.uint64(48)).astype(np.uint16), kind="stable")  # by 16 bits of a hash, for many places by 32
    if n > 1 << 14:
        lower = np.argsort((mixed >> np.uint64(32)).astype(np.uint16), kind="stable")
        order = lower[np.argsort((mixed >> np.uint64(48)).astype(np.uint16)[lower], kind="stable")]
    sorted_ = key[order]
    same = np.flatnonzero(sorted_[1:] == sorted_[:-1])
    gap = np.zeros(n + 1, np.int64)
    gap[order[same + 1]] = order[same + 1] - order[same]
    at = np.flatnonzero(gap)
    if not len(at):
        return none, none, none
    # runs of one distance are one match: where the run of each place ends
    change = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    length = np.minimum(change[np.searchsorted(change, at, side="right")] - at + SHORTEST - 1, LONGEST_MATCH)
    upto = np.zeros(len(x) + 1, np.int64)
    upto[at] = 1
    upto = np.cumsum(upto) - upto  # candidates before each place
    after = memoryview(upto[at + length])
    taken, i, stop = array("q"), 0, len(at)
    push = taken.append
    while i < stop:
        push(i)
        i = after[i]
    taken = np.frombuffer(taken, np.int64)
    at = at[taken]
    return at, length[taken], gap[at]


_NEAR_CODES: dict[int, np.ndarray] = {}


def _distance_codes(gap: np.ndarray, width: int) -> np.ndarray:
    """The shortest code of each distance: a near one where there is one."""
    if width not in _NEAR_CODES:
        gaps = _near_gaps(width)
        codes = np.arange(int(gaps.max()) + 1) + 120
        codes[gaps[::-1]] = np.arange(120, 0, -1)
        _NEAR_CODES[width] = codes
    codes = _NEAR_CODES[width]
    return np.where(gap < len(codes), codes[np.minimum(gap, len(codes) - 1)], gap + 120)


_EVEN = np.where(np.arange(40) < 32, 5, 0)
_EVEN_WORDS = code_words(_EVEN)
_EVEN_SENT = _sent(_EVEN)


def put_pixels(w: Writer, x: np.ndarray, width: int, alpha: int, main: bool = True) -> None:
    """An image whose green samples are ``x`` and whose other channels are constant (red and blue 0)."""
    at, length, gap = matches(x)
    literal = np.ones(len(x), bool)
    change = np.zeros(len(x) + 1, np.int64)
    change[at] += 1
    change[at + length] -= 1
    literal[np.cumsum(change[:-1]) > 0] = False
    literal[at] = True  # the first pixel stands for its match
    places = np.flatnonzero(literal)
    back = np.searchsorted(places, at)
    green, more, n = x[places].astype(np.int64), np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    prefix, more[back], n[back] = prefixed(length)
    green[back] = 256 + prefix
    far, far_more, far_n = prefixed(_distance_codes(gap, width))
    greens = code_lengths(np.bincount(green, minlength=280))
    even = bool(len(far)) and int(far.max()) < 32  # distances up to 65,536: one code of 5 bits each
    fars = _EVEN if even else code_lengths(np.bincount(far, minlength=40))
    w.put((0, 1), *([(0, 1)] if main else []))
    put_code(w, greens)
    w.put(*[p for symbol in (0, 0, alpha) for p in _one_symbol(symbol)])
    w.put(_EVEN_SENT) if even else put_code(w, fars)
    size = greens[green] if (greens > 0).sum() > 1 else np.zeros(len(green), np.int64)
    value = code_words(greens)[green]
    value |= more.astype(np.uint64) << size.astype(np.uint64)
    size = size + n
    if len(back):
        far_size = fars[far] if (fars > 0).sum() > 1 else np.zeros(len(far), np.int64)
        value[back] |= (_EVEN_WORDS if even else code_words(fars))[far] << size[back].astype(np.uint64) | far_more.astype(np.uint64) << (size[back] + far_size).astype(np.uint64)
        size[back] += far_size + far_n
    w.put_all(value, size)


def _cost(x: np.ndarray) -> float:
    """Bits that the samples take without back-references."""
    n = np.bincount(x, minlength=256)
    n = n[n > 0]
    return float(-(n * np.log2(n / len(x))).sum())


def _predictor(some: np.ndarray) -> int:
    """0, or the predictor (1 left, 2 top) whose residuals are cheaper; samples of few bits each are left as they are."""
    plain = _cost(some.ravel())
    if plain <= 5.5 * some.size:
        return 0
    left, top = some.copy(), some.copy()
    left[:, 1:] -= some[:, :-1]
    top[1:] -= some[:-1]
    return int(np.argmin([plain, _cost(left.ravel()) + 64, _cost(top.ravel()) + 64]))


def encode_grey(samples: np.ndarray) -> bytes:
    """A lossless WebP file of a (height, width) array of 8-bit grey samples."""
    height, width = samples.shape
    if not (0 < height <= MAX_SIDE and 0 < width <= MAX_SIDE):
        raise ValueError("sides are from 1 to 16384")
    x = samples.ravel()
    shades = np.flatnonzero(np.bincount(x, minlength=256))
    w = Writer()
    w.put((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3))
    if len(shades) <= 16:
        pack = 3 if len(shades) <= 2 else 2 if len(shades) <= 4 else 1
        w.put((1, 1), (PALETTE, 2), (len(shades) - 1, 8))
        _put_palette(w, shades)
        per, size = 1 << pack, 8 >> pack
        index = np.pad(np.searchsorted(shades, samples), ((0, 0), (0, -width % per))).reshape(height, -1, per)
        w.put((0, 1))
        put_pixels(w, (index << size * np.arange(per)).sum(axis=2).ravel(), -(-width // per), 255)
    else:
        alpha, mode = 255, _predictor(samples[: -(-_TRIED // width)])
        if mode:  # one mode for the whole image; residuals have alpha 0 throughout
            rest = samples.copy()
            if mode == 1:
                rest[:, 1:] -= samples[:, :-1]
                rest[1:, 0] -= samples[:-1, 0]
            else:
                rest[1:] -= samples[:-1]
                rest[0, 1:] -= samples[0, :-1]
            x, alpha, block = rest.ravel(), 0, 9
            w.put((1, 1), (PREDICTOR, 2), (block - 2, 3), (0, 1))
            w.put(*[p for symbol in (mode, 0, 0, 255, 0) for p in _one_symbol(symbol)])
        w.put((1, 1), (SUBTRACT_GREEN, 2), (0, 1))
        put_pixels(w, x, width, alpha)
    body = w.bytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def _put_palette(w: Writer, shades: np.ndarray) -> None:
    """The palette image: differences of grey colours, the first from transparent black."""
    step = np.diff(shades, prepend=0)
    alpha = (np.arange(len(shades)) == 0) * 255
    w.put((0, 1))
    codes = [code_lengths(np.bincount(c, minlength=n)) for c, n in ((step, 280), (step, 256), (step, 256), (alpha, 256))]
    for lengths in (*codes, np.eye(40, dtype=np.int64)[0]):
        put_code(w, lengths)
    for s, a in zip(step.tolist(), alpha.tolist(), strict=True):
        for lengths, v in zip(codes, (s, s, s, a), strict=True):
            w.put((int(code_words(lengths)[v]), int(lengths[v]) if (lengths > 0).sum() > 1 else 0))
