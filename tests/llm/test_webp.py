"""The decoder against files of a small writer of its own: every kind of symbol, code and transform, one value at a time."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from skerry.llm import media, webp

SF = "/root/testdata/sf0.001"
ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]


class Out:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def word(self, code):
        self.bits += [int(c) for c in code]

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def words_of(symbols, rng):
    """Symbol -> code text of a complete canonical code; uneven where there are several symbols."""
    symbols = sorted(symbols)
    if len(symbols) == 1:
        return {symbols[0]: ""}, {symbols[0]: 1}
    sizes = [1, 1]
    while len(sizes) < len(symbols):  # split a leaf that is not too deep
        i = rng.choice([k for k, s in enumerate(sizes) if s < 12])
        sizes[i] += 1
        sizes.append(sizes[i])
    rng.shuffle(sizes)
    lengths = dict(zip(symbols, sizes, strict=True))
    out, code, size = {}, 0, 0
    for s in sorted(symbols, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - size
        size = lengths[s]
        out[s] = format(code, f"0{size}b")
        code += 1
    return out, lengths


def put_code(o, symbols, alphabet, rng):
    words, lengths = words_of(symbols or [0], rng)
    if len(words) <= 2 and max(words) < 256 and rng.random() < 0.5:
        a, *b = sorted(words)
        o.put(1, 1)
        o.put(len(b), 1)
        o.put(int(a > 1), 1)
        o.put(a, 8 if a > 1 else 1)
        for s in b:
            o.put(s, 8)
        return {s: (format(i, "b") if b else "") for i, s in enumerate(sorted(words))}
    o.put(0, 1)  # lengths 0 to 15 and the three runs, all with codes of 4 or 5 bits
    own = {s: 4 for s in range(13)} | {s: 5 for s in range(13, 19)}
    own_words, code, size = {}, 0, 0
    for s in sorted(own, key=lambda s: (own[s], s)):
        code <<= own[s] - size
        size = own[s]
        own_words[s] = format(code, f"0{size}b")
        code += 1
    o.put(15, 4)
    for s in ORDER:
        o.put(own[s], 3)
    o.put(0, 1)
    row, i = [lengths.get(s, 0) for s in range(alphabet)], 0
    last = 8
    while i < alphabet:
        n = next((k for k in range(1, alphabet - i) if row[i + k] != row[i]), alphabet - i)
        if row[i] == 0 and n >= 3:
            n = min(n, 138)
            o.word(own_words[18 if n >= 11 else 17])
            o.put(n - 11 if n >= 11 else n - 3, 7 if n >= 11 else 3)
        elif row[i] == last and n >= 3:
            n = min(n, 6)
            o.word(own_words[16])
            o.put(n - 3, 2)
        else:
            n = 1
            o.word(own_words[row[i]])
            last = row[i] or last
        i += n
    return words


def prefix(v):
    if v <= 4:
        return v - 1, 0, 0
    top = (v - 1).bit_length() - 1
    half = (v - 1) >> (top - 1) & 1
    return 2 * top + half, (v - 1) & ((1 << (top - 1)) - 1), top - 1


def put_image(o, pixels, width, rng, main, cache_bits=0, block=0):
    """Literals, back-references near and far, and cache hits, chosen at random among those that fit."""
    height = len(pixels) // width
    ops, cache, i = [], {}, 0
    while i < len(pixels):
        hit = (0x1E35A7BD * pixels[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        n = 1
        if cache_bits and cache.get(hit, 0) == pixels[i] and rng.random() < 0.7:
            ops.append((i, "cache", hit))
        else:
            ops.append((i, "literal", pixels[i]))
            for d in (1, 2, width - 1, width, width + 1, 3 * width + 2, 300):
                k = 0
                while 1 <= d <= i and i + k < len(pixels) and k < 60 and pixels[i + k] == pixels[i + k - d]:
                    k += 1
                if k > 2 and rng.random() < 0.8:
                    code = next((c for c, (x, y) in enumerate(NEAR, 1) if max(1, x + y * width) == d and rng.random() < 0.7), d + 120)
                    ops[-1] = (i, "back", k, code)
                    n = k
                    break
        for p in pixels[i : i + n]:
            cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0] = p
        i += n
    o.put(int(cache_bits > 0), 1)
    if cache_bits:
        o.put(cache_bits, 4)
    owner = [0]
    wide = 1
    if main:
        o.put(int(block > 0), 1)
        if block:
            o.put(block - 2, 3)
            wide = -(-width >> block)
            owner = [int(rng.integers(0, 3)) for _ in range(wide * -(-height >> block))]
            put_image(o, [g << 8 for g in owner], wide, rng, False)
    group = lambda i: owner[(i // width >> block) * wide + (i % width >> block)] if block else 0
    used = [[set() for _ in range(5)] for _ in range(max(owner) + 1)]
    for i, kind, *x in ops:
        g = used[group(i)]
        if kind == "literal":
            for c, shift in enumerate((8, 16, 0, 24)):
                g[c].add(x[0] >> shift & 255)
        elif kind == "back":
            g[0].add(256 + prefix(x[0])[0])
            g[4].add(prefix(x[1])[0])
        else:
            g[0].add(280 + x[0])
    codes = [[put_code(o, s, n, rng) for s, n in zip(g, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40), strict=True)] for g in used]
    for i, kind, *x in ops:
        g = codes[group(i)]
        if kind == "literal":
            for c, shift in enumerate((8, 16, 0, 24)):
                o.word(g[c][x[0] >> shift & 255])
        elif kind == "back":
            p, more, n = prefix(x[0])
            o.word(g[0][256 + p])
            o.put(more, n)
            p, more, n = prefix(x[1])
            o.word(g[4][p])
            o.put(more, n)
        else:
            o.word(g[0][280 + x[0]])
    return o


NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))


def split(p):
    return [p >> s & 255 for s in (24, 16, 8, 0)]


def join(c):
    return (c[0] & 255) << 24 | (c[1] & 255) << 16 | (c[2] & 255) << 8 | c[3] & 255


def guess(mode, left, top, right, corner):
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: min(255, max(0, v))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner, strict=True)]
    plain = {0: [255, 0, 0, 0], 1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top), 8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right))}
    return plain[mode]


def predictor(o, pixels, width, rng, modes):
    height, block = len(pixels) // width, 2
    wide = -(-width >> block)
    own = [int(rng.choice(modes)) for _ in range(wide * -(-height >> block))]
    o.put(1, 1)
    o.put(0, 2)
    o.put(block - 2, 3)
    put_image(o, [m << 8 for m in own], wide, rng, False)
    out = []
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        at = lambda k: split(pixels[k])
        if i == 0:
            g = [255, 0, 0, 0]
        elif y == 0:
            g = at(i - 1)
        elif x == 0:
            g = at(i - width)
        else:
            g = guess(own[(y >> block) * wide + (x >> block)], at(i - 1), at(i - width), at(i - width + 1), at(i - width - 1))
        out.append(join([a - b for a, b in zip(split(p), g, strict=True)]))
    return out


def cross_colour(o, pixels, width, rng):
    height, block = len(pixels) // width, 3
    wide = -(-width >> block)
    own = [[int(v) for v in rng.integers(0, 256, 3)] for _ in range(wide * -(-height >> block))]
    o.put(1, 1)
    o.put(1, 2)
    o.put(block - 2, 3)
    put_image(o, [join([255, *e]) for e in own], wide, rng, False)
    signed = lambda v: v - 256 if v > 127 else v
    out = []
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        red_to_blue, green_to_blue, green_to_red = map(signed, own[(y >> block) * wide + (x >> block)])
        a, r, g, b = split(p)
        out.append(join([a, r - (green_to_red * signed(g) >> 5), g, b - (green_to_blue * signed(g) >> 5) - (red_to_blue * signed(r) >> 5)]))
    return out


def subtract_green(o, pixels, width, rng):
    o.put(1, 1)
    o.put(2, 2)
    return [join([a, r - g, g, b - g]) for a, r, g, b in map(split, pixels)]


def palette(o, pixels, width, rng):
    """(packed pixels, their width)."""
    colours = list(dict.fromkeys(pixels))
    o.put(1, 1)
    o.put(3, 2)
    o.put(len(colours) - 1, 8)
    steps = [join([a - b for a, b in zip(split(c), split(before), strict=True)]) for c, before in zip(colours, [0, *colours], strict=False)]
    put_image(o, steps, len(colours), rng, False)
    size = 1 if len(colours) <= 2 else 2 if len(colours) <= 4 else 4 if len(colours) <= 16 else 8
    per = 8 // size
    out = []
    for y in range(len(pixels) // width):
        row = [colours.index(p) for p in pixels[y * width : (y + 1) * width]]
        out += [join([255, 0, sum(v << size * k for k, v in enumerate(row[x : x + per])), 0]) for x in range(0, width, per)]
    return out, -(-width // per)


def packed(o):
    body = o.bytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def picture(rng, width, height, colours):
    few = [join(rng.integers(0, 256, 4).tolist()) for _ in range(colours)]
    runs = [[int(rng.integers(0, colours))] * int(rng.integers(1, 9)) for _ in range(width * height)]
    return [few[k] for r in runs for k in r][: width * height]


def start(width, height):
    o = Out()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        o.put(v, n)
    return o


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("cache_bits,block", [(0, 0), (1, 0), (6, 0), (11, 0), (0, 2), (5, 3)])
def test_symbols_and_groups(seed, cache_bits, block):
    """Literals of all channels, back-references, colour cache, one group of codes and several."""
    rng = np.random.default_rng(seed)
    width, height = int(rng.integers(1, 40)), int(rng.integers(1, 20))
    pixels = picture(rng, width, height, [1, 2, 7, 60][seed % 4])
    o = start(width, height)
    o.put(0, 1)
    put_image(o, pixels, width, rng, True, cache_bits, block)
    assert webp.decode(packed(o)).ravel().tolist() == pixels


@pytest.mark.parametrize("mode", [*range(14), "mixed"])
def test_predictors(mode):
    rng = np.random.default_rng(3)
    for width, height in ((1, 1), (1, 9), (13, 1), (13, 11)):
        pixels = picture(rng, width, height, 30)
        o = start(width, height)
        rest = predictor(o, pixels, width, rng, list(range(14)) if mode == "mixed" else [mode])
        o.put(0, 1)
        put_image(o, rest, width, rng, True, 4)
        assert webp.decode(packed(o)).ravel().tolist() == pixels


@pytest.mark.parametrize("steps", [[cross_colour], [subtract_green], [cross_colour, subtract_green], ["predictor", cross_colour, subtract_green], [subtract_green, cross_colour, "predictor"]])
def test_colour_transforms(steps):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        width, height = int(rng.integers(2, 30)), int(rng.integers(2, 20))
        pixels = picture(rng, width, height, 25)
        o, now = start(width, height), pixels
        for step in steps:
            now = predictor(o, now, width, rng, range(14)) if step == "predictor" else step(o, now, width, rng)
        o.put(0, 1)
        put_image(o, now, width, rng, True, 3 * (seed % 2), 2 * (seed % 3))
        assert webp.decode(packed(o)).ravel().tolist() == pixels


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 100])
def test_palettes(colours):
    for seed in range(3):
        rng = np.random.default_rng(seed)
        width, height = int(rng.integers(1, 30)), int(rng.integers(5, 20))
        pixels = picture(rng, width, height, colours)
        o = start(width, height)
        rest, wide = palette(o, pixels, width, rng)
        if seed:
            rest = predictor(o, rest, wide, rng, range(14))
        o.put(0, 1)
        put_image(o, rest, wide, rng, True, 2 * (seed % 2))
        assert webp.decode(packed(o)).ravel().tolist() == pixels


def test_broken_files_raise():
    good = webp.encode_grey(np.arange(640).reshape(-1, 64).astype(np.uint8) * 7)
    for bad in (b"", b"RIFF", good[:12] + b"VP8X" + good[16:], good[:20] + b"\0" + good[21:], good[:20] + good[20:30]):
        with pytest.raises(ValueError):
            webp.decode(bad)


@pytest.mark.parametrize("longest", [4, 7, 15])
def test_code_lengths_fit(longest):
    counts = np.array([0, *(2**i for i in range(14))])
    lengths = webp.code_lengths(counts, longest)
    used = lengths[lengths > 0]
    assert used.max() <= longest and sum(2.0 ** -used) == 1 and lengths[0] == 0


def test_grey_samples_take_every_way(monkeypatch):
    """Palettes, plain literals, both predictors, long matches, pieces that end within a symbol."""
    monkeypatch.setattr(webp, "PIECE", 7)
    rng = np.random.default_rng(2)
    ramp = np.add.outer(np.zeros(40, int), np.arange(64) * 3).astype(np.uint8)
    noise = rng.integers(0, 256, (40, 64)).astype(np.uint8)
    drift = np.cumsum(rng.integers(0, 3, (60, 64)), axis=1).astype(np.uint8)
    for x in (ramp, ramp.T, noise, drift, drift.T, np.zeros((300, 64), np.uint8), np.tile(noise[:3], (40, 1)), noise & 1, noise & 3, noise & 15):
        x = np.ascontiguousarray(x)
        assert ((webp.decode(webp.encode_grey(x)) >> 8 & 255).astype(np.uint8) == x).all()
    assert len(webp.encode_grey(drift)) < 0.4 * drift.size


def brute_feature(payload):
    rows = [payload[i : i + 64] for i in range(0, len(payload), 64)]
    steps = sum(abs(a - b) for r in rows for a, b in zip(r, r[1:], strict=False))
    shades = [sum(1 for v in payload if v >> 4 == s) for s in range(16)]
    return f"64x{len(rows)}:{sum(payload)}:{sum(v * v for v in payload)}:{steps}:" + ",".join(map(str, shades))


def test_media_columns_by_brute_force(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    rows = media.op5_media_columns(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.to_media(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        if len(payload) < 4000:
            assert r.feature == brute_feature(payload)
    assert sum(r.media_bytes for r in rows) < 0.6 * sum(r.n_bytes for r in rows)
