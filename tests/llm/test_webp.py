import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from twinlake.llm import webp

from .conftest import ODD


def put_codes(w, symbols, size):
    weights = [0.0] * size
    for s in symbols:
        weights[s] += 1
    lengths = webp.huffman(weights, 15) if symbols else bytes(size)
    webp.write_lengths(w, lengths)
    return webp.codes_of(lengths)


def put_image(w, px, cache_bits=0, refs=(), main=None, meta=None):
    """px: ARGB values; refs: {at: (length, distance code)}; main: write the meta flag; meta: (bits, width, group of a block)."""
    w.put(bool(cache_bits), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups = 1
    if main:
        w.put(meta is not None, 1)
        if meta:
            bits, across, of = meta
            w.put(bits - 2, 3)
            put_image(w, [0xFF000000 | g << 8 for g in of])
            groups = max(of) + 1
    refs, cache, tokens, i = dict(refs), {}, [], 0
    place = lambda v: (0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(px):
        g = meta[2][(i // main >> meta[0]) * meta[1] + (i % main >> meta[0])] if meta else 0
        if i in refs:
            n, code = refs[i]
            tokens.append((g, "ref", webp.prefix_symbol(n), webp.prefix_symbol(code)))
        elif cache_bits and cache.get(place(px[i])) == px[i]:
            n = 1
            tokens.append((g, "cache", place(px[i])))
        else:
            n = 1
            tokens.append((g, "plain", px[i]))
        if cache_bits:
            for v in px[i : i + n]:
                cache[place(v)] = v
        i += n
    tables = []
    for k in range(groups):
        own = [t for t in tokens if t[0] == k]
        plain = [t[2] for t in own if t[1] == "plain"]
        green = [v >> 8 & 255 for v in plain] + [256 + t[2][0] for t in own if t[1] == "ref"] + [280 + t[2] for t in own if t[1] == "cache"]
        lists = (green, [v >> 16 & 255 for v in plain], [v & 255 for v in plain], [v >> 24 for v in plain], [t[3][0] for t in own if t[1] == "ref"])
        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        tables.append([put_codes(w, s or [0], n) for s, n in zip(lists, sizes, strict=True)])
    for t in tokens:
        green, red, blue, alpha, far = tables[t[0]]
        if t[1] == "plain":
            v = t[2]
            for code, s in ((green, v >> 8 & 255), (red, v >> 16 & 255), (blue, v & 255), (alpha, v >> 24)):
                w.put(*code[s])
        elif t[1] == "cache":
            w.put(*green[280 + t[2]])
        else:
            for code, base, (s, extra, bits) in ((green, 256, t[2]), (far, 0, t[3])):
                w.put(*code[base + s])
                w.put(extra, bits)


def stream(width, height, body):
    w = webp.BitWriter()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    body(w)
    return w.value.to_bytes((w.n + 7) // 8, "little")


def values(n, seed=1, colours=None):
    rng = random.Random(seed)
    pool = [rng.getrandbits(32) for _ in range(colours)] if colours else None
    return [rng.choice(pool) if pool else rng.getrandbits(32) for _ in range(n)]


def argb(px):
    return webp.join(px.reshape(-1, 4)).tolist()


def plain(w, px, width, **more):
    w.put(0, 1)
    put_image(w, px, main=width, **more)


@pytest.mark.parametrize("colours", [1, 2, 3, 40, None])
def test_prefix_codes(colours):
    px = values(12 * 7, colours=colours)
    s = stream(12, 7, lambda w: plain(w, px, 12))
    assert argb(webp.decode(s)) == px
    assert argb(webp.decode_many([s, s])[1]) == px


def test_colour_cache_and_meta_codes():
    px = values(16 * 16, colours=20)
    assert argb(webp.decode(stream(16, 16, lambda w: plain(w, px, 16, cache_bits=4)))) == px
    assert argb(webp.decode(stream(16, 16, lambda w: plain(w, px, 16, meta=(2, 4, [0, 1, 2, 1] * 4))))) == px
    assert argb(webp.decode(stream(16, 16, lambda w: plain(w, px, 16, cache_bits=7, meta=(3, 2, [1, 0, 0, 1]))))) == px


def test_back_references():
    px = values(10)
    px += [px[-1]] * 6  # code 2: one to the left, overlapping itself
    px += px[6:16]  # code 1: the row above
    px += px[3:8]  # a distance beyond the near ones
    refs = {10: (6, 2), 16: (10, 1), 26: (5, 120 + 23)}
    px += values(9, 5)
    s = stream(10, 4, lambda w: plain(w, px, 10, refs=refs))
    assert argb(webp.decode(s)) == px
    assert argb(webp.decode_many([s])[0]) == px
    bad = stream(10, 4, lambda w: plain(w, px, 10, refs={0: (3, 2), **refs}))
    for read in (webp.decode, lambda x: webp.decode_many([x])):
        with pytest.raises(ValueError):
            read(bad)


def test_near_distances_are_the_formats():
    assert len(webp.NEAR) == 120 == len(set(webp.NEAR))
    assert webp.distance(1, 100) == 100 and webp.distance(2, 100) == 1 and webp.distance(4, 100) == 99 and webp.distance(121, 100) == 1
    assert max(abs(x) for x, _ in webp.NEAR) == 8 and max(y for _, y in webp.NEAR) == 7


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    w, h = 9, 6
    px = values(w * h, mode)
    c = webp.split(np.array(px, np.uint32)).astype(int).tolist()
    rest = []
    for i, v in enumerate(c):
        y, x = divmod(i, w)
        p = ([0, 0, 0, 255] if not x else c[i - 1]) if not y else c[i - w] if not x else webp.predict(mode, c[i - 1], c[i - w], c[i - w + 1], c[i - w - 1])
        rest.append([(a - b) & 255 for a, b in zip(v, p, strict=True)])
    rest = webp.join(np.array(rest)).tolist()

    def body(b):
        b.put(1, 1)
        b.put(0, 2)
        b.put(0, 3)  # blocks of four
        put_image(b, [0xFF000000 | mode << 8] * (3 * 2))
        plain(b, rest, w)

    assert argb(webp.decode(stream(w, h, body))) == px


def test_predictor_modes_by_hand():
    left, top, right, corner = [10, 0, 255, 7], [20, 9, 0, 7], [31, 1, 1, 1], [15, 4, 100, 7]
    assert webp.predict(0, left, top, right, corner) == [0, 0, 0, 255]
    assert [webp.predict(m, left, top, right, corner) for m in (1, 2, 3, 4)] == [left, top, right, corner]
    assert webp.predict(5, left, top, right, corner) == [20, 4, 64, 5]
    assert webp.predict(10, left, top, right, corner)[0] == ((10 + 15) // 2 + (20 + 31) // 2) // 2
    assert webp.predict(12, left, top, right, corner) == [15, 5, 155, 7]
    assert webp.predict(13, left, top, right, corner)[0] == 15 and webp.predict(13, left, top, right, corner)[2] == 127 + 13
    assert webp.predict(11, left, top, right, corner) == left  # 110 < 164: the pixel above is nearer to the corner


def test_green_and_cross_colour():
    px = values(8 * 8)

    def green(b):
        b.put(1, 1)
        b.put(2, 2)
        plain(b, px, 8)

    want = [v & 0xFF00FF00 | ((v >> 16) + (v >> 8) & 255) << 16 | (v + (v >> 8)) & 255 for v in px]
    assert argb(webp.decode(stream(8, 8, green))) == want
    g2r, g2b, r2b = -30, 77, 120

    def cross(b):
        b.put(1, 1)
        b.put(1, 2)
        b.put(1, 3)
        put_image(b, [0xFF000000 | (r2b & 255) << 16 | (g2b & 255) << 8 | g2r & 255])
        plain(b, px, 8)

    signed = lambda v: (v & 255) - 256 * (v & 128 > 0)
    want = []
    for v in px:
        g = signed(v >> 8)
        r = (v >> 16 & 255) + (g2r * g >> 5) & 255
        bl = (v & 255) + (g2b * g >> 5) + (r2b * signed(r) >> 5) & 255
        want.append(v & 0xFF00FF00 | r << 16 | bl)
    assert argb(webp.decode(stream(8, 8, cross))) == want


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palette(n):
    w, h, rng = 13, 5, random.Random(n)
    palette = [rng.getrandbits(32) for _ in range(n)]
    index = [rng.randrange(n) for _ in range(w * h)]
    pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    bits, inner = 8 >> pack, -(-w >> pack)
    rows = [[sum(index[y * w + x] << bits * (x & ((1 << pack) - 1)) for x in range(k << pack, min(w, k + 1 << pack))) for k in range(inner)] for y in range(h)]
    c = webp.split(np.array(palette, np.uint32)).astype(int)
    steps = webp.join(np.diff(c, axis=0, prepend=0) & 255).tolist()

    def body(b):
        b.put(1, 1)
        b.put(3, 2)
        b.put(n - 1, 8)
        put_image(b, steps)
        plain(b, [0xFF000000 | g << 8 for r in rows for g in r], inner)

    assert argb(webp.decode(stream(w, h, body))) == [palette[i] for i in index]


def test_broken_streams():
    ok = webp.encode_many([webp.payload_of("some text")[0]])[0]
    for bad in (b"", b"\x2e" + ok[1:], ok[:30], ok[: len(ok) // 2]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)


def test_store_and_read_back(spark, docs_of):
    texts = [*ODD, "ÿ" * 40000, "y" * 575, "y" * 576, "y" * 577, "ab" * 60000]
    got = {r.doc_id: r for r in webp.describe(webp.store(docs_of(texts))).collect()}
    files = {r.doc_id: bytes(r.media) for r in webp.store(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        data = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(files[i]), hashlib.sha256(files[i]).hexdigest())
        at, px = 0, []
        while at < len(files[i]):
            s, at = webp.chunk(files[i], at)
            px.append(webp.decode(s))  # the plain decoder agrees with the one that works in step
        assert webp.samples(px) == data
    same = [r for i, r in got.items() if texts[i] == "dup dup"]
    assert same[0][1:] == same[1][1:]
    assert webp.describe(webp.store(docs_of([]))).count() == 0


def test_stored_pictures_use_every_form():
    """Own codes, cache, predictor and palette occur where they shrink a picture, and both decoders read all of them."""
    rng = np.random.default_rng(3)
    line = bytes(rng.integers(32, 127, 576, dtype=np.uint8))
    shifted = b"".join(((np.frombuffer(line, np.uint8).astype(int) + k % 3) % 256).astype(np.uint8).tobytes() for k in range(64))
    ramp = np.repeat(np.cumsum(rng.integers(0, 2, 192 * 64)) % 256, 3).astype(np.uint8).tobytes()
    grey = np.repeat(rng.integers(0, 256, 192 * 64, dtype=np.uint8), 3).tobytes()
    few = rng.choice(np.array([[1, 2, 3], [9, 9, 9], [250, 0, 7]], np.uint8), 192 * 8).tobytes()
    words = (" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"], 5000)).encode() + b" " * 576)[: 576 * 40]
    noise = bytes(rng.integers(0, 256, 576 * 64, dtype=np.uint8))
    short = b"etaoin shrdlu " * 3 + b"\xff" * (576 - 42)
    payloads = [shifted, ramp, grey, few, words, noise, short]
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 3)[:, [1, 0, 2]]
    forms, cache = webp._forms(raw, np.array([len(p) // 3 for p in payloads]))
    assert forms[0] == 5 and forms[1] == 4 and forms[2] == 3 and forms[3] == 6 and forms[4] == 2 and cache[4] > 0 and {1, 0} & set(forms.tolist()), forms
    streams = webp.encode_many(payloads)
    alone = [webp.samples([webp.decode(s)]) for s in streams]
    together = [webp.samples([p]) for p in webp.decode_many(streams)]
    assert alone == payloads and together == payloads
    # a form is only taken where it is less than the fixed codes
    kinds = [webp.read_transforms(webp.read_start(s)[0], 192, 64)[0] for s in streams]
    assert [len(k) for k in kinds] == [int(f >= 3) for f in forms]
    assert len(streams[3]) < len(few) / 8 and len(streams[0]) < len(shifted) / 20


def test_stored_text_uses_cache_and_own_codes():
    texts = [" ".join(f"word{(i * 7 + k) % 50}" for i in range(2000)) for k in range(6)]
    payloads = [webp.payload_of(t)[0] for t in texts]
    media = webp.write_files(payloads)
    heads = [webp._head(webp.chunk(m)[0]) for m in media]
    assert all(h[3] > 0 for h in heads) and len({h[4] for h in heads}) > 1
    assert [webp.samples(p) for p in webp.read_files(media)] == payloads
    assert media == webp.write_files(payloads) and media[2] == webp.write_files([payloads[2]])[0]  # whatever stands beside it


@pytest.mark.parametrize("mode", [1, 2])
@pytest.mark.parametrize("width,height", [(1, 1), (1, 5), (5, 1), (7, 9)])
def test_even_predictors_as_the_general_way(mode, width, height):
    px = np.random.default_rng(width * height).integers(0, 1 << 32, width * height, dtype=np.uint32)
    one = np.full(1, mode << 8, np.uint32)
    mixed = webp.undo_predictor(px, width, height, 2, np.array([mode << 8] * (-(-width // 4) * -(-height // 4) - 1) + [mode << 8], np.uint32))
    c = webp.split(px).astype(int)
    for i in range(width * height):
        y, x = divmod(i, width)
        p = np.array([0, 0, 0, 255]) if not i else c[i - 1] if not y or x and mode == 1 else c[i - width]
        c[i] = (c[i] + p) & 255
    assert (webp.undo_predictor(px, width, height, 9, one) == webp.join(c)).all() and (mixed == webp.join(c)).all()


def test_codes_of_many_pictures_are_those_of_each():
    """Code lengths, codes and their written form are made for many pictures in one; all are as for one alone."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 40, (80, 60)) * (rng.random((80, 60)) < rng.random((80, 1)))
    counts[0], counts[1, 1:], counts[2, :40] = 0, 0, [int(1.5**i) for i in range(40)]
    counts[counts.sum(axis=1) == 0, 0] = 7
    for longest in (7, 15):
        lengths = webp.huffman_many(counts, longest)
        assert [x.tobytes() for x in lengths] == [webp.huffman(x.tolist(), longest) for x in counts]
        codes, sizes = webp._codes_many(lengths)
        for row, code, size in zip(lengths, codes, sizes, strict=True):
            assert list(zip(code.tolist(), size.tolist(), strict=True)) == webp.codes_of(row.tobytes())
    odd = [bytes([8] * 256), bytes([5] * 32 + [0] * 200), bytes([0] * 279 + [1]), bytes([0] * 270 + [1, 1] + [0] * 300)]
    every = [x.tobytes() for x in lengths] + odd
    assert webp.written_many(every) == [webp._written_lengths(x) for x in every]
    for x, (value, n) in zip(every, webp.written_many(every), strict=True):
        got = webp.read_lengths(webp.Bits(value.to_bytes(n + 7 >> 3, "little") + bytes(8)), len(x))
        assert got == x


def test_limited_codes_are_the_best():
    """A code that had to be flattened was longer than need be."""
    weights = [2, 2, 4, 6, 11, 19, 35, 62, 111, 199]
    got = webp.huffman(weights, 5)
    assert max(got) <= 5 and sum(2.0**-n for n in got) == 1
    cost = sum(w * n for w, n in zip(weights, got, strict=True))
    best = min(
        sum(w * n for w, n in zip(sorted(weights), sorted(x, reverse=True), strict=True))
        for x in itertools.combinations_with_replacement(range(1, 6), 10)
        if sum(2.0**-n for n in x) == 1
    )
    assert cost == best
