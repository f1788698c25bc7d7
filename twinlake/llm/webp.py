"""Lossless WebP: a decoder for the whole format, and a writer that stores byte payloads as pictures.

`decode` reads any lossless stream: prefix codes (also by meta codes), back-references, colour cache, and the
predictor, cross-colour, subtract-green and palette transforms. `decode_many` reads many streams in step, one symbol
of each at a time as numpy columns, each by its own prefix codes and colour cache, and then undoes their transforms;
streams with meta codes go to `decode`. Both give ARGB pixels as numpy arrays.

`store` keeps a document's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576, as RGB samples in
pictures 192 pixels wide and at most 64 rows high, one WebP file after the other. For every picture the least of some
forms is taken, as estimated from its own counts: one fixed set of prefix codes for text, or codes of its own, these
also with a colour cache, or after a subtract-green, a predictor or a palette transform. Runs of a pixel are
back-references in every form.

Null text counts as empty: one row of 255. Equal texts give equal files; of forms of equal size the first named is
taken. A very long text is many pictures, a batch of them at a time. Repeated rows are stored each on their own, an
empty table gives no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame

from twinlake.llm.common import map_arrow, need

WIDTH, ROWS, UNIT = 192, 64, 576
#: Pictures whose prefix codes are made at a time.
CODES = 512

# Fixed values of the format: the order of code length codes, and the offsets (left, up) of the first 120 distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Little-endian bit reader."""

    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos, self.end = data, pos, 8 * len(data)

    def read(self, n: int) -> int:
        p = self.pos
        if p + n > self.end:
            raise ValueError("the stream ends early")
        self.pos = p + n
        return int.from_bytes(self.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7) & ((1 << n) - 1)

    def peek(self) -> int:
        p = self.pos
        return int.from_bytes(self.data[p >> 3 : (p >> 3) + 4], "little") >> (p & 7)


@lru_cache(maxsize=64)
def code_table(lengths: bytes) -> tuple[np.ndarray, int]:
    """Lookup by the next `bits` bits: symbol << 4 | length of its code. One used symbol has a code of no bits."""
    n = np.frombuffer(lengths, np.uint8)
    used = np.flatnonzero(n)
    if not len(used):
        return np.zeros(1, np.uint32), 0
    if len(used) == 1:
        return (used << 4).astype(np.uint32), 0
    order = used[np.argsort(n[used], kind="stable")]
    sizes = n[order].astype(np.int64)
    bits = int(sizes[-1])
    # in canonical order codes fill the table from its beginning, read from the first bit down
    spans = 1 << (bits - sizes)
    if spans.sum() != 1 << bits:
        raise ValueError("prefix code isn't complete")
    entries = np.repeat((order << 4 | sizes).astype(np.uint32), spans)
    return entries[_reversed(bits)], bits


@lru_cache(maxsize=16)
def _reversed(bits: int) -> np.ndarray:
    """Every number of so many bits read backwards."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def read_symbol(b: Bits, table: tuple[np.ndarray, int]) -> int:
    e = int(table[0][b.peek() & ((1 << table[1]) - 1)])
    b.pos += e & 15
    if b.pos > b.end:
        raise ValueError("the stream ends early")
    return e >> 4


def read_lengths(b: Bits, size: int) -> bytes:
    """Code lengths of one prefix code over `size` symbols."""
    out = bytearray(size)
    if b.read(1):
        two, wide = b.read(1), b.read(1)
        symbols = [b.read(8 if wide else 1)] + ([b.read(8)] if two else [])
        for s in symbols:
            out[s] = 1
        return bytes(out)
    of = bytearray(19)
    many = 4 + b.read(4)
    sizes = b.read(3 * many)
    for i in LENGTH_ORDER[:many]:
        of[i] = sizes & 7
        sizes >>= 3
    left = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else size
    entries, bits = _small_table(bytes(of))
    # at most 14 bits to a symbol, read from one number
    begin, mask, at, last, used = b.pos, (1 << bits) - 1, 0, 8, 0
    ahead = int.from_bytes(b.data[begin >> 3 : (begin + 14 * min(left, size) + 7 >> 3) + 1], "little") >> (begin & 7)
    while at < size and left:
        left -= 1
        e = entries[ahead & mask]
        s, n = e >> 4, e & 15
        if s < 16:
            out[at] = s
            at += 1
            last = s or last
        else:
            extra, least = ((2, 3), (3, 3), (7, 11))[s - 16]
            count = least + (ahead >> n & ((1 << extra) - 1))
            if at + count > size:
                raise ValueError("too many code lengths")
            if s == 16:
                out[at : at + count] = bytes([last]) * count
            at += count
            n += extra
        ahead >>= n
        used += n
    b.pos = begin + used
    if b.pos > b.end:
        raise ValueError("the stream ends early")
    return bytes(out)


@lru_cache(maxsize=256)
def _small_table(lengths: bytes) -> tuple[list[int], int]:
    table, bits = code_table(lengths)
    return table.tolist(), bits


def prefix_value(b: Bits, code: int) -> int:
    """Lengths and distances: a prefix symbol with its extra bits."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + b.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_pixels(b: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB values of one entropy-coded picture, back-references and colour cache resolved."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, meta, block = 1, None, 0
    if main and b.read(1):
        block = b.read(3) + 2
        across = -(-width >> block)
        meta = read_pixels(b, across, -(-height >> block), False) >> 8 & 0xFFFF
        groups = int(meta.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[code_table(read_lengths(b, n)) for n in sizes] for _ in range(groups)]
    cache = [0] * (1 << cache_bits) if cache_bits else []
    out, n, i = [0] * (width * height), width * height, 0
    green, red, blue, alpha, far = codes[0]
    while i < n:
        if meta is not None:
            green, red, blue, alpha, far = codes[int(meta[(i // width >> block) * across + (i % width >> block)])]
        s = read_symbol(b, green)
        if s < 256:
            v = read_symbol(b, red) << 16 | s << 8 | read_symbol(b, blue)
            out[i] = v | read_symbol(b, alpha) << 24
            i += 1
        elif s < 280:
            count = prefix_value(b, s - 256)
            back = distance(prefix_value(b, read_symbol(b, far)), width)
            if back > i or i + count > n:
                raise ValueError("back-reference outside the picture")
            for k in range(i, i + count):
                out[k] = out[k - back]
            i += count
        else:
            out[i] = cache[s - 280]
            i += 1
            count = 1
        if cache:
            for v in out[i - (count if s >= 256 else 1) : i]:
                cache[(0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
    return np.array(out, np.uint32)


def split(argb: np.ndarray) -> np.ndarray:
    """ARGB values as rows of (blue, green, red, alpha) bytes."""
    return np.ascontiguousarray(argb.astype("<u4")).view(np.uint8).reshape(-1, 4)


def join(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, dtype=np.uint8).view("<u4").reshape(-1).astype(np.uint32)


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def predict(mode: int, left, top, top_right, top_left) -> list[int]:
    """The predicted pixel of a mode; pixels are 4 channel values."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    if mode == 11:
        near = sum(abs(t - c) for t, c in zip(top, top_left, strict=True)) < sum(abs(p - c) for p, c in zip(left, top_left, strict=True))
        return list(left) if near else list(top)
    if mode == 12:
        return [_clamp(p + t - c) for p, t, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        half = lambda d: int(d / 2)  # noqa: E731  towards zero
        return [_clamp(m + half(m - c)) for m, c in zip(mean(left, top), top_left, strict=True)]
    plain = {
        0: lambda: [0, 0, 0, 255], 1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left,
        5: lambda: mean(mean(left, top_right), top), 6: lambda: mean(left, top_left), 7: lambda: mean(left, top),
        8: lambda: mean(top_left, top), 9: lambda: mean(top, top_right),
        10: lambda: mean(mean(left, top_left), mean(top, top_right)),
    }
    return list(plain.get(mode, plain[0])())


def undo_predictor(px: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    across = -(-width >> block)
    kinds = (modes >> 8 & 15).tolist()
    if set(kinds) <= {1} or set(kinds) <= {2}:
        # sums along the rows from the first column's, or down the columns from the first row's
        c = split(px).reshape(height, width, 4).copy()
        c[0, 0, 3] = int(c[0, 0, 3]) + 255 & 255
        edge, rest = (0, 1) if kinds[0] == 1 else (1, 0)
        begin = c[:, 0] if edge == 0 else c[0]
        begin[:] = np.cumsum(begin, axis=0, dtype=np.uint8)
        return join(np.cumsum(c, axis=rest, dtype=np.uint8).reshape(-1, 4))
    c = split(px).astype(int).tolist()
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not y:
                p = c[i - 1] if x else [0, 0, 0, 255]
            elif not x:
                p = c[i - width]
            else:
                # to the right of the last column stands the first pixel of the current row
                p = predict(kinds[(y >> block) * across + (x >> block)], c[i - 1], c[i - width], c[i - width + 1], c[i - width - 1])
            c[i] = [(a + b) & 255 for a, b in zip(c[i], p, strict=True)]
    return join(np.array(c, np.uint8))


def undo_cross_colour(px: np.ndarray, width: int, height: int, block: int, factors: np.ndarray) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    f = split(factors)[(y >> block) * -(-width >> block) + (x >> block)].view(np.int8).astype(int)
    c = split(px).copy()
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(int)
    green = signed(c[:, 1])
    red = c[:, 2] + (f[:, 0] * green >> 5)
    blue = c[:, 0] + (f[:, 1] * green >> 5) + (f[:, 2] * signed(red & 255) >> 5)
    c[:, 2], c[:, 0] = red & 255, blue & 255
    return join(c)


def undo_green(px: np.ndarray) -> np.ndarray:
    c = split(px).copy()
    c[:, 0] += c[:, 1]
    c[:, 2] += c[:, 1]
    return join(c)


def undo_palette(px: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    """px has several indices to a pixel where the palette is small; width is that of the picture."""
    pack = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
    rows = (px >> 8 & 255).reshape(height, -1)
    bits = 8 >> pack
    x = np.arange(width)
    index = rows[:, x >> pack] >> (x & ((1 << pack) - 1)).astype(np.uint32) * np.uint32(bits) & np.uint32((1 << bits) - 1)
    colours = np.zeros(256, np.uint32)  # an index beyond the palette is transparent black
    colours[: len(palette)] = palette
    return colours[index].reshape(-1)


def chunk(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The lossless stream of the WebP file that begins at `at`, and where the file ends."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
        raise ValueError("no WebP file")
    end, p = at + 8 + struct.unpack_from("<I", data, at + 4)[0], at + 12
    while p + 8 <= end:
        n = struct.unpack_from("<I", data, p + 4)[0]
        if data[p : p + 4] == b"VP8L":
            return data[p + 8 : p + 8 + n], end
        p += 8 + n + (n & 1)
    raise ValueError("no lossless picture")


def read_transforms(b: Bits, width: int, height: int) -> tuple[list, int]:
    """What undoes each transform of a stream, in their order, and the width of the coded picture."""
    undo, inner = [], width
    while b.read(1):
        kind = b.read(2)
        if kind == 2:
            undo.append(undo_green)
        elif kind == 3:
            n = b.read(8) + 1
            palette = join(np.cumsum(split(read_pixels(b, n, 1, False)), axis=0, dtype=np.uint8))
            undo.append(lambda px, w=inner, p=palette: undo_palette(px, w, height, p))
            inner = -(-inner >> (3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0))
        else:
            block = b.read(3) + 2
            data = read_pixels(b, -(-inner >> block), -(-height >> block), False)
            undo.append(lambda px, w=inner, k=block, d=data, f=undo_cross_colour if kind else undo_predictor: f(px, w, height, k, d))
    return undo, inner


def read_start(stream: bytes) -> tuple[Bits, int, int]:
    """A reader behind a stream's first fields, its width and height."""
    b = Bits(stream, 8)
    if stream[:1] != b"\x2f":
        raise ValueError("no lossless picture")
    width, height = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise ValueError("unknown version")
    return b, width, height


def decode(stream: bytes) -> np.ndarray:
    """Pixels (height, width, 4) of (blue, green, red, alpha) of one lossless stream."""
    b, width, height = read_start(stream)
    undo, inner = read_transforms(b, width, height)
    px = read_pixels(b, inner, height, True)
    for f in reversed(undo):
        px = f(px)
    return split(px).reshape(height, width, 4)


_HEADERS: dict[bytes, list[tuple[int, int, int, tuple]]] = {}  # parsed heads without transforms by their first bytes; each is compared bit by bit


def _head(stream: bytes) -> tuple[int, int, int, int, tuple, list] | None:
    """(first bit of the pixels, coded width, height, bits of the cache, code lengths, what undoes the transforms), or None
    for meta codes."""
    size = int.from_bytes(stream[1:5], "little")
    for bits, value, cache, lengths in _HEADERS.get(stream[5:13], ()):
        if int.from_bytes(stream[5 : 5 + (bits + 7 >> 3)], "little") & ((1 << bits) - 1) == value:
            return 40 + bits, (size & 16383) + 1, (size >> 14 & 16383) + 1, cache, lengths, []
    b, width, height = read_start(stream)
    undo, inner = read_transforms(b, width, height)
    cache = b.read(4) if b.read(1) else 0
    if cache > 11:
        raise ValueError("colour cache too large")
    if b.read(1):
        return None
    lengths = tuple(read_lengths(b, n) for n in (280 + (1 << cache if cache else 0), 256, 256, 256, 40))
    if not undo and len(_HEADERS) < 64:
        bits = b.pos - 40
        _HEADERS.setdefault(stream[5:13], []).append((bits, int.from_bytes(stream[5 : 5 + (bits + 7 >> 3)], "little") & ((1 << bits) - 1), cache, lengths))
    return b.pos, inner, height, cache, lengths, undo


def decode_many(streams: list[bytes]) -> list[np.ndarray]:
    """As `decode` for each, in step."""
    out: list[np.ndarray | None] = [None] * len(streams)
    heads = []
    for i, s in enumerate(streams):
        if head := _head(s):
            heads.append((i, head))
        else:
            out[i] = decode(s)
    if heads:
        px = _in_step([streams[i] for i, _ in heads], [h for _, h in heads])
        ends = np.cumsum([h[1] * h[2] for _, h in heads])
        for (i, (_, w, h, _, _, undo)), end in zip(heads, ends, strict=True):
            own = px[end - w * h : end]
            for f in reversed(undo):
                own = f(own)
            out[i] = split(own).reshape(h, -1, 4)
    return out


_SPREAD = 0x1E35A7BD


def _in_step(streams: list[bytes], heads: list[tuple]) -> np.ndarray:
    """ARGB values of the coded pictures one after the other."""
    data = b"".join(streams) + bytes(16)
    # signed: a symbol's bits lie below the 53rd
    words = np.ndarray((len(data) - 8,), "<i8", data, strides=(1,))
    begin = np.cumsum([0] + [len(s) for s in streams[:-1]])
    limit = 8 * (begin + [len(s) for s in streams])
    pos, width = 8 * begin + np.array([h[0] for h in heads]), np.array([h[1] for h in heads])
    sizes = width * np.array([h[2] for h in heads])
    end = np.cumsum(sizes)
    at, first = end - sizes, end - sizes
    out = np.zeros(int(end[-1]), np.int64)
    # every set of prefix codes once, its tables in one array; symbols of red and alpha stand where a pixel has them
    sets: dict[tuple, int] = {}
    which = np.array([sets.setdefault(h[4], len(sets)) for h in heads])
    tables = [[code_table(x) for x in lengths] for lengths in sets]
    flat, starts, masks = [], np.zeros((4, len(tables)), np.int64), np.zeros((4, len(tables)), np.int64)
    n = 0
    for k, of in enumerate(tables):
        for c, shift in enumerate((0, 16, 0, 24)):
            e = of[c][0].astype(np.int64)
            flat.append((e & ~15) << shift | e & 15 if shift else e)
            starts[c, k], masks[c, k] = n, (1 << of[c][1]) - 1
            n += len(e)
    flat = np.concatenate(flat)
    starts, masks = starts[:, which], masks[:, which]
    sees_alpha = masks[3].any()
    alpha = flat[starts[3]] >> 4  # where all pixels have one
    cache_bits = np.array([h[3] for h in heads])
    caching = bool(cache_bits.any())
    room = 1 << cache_bits
    place = np.cumsum(room) - room
    cache = np.zeros(int(room.sum()), np.int64)
    down = 32 - cache_bits

    def keep(v, k):
        cache[place[k] + ((v * _SPREAD & 0xFFFFFFFF) >> down[k])] = v

    while len(at):
        # every picture's next symbol as if it were a literal; what else it can be is put in its place
        w = words[pos >> 3] >> (pos & 7)
        e = flat[starts[0] + (w & masks[0])]
        s, n = e >> 4, e & 15
        w >>= n
        red = flat[starts[1] + (w & masks[1])]
        more = red & 15
        w >>= more
        blue = flat[starts[2] + (w & masks[2])]
        more += blue & 15
        v = (red >> 4) + (blue >> 4) + (s << 8)
        if sees_alpha:
            p = pos + n + more
            e = flat[starts[3] + (words[p >> 3] >> (p & 7) & masks[3])]
            more += e & 15
            v += e >> 4
        else:
            v += alpha
        pos += n
        other = s > 255
        far = ()
        if other.any():
            pos += np.where(other, 0, more)
            far = np.flatnonzero(other & (s < 280))
            if caching:
                v = np.where(other, cache[place + np.maximum(s - 280, 0)], v)
            # the pixel before, which the cache has already; the copy follows
            v[far] = out[at[far] - 1]
        else:
            pos += more
        out[at] = v
        if caching:
            cache[place + ((v * _SPREAD & 0xFFFFFFFF) >> down)] = v
        at += 1
        for k in far:
            b = Bits(data, int(pos[k]))
            count = prefix_value(b, int(s[k]) - 256)
            back, a = distance(prefix_value(b, read_symbol(b, tables[which[k]][4])), int(width[k])), int(at[k]) - 1
            if back > a - first[k] or a + count > end[k]:
                raise ValueError("back-reference outside the picture")
            got = out[a : a + count] = np.resize(out[a - back : a], count) if back < count else out[a - back : a - back + count]
            if caching:
                keep(got[-back:] if back < count else got, np.full(min(back, count), k))
            pos[k] = b.pos
            at[k] = a + count
        live = at < end
        if not live.all():
            if (pos > limit).any():
                raise ValueError("the stream ends early")
            pos, at, end, first, width, limit, which, place, down, alpha = (x[live] for x in (pos, at, end, first, width, limit, which, place, down, alpha))
            starts, masks = starts[:, live], masks[:, live]
    return out.astype(np.uint32)


# --- writing


def huffman(weights: list[float], longest: int) -> bytes:
    """The best code lengths of at most `longest`."""
    depth = bytearray(len(weights))
    used = [i for i, w in enumerate(weights) if w]
    if len(used) == 1:
        depth[used[0]] = 1
        return bytes(depth)
    # leaves by weight, and inner nodes, which come in order of weight by themselves
    leaves = sorted(used, key=weights.__getitem__)
    n = len(leaves)
    w, up = [weights[i] for i in leaves], [0] * (2 * n - 1)
    w.append(float("inf"))  # no leaf is left
    inner: list = []
    a = b = 0
    for node in range(n - 1):
        top = n + node
        if b == node or w[a] <= inner[b]:
            x, up[a], a = w[a], top, a + 1
        else:
            x, up[n + b], b = inner[b], top, b + 1
        if b == node or w[a] <= inner[b]:
            x, up[a], a = x + w[a], top, a + 1
        else:
            x, up[n + b], b = x + inner[b], top, b + 1
        inner.append(x)
    deep = [0] * (2 * n - 1)
    for node in range(2 * n - 3, -1, -1):
        deep[node] = deep[up[node]] + 1
    if max(deep[:n]) <= longest:
        for i, d in zip(leaves, deep, strict=False):
            depth[i] = d
        return bytes(depth)
    return _limited(weights, leaves, longest)


def _limited(weights: list[float], leaves: list[int], longest: int) -> bytes:
    """The best code lengths of at most `longest`, by package-merge: each time a symbol is taken it is a bit deeper."""
    coins = [(weights[i], (i,)) for i in leaves]
    row = coins
    for _ in range(longest - 1):
        row = sorted([*coins, *((x[0] + y[0], x[1] + y[1]) for x, y in zip(row[::2], row[1::2], strict=False))], key=lambda x: x[0])
    depth = bytearray(len(weights))
    for _, symbols in row[: 2 * len(leaves) - 2]:
        for i in symbols:
            depth[i] += 1
    return bytes(depth)


def huffman_many(weights: np.ndarray, longest: int) -> np.ndarray:
    """As `huffman` for each row of counts, one node of every code at a time."""
    out = np.zeros(weights.shape, np.uint8)
    number = (weights > 0).sum(axis=1)
    lone = number == 1
    out[lone] = weights[lone] > 0
    rows = np.flatnonzero(number > 1)
    if not len(rows):
        return out
    rows = rows[np.argsort(-number[rows], kind="stable")]
    number, none = number[rows], np.int64(1) << 60
    most = int(number[0])
    # leaves by weight; behind them none is left
    own = np.where(weights[rows] > 0, weights[rows], none)
    leaves = np.argsort(own, axis=1, kind="stable")[:, :most]
    w = np.full((len(rows), most + 1), none)
    w[:, :most] = np.take_along_axis(own, leaves, axis=1)
    inner, up = np.full((len(rows), most), none), np.zeros((len(rows), 2 * most), np.int64)
    w_, inner_, up_ = w.reshape(-1), inner.reshape(-1), up.reshape(-1)
    line = np.arange(len(rows))
    a, b = line * (most + 1), line * most
    live = np.searchsorted(-number, -np.arange(most) - 1, "left")  # how many rows have more than so many inner nodes
    for node in range(most - 1):
        g = int(live[node])
        total = np.zeros(g, np.int64)
        a, b, k = a[:g], b[:g], line[:g]
        for _ in range(2):
            x, y = w_[a], inner_[b]
            leaf = x <= y
            total += np.minimum(x, y)
            # of leaf i of row k: 2 * most * k + i; of inner node i: most more
            up_[np.where(leaf, a + k * (most - 1), b + (k + 1) * most)] = node
            a, b = a + leaf, b + ~leaf
        inner_[k * most + node] = total
    deep = np.zeros((len(rows), most), np.int64)
    deep_ = deep.reshape(-1)
    for node in range(most - 3, -1, -1):
        k = line[: int(live[node + 1])]
        deep_[k * most + node] = deep_[k * most + up_[2 * most * k + most + node]] + 1
    depth = np.where(np.arange(most) < number[:, None], np.take_along_axis(deep, up[:, :most], axis=1) + 1, 0)
    over = depth.max(axis=1) > longest
    got = np.zeros((len(rows), weights.shape[1]), np.uint8)
    np.put_along_axis(got, leaves, np.where(over[:, None], 0, depth).astype(np.uint8), axis=1)
    out[rows] = got
    for i in rows[over].tolist():
        out[i] = np.frombuffer(huffman(weights[i].tolist(), longest), np.uint8)
    return out


def _codes_many(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _code_arrays for each row."""
    many, n = lengths.shape
    line = np.arange(many)[:, None]
    count = np.bincount((line * 16 + lengths).reshape(-1), minlength=16 * many).reshape(many, 16)
    begin = np.cumsum(count, axis=1) - count
    first = np.zeros((many, 16), np.int64)
    for k in range(2, 16):
        first[:, k] = first[:, k - 1] + count[:, k - 1] << 1
    order = np.argsort(lengths, axis=1, kind="stable")
    size = np.take_along_axis(lengths, order, axis=1).astype(np.int64)
    code = np.take_along_axis(first - begin, size, axis=1) + np.arange(n)
    out, sizes = np.zeros((many, n), np.uint16), lengths.copy()
    np.put_along_axis(out, order, np.where(size > 0, _reversed(15)[code & 32767] >> 15 - size, 0).astype(np.uint16), axis=1)
    lone = count[:, 0] == n - 1
    out[lone] = sizes[lone] = 0
    return out, sizes


def _pack(value: np.ndarray, bits: np.ndarray, kept: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Tokens of `kept` a stream as bits: the bytes, how many bits each stream has, and the byte where it begins."""
    token0 = np.cumsum(kept) - kept
    total = np.add.reduceat(bits, token0)
    # every stream begins at a new 64-bit word
    words = (total + 63 + 64) >> 6
    base = (np.cumsum(words) - words) * 64
    pos = np.cumsum(bits) - bits
    pos += np.repeat(base - pos[token0], kept)
    word, shift = pos >> 6, (pos & 63).astype(np.uint64)
    low = value << shift
    high = np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    for w, v in ((word, low), (word + 1, high)):
        at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        out[w[at]] |= np.bitwise_or.reduceat(v, at)
    return out.tobytes(), total, base // 8


def written_many(codes: list[bytes]) -> list[tuple[int, int]]:
    """As _written_lengths for each code, runs and bits of all in one."""
    used = [np.flatnonzero(np.frombuffer(c, np.uint8)) for c in codes]
    out = [_written_lengths(c) if len(u) <= 2 and (u < 256).all() else None for c, u in zip(codes, used, strict=True)]
    long = [i for i, x in enumerate(out) if x is None]
    if not long:
        return out
    flat = np.frombuffer(b"".join(codes[i] for i in long), np.uint8).astype(np.int64)
    sizes = np.array([len(codes[i]) for i in long])
    of = np.repeat(np.arange(len(long)), sizes)
    begin = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])]))
    value, length = flat[begin], np.diff(np.append(begin, len(flat)))
    some = value > 0
    most = np.where(some, 6, 138)
    full, rest = (length - some) // most, (length - some) % most
    # a run: its value unless that is 0, then as many full repeats as there are, then a shorter one or the value itself
    code = np.where(rest < 3, value, np.where(some, 16, np.where(rest < 11, 17, 18)))
    symbol = np.stack([value, np.where(some, 16, 18), code], axis=1).reshape(-1)
    extra = np.stack([0 * value, np.where(some, 3, 127), np.where(rest < 3, 0, rest - np.where(code == 18, 11, 3))], axis=1).reshape(-1)
    times = np.stack([some.astype(np.int64), full, np.where(rest < 3, rest, 1)], axis=1).reshape(-1)
    symbol, extra, of = np.repeat(symbol, times), np.repeat(extra, times), np.repeat(np.repeat(of[begin], 3), times)
    lengths = huffman_many(np.bincount(of * 19 + symbol, minlength=19 * len(long)).reshape(-1, 19), 7)
    lengths[(lengths > 0).sum(axis=1) == 1, 17] = 1
    codes_, sizes_ = _codes_many(lengths)
    n = sizes_[of, symbol].astype(np.int64)
    bits = n + np.array([0] * 16 + [2, 3, 7])[symbol]
    data, total, at = _pack(codes_[of, symbol].astype(np.uint64) | extra.astype(np.uint64) << n.astype(np.uint64), bits, np.bincount(of))
    heads = 30 + (lengths[:, LENGTH_ORDER].astype(np.int64) << 5 + 3 * np.arange(19)).sum(axis=1)
    for i, h, t, b in zip(long, heads.tolist(), total.tolist(), at.tolist(), strict=True):
        out[i] = h | int.from_bytes(data[b : b + (t + 7 >> 3)], "little") << 63, 63 + t
    return out


def codes_of(lengths: bytes) -> list[tuple[int, int]]:
    """(code as it is written, length) of each symbol; a lone symbol takes no bits."""
    codes, sizes = _code_arrays(lengths)
    return list(zip(codes.tolist(), sizes.tolist(), strict=True))


class BitWriter:
    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def write_lengths(w: BitWriter, lengths: bytes) -> None:
    """One prefix code: short forms for one or two symbols, else run-length coded lengths."""
    w.put(*_written_lengths(lengths))


@lru_cache(maxsize=64)
def _written_lengths(lengths: bytes) -> tuple[int, int]:
    w = BitWriter()
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        w.put(1, 1)
        w.put(len(used) == 2, 1)
        w.put(1, 1)
        for s in used or [0]:
            w.put(s, 8)
        return w.value, w.n
    runs: list[tuple[int, int, int]] = []
    for value, group in groupby(lengths):
        n = len(list(group))
        if value:
            runs.append((value, 0, 0))
            n -= 1
        while n >= 3:
            code, least, most, extra = (16, 3, 6, 2) if value else (18, 11, 138, 7) if n >= 11 else (17, 3, 10, 3)
            k = min(n, most)
            runs.append((code, k - least, extra))
            n -= k
        runs += [(value, 0, 0)] * n
    weights = [0] * 19
    for s, _, _ in runs:
        weights[s] += 1
    of = huffman(weights, 7)
    if sum(map(bool, of)) == 1:
        of = bytes(1 if n else int(s == 17) for s, n in enumerate(of))
    w.put(0, 1)
    w.put(15, 4)
    for s in LENGTH_ORDER:
        w.put(of[s], 3)
    w.put(0, 1)
    codes = codes_of(of)
    for s, value, extra in runs:
        code, n = codes[s]
        w.value |= (code | value << n) << w.n
        w.n += n + extra
    return w.value, w.n


def prefix_symbol(value: int) -> tuple[int, int, int]:
    """(symbol, extra value, extra bits) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def _write_codes(w: BitWriter, cache: int, written: list[tuple[int, int]], alpha: int) -> None:
    """The head of a picture's pixels: cache, no meta codes, prefix codes. Distances are code 2, the pixel to the left."""
    if cache:
        w.put(1 | cache << 1, 5)
    else:
        w.put(0, 1)
    w.put(0, 1)
    for x in (*written, *_lone(alpha)):
        w.put(*x)


@lru_cache(maxsize=2)
def _lone(alpha: int) -> tuple[tuple[int, int], tuple[int, int]]:
    lone = lambda n, i: bytes(int(k == i) for k in range(n))
    return _written_lengths(lone(256, alpha)), _written_lengths(lone(40, 1))


def _code_arrays(lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes as they are written, and their lengths; a lone symbol takes no bits."""
    n = np.frombuffer(lengths, np.uint8).astype(np.int64)
    out = np.zeros(len(n), np.uint64)
    used = np.flatnonzero(n)
    if len(used) == 1:
        return out, np.zeros(len(n), np.uint64)
    order = used[np.argsort(n[used], kind="stable")]
    bits = int(n.max())
    spans = 1 << (bits - n[order])
    top = np.cumsum(spans) - spans
    out[order] = _reversed(bits)[top]
    return out, n.astype(np.uint64)


@lru_cache(maxsize=1)
def _prior() -> tuple[int, int, bytes, bytes]:
    """The fixed set of codes, for text: (head bits, their number, lengths of green, and of red and blue)."""
    common = b" etaonrishdlucmpgfbvyw.,\nkqxjz"
    weights = [1e-5 + 1e-3 * (32 <= b < 127) + 2e-3 * (128 <= b < 192) + 5e-3 * (b in (195, 194, 255)) for b in range(256)]
    for i, b in enumerate(common):
        weights[b] += 1 / (i + 6)
    literal = huffman(weights, 13)
    green = huffman([*weights, *[2e-4] * 24], 13)
    w = BitWriter()
    w.put(0, 1)  # no transforms
    _write_codes(w, 0, [_written_lengths(x) for x in (green, literal, literal)], 255)
    return w.value, w.n, green, literal


@lru_cache(maxsize=1)
def _run_symbols() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number by the length of a run."""
    got = [(0, 0, 0)] + [prefix_symbol(n) for n in range(1, 4097)]
    return tuple(np.array(x, np.int64) for x in zip(*got, strict=True))


class _Pictures:
    """Pixels (green, red, blue) of pictures one after the other, with what each form of them would take."""

    def __init__(self, px: np.ndarray, sizes: np.ndarray):
        self.px, self.sizes, self.n = px, sizes, len(sizes)
        self.first = np.cumsum(sizes) - sizes
        self.of = np.repeat(np.arange(self.n), sizes)
        self.argb = px[:, 0].astype(np.uint32) << np.uint32(8) | px[:, 1].astype(np.uint32) << np.uint32(16) | px[:, 2]
        same = np.zeros(len(px), bool)
        same[1:] = self.argb[1:] == self.argb[:-1]
        same[self.first] = False
        # a run after its first pixel, cut at 4096: its length at its beginning, -1 behind
        edge = np.flatnonzero(same & ~np.concatenate([[False], same[:-1]]))
        stop = np.flatnonzero(same & ~np.concatenate([same[1:], [False]])) + 1
        self.run = np.zeros(len(px), np.int64)
        for a, b in zip(edge[stop - edge >= 3].tolist(), stop[stop - edge >= 3].tolist(), strict=True):
            self.run[a:b] = -1
            for k in range(a, b, 4096):
                self.run[k] = min(4096, b - k)

    def counts(self, values: np.ndarray, where: np.ndarray, bins: int) -> np.ndarray:
        return np.bincount(self.of[where] * bins + values[where], minlength=self.n * bins).reshape(self.n, bins)

    def hits(self, bits: np.ndarray, alpha: int) -> tuple[np.ndarray, np.ndarray]:
        """Which pixels the colour cache holds when they come, and their place in it; bits are of each picture."""
        v = self.argb.astype(np.uint64) | np.uint64(alpha << 24)
        place = ((v * np.uint64(_SPREAD) & np.uint64(0xFFFFFFFF)) >> (np.uint64(32) - bits.astype(np.uint64)[self.of])).astype(np.int64)
        order = np.argsort(self.of << 11 | place, kind="stable")
        key, value = (self.of << 11 | place)[order], self.argb[order]
        held = np.zeros(len(v), bool)
        held[order[1:]] = (key[1:] == key[:-1]) & (value[1:] == value[:-1])
        return held & (bits > 0)[self.of], place


def _information(counts: np.ndarray) -> np.ndarray:
    """Bits of so many symbols by a code of their own, with what the code itself takes."""
    total = counts.sum(axis=1)
    log = lambda x: x * np.log2(np.maximum(x, 1))
    return log(total) - log(counts).sum(axis=1) + 4.5 * (counts > 0).sum(axis=1) + 40


def _forms(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each picture the form that is estimated to be the least, and the bits of its colour cache.

    Forms: 0 fixed codes, 1 own codes, 2 own codes and cache, 3 subtract-green, 4 and 5 predictors left and top, 6 palette.
    """
    plain = _Pictures(raw, sizes)
    literal = plain.run == 0
    every = [plain.counts(plain.px[:, c], literal, 256) for c in range(3)]
    _, head, green, other = _prior()
    fixed = sum((n @ np.frombuffer(x, np.uint8)[:256].astype(np.int64) for n, x in zip(every, (green, other, other), strict=True)), np.zeros(plain.n)) + head
    size = [fixed, sum(map(_information, every))]
    bits = np.clip(np.frexp(sizes)[1] - 4, 2, 10)
    held, place = plain.hits(bits, 255)
    rest = literal & ~held
    found = plain.counts(place, literal & held, 1 << 11)
    size.append(sum(_information(plain.counts(plain.px[:, c], rest, 256)) for c in (1, 2)) + _information(np.hstack([plain.counts(plain.px[:, 0], rest, 256), found])))
    for t in (3, 4, 5):
        p = _Pictures(_transformed(raw, plain, t), sizes)
        size.append(sum(_information(p.counts(p.px[:, c], p.run == 0, 256)) for c in range(3)) + 60)
    # colours are counted where no channel has too many values for a palette
    few = np.flatnonzero(np.max([(n > 0).sum(axis=1) for n in every], axis=0) <= 16)
    colours = np.full(plain.n, 17)
    for i in few.tolist():
        colours[i] = len(np.unique(plain.argb[plain.first[i] : plain.first[i] + sizes[i]]))
    # several indices to a pixel, at most a byte of information each, and the colours themselves
    pack = np.select([colours <= 2, colours <= 4, colours <= 16], [8, 4, 2], 0)
    size.append(np.where(pack > 0, sizes / np.maximum(pack, 1) * 4 + 30 * colours + 300, np.inf))
    form = np.argmin(np.array(size), axis=0)
    return form, np.where(form == 2, bits, 0)


def _transformed(raw: np.ndarray, p: _Pictures, form: int) -> np.ndarray:
    """All pixels less what a transform says: 3 subtract-green, 4 left, 5 top."""
    if form == 3:
        return raw - np.concatenate([np.zeros_like(raw[:, :1]), raw[:, :1], raw[:, :1]], axis=1)
    left, top = (np.concatenate([np.zeros_like(raw[:n]), raw])[: len(raw)] for n in (1, WIDTH))
    place = np.arange(len(raw)) - p.first[p.of]
    no_left, no_top = (place % WIDTH == 0)[:, None], (place < WIDTH)[:, None]
    said = np.where(no_left, top, left) if form == 4 else np.where(no_top, left, top)
    return raw - np.where((place == 0)[:, None], 0, said).astype(np.uint8)


def _palette(px: np.ndarray) -> tuple[list[int], np.ndarray, int]:
    """(colours, packed indices, bits of the packing) of one picture."""
    argb = px[:, 0].astype(np.int64) << 8 | px[:, 1].astype(np.int64) << 16 | px[:, 2]
    colours, index = np.unique(argb, return_inverse=True)
    pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
    parts = index.reshape(-1, WIDTH >> pack, 1 << pack) << (np.arange(1 << pack) * (8 >> pack))
    return colours.tolist(), parts.sum(axis=2).ravel().astype(np.uint8), pack


def _write_pixel_row(w: BitWriter, values: list[int]) -> None:
    """A small picture within a stream, one ARGB value after the other, by codes of its own."""
    channels = [[v >> k & 255 for v in values] for k in (8, 16, 0, 24)]
    codes = []
    w.put(0, 1)
    for n, c in zip((280, 256, 256, 256), channels, strict=True):
        counts = [0] * n
        for x in c:
            counts[x] += 1
        lengths = huffman(counts, 15)
        write_lengths(w, lengths)
        codes.append(codes_of(lengths))
    write_lengths(w, bytes([1] + [0] * 39))
    for row in zip(*channels, strict=True):
        for code, x in zip(codes, row, strict=True):
            w.put(*code[x])


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """Lossless streams of RGB samples, 192 pixels a row."""
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 3)[:, [1, 0, 2]]
    sizes = np.array([len(p) // 3 for p in payloads])
    form, cache = _forms(raw, sizes)
    plain = _Pictures(raw, sizes)
    px, coded, starts = raw, sizes, {}
    for t in (3, 4, 5):
        if (form == t).any():
            px = np.where((form == t)[plain.of][:, None], _transformed(raw, plain, t), px)
    # palettes make pictures narrower
    if (form == 6).any():
        parts, coded = [], sizes.copy()
        for i in range(len(payloads)):
            own = px[plain.first[i] : plain.first[i] + sizes[i]]
            if form[i] == 6:
                colours, index, _ = _palette(own)
                starts[i] = colours
                own = np.stack([index, np.zeros_like(index), np.zeros_like(index)], axis=1)
                coded[i] = len(own)
            parts.append(own)
        px = np.concatenate(parts)
    p = _Pictures(px, coded)
    held, place = p.hits(cache, 255)
    held &= p.run == 0
    literal = (p.run == 0) & ~held
    symbol, extra, extra_bits = _run_symbols()
    runs = np.where(p.run > 0, p.run, 0)
    # the symbol of each token in the first code: a literal's green, a run's length, a place in the cache
    first_symbol = np.where(held, 280 + place, np.where(p.run > 0, 256 + symbol[runs], p.px[:, 0]))
    token = p.run >= 0
    # prefix codes: the fixed ones, and those of each picture that has its own
    head, head_bits, green, other = _prior()
    which, heads = np.zeros(p.n, np.int64), [(head, head_bits)] * p.n
    wide = 280 + (1 << int(cache.max()) if cache.any() else 0)
    tables = [[tuple(np.pad(x, (0, n - len(x)))[None] for x in _code_arrays(fixed))] for fixed, n in ((green, wide), (other, 256), (other, 256))]
    every = np.flatnonzero(form > 0)
    end = np.cumsum(coded)
    for k in range(0, len(every), CODES):
        some = every[k : k + CODES]
        part = np.concatenate([np.arange(end[i] - coded[i], end[i]) for i in some.tolist()])
        line = np.repeat(np.arange(len(some)), coded[some])
        counts = lambda values, where, bins: np.bincount(line[where] * bins + values[part][where], minlength=len(some) * bins).reshape(-1, bins)  # noqa: B023, E731
        own = [huffman_many(counts(first_symbol, token[part], wide), 15)]
        for c in (1, 2):
            n = counts(p.px[:, c], literal[part], 256)
            n[n.sum(axis=1) == 0, 0] = 1
            own.append(huffman_many(n, 15))
        for t, lengths in zip(tables, own, strict=True):
            t.append(_codes_many(lengths))
        greens = [x[: 280 + (1 << c if c else 0)] for x, c in zip(own[0], cache[some].tolist(), strict=True)]
        written = written_many([x.tobytes() for of in (greens, own[1], own[2]) for x in of])
        for j, i in enumerate(some.tolist()):
            w = BitWriter()
            alpha = 255
            if form[i] == 3:
                w.put(1 | 2 << 1, 3)
            elif form[i] in (4, 5):
                w.put(1 | 0 << 1 | 7 << 3, 6)
                _write_pixel_row(w, [(int(form[i]) - 3) << 8])
                alpha = 0  # as predicted
            elif form[i] == 6:
                w.put(1 | 3 << 1, 3)
                w.put(len(starts[i]) - 1, 8)
                full = [0, *[c | 0xFF000000 for c in starts[i]]]
                less = lambda a, b: sum(((a >> k) - (b >> k) & 255) << k for k in (0, 8, 16, 24))
                _write_pixel_row(w, [less(b, a) for a, b in zip(full, full[1:], strict=False)])
            w.put(0, 1)
            _write_codes(w, int(cache[i]), written[j :: len(some)], alpha)
            which[i], heads[i] = 1 + k + j, (w.value, w.n)
    codes, code_bits = ([np.concatenate([x[k].astype(kind) for x in t]) for t in tables] for k, kind in ((0, np.uint16), (1, np.uint8)))
    of = which[p.of]
    code = lambda c, v: (codes[c][of, v].astype(np.uint64), code_bits[c][of, v].astype(np.uint64))
    (value, bits), (rv, rn), (bv, bn) = code(0, first_symbol), code(1, p.px[:, 1]), code(2, p.px[:, 2])
    zero = np.uint64(0)
    more = np.where(literal, rv | bv << rn, np.where(p.run > 0, extra[runs].astype(np.uint64), zero))
    more_bits = np.where(literal, rn + bn, np.where(p.run > 0, extra_bits[runs].astype(np.uint64), zero))
    value, bits = (value | more << bits)[token], (bits + more_bits)[token].astype(np.int64)
    kept = np.add.reduceat(token.astype(np.int64), p.first)
    data, total, at = _pack(value, bits, kept)
    result = []
    for payload, t, a, (value_, n) in zip(payloads, total.tolist(), at.tolist(), heads, strict=True):
        height = len(payload) // UNIT
        start = value_ << 40 | 0x2F | (WIDTH - 1) << 8 | (height - 1) << 22
        # the head rarely ends at a whole byte: shift the body behind it
        body = int.from_bytes(data[a : a + (t + 7 >> 3)], "little")
        result.append((start | body << (40 + n)).to_bytes(40 + n + t + 7 >> 3, "little"))
    return result


def riff(stream: bytes) -> bytes:
    pad = len(stream) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + pad) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + bytes(pad)


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8")
    return data + b"\xff" * ((-len(data)) % UNIT if data else UNIT), len(data)


def write_files(payloads: list[bytes]) -> list[bytes]:
    """Each payload as WebP files, one after the other."""
    cut = [[p[i : i + UNIT * ROWS] for i in range(0, len(p), UNIT * ROWS)] for p in payloads]
    streams = iter(encode_many([x for c in cut for x in c])) if cut else iter(())
    return [b"".join(riff(next(streams)) for _ in c) for c in cut]


def read_files(media: list[bytes]) -> list[list[np.ndarray]]:
    """The pixel arrays of each run of WebP files."""
    streams, counts = [], []
    for m in media:
        at = n = 0
        while at < len(m):
            s, at = chunk(m, at)
            streams.append(s)
            n += 1
        counts.append(n)
    px = iter(decode_many(streams))
    return [[next(px) for _ in range(n)] for n in counts]


def samples(pictures: list[np.ndarray]) -> bytes:
    """The RGB samples of pictures, in order."""
    return b"".join(np.ascontiguousarray(p[:, :, 2::-1]).tobytes() for p in pictures)


def feature(data: bytes) -> str:
    """Means of the three channels in thousandths, and a 64-bit difference hash of 8 rows of 9 equal parts."""
    x = np.frombuffer(data, np.uint8)
    means = (x.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // (len(x) // 3)).tolist()
    parts = np.add.reduceat(x, np.arange(72) * (len(x) // 72), dtype=np.int64)[:72].reshape(8, 9)
    bits = np.packbits(parts[:, 1:] > parts[:, :-1]).tobytes().hex()
    return f"{means[0]}:{means[1]}:{means[2]}:{bits}"


def store(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as WebP files."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        p = [payload_of(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_bytes": [n for _, n in p], "media": write_files([x for x, _ in p])}

    return map_arrow(need(df, "doc_id", "text"), run, "doc_id long, n_bytes long, media binary", 4096)


def describe(stored: DataFrame) -> DataFrame:
    """Reads the files of `store` back and computes digests and features from their pixels."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        media = cols["media"]
        back = [samples(p) for p in read_files(media)]
        return {
            "doc_id": cols["doc_id"],
            "n_bytes": cols["n_bytes"],
            "payload_bytes": [len(d) for d in back],
            "payload_sha256": [hashlib.sha256(d).hexdigest() for d in back],
            "tail_crc32": [zlib.crc32(d[-32:]) for d in back],
            "media_bytes": [len(m) for m in media],
            "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
            "feature": [feature(d) for d in back],
        }

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    # steps are shared by all pictures of a batch
    return map_arrow(need(stored, "doc_id", "n_bytes", "media"), run, schema, 8192, 8_000_000)
