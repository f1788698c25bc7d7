"""Array functions over pixels and bytes (X9, X11-X17), and their Arrow-batched column forms."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dtw_distance(a: list[int], b: list[int]) -> float:
    """Dynamic time warping over Hamming distances in a band of max((n + m) / 7, 2); 64 where unreachable."""
    n, m = len(a), len(b)
    if not n or not m:
        return 64.0
    band = max((n + m) // 7, 2)
    cost = np.bitwise_count(np.array(a, np.int64)[:, None].view(np.uint64) ^ np.array(b, np.int64)[None, :].view(np.uint64)).astype(float)
    best = np.full((n + 1, m + 1), np.inf)
    best[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            best[i, j] = cost[i - 1, j - 1] + min(best[i - 1, j - 1], best[i - 1, j], best[i, j - 1])
    return float(best[n, m] / max(n, m)) if np.isfinite(best[n, m]) else 64.0


def mean_hash(pixels: np.ndarray) -> int:
    """Bit i where pixel i of 64 is at least the integer mean (X11)."""
    p = np.asarray(pixels, np.int64).ravel()
    return int(sum(1 << i for i, v in enumerate(p >= p.sum() // len(p)) if v))


def dark_border(gray: np.ndarray, level: int = 16) -> tuple[int, int, int, int]:
    """Dark columns and rows (left, right, top, bottom); none for a picture that is all dark."""
    g = np.asarray(gray, np.int64)
    columns, rows = g.sum(axis=0) // g.shape[0] > level, g.sum(axis=1) // g.shape[1] > level
    if not columns.any() or not rows.any():
        return 0, 0, 0, 0
    return int(columns.argmax()), int(columns[::-1].argmax()), int(rows.argmax()), int(rows[::-1].argmax())


def block_means(gray: np.ndarray, border: tuple[int, int, int, int] = (0, 0, 0, 0), size: int = 8) -> np.ndarray:
    """The picture without its border as size x size integer means."""
    left, right, top, bottom = border
    g = np.asarray(gray, np.int64)
    g = g[top : g.shape[0] - bottom, left : g.shape[1] - right]
    h, w = g.shape
    if not h or not w:
        return np.zeros((size, size), np.int64)
    y = [(i * h // size, max((i + 1) * h // size, i * h // size + 1)) for i in range(size)]
    x = [(i * w // size, max((i + 1) * w // size, i * w // size + 1)) for i in range(size)]
    return np.array([[g[a:b, c:d].sum() // ((min(b, h) - a) * (min(d, w) - c)) for c, d in x] for a, b in y])


def frame_times(duration: float, n: int) -> list[float]:
    """Where frames are taken: the middle 80 % of the video in n equal parts."""
    return [duration * (0.1 + 0.8 * (i + 0.5) / n) for i in range(n)]


def frame_hashes(frames: list[np.ndarray | None]) -> list[int] | None:
    """Mean hashes of all frames, cropped to their common border; None if any frame failed."""
    if not frames or any(f is None for f in frames):
        return None
    border = tuple(min(b) for b in zip(*(dark_border(f) for f in frames), strict=True))
    return [mean_hash(block_means(f, border)) for f in frames]


def gradient_hash(gray: np.ndarray, size: int) -> bytes:
    """size * size bits: whether brightness falls from each block to its right neighbour."""
    g = np.asarray(gray, float)
    h, w = g.shape
    y = np.minimum(np.arange(size + 1) * h // size, h)
    x = np.minimum(np.arange(size + 2) * w // (size + 1), w)
    total = np.pad(g.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    y0, y1 = y[:-1], np.maximum(y[1:], y[:-1] + 1).clip(max=h)
    x0, x1 = x[:-1], np.maximum(x[1:], x[:-1] + 1).clip(max=w)
    y0, x0 = np.minimum(y0, h - 1), np.minimum(x0, w - 1)
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    means = (total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]) / area
    return np.packbits(means[:, 1:] < means[:, :-1] - 1e-9, bitorder="little").tobytes()


def image_hashes(gray: np.ndarray, coarse: int = 4, fine: int = 8) -> tuple[bytes, bytes]:
    return gradient_hash(gray, coarse), gradient_hash(gray, fine)


def exif_thumbnail(data: bytes) -> bytes | None:
    """The JPEG inside a JPEG's EXIF block, if there is one."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            block = data[at + 4 : at + 2 + size]
            a, b = block.find(b"\xff\xd8", 6), block.rfind(b"\xff\xd9")
            return block[a : b + 2] if 0 <= a < b else None
        if kind == 0xDA:
            break
        at += 2 + size
    return None


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from a PNG's or JPEG's header; None for all else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        if kind in (0x01, *range(0xD0, 0xDA)):
            at += 2
            continue
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def image_dimensions(content: pd.Series) -> pd.DataFrame:
    found = [image_size(bytes(c)) if c is not None else None for c in content]
    return pd.DataFrame({"width": pd.array([f and f[0] for f in found], "Int32"), "height": pd.array([f and f[1] for f in found], "Int32")})


def _gray(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    return px[:, :, 0] if channels == 1 else 0.114 * px[:, :, 0] + 0.587 * px[:, :, 1] + 0.299 * px[:, :, 2]


@F.pandas_udf(T.StructType([T.StructField("coarse", T.BinaryType()), T.StructField("fine", T.BinaryType())]))
def decoded_hashes(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Hashes of pictures as the image source decodes them (blue, green, red)."""
    out = [image_hashes(_gray(h, w, c, bytes(d))) for h, w, c, d in zip(height, width, channels, data, strict=True)]
    return pd.DataFrame({"coarse": [c for c, _ in out], "fine": [f for _, f in out]})
