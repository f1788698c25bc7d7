"""All pairs of rows with like keys, compared block by block.

Where no equi-join can tell which rows are near - wide Hamming thresholds, sequences, fingerprints - every pair of a key's
rows has to be looked at. A key's rows are dealt by a hash of their id to blocks; each pair of blocks is one row of an
equi-join on the block's number, compared as numpy arrays, tile by tile of about `size` rows. A row is shuffled as often
as its key has blocks, so these grow with the key's rows, from `size` to LARGE rows or WORDS words. So no task holds more
than two blocks at a time, a frequent key is spread over as many tasks as it has pairs of blocks, no pair of rows is
shuffled, and a pair costs nanoseconds.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType, _parse_datatype_string

from twinlake.session import ship

#: Indices of the pairs that are near, left and right, and their distances.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]
#: For all rows of two blocks, or of a block and itself (then each pair once), in parts.
Compare = Callable[[pa.StructArray, pa.StructArray, bool, int], Iterator[Found]]
SIZE = 512
#: Blocks that a key has before they get larger than a tile, and the most rows and words of one.
MANY, LARGE, WORDS = 16, 1 << 16, 1 << 21


def _blocks(rows: DataFrame, id_: str, cols: list[str], size: int) -> tuple[DataFrame, DataFrame]:
    """(k, i, rows): blocks of each key; (k, n): how many it has."""
    lists = [f.name for f in rows.schema if f.name in cols and isinstance(f.dataType, ArrayType)]
    words = " + ".join(f"coalesce(sum(greatest(size({c}), 0)), 0) div {WORDS}" for c in lists) or "0"
    counts = rows.groupBy("k").agg(F.expr(f"cast(least(count(*) div {size} + 1, greatest({MANY}, count(*) div {LARGE} + 1, {words} + 1)) as int)").alias("n"))
    placed = rows.join(counts, "k").select("k", F.pmod(F.xxhash64(id_), F.col("n")).cast("int").alias("i"), F.struct(F.col(id_).alias("id"), *cols).alias("row"))
    return placed.groupBy("k", "i").agg(F.collect_list("row").alias("rows")), counts


def near_pairs(
    rows: DataFrame, compare: Compare, cols: list[str], distance: str, id_: str = "id", key: Column | None = None, steps: tuple[int, ...] = (0,), right: DataFrame | None = None, size: int = SIZE, forest: bool = False
) -> DataFrame:
    """(a, b, distance), a < b, of the pairs that `compare` finds near among rows with equal keys.

    With `steps` keys are whole numbers, and rows meet whose keys differ by one of them. With `right`, every row meets
    every row of it instead. Rows without a key meet none; a row never meets one of its own id. With `forest`, for those who
    want to know only what is connected, two blocks give no more pairs than connect what their near pairs do.
    """
    spark = rows.sparkSession
    ship(spark)
    # one key for all, which the optimizer must not take for a constant: the joins on it would become products
    one = F.pmod(F.xxhash64(id_), F.lit(1))
    with_key = lambda df: df.withColumn("k", one if key is None else key).where("k is not null").select("k", id_, *cols)
    left_blocks, counts = _blocks(with_key(rows), id_, cols, size)
    right_blocks, right_counts = (left_blocks, counts) if right is None else _blocks(with_key(right), id_, cols, size)
    lookers = None
    for d in steps:
        first = F.col("i") if d == 0 and right is None else F.lit(0)
        of = right_counts.select((F.col("k") - d if d else F.col("k")).alias("k"), "n")
        part = left_blocks.join(of, "k").select((F.col("k") + d if d else F.col("k")).alias("k"), "i", F.col("rows").alias("left"), F.lit(d == 0 and right is None).alias("own"), F.explode(F.sequence(first, F.col("n") - 1)).alias("j"))
        lookers = part if lookers is None else lookers.unionByName(part)
    met = lookers.join(right_blocks.select("k", F.col("i").alias("j"), F.col("rows").alias("right")), ["k", "j"])
    met = met.select("left", "right", (F.col("own") & (F.col("i") == F.col("j"))).alias("same"))
    kind = rows.select(id_).schema[0].dataType
    out = StructType([StructField("x", kind), StructField("y", kind), StructField("distance", _parse_datatype_string(distance))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right_, same = b.column("left"), b.column("right"), b.column("same")
            for r in range(b.num_rows):
                x = left[r].values
                # a block and itself: both sides in one order, whatever order the shuffles brought their rows in
                y = x if same[r].as_py() else right_[r].values
                held: list[Found] = []
                roots = np.arange(len(x) + (0 if y is x else len(y)))
                for found in compare(x, y, y is x, size):
                    held.append(_joining(roots, *found, 0 if y is x else len(x)) if forest else found)
                    if sum(len(f[0]) for f in held) >= cut:
                        yield from batches_of(x, y, held)
                        held = []
                yield from batches_of(x, y, held)

    cut = 1 << 16

    def batches_of(x: pa.StructArray, y: pa.StructArray, held: list[Found]) -> Iterator[pa.RecordBatch]:
        i, j, d = (np.concatenate(z) for z in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
        for at in range(0, len(i), cut):
            yield pa.RecordBatch.from_arrays(
                [x.field("id").take(pa.array(i[at : at + cut])), y.field("id").take(pa.array(j[at : at + cut])), pa.array(d[at : at + cut], types[2])], names=["x", "y", "distance"]
            )

    from pyspark.sql.pandas.types import to_arrow_schema

    types = [f.type for f in to_arrow_schema(out)]
    found = met.mapInArrow(run, out)
    return found.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def _joining(roots: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray, start: int) -> Found:
    """Of these pairs those that join what wasn't connected; roots, one to a row of both blocks, are kept up to date."""
    a, b = roots[i], roots[j + start]
    apart = np.flatnonzero(a != b)
    up: dict[int, int] = {}
    kept = []
    for at, u, v in zip(apart.tolist(), a[apart].tolist(), b[apart].tolist(), strict=True):
        while u in up:
            u = up[u]
        while v in up:
            v = up[v]
        if u != v:
            up[max(u, v)] = min(u, v)
            kept.append(at)
    if kept:
        to = np.arange(len(roots))
        to[list(up)] = list(up.values())
        while (to[to] != to).any():
            to = to[to]
        roots[:] = to[roots]
    only = np.array(kept, np.int64)
    return i[only], j[only], d[only]


def _numbers(rows: pa.StructArray, name: str) -> np.ndarray:
    return rows.field(name).to_numpy(zero_copy_only=False)


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.astype(np.int64).view(np.uint64) ^ b.astype(np.int64).view(np.uint64))


def _within(a: np.ndarray, b: np.ndarray, tolerance: float) -> np.ndarray:
    """|a - b| / max(a, b) within the tolerance; true where the larger isn't positive, or one is unknown."""
    most = np.maximum(a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.isnan(most) | (most <= 0) | (np.abs(a - b) / most <= tolerance)


def _tiles(n: int, m: int, same: bool, size: int) -> Iterator[tuple[slice, slice]]:
    for q in range(0, m, size):
        for p in range(0, min(n, q + 1) if same else n, size):
            yield slice(p, p + size), slice(q, q + size)


def pictures(threshold: int, tolerance: float | None = None, coarse_max: int | None = None) -> Compare:
    """Fine hashes within the threshold; coarse ones and aspects too, where asked for."""

    def compare(x: pa.StructArray, y: pa.StructArray, same: bool, size: int) -> Iterator[Found]:
        read = lambda rows: [_numbers(rows, c) if on else None for c, on in (("fine", True), ("coarse", coarse_max is not None), ("aspect", tolerance is not None))]
        a, b = read(x), read(y)
        for p, q in _tiles(len(x), len(y), same, size):
            d = _bits(a[0][p, None], b[0][None, q])
            i, j = np.nonzero(d <= threshold)
            keep = i < j if same and p == q else np.ones(len(i), bool)
            d, i, j = d[i, j].astype(np.int32), i + p.start, j + q.start
            if coarse_max is not None:
                keep &= _bits(a[1][i], b[1][j]) <= coarse_max
            if tolerance is not None:
                keep &= _within(a[2].astype(float)[i], b[2].astype(float)[j], tolerance)
            yield i[keep], j[keep], d[keep]

    return compare


class _Tile:
    """Some rows of a block, alike in duration and length: their words as columns, w by row, filled up with 0."""

    def __init__(self, at: np.ndarray, duration: np.ndarray, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray, alike: np.ndarray | None):
        self.at, self.duration, self.sizes = at, duration[at], sizes[at]
        self.near, self.far, self.least, self.most = self.duration.min(), self.duration.max(), int(self.sizes.min()), int(self.sizes.max())
        row = np.repeat(np.arange(len(at)), self.sizes)
        w = np.arange(len(row)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.words = np.zeros((self.most, len(at)), flat.dtype)
        self.words[w, row] = flat[np.repeat(starts[at], self.sizes) + w]
        self.alike = alike
        self._tables: dict[int, np.ndarray] = {}

    def table(self, w: int) -> np.ndarray:
        """Bits in which each word that occurs differs from this tile's w-th words."""
        found = self._tables.get(w)
        if found is None:
            found = self.alike[:, self.words[w]]
            if w < 64:
                self._tables[w] = found
        return found

    def part(self, rows: np.ndarray) -> _Tile:
        """Only those rows' words."""
        if len(rows) == len(self.at):
            return self
        out = copy.copy(self)
        out.at, out.words, out._tables = self.at[rows], self.words[:, rows], {}
        return out


def _words(rows: pa.StructArray, name: str, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words = rows.field(name)
    offsets = words.offsets.to_numpy()
    return _numbers(rows, "duration").astype(float), np.diff(offsets), offsets[:-1] - offsets[0], words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).astype(kind)


def _cut(x: pa.StructArray, y: pa.StructArray, same: bool, name: str, kind, size: int) -> tuple[list[_Tile], list[_Tile]]:
    """Both blocks as tiles. Where few words occur, they stand by their number, and `alike` has the bits between any two."""
    sides = [_words(x, name, kind)] + ([] if same else [_words(y, name, kind)])
    known, alike = np.unique(np.concatenate([np.unique(s[3]) for s in sides])), None
    if len(known) <= 256:
        alike = np.bitwise_count(known[:, None] ^ known[None, :])
        sides = [(*s[:3], np.searchsorted(known, s[3]).astype(np.uint8)) for s in sides]
    out = []
    for duration, sizes, starts, flat in sides:
        order = np.lexsort((sizes, duration))
        out.append([_Tile(order[p : p + size], duration, sizes, starts, flat, alike) for p in range(0, len(order), size)])
    return out[0], out[-1]


def _apart(a: _Tile, b: _Tile, tolerance: float) -> bool:
    """No duration of the one is within the tolerance of one of the other."""
    low, high = (a.far, b.near) if b.near > a.far else (b.far, a.near)
    return bool(0 < high and low < high and (high - low) / high > tolerance + 1e-9)


def _meet(x: pa.StructArray, y: pa.StructArray, same: bool, name: str, kind, size: int, tolerance: float, near: Callable[[_Tile, _Tile], Found]) -> Iterator[Found]:
    left, right = _cut(x, y, same, name, kind, size)
    for q, b in enumerate(right):
        for p, a in enumerate(left[: q + 1] if same else left):
            if _apart(a, b, tolerance):
                continue
            i, j, d = near(a, b)
            keep = _within(a.duration[i], b.duration[j], tolerance)
            if same and p == q:
                keep &= i < j
            if keep.any():
                yield a.at[i[keep]], b.at[j[keep]], d[keep]
        b._tables.clear()


def _differ(a: _Tile, b: _Tile, w: int, v: int, out: np.ndarray) -> None:
    """Differing bits of the w-th word of each row of a and the v-th of each row of b."""
    if a.alike is not None:
        np.take(b.table(v), a.words[w], axis=0, out=out, mode="clip")
    else:
        np.bitwise_count(a.words[w][:, None] ^ b.words[v][None, :], out=out)


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a table in which little is true: eight at a time."""
    flat = mask.ravel()
    eights = flat[: len(flat) // 8 * 8]
    at = (np.flatnonzero(eights.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([at[flat[at]], len(eights) + np.flatnonzero(flat[len(eights) :])])
    return np.divmod(at, mask.shape[1])


def _kind(most: int):
    return next(k for k in (np.uint8, np.uint16, np.uint32) if most <= np.iinfo(k).max)


def sequences(name: str, threshold: float, tolerance: float, kind, bits: float, otherwise: float) -> Compare:
    """Share or mean of differing bits over the common length within the threshold, durations within the tolerance.

    All pairs of two tiles are summed up over the words that all their rows have, in the least type that holds what is
    near; only those still near are then summed up exactly.
    """
    wide = 8 * np.dtype(kind).itemsize

    def near(a: _Tile, b: _Tile) -> Found:
        most = int(threshold * bits * min(a.most, b.most) * (1 + 1e-9) + 1e-6)
        shared = min(a.least, b.least)
        total = np.zeros((len(a.at), len(b.at)), _kind(most + 1 + wide))
        # as a table: numpy takes ten times as long for the least of a table and one number
        one, top, bound, room = np.empty(total.shape, np.uint8), np.full_like(total, most + 1), 0, int(np.iinfo(total.dtype).max)
        for w in range(shared):
            if bound + wide > room:
                np.minimum(total, top, out=total)
                bound = most + 1
                if total.min() > most:
                    break
            _differ(a, b, w, w, one)
            np.add(total, one, out=total)
            bound += wide
        i, j = _where(total <= most) if shared else map(np.ravel, np.indices(total.shape))
        n, exact = np.minimum(a.sizes[i], b.sizes[j]), np.zeros(len(i), np.int64)
        for w in range(int(n.max(initial=0))):
            u, v = a.words[w][i], b.words[w][j]
            exact += np.where(w < n, np.bitwise_count(u ^ v) if a.alike is None else a.alike[u, v], 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(n > 0, exact / (n * bits), otherwise)
        keep = d <= threshold
        return i[keep], j[keep], d[keep]

    return lambda x, y, same, size: _meet(x, y, same, name, kind, size, tolerance, near)


def warped(threshold: float, tolerance: float) -> Compare:
    """Frames by dynamic time warping within a band, all pairs of two lengths in step; see functions.media.dtw_distance."""

    def near(a: _Tile, b: _Tile) -> Found:
        found = []
        for n in np.unique(a.sizes):
            for m in np.unique(b.sizes):
                rows, cols = np.flatnonzero(a.sizes == n), np.flatnonzero(b.sizes == m)
                d = _warp(a.part(rows), b.part(cols), int(n), int(m), threshold)
                i, j = _where(d <= threshold)
                found.append((rows[i], cols[j], d[i, j].astype(float)))
        return tuple(np.concatenate(z) for z in zip(*found, strict=True))

    return lambda x, y, same, size: _meet(x, y, same, "hashes", np.uint64, size, tolerance, near)


def _warp(a: _Tile, b: _Tile, n: int, m: int, threshold: float) -> np.ndarray:
    """Warped distances of all rows of a, n words each, to all rows of b, m each; infinite where beyond the threshold."""
    whole = (len(a.at), len(b.at))
    band, longest = max((n + m) // 7, 2), max(n, m)
    if not n or not m or abs(n - m) > band:
        return np.full(whole, 64.0)
    # sums stop at one more than the most that is near, which holds for every path through a cell beyond it
    most = int(min(threshold * longest * (1 + 1e-9) + 1e-6, 64 * (n + m)))
    kind = _kind(most + 1 + 64)
    away, one = np.full(whole, most + 1, kind), np.empty(whole, np.uint8)
    last = [np.zeros(whole, kind)] + [away] * m
    for i in range(1, n + 1):
        row = [away] * (m + 1)
        for j in range(max(1, i - band), min(m, i + band) + 1):
            _differ(a, b, i - 1, j - 1, one)
            cell = np.minimum(last[j - 1], last[j])
            np.minimum(cell, row[j - 1], out=cell)
            np.add(cell, one, out=cell)
            row[j] = np.minimum(cell, away, out=cell)
        last = row
    d = np.full(whole, np.inf)
    i, j = _where(last[m] <= most)
    d[i, j] = last[m][i, j] / longest
    return d
