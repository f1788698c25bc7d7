"""Archives as rows of their entries."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from twinlake.session import ship

# Suffixes of each format, longer ones first, and the bytes that a file of it begins with.
SUFFIXES = (
    ("TarGz", (".tar.gz", ".tgz")), ("TarBz2", (".tar.bz2", ".tbz2")), ("TarXz", (".tar.xz", ".txz")), ("TarZst", (".tar.zst",)), ("Tar", (".tar",)),
    ("Zip", (".zip", ".cbz", ".jar", ".war", ".ear", ".apk", ".ipa")), ("SevenZip", (".7z",)),
)
MAGIC = {
    "Zip": ("504B0304", "504B0506", "504B0708"), "SevenZip": ("377ABCAF271C",), "TarGz": ("1F8B",), "TarBz2": ("425A68",),
    "TarXz": ("FD377A585A00",), "TarZst": ("28B52FFD",),
}
LARGE_IMAGE = 50 << 20

ENTRY = "archive string, internal_path string, hash string, size bigint, pos bigint"


def detected(name: Column | str) -> Column:
    """Format by suffix, any case; null for what isn't supported."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    out = F.lit(None).cast("string")
    for kind, ends in reversed(SUFFIXES):
        out = F.when(F.greatest(*[F.endswith(n, F.lit(e)) for e in ends]) if len(ends) > 1 else F.endswith(n, F.lit(ends[0])), kind).otherwise(out)
    return out


def verified(kind: Column | str, content: Column | str) -> Column:
    """Whether the content begins as its format does; unknown content (null) passes, too short content doesn't."""
    k, c = (F.col(x) if isinstance(x, str) else x for x in (kind, content))
    head = F.hex(F.substring(c, 1, 6))
    out = F.when(k == "Tar", F.hex(F.substring(c, 258, 5)) == b"ustar".hex().upper())
    for name, starts in MAGIC.items():
        ok = F.lit(False)
        for s in starts:
            ok = ok | F.startswith(head, F.lit(s))
        out = out.when(k == name, ok)
    return F.coalesce(F.when(c.isNull(), F.lit(True)).otherwise(out), F.lit(False))


def _tar_stream(kind: str, data: bytes):
    raw = io.BytesIO(data)
    if kind == "TarGz":
        return gzip.GzipFile(fileobj=raw)
    if kind == "TarBz2":
        return bz2.BZ2File(raw)
    if kind == "TarXz":
        return lzma.LZMAFile(raw)
    if kind == "TarZst":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(raw)
    return raw


def entries_of(kind: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of each readable entry: directories, encrypted and broken ones are left out.

    The 7z format needs a library that is looked for at run time; without it the archive has no entries (S6).
    """
    try:
        if kind == "Zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if i.is_dir() or i.flag_bits & 1:
                        continue
                    try:
                        yield i.filename, z.read(i)
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, OSError):
                        continue
        elif kind == "SevenZip":
            try:
                import py7zr
            except ImportError:
                return
            with py7zr.SevenZipFile(io.BytesIO(data)) as z:
                for name, f in (z.readall() or {}).items():
                    yield name, f.read()
        else:
            with tarfile.open(fileobj=_tar_stream(kind, data), mode="r|") as t:
                for m in t:
                    if m.isreg() and (f := t.extractfile(m)) is not None:
                        yield m.name, f.read()
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, lzma.LZMAError, ValueError):
        return


def entries(archives: DataFrame, heads: bool = False) -> DataFrame:
    """One row per entry of (path, format, content) rows, with its digest.

    With `heads`, each archive has a row before these at pos -1, with its format as hash and the size of its content.
    """
    ship(archives.sparkSession)
    cols = ["archive", "internal_path", "hash", "size", "pos"]

    def run(frames):
        import hashlib

        rows = []
        for f in frames:
            for path, kind, content in zip(f["path"], f["format"], f["content"], strict=True):
                if heads:
                    rows.append((path, None, kind, None if content is None else len(content), -1))
                if kind and content is not None:
                    rows += [(path, name, hashlib.md5(b, usedforsecurity=False).hexdigest(), len(b), i) for i, (name, b) in enumerate(entries_of(kind, bytes(content)))]
                # a frame costs more than the rows of a small archive
                if len(rows) >= 4096:
                    yield pd.DataFrame(rows, columns=cols).astype({"size": "Int64"})
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=cols).astype({"size": "Int64"})

    return archives.select("path", "format", "content").mapInPandas(run, ENTRY)


def read_entry(kind: str, data: bytes, internal_path: str) -> bytes | None:
    """One entry's bytes."""
    return next((b for name, b in entries_of(kind, data) if name == internal_path), None)


def counts(archives: DataFrame, filtered: Column | None = None, **also: Column) -> DataFrame:
    """Entries per archive, those that `filtered` (over their rows) lets pass, and an estimate of the bytes that extraction
    takes: for tars four times their size (S11, S12). `also` names further counts, of entries that pass another filter.

    Every archive is opened once, and no content is shuffled.
    """
    e = entries(archives, heads=True)
    entry = F.col("pos") >= 0
    kept = entry if filtered is None else entry & filtered
    head = F.when(F.col("pos") < 0, F.struct(F.col("hash").alias("format"), F.col("size").alias("bytes")))
    more = [F.count_if(entry & c).alias(name) for name, c in also.items()]
    # rows of one path have its entries in common
    per = e.groupBy(F.col("archive").alias("path")).agg(F.collect_list(head).alias("heads"), F.count_if(kept).alias("n_entries"), F.sum(F.when(kept, F.col("size"))).alias("total"), *more)
    each = per.select("path", F.explode("heads").alias("head"), "n_entries", "total", *also)
    guess = F.when(F.startswith("head.format", F.lit("Tar")), F.col("head.bytes") * 4).otherwise(F.coalesce("total", F.lit(0)))
    return each.select("path", "head.format", "n_entries", guess.alias("estimate"), *also)


def tools() -> dict[str, bool]:
    """Which external tools and libraries are there; missing ones switch phases off and are no errors."""
    import importlib.util
    import shutil

    return {"ffmpeg": bool(shutil.which("ffmpeg") and shutil.which("ffprobe")), "fpcalc": bool(shutil.which("fpcalc")), "py7zr": importlib.util.find_spec("py7zr") is not None}


def probe(files: DataFrame, command: tuple[str, ...] = ("ffprobe", "-v", "quiet", "-print_format", "json", "-show_format", "-show_streams")) -> DataFrame:
    """Adds `output`: what an external tool prints for each path, null where it fails or is missing."""
    ship(files.sparkSession)

    def run(frames):
        import subprocess

        def one(path: str) -> str | None:
            try:
                r = subprocess.run([*command, path], capture_output=True, text=True, timeout=300, check=False)
            except (OSError, subprocess.SubprocessError):
                return None
            return r.stdout if r.returncode == 0 else None

        for f in frames:
            yield f.assign(output=[one(p) for p in f["path"]])

    return files.mapInPandas(run, StructType([*files.schema.fields, StructField("output", StringType())]))
