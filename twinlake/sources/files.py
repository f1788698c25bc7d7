"""File inventories (S1-S3): a lister that sees every name, and the built-in reader where hidden names don't matter."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from twinlake.functions.scalar import basename, first_level_folder
from twinlake.operators.filters import inventory_predicate
from twinlake.params import ScanParams
from twinlake.session import ship

SCHEMA = "path string, name string, size bigint, modified bigint"


class _Directory(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.deep = deep


class _Lister(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.recursive = options.get("recursive", "true") == "true"
        self.excluded = frozenset(x for x in options.get("excluded", "").split("/") if x)
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no such folder: {self.root}")

    def partitions(self) -> list[InputPartition]:
        """The root's own files, and each directory below it with all it holds."""
        out: list[InputPartition] = [_Directory(self.root, False)]
        if self.recursive:
            with os.scandir(self.root) as entries:
                out += [_Directory(e.path, True) for e in sorted(entries, key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and e.name not in self.excluded]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        todo = [partition.value]
        while todo:
            try:
                entries = sorted(os.scandir(todo.pop()), key=lambda e: e.name)
            except OSError:
                continue  # what can't be read is left out
            for e in entries:
                try:
                    if e.is_dir(follow_symlinks=False):
                        if partition.deep and e.name not in self.excluded:
                            todo.append(e.path)
                    elif e.is_file(follow_symlinks=not self.recursive):
                        s = e.stat(follow_symlinks=not self.recursive)
                        yield e.path, e.name, s.st_size, int(s.st_mtime)
                except OSError:
                    continue


class FileLister(DataSource):
    """spark.read.format("file_lister").option("recursive", ...).option("excluded", "a/b").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "file_lister"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Lister(self.options)


def inventory(spark: SparkSession, params: ScanParams) -> DataFrame:
    """Files of a scan, filtered: path, name, size, modified, folder, side. Mode by folder is always recursive.

    With a second folder its files follow, recursively, marked as secondary (S3).
    """

    def listed(folder: str, recursive: bool) -> DataFrame:
        ship(spark)
        spark.dataSource.register(FileLister)
        rows = spark.read.format("file_lister").option("recursive", str(recursive).lower()).option("excluded", "/".join(params.excluded)).load(folder)
        return rows.where(inventory_predicate(params)).withColumn("folder", first_level_folder("path", params.folder))

    first = listed(params.folder, params.recursive or params.by_folder).withColumn("side", F.lit("primary"))
    if not params.secondary_folder:
        return first
    return first.unionByName(listed(params.secondary_folder, True).withColumn("side", F.lit("secondary")))


def inventory_builtin(spark: SparkSession, folder: str, recursive: bool = True, **options: str) -> DataFrame:
    """As `inventory` by the binary file source, for remote stores; names with a leading dot or underscore are not seen.

    Contents aren't read, and bounds on size and time reach the listing.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    for k, v in options.items():
        reader = reader.option(k, v)
    path = F.regexp_replace("path", "^file:/*", "/")
    return reader.load(folder).select(path.alias("path"), basename("path").alias("name"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified"))




def contents(files: DataFrame) -> DataFrame:
    """Adds `content`, the files' bytes, read by the executors from a shared file system; null where that fails."""
    ship(files.sparkSession)

    def run(frames):
        def one(path: str) -> bytes | None:
            try:
                return Path(path).read_bytes()
            except OSError:
                return None

        for f in frames:
            for i in range(len(f)):  # one file's bytes at a time
                part = f.iloc[i : i + 1]
                yield part.assign(content=[one(part["path"].iloc[0])])

    return files.mapInPandas(run, StructType([*files.schema.fields, StructField("content", BinaryType())]))


def digests(files: DataFrame, partial: bool = False, block: int = 1 << 20) -> DataFrame:
    """Adds `partial` or `full`: the digest of a file's first 4096 bytes or of all, read in blocks of fixed size.

    Files that can't be read get null and so belong to no group.
    """
    ship(files.sparkSession)
    name = "partial" if partial else "full"
    schema = StructType([*files.schema.fields, StructField(name, StringType())])

    def run(frames):
        import hashlib

        def one(path: str) -> str | None:
            h = hashlib.md5(usedforsecurity=False)
            try:
                with open(path, "rb") as f:
                    if partial:
                        h.update(f.read(4096))
                    else:
                        while b := f.read(block):
                            h.update(b)
            except OSError:
                return None
            return h.hexdigest()

        for f in frames:
            yield f.assign(**{name: [one(p) for p in f["path"]]})

    return files.mapInPandas(run, schema)
