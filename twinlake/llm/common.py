"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns; other columns, whatever their names, take no part."""
    return df.select(*cols)


def map_arrow(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = 256, size: int = 2_000_000) -> DataFrame:
    """Apply fn to column lists of at most `rows` rows and about `size` bytes at a time; a larger row stands alone."""
    ship(df.sparkSession)
    names = df.columns
    out = df.sparkSession.createDataFrame([], schema).schema
    arrow = _arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, rows, size):
                got = fn({name: part.column(name).to_pylist() for name in names})
                if got and len(next(iter(got.values()))):
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)
        tidy()

    return df.mapInArrow(run, out)


def map_whole(df: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch], done: Callable[[], None] | None = None) -> DataFrame:
    """Apply change to slices of whole rows, whatever their columns are named: it takes and gives batches of these columns."""
    from pyspark.sql.types import StructField, StructType

    ship(df.sparkSession)
    names, plain = df.columns, [f"c{i}" for i in range(len(df.columns))]
    schema = StructType([StructField(p, f.dataType, f.nullable) for p, f in zip(plain, df.schema.fields, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b):
                yield pa.RecordBatch.from_arrays(change(pa.RecordBatch.from_arrays(part.columns, names=names)).columns, names=plain)
        if done:
            done()
        tidy()

    return df.toDF(*plain).mapInArrow(run, schema).toDF(*names)


def parts(b: pa.RecordBatch, rows: int = 1024, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `rows` rows and about `size` bytes; a larger row stands alone."""
    for begin, n in _cuts(b, rows, size):
        yield b.slice(begin, n)


def _cuts(b: pa.RecordBatch, rows: int, size: int) -> Iterator[tuple[int, int]]:
    import pyarrow.compute as pc

    wide = [c for c in b.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)]
    sizes = [0] * b.num_rows
    for c in wide:
        sizes = [x + (y or 0) for x, y in zip(sizes, pc.binary_length(c).to_pylist(), strict=True)]
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and (i - begin >= rows or total + n > size):
            yield begin, i - begin
            begin, total = i, 0
        total += n
    if begin < b.num_rows:
        yield begin, b.num_rows - begin


def tidy() -> None:
    """Give what a finished task has freed back to the system: its Python worker lives on beside the next stage's."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def utf8(col) -> F.Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
