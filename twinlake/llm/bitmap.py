"""Joins that spare rows the shuffle by a bitmap of hashed ids.

The bitmap has 8 to 16 bits to an id, 2 ** 22 at least, in parts of 4 KB, and 2 ** 30 bits at most (128 MB): the bound of what is
broadcast. Beyond that it gets fuller and lets more rows through to the join, which decides in any case. Rows travel
packed in one column, so that their own columns may have any names. Null ids are none of the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 22, 30


def bits_for(n: int) -> int:
    """The number of bits for n ids, as a power of two."""
    return min(MOST, max(LEAST, (8 * n).bit_length()))


def _packed(rows: DataFrame, column: str) -> DataFrame:
    """(row, id): each row whole, and its id."""
    quoted = [F.col(f"`{c}`") for c in rows.columns]
    return rows.select(F.struct(*quoted).alias("row"), F.col(f"`{column}`").alias("id"))


def _marked(rows: DataFrame, ids: DataFrame, column: str, bits: int | None, how: str) -> tuple[DataFrame, Column]:
    """Packed rows joined with the bitmap's parts, and whether a row's id may be among the ids."""
    bits = bits or bits_for(ids.count())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    parts = ids.select(place(F.col(f"`{column}`")).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    at = F.bitmap_bit_position(place("id"))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return _packed(rows, column).join(F.broadcast(parts), F.bitmap_bucket_number(place("id")) == F.col("part"), how), held & F.col("id").isNotNull()


def may_hold(rows: DataFrame, ids: DataFrame, column: str, bits: int | None = None) -> DataFrame:
    """rows without those whose id is surely none of ids."""
    marked, held = _marked(rows, ids, column, bits, "inner")
    return marked.where(held).select("row.*")


def without(rows: DataFrame, ids: DataFrame, column: str, bits: int | None = None) -> DataFrame:
    """rows whose id is none of ids; only those that the bitmap holds are shuffled."""
    marked, held = _marked(rows, ids, column, bits, "left")
    marked = marked.select("row", "id", F.coalesce(held, F.lit(False)).alias("held"))
    gone = ids.select(F.col(f"`{column}`").alias("gone"))
    doubtful = marked.where("held").join(gone, F.col("id") == F.col("gone"), "left_anti")
    return marked.where("not held").select("row").unionByName(doubtful.select("row")).select("row.*")
