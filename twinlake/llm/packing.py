"""Packing by power-of-two decomposition.

A document's token ids, closed by the end id, are cut into pieces whose lengths are powers of two: as many pieces of
the longest length as fit, then the set bits of what remains, from high to low. A sequence is one piece, so sequences
never cross documents and need no padding; sequences of one length form a bucket (`bucket`, the exponent), from which
batches of equal shape are drawn.

Null text counts as empty: such a document is the end id alone. A very long text is many pieces of the longest length.
An empty table gives no pieces. Repeated rows are packed each on their own, ids may repeat or be null. There are no
ties. Columns of the input beyond the id and the text, whatever their names, take no part.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm.common import need, parts, tidy
from twinlake.llm.pretokens import Units
from twinlake.session import ship

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def lengths(n: int, longest: int = 1024) -> list[int]:
    """Piece lengths for n tokens: powers of two, longest first, none over `longest` (itself a power of two)."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable ones as themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Units:
    """Little-endian 32-bit ids of texts by a byte-level tokenizers file; its words, up to 64 MB, stay with the worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True  # their strings inside a text are ordinary text
    model, letters = tok.model, {ord(chr(b)): c for b, c in _byte_letters().items()}
    space = letters[32]

    def encode(words: list[str]) -> list[bytes]:
        out = []
        for w in words:
            if w.isascii() and w[1:].isalnum() and w[0] == " ":
                w = space + w[1:]
            else:
                w = w.encode().decode("latin-1").translate(letters)
            out.append(b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(w)]))
        return out

    return Units(public_tokenizers.PATTERN, encode, b"".join)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_ids(df: DataFrame, name: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, ids): little-endian 32-bit ids of each whole text, as tokenizers gives them without special tokens."""
    ship(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        units = tokenizer(vocabulary(name))
        for b in batches:
            for part in parts(b):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([b"".join(v) for v in units(texts)], pa.binary())], names=["doc_id", "ids"])
        tidy()

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def pack(df: DataFrame, name: str = "byte_bpe_50k.json", longest: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: where it starts in its document, its length, checksum, sequence and bucket.

    sequence_id is the task's number in the high bits and the piece's in the low 33, so that it is unique and the same
    when a task is run again; offset is 0, as a sequence is one piece.
    """
    ship(df.sparkSession)
    assert longest & (longest - 1) == 0
    end = end_id.to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa

        units, n = tokenizer(vocabulary(name)), TaskContext.get().partitionId() << 33
        kinds = [pa.int64()] * 7 + [pa.int32()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for part in parts(b):
                ids, texts = part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()]
                cols: list[list] = [[] for _ in kinds]
                for doc, words in zip(ids, units(texts), strict=True):
                    data, at = memoryview(b"".join([*words, end])), 0
                    total = len(data) // 4
                    for size in lengths(total, longest):
                        for c, v in zip(cols, (doc, at, size, zlib.crc32(data[4 * at : 4 * (at + size)]), total, n, 0, size.bit_length() - 1), strict=True):
                            c.append(v)
                        at += size
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        tidy()

    return need(df, "doc_id", "text").mapInArrow(run, SCHEMA)
