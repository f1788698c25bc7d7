"""Byte-level BPE by recursive queries, in an embedded DuckDB that a partition's task asks.

Encoding: the rows (word, position, token) of distinct words join the merge table on the token and its successor; each
step contracts a word's leftmost pair of least rank, and a word without such a pair has reached its fixpoint. A word
that is itself a vocabulary entry is one token. In long words all pairs of the least rank are contracted in one step
where no later pair could come before them, and the recursion is entered again every few steps, so that the rows kept
stay bounded. Words are encoded once for all their places in a task's texts, as long as they are remembered (a bound in
bytes). Decoding: a document's own rows (position, id) join the vocabulary and are put together by an ordered
aggregation, in runs of positions that are joined in order.

Null text counts as empty: no tokens. A very long text stands alone in its queries. Repeated rows are encoded each on
their own, an empty table gives no rows, other columns, whatever their names, take no part. There are no ties: a rank
belongs to one token, and of equal ranks the leftmost pair comes first.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame

from twinlake.llm.common import need, parts, tidy
from twinlake.llm.packing import vocabulary
from twinlake.llm.pretokens import Flat
from twinlake.session import ship

#: One step for every live word: its least (rank, position), and its rows without the token that was merged away. A row's
#: place is its word's number and its position in it, in one number.
_FIXPOINT = """
create or replace table tokens as
with recursive step(k, q, t) as (
  select 0::int, q, t from seed
  union all
  (with x as materialized (
     select k, q, t, lead(t) over win as next_t, lead(q) over win as next_q, lag(q) over win as prev_q from step window win as (order by q)),
   best as (
     select q >> 12 as w, min((g.r::bigint << 12) | (q & 4095)) as b
     from x join merges g on g.a = x.t and g.b = x.next_t where q >> 12 = next_q >> 12 group by q >> 12)
   select x.k + 1, x.q, case when x.q & 4095 = best.b & 4095 then (best.b >> 12)::int else x.t end
   from x join best on best.w = x.q >> 12
   where x.prev_q is null or x.prev_q <> (best.w << 12 | (best.b & 4095))))
select s.q >> 12 as w, s.q & 4095 as p, s.t from step s join (select q >> 12 as w, max(k) as k from step group by q >> 12) m on m.w = s.q >> 12 and m.k = s.k
"""
#: As above for one long word: every pair of the least rank, of a run of equal tokens every other one, from its left end.
_LONG = """
with recursive step(k, p, t) as (
  select 0::int, p, t from seed
  union all
  (with x as materialized (
     select k, p, t, lead(t) over (order by p) as next_t, row_number() over (order by p) as n from step),
   best as (select min(g.r) as r from x join merges g on g.a = x.t and g.b = x.next_t),
   hit as (
     select x.p, x.n, g.r, g.a = g.b as same, g.r in (select t from unsafe) as single, row_number() over (order by x.n) as i
     from x join merges g on g.a = x.t and g.b = x.next_t where g.r = (select r from best)),
   taken as (
     select n, r from (select *, row_number() over (partition by n - i order by n) as j from hit)
     where case when single then i = 1 when same then j % 2 = 1 else true end)
   select x.k + 1, x.p, coalesce(m.r, x.t)::int
   from x left join taken m on m.n = x.n left join taken gone on gone.n = x.n - 1
   where gone.n is null and x.k < {depth} and exists (select 1 from taken)))
select k, p, t from step where k = (select max(k) from step) order by p
"""
_IDS = "select w, t from tokens order by w, p"
#: The bytes of each run of positions; a byte is written as the letter of its number.
_DECODE = "select g, string_agg(v.tok, '' order by p) as data from ids join vocab v on v.t = ids.t group by g order by g"
_RUN, _AT_ONCE = 1 << 16, 1 << 18
KEPT = 256 << 20
_LONG_BYTES = 1024


class Bpe:
    """Merge table and vocabulary of a rank file, in DuckDB."""

    def __init__(self, path: str):
        import duckdb
        import pyarrow as pa

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(r) for a, r in map(bytes.split, f)}
        self.pa, self.ranks = pa, ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[a], ranks[b], r) for tok, r in ranks.items() for i in range(1, len(tok)) if (a := tok[:i]) in ranks and (b := tok[i:]) in ranks]
        # tokens that a pair of lower rank takes up: after their merge, a pair may come before others of the same rank
        unsafe = {x for a, b, r in pairs for x in (a, b) if r < x}
        self.db = duckdb.connect()
        # nothing goes to a machine's own disk: the rows of a query are bounded instead
        self.db.execute("set threads = 1; set memory_limit = '400MB'; set temp_directory = ''")
        a, b, r = np.array(pairs, np.int32).T
        self._fill("merges", a=a.copy(), b=b.copy(), r=r.copy())
        self._fill("unsafe", t=np.array(sorted(unsafe), np.int32))
        self.db.register("v", pa.table({"tok": pa.array([t.decode("latin-1") for t in ranks]), "t": pa.array([*ranks.values()], pa.int32())}))
        self.db.execute("create table vocab as select * from v; ")
        self.db.unregister("v")
        self.decimals = pa.array([f"{i}," for i in range(max(ranks.values()) + 1)], pa.large_string())

    def _fill(self, name: str, **cols: np.ndarray) -> None:
        self.db.register("incoming", self.pa.table({k: self.pa.array(v) for k, v in cols.items()}))
        self.db.execute(f"create or replace table {name} as select * from incoming")
        self.db.unregister("incoming")

    def encode(self, words: list[bytes], at_once: int = 4_000_000) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        out: list = [None] * len(words)
        whole, long, part, size = [], [], [], 0
        for i, w in enumerate(words):
            if w in self.ranks:
                whole.append(i)
            elif len(w) > _LONG_BYTES:
                long.append(i)
            elif w:
                part.append(i)
                size += len(w) * (len(w) + 1) // 2  # rows of all steps at most
                if size > at_once:
                    self._encode_part(words, part, out)
                    part, size = [], 0
            else:
                out[i] = b""
        if part:
            self._encode_part(words, part, out)
        for i in whole:
            out[i] = self.ranks[words[i]].to_bytes(4, "little")
        for i in long:
            out[i] = np.array(self._encode_long(words[i]), "<i4").tobytes()
        return out

    def _encode_part(self, words: list[bytes], part: list[int], out: list) -> None:
        sizes = np.array([len(words[i]) for i in part])
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        single = self.bytes[np.frombuffer(b"".join([words[i] for i in part]), np.uint8)]
        self._fill("seed", q=np.repeat(np.arange(len(part)), sizes) << 12 | place, t=single)
        self.db.execute(_FIXPOINT)
        got = self.db.sql(_IDS).fetchnumpy()
        data, cuts = got["t"].astype("<i4").tobytes(), (np.flatnonzero(np.diff(got["w"])) + 1) * 4
        for i, (a, b) in zip(part, pairwise([0, *cuts.tolist(), len(data)]), strict=True):
            out[i] = data[a:b]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes that each document's ids stand for."""
        out: list[list[bytes]] = [[] for _ in ids]
        todo, n = [], 0
        for i, x in enumerate(ids):
            for at in range(0, len(x), _RUN):
                todo.append((i, x[at : at + _RUN]))
                n += len(todo[-1][1])
                if n >= _AT_ONCE:
                    self._decode_runs(todo, out)
                    todo, n = [], 0
        if todo:
            self._decode_runs(todo, out)
        return [b"".join(x) for x in out]

    def _decode_runs(self, runs: list[tuple[int, np.ndarray]], out: list[list[bytes]]) -> None:
        sizes = [len(x) for _, x in runs]
        self.db.register("ids", self.pa.table({"g": np.repeat(np.arange(len(runs)), sizes), "p": np.arange(sum(sizes)), "t": np.concatenate([x for _, x in runs])}))
        got = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("ids")
        for g, data in zip(got.column("g").to_pylist(), got.column("data").to_pylist(), strict=True):
            out[runs[g][0]].append(data.encode("latin-1"))

    def written(self, ids: list[np.ndarray]) -> list[bytes]:
        """Each document's ids as decimals, joined by commas."""
        ends = np.cumsum([0, *map(len, ids)])
        got = self.decimals.take(self.pa.array(np.concatenate(ids)))
        _, places, letters = got.buffers()
        at = np.frombuffer(places, np.int64)[ends].tolist()
        data = memoryview(letters or b"")
        return [bytes(data[a : max(a, b - 1)]) for a, b in pairwise(at)]

    def _encode_long(self, word: bytes) -> list[int]:
        ids = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        while True:
            depth = max(4, min(64, 4_000_000 // len(ids)))
            self._fill("seed", p=np.arange(len(ids)), t=np.array(ids, np.int32))
            rows = self.db.sql(_LONG.format(depth=depth)).fetchall()
            ids = [t for _, _, t in rows]
            if rows[0][0] < depth:
                return ids


@lru_cache(maxsize=1)
def tokenizer(path: str) -> tuple[Bpe, Flat]:
    """The tables, and little-endian ids of the units of texts; a worker keeps both, the units up to KEPT bytes."""
    import public_tokenizers

    bpe = Bpe(path)
    return bpe, Flat(public_tokenizers.PATTERN, lambda words: bpe.encode([w.encode() for w in words]), limit=KEPT)


def _ids(units: Flat, texts) -> list[np.ndarray]:
    """Each text's ids."""
    values, bounds = units(texts)
    _, places, data = values.buffers()
    at = np.frombuffer(places, np.int64)[bounds] // 4
    flat = np.frombuffer(data or b"", "<i4")
    return [flat[a:b] for a, b in pairwise(at.tolist())]


def encode(df: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as comma-joined decimals, decoded as the bytes that the ids stand for."""
    return _each(df, name, "doc_id long, n_tokens long, ids string, decoded binary", lambda ids, data: (ids.decode(), data))


def digests(df: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what `encode` gives."""
    hexed = lambda ids, data: (hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest())
    return _each(df, name, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", hexed)


def _each(df: DataFrame, name: str, schema: str, last) -> DataFrame:
    ship(df.sparkSession)
    kinds = {"string": "string", "binary": "binary"}
    names = [c.split()[0] for c in schema.split(", ")]
    types = [c.split()[1] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        bpe, units = tokenizer(vocabulary(name))
        arrow = [pa.type_for_alias(kinds.get(t, "int64")) for t in types]
        for b in batches:
            for part in parts(b):
                ids = _ids(units, part.column("text"))
                rows = [(doc, len(x), *last(text, data)) for doc, x, text, data in zip(part.column("doc_id").to_pylist(), ids, bpe.written(ids), bpe.decode(ids), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), arrow, strict=True)], names=names)
        tidy()

    return need(df, "doc_id", "text").mapInArrow(run, schema)
