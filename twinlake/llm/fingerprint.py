"""Document fingerprints: one-permutation MinHash, by DataFrame functions alone.

Lower-cased words (runs other than ASCII white space) form shingles of five words, or one shingle of all words where
there are fewer. Each shingle is hashed once; the top bits of its hash choose one of 128 bins, which keeps its least
hash. An empty bin takes the value of the filled bin that comes first in a random order of its own (optimal
densification). The fingerprint stores the low eight bits of each bin, as 256 hex digits. Likeness is the share of
equal bins, less the share that chance makes equal (bias correction), cut to 0..1.

Null text counts as empty. Very long texts are hashed whole, an empty table gives no rows. A tie in an empty bin's order
goes to the least low bits. A text without words has the fingerprint '' and likeness 1 to another such, 0 to all else.
Of repeated ids the one whose text sorts first comes first; repeated rows are kept each. Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinlake.llm.common import utf8

BIN_BITS, LOW_BITS, WORDS = 7, 8, 5
BINS = 1 << BIN_BITS
CHANCE = 1 / (1 << LOW_BITS)


def let(value: Column, body) -> Column:
    """body of a value that is computed once: a lambda's argument is never copied into its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(
        hashes,
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) < WORDS, F.array(F.xxhash64(F.concat_ws(",", F.transform(h, lambda x: x.cast("string"))))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]))),
    )


def bins(text: Column) -> Column:
    """(bin << 8 | low bits) of each of the 128 bins in order, or an empty array for a text without words."""
    shift, low = 64 - BIN_BITS, (1 << LOW_BITS) - 1
    every = F.sequence(F.lit(-(BINS // 2)).cast("bigint"), F.lit(BINS // 2 - 1).cast("bigint"))
    of = lambda x: F.shiftright(x, shift)  # noqa: E731  the bin, from -64 to 63
    low_of = lambda x: x.bitwiseAND(F.lit(low))
    entry = lambda b, v: F.shiftleft(b, LOW_BITS).bitwiseOR(v)

    def fill(b, mins):
        # least of a hash of (empty bin, filled bin), carrying the filled bin's low bits
        return low_of(F.array_min(F.transform(mins, lambda x: F.xxhash64(b, of(x)).bitwiseAND(F.lit(~low)).bitwiseOR(low_of(x)))))

    def dense(mins):
        filled = F.transform(mins, lambda x: entry(of(x), low_of(x)))
        empty = F.array_except(every, F.transform(mins, of))
        return F.when(F.size(mins) == BINS, filled).otherwise(F.sort_array(F.concat(filled, F.transform(empty, lambda b: entry(b, fill(b, mins))))))

    least = let(
        F.sort_array(shingle_hashes(text)),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (of(x) != of(F.get(s, i - 1)))),
    )
    return let(least, lambda m: F.when(F.size(m) == 0, F.array().cast("array<bigint>")).otherwise(dense(m)))


def packed(b: Column) -> Column:
    """The bins as hex digits, two to a bin."""
    return F.lower(F.array_join(F.transform(b, lambda x: F.right(F.hex(x.bitwiseOR(F.lit(256))), F.lit(2))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two bin arrays, 0 to 1."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same - CHANCE) / (1 - CHANCE))))
    )


def bounds(df: DataFrame, per_block: int, most_blocks: int, each: int = 8) -> list[int]:
    """Ids that part the rows into blocks of about `per_block`, at most `most_blocks` in number.

    They are every eighth of a sample of ids chosen by a hash, so they follow the ids however these are spread; what
    the driver gets is bounded by 8 * `most_blocks` ids.
    """
    n = df.count()
    blocks = max(1, min(most_blocks, n // per_block))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, each * blocks / max(n, 1)) * (1 << 30)))
    ids = F.sort_array(F.collect_set("doc_id"))
    return df.where(chosen).agg(F.filter(ids, lambda _, i: i % each == each - 1)).first()[0] or []


def block_of(doc_id: Column, edges: list[int]) -> Column:
    """How many of the sorted edges are not above the id (binary search); -1 for none."""
    if not edges:
        return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.lit(0))
    held = F.from_json(F.lit(str(edges)), "array<bigint>")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(edges)).alias("hi"))

    def step(s, _):
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        right = (s["lo"] < s["hi"]) & (F.get(held, mid) <= doc_id)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(edges).bit_length() + 1)), start, step, lambda s: s["lo"])
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(found)


def with_next(df: DataFrame, per_block: int = 64, most_blocks: int = 1 << 18) -> DataFrame:
    """Rows dealt out by blocks of the id, with a copy of the first row of the block below at each block's end.

    Within a block, by descending id, the row after one is then the next document of the whole table; `copied` marks
    the copies, which come last. The lowest block is followed by the highest. The blocks' summary has `most_blocks` + 2
    rows at most, which bounds what is broadcast.
    """
    rows = df.withColumn("block", block_of(F.col("doc_id"), bounds(df, per_block, most_blocks)))
    order = W.orderBy(F.col("block").desc())
    # the first of a block: its greatest id, and of several rows with that id the least text
    tops = rows.groupBy("block").agg(F.max(F.coalesce("doc_id", F.lit(-(2**63)))).alias("top_id"))
    tops = tops.withColumn("above", F.coalesce(F.lag("block").over(order), F.min("block").over(W.partitionBy())))
    firsts = rows.join(F.broadcast(tops), "block").where(F.coalesce("doc_id", F.lit(-(2**63))) == F.col("top_id"))
    first = firsts.groupBy("block", "above", "doc_id").agg(F.min("text").alias("text"))
    copies = first.select("doc_id", "text", F.col("above").alias("block"), F.lit(True).alias("copied"))
    return rows.select("doc_id", "text", "block", F.lit(False).alias("copied")).unionByName(copies)


def fingerprints(df: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to the edited text and the next document.

    The edited text has the last half of the code points replaced by as many, or all, of the first of the next
    document by descending id; the last document is followed by the first.
    """
    rows = with_next(df.select("doc_id", utf8("text").alias("text")))
    here = W.partitionBy("block").orderBy("copied", F.col("doc_id").desc(), "text")
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    seen = rows.withColumn("next_text", F.lead("text").over(here)).withColumn("edited", F.when(~F.col("copied"), edited))
    both = seen.select(
        "doc_id", "copied", "block", "text",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        bins(F.col("text")).alias("own"),
        F.when(~F.col("copied"), bins(F.col("edited"))).alias("changed"),
    )
    out = both.withColumn("after", F.lead("own").over(here)).where(~F.col("copied"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        packed(F.col("own")).alias("fingerprint"),
        packed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
