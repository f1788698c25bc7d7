"""Near-duplicate groups by MinHash with tensored banding, every link confirmed on full shingle sets.

A document's set holds the hashes of its distinct shingles of lower-cased (A-Z) words; a shorter text is one shingle,
a text without words has the empty set and links with nothing. Documents with equal sets form a class, which stands
for them below. Two collections of m sketches, each of k minhashes, are computed; the m * m table keys are the pairs
(sketch i of the first, sketch j of the second). So 2 * m * k minhashes serve m * m tables of 2 * k minhashes each.
m is the least for which a pair at the threshold is missed with a chance of at most `miss`.

Only sketches that two classes share can make a shared key, so only their pairs are spread. Within a key's group the
least id is compared with each other. Members of groups that are then not all connected go through an exact join on
prefixes of their sets, across what is not connected. No group is enumerated in pairs or gathered in one task, and no
link between members of a group is lost. A hash that very many sets share is met by broadcast counts and dealt out by
salts, so that no task gets all its sets.

Null text counts as empty. A very long text is hashed whole, in blocks. Rows with one id are one document: what is
linked with one of its texts is linked with all. Repeated rows are rows of one class. Ties do not arise: a component is
named by its least id. Rows without an id stand for no document: they get the component of the documents with the same
set, if there are any, and null for kept. Columns beyond id and text, whatever their names, take no part. An empty table
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinlake.llm.bitmap import may_hold
from twinlake.llm.common import map_arrow, need
from twinlake.operators.components import connected_components
from twinlake.session import Scratch

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    import xxhash

    got = (text or "").encode("utf-8").lower().split()
    if not got:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, got), np.uint64, len(got))
    if len(h) < words:
        # a whole text is no shingle of as many words: its length goes in
        return _scramble(np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64) + np.uint64(len(h)))
    n = len(h) - words + 1
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total = _scramble(total * _MIX[0] + h[k : k + n])
    return np.unique(total)


def sketches_needed(threshold: float, k: int, miss: float) -> int:
    return math.ceil(math.log(miss / 2) / math.log(1 - threshold**k))


def sketch(df: DataFrame, words: int, m: int, k: int) -> DataFrame:
    """(doc_id, n, set_key, halves): set size, digest of the set, and the 2 * m sketches of its minhashes."""
    rng = np.random.default_rng(20240501)
    factor = rng.integers(1, 2**63, 2 * m * k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, 2 * m * k, dtype=np.uint64)

    def run(cols: dict[str, list]) -> dict[str, list]:
        import xxhash

        out: dict[str, list] = {"doc_id": cols["doc_id"], "n": [], "set_key": [], "halves": []}
        for t in cols["text"]:
            s = shingle_set(t, words)
            out["n"].append(len(s))
            out["set_key"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            if not len(s):
                out["halves"].append(None)
                continue
            least = np.full(2 * m * k, np.iinfo(np.uint64).max, np.uint64)
            for i in range(0, len(s), 4096):
                part = s[None, i : i + 4096] * factor[:, None] + shift[:, None]
                np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=1), out=least)
            least = _scramble(least).reshape(2 * m, k)
            half = np.arange(2 * m, dtype=np.uint64)
            for j in range(k):
                half = _scramble(half * _MIX[1] + least[:, j])
            # the low bit tells the collection
            half = half & ~np.uint64(1) | (np.arange(2 * m) >= m).astype(np.uint64)
            out["halves"].append(half.view(np.int64))
        return out

    return map_arrow(need(df, "doc_id", "text"), run, "doc_id long, n int, set_key binary, halves array<long>", 1024)


def shingle_sets(df: DataFrame, words: int) -> DataFrame:
    """(id, hashes) of each document."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"id": cols["doc_id"], "hashes": [shingle_set(t, words).view(np.int64) for t in cols["text"]]}

    return map_arrow(need(df, "doc_id", "text"), run, "id long, hashes array<long>", 1024)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their sets."""
    first = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    second = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    joined = pairs.join(first, "a").join(second, "b")
    small, large = F.least(F.size("ha"), F.size("hb")), F.greatest(F.size("ha"), F.size("hb"))
    joined = joined.where(100 * small >= percent * large)
    joined = joined.withColumn("both", F.size(F.array_intersect("ha", "hb")))
    return joined.where(100 * F.col("both") >= percent * (F.size("ha") + F.size("hb") - F.col("both"))).select("a", "b").distinct()


def join_by_key(rows: DataFrame, facts: DataFrame, key: str, total: int | None = None, least: int = 1000) -> DataFrame:
    """rows joined with facts, one row to a key with its count n of rows; total is the sum of n.

    A key with more than a ten-thousandth of all rows is one of 10,000 at most: these are broadcast, and their rows stay
    where they are.
    """
    if total is None:
        total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") > max(least, total // 10_000)
    hot, cold = F.broadcast(facts.where(often)), facts.where(~often)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key))


def in_any(inside: DataFrame, keys: DataFrame) -> DataFrame:
    """(rep, part) of inside, once, where any of a rep's keys is among keys; inside: (key, rep, scale, part).

    One key of each rep is looked at first, any of its largest: in a large group of near copies that settles nearly all,
    with one row to a rep. Only what it leaves is looked at with every key.
    """
    likely = F.struct(-F.col("scale"), F.xxhash64("key", "rep"))
    first = inside.groupBy("rep").agg(F.min_by("key", likely).alias("key"), F.min("part").alias("part"))
    found = first.join(keys, "key", "left_semi").select("rep", "part")
    left = first.join(keys, "key", "left_anti").select("rep")
    rest = inside.join(left, "rep", "left_semi").join(keys, "key", "left_semi").select("rep", "part").distinct()
    return found.unionByName(rest)


def across_parts(rows: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, salted: int = 1000) -> DataFrame:
    """Every pair (a, b) of different parts that can reach the threshold, by prefixes of the sets; rows: (id, part).

    Hashes are put in one order, rare ones first. Sets that reach the threshold share one of their first
    size - ceil(threshold * size) + 1 hashes, and at the first one that they share, what is left of both still allows the
    overlap needed. In a hash's list only those outside its largest part look for partners, and a document with many
    hashes of its own finds none at all: near copies of one text don't meet in all pairs. A list is dealt out by salts,
    `salted` sets to each, and every looker goes to each.
    """
    each = rows.join(sets, "id").select("id", "part", F.size("hashes").alias("size"), F.explode("hashes").alias("h"))
    often = scratch.keep(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "often")
    common = join_by_key(each, often, "h").withColumnRenamed("n", "df")
    per = common.groupBy("id").agg(F.count("*").alias("c"))
    order = W.partitionBy("id").orderBy("df", "h")
    placed = common.withColumn("r", F.row_number().over(order)).join(per, "id").withColumn("at", F.col("size") - F.col("c") + F.col("r"))
    first = placed.where(f"at <= size - ({percent} * size + 99) div 100 + 1").select("h", "id", "part", "size", "at")
    first = scratch.keep(first, "prefixes")
    scratch.drop(often)
    lists = first.groupBy("h", "part").agg(F.count("*").alias("m")).groupBy("h").agg(F.max(F.struct("m", "part")).alias("top"), F.count("*").alias("k"), F.sum("m").alias("n"))
    lists = scratch.keep(lists.where("k > 1").select("h", F.col("top.part").alias("largest"), "n", (F.expr(f"n div {salted}") + 1).cast("int").alias("salts")), "lists")
    here = join_by_key(first, lists, "h")
    a = here.where("part <> largest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    a = a.select("h", "salt", *[F.col(c).alias(f"{c}_a") for c in ("id", "part", "size", "at")])
    b = here.select("h", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), *[F.col(c).alias(f"{c}_b") for c in ("id", "part", "size", "at")])
    needed = F.expr(f"({percent} * (size_a + size_b) + {99 + percent}) div {100 + percent}")
    fits = (
        (F.col("part_a") != F.col("part_b"))
        & (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
        & (1 + F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= needed)
    )
    return a.join(b, (a["h"] == b["h"]) & (a["salt"] == b["salt"]) & fits).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, k: int = 3, miss: float = 1e-4) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (least id reachable by links), kept."""
    spark = df.sparkSession
    scratch = Scratch(spark, "neardup")
    m = sketches_needed(percent / 100, k, miss)
    rows = scratch.keep(sketch(df, words, m, k).withColumnRenamed("n", "size"), "sketch")
    # a class has the sketches of any of its rows: they have the same set
    classes = rows.where("size > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by("halves", "doc_id").alias("halves"), F.count("*").alias("n"))
    classes = scratch.keep(classes, "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # an id with several texts stands for several classes, told apart by c
    halves = classes.where("rep is not null").select("rep", F.xxhash64("set_key").alias("c"), F.explode("halves").alias("v"))
    halves = scratch.keep(halves, "halves")
    shared = halves.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
    useful = halves.join(shared, "v").groupBy("rep", "c").agg(F.collect_list("v").alias("s"))  # 2 * m at most to a class
    sides = useful.select("rep", F.filter("s", lambda x: x % 2 == 0).alias("s1"), F.filter("s", lambda x: x % 2 != 0).alias("s2"))
    keys = sides.select("rep", F.explode("s1").alias("x"), "s2").select("rep", "x", F.explode("s2").alias("y"))
    keys = scratch.keep(keys.select(F.xxhash64("x", "y").alias("key"), "rep"), "keys")
    scratch.drop(halves)
    # groups with the same members need be looked at once
    groups = keys.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("members")).where("n > 1")
    groups = groups.groupBy("lead", "n", "members").agg(F.min("key").alias("key")).select("key", "lead", "n")
    members = scratch.keep(keys.join(groups, "key"), "members")
    scratch.drop(keys)
    wanted = scratch.keep(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    # an inner join with distinct ids: a semi-join would be moved before the bitmap
    texts = may_hold(need(df, "doc_id", "text"), wanted, "doc_id").join(wanted, "doc_id")
    sets = scratch.keep(shingle_sets(texts, words).distinct(), "sets")
    pairs = members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    links = scratch.keep(confirmed(pairs, sets, percent), "links")
    # rows with one id but different sets are one document: the least of its classes is linked with every other
    rep_of = join_by_key(rows.where("size > 0").select("doc_id", "set_key"), classes.select("set_key", "rep", "n"), "set_key", total).select("doc_id", "rep").distinct()
    several = rep_of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count("*").alias("k")).where("k > 1").select("doc_id", "a")
    links = links.unionByName(scratch.keep(rep_of.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")), "same"))
    parts = connected_components(links, scratch=scratch)
    inside = members.where("n > 2").select("key", "rep", F.log2("n").cast("int").alias("scale")).join(parts, F.col("rep") == F.col("id"), "left")
    inside = scratch.keep(inside.select("key", "rep", "scale", F.coalesce("component", "rep").alias("part")), "parts")
    unsettled = inside.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    unsettled = scratch.keep(unsettled, "unsettled")
    still = scratch.keep(in_any(inside, unsettled).withColumnRenamed("rep", "id"), "still")
    more = scratch.keep(confirmed(across_parts(still, sets, percent, scratch), sets, percent), "links")
    if more.limit(1).count():
        parts = connected_components(links.unionByName(more), scratch=scratch)
    scratch.drop(sets, members, wanted, inside, unsettled, still, more)
    found = classes.join(parts, F.col("rep") == F.col("id"), "left").select("set_key", "n", F.coalesce("component", "rep").alias("component"))
    placed = join_by_key(rows.where("size > 0").select("doc_id", "size", "set_key"), found, "set_key", total).select("doc_id", "size", "component")
    out = placed.unionByName(rows.where("size = 0").select("doc_id", "size", F.lit(None).cast("bigint").alias("component")))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("size").cast("bigint").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
