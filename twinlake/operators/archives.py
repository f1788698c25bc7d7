"""Archives with common content: links, groups, comparison, alignment, counters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinlake.operators import blocks, pairs
from twinlake.operators.components import connected_components


def shared_hashes(entries: DataFrame) -> DataFrame:
    """(hash, lead): hashes that two archives or more hold, with the first of these."""
    return entries.select("archive", "hash").distinct().groupBy("hash").agg(F.min("archive").alias("lead"), F.count("*").alias("n")).where("n >= 2").select("hash", "lead")


def exact_links(entries: DataFrame) -> DataFrame:
    """(a, b, shared): links from the first archive of a hash to the others, a star and not all pairs."""
    held = entries.select("archive", "hash").distinct()
    star = held.join(shared_hashes(entries), "hash").where("archive <> lead")
    return star.groupBy(F.col("lead").alias("a"), F.col("archive").alias("b")).agg(F.count("*").alias("shared"))


def matched_entries(entries: DataFrame) -> DataFrame:
    """Entries whose hash another archive holds."""
    return entries.join(shared_hashes(entries).select("hash"), "hash", "left_semi")


def _links(entries: DataFrame, pairs_of) -> DataFrame:
    """Pairs of near entries of different archives, the first archive's entry first."""
    found = pairs_of(entries.withColumn("entry", F.struct("archive", "internal_path"))).where("a.archive <> b.archive")
    return found.select(
        F.col("a.archive").alias("archive_a"), F.col("b.archive").alias("archive_b"), F.col("a.internal_path").alias("internal_path_a"), F.col("b.internal_path").alias("internal_path_b"), "distance"
    )


def image_links(images: DataFrame, threshold: int) -> DataFrame:
    """Picture entries of different archives, coarse and fine both within the same threshold."""
    return _links(images, lambda e: blocks.near_pairs(e, blocks.pictures(threshold, None, threshold), ["fine", "coarse"], "int", "entry", size=1024))


def audio_links(audio: DataFrame, threshold: int, tolerance: float) -> DataFrame:
    """Sound entries of different archives; here the threshold is in 32nds."""
    return _links(audio, lambda e: pairs.audio_pairs(e, threshold / 32, tolerance, "entry"))


def archive_groups(links: DataFrame) -> DataFrame:
    """(archive, group_id) of linked archives."""
    return connected_components(links).select(F.col("id").alias("archive"), F.col("component").alias("group_id"))


def archive_stats(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Per archive of a group: entries, distinct matched paths, their first sizes' sum, whether it can go (A10)."""
    total = entries.groupBy("archive").agg(F.count("*").alias("total_entries"))
    matched = matched_entries(entries).groupBy("archive", "internal_path").agg(F.min_by("size", "pos").alias("size"))
    per = matched.groupBy("archive").agg(F.count("*").alias("duplicated_entries"), F.sum("size").alias("wasted_bytes"))
    groups = archive_groups(links)
    counts = links.join(groups.select(F.col("archive").alias("a"), "group_id"), "a").groupBy("group_id").agg(F.greatest(F.sum("shared"), F.lit(1)).alias("shared_entry_count"))
    out = groups.join(total, "archive").join(per, "archive", "left").join(counts, "group_id")
    n = F.coalesce("duplicated_entries", F.lit(0))
    return out.select(
        "archive", "group_id", "total_entries", n.alias("duplicated_entries"),
        F.coalesce("wasted_bytes", F.lit(0)).alias("wasted_bytes"),
        ((F.col("total_entries") > 0) & (n == F.col("total_entries"))).alias("can_delete"), "shared_entry_count",
    )


def compare_exact(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sides' entries: duplicate with the last path of that hash on the other side, or unique."""

    def one(mine: DataFrame, other: DataFrame, side: str) -> DataFrame:
        last = other.groupBy("hash").agg(F.max_by("internal_path", "pos").alias("duplicate_in"))
        out = mine.join(last, "hash", "left")
        status = F.when(F.col("duplicate_in").isNotNull(), "duplicate").otherwise("unique")
        return out.select(F.lit(side).alias("side"), "internal_path", "hash", "size", status.alias("status"), "duplicate_in", "pos")

    return one(a, b, "a").unionByName(one(b, a, "b"))


def compare_greedy(a: DataFrame, b: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b, distance, score) of picture entries: each of A, in order, takes the nearest free one of B.

    Whose turn it is depends on all before, so a pair of archives is one task; its input is what is still unique.
    """

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        left, right = left.sort_values("pos"), right.sort_values("pos")
        fine, coarse = right["fine"].to_numpy(np.int64), right["coarse"].to_numpy(np.int64)
        free = np.ones(len(right), bool)
        out = []
        for p, f, c in zip(left["internal_path"], left["fine"], left["coarse"], strict=True):
            d = np.bitwise_count((fine ^ np.int64(f)).view(np.uint64)).astype(int)
            ok = free & (d <= threshold) & (np.bitwise_count((coarse ^ np.int64(c)).view(np.uint64)) <= threshold)
            if ok.any():
                i = int(np.where(ok, d, 1000).argmin())
                free[i] = False
                out.append((p, right["internal_path"].iloc[i], int(d[i]), float((1 - d[i] / 64) * 100)))
        return pd.DataFrame(out, columns=["a", "b", "distance", "score"])

    cols = ["pair", "internal_path", "fine", "coarse", "pos"]
    left, right = a.select(*cols).groupBy("pair"), b.select(*cols).groupBy("pair")
    return left.cogroup(right).applyInPandas(match, "a string, b string, distance int, score double")


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left, right, match_type): the k-th entry of a hash beside the k-th of the other side, by path.

    Extra entries of a hash that both sides have stand alone as duplicates; others are unique.
    """
    order = W.partitionBy("hash").orderBy("internal_path")
    left = a.select("hash", F.col("internal_path").alias("left"), F.row_number().over(order).alias("k"))
    right = b.select("hash", F.col("internal_path").alias("right"), F.row_number().over(order).alias("k"))
    both = a.select("hash").join(b.select("hash"), "hash", "left_semi").distinct().withColumn("_shared", F.lit(True))
    rows = left.join(right, ["hash", "k"], "full_outer").join(both, "hash", "left")
    return rows.select("left", "right", F.when(F.col("_shared"), "duplicate").otherwise("unique").alias("match_type"))


def unmatched(entries: DataFrame, also: DataFrame) -> DataFrame:
    """Rows of `also` (archive, internal_path, ...) whose entry no other archive holds exactly: candidates for J11 and J12."""
    return also.join(matched_entries(entries).select("archive", "internal_path").distinct(), ["archive", "internal_path"], "left_anti")


def linked(links: DataFrame) -> DataFrame:
    """(a, b, shared) of links between entries, as `exact_links` has it: pairs of archives, with the entries of the first."""
    return links.groupBy(F.col("archive_a").alias("a"), F.col("archive_b").alias("b")).agg(F.countDistinct("internal_path_a").alias("shared"))


def all_links(*links: DataFrame) -> DataFrame:
    """Links of several kinds together, with what they share in sum."""
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def linked_entries(links: DataFrame) -> DataFrame:
    """(archive, internal_path) of both ends of links between entries."""
    ends = [links.select(F.col(f"archive_{s}").alias("archive"), F.col(f"internal_path_{s}").alias("internal_path")) for s in "ab"]
    return ends[0].unionByName(ends[1]).distinct()


def recompute(entries: DataFrame, groups: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Matched entries per archive within its group: those whose hash another archive of it holds, and with `links` those
    near an entry of another archive of it, each once (J15)."""
    if links is not None:
        return _recompute_linked(entries, groups, links)
    e = entries.join(groups, "archive")
    per = e.select("group_id", "hash", "archive").distinct().groupBy("group_id", "hash").agg(F.count("*").alias("n")).where("n >= 2")
    hit = e.join(per, ["group_id", "hash"], "left_semi").groupBy("archive").agg(F.count("*").alias("matched"))
    total = e.groupBy("archive", "group_id").agg(F.count("*").alias("total_entries"))
    n = F.coalesce("matched", F.lit(0))
    return total.join(hit, "archive", "left").select("archive", "group_id", "total_entries", n.alias("duplicated_entries"), (n == F.col("total_entries")).alias("can_delete"))


def _recompute_linked(entries: DataFrame, groups: DataFrame, links: DataFrame) -> DataFrame:
    e = entries.join(groups, "archive")
    per = e.select("group_id", "hash", "archive").distinct().groupBy("group_id", "hash").agg(F.count("*").alias("n")).where("n >= 2")
    same = e.join(per, ["group_id", "hash"], "left_semi").select("archive", "internal_path")
    of = lambda s: groups.select(F.col("archive").alias(f"archive_{s}"), F.col("group_id").alias(f"group_{s}"))
    near = linked_entries(links.join(of("a"), "archive_a").join(of("b"), "archive_b").where("group_a = group_b"))
    hit = same.unionByName(near).distinct().groupBy("archive").agg(F.count("*").alias("matched"))
    total = e.groupBy("archive", "group_id").agg(F.count("*").alias("total_entries"))
    n = F.coalesce("matched", F.lit(0))
    return total.join(hit, "archive", "left").select("archive", "group_id", "total_entries", n.alias("duplicated_entries"), (n == F.col("total_entries")).alias("can_delete"))


def compare_audio(a: DataFrame, b: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Pairs (a, b, distance, score) of sound entries of two archives, greedy as `compare_greedy`: (1 - d) * 100."""
    held = a.withColumn("archive", F.lit("a")).unionByName(b.withColumn("archive", F.lit("b")))
    near = pairs.audio_pairs(held.withColumn("entry", F.struct("archive", "internal_path", "pos")), threshold, tolerance, "entry").where("a.archive <> b.archive")
    rows = near.select(F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), "distance", F.col("a.internal_path").alias("a"), F.col("b.internal_path").alias("b"))

    def match(frames):
        # whose turn it is depends on all before: one task, which holds what is taken and no pairs but those at hand
        taken, last = set(), None
        for f in frames:
            out = []
            for own, other, d, x, y in zip(f["pos_a"], f["pos_b"], f["distance"], f["a"], f["b"], strict=True):
                if own != last and other not in taken:
                    taken.add(other)
                    last = own
                    out.append((x, y, float(d), float((1 - d) * 100)))
            yield pd.DataFrame(out, columns=["a", "b", "distance", "score"])

    return rows.repartition(1).sortWithinPartitions("pos_a", "distance", "pos_b").mapInPandas(match, "a string, b string, distance double, score double")


def align_compared(a: DataFrame, b: DataFrame, similar: DataFrame) -> DataFrame:
    """The rows of `align` in order, with the entries that are only similar beside each other.

    similar: pairs (a, b, score) of what is unique. First the duplicates, then the similar, then what is only in a, then
    what is only in b: (part, left, right, match_type, score).
    """
    rows = align(a, b)
    same = rows.where("match_type = 'duplicate'").select(F.lit(0).alias("part"), "left", "right", "match_type", F.lit(None).cast("double").alias("score"))
    pairs_ = similar.select(F.col("a").alias("left"), F.col("b").alias("right"), "score")
    near = pairs_.select(F.lit(1).alias("part"), "left", "right", F.lit("similar").alias("match_type"), "score")
    alone = rows.where("match_type = 'unique'")
    left = alone.where("left is not null").join(pairs_.select("left"), "left", "left_anti").select(F.lit(2).alias("part"), "left", "right", "match_type", F.lit(None).cast("double").alias("score"))
    right = alone.where("left is null").join(pairs_.select("right"), "right", "left_anti").select(F.lit(3).alias("part"), "left", "right", "match_type", F.lit(None).cast("double").alias("score"))
    return same.unionByName(near).unionByName(left).unionByName(right)


def missing_from_cache(groups: DataFrame, cached: DataFrame) -> DataFrame:
    """Archives of groups that the entry cache lacks."""
    return groups.join(cached.select("archive").distinct(), "archive", "left_anti").select("archive").distinct()
