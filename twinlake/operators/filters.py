"""Projections, filters and predicates (F1-F16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.functions.scalar import extension, media_class, saturating_kb
from twinlake.params import ScanParams


def inventory_predicate(p: ScanParams) -> Column:
    """Size and time bounds, each off at 0, and extension lists (F1); plain comparisons, so the scan takes them over."""
    ok = F.lit(True)
    size = lambda kb: min(saturating_kb(kb), 2**63 - 1)  # noqa: E731  sizes are signed here
    for bound, name, low in ((size(p.min_file_size_kb), "size", True), (size(p.max_file_size_kb), "size", False), (p.min_modified_timestamp, "modified", True), (p.max_modified_timestamp, "modified", False)):
        if bound > 0:
            ok = ok & (F.col(name) >= bound if low else F.col(name) <= bound)
    e = extension("name")
    if p.exclude_extensions:
        ok = ok & ~e.isin(*[x.lower() for x in p.exclude_extensions])
    if p.include_extensions:
        ok = ok & e.isin(*[x.lower() for x in p.include_extensions])
    return ok


def outside_excluded(relative_dir: Column, excluded: tuple[str, ...]) -> Column:
    """No directory on the way from the root is excluded."""
    if not excluded:
        return F.lit(True)
    return ~F.arrays_overlap(F.split(relative_dir, "/"), F.array(*map(F.lit, excluded)))


def restrict_mode(files: DataFrame, mode: str | None) -> DataFrame:
    """Only one kind of media, where a single similarity search is on."""
    return files.where(media_class("name") == mode) if mode else files


def large_enough(images: DataFrame, min_size: int, min_images: int) -> DataFrame:
    """The size filter, active from a number of candidates on (F8, O5): one aggregated row decides inside the plan."""
    if min_size <= 0:
        return images
    n = images.agg(F.count("*").alias("_n"))
    return images.join(F.broadcast(n)).where((F.col("_n") < min_images) | (F.col("size") >= min_size)).drop("_n")


def minus_ignored(groups: DataFrame, ignored: DataFrame, key: str = "ignore_key") -> DataFrame:
    """Groups whose canonical key is not on the list."""
    return groups.join(ignored.select(key).distinct(), key, "left_anti")


def normalized(query: str | None) -> str | None:
    q = (query or "").strip().lower()
    return q or None


def text_filter(groups: DataFrame, members: DataFrame, query: str | None) -> DataFrame:
    """Groups with the text in their folder key, or in a member's name or path; literal, any case."""
    q = normalized(query)
    if q is None:
        return groups
    holds = lambda c: F.instr(F.lower(F.col(c)), q) > 0
    hit = members.where(holds("name") | holds("path")).select("group_key").union(groups.where(holds("folder_key")).select("group_key"))
    return groups.join(hit.distinct(), "group_key", "left_semi")


def kind_view(groups: DataFrame, members: DataFrame, kind: str) -> DataFrame:
    """Groups of a kind: by their flag, or by the extension of the kept member."""
    first = members.where("pos = 0").where(media_class("name") == kind).select("group_key")
    return groups.join(first, "group_key", "left_semi")


def cross_source(members: DataFrame, key: str = "group_key", side: str = "side") -> DataFrame:
    """Keys of groups with members of both sources."""
    both = members.groupBy(key).agg(F.max((F.col(side) == "primary").cast("int")).alias("p"), F.max((F.col(side) == "secondary").cast("int")).alias("s"))
    return both.where("p = 1 and s = 1").select(key)


def purge(members: DataFrame, gone: DataFrame, key: str = "group_key") -> DataFrame:
    """Members that are still there, of groups that still have two."""
    left = members.join(gone.select("path").distinct(), "path", "left_anti")
    return left.join(left.groupBy(key).agg(F.count("*").alias("_n")).where("_n >= 2").select(key), key, "left_semi")


def duplicates_only(rows: DataFrame) -> DataFrame:
    """Aligned rows that have a match (F16)."""
    return rows.where("match_type <> 'unique'")
