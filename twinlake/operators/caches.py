"""Hash caches kept between scans, and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What must agree besides the path for an entry to count.
VALID = {"exact": ("mtime", "size"), "image": ("mtime", "coarse_size", "fine_size", "thumbnail_setting"), "video": ("mtime", "size", "n_frames", "algorithm_version"), "audio": ("mtime", "size")}


def lookup(files: DataFrame, cache: DataFrame, kind: str = "exact") -> DataFrame:
    """files with the cached columns where an entry is valid, and `hit` (J2). files has mtime among its columns."""
    keys = ["path", *VALID[kind]]
    return files.join(cache.withColumn("hit", F.lit(True)), keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(files: DataFrame, cache: DataFrame, kind: str = "exact") -> DataFrame:
    return files.join(cache.select("path", *VALID[kind]), ["path", *VALID[kind]], "left_anti")


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """New digests over old entries: one without a full digest clears the old, one with it keeps the old partial of the
    same version (J3)."""
    old = cache.select("path", *[F.col(c).alias(f"old_{c}") for c in ("mtime", "size", "partial_hash", "full_hash")])
    new = fresh.withColumn("is_new", F.lit(True))
    j = old.join(new, "path", "full_outer")
    same = (F.col("old_mtime") == F.col("mtime")) & (F.col("old_size") == F.col("size"))
    pick = lambda c: F.when(F.col("is_new"), F.col(c)).otherwise(F.col(f"old_{c}"))
    partial = F.when(F.col("is_new"), F.coalesce("partial_hash", F.when(same, F.col("old_partial_hash")))).otherwise(F.col("old_partial_hash"))
    return j.select("path", pick("mtime").alias("mtime"), pick("size").alias("size"), partial.alias("partial_hash"), pick("full_hash").alias("full_hash"))


def stats(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Entries, those of another version, and those without a file."""
    f = files.select("path", F.col("modified").alias("now_mtime"), F.col("size").alias("now_size"), F.lit(True).alias("there"))
    j = cache.join(f, "path", "left")
    fresh = (F.col("mtime") == F.col("now_mtime")) & (F.col("size") == F.col("now_size"))
    return j.agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce(fresh, F.lit(False))).alias("fresh"),
        F.count_if(F.col("there") & ~fresh).alias("stale"),
        F.count_if(F.col("there").isNull()).alias("orphaned"),
    )


def volume_root(path: Column) -> Column:
    """The mount point of a path on an external volume, else null."""
    out = F.lit(None).cast("string")
    # fixed values: where external volumes are mounted, and how many components make their root
    for prefix, depth in reversed((("/run/media/", 4), ("/media/", 3), ("/Volumes/", 2), ("/mnt/", 2))):
        parts = F.filter(F.split(path, "/"), lambda p: p != "")
        root = F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, depth), "/"))
        out = F.when(F.startswith(path, F.lit(prefix)), F.when(F.size(parts) >= depth, root)).otherwise(out)
    return out


def purgeable(paths: DataFrame, existing: DataFrame, mounted: DataFrame | None = None) -> DataFrame:
    """Paths that are gone from a volume that can be reached (X22, X23). mounted: (root) of volumes that are there."""
    gone = paths.join(existing.select("path").distinct(), "path", "left_anti").withColumn("_root", volume_root(F.col("path")))
    if mounted is None:
        return gone.where("_root is null").drop("_root")
    there = mounted.select(F.col("root").alias("_root"), F.lit(True).alias("_there")).distinct()
    return gone.join(there, "_root", "left").where("_root is null or _there").drop("_root", "_there")


def prune(cache: DataFrame, existing: DataFrame, mounted: DataFrame | None = None) -> DataFrame:
    return cache.join(purgeable(cache.select("path"), existing, mounted), "path", "left_anti")


def stale_keys(keys: DataFrame, existing: DataFrame, mounted: DataFrame | None = None) -> DataFrame:
    """Ignore keys with a path that is gone for good, and none on a volume that is away."""
    each = keys.select("ignore_key", F.explode(F.split("ignore_key", "\\|")).alias("path"))
    there = existing.select("path").distinct().withColumn("_there", F.lit(True))
    dead = purgeable(each.select("path").distinct(), existing, mounted).select("path", F.lit(True).alias("_dead"))
    j = each.join(there, "path", "left").join(dead, "path", "left")
    per = j.groupBy("ignore_key").agg(F.max(F.coalesce("_dead", F.lit(False))).alias("dead"), F.max(F.col("_there").isNull() & F.col("_dead").isNull()).alias("away"))
    return per.where("dead and not away").select("ignore_key")
