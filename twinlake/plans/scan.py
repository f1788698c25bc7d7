"""A whole scan as lazy plans: inventory, exact groups, similar groups, ranking."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from twinlake.functions.media import decoded_hashes, frame_hashes, frame_times, image_dimensions
from twinlake.functions.scalar import aspect, full_hash, media_class, parse_fingerprint, parse_probe, partial_hash
from twinlake.operators import archives as archive_ops
from twinlake.operators import caches, exact, filters, pairs
from twinlake.params import ScanParams
from twinlake.sources import archives as archive_source
from twinlake.sources import files as file_source
from twinlake.sources.state import append_log, append_table, load_table, versions

TAG = "twinlake-scan"
CACHE = "path string, mtime bigint, size bigint, partial_hash string, full_hash string"


@dataclass
class ScanResult:
    groups: DataFrame
    members: DataFrame
    archives: DataFrame | None = None
    scanned: DataFrame | None = None
    missing_tools: dict[str, bool] = field(default_factory=dict)
    partial: bool = False
    started: float = field(default_factory=time.time)

    def summary(self) -> DataFrame:
        """One row: scanned files, groups, waste."""
        return exact.total_waste(self.groups).join(self.scanned.agg(F.count("*").alias("scanned_files")))  # one row each


def cancel(spark: SparkSession) -> None:
    """Stop the jobs of running scans."""
    spark.sparkContext.cancelJobsWithTag(TAG)


def exact_phase(files: DataFrame, params: ScanParams, cache_path: str | None = None) -> DataFrame:
    """Members of exact groups by the cascade; files by path are read in blocks, rows with content are hashed in place.

    With a cache, digests of unchanged files come from it (J2) and new ones are written to it as they are made (J3), so
    that a scan of what has been scanned reads no content.
    """
    partition = ("folder",) if params.by_folder else ()
    if "content" in files.columns:
        return exact.exact_members(files, *partition)
    step = exact.size_candidates(files, *partition)
    if cache_path and params.exact_cache_enabled:
        step = cached_digests(step, cache_path, "partial", partition)
    else:
        step = file_source.digests(step, partial=True).where("partial is not null")
    step = step.join(exact.shared(step, *partition, "partial"), [*partition, "partial"], "left_semi")
    if cache_path and params.exact_cache_enabled:
        step = cached_digests(step.drop("partial"), cache_path, "full", partition)
    else:
        step = file_source.digests(step).where("full is not null").drop("partial")
    return exact.exact_members(step, *partition)


def cached_digests(files: DataFrame, cache_path: str, which: str, partition: tuple[str, ...] = ()) -> DataFrame:
    """files with their `partial` or `full` digest from the cache, which first gets what it lacks of them."""
    spark = files.sparkSession
    column = f"{which}_hash"
    held = lambda: caches.lookup(files.withColumnRenamed("modified", "mtime"), load_table(spark, f"{cache_path}/exact", CACHE, "path").select("path", "mtime", "size", "partial_hash", "full_hash"))
    lacking = held().where(F.col(column).isNull()).drop("full_hash" if which == "partial" else "none")
    fresh = file_source.digests(lacking.select("path", "mtime", "size", *(["partial_hash"] if which == "full" else [])), partial=which == "partial").where(f"{which} is not null")
    row = [F.col("partial").alias("partial_hash"), F.lit(None).cast("string").alias("full_hash")] if which == "partial" else ["partial_hash", F.col("full").alias("full_hash")]
    append_table(fresh.select("path", "mtime", "size", *row), f"{cache_path}/exact")
    return held().withColumnRenamed("mtime", "modified").withColumnRenamed(column, which).where(f"{which} is not null").select(*files.columns, which)


def files_read(spark: SparkSession, cache_path: str) -> int:
    """How many digests the last step of a scan added to the cache."""
    return spark.read.parquet(versions(spark, f"{cache_path}/exact")[-1][2]).count()


#: What a cache of each kind holds: the key's columns, then the values.
MEDIA = {
    "image": ("path string, mtime bigint, coarse_size int, fine_size int, thumbnail_setting boolean", "fine bigint, coarse bigint, aspect double"),
    "video": ("path string, mtime bigint, size bigint, n_frames int, algorithm_version int", "hashes array<bigint>, duration double"),
    "audio": ("path string, mtime bigint, size bigint", "fp array<int>, duration double"),
}


def remembered(candidates: DataFrame, cache_path: str | None, kind: str, settings: dict, compute) -> DataFrame:
    """candidates with the values that `compute` gives them, from the cache where an entry is valid (J2); others are added
    to it as they are made (J3)."""
    if not cache_path:
        return compute(candidates)
    spark, path = candidates.sparkSession, f"{cache_path}/{kind}"
    keys, values = MEDIA[kind]
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    keyed = candidates.withColumns({"mtime": F.col("modified")} | {k: F.lit(v) for k, v in settings.items()})
    held = lambda: load_table(spark, path, f"{keys}, {values}", "path")
    lacking = caches.misses(keyed, held(), kind).select(candidates.columns)
    if lacking.limit(1).count():
        fresh = compute(lacking).withColumns({"mtime": F.col("modified")} | {k: F.lit(v) for k, v in settings.items()})
        append_table(fresh.select(*names(keys), *names(values)), path)
    return caches.lookup(keyed, held(), kind).where("hit").select(*candidates.columns, *names(values))


def similar_members(rows: DataFrame, links: DataFrame, params: ScanParams) -> DataFrame:
    """Members of similar groups in origin order, from rows (id, path, ...) and links between ids."""
    parts = pairs.groups_of(links).select("id", "group_id")
    m = exact.origin_order(rows.join(parts, "id"), "group_id").drop("group_id")
    if params.secondary_folder:
        m = m.join(filters.cross_source(m), "group_key", "left_semi")
    return m


def image_phase(spark: SparkSession, candidates: DataFrame, folder: str, params: ScanParams, cache_path: str | None = None) -> DataFrame:
    """Similar pictures: hashes of all that the image source decodes in either folder, pairs, groups."""
    c = params.image
    folders = [folder, params.secondary_folder] if params.secondary_folder else [folder]

    def hashes(lacking: DataFrame) -> DataFrame:
        px = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folders).select("image.*")
        # only what is asked for is hashed
        px = px.withColumn("path", F.regexp_replace("origin", "^file:/*", "/")).join(lacking.select("path"), "path", "left_semi")
        px = px.select("path", "width", "height", decoded_hashes("height", "width", "nChannels", "data").alias("h"))
        if len(folders) > 1:
            px = px.dropDuplicates(["path"])  # one folder may lie in the other
        word = lambda b: F.conv(F.hex(b), 16, 10).cast("decimal(20,0)")
        signed = lambda d: F.when(d >= F.lit(Decimal(2**63)), d - F.lit(Decimal(2**64))).otherwise(d).cast("bigint")
        return lacking.join(px, "path").select(lacking["*"], signed(word(F.col("h.fine"))).alias("fine"), signed(word(F.col("h.coarse"))).alias("coarse"), aspect("width", "height").cast("double").alias("aspect"))

    settings = {"coarse_size": c.coarse_hash_size, "fine_size": c.fine_hash_size, "thumbnail_setting": c.use_exif_thumbnail}
    rows = remembered(candidates, cache_path if c.cache_enabled else None, "image", settings, hashes)
    rows = filters.large_enough(rows, c.min_file_size_bytes, c.min_images_size_filter).withColumn("id", F.col("path"))
    links = pairs.image_pairs(rows, params.sim_threshold, rows.count(), c, "folder" if params.by_folder else None)
    return similar_members(rows, links, params)


def video_phase(candidates: DataFrame, params: ScanParams, cache_path: str | None = None) -> DataFrame:
    """Similar videos: probed for their length, sampled by the external decoder, hashed, paired."""
    import subprocess

    import pandas as pd

    n = params.video_frames

    def probed(lacking: DataFrame) -> DataFrame:
        meta = archive_source.probe(lacking).withColumn("meta", parse_probe("output")).where("meta.duration > 0").drop("output")
        return meta.select(*lacking.columns, F.col("meta.duration").alias("duration"))

    def run(frames):
        import numpy as np

        def frame(path: str, at: float):
            command = ["ffmpeg", "-v", "quiet", "-ss", f"{at:.3f}", "-i", path, "-frames:v", "1", "-vf", "scale=32:32,format=gray", "-f", "rawvideo", "-"]
            try:
                out = subprocess.run(command, capture_output=True, timeout=120, check=False).stdout
            except (OSError, subprocess.SubprocessError):
                return None
            return np.frombuffer(out[:1024], np.uint8).reshape(32, 32) if len(out) >= 1024 else None

        def hashes(path: str, duration: float):
            found = frame_hashes([frame(path, t) for t in frame_times(duration, n)])
            return found and [h - 2**64 if h >= 2**63 else h for h in found]

        for f in frames:
            yield pd.DataFrame({**f, "hashes": [hashes(p, d) for p, d in zip(f["path"], f["duration"], strict=True)]})

    def sampled(lacking: DataFrame) -> DataFrame:
        rows = probed(lacking)
        return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("hashes", ArrayType(LongType()))])).where("hashes is not null")

    settings = {"n_frames": n, "algorithm_version": 1}
    hashed = remembered(candidates, cache_path if params.video_cache_enabled else None, "video", settings, sampled).withColumn("id", F.col("path"))
    links = pairs.video_pairs(hashed, params.video_sim_threshold, params.video_duration_tolerance, params.video_use_dtw)
    return similar_members(hashed, same_folder(hashed, links, params), params)


def audio_phase(candidates: DataFrame, params: ScanParams, cache_path: str | None = None) -> DataFrame:
    """Similar sounds by the external fingerprint tool."""

    def printed(lacking: DataFrame) -> DataFrame:
        found = archive_source.probe(lacking, ("fpcalc", "-raw")).withColumn("fp", parse_fingerprint("output")).where("fp is not null")
        return found.select(*lacking.columns, F.col("fp.duration").alias("duration"), F.col("fp.words").alias("fp"))

    rows = remembered(candidates, cache_path if params.audio_cache_enabled else None, "audio", {}, printed).withColumn("id", F.col("path"))
    links = pairs.audio_pairs(rows, params.audio_sim_threshold / 100, params.audio_duration_tolerance)
    return similar_members(rows, same_folder(rows, links, params), params)


def same_folder(rows: DataFrame, links: DataFrame, params: ScanParams) -> DataFrame:
    """In folder mode, links within one folder only."""
    if not params.by_folder:
        return links
    of = rows.select("id", "folder")
    both = links.join(of.select(F.col("id").alias("a"), F.col("folder").alias("fa")), "a").join(of.select(F.col("id").alias("b"), F.col("folder").alias("fb")), "b")
    return both.where("fa = fb").drop("fa", "fb")


def archive_phase(files: DataFrame) -> DataFrame:
    """Archives with common entries; one whose content is not what its name says is left out."""
    named = files.select("path", archive_source.detected("name").alias("format")).where("format is not null")
    ok = file_source.contents(named).where(archive_source.verified("format", "content"))
    e = archive_source.entries(ok)
    return archive_ops.archive_stats(e, archive_ops.exact_links(e))


def scan(spark: SparkSession, params: ScanParams, files: DataFrame | None = None, cache_path: str | None = None, log_path: str | None = None) -> ScanResult:
    """Run a scan over a folder, or over given file rows. Plans stay lazy but for what decides strategies and groups.

    cache_path names the folder of the hashes that are kept between scans (T1), log_path a log of its phases (S20). A scan
    whose jobs are cancelled in a later phase returns what the phases before it found, marked as partial (T2).
    """
    spark.sparkContext.addJobTag(TAG)
    try:
        files = file_source.inventory(spark, params) if files is None else files.where(filters.inventory_predicate(params))
        seen = filters.restrict_mode(files, params.single_mode())
        found = exact_phase(seen, params, cache_path)
        if params.secondary_folder:
            found = found.join(filters.cross_source(found), "group_key", "left_semi")
        result = ScanResult(exact.group_rows(found), found, scanned=files)
        tools = archive_source.tools()

        def similar(kind: str, phase) -> None:
            began = time.time()
            m = phase(exact.minus_exact(seen.where(media_class("name") == kind), found))
            result.groups = result.groups.unionByName(exact.group_rows(m, kind))
            result.members = result.members.unionByName(m, allowMissingColumns=True)
            if log_path:
                append_log(spark, log_path, phase=kind, seconds=round(time.time() - began, 3))

        phases = []
        if params.find_similar and params.folder:
            phases.append(("image", lambda rest: image_phase(spark, rest, params.folder, params, cache_path)))
        for on, tool, kind, phase in ((params.find_similar_videos, "ffmpeg", "video", video_phase), (params.find_similar_audio, "fpcalc", "audio", audio_phase)):
            if on and not tools[tool]:
                result.missing_tools[f"{tool}_missing"] = True
            elif on and params.folder:
                phases.append((kind, lambda rest, phase=phase: phase(rest, params, cache_path)))
        for kind, phase in phases:
            try:
                similar(kind, phase)
            except Exception as e:
                if "cancel" not in str(e).lower():
                    raise
                result.partial = True
                break
        if params.ignored_keys:
            keys = spark.createDataFrame([(k,) for k in params.ignored_keys], "ignore_key string")
            result.groups = filters.minus_ignored(result.groups, keys)
            result.members = result.members.join(result.groups.select("group_key"), "group_key", "left_semi")
        if params.scan_archives and not result.partial:
            result.archives = archive_phase(files)
        return result
    finally:
        spark.sparkContext.removeJobTag(TAG)


def hashes_of(rows: DataFrame) -> DataFrame:
    """Both digests of rows with content, for the cache."""
    return rows.select("path", F.col("modified").alias("mtime"), "size", partial_hash("content").alias("partial_hash"), full_hash("content").alias("full_hash"))


def dimensions(rows: DataFrame) -> DataFrame:
    """Adds width and height from picture headers."""
    return rows.withColumn("d", image_dimensions("content")).withColumns({"width": F.col("d.width"), "height": F.col("d.height")}).drop("d")
