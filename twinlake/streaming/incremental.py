"""Incremental scans: new files go through the hash cache, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinlake.operators import caches
from twinlake.sources.state import append_table, load_table, save_table, versions

CACHE = "path string, mtime bigint, size bigint, partial_hash string, full_hash string"


#: After so many batches the cache is written anew as one version.
COMPACT = 16


def absorb(batch: DataFrame, cache_path: str) -> int:
    """Hash what the cache lacks of a batch (path, modified, size, content) and add it; returns the misses.

    Only the batch's rows are written; every COMPACT batches the cache is made one again. A batch that is run again after
    a failure finds its rows in the cache, so the result is the same.
    """
    spark = batch.sparkSession
    cache = load_table(spark, cache_path, CACHE, "path")
    rows = batch.withColumnRenamed("modified", "mtime")
    new = caches.misses(rows, cache).select("path", "mtime", "size", F.md5(F.substring("content", 1, 4096)).alias("partial_hash"), F.md5("content").alias("full_hash"))
    new = new.dropDuplicates(["path"])
    before = len(versions(spark, cache_path))
    append_table(new, cache_path)
    n = spark.read.schema(CACHE).parquet(versions(spark, cache_path)[-1][2]).count()
    if before >= COMPACT:
        save_table(load_table(spark, cache_path, CACHE, "path"), cache_path)
    return n


def watch(spark: SparkSession, folder: str, cache_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Follow a folder of files: each new one is hashed once and kept in the cache."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    rows = stream.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.unix_timestamp("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    return rows.writeStream.foreachBatch(lambda b, _: absorb(b, cache_path) and None).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def watch_table(stream: DataFrame, cache_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """As `watch`, over a stream of (path, modified, size, content) rows."""
    return stream.writeStream.foreachBatch(lambda b, _: absorb(b, cache_path) and None).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def duplicates(cache: DataFrame) -> DataFrame:
    """Digests that two cached files or more have."""
    return cache.where("full_hash is not null").groupBy("full_hash").agg(F.count("*").alias("n"), F.min("path").alias("group_key")).where("n >= 2")


def observed(groups: DataFrame, name: str = "groups"):
    """(frame, observation): a count of groups as they are made, for progress."""
    from pyspark.sql import Observation

    o = Observation(name)
    return groups.observe(o, F.count("*").alias("n_groups")), o
