"""Adapters that read the analytics tables as the engine's entities: files, pictures, videos, audio, archives, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, content: bool = True) -> DataFrame:
    """Documents as files: /source/id.lang. `content` stays a lazy column, so plans that never use it don't read text."""
    d = table(spark, sf_dir, "documents")
    side = F.when(F.regexp_extract("source", r"(\d+)", 1).try_cast("int") < 10, "primary").otherwise("secondary")
    out = d.select(
        F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"),
        F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang").alias("name"),
        F.col("source").alias("folder"),
        F.col("lang").alias("ext"),
        F.octet_length("text").cast("bigint").alias("size"),
        (F.lit(1700000000) + F.col("doc_id") % 7 * 3600).alias("modified"),
        F.encode("text", "UTF-8").alias("content"),
        side.alias("side"),
        "doc_id",
    )
    return out if content else out.drop("content")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as picture hashes: fine is their 64 sign bits, coarse the low 16 of these."""
    e = table(spark, sf_dir, "embeddings")
    fine = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, i: F.when(F.get("embedding", i) >= 0, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))).otherwise(acc))
    return e.select(
        F.col("vec_id").alias("id"),
        fine.alias("fine"),
        F.when(F.col("vec_id") % 11 != 0, F.lit(0.5) + F.col("label") * F.lit(0.15)).alias("aspect"),
        (F.lit(5000) + F.col("vec_id") * 40).alias("size"),
        F.col("label").alias("folder"),
    ).withColumn("coarse", F.col("fine").bitwiseAND(F.lit(0xFFFF)))


def videos(spark: SparkSession, sf_dir: str, frames: int = 8) -> DataFrame:
    """Users as videos: events of the middle 80 % in equal parts as thermometer codes, the number of events as duration."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    code = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.floor(F.col("value") / 10).cast("int")) - 1
    numbered = e.select("user_id", code.alias("code"), F.row_number().over(order).alias("n"))
    lengths = e.groupBy("user_id").agg(F.count("*").alias("duration"))
    # a tenth of the length, and then the middle of each part of eight tenths
    at = F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: F.struct(i.alias("i"), (F.expr("duration") * (8 * i + F.lit(frames + 4))).alias("x")))
    wanted = lengths.select("user_id", "duration", F.explode(at).alias("f")).select("user_id", "duration", "f.i", F.expr(f"(f.x div {10 * frames} + 1)").cast("int").alias("n"))
    got = wanted.join(numbered, ["user_id", "n"]).groupBy(F.col("user_id").alias("id"), "duration").agg(F.sort_array(F.collect_list(F.struct("i", "code"))).alias("f"))
    return got.select("id", F.col("f.code").alias("hashes"), F.col("duration").cast("double").alias("duration"))


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sounds: all orders in time as 32-bit words, the number of orders as duration."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    k = F.floor(F.col("o_totalprice") / 20000).cast("int")
    bit = F.call_function("shiftleft", F.lit(1), k)
    word = F.when(F.col("o_orderstatus") == "P", -bit).otherwise(bit - 1)
    got = o.groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", word.alias("w")))).alias("f"))
    return got.select("id", F.col("f.w").alias("fp"), F.size("f").cast("double").alias("duration"))


def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries of archives source-lang."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("-", "source", "lang").alias("archive"),
        F.col("doc_id").cast("string").alias("internal_path"),
        F.md5(F.encode("text", "UTF-8")).alias("hash"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.col("doc_id").alias("pos"),
    )


def archive_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures as entries of twenty archives."""
    return images(spark, sf_dir).select(F.concat(F.lit("arch"), (F.col("id") % 20).cast("string")).alias("archive"), F.col("id").alias("internal_path"), "fine", "coarse")


def exact_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash cache that lacks a third of the files and is stale for a fifth of the rest."""
    f = files(spark, sf_dir).where("doc_id % 3 <> 0")
    return f.select(
        "path",
        (F.col("modified") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("mtime"),
        "size",
        F.md5(F.substring("content", 1, 4096)).alias("partial_hash"),
        F.md5("content").alias("full_hash"),
    )


def missing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir, content=False).where("doc_id % 10 = 0").select("path")
