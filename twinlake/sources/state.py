"""Tables and small files kept between scans."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def versions(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """(number, kind, path) of a kept table's finished parts, in order; kind is `whole` or `more`.

    A part that was not written to its end lacks Spark's mark of success and doesn't count.
    """
    p, fs = _files(spark, path)
    out = []
    for s in fs.listStatus(p) if fs.exists(p) else ():
        kind, _, n = s.getPath().getName().partition("-")
        if kind in ("whole", "more") and n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            out.append((int(n), kind, s.getPath().toString()))
    return sorted(out)


def _write(df: DataFrame, path: str, kind: str) -> int:
    n = max([n for n, _, _ in versions(df.sparkSession, path)], default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/{kind}-{n}")
    return n


def load_table(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """A kept table; where there is none yet, an empty one (S14). With a key, of several rows the last written holds."""
    found = versions(spark, path)
    base = max([n for n, kind, _ in found if kind == "whole"], default=0)
    parts = [(n, p) for n, _, p in found if n >= base]
    if not parts:
        return spark.createDataFrame([], schema)
    read = [spark.read.schema(schema).parquet(p).withColumn("_v", F.lit(n)) for n, p in parts]
    out = read[0]
    for r in read[1:]:
        out = out.unionByName(r)
    if len(parts) > 1 and key:
        cols = [c for c in out.columns if c not in ("_v", key)]
        return out.groupBy(key).agg(F.max_by(F.struct(*cols), "_v").alias("_last")).select(*[key if c == key else F.col(f"_last.{c}").alias(c) for c in out.columns if c != "_v"])
    return out.drop("_v")


def save_table(df: DataFrame, path: str) -> None:
    """Replace a kept table, also by a plan that reads it: a new version is written, then those before the last go.

    A crash at any point leaves the last finished version, and the one that a running plan may still read.
    """
    spark = df.sparkSession
    n = _write(df, path, "whole")
    older = [m for m, kind, _ in versions(spark, path) if kind == "whole" and m < n]
    for m, _, p in versions(spark, path):
        if older and m < max(older):
            q, fs = _files(spark, p)
            fs.delete(q, True)


def append_table(df: DataFrame, path: str) -> None:
    """Add rows to a kept table without reading what it holds; `load_table` with a key lets them win."""
    _write(df, path, "more")


def append_log(spark: SparkSession, path: str, **fields) -> None:
    """One line of JSON per phase or scan."""
    row = spark.createDataFrame([json.dumps(fields | {"at": datetime.now(UTC).isoformat()}, sort_keys=True)], "value string")
    row.coalesce(1).write.mode("append").text(path)


def ignore(spark: SparkSession, path: str, key: str, names: list[str]) -> None:
    """Put a group's key on the ignore list, once."""
    schema = "ignore_key string, display_names array<string>, ignored_at bigint"
    old = load_table(spark, path, schema)
    new = spark.createDataFrame([(key, names, int(datetime.now(UTC).timestamp()))], schema)
    save_table(old.where(F.col("ignore_key") != key).unionByName(new), path)


def unignore(spark: SparkSession, path: str, key: str | None = None) -> None:
    """Take a key, or all, off the list."""
    schema = "ignore_key string, display_names array<string>, ignored_at bigint"
    old = load_table(spark, path, schema)
    save_table(old.where(F.col("ignore_key") != key) if key is not None else old.limit(0), path)


class Profiles:
    """Saved parameters as small JSON files, newest first."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def save(self, name: str, params: dict, created: int) -> str:
        self.folder.mkdir(parents=True, exist_ok=True)
        ident = f"{created}-{''.join(c if c.isalnum() else '_' for c in name)}"
        (self.folder / f"{ident}.json").write_text(json.dumps({"id": ident, "name": name, "created": created, "params": params}))
        return ident

    def list(self) -> list[dict]:
        out = []
        for f in self.folder.glob("*.json") if self.folder.is_dir() else ():
            try:
                out.append(json.loads(f.read_text()))
            except ValueError:
                continue
        return sorted(out, key=lambda p: p["created"], reverse=True)

    def delete(self, ident: str) -> None:
        (self.folder / f"{ident}.json").unlink(missing_ok=True)
