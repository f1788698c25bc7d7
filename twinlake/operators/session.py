"""A stored scan and everything read from it: views, pages, ranking, purging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.operators import exact, filters


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of ordered rows, with the total and whether more follow (W3). The order must end in a unique column."""
    total = rows.agg(F.count("*").alias("total"))
    part = rows.orderBy(*order).offset(offset).limit(limit)
    return part.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def groups_page(groups: DataFrame, offset: int, limit: int) -> DataFrame:
    return page(groups, [F.desc("waste"), F.col("group_key")], offset, limit)


def folder_page(groups: DataFrame, folder: str, offset: int, limit: int) -> DataFrame:
    """A page of one folder's groups."""
    return groups_page(groups.where(F.col("folder_key") == folder), offset, limit)


def merged_ranking(groups: DataFrame, archives: DataFrame) -> DataFrame:
    """File groups and archive groups by waste together."""
    a = groups.select(F.lit("files").alias("kind"), F.col("group_key").alias("key"), "waste")
    b = archives.select(F.lit("archives").alias("kind"), F.col("group_id").alias("key"), "waste")
    return a.unionByName(b).orderBy(F.desc("waste"), "kind", "key")


def newest_first(rows: DataFrame, column: str, *ties: str) -> DataFrame:
    """Lists by descending id or date (W6-W8); ids are strings and sort as such."""
    return rows.orderBy(F.desc(column), *ties)


def sorted_folders(summary: DataFrame, by: str = "waste") -> DataFrame:
    """Folders by name, or by waste with the greatest first."""
    return summary.orderBy("folder_key") if by == "name" else summary.orderBy(F.desc("total_wasted_bytes"), "folder_key")


def session_list(sessions: DataFrame, groups: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Sessions (id, ...) by descending id, each with what its groups (id, ignore_key, waste) come to without those that
    are ignored now (W7)."""
    seen = filters.minus_ignored(groups, ignored) if ignored is not None else groups
    per = seen.groupBy("id").agg(F.count("*").alias("n_groups"), F.sum("waste").alias("total_waste"))
    zero = {"n_groups": F.coalesce("n_groups", F.lit(0)), "total_waste": F.coalesce("total_waste", F.lit(0))}
    return newest_first(sessions.join(per, "id", "left").withColumns(zero), "id")


def delete_session(spark: SparkSession, path: str) -> None:
    """Remove a stored session with all it holds."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@dataclass
class Session:
    """One scan's groups and members, as Parquet in a directory of their own."""

    spark: SparkSession
    path: str

    @classmethod
    def save(cls, path: str, groups: DataFrame, members: DataFrame, summary: DataFrame | None = None) -> Session:
        spark = groups.sparkSession
        groups.write.mode("overwrite").parquet(f"{path}/groups")
        members.write.mode("overwrite").parquet(f"{path}/members")
        if summary is not None:
            summary.write.mode("overwrite").parquet(f"{path}/summary")
        return cls(spark, path)

    def raw_groups(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/groups")

    def members(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/members")

    def summary(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/summary")

    def groups(self, ignored: DataFrame | None = None) -> DataFrame:
        """The stored groups without those ignored now: taking a key off the list brings its group back."""
        return filters.minus_ignored(self.raw_groups(), ignored) if ignored is not None else self.raw_groups()

    def view(self, ignored: DataFrame | None = None, query: str | None = None) -> DataFrame:
        return filters.text_filter(self.groups(ignored), self.members(), query)

    def without(self, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(groups, members) after paths are gone; positions and waste are made anew. No file is touched."""
        left = exact.origin_order(filters.purge(self.members(), gone).withColumn("_old", F.col("group_key")).drop("group_key", "pos"), "_old").drop("_old")
        return exact.group_rows(left), left
