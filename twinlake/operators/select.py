"""Selection rules: which member of a group is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RULES = ("first", "newest", "oldest", "largest_size", "highest_resolution", "priority_folder")


def kept_members(members: DataFrame, rule: str = "first", prefix: str = "") -> DataFrame:
    """The kept row of each group; groups for which a rule says nothing have none.

    Ties go to the last in origin order where the rule asks for a greatest, to the first where it asks for a least.
    """
    group = W.partitionBy("group_key")
    rows = members
    if rule == "newest":
        order = [F.desc("modified"), F.desc("pos")]
    elif rule == "oldest":
        order = [F.col("modified"), F.col("pos")]
    elif rule == "largest_size":
        order = [F.desc("size"), F.desc("modified"), F.desc("pos")]
    elif rule == "highest_resolution":
        rows = rows.withColumn("_known", F.max("pixels").over(group)).where("_known is not null").drop("_known")
        order = [F.desc(F.coalesce("pixels", F.lit(0))), F.desc("size"), F.desc("modified"), F.desc("pos")]
    elif rule == "priority_folder":
        rows = rows.where(F.startswith("path", F.lit(prefix)))
        order = [F.desc("modified"), F.desc("pos")]
    else:
        order = [F.col("pos")]
    return rows.withColumn("_r", F.row_number().over(group.orderBy(*order))).where("_r = 1").drop("_r")


def selected(members: DataFrame, rule: str = "first", prefix: str = "") -> DataFrame:
    """Members to delete: all whose path is not the kept one's, of groups with a kept one."""
    kept = kept_members(members, rule, prefix).select("group_key", F.col("path").alias("_kept"))
    return members.join(kept, "group_key").where("path <> _kept").drop("_kept")


def all_duplicates(members: DataFrame) -> DataFrame:
    """All but the first of each group."""
    return members.where("pos > 0")


def selected_size(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """Bytes of the chosen paths."""
    return members.join(chosen.select("path").distinct(), "path", "left_semi").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("selected_bytes"))
