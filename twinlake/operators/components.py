"""Connected components (A9): nodes point to their least neighbour, what points to one node is drawn together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.session import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(id, component) for every end of an edge; component is the least id that can be reached.

    Every round each node points to the least of its neighbours and itself, pointers are followed to their ends, and only
    the edges between different ends are left for the next round, which few are where nodes have many neighbours. Each
    step is written to the shared folder: lineage stays short, and a lost executor costs one step at most. Null ends and
    loops are dropped; ids that occur in no edge don't appear.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark, "components")
    ordered = lambda df: df.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left = scratch.keep(ordered(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    found: DataFrame | None = None
    while True:
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = scratch.keep(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("v")).select("id", F.least("id", "v").alias("label")), "ends")
        while True:
            jump = ends.select(F.col("id").alias("label"), F.col("label").alias("far"))
            nxt = scratch.keep(ends.join(jump, "label").select("id", F.col("label").alias("old"), F.col("far").alias("label")), "ends")
            moved = nxt.where("old <> label").limit(1).count()
            scratch.drop(ends)
            ends = nxt.select("id", "label")
            ends._scratch_path = nxt._scratch_path
            if not moved:
                break
        to = lambda c: ends.select(F.col("id").alias(c), F.col("label").alias(f"{c}_end"))  # noqa: B023, E731
        met = left.join(to("u"), "u").join(to("v"), "v").select(F.col("u_end").alias("u"), F.col("v_end").alias("v"))
        rest = scratch.keep(ordered(met), "edges")
        if found is None:
            found = ends
        else:
            later = ends.select(F.col("id").alias("label"), F.col("label").alias("next"))
            was, found = found, scratch.keep(found.join(later, "label", "left").select("id", F.coalesce("next", "label").alias("label")), "found")
            scratch.drop(was, ends)
        scratch.drop(left)
        left = rest
        if not left.limit(1).count():
            scratch.drop(left)
            return found.select("id", F.col("label").alias("component"))
