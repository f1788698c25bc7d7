"""Exports of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.functions.scalar import csv_field, format_size, html_field

# Fixed value: the header that readers of the export expect.
CSV_HEADER = "Group ID,File Path,File Name,Size (bytes),Modified (Unix),Status"


def status() -> F.Column:
    return F.when(F.col("pos") == 0, "kept").otherwise("duplicate")


def csv_rows(members: DataFrame) -> DataFrame:
    """(group_key, pos, line): one CSV line per member."""
    fields = [csv_field("group_key"), csv_field("path"), csv_field("name"), F.col("size").cast("string"), F.col("modified").cast("string"), status()]
    return members.select("group_key", "pos", F.concat_ws(",", *fields).alias("line"))


def html_rows(members: DataFrame) -> DataFrame:
    """(group_key, pos, cells): one table row's cells per member, escaped."""
    cells = F.concat(
        F.lit('<td><a href="'), html_field(F.concat(F.lit("file://"), F.col("path"))), F.lit('">'), html_field("name"), F.lit("</a></td><td>"),
        html_field(format_size("size")), F.lit('</td><td class="'), F.when(F.col("pos") == 0, "kept").otherwise("dup"), F.lit('">'), status(), F.lit("</td>"),
    )
    return members.select("group_key", "pos", cells.alias("cells"))


def html_heads(groups: DataFrame) -> DataFrame:
    """(group_key, head): a group's title row; sounds are titled as identical files, as the others' titles have it."""
    kind = F.when(F.col("kind") == "image", "similar images").when(F.col("kind") == "video", "similar videos").otherwise("identical")
    return groups.select("group_key", F.concat_ws(" - ", kind, F.concat(F.col("n").cast("string"), F.lit(" files")), F.concat(format_size("waste"), F.lit(" wasted"))).alias("head"))


def html_lines(groups: DataFrame, members: DataFrame, scanned: int = 0, folder: str = "") -> DataFrame:
    """(part, waste, group_key, pos, value): the lines of a report, to be put in this order; parts are its head with the
    totals, the groups, and its end (S18)."""
    rank = groups.select("group_key", "waste")
    rows = html_rows(members).select("group_key", "pos", F.concat(F.lit("<tr>"), F.col("cells"), F.lit("</tr>")).alias("value"))
    heads = html_heads(groups).select("group_key", F.lit(-1).alias("pos"), F.concat(F.lit('<tr class="group"><td colspan="4">'), html_field("head"), F.lit("</td></tr>")).alias("value"))
    body = rows.unionByName(heads).join(rank, "group_key").select(F.lit(1).alias("part"), "waste", "group_key", "pos", "value")
    totals = groups.agg(F.count("*").alias("n"), F.coalesce(F.sum("waste"), F.lit(0)).cast("bigint").alias("bytes"))
    figures = ((F.lit(str(scanned)), "files scanned"), (F.col("n").cast("string"), "groups"), (format_size("bytes"), "recoverable"), (F.lit(folder), "folder"))
    stats = F.concat(*[x for value, name in figures for x in (F.lit("<li><b>"), html_field(value), F.lit(f"</b> {name}</li>"))])
    begin = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="UTF-8"><title>Duplicates</title></head><body><ul>'), stats, F.lit("</ul><table><tbody>"))
    edge = lambda part, value: totals.select(F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("waste"), F.lit("").alias("group_key"), F.lit(0).alias("pos"), value.alias("value"))
    return body.unionByName(edge(0, begin)).unionByName(edge(2, F.lit("</tbody></table></body></html>")))


def csv_lines(groups: DataFrame, members: DataFrame) -> DataFrame:
    """As html_lines, of the CSV with its header."""
    body = csv_rows(members).join(groups.select("group_key", "waste"), "group_key").select(F.lit(1).alias("part"), "waste", "group_key", "pos", F.col("line").alias("value"))
    head = members.sparkSession.createDataFrame([(0, 0, "", 0, CSV_HEADER)], body.schema)
    return body.unionByName(head)


def export(groups: DataFrame, members: DataFrame, path: str, form: str, scanned: int = 0, folder: str = "") -> None:
    """Write all of a session, ignored groups too. Lines are in the ranking's order; csv or html, else an error."""
    if form == "csv":
        lines = csv_lines(groups, members)
    elif form == "html":
        lines = html_lines(groups, members, scanned, folder)
    else:
        raise ValueError(f"unknown export format: {form}")
    lines.orderBy("part", F.desc("waste"), "group_key", "pos").select("value").write.mode("overwrite").text(path)
