"""From raw documents to packed training sequences, stage by stage.

All stages but the last return the columns of their documents, whatever these are named beside doc_id and text. Null
texts count as empty. Ids may be null or repeat: rows of one id stay or go together in near_dedup, all else is done for
each row. Very long texts are read whole. An empty table gives an empty table. Results do not depend on the order of
rows: cuts keep what equals them, groups keep their least id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinlake.llm import bitmap, langid, neardup, packing, quality, secrets
from twinlake.llm.common import table
from twinlake.session import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression selects; it is fitted on the labelled ones. Without labels all stay."""
    return quality.select(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a centroid of some language; those without letters go. Where no row has a language to
    learn from, all stay."""
    return langid.select(docs, langid.fit(docs.where(~langid.held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the least id. Texts without words are in no group."""
    found = neardup.near_duplicates(docs, words=5, percent=80)
    gone = Scratch(spark, "near_dedup").keep(found.where("not kept").select("doc_id").distinct(), "gone")
    return bitmap.without(docs, gone, "doc_id")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by marks; n_chars, where there is such a column, follows. Null texts stay null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, one to a sequence: the table of `packing.pack`."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: No stage but the last could be said in SQL: models and hashing decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written to the shared folder and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
