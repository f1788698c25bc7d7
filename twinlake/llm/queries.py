"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinlake.llm import bpe, chat, fingerprint, html, langid, neardup, packing, quality, secrets, webp
from twinlake.llm.common import table


def op1_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.describe(webp.store(table(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs.where(~langid.held_out())))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], rows.schema)
    return chat.digests(chat.windows(rows.unionByName(more)))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_media_webp, op2_secret_scan, op3_quality_grades, op4_near_duplicates, op5_main_text,
        op6_language, op7_chat_windows, op8_fingerprints, op9_packing, op10_byte_bpe,
    )
    return {f.__name__: f for f in named}


#: Links over full sets, components by recursion.
_OP4 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) >= 3 then [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
meet as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from meet join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
steps as (select a as u, b as v from links union select b, a from links),
reached(id, r) as (select u, u from steps union select reached.id, steps.v from reached join steps on steps.u = reached.r),
parts as (select id, min(r) as component from reached group by id)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(component, d.doc_id) as component_id, coalesce(component, d.doc_id) = d.doc_id as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join parts p on p.id = d.doc_id"""

#: The same windows: a budget of 1,024 tokens, 128 of them for history.
_OP7 = r"""
with given as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
a as (select *, row_number() over (partition by conv_id order by turn, role, text) as n from given),
b as (select *, n = 1 and role = 'system' as sys, greatest(len(regexp_split_to_array(trim(text), '\s+')), ceil(strlen(text) / 4)::bigint) + 2 as tok,
  replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>') as body from a),
c as (select *, case when sys then 0 else tok end as tt, sum(case when sys then 0 else tok end) over (partition by conv_id order by n) as after,
  greatest(256, 896 - coalesce(max(case when sys then tok end) over (partition by conv_id), 0)) as room from b),
d as (select *, after - tt as before, case when not sys then (after - tt) // room + (after - 1) // room end as w0 from c),
e as (select *, coalesce(w0, lead(w0) over (partition by conv_id order by n), 0) as win from d),
f as (select *, lead(win) over (partition by conv_id order by n) as nx from e),
g as (select *, max(nx) over (partition by conv_id, win) as nxt, max(after) over (partition by conv_id, win) as stop from f),
h as (select *, not sys and nxt > win and stop - before <= 128 as rep, 4 + length(role) + 2 + length(body) + 9 as chars from g),
sized as (select conv_id, win, chars from h union all select conv_id, nxt, chars from h where rep),
per as (select conv_id, sum(chars) as chars, count(distinct win) as n_windows from sized group by conv_id),
heads as (select conv_id, chars as head from h where sys)
select h.conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  (any_value(per.chars) + coalesce(any_value(head), 0) * (any_value(n_windows) - 1))::bigint as formatted_chars, any_value(n_windows) as n_windows
from h join per on per.conv_id = h.conv_id left join heads on heads.conv_id = h.conv_id group by h.conv_id"""


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can say; the others are tested against brute force, round trips and held-out rows."""
    return {"op4_near_duplicates": _OP4, "op7_chat_windows": _OP7}
