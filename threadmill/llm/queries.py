"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import capture_index, chat, decontam, fingerprints, langid, license_scan, near_dedup, packing, pii, quality


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.lcp_fingerprints(table(spark, sf_dir, "documents"))


def shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.shared_passages(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index.capture_lookup(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_windows(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second part of op8: the whole table with typed parts made by a rule that SQL repeats."""
    return chat.format_chats(chat.with_parts(table(spark, sf_dir, "conversations")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_fingerprints, shared_passages, op2_near_dedup, op3_license_scan, op4_capture_index, op5_packing, op6_language_id, op7_pii, op8_chat_format, chat_parts, op9_decontamination, op10_quality)
}

ORACLE_SQL: dict[str, str] = {
    "op4_capture_index": r"""
with u as (
  select page_id, url, html, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '#.*$', '') as u from pages
), h as (
  select *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, '^([^/?]*)', 1), '^.*@', ''), ':(80|443)$', ''), '^www[0-9]*[.]', '') as host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') as path, regexp_extract(u, '[?](.*)$', 1) as query from u
), k as (
  select page_id, html, case when length(trim(url)) > 0 then array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || case when path = '' then '/' else path end
    || case when query = '' then '' else '?' || array_to_string(list_sort(string_split(query, '&')), '&') end end as url_key from h
), g as (
  select url_key, count(*) as n, count(distinct sha256(coalesce(html, ''))) as v, sum(strlen(coalesce(html, ''))) as b, min(page_id) as f from k where url_key is not null group by 1
)
select k.page_id, k.url_key, coalesce(g.n, 0)::bigint as n_captures, coalesce(g.v, 0)::bigint as n_versions, coalesce(g.b, 0)::bigint as n_bytes, g.f as first_page_id
from k left join g using (url_key)""",
    "op8_chat_format": r"""
with t as (
  select conv_id, turn, role, text, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) as shown,
    len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z_\x{80}-\x{10ffff}]+|[\x21-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]')) + 2 as n
  from conversations where conv_id is not null
)
select conv_id, string_agg(shown, '' order by turn nulls first, role nulls first, text nulls first) as prompt, count(*)::bigint as n_turns, sum(n)::bigint as n_tokens,
  0::bigint as n_attachments, '[]' as attachments
from t group by conv_id""",
    "chat_parts": r"""
with s as (
  select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as o, coalesce(text, '') as shown_text,
    text is not null and turn % 3 = 1 as media, text is not null and turn % 3 = 2 as paper from conversations where conv_id is not null
), m as (
  select *, sum(media::int) over w as i, sum(paper::int) over w as d from s window w as (partition by conv_id order by o rows unbounded preceding)
), t as (
  select conv_id, o, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || case when paper then '<|document_' || d || '|>' else '' end || replace(shown_text, '<|', '< |')
      || case when media then '<|image_' || i || '|><|audio_' || i || '|>' else '' end || '<|end|>' || chr(10) as shown,
    len(regexp_extract_all(shown_text, '[0-9A-Za-z_\x{80}-\x{10ffff}]+|[\x21-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]')) + 2
      + case when media then (turn + 1) * 3 + (turn + 1) * 25 when paper then turn * 512 else 0 end as n, case when media then 2 when paper then 1 else 0 end as a,
    case when media then '{"placeholder": "<|image_' || i || '|>", "kind": "image", "ref": "i' || turn || '", "turn": ' || turn || ', "n_tokens": ' || (turn + 1) * 3 || '}, {"placeholder": "<|audio_' || i || '|>", "kind": "audio", "ref": "a' || turn || '.wav", "turn": ' || turn || ', "n_tokens": ' || (turn + 1) * 25 || '}'
      when paper then '{"placeholder": "<|document_' || d || '|>", "kind": "document", "ref": "d' || turn || '", "turn": ' || turn || ', "n_tokens": ' || turn * 512 || '}' end as att
  from m
)
select conv_id, string_agg(shown, '' order by o) as prompt, count(*)::bigint as n_turns, sum(n)::bigint as n_tokens, sum(a)::bigint as n_attachments,
  '[' || coalesce(string_agg(att, ', ' order by o), '') || ']' as attachments
from t group by conv_id""",
    "op9_decontamination": r"""
with d as (
  select doc_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10ffff}]+') as w from documents
), b as (
  select row_number() over () as r, item_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10ffff}]+') as w from benchmark
), bs as (
  select distinct r, item_id, least(5, len(w)) as k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) as s from b where len(w) > 0
), ds as (
  select distinct doc_id, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s from d, (select distinct k from bs)
), n as (
  select r, count(*) as n from bs group by 1
)
select ds.doc_id, bs.item_id, count(*) / any_value(n.n)::double as containment, any_value(n.n)::bigint as n_shingles
from ds join bs using (k, s) join n using (r) group by ds.doc_id, bs.r, bs.item_id having count(*) / any_value(n.n)::double >= 0.5""",
}
