"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwork.llm import (
    compression, cutting_stock, deobfuscation, entropy_scan, fm_index, free_parse, hard_negatives, html_text, license_scan, signature_trees, spans, spelling,
    suffix_trees, trie_counts,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")


def _span_total(name: str):
    return F.aggregate(name, F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))


@_query
def op1_suffix_trees(spark: SparkSession, path: str) -> DataFrame:
    out = suffix_trees.dedup_substrings(_table(spark, path, "documents"))
    return out.select("doc_id", "n_words", _span_total("removed").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op1_suffix_trees"] = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
v as (select doc_id, words, unnest(range(1, len(words) - 11)) as i from w where len(words) >= 13),
k as (select doc_id, i, array_to_string(words[i:i + 12], ' ') as path from v),
f as (select path, min(doc_id) as first_doc from k group by path),
h as (select distinct doc_id, unnest(range(i, i + 13)) as p from k join f using (path) where first_doc < doc_id),
g as (select doc_id, list(p) as gone from h group by doc_id),
r as (select w.doc_id, words, coalesce(gone, []) as gone from w left join g using (doc_id))
select doc_id, len(words)::bigint as n_words, len(gone)::bigint as n_removed,
  sha256(array_to_string(list_filter(words, lambda x, i: not list_contains(gone, i)), ' ')) as kept_sha256 from r
"""


@_query
def op2_prefix_free_parse(spark: SparkSession, path: str) -> DataFrame:
    out = free_parse.dedup_bytes(_table(spark, path, "documents"))
    return out.select(
        "doc_id", "n_bytes", _span_total("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query
def op10_signature_trees(spark: SparkSession, path: str) -> DataFrame:
    return signature_trees.ngram_join(_table(spark, path, "documents"))


@_query
def op3_fm_index(spark: SparkSession, path: str) -> DataFrame:
    found = fm_index.decontaminate(_table(spark, path, "documents").select("doc_id", "text"), _table(spark, path, "benchmark"), cut=False)
    hit = _span_total("_hits")
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


ORACLE["op3_fm_index"] = r"""
with b as (select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
p as (select item, w, least(len(w), 10) as k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from b where len(w) > 0),
q as (select distinct item, k, array_to_string(w[i:i + k - 1], ' ') as phrase from p),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
s as (select distinct k from q),
v as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, s where len(w) >= k),
o as (select doc_id, i, q.k, item from v join q on v.k = q.k and array_to_string(w[i:i + v.k - 1], ' ') = phrase),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from o) group by doc_id),
m as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from o) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join m using (doc_id)
"""


@_query
def op7_cutting_stock(spark: SparkSession, path: str) -> DataFrame:
    return cutting_stock.pack(_table(spark, path, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op6_compression_bands(spark: SparkSession, path: str) -> DataFrame:
    return compression.rated(_table(spark, path, "documents").select("doc_id", "text")).drop("text")


@_query
def op4_entropy_scan(spark: SparkSession, path: str) -> DataFrame:
    found = entropy_scan.scan_secrets(_table(spark, path, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[spans.count_of("secrets", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(spans.joined("secrets", entropy_scan.KINDS, by_kind=False, base_only=True), 256).alias("base_sha256"),
        spans.joined("secrets", entropy_scan.KINDS, by_kind=False, base_only=False).alias("spans"),
    )


@_query
def op8_deobfuscation(spark: SparkSession, path: str) -> DataFrame:
    found = deobfuscation.scan_personal(_table(spark, path, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[spans.count_of("personal", k).alias(f"n_{k}") for k in deobfuscation.KINDS],
        F.sha2(spans.joined("personal", deobfuscation.KINDS, by_kind=True, base_only=True), 256).alias("base_sha256"),
        spans.joined("personal", deobfuscation.KINDS, by_kind=True, base_only=False).alias("spans"),
    )


@_query
def op5_patience_alignment(spark: SparkSession, path: str) -> DataFrame:
    found = license_scan.scan_licenses(_table(spark, path, "documents").select("doc_id", "text"))
    one = F.transform("licenses", lambda s: F.concat_ws(":", s["license"], F.round(s["coverage"], 3), s["start"], s["end"]))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(one, ",").alias("licenses"))


@_query
def op9_trie_counts(spark: SparkSession, path: str) -> DataFrame:
    counted = trie_counts.token_counts(_table(spark, path, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", F.col("_words").alias("n_words"), F.col("_tokens").alias("n_tokens"))


@_query
def op11_tree_blocks(spark: SparkSession, path: str) -> DataFrame:
    return html_text.extract_text(_table(spark, path, "pages"))


@_query
def op12_search_schemes(spark: SparkSession, path: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, path, "documents"))


@_query
def op13_zone_maps(spark: SparkSession, path: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, path, "embeddings"))


ORACLE["op13_zone_maps"] = r"""
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where label is not null and embedding is not null
    and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x::double))), true)),
a as (select vec_id as anchor_id, label as a_label, v as a from r where vec_id % 100 = 0),
s as (
  select anchor_id, a_label, r.vec_id, r.label,
    coalesce(list_sum(list_transform(range(1, greatest(len(a), len(v)) + 1), lambda i: coalesce(a[i] * v[i], 0))), 0)::bigint as score
  from a, r),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where label = a_label and vec_id <> anchor_id)
  where k <= 5),
n as (
  select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and s.label <> s.a_label and 80 * positive_score <= 100 * s.score and s.score <= positive_score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
