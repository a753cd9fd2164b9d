"""Registered queries of the operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._spark import table
from .bpe import bpe_report
from .clustering import cluster_report, lloyd_sql
from .conversations import repair_report, repair_sql
from .decontaminate import decontamination_digest
from .dedup_exact import exact_dedup
from .dedup_suffix import repeats_digest
from .jaccard import jaccard_components
from .langid import language_report
from .licenses import scan_licenses, scan_sql
from .lm_score import lm_report
from .mixing import mix_report
from .sharding import place
from .toxicity import toxicity_report


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_report(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op10_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_lm_score": op5_lm_score,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_suffix_repeats": op7_suffix_repeats,
    "op8_decontaminate": op8_decontaminate,
    "op9_language_id": op9_language_id,
    "op10_shard_lookup": op10_shard_lookup,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": scan_sql(),
    "op5_lm_score": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), t AS (SELECT doc_id, k, ws[k] AS w, ws[k - 1] AS v, ws[k - 2] AS u FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM d)
), c AS (
  SELECT doc_id, k, count(*) OVER (PARTITION BY w) AS c1, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS a1,
         CASE WHEN k > 1 THEN count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) ELSE 0 END AS a2,
         CASE WHEN k > 2 THEN count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY doc_id, u, v, w) ELSE 0 END AS a3
  FROM t
), b AS (SELECT *, lag(a1) OVER (PARTITION BY doc_id ORDER BY k) AS b1, lag(a2) OVER (PARTITION BY doc_id ORDER BY k) AS b2 FROM c
), n AS (SELECT count(*) AS total FROM t
), s AS (
  SELECT doc_id, k > 1 AND a2 = 0 OR k > 2 AND a3 = 0 AS backoff,
         CASE WHEN a3 > 0 THEN ln(a3) - ln(b2) WHEN a2 > 0 THEN ln(a2) - ln(b1) + CASE WHEN k > 2 THEN ln(0.4) ELSE 0 END
              ELSE ln(c1) - ln(total) + least(k - 1, 2) * ln(0.4) END AS p
  FROM b CROSS JOIN n
), g AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE backoff) AS n_backoff, sum(p) AS log_prob FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_backoff, 0) AS n_backoff, round(coalesce(log_prob, 0), 4) AS log_prob,
       round(log_prob / n_tokens, 6) AS mean_log_prob
FROM d LEFT JOIN g USING (doc_id)""",
    "op6_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n""",
    "op8_decontaminate": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower_az, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)
), i AS (
  SELECT item_id, list_filter(string_split_regex(lower_az, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)
), w AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[k:k + 9], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM i WHERE len(ws) > 0)
), lengths AS (SELECT DISTINCT n FROM w
), p AS (
  SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, lengths WHERE len(ws) >= n)
), m AS (SELECT p.doc_id, p.k, p.n, w.item_id FROM p JOIN w ON p.n = w.n AND p.phrase = w.phrase
), h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM m) GROUP BY doc_id
), t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT cast(item_id AS varchar), ',' ORDER BY cast(item_id AS varchar)) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_centroid_clusters": lloyd_sql(),
    "op13_conversation_repair": repair_sql(),
}
