"""The registered queries of this package, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, neardup, packing, pii, quality, secrets, sharding, substring, tokens, urls
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_bagminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("row")


def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(table(spark, sf_dir, "documents"))


def op5_gear_chunk_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cascade(table(spark, sf_dir, "documents"))


def op7_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.histogram(table(spark, sf_dir, "documents"))


def op9_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_secret_battery, op3_bagminhash_near_duplicates, op4_contextual_pii, op5_gear_chunk_substrings, op6_quality_cascade, op7_sampled_splitters, op8_token_histogram, op9_url_association_rules, op10_pigeonhole_decontamination)}

OP6_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, p + d AS at FROM twice, (VALUES (0), (1), (2)) AS o(d)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(string_split(text, chr(10))) AS n_lines, length(list_aggregate(list_filter(string_split(text, ''), lambda c: upper(c) <> lower(c)), 'string_agg', '')) AS cased,
    length(list_aggregate(list_filter(string_split(text, ''), lambda c: upper(c) <> lower(c) AND upper(c) = c), 'string_agg', '')) AS uppers
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 4 * n_symbols > n_words
    OR 2 * n_dup_lines > n_lines OR (coalesce(cased, 0) >= 20 AND 2 * coalesce(uppers, 0) > cased)) AS kept
FROM base
"""

ORACLE_SQL: dict[str, str] = {"op6_quality_cascade": OP6_SQL}
