"""Queries of the training text problems, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintflow.llm import formatdup, leakage, pairs, pii, reading, tokens
from glintflow.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "team_members")
    notes = pii.personal_items(table(spark, d, "diagnostic_assignments"), "diagnostic_assignments", "id", F.col("notes"), members)
    return notes.unionByName(pii.personal_items(table(spark, d, "sample_diagnostics"), "sample_diagnostics", "id", F.col("message"), members))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "team_members")
    notes = pii.redacted(table(spark, d, "diagnostic_assignments"), "diagnostic_assignments", "id", F.col("notes"), members)
    return notes.unionByName(pii.redacted(table(spark, d, "sample_diagnostics"), "sample_diagnostics", "id", F.col("message"), members))


_SAMPLES = ("sample_diagnostics", "id", "message", "code", "source")
_PATTERNS = ("error_patterns", "pattern_hash", "error_message", "error_code", "source")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.copies(table(spark, d, _SAMPLES[0]), *_SAMPLES).unionByName(formatdup.copies(table(spark, d, _PATTERNS[0]), *_PATTERNS))


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.collapsed(table(spark, d, _SAMPLES[0]), *_SAMPLES).unionByName(formatdup.collapsed(table(spark, d, _PATTERNS[0]), *_PATTERNS))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "ml_training_examples"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES = {"p5_found": p5_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p1_found": p1_found, "p1_redacted": p1_redacted, "p4_found": p4_found, "p4_collapsed": p4_collapsed}

_P4 = r"""
WITH raw AS (
  SELECT 'sample_diagnostics' AS t, id, message AS m, code AS c, source AS s FROM sample_diagnostics
  UNION ALL SELECT 'error_patterns', pattern_hash, error_message, error_code, source FROM error_patterns
), kind AS (
  SELECT *, CASE WHEN c IS NULL AND s IS NULL AND json_valid(m) AND m LIKE '{%' THEN
      CAST(map_from_entries(list_transform(json_keys(m), lambda k: {'key': lower(k), 'value': json_extract_string(m, '$."' || k || '"')})) AS MAP(VARCHAR, VARCHAR)) END AS j,
    c IS NULL AND s IS NULL AND regexp_matches(m, '(?is)^\s*(message|code|source)\s*[:=]')
      AND regexp_matches(m, '(?is)(^|\|)\s*message\s*[:=]') AND regexp_matches(m, '(?is)(^|\|)\s*code\s*[:=]') AND regexp_matches(m, '(?is)(^|\|)\s*source\s*[:=]') AS bars
  FROM raw
), fields AS (
  SELECT t, id,
    CASE WHEN j IS NOT NULL THEN j['message'] WHEN bars THEN regexp_replace(regexp_replace(m, '(?is)^(.*\|)?\s*message\s*[:=]', ''), '(?is)\|\s*(code|source)\s*[:=].*$', '') ELSE m END AS m,
    CASE WHEN j IS NOT NULL THEN j['code'] WHEN bars THEN regexp_replace(regexp_replace(m, '(?is)^(.*\|)?\s*code\s*[:=]', ''), '(?is)\|\s*(message|source)\s*[:=].*$', '') ELSE c END AS c,
    CASE WHEN j IS NOT NULL THEN j['source'] WHEN bars THEN regexp_replace(regexp_replace(m, '(?is)^(.*\|)?\s*source\s*[:=]', ''), '(?is)\|\s*(code|message)\s*[:=].*$', '') ELSE s END AS s
  FROM kind
), keyed AS (
  SELECT DISTINCT t, id, regexp_replace(lower(coalesce(m, '')), '[^\p{L}\p{N}]', '', 'g') AS m,
    regexp_replace(lower(coalesce(c, '')), '[^\p{L}\p{N}]', '', 'g') AS c, regexp_replace(lower(coalesce(s, '')), '[^\p{L}\p{N}]', '', 'g') AS s
  FROM fields
)
"""
SQL = {
    "p4_found": _P4 + "SELECT t AS table_name, first_id, id AS copy_id FROM (SELECT t, id, min(id) OVER (PARTITION BY t, m, c, s) AS first_id FROM keyed) WHERE id <> first_id",
    "p4_collapsed": _P4 + "SELECT t AS table_name, min(id) AS first_id, count(*) AS copies FROM keyed GROUP BY t, m, c, s",
}
