"""Registered queries of the general training-data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusgate.operators.skew import key_profiles
from corpusgate.session import read_table


def p2_key_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_profiles(read_table(spark, sf_dir, "violations"))


QUERIES = {"p2_key_profiles": p2_key_profiles}

_P2 = """
WITH once AS (
  SELECT violation_id, reported_at, rule_id, file,
         CASE WHEN lower(trim(severity)) IN ('error', 'err') THEN 'e' WHEN lower(trim(severity)) IN ('warn', 'warning') THEN 'w'
              WHEN lower(trim(severity)) IN ('info', 'note') THEN 'i' ELSE 'u' END AS sev,
         row_number() OVER (PARTITION BY violation_id ORDER BY ingested_at DESC) AS rn
  FROM violations),
keyed AS (
  SELECT 'rule' AS key_kind, rule_id AS key, file AS other, reported_at, violation_id, sev FROM once WHERE rn = 1
  UNION ALL SELECT 'file', file, rule_id, reported_at, violation_id, sev FROM once WHERE rn = 1),
turns AS (
  SELECT *, CASE WHEN lag(sev) OVER w IS NULL OR lag(sev) OVER w = sev THEN 0 ELSE 1 END AS turn
  FROM keyed WINDOW w AS (PARTITION BY key_kind, key ORDER BY reported_at, violation_id)),
runs AS (SELECT *, sum(turn) OVER (PARTITION BY key_kind, key ORDER BY reported_at, violation_id ROWS UNBOUNDED PRECEDING) AS run FROM turns),
longest AS (
  SELECT key_kind, key, max(len) AS longest FROM (SELECT key_kind, key, run, count(*) AS len FROM runs GROUP BY ALL) GROUP BY ALL)
SELECT r.key_kind, r.key, count(*) AS n, count(DISTINCT other) AS others,
       CAST(sum(CASE WHEN sev = 'e' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN sev = 'w' THEN 1 ELSE 0 END) AS BIGINT) AS warnings,
       CAST(sum(CASE WHEN sev = 'i' THEN 1 ELSE 0 END) AS BIGINT) AS infos, CAST(sum(CASE WHEN sev = 'u' THEN 1 ELSE 0 END) AS BIGINT) AS unrated,
       min(reported_at) AS first_at, max(reported_at) AS last_at, CAST(sum(turn) AS BIGINT) AS changes, max(l.longest) AS longest
FROM runs r JOIN longest l ON r.key_kind = l.key_kind AND r.key IS NOT DISTINCT FROM l.key
GROUP BY r.key_kind, r.key
"""

ORACLES = {"p2_key_profiles": _P2}
