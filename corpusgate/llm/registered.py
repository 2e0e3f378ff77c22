"""Registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusgate.llm import credentials, docpairs, leakage, mixing, pii, quantiles, topn
from corpusgate.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.documented_symbols(read_table(spark, sf_dir, "source_files"))


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.documented_pairs(read_table(spark, sf_dir, "source_files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.most_complex_facts(read_table(spark, sf_dir, "policy_facts")).select("file_path", "fact_id")


def p3_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.most_complex_facts(read_table(spark, sf_dir, "policy_facts"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_strings(read_table(spark, sf_dir, "macros"), read_table(spark, sf_dir, "tooling_gates"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = credentials.command_strings(read_table(spark, sf_dir, "macros"), read_table(spark, sf_dir, "tooling_gates"))
    return credentials.redacted(strings, credentials.KEYS, "text")


def p5_file_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.file_percentiles(read_table(spark, sf_dir, "policy_facts"))


def p5_language_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.language_percentiles(read_table(spark, sf_dir, "policy_facts"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p6_item_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p7_mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p7_mix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p7_mix_exact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"), "exact")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_lines(read_table(spark, sf_dir, "documents"))


def p8_anonymised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.anonymised(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_pairs, p3_found, p3_ranked, p4_found, p4_redacted, p5_file_percentiles, p5_language_percentiles, p6_found, p6_spans, p6_item_report, p7_mixed_documents, p7_mix_report, p7_mix_exact_report, p8_found, p8_anonymised)
}

_RANKED = """
SELECT file_path, fact_id, complexity, line_number, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY complexity DESC, line_number ASC NULLS LAST, fact_id ASC) AS rank
  FROM (SELECT DISTINCT file_path, fact_id, complexity, line_number FROM policy_facts WHERE complexity IS NOT NULL AND file_path <> ''))
WHERE rank <= 5
"""

# The same words as in the operator, but runs by a join on whole windows instead of an automaton.
_LEAKED = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE item_text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 12], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 12], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS p FROM i WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run)
"""

# Groups below the operator's buffer size are exact, and all are at the scale of the comparison.
_FILE_PERCENTILES = """
WITH f AS (SELECT fact_id, CASE WHEN trim(coalesce(language, '')) = '' THEN 'unknown' ELSE lower(trim(language)) END AS language, file_path, complexity, param_count
  FROM policy_facts QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY ingested_at) = 1),
m AS (SELECT language, file_path, 'complexity' AS metric, CAST(complexity AS DOUBLE) AS v FROM f WHERE complexity IS NOT NULL
  UNION ALL SELECT language, file_path, 'param_count', CAST(param_count AS DOUBLE) FROM f WHERE param_count IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY language, file_path, metric ORDER BY v) AS i, count(*) OVER (PARTITION BY language, file_path, metric) AS n FROM m)
SELECT language, file_path, metric, n, CAST(0 AS DOUBLE) AS rank_error, min(v) FILTER (i >= ceil(0.5 * n - 1e-9)) AS p50, min(v) FILTER (i >= ceil(0.9 * n - 1e-9)) AS p90,
  min(v) FILTER (i >= ceil(0.95 * n - 1e-9)) AS p95, min(v) FILTER (i >= ceil(0.99 * n - 1e-9)) AS p99 FROM r GROUP BY language, file_path, metric, n
"""

# Stretches are islands of neighbouring windows; a word's place is the length of all words and gaps before it.
_SPANS = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
dl AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM d),
i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE item_text IS NOT NULL AND item_id IS NOT NULL),
dw AS (SELECT doc_id, text, p, array_to_string(w[p:p + 12], ' ') AS run FROM (SELECT doc_id, text, w, unnest(range(1, len(w) - 11)) AS p FROM dl WHERE len(w) >= 13)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 12], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS p FROM i WHERE len(w) >= 13)),
h AS (SELECT DISTINCT doc_id, text, item_id, p FROM dw JOIN iw USING (run)),
n AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY p) AS island FROM h),
s AS (SELECT doc_id, text, item_id, min(p) AS a, max(p) + 12 AS z FROM n GROUP BY doc_id, text, item_id, island),
l AS (SELECT *, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: length(x)) AS wl, list_transform(regexp_split_to_array(text, '[\\p{L}\\p{N}]+'), lambda x: length(x)) AS gl FROM s)
SELECT DISTINCT doc_id, item_id, CAST(list_sum(gl[1:a]) + coalesce(list_sum(wl[1:a - 1]), 0) AS INTEGER) AS start, CAST(list_sum(gl[1:z]) + list_sum(wl[1:z]) AS INTEGER) AS end, CAST(z - a + 1 AS INTEGER) AS words FROM l
"""
_ITEM_REPORT = f"""
WITH sp AS ({_SPANS}), k AS (SELECT item_id, min(suite) AS suite FROM eval_items GROUP BY item_id),
r AS (SELECT item_id, count(DISTINCT doc_id) AS documents, max(words) AS longest FROM sp GROUP BY item_id)
SELECT k.item_id, suite, coalesce(documents, 0) AS documents, coalesce(longest, 0) AS longest FROM k LEFT JOIN r USING (item_id)
"""

ORACLES: dict[str, str] = {
    "p6_spans": _SPANS,
    "p6_item_report": _ITEM_REPORT,
    "p5_file_percentiles": _FILE_PERCENTILES,
    "p3_found": f"SELECT file_path, fact_id FROM ({_RANKED})",
    "p3_ranked": _RANKED,
    "p6_found": _LEAKED,
}
