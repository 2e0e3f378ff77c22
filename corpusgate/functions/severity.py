"""Severities and languages as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ranks of advisory severities; "medium" is another word for moderate.
ADVISORY_RANKS = {"info": 0, "low": 1, "moderate": 2, "medium": 2, "high": 3, "critical": 4}


def clean_label(label: Column) -> Column:
    """Trimmed lower case; null is ''."""
    return F.lower(F.trim(F.coalesce(label, F.lit(""))))


def violation_severity(severity: Column) -> Column:
    """``error``, ``warn`` (also for warning), else the cleaned label."""
    low = clean_label(severity)
    return F.when(low == "warning", "warn").otherwise(low)


def violation_rank(severity: Column) -> Column:
    """Order of a report: error 0, warn 1, all else 2."""
    return F.when(severity == "error", 0).when(severity == "warn", 1).otherwise(2)


def advisory_rank(label: Column) -> Column:
    """Rank of an advisory's severity; null for an unknown one."""
    low, out = clean_label(label), F.lit(None).cast("int")
    for name, rank in ADVISORY_RANKS.items():
        out = F.when(low == name, rank).otherwise(out)
    return out


def override_covers(override: Column, blocked: Column) -> Column:
    """An override label reaches the blocked one; an empty or unknown override never does, an unknown block counts as critical."""
    return F.coalesce(advisory_rank(override) >= F.coalesce(advisory_rank(blocked), F.lit(4)), F.lit(False))


def clean_language(language: Column) -> Column:
    low = clean_label(language)
    return F.when(low == "", "unknown").otherwise(low)


def advisory_label(vuln: Column) -> Column:
    """The severity that an advisory's JSON names: a text, else the first ``score`` of a list that is not blank, else that of ``database_specific``, else ``unknown``; lower case."""
    low = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    is_list = F.get_json_object(vuln, "$.severity").startswith("[")
    text = F.when(~is_list, low(F.get_json_object(vuln, "$.severity")))
    scores = F.transform(F.from_json(F.when(is_list, F.get_json_object(vuln, "$.severity")), "array<struct<score:string>>"), lambda x: low(x["score"]))
    first = F.get(F.filter(scores, lambda x: F.coalesce(x != "", F.lit(False))), F.lit(0))
    own = low(F.get_json_object(vuln, "$.database_specific.severity"))
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(text), first, filled(own), F.lit("unknown"))


def advisories(payloads: DataFrame, text: str) -> DataFrame:
    """``id, summary, severity``, once per id, of all advisories in JSON reports: under ``vulns`` or ``vulnerabilities``, at the top, in ``results`` and in their ``packages``.

    Reports that do not parse have none; of several advisories with one id the least by summary and severity stays.
    """
    vulns = "vulns array<string>, vulnerabilities array<string>"
    report = F.from_json(text, f"{vulns}, results array<struct<vulns:array<string>,vulnerabilities:array<string>,packages:array<struct<vulns:array<string>,vulnerabilities:array<string>>>>>")
    none = F.array().cast("array<string>")
    of = lambda x: F.concat(F.coalesce(x["vulns"], none), F.coalesce(x["vulnerabilities"], none))
    packages = "array<struct<vulns:array<string>,vulnerabilities:array<string>>>"
    inner = lambda r: F.concat(of(r), F.flatten(F.transform(F.coalesce(r["packages"], F.array().cast(packages)), of)))
    results = F.flatten(F.transform(F.coalesce(F.col("__r.results"), F.array().cast("array<struct<vulns:array<string>,vulnerabilities:array<string>,packages:" + packages + ">>")), inner))
    rows = payloads.select(report.alias("__r")).select(F.explode(F.concat(of(F.col("__r")), results)).alias("v"))
    named = rows.select(F.get_json_object("v", "$.id").alias("id"), F.coalesce(F.get_json_object("v", "$.summary"), F.lit("")).alias("summary"), advisory_label(F.col("v")).alias("severity"))
    return named.where("id <> ''").groupBy("id").agg(F.min(F.struct("summary", "severity")).alias("a")).select("id", "a.*")
