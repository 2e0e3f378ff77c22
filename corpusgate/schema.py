"""Relations: what a violation, a fact and a file are, from tables that hold repeats and late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.functions.paths import clean_path
from corpusgate.functions.severity import clean_language, violation_severity
from corpusgate.operators.skew import latest_rows
from corpusgate.session import read_table

VIOLATION = "rule_id string, file string, function string, message string, severity string, line int"
FACT = (
    "kind string, symbol_name string, language string, symbol_kind string, file_path string, line_number int, end_line int, complexity int, param_count int, "
    "params array<string>, repeated_nil_guards int, docstring string"
)
VIOLATION_COLUMNS = ["rule_id", "file", "function", "message", "severity", "line"]


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each violation once, as last ingested, without nulls: '' and 0 stand for absence, paths and severities are cleaned."""
    once = latest_rows(read_table(spark, sf_dir, "violations"), "violation_id", "ingested_at", VIOLATION_COLUMNS)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return once.select(
        "violation_id", text("rule_id"), clean_path(F.col("file")).alias("file"), text("function"), text("message"),
        violation_severity(F.col("severity")).alias("severity"), F.coalesce("line", F.lit(0)).alias("line"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact once; language cleaned, null paths and texts '', null numbers kept."""
    columns = [c.split()[0] for c in FACT.split(", ")]
    once = read_table(spark, sf_dir, "policy_facts").select("fact_id", *columns).dropDuplicates(["fact_id"])
    text = ("symbol_name", "symbol_kind", "docstring")
    return once.withColumns(
        {c: F.coalesce(F.col(c), F.lit("")) for c in text} | {"language": clean_language(F.col("language")), "file_path": clean_path(F.col("file_path"))}
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rel, content`` of each source file once, as last captured (ties: the greater text); without null contents and byte-order marks."""
    rows = read_table(spark, sf_dir, "source_files").where("rel IS NOT NULL AND content IS NOT NULL")
    once = rows.groupBy("rel").agg(F.max_by("content", F.struct("captured_at", "content")).alias("content"))
    return once.select("rel", F.regexp_replace("content", "^\\uFEFF", "").alias("content"))
