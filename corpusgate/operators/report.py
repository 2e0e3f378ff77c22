"""What a report does with violations: roll-up, dedupe, order, grouping, totals, lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.functions.severity import violation_rank
from corpusgate.operators.skew import offset_numbers
from corpusgate.session import materialize

MILD = "function-quality.mild-ctx"


@dataclass(frozen=True)
class RollUp:
    """From ``per_file`` mild rows a file becomes one row, from ``hotspot`` with a note; the rest one row from ``least`` rows."""

    per_file: int = 2
    hotspot: int = 4
    least: int = 3
    mild: int = 12
    elevated: int = 14


def roll_up(violations: DataFrame, how: RollUp = RollUp()) -> DataFrame:
    """Mild warnings summed up; all other rows as they are. Each row counts once, in its file's row or in the rest."""
    columns = ["rule_id", "file", "function", "message", "severity", "line"]
    mild = violations.where(F.col("rule_id") == MILD).select(*columns)
    others = violations.where(F.col("rule_id") != MILD).select(*columns)
    per_file = mild.groupBy("file").agg(F.count("*").alias("n"))
    span = f"(CTX {how.mild}-{how.elevated - 1})"
    low = F.format_string(f"%s has %d low CTX violations {span}", F.col("file"), F.col("n"))
    text = F.when(F.col("n") >= how.hotspot, F.concat(low, F.lit(f"; hotspot threshold is {how.hotspot}"))).otherwise(low)
    summed = per_file.where(F.col("n") >= how.per_file).select(
        F.lit("function-quality").alias("rule_id"), "file", F.lit("").alias("function"), text.alias("message"), F.lit("warn").alias("severity"), F.lit(0).alias("line")
    )
    # A file that stays below has fewer rows than ``per_file``, so no more of any file are looked at; each task drops the others.
    of_file = Window.partitionBy("file")
    first = mild.withColumn("__i", F.row_number().over(of_file.orderBy("function", "line", "message", "severity"))).where(F.col("__i") <= how.per_file)
    rest = first.withColumn("__n", F.count("*").over(of_file)).where(F.col("__n") < how.per_file).select(*columns).withColumn("rule_id", F.lit("function-quality"))
    count = per_file.where(F.col("n") < how.per_file).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    passed = rest.join(F.broadcast(count), F.col("n") < how.least).select(*columns)
    bundle = count.where(F.col("n") >= how.least).select(
        F.lit("function-quality").alias("rule_id"), F.lit("").alias("file"), F.lit("").alias("function"),
        F.format_string(f"%d functions have low CTX violations {span}", F.col("n")).alias("message"), F.lit("warn").alias("severity"), F.lit(0).alias("line"),
    )
    return others.unionByName(summed).unionByName(passed).unionByName(bundle)


def deduped(violations: DataFrame) -> DataFrame:
    """One row per file, line, function, rule and message: the gravest; severity is not part of the key."""
    return violations.groupBy("file", "line", "function", "rule_id", "message").agg(F.min_by("severity", F.struct(violation_rank(F.col("severity")), F.col("severity"))).alias("severity"))


ORDER = ["rank", "rule_id", "file", "function", "line", "message"]


def positions(violations: DataFrame, tie: str | None = None) -> DataFrame:
    """``violations`` with ``position`` from 0 in report order: severity, rule, file, function, line, message.

    Rows are numbered by range and offset, so no task sees them all.
    """
    ranked = violations.withColumns({"rank": violation_rank(F.col("severity")), "__all": F.lit(1)})
    return offset_numbers(ranked, ["__all"], [*ORDER, *([tie] if tie else [])]).drop("__all", "rank").withColumnRenamed("seq", "position")


def group_starts(violations: DataFrame) -> DataFrame:
    """``severity, rule_id, rows``, and the first row's ``file, function, line, message`` of each printed group."""
    first = F.min(F.struct("file", "function", "line", "message"))
    return violations.groupBy("severity", "rule_id").agg(F.count("*").alias("rows"), first.alias("f")).select("severity", "rule_id", "rows", "f.file", "f.function", "f.line", "f.message")


def grouped_report(violations: DataFrame, tie: str) -> DataFrame:
    """``position, file, group, tie``: each violation once per place, rule and message, with the least position of its file; files print in the order of ``group``.

    Of repeats the first by ``tie`` stays. Positions count the rows that are left, from 0.
    """
    same = ["file", "line", "function", "rule_id", "message"]
    first = F.min(F.struct(violation_rank(F.col("severity")).alias("r"), F.col(tie).alias("t"), F.col("severity").alias("s")))
    once = violations.groupBy(*same).agg(first.alias("f")).select(*same, F.col("f.s").alias("severity"), F.col("f.t").alias(tie))
    placed = materialize(positions(once, tie).select("position", shown_file(F.col("file")).alias("file"), tie), "placed")
    starts = placed.groupBy("file").agg(F.min("position").alias("group"))
    return placed.join(starts, "file").select("position", "file", "group", tie)


def shown_file(file: Column) -> Column:
    return F.when(file == "", "(repo)").otherwise(file)


def report_lines(violations: DataFrame) -> DataFrame:
    """``violation_id, text``: ``SEVERITY file:function:line: message [rule]``; an empty function or line 0 is left out."""
    place = F.concat_ws(":", shown_file(F.col("file")), F.when(F.col("function") != "", F.col("function")), F.when(F.col("line") > 0, F.col("line").cast("string")))
    return violations.select("violation_id", F.concat(F.upper("severity"), F.lit(" "), place, F.lit(": "), F.col("message"), F.lit(" ["), F.col("rule_id"), F.lit("]")).alias("text"))


def totals(violations: DataFrame) -> DataFrame:
    """One row: ``errors``, ``warnings`` (all that is no error), ``files`` and the ``exit_code``; zeros for no violations."""
    errors = F.count_if(F.col("severity") == "error")
    return violations.agg(errors.alias("errors"), F.count_if(F.col("severity") != "error").alias("warnings"), F.count_distinct(shown_file(F.col("file"))).alias("files"), (errors > 0).cast("int").alias("exit_code"))


def per_file(violations: DataFrame) -> DataFrame:
    """``file, errors, warnings, rules, first_line, repo_last``: ``repo_last`` puts the whole repository behind all names."""
    return violations.groupBy(shown_file(F.col("file")).alias("file")).agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") != "error").alias("warnings"),
        F.count_distinct("rule_id").alias("rules"), F.min(F.when(F.col("line") > 0, F.col("line"))).alias("first_line"),
    ).withColumn("repo_last", (F.col("file") == "(repo)").cast("int"))


def first_blocking(violations: DataFrame, least: str = "error", listed: tuple[str, ...] = ()) -> DataFrame:
    """Per file the first violation, by line, rule and id, that blocks: severity at or above ``least`` or a rule of ``listed``.

    Severities that are not known count as the gravest.
    """
    known = F.col("severity").isin("error", "warn", "info")
    rank = F.when(~known, 3).when(F.col("severity") == "error", 2).when(F.col("severity") == "warn", 1).otherwise(0)
    reach = {"error": 2, "warn": 1, "info": 0}[least]
    blocks = violations.where((rank >= reach) | F.col("rule_id").isin(*listed)) if listed else violations.where(rank >= reach)
    first = F.min(F.struct("line", "rule_id", "violation_id", "severity"))
    return blocks.groupBy("file").agg(first.alias("f"), F.count("*").alias("blocking")).select("file", "f.line", "f.rule_id", "f.violation_id", "f.severity", "blocking")


# The catalog's rules and their categories.
CATEGORIES = {
    "scope-guard": "contracts", "hardcoded-runtime-knob": "contracts", "function-quality": "quality", "hygiene.symbol_names": "hygiene",
    "hygiene.doc_style": "hygiene", "hygiene.documentation": "hygiene", "secret-keyword": "security", "structure.architecture": "structure",
    "structure.test_location": "structure", "file-size": "quality", "ai-compatibility": "contracts", "cli-formatter": "contracts", "go-version": "contracts",
    "custom-rule": "custom", "structure.package_rules": "structure",
}


def category(rule_id: Column) -> Column:
    """A rule's category: its own, ``custom`` for custom.*, that of its first part, else ``unlisted``."""
    out = F.lit("unlisted")
    for prefix, name in (("structure.", "structure"), ("function-quality.", "quality"), ("custom.", "custom")):
        out = F.when(rule_id.startswith(prefix), name).otherwise(out)
    for rule, name in CATEGORIES.items():
        out = F.when(rule_id == rule, name).otherwise(out)
    return out


def by_category(violations: DataFrame) -> DataFrame:
    """``category, rules, rows``, with the catalog's categories that have no rows."""
    spark = violations.sparkSession
    known = spark.createDataFrame([(c,) for c in sorted({*CATEGORIES.values(), "unlisted"})], "category string")
    seen = violations.groupBy(category(F.col("rule_id")).alias("category"), "rule_id").agg(F.count("*").alias("n"))
    return known.join(seen.groupBy("category").agg(F.count("*").alias("rules"), F.sum("n").alias("rows")), "category", "left").select(
        "category", F.coalesce("rules", F.lit(0)).alias("rules"), F.coalesce("rows", F.lit(0)).alias("rows")
    )
