"""Thresholds over facts and files: function quality and file size."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.functions.paths import starts_with_any, under_any
from corpusgate.functions.text import line_count


# All limits of the two classes, and the texts of the messages below.
@dataclass(frozen=True)
class FunctionLimits:
    """Limits of functions; lines per language as (warn, most)."""

    lines: dict[str, tuple[int, int]] = field(default_factory=lambda: {"go": (80, 120), "python": (100, 150), "typescript": (100, 160)})
    other_lines: tuple[int, int] = (100, 150)
    warn_params: int = 5
    most_params: int = 7
    mild: int = 12
    elevated: int = 14
    immediate: int = 16
    error: int = 18
    both_complexity: int = 10
    both_lines: int = 80
    nil_guards: int = 8
    languages: tuple[str, ...] = ("go", "python")


@dataclass(frozen=True)
class FileLimits:
    warn: int = 700
    most: int = 900
    warn_penalty: int = 10
    most_penalty: int = 15
    least_warn: int = 450
    least_most: int = 650
    gap: int = 150
    mild: int = 12
    hard: int = 18


def function_violations(facts: DataFrame, limits: FunctionLimits = FunctionLimits(), roots: tuple[str, ...] = ()) -> DataFrame:
    """``fact_id, rule_id, file, function, message, severity, line`` of functions and methods beyond ``limits``.

    One error ends the judgement of a function (both limits together, complexity, length, in this
    order); otherwise it may have several rows. Null numbers count as 0. ``roots``: only files
    below them, all files if there are none. One pass, no join.
    """
    lang, cx = F.col("language"), F.coalesce("complexity", F.lit(0))
    loc = F.coalesce(F.col("end_line") - F.col("line_number") + 1, F.lit(0))
    params, guards = F.coalesce("param_count", F.lit(0)), F.coalesce("repeated_nil_guards", F.lit(0))
    warn_lines, most_lines = F.lit(limits.other_lines[0]), F.lit(limits.other_lines[1])
    for name, (w, m) in limits.lines.items():
        warn_lines, most_lines = F.when(lang == name, w).otherwise(warn_lines), F.when(lang == name, m).otherwise(most_lines)
    base, mild = "function-quality", "function-quality.mild-ctx"

    def row(severity: str, text: str, *values: Column, rule: str = base) -> Column:
        return F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.format_string(text, F.col("symbol_name"), *values).alias("message"))

    hard = (
        F.when((cx >= limits.both_complexity) & (loc >= limits.both_lines), row("error", "function %s is both complex and long (CTX:%d, LOC:%d); must be refactored", cx, loc))
        .when(cx >= limits.error, row("error", "function %s is excessively complex (CTX:%d); hard limit is %d", cx, F.lit(limits.error)))
        .when(loc >= most_lines, row("error", "function %s is excessively long (LOC:%d); hard limit is %d", loc, most_lines))
    )
    soft = F.array(
        F.when(cx >= limits.immediate, row("warn", "function %s requires immediate refactoring (CTX:%d); exceeds refactor threshold %d", cx, F.lit(limits.immediate)))
        .when(cx >= limits.elevated, row("warn", "function %s has elevated complexity (CTX:%d); exceeds elevated threshold %d", cx, F.lit(limits.elevated)))
        .when(cx >= limits.mild, row("warn", "function %s has mild complexity (CTX:%d); exceeds mild threshold %d", cx, F.lit(limits.mild), rule=mild)),
        F.when(loc >= warn_lines, row("warn", "function %s is approaching size limit (LOC:%d); warn threshold is %d", loc, warn_lines)),
        F.when(params >= limits.most_params, row("error", "function %s has excessive parameters (%d); hard limit is %d", params, F.lit(limits.most_params)))
        .when(params >= limits.warn_params, row("warn", "function %s has many parameters (%d); warn threshold is %d", params, F.lit(limits.warn_params))),
        F.when(guards >= limits.nil_guards, row("warn", "function %s repeats plain nil-guard checks %d times; CTX may be inflated by distant repeated guards", guards)),
    )
    found = F.when(hard.isNotNull(), F.array(hard)).otherwise(F.filter(soft, lambda x: x.isNotNull()))
    inside = under_any(F.col("file_path"), list(roots)) if roots else F.lit(True)
    judged = facts.where(inside & lang.isin(*limits.languages) & F.col("symbol_kind").isin("function", "method"))
    return judged.select("fact_id", F.col("file_path").alias("file"), F.col("symbol_name").alias("function"), F.coalesce("line_number", F.lit(0)).alias("line"), F.explode(found).alias("v")).select(
        "fact_id", "v.rule_id", "file", "function", "v.message", "v.severity", "line"
    )


def file_penalties(facts: DataFrame, limits: FileLimits = FileLimits()) -> DataFrame:
    """``file, mild, hard``: functions of each file from the mild and the hard complexity."""
    return facts.where("file_path <> ''").groupBy(F.col("file_path").alias("file")).agg(
        F.count_if(F.col("complexity") >= limits.mild).alias("mild"), F.count_if(F.col("complexity") >= limits.hard).alias("hard")
    )


def file_thresholds(mild: Column, hard: Column, limits: FileLimits) -> tuple[Column, Column]:
    """Effective (warn, most) lines: penalties lower both down to floors, and a gap stays between them."""
    warn = F.greatest(F.lit(limits.warn) - mild * limits.warn_penalty, F.lit(limits.least_warn))
    most = F.greatest(F.lit(limits.most) - hard * limits.most_penalty, F.lit(limits.least_most))
    return warn, F.greatest(most, warn + limits.gap)


def file_verdicts(files: DataFrame, facts: DataFrame, limits: FileLimits = FileLimits(), roots: tuple[str, ...] = (), ignored: tuple[str, ...] = ()) -> DataFrame:
    """``file, lines, warn, most, severity`` of files with more lines than their thresholds allow; a file without facts has no penalty.

    ``roots``: only files below them, all if there are none; paths that start with one of
    ``ignored`` are left out.
    """
    inside = under_any(F.col("rel"), list(roots)) if roots else F.lit(True)
    sized = files.where(inside & ~starts_with_any(F.col("rel"), list(ignored))).select(F.col("rel").alias("file"), line_count(F.col("content")).alias("lines"))
    both = sized.join(file_penalties(facts, limits), "file", "left")
    warn, most = file_thresholds(F.coalesce("mild", F.lit(0)), F.coalesce("hard", F.lit(0)), limits)
    judged = both.select("file", "lines", warn.cast("int").alias("warn"), most.cast("int").alias("most"))
    return judged.withColumn("severity", F.when(F.col("lines") > F.col("most"), "error").when(F.col("lines") > F.col("warn"), "warn")).where("severity IS NOT NULL")
