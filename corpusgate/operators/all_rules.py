"""All rules in one run, as one relation of violations."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.operators import contracts, hygiene, quality, structure


@dataclass(frozen=True)
class Policy:
    """What the rules demand; empty roots stand for the whole repository, empty lists leave their rule out."""

    files: quality.FileLimits = field(default_factory=quality.FileLimits)
    functions: quality.FunctionLimits = field(default_factory=quality.FunctionLimits)
    production_roots: tuple[str, ...] = ()
    file_roots: tuple[str, ...] = ()
    function_roots: tuple[str, ...] = ()
    ignored_prefixes: tuple[str, ...] = ()
    test_roots: tuple[str, ...] = ("internal/tests",)
    calls: tuple[str, ...] = ()
    call_mode: str = "restrict"
    calls_allowed: tuple[str, ...] = ()
    print_forms: tuple[str, ...] = ("fmt.Print(", "fmt.Printf(", "fmt.Println(", "console.log(", "print(")
    flags: tuple[str, ...] = ()
    documentation: str = "strict"
    python_style: str = "google"
    typescript_style: str = "tsdoc"


_FACT = ("file_path", "symbol_name", "line_number")


def _row(df: DataFrame, rule: str | Column, severity: str | Column, file: str, message: Column, function: str | None = None, line: str | None = None) -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(
        text(rule).alias("rule_id"), F.coalesce(F.col(file), F.lit("")).alias("file"), F.coalesce(F.col(function), F.lit("")).alias("function") if function else F.lit("").alias("function"),
        message.alias("message"), text(severity).alias("severity"), F.coalesce(F.col(line).cast("int"), F.lit(0)).alias("line") if line else F.lit(0).alias("line"),
    )


def check(files: DataFrame, facts: DataFrame, rules: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``rule_id, file, function, message, severity, line`` of every rule over ``files`` and ``facts``; a bag, as the rules put it out.

    ``rules`` are the custom rules. A rule whose input is empty adds no rows, but the flags rule one.
    """
    of_fact = {"file": "file_path", "function": "symbol_name", "line": "line_number"}
    messages = rules.where("enabled").select(F.concat(F.lit("custom."), F.col("id")).alias("rule_id"), "message").dropDuplicates(["rule_id"])
    custom = contracts.rule_hits(files, rules, roots=policy.production_roots).join(F.broadcast(messages), "rule_id", "left")
    parts = [
        _row(quality.file_verdicts(files, facts, policy.files, policy.file_roots, policy.ignored_prefixes), "file-size", F.col("severity"), "file", F.format_string("%d lines, limits %d and %d", "lines", "warn", "most")),
        _row(quality.function_violations(facts, policy.functions, policy.function_roots), F.col("rule_id"), F.col("severity"), "file", F.col("message"), "function", "line"),
        _row(hygiene.symbol_name_violations(facts), "hygiene.symbol_names", "error", "file", F.col("problem"), "function", "line"),
        _row(hygiene.doc_style_problems(facts, keep=_FACT), "hygiene.doc_style", "error", message=F.col("problem"), **of_fact),
        _row(hygiene.documentation_problems(facts, policy.documentation, policy.python_style, policy.typescript_style, keep=_FACT), "hygiene.documentation", "error", message=F.col("problem"), **of_fact),
        _row(hygiene.header_problems(files, policy.documentation), "hygiene.documentation", "error", "rel", F.col("problem"), line="line"),
        _row(structure.misplaced_tests(files.select("rel"), list(policy.test_roots)), "structure.test_location", "error", "rel", F.lit("test outside of its roots")),
        _row(structure.package_verdicts(structure.package_stats(files)), "structure.package_rules", "error", "dir", F.col("problem")),
        _row(contracts.forbidden_prints(files, policy.print_forms), "cli-formatter", "error", "rel", F.col("form"), line="line"),
        _row(contracts.forbidden_calls(files, list(policy.calls), policy.call_mode, policy.calls_allowed), "scope-guard", "error", "rel", F.col("call")),
        _row(contracts.knob_sites(files), "hardcoded-runtime-knob", "warn", "rel", F.col("name"), line="line"),
        _row(custom, F.col("rule_id"), F.col("severity"), "rel", F.coalesce("message", F.lit("")), line="line"),
    ]
    if policy.flags:
        parts.append(_row(contracts.ai_compatibility(files, list(policy.flags)), "ai-compatibility", "error", "file", F.col("message")))
    return reduce(DataFrame.unionByName, parts)
