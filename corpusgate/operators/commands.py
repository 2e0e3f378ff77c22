"""Commands of macros and gates: kinds, parts and templates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.operators.skew import latest_rows

# Package managers, the words that install, and the ecosystem of each.
MANAGERS = {"go": (("get", "install"), "Go"), "npm": (("install", "i", "add", "ci"), "npm"), "pip": (("install",), "PyPI"), "uv": (("add", "pip"), "PyPI"), "pnpm": (("add",), "npm"), "yarn": (("add",), "npm")}
TOOLS = ("go", "npm", "npx", "pip", "uv", "pytest", "eslint", "mypy", "ruff", "make", "docker", "gofumpt", "golangci-lint", "staticcheck")


def simple_commands(strings: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, part, command``: the commands of a string, split at ``&&``, ``;`` and new lines; continued lines are one.

    Separators inside quotes are not looked at, as in the reference's chains; blank parts are left out.
    """
    joined = F.regexp_replace(text, r"\\\r?\n\s*", "")
    parts = F.filter(F.transform(F.split(joined, r"\s*&&\s*|;\s|\n"), lambda x: F.trim(x)), lambda x: x != "")
    return strings.where(F.col(text).isNotNull()).select(*keys, F.posexplode(parts).alias("part", "command"))


def command_kind(command: Column, macros: tuple[str, ...] = ("run-job",)) -> Column:
    """``macro`` before ``format`` (fmt headers) before ``package`` (a manager's installing word) before ``tool`` before ``passthrough``."""
    args = F.split(command, r"\s+")
    first, second = F.get(args, F.lit(0)), F.get(args, F.lit(1))
    package = F.lit(False)
    for manager, (actions, _) in MANAGERS.items():
        package = package | ((first == manager) & F.coalesce(second.isin(*actions), F.lit(False)))
    return (
        F.when(first.isin(*macros), "macro").when((first == "fmt") & (second == "headers"), "format").when(package, "package").when(first.isin(*TOOLS), "tool").otherwise("passthrough")
    )


def install_requests(commands: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, manager, action, ecosystem, packages``: installing commands with the named packages, options left out."""
    args = F.split("command", r"\s+")
    ecosystem = F.lit(None).cast("string")
    for manager, (_, name) in MANAGERS.items():
        ecosystem = F.when(F.get(args, F.lit(0)) == manager, name).otherwise(ecosystem)
    packages = F.filter(F.slice(args, F.lit(3), F.size(args)), lambda a: ~a.startswith("-"))
    return commands.where(command_kind(F.col("command")) == "package").select(*keys, args[0].alias("manager"), args[1].alias("action"), ecosystem.alias("ecosystem"), F.array_join(packages, " ").alias("packages"))


def placeholders(strings: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, name``: distinct ``{{.name}}`` placeholders of a string."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"\{\{\s*\.?(\w+)\s*\}\}"), F.lit(1))
    return strings.where(F.col(text).isNotNull()).select(*keys, F.explode(F.array_distinct(found)).alias("name"))


def failure_mode(on_failure: Column) -> Column:
    """``stop`` or ``continue`` in any spelling; missing and empty are ``stop``, anything else ``invalid``."""
    low = F.lower(F.trim(F.coalesce(on_failure, F.lit(""))))
    return F.when(low.isin("", "stop"), "stop").when(low == "continue", "continue").otherwise("invalid")


def macro_lint(macros: DataFrame) -> DataFrame:
    """``macro_id, mode, steps, problems``: of each macro once, as last ingested; problems joined by commas, '' for none."""
    clean = F.filter(F.coalesce("steps", F.array().cast("array<string>")), lambda s: F.coalesce(F.trim(s) != "", F.lit(False)))
    once = latest_rows(macros, "macro_id", "ingested_at", ["name", "description", "steps", "on_failure"])
    size = F.size(F.coalesce("steps", F.array().cast("array<string>")))
    problems = F.array(
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name"),
        F.when(F.size(clean) == 0, "no steps"),
        F.when((F.size(clean) > 0) & (F.size(clean) < size), "blank step"),
        F.when(F.col("description").isNull(), "no description"),
        F.when(failure_mode(F.col("on_failure")) == "invalid", "bad mode"),
    )
    return once.select("macro_id", failure_mode(F.col("on_failure")).alias("mode"), F.size(clean).alias("steps"), F.array_join(problems, ",").alias("problems"))


_ATOM = re.compile(r"\\(.)|'((?:\\.|[^'\\])*)'|\"((?:\\.|[^\"\\])*)\"|([^'\"\\ \t\n]+)|([ \t\n]+)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def split_tokens(text: str) -> tuple[list[str] | None, str | None]:
    """The words of a command by shell-like quotes and escapes, or an error; empty quoted words vanish."""
    words, word, at = [], "", 0
    while m := _ATOM.match(text, at):
        escaped, single, double, plain, blank = m.groups()
        if blank is not None:
            words += [word] if word else []
            word = ""
        else:
            quoted = single if single is not None else double
            word += escaped or plain or _ESCAPED.sub(r"\1", quoted or "")
        at = m.end()
    if at < len(text):
        # What is left is an open quote or a last sign of escape; an escape inside an open quote counts first.
        tail = text[at:]
        ends = len(tail) - len(tail.rstrip("\\"))
        return None, "trailing escape" if ends % 2 else "unterminated quote"
    return words + ([word] if word else []), None


def tokens(strings: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, tokens, error`` of every string that is not null: its words, or why it has none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in strings.select(*keys).schema) + ", tokens array<string>, error string"

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from corpusgate.operators.commands import split_tokens

        for pdf in batches:
            made = [split_tokens(t) for t in pdf["__text"]]
            out = pdf[keys].copy()
            out["tokens"], out["error"] = [t for t, _ in made], [e for _, e in made]
            yield out

    return strings.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text")).mapInPandas(split, schema)


_TEMPLATE = r"\{\{\.([A-Za-z0-9_-]+)\}\}"


def interpolated(text: Column, values: dict[str, str]) -> Column:
    """``text`` with ``{{.name}}`` replaced by the values, as a struct ``command, missing``: a missing name (the last) leaves no command.

    What a value holds is not looked at again.
    """
    names = F.regexp_extract_all(text, F.lit(_TEMPLATE), F.lit(1))
    pieces = F.split(text, _TEMPLATE, -1)
    known = F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.create_map().cast("map<string,string>")
    filled = F.transform(names, lambda n: F.element_at(known, n))
    missing = F.element_at(F.reverse(F.filter(names, lambda n: F.element_at(known, n).isNull())), 1)
    some = F.size(F.filter(filled, lambda v: v.isNull())) > 0
    joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(filled, i), F.lit("")))), "")
    return F.struct(F.when(~some, joined).alias("command"), F.when(some, missing).alias("missing"))


def chain_parts(args: Column, sign: str = "-then") -> Column:
    """``gate, main, chained``: the words before and behind the first ``sign``; without it all are the main part."""
    at = F.array_position(args, sign).cast("int")
    return F.struct(F.when(at > 0, F.slice(args, F.lit(1), at - 1)).alias("gate"), F.when(at > 0, F.slice(args, at + 1, F.size(args))).otherwise(args).alias("main"), (at > 0).alias("chained"))


def macro_failures(macros: DataFrame, values: dict[str, str]) -> DataFrame:
    """``macro_id, mode, failures``: why steps of each macro (as last ingested) cannot run, as ``step N: reason``.

    In mode ``continue`` all of them, joined by ``; ``; else the first only. Reasons: a template
    name without value, a broken quote or escape, nothing to run. Macros without failures and null
    steps are left out.
    """
    once = latest_rows(macros.where("macro_id IS NOT NULL"), "macro_id", "ingested_at", ["steps", "on_failure"])
    steps = once.select("macro_id", failure_mode(F.col("on_failure")).alias("mode"), F.posexplode("steps").alias("pos", "step")).where("step IS NOT NULL")
    made = steps.withColumn("__c", interpolated(F.col("step"), values)).select("macro_id", "mode", "pos", F.col("__c.missing").alias("missing"), F.coalesce("__c.command", F.lit("")).alias("command"))
    judged = tokens(made, ["macro_id", "mode", "pos", "missing"], "command")
    reason = F.coalesce(F.concat(F.lit("missing template variable "), F.col("missing")), F.col("error"), F.when(F.size("tokens") == 0, "empty command"))
    failed = judged.select("macro_id", "mode", "pos", reason.alias("reason")).where("reason IS NOT NULL")
    # A macro's steps are one row of the table, so they fit in one array.
    listed = failed.groupBy("macro_id", "mode").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("step "), F.col("pos") + 1, F.lit(": "), F.col("reason")).alias("t")))).alias("f"))
    texts = F.transform("f", lambda x: x["t"])
    return listed.select("macro_id", "mode", F.when(F.col("mode") == "continue", F.array_join(texts, "; ")).otherwise(F.element_at(texts, 1)).alias("failures"))
