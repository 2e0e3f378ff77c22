"""Path headers put into source files, as array expressions over their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.functions.paths import directory, extension
from corpusgate.functions.text import lines_of

DEFAULT_SHEBANG = "#!/usr/bin/env python3"
EXTENSIONS = {"go": [".go"], "typescript": [".ts", ".tsx"], "python": [".py"]}
# Directories below which no header is written.
SKIPPED_DIRECTORIES = (".git", ".venv", "venv", "node_modules", "__pycache__", ".mypy_cache", ".ruff_cache", "dist", "build", "vendor")


def _from(lines: Column, start: Column | int) -> Column:
    """The lines from number ``start``, counted from 1."""
    return F.slice(lines, start if isinstance(start, Column) else F.lit(start), F.size(lines) + 1)


def _first_not(lines: Column, test) -> Column:
    """Number, from 1, of the first line that fails ``test``; one past the end if none does."""
    at = F.array_position(F.transform(lines, lambda x: test(x)), False).cast("int")
    return F.coalesce(F.nullif(at, F.lit(0)), F.size(lines) + 1)


def _is_path(sign: str, exts: list[str]):
    pattern = rf"^{sign}\s*\S*[^\s/]\S*(?:" + "|".join(e.replace(".", r"\.") for e in exts) + r")\s*$"
    return lambda line: line.rlike(pattern)


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _headed(lines: Column, rel: Column, language: str) -> Column:
    """``lines`` with the path's comment in its place."""
    if language == "python":
        is_path, first = _is_path("#", EXTENSIONS["python"]), F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
        behind = F.when(first.startswith("#!"), _from(lines, 2)).otherwise(lines)
        rest = lambda body: F.when(F.coalesce(is_path(F.get(body, F.lit(0))), F.lit(False)), _from(body, 2)).otherwise(body)
        return F.concat(F.array(F.when(first.startswith("#!"), first).otherwise(DEFAULT_SHEBANG), F.concat(F.lit("# "), rel)), _let(behind, rest))
    is_path = _is_path("//", EXTENSIONS[language])

    def placed(body: Column) -> Column:
        at = F.lit(1)
        if language == "go":
            behind = _first_not(body, lambda x: x.startswith("//go:build") | x.startswith("// +build"))
            at = _let(behind, lambda b: b + _first_not(_from(body, b), lambda x: x == "") - 1)
        return _let(at, lambda k: put(body, k))

    def put(body: Column, at: Column) -> Column:
        gap = F.when(F.coalesce(F.get(body, at - 1), F.lit("")).startswith("//"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.slice(body, F.lit(1), at - 1), F.array(F.concat(F.lit("// "), rel)), gap, _from(body, at))

    without = lambda k: F.concat(F.filter(F.slice(lines, F.lit(1), k - 1), lambda x: ~is_path(x)), _from(lines, k))
    return _let(_let(_first_not(lines, lambda x: (x == "") | x.startswith("//")), without), placed)


def with_header(content: Column, rel: Column, language: str) -> Column:
    """``content`` with the comment of its own path on top, in place of other path headers.

    Go: behind build constraints; Go and TypeScript: set off from a comment that follows. Python:
    behind the shebang, which is added where there is none. The newline style is kept, and the
    text ends with a newline.
    """
    crlf = content.contains("\r\n")
    pieces = lines_of(F.replace(content, F.lit("\r\n"), F.lit("\n")))
    end = F.when(crlf, "\r\n").otherwise("\n")
    made = _let(pieces, lambda p: _let(F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p), lambda lines: _headed(lines, rel, language)))
    return _let(made, lambda lines: F.concat(F.when(crlf, F.array_join(lines, "\r\n")).otherwise(F.array_join(lines, "\n")), end))


def has_header(content: Column, rel: Column, language: str, window: int = 6) -> Column:
    """Whether the first path header among the first ``window`` lines is the file's own."""
    sign = "#" if language == "python" else "//"
    is_path = _is_path(sign, EXTENSIONS[language])
    head = F.slice(F.transform(lines_of(content), lambda x: F.regexp_replace(x, "\r$", "")), 1, window)
    first = F.get(F.filter(head, lambda x: is_path(x)), F.lit(0))
    return F.coalesce(first == F.concat(F.lit(sign + " "), rel), F.lit(False))


def skipped(rel: Column) -> Column:
    """Whether one of the directories above the file is left out."""
    return F.arrays_overlap(F.split(directory(rel), "/"), F.array(*map(F.lit, SKIPPED_DIRECTORIES)))


def formatted(files: DataFrame, only: tuple[str, ...] = ("go", "python", "typescript")) -> DataFrame:
    """``rel, language, changed, content``: every file of the languages with its header put right, but for skipped directories."""
    unknown = set(only) - set(EXTENSIONS)
    if unknown:
        raise ValueError(f"unsupported languages {sorted(unknown)}")
    ext, language, made = extension(F.col("rel")), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in only:
        mine = ext.isin(*EXTENSIONS[name])
        language = F.when(mine, name).otherwise(language)
        content, rel = F.col("content"), F.col("rel")
        made = F.when(mine & has_header(content, rel, name), content).when(mine, with_header(content, rel, name)).otherwise(made)
    rows = files.select("rel", language.alias("language"), "content", made.alias("made")).where(F.col("language").isNotNull() & ~skipped(F.col("rel")))
    return rows.select("rel", "language", (F.col("made") != F.col("content")).alias("changed"), F.col("made").alias("content"))


def run_report(files: DataFrame, only: tuple[str, ...] = ("go", "python", "typescript")) -> DataFrame:
    """One row per language: files ``checked`` and ``modified``."""
    return formatted(files, only).groupBy("language").agg(F.count("*").alias("checked"), F.count_if("changed").alias("modified"))
