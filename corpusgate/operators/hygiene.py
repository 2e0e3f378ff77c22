"""Rules about names and documentation of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.functions import text as T
from corpusgate.functions.paths import extension, under_any

#: Names that need no second word.
EXEMPT = ("main", "init", "New", "Run", "String", "Error")


def symbol_name_violations(facts: DataFrame, least: int = 2, cross: int = 3, exempt: tuple[str, ...] = EXEMPT) -> DataFrame:
    """``fact_id, file, function, line, problem, tokens``: an acronym's casing first, else too few words.

    Exported names only; exempt ones may be functions, not methods. A path with ports, types or
    contracts in it needs ``cross`` words.
    """
    name, path = F.col("symbol_name"), F.col("file_path")
    needed = F.when(path.contains("ports") | path.contains("types") | path.contains("contracts"), cross).otherwise(least)
    judged = facts.where(name.rlike(r"^\p{Lu}") & ~((F.col("symbol_kind") == "function") & name.isin(*exempt)))
    problem = F.coalesce(F.concat(F.lit("acronym "), T.acronym_casing(name)), F.when(T.token_count(name) < needed, F.format_string("fewer than %d words", needed)))
    return judged.select("fact_id", path.alias("file"), name.alias("function"), F.col("line_number").alias("line"), problem.alias("problem"), T.token_count(name).alias("tokens")).where("problem IS NOT NULL")


def doc_style_problems(facts: DataFrame, least_words: int = 5, keep: tuple[str, ...] = ("fact_id",)) -> DataFrame:
    """``keep, problem``: documentation that does not name its symbol first, holds a TODO, or is short; several may hold."""
    doc = F.col("docstring")
    lines = F.transform(T.lines_of(doc), T.without_markers)
    problems = F.array(
        F.when(~T.named_first(lines, F.col("symbol_name")), "name"),
        F.when(F.exists(lines, T.has_todo), "todo"),
        F.when(T.word_count(F.array_join(lines, " ")) < least_words, "short"),
    )
    return facts.where(F.trim(doc) != "").select(*keep, F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))


def summary_problems(facts: DataFrame) -> DataFrame:
    """``fact_id, summary, problem`` of Python and TypeScript facts whose first line is no good summary."""
    first = T.first_line(F.col("docstring"))
    judged = facts.where(F.col("language").isin("python", "typescript"))
    return judged.select("fact_id", T.cut_to(first).alias("summary"), T.summary_problem(first, F.col("symbol_name")).alias("problem")).where("problem IS NOT NULL")


def missing_parameters(facts: DataFrame) -> DataFrame:
    """``fact_id, style, param`` of documented parameters' absence: reST and TSDoc marks, and Google or NumPy sections.

    ``style`` is the one that the docstring shows: google, numpy, tsdoc for TypeScript, else rest.
    """
    doc = F.col("docstring")
    google, numpy = doc.rlike(T.GOOGLE_ARGS), doc.rlike(T.NUMPY_PARAMETERS)
    style = F.when(F.col("language") == "typescript", "tsdoc").when(google, "google").when(numpy, "numpy").otherwise("rest")
    params = F.filter(F.coalesce("params", F.array().cast("array<string>")), lambda p: ~p.isin("self", "cls", ""))
    absent = (
        F.when(style == "tsdoc", T.missing_fields(doc, params, "@param "))
        .when(style == "rest", T.missing_fields(doc, params))
        .otherwise(F.filter(params, lambda p: ~doc.contains(F.concat(p, F.lit(":")))))
    )
    judged = facts.where(F.col("language").isin("python", "typescript") & (F.trim(doc) != ""))
    return judged.select("fact_id", style.alias("style"), F.explode(absent).alias("param"))


def paragraph_gaps(facts: DataFrame) -> DataFrame:
    """``fact_id, needs_gap`` of every documented fact: whether a blank line is missing after the summary."""
    return facts.where(F.trim("docstring") != "").select("fact_id", T.needs_blank_line(F.col("docstring")).alias("needs_gap"))


#: Comment sign of the files that carry a header.
COMMENT_SIGNS = {".go": "//", ".ts": "//", ".py": "#"}


def header_status(files: DataFrame, window: int = 6) -> DataFrame:
    """``rel, status, described``: the path header of Go, TypeScript and Python files.

    ``status``: ``ok`` if one of the first ``window`` lines is the comment with the file's path,
    ``stale`` if one is a comment of another path with the same extension, else ``missing``.
    ``described``: comment lines right behind the header, up to the first other line or empty comment.
    """
    ext, sign = extension(F.col("rel")), F.lit(None).cast("string")
    for e, s in COMMENT_SIGNS.items():
        sign = F.when(ext == e, s).otherwise(sign)
    lines = F.transform(T.reader_lines(F.col("content")), lambda x: F.trim(x))
    rows = files.select("rel", sign.alias("sign"), ext.alias("ext"), lines.alias("lines")).where("sign IS NOT NULL")
    head = F.slice("lines", 1, window)
    said = lambda x: F.when(x.startswith(F.col("sign")), F.trim(F.substring(x, F.length("sign") + 1, F.length(x))))
    spoken = F.transform(head, said)
    ok_at = F.coalesce(F.array_position(spoken, F.col("rel")), F.lit(0))
    stale = F.exists(spoken, lambda s: s.contains("/") & ~s.contains(" ") & s.endswith(F.col("ext")))
    after = F.transform(F.slice("lines", ok_at.cast("int") + 1, F.size("lines")), said)
    stop = F.array_position(F.transform(after, lambda s: F.coalesce(s == "", F.lit(True))), True)
    described = F.when(ok_at == 0, 0).when(stop == 0, F.size(after)).otherwise(stop - 1)
    status = F.when(ok_at > 0, "ok").when(F.coalesce(stale, F.lit(False)), "stale").otherwise("missing")
    return rows.select("rel", status.alias("status"), described.cast("int").alias("described"))


#: Documentation styles of a language.
PYTHON_STYLES = ("presence_only", "standard", "google", "numpy", "restructuredtext")
TYPESCRIPT_STYLES = ("presence_only", "standard", "tsdoc")


def documentation_problems(facts: DataFrame, level: str = "strict", python_style: str = "google", typescript_style: str = "tsdoc", keep: tuple[str, ...] = ("fact_id",)) -> DataFrame:
    """``keep, problem`` of Python and TypeScript facts: missing documentation, else what its style demands; several may hold.

    ``loose`` only asks for documentation. A bad summary ends the judgement of a fact. Parameters
    ``self`` and ``cls`` need no words.
    """
    if level not in ("strict", "loose") or python_style not in PYTHON_STYLES or typescript_style not in TYPESCRIPT_STYLES:
        raise ValueError(f"unknown level or style: {level}, {python_style}, {typescript_style}")
    doc, python = F.col("docstring"), F.col("language") == "python"
    params = F.filter(F.coalesce("params", F.array().cast("array<string>")), lambda p: ~p.isin("self", "cls", ""))
    lacking = lambda cond, text: F.when(cond, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    each = lambda mark: F.transform(T.missing_fields(doc, params, mark), lambda p: F.concat(F.lit("missing " + mark), p))
    summary = F.when(python, T.first_line(doc)).otherwise(T.first_tag_line(doc))
    bad = T.summary_problem(summary, F.col("symbol_name"))
    floor = F.when(bad.isNotNull(), F.array(F.concat(F.lit("summary "), bad)))
    some = F.size(params) > 0
    demands = {
        "presence_only": lacking(F.lit(False), ""),
        "standard": lacking(F.lit(False), ""),
        "google": F.concat(lacking(some & ~doc.rlike(T.GOOGLE_ARGS), "missing Args"), lacking(~doc.rlike(T.GOOGLE_RETURNS), "missing Returns")),
        "numpy": F.concat(lacking(some & ~doc.rlike(T.NUMPY_PARAMETERS), "missing Parameters"), lacking(~doc.rlike(T.NUMPY_RETURNS), "missing Returns")),
        "restructuredtext": F.concat(each(":param "), lacking(~doc.contains(":returns:") & ~doc.contains(":return:"), "missing :returns:")),
        "tsdoc": F.concat(each("@param "), lacking(~doc.contains("@return"), "missing @returns")),
    }
    of = lambda style: demands[style] if style == "presence_only" else F.coalesce(floor, demands[style])
    block = F.when(~T.stripped(doc).startswith("/**"), F.array(F.lit("no documentation block"))) if typescript_style == "tsdoc" else F.lit(None).cast("array<string>")
    strict = F.when(python, of(python_style)).otherwise(F.coalesce(block, of(typescript_style)))
    found = F.when(T.stripped(doc) == "", F.array(F.lit("missing documentation"))).otherwise(strict if level == "strict" else F.array().cast("array<string>"))
    return facts.where(F.col("language").isin("python", "typescript") & F.col("symbol_kind").isin("function", "method")).select(*keep, F.explode(found).alias("problem"))


SHEBANG = "#!/usr/bin/env python3"


def header_problems(files: DataFrame, level: str = "loose", shebang_roots: tuple[str, ...] = (), window: int = 6, least: int = 2, most: int = 5) -> DataFrame:
    """``rel, line, problem`` of Go, TypeScript and Python files whose path header or description is not as demanded.

    ``strict`` wants the header on the first line, or the second behind a shebang, which Python
    files below ``shebang_roots`` must have; ``loose`` within ``window`` lines. Right behind the
    header come ``least`` to ``most`` comment lines that say something. Null contents give no rows.
    """
    if level not in ("strict", "loose"):
        raise ValueError(f"unknown level {level}")
    ext, sign = extension(F.col("rel")), F.lit(None).cast("string")
    for e, s in COMMENT_SIGNS.items():
        sign = F.when(ext == e, s).otherwise(sign)
    rows = files.select("rel", ext.alias("ext"), sign.alias("sign"), F.transform(T.lines_of(F.col("content")), T.stripped).alias("lines")).where("sign IS NOT NULL AND lines IS NOT NULL")
    first = F.element_at("lines", 1)
    wanted = (F.col("ext") == ".py") & under_any(F.col("rel"), list(shebang_roots)) if level == "strict" else F.lit(False)
    start = F.when((F.col("ext") == ".py") & F.when(wanted, first == SHEBANG).otherwise(first.startswith("#!")), 2).otherwise(1)
    said = F.transform("lines", lambda x: F.when(x.startswith(F.col("sign")), T.stripped(F.substring(x, F.length("sign") + 1, F.length(x)))).otherwise(""))
    placed = rows.select("rel", said.alias("said"), start.alias("start"), (wanted & (first != SHEBANG)).alias("bare"))
    within = F.slice("said", F.col("start"), F.lit(1 if level == "strict" else window))
    at = F.array_position(within, F.col("rel")).cast("int")
    header = F.when(at > 0, F.col("start") + at - 1)
    judged = placed.select("rel", "said", "start", "bare", header.alias("header"))
    after = F.slice("said", F.col("header") + 1, F.size("said"))
    stop = F.array_position(after, "")
    n = F.when(stop == 0, F.size(after)).otherwise(stop - 1).cast("int")
    problem = lambda line, text: F.struct(line.cast("int").alias("line"), text.alias("problem"))
    found = F.array(
        F.when(F.col("bare"), problem(F.lit(1), F.lit("missing shebang"))),
        F.when(F.col("header").isNull(), problem(F.col("start"), F.lit("header is incorrect" if level == "strict" else "header is missing"))),
        F.when(F.col("header").isNotNull() & ((n < least) | (n > most)), problem(F.col("header") + 1, F.format_string("description has %d line(s)", n))),
    )
    return judged.select("rel", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("p")).select("rel", "p.line", "p.problem")
