"""Column expressions over identifiers, comments and documentation text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Casings of acronyms that names should not have, in the order of the check.
ACRONYM_FORMS = ("Http", "Url", "Id", "Json", "Xml", "Dsn", "Api")
# Openers that make a summary weak.
WEAK_OPENERS = ("this function", "this method", "helper")


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    """Pieces between ``\\n``: a trailing newline counts one more, an empty text is one line."""
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    return F.size(lines_of(text))


def reader_lines(text: Column) -> Column:
    """Lines as a line reader gives them: no trailing ``\\r``, no empty piece after the last newline."""
    pieces = F.transform(lines_of(text), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def token_count(name: Column) -> Column:
    """Camel-case words, acronym runs and underscore parts of an identifier; ``main`` has 2, '' has 0."""
    tokens = F.regexp_count(name, F.lit(r"[A-Z][a-z][^_A-Z]*|[A-Z](?:[A-Z](?![a-z]))*|[^_A-Z]+"))
    return F.when(name == "main", 2).otherwise(tokens)


def acronym_casing(name: Column) -> Column:
    """The first of ``ACRONYM_FORMS`` whose first occurrence is not followed by a lower-case letter; else null."""
    found = [
        F.when((F.instr(name, form) > 0) & ~F.substring(name, F.instr(name, form) + len(form), F.lit(1)).rlike(r"^\p{Ll}"), form) for form in ACRONYM_FORMS
    ]
    return F.coalesce(*found)


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def without_markers(line: Column) -> Column:
    """A comment line without ``//``, ``/*`` and ``*/``, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), r"^(//|/\*)", ""), r"\*/$", ""))


def has_todo(line: Column) -> Column:
    return line.rlike("(?i)todo|fixme")


def named_first(lines: Column, name: Column) -> Column:
    """Whether some line is the name, or starts with it and a blank."""
    return F.exists(lines, lambda x: (x == name) | x.startswith(F.concat(name, F.lit(" "))) | x.startswith(F.concat(name, F.lit("\t"))))


def first_line(text: Column) -> Column:
    """The first line that is not blank, trimmed; '' if there is none."""
    full = F.filter(F.transform(lines_of(text), lambda x: F.trim(F.regexp_replace(x, r"[\r\t]", " "))), lambda x: x != "")
    return F.coalesce(F.get(full, F.lit(0)), F.lit(""))


def first_tag_line(text: Column) -> Column:
    """The first line of a ``/** */`` block that says something and is no tag; '' if there is none."""
    said = F.transform(lines_of(text), lambda x: stripped(F.regexp_replace(F.regexp_replace(F.regexp_replace(stripped(x), r"^/\*\*", ""), r"^\*/", ""), r"^\s*\*", "")))
    return F.coalesce(F.get(F.filter(said, lambda x: (x != "") & ~x.startswith("@")), F.lit(0)), F.lit(""))


def summary_problem(summary: Column, name: Column) -> Column:
    """``empty``, ``symbol``, ``short`` (under 10 characters) or ``weak``; null for a good summary."""
    low = F.lower(summary)
    weak = F.lit(False)
    for opener in WEAK_OPENERS:
        weak = weak | low.startswith(opener)
    return (
        F.when(summary == "", "empty").when(F.regexp_replace(low, r"[.\s]+$", "") == F.lower(name), "symbol").when(F.length(summary) < 10, "short").when(weak, "weak")
    )


def needs_blank_line(text: Column) -> Column:
    """Two or more lines without a blank one, the first ending in ``.``, the second starting with no lower-case letter."""
    lines = F.transform(lines_of(text), lambda x: F.trim(x))
    second = F.substring(F.element_at(lines, 2), 1, 1)
    return F.when(F.size(lines) < 2, False).otherwise(
        ~F.exists(lines, lambda x: x == "") & F.element_at(lines, 1).endswith(".") & (second == F.upper(second))
    )


# Section headings of the documentation styles.
GOOGLE_ARGS, GOOGLE_RETURNS = r"(?dm)^\s*Args:\s*$", r"(?dm)^\s*(Returns|Yields):\s*$"
NUMPY_PARAMETERS, NUMPY_RETURNS = r"(?dm)^\s*Parameters\s*\n\s*-{3,}\s*$", r"(?dm)^\s*Returns\s*\n\s*-{3,}\s*$"


def missing_fields(text: Column, params: Column, mark: str = ":param ") -> Column:
    """Parameters without a field in ``text``: ``:param x:``, or ``@param x`` by prefix."""
    sign = ":" if mark.startswith(":") else ""
    return F.filter(params, lambda p: ~text.contains(F.concat(F.lit(mark), p, F.lit(sign))))


def cut_to(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def plural_noun(count: Column, noun: str) -> Column:
    return F.when(count == 1, noun).otherwise(noun + "s")


# Verbs whose plural is no shorter form.
IRREGULAR_VERBS = {"does": "do", "has": "have", "is": "are", "was": "were"}


def plural_verb(count: Column, singular: str) -> Column:
    """The verb as it goes with ``count``: irregular ones by list, else without ``es`` or ``s``."""
    regular = singular.removesuffix("es") if singular.endswith("es") else singular.removesuffix("s")
    return F.when(count == 1, singular).otherwise(IRREGULAR_VERBS.get(singular, regular))


def comment_doc_prefix(text: Column) -> Column:
    """The word group after the name in the first ``// Package`` line starts with A-Z."""
    line = F.regexp_extract(text, r"(?m)^// Package ([^\n\r]*)", 1)
    return F.regexp_extract(line, r"^\S+\s+(\S)", 1).rlike("^[A-Z]")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.round(F.reduce(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)), 6)
