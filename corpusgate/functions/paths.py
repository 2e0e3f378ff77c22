"""Column expressions over paths and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """Trimmed, ``\\`` as ``/``, ``.`` and ``..`` resolved, no leading ``./``; null and ``.`` give ''.

    A ``..`` above the start is kept in a relative path and dropped in an absolute one.
    """
    text = F.translate(F.trim(F.coalesce(path, F.lit(""))), "\\", "/")
    rooted = text.startswith("/")
    none = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        above = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return (
            F.when((part == "") | (part == "."), acc)
            .when((part == "..") & above, F.slice(acc, 1, F.size(acc) - 1))
            .when((part == "..") & rooted, acc)
            .otherwise(F.concat(acc, F.array(part)))
        )

    parts = F.reduce(F.split(text, "/"), none, step)
    plain = ~text.rlike(r"(^|/)\.{0,2}(/|$)")
    return F.when(plain | (text == ""), text).when(rooted, F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(F.array_join(parts, "/"))


def is_absolute(path: Column) -> Column:
    """POSIX root, UNC or drive letter."""
    return F.trim(path).rlike(r"^(/|\\\\|[A-Za-z]:[\\/])")


def relative_to(path: Column, root: Column) -> Column:
    """``path`` seen from ``root``, both cleaned, with ``..`` for the rest; '' where they are equal."""
    a, b = F.filter(F.split(path, "/"), lambda x: x != ""), F.filter(F.split(root, "/"), lambda x: x != "")
    common = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda n: (n <= F.size(a)) & (n <= F.size(b)) & (F.slice(a, 1, n) == F.slice(b, 1, n))))
    up = F.array_repeat(F.lit(".."), F.size(b) - common)
    return F.array_join(F.concat(up, F.slice(a, common + 1, F.size(a))), "/")


def directory(path: Column) -> Column:
    """What stands before the last ``/``; ``.`` for a file at the root."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The last dot of the base name and what follows, in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def under_any(path: Column, prefixes: list[str]) -> Column:
    """Whether ``path`` is one of ``prefixes`` or below one; empty prefixes never match."""
    out = F.lit(False)
    for p in prefixes:
        if p:
            out = out | (path == p) | path.startswith(p + "/")
    return out


def starts_with_any(path: Column, prefixes: list[str]) -> Column:
    """Plain string prefixes, without regard to path boundaries."""
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def glob_regex(glob: str) -> str:
    """``**`` is anything, ``*`` anything but ``/``, a dot is a dot; all else stays a regular expression."""
    pieces = re.split(r"(\*\*|\*|\.)", glob)
    named = {"**": ".*", "*": "[^/]*", ".": r"\."}
    return "^" + "".join(named.get(p, p) for p in pieces) + "$"


def glob_regex_column(glob: Column) -> Column:
    """``glob_regex`` of a column; null and empty match every path."""
    text = F.replace(glob, F.lit("."), F.lit("\\."))
    text = F.replace(text, F.lit("**"), F.lit("\x00"))
    text = F.replace(F.replace(text, F.lit("*"), F.lit("[^/]*")), F.lit("\x00"), F.lit(".*"))
    return F.when(glob.isNull() | (glob == ""), F.lit("")).otherwise(F.concat(F.lit("^"), text, F.lit("$")))
