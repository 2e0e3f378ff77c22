import math
import posixpath
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusgate.functions import paths as P
from corpusgate.functions import severity as S
from corpusgate.functions import text as T


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clean_path(spark):
    given_ = ["", ".", None, "./internal/a", "internal\\a\\..\\tests", " a//b/./c ", "../x/../y", "/../a", "a/..", "plain/path.go"]
    assert apply(spark, given_, P.clean_path) == ["", "", "", "internal/a", "internal/tests", "a/b/c", "../y", "/a", "", "plain/path.go"]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bc", "..", ".", ""]), min_size=1, max_size=6).map("/".join), min_size=60, max_size=60))
def test_clean_path_equals_the_library(spark, values):
    want = ["" if posixpath.normpath(v) == "." or not v else re.sub("^//", "/", posixpath.normpath(v)) for v in values]
    assert apply(spark, values, P.clean_path) == want


def test_prefixes_respect_boundaries(spark):
    got = apply(spark, ["internal/engine", "internal/engine/a", "internal/engineer", ""], lambda c: P.under_any(c, ["internal/engine", ""]))
    assert got == [True, True, False, False]
    assert apply(spark, ["zz_a", "b"], lambda c: P.starts_with_any(c, ["zz"])) == [True, False]


def test_globs(spark):
    for glob, path, want in (
        ("internal/app/*.go", "internal/app/main.go", True), ("internal/**/*.go", "internal/app/sub/main.go", True), ("internal/**/*.go", "cmd/main.go", False),
        ("internal/**/*.go", "internal/main.go", False), ("*.go", "a/b.go", False),
    ):
        assert bool(re.search(P.glob_regex(glob), path)) is want
        assert apply(spark, [glob], P.glob_regex_column) == [P.glob_regex(glob)]
    assert apply(spark, [None, ""], P.glob_regex_column) == ["", ""]


def test_relative_and_parts(spark):
    df = spark.createDataFrame([("a/b/c", "a/b"), ("a/x", "a/b"), ("a", "a"), ("c", "a/b")], "p string, r string")
    assert [r[0] for r in df.select(P.relative_to(F.col("p"), F.col("r"))).collect()] == ["c", "../x", "", "../../c"]
    assert apply(spark, ["a/b.PY", "x", ".env"], P.extension) == [".py", "", ".env"]
    assert apply(spark, ["a/b/c.go", "x"], P.directory) == ["a/b", "."]
    assert apply(spark, ["C:\\repo", "/a", "a", "\\\\host"], P.is_absolute) == [True, True, False, True]


NAMES = {"ValidateSchema": 2, "parseGoAST": 3, "HTTPHandler": 2, "validate": 1, "v": 1, "XMLParser": 2, "NewJSONEncoder": 3, "main": 2, "my_symbol": 2, "My_Symbol": 2, "DB": 1, "UserByID": 3, "": 0, "A1b": 2}


def test_token_count(spark):
    assert apply(spark, list(NAMES), T.token_count) == list(NAMES.values())


def test_acronym_casing(spark):
    assert apply(spark, ["HttpClient", "HttpsOnly", "UserId", "IdentityId", "Plain", "", "JsonXml"], T.acronym_casing) == ["Http", None, "Id", None, None, None, "Json"]


def test_lines(spark):
    assert apply(spark, ["", "a", "a\n", "a\nb"], T.line_count) == [1, 1, 2, 2]
    assert apply(spark, ["", "a\r\nb\n", "a\n\n"], T.reader_lines) == [[], ["a", "b"], ["a", ""]]


def test_summaries(spark):
    df = spark.createDataFrame([("", "f"), ("f.", "f"), ("Short one", "f"), ("This function does it all", "f"), ("Reads the whole table.", "f")], "s string, n string")
    assert [r[0] for r in df.select(T.summary_problem(F.col("s"), F.col("n"))).collect()] == ["empty", "symbol", "short", "weak", None]
    assert apply(spark, ["One.\nTwo", "One.\n\nTwo", "One\nTwo", "One.\ntwo", "One."], T.needs_blank_line) == [True, False, False, False, False]


def test_entropy(spark):
    got = apply(spark, ["", "aaaa", "abab", "abcd"], T.entropy)
    assert got == [0.0, 0.0, 1.0, 2.0] and math.isclose(apply(spark, ["aab"], T.entropy)[0], 0.918296, abs_tol=1e-6)


def test_severities(spark):
    assert apply(spark, ["WARNING", " Error", None, "x"], S.violation_severity) == ["warn", "error", "", "x"]
    assert apply(spark, ["medium", "CRITICAL", "odd", None], S.advisory_rank) == [2, 4, None, None]
    df = spark.createDataFrame([("high", "high"), ("high", "critical"), ("", "low"), ("critical", "odd"), (None, "low")], "o string, b string")
    assert [r[0] for r in df.select(S.override_covers(F.col("o"), F.col("b"))).collect()] == [True, False, False, True, False]


def test_cut_and_plural(spark):
    assert apply(spark, ["a" * 201, "b"], T.cut_to) == ["a" * 200 + "...", "b"]
    assert apply(spark, [1, 2], lambda c: T.plural_noun(c, "file"), "int") == ["file", "files"]
    assert pytest.approx(1) == 1
