import pytest
from pyspark.sql import functions as F

from corpusgate.functions import severity as S
from corpusgate.operators import all_rules, commands, contracts, headers, hygiene, quality, structure
from corpusgate.schema import FACT

FILES = "rel string, content string"


def test_go_versions(spark):
    def run(*files):
        return pytest.rows(contracts.check_go_version(spark.createDataFrame(list(files), FILES), ("1.24",)), "rule_id", "line", "message")

    assert run(("a.go", "")) == [("go-version", 0, "missing go.mod")]
    assert run(("go.mod", "module m\n")) == [("go-version", 0, "missing go")]
    assert run(("go.mod", "go 1.9\n  go 1.24.1\r\ntoolchain t\n"), ("Dockerfile", "FROM golang:1.24.1\n")) == []
    got = run(("go.mod", "go 1.30"), (".gitlab-ci.yml", "x\nimage: golang:1.22 \nGO_VERSION 1.30.1.2"))
    assert got == [("go-version", 0, "missing toolchain"), ("go-version", 0, "version 1.30 is not allowed"), ("go-version-mismatch", 2, "go.mod is 1.30 but found: image: golang:1.22")]
    none = contracts.go_directives(spark.createDataFrame([("a", None), ("b", "")], FILES))
    assert pytest.rows(none) == [("b", None, None)]


def test_flags(spark):
    run = lambda files, flags: pytest.rows(contracts.ai_compatibility(spark.createDataFrame(files, FILES), flags))
    thin, some, all_ = ("cmd/a.go", "x.RunCLI(1)"), ("b.go", "RunCLI( flag.Parse --one"), ("c.go", "--one --two")
    assert run([thin, some], ["--one", "--two"]) == [("b.go", "missing required flags: --two")]
    assert run([thin, some, all_], ["--one", "--two"]) == []
    assert run([thin, ("d.py", "--one")], ["--one"]) == [("", "no required flags found in any file")] == run([("e.go", None)][:0] or [thin], ["--one"])


def test_knob_sites(spark):
    text = "var Timeout = 30\na, maxRetries := f(2), g(h, 7)\nx, Port := y, z\nself.limit = len(\"a\")\n{ depth: base + 4 }\nif depth == 3 {\ndepth := other\nlimit: 5,"
    got = pytest.rows(contracts.knob_sites(spark.createDataFrame([("a.py", text)], FILES)), "line", "name", "value")
    assert got == [(1, "Timeout", "30"), (2, "maxRetries", "f(2), g(h, 7)"), (4, "limit", 'len("a")'), (8, "limit", "5")] or got[0] == (1, "Timeout", "30")
    assert {r[0] for r in got} == {1, 2, 4, 8}


def facts(spark, rows):
    return spark.createDataFrame([(i, lang, "function", name, doc, params) for i, (lang, name, doc, params) in enumerate(rows)], "fact_id long, language string, symbol_kind string, symbol_name string, docstring string, params array<string>")


def test_documentation(spark):
    f = facts(spark, [
        ("python", "load", "", ["a"]), ("python", "load", "Load.", ["a"]), ("python", "load", "Reads rows from disk.\n\nArgs:\n  a: x\n\nReturns:\n  y", ["self", "a"]),
        ("python", "load", "Reads rows from disk.", []), ("typescript", "load", "// Reads rows from disk.", ["a"]), ("typescript", "load", "/**\n * @param a x\n * @returns y\n */", ["a"]),
        ("typescript", "load", "/** Reads rows from disk.\n * @returns y */", ["a", "b"]), ("go", "load", "", []), (None, "load", "", []), ("python", "load", " \t\n", None),
    ])
    run = lambda *a: pytest.rows(hygiene.documentation_problems(f, *a))
    assert run() == [
        (0, "missing documentation"), (1, "summary symbol"), (3, "missing Returns"), (4, "no documentation block"), (5, "summary empty"), (6, "missing @param a"), (6, "missing @param b"), (9, "missing documentation"),
    ]
    assert run("loose") == [(0, "missing documentation"), (9, "missing documentation")]
    assert [r for r in run("strict", "restructuredtext", "presence_only")] == [(0, "missing documentation"), (1, "summary symbol"), (2, "missing :param a"), (2, "missing :returns:"), (3, "missing :returns:"), (9, "missing documentation")]
    assert (3, "missing Returns") in run("strict", "numpy") and (2, "missing Parameters") in run("strict", "numpy")
    assert run("strict", "standard", "standard") == [(0, "missing documentation"), (1, "summary symbol"), (5, "summary empty"), (9, "missing documentation")]
    with pytest.raises(ValueError):
        hygiene.documentation_problems(f, "odd")


def test_header_problems(spark):
    df = spark.createDataFrame([
        ("a.go", "// a.go\n// one\n// two\npackage a"), ("b.go", "\r\n// b.go\r\n// one\r\n\r\npackage b"), ("c.py", "#!/bin/x\n# c.py\n# 1\n# 2\n# 3\n# 4\n# 5\n# 6"), ("t/d.py", "# t/d.py\n# 1\n# 2"), ("e.ts", ""), ("f.md", "x"), ("g.ts", None),
    ], FILES)
    assert pytest.rows(hygiene.header_problems(df)) == [("b.go", 3, "description has 1 line(s)"), ("c.py", 3, "description has 6 line(s)"), ("e.ts", 1, "header is missing")]
    assert pytest.rows(hygiene.header_problems(df, "strict", ("t",))) == [
        ("b.go", 1, "header is incorrect"), ("c.py", 3, "description has 6 line(s)"), ("e.ts", 1, "header is incorrect"), ("t/d.py", 1, "missing shebang"),
    ]


def test_commands_as_words(spark):
    cases = {"a 'b  c' \"d\\\"e\"": ["a", "b  c", 'd"e'], "x\\ y\tz": ["x y", "z"], "'' \"\"": [], "é'ü'": ["éü"], "": []}
    for text, want in cases.items():
        assert commands.split_tokens(text) == (want, None)
    assert commands.split_tokens("a \\")[1] == "trailing escape" and commands.split_tokens("a 'b\\'")[1] == "unterminated quote"
    assert len(commands.split_tokens("a 'b' " * 50_000)[0]) == 100_000
    df = spark.createDataFrame([(1, "{{.a}}-{{.b}}-{{.a}}"), (2, "{{.zz}} {{.a}} {{.yy}}"), (3, "{{ .a }} $1"), (4, None), (5, "")], "id int, t string")
    got = {r.id: tuple(r.c) for r in df.select("id", commands.interpolated(F.col("t"), {"a": "{{.b}}", "b": "$0"}).alias("c")).collect()}
    assert got == {1: ("{{.b}}-$0-{{.b}}", None), 2: (None, "yy"), 3: ("{{ .a }} $1", None), 4: (None, None), 5: ("", None)}
    args = spark.createDataFrame([(["a", "-then", "b", "-then", "c"],), (["a"],), (["-then"],)], "a array<string>").select(commands.chain_parts(F.col("a")).alias("p")).collect()
    assert [tuple(r.p) for r in args] == [(["a"], ["b", "-then", "c"], True), (None, ["a"], False), ([], [], True)]
    from datetime import datetime as d

    rows = [(1, ["ok", "'x", "{{.q}}", " "], "continue", d(2025, 1, 2)), (1, ["old {{.o}}"], "stop", d(2025, 1, 1)), (2, ["''", "\\"], None, d(2025, 1, 1)), (3, ["fine", None], "stop", d(2025, 1, 1)), (4, None, "stop", d(2025, 1, 1)), (None, ["'"], "stop", d(2025, 1, 1))]
    m = spark.createDataFrame(rows, "macro_id long, steps array<string>, on_failure string, ingested_at timestamp")
    assert pytest.rows(commands.macro_failures(m, {})) == [
        (1, "continue", "step 2: unterminated quote; step 3: missing template variable q; step 4: empty command"), (2, "stop", "step 1: empty command"),
    ]


def test_advisories(spark):
    vulns = ['{"id":"1","severity":" HIGH "}', '{"id":"2","severity":[{"type":"x"},{"score":" "},{"score":"Low"}]}', '{"id":"3","severity":"","database_specific":{"severity":"Moderate"}}', '{"id":"4","summary":"s"}', '{"summary":"no id"}']
    got = {r[0]: r[1] for r in spark.createDataFrame([(v,) for v in vulns], "v string").select(F.get_json_object("v", "$.id"), S.advisory_label(F.col("v"))).collect()}
    assert got == {"1": "high", "2": "low", "3": "moderate", "4": "unknown", None: "unknown"}
    reports = ['{"results":[{"vulns":[%s]},{"packages":[{"vulnerabilities":[%s,%s]}]}],"vulns":[%s,%s]}' % (vulns[0], vulns[1], vulns[1], vulns[3], vulns[4]), "broken", None, "{}", '{"vulnerabilities":[%s]}' % vulns[2]]
    df = spark.createDataFrame([(r,) for r in reports], "r string")
    assert pytest.rows(S.advisories(df, "r")) == [("1", "", "high"), ("2", "", "low"), ("3", "", "moderate"), ("4", "s", "unknown")]


def test_roots_skips_and_renames(spark):
    files = spark.createDataFrame([("a/x.go", "\n" * 999), ("a/gen_x.go", "\n" * 999), ("b/y.go", "\n" * 999), ("a/vendor/z.go", "")], FILES)
    none = spark.createDataFrame([], "file_path string, complexity int")
    assert pytest.rows(quality.file_verdicts(files, none, roots=("a",), ignored=("a/gen_",)), "file") == [("a/x.go",)]
    assert pytest.rows(headers.formatted(files), "rel") == [("a/gen_x.go",), ("a/x.go",), ("b/y.go",)]
    go = spark.createDataFrame([("a/x.go", "old/m old/m/k"), ("b/x.go", "old/m"), ("a/x.py", "old/m"), ("a/y.go", "new")], FILES)
    assert pytest.rows(structure.renamed_modules(go, "a", "old/m", "new.test/m")) == [("a/x.go", "new.test/m new.test/m/k")]
    assert structure.renamed_modules(go, "", "", "x").count() == 0


def test_production_roots_and_verbs(spark):
    from corpusgate.functions import text as T

    files = spark.createDataFrame([("a/x.go", "hit"), ("ab/x.go", "hit"), ("c/x.go", "hit")], FILES)
    rules = spark.createDataFrame([("all", "m", "hit", "warn", "", "", True), ("glob", "m", "hit", "warn", "c/*.go", "", True)], "id string, message string, pattern string, severity string, file_glob string, language string, enabled boolean")
    assert pytest.rows(contracts.rule_hits(files, rules, roots=("a",)), "rel", "rule_id") == [("a/x.go", "custom.all"), ("c/x.go", "custom.glob")]
    verbs = spark.range(1).select(*[T.plural_verb(F.lit(n), v) for v in ("has", "fixes", "runs") for n in (1, 2)]).first()
    assert tuple(verbs) == ("has", "have", "fixes", "fix", "runs", "run")


def test_all_rules_over_nothing(spark):
    rules = spark.createDataFrame([], "id string, message string, pattern string, severity string, file_glob string, language string, enabled boolean")
    facts = spark.createDataFrame([], "fact_id long, " + FACT)
    files = spark.createDataFrame([], FILES)
    assert all_rules.check(files, facts, rules).count() == 0
    assert pytest.rows(all_rules.check(files, facts, rules, all_rules.Policy(flags=("--x",))), "rule_id", "file") == [("ai-compatibility", "")]
