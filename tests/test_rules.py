import time

import pytest
from pyspark.sql import functions as F

from corpusgate.operators import commands, contracts, headers, hygiene, quality, registry, report, structure
from corpusgate.schema import FACT, VIOLATION
from corpusgate.sources.extract import source_facts
from corpusgate.streaming.sessions import advance, finished_sessions, session_outcomes


def fact(spark, rows):
    names = ("fact_id", "language", "symbol_kind", "line_number", "end_line", "complexity", "param_count", "repeated_nil_guards")
    return spark.createDataFrame(rows, "fact_id long, language string, symbol_kind string, line_number int, end_line int, complexity int, param_count int, repeated_nil_guards int").select(
        *names, F.lit("a.go").alias("file_path"), F.lit("f").alias("symbol_name")
    )


def test_function_quality_ladder(spark):
    cases = [
        ("go", "function", 10, 20, 5), ("go", "function", 10, 20, 12), ("go", "function", 10, 20, 14), ("go", "function", 10, 20, 16), ("go", "function", 10, 20, 18),
        ("go", "function", 1, 120, 5), ("go", "function", 1, 80, 10), ("go", "function", 1, 79, 10), ("typescript", "function", 1, 1, 20), ("go", "struct", 1, 1, 20),
        (None, None, None, None, None),
    ]
    got = quality.function_violations(fact(spark, [(i, *c, 0, 0) for i, c in enumerate(cases)]))
    assert pytest.rows(got, "fact_id", "severity", "rule_id") == [
        (1, "warn", "function-quality.mild-ctx"), (2, "warn", "function-quality"), (3, "warn", "function-quality"), (4, "error", "function-quality"),
        (5, "error", "function-quality"), (6, "error", "function-quality"),
    ]


def test_several_rows_of_one_function(spark):
    got = quality.function_violations(fact(spark, [(1, "go", "method", 1, 90, 9, 7, 8)]))
    assert sorted(r.severity for r in got.collect()) == ["error", "warn", "warn"]


@pytest.mark.parametrize("mild,hard,want", [(0, 0, (700, 900)), (5, 5, (650, 825)), (30, 30, (450, 650)), (22, 22, (480, 650))])
def test_file_thresholds(spark, mild, hard, want):
    warn, most = quality.file_thresholds(F.lit(mild), F.lit(hard), quality.FileLimits())
    assert tuple(spark.range(1).select(warn, most).first()) == want


def test_file_verdicts_are_strict(spark):
    files = spark.createDataFrame([(f"f{n}", "\n" * (n - 1)) for n in (500, 700, 701, 901)], "rel string, content string")
    facts = spark.createDataFrame([], "file_path string, complexity int")
    assert pytest.rows(quality.file_verdicts(files, facts), "file", "severity") == [("f701", "warn"), ("f901", "error")]


def violations(spark, rows):
    return spark.createDataFrame(rows, VIOLATION)


def test_roll_up(spark):
    mild = report.MILD
    data = [(mild, "a.go", f"f{i}", "m", "warn", i) for i in range(4)] + [(mild, "b.go", "g", "m", "warn", 1), ("x", "", "", "m", "error", 0)]
    got = pytest.rows(report.roll_up(violations(spark, data)), "rule_id", "file", "function", "message")
    assert got == [
        ("function-quality", "a.go", "", "a.go has 4 low CTX violations (CTX 12-13); hotspot threshold is 4"), ("function-quality", "b.go", "g", "m"), ("x", "", "", "m"),
    ]
    many = report.roll_up(violations(spark, [(mild, f"{i}.go", "f", "m", "warn", 1) for i in range(3)]))
    assert pytest.rows(many, "message") == [("3 functions have low CTX violations (CTX 12-13)",)]
    assert report.roll_up(violations(spark, [])).count() == 0


def test_order_dedupe_totals(spark):
    data = [("b", "f", "", "m", "warn", 2), ("a", "f", "", "m", "error", 1), ("a", "f", "", "m", "warn", 1), ("a", "", "", "n", "odd", 0)]
    v = violations(spark, data)
    assert [(r.severity, r.rule_id) for r in report.positions(v).orderBy("position").collect()] == [("error", "a"), ("warn", "a"), ("warn", "b"), ("odd", "a")]
    assert pytest.rows(report.deduped(v), "rule_id", "severity") == [("a", "error"), ("a", "odd"), ("b", "warn")]
    assert tuple(report.totals(v).first()) == (1, 3, 2, 1)
    assert tuple(report.totals(violations(spark, [])).first()) == (0, 0, 0, 0)
    assert pytest.rows(report.per_file(v), "file", "errors", "first_line", "repo_last") == [("(repo)", 0, None, 1), ("f", 1, 1, 0)]


def test_symbol_names(spark):
    rows = [(1, "HttpClientPool"), (2, "Run"), (3, "Alone"), (4, "TwoWords"), (5, "lower")]
    facts = spark.createDataFrame(rows, "fact_id long, symbol_name string").withColumns({"file_path": F.lit("a/x.go"), "symbol_kind": F.lit("function"), "line_number": F.lit(1)})
    assert pytest.rows(hygiene.symbol_name_violations(facts), "fact_id", "problem") == [(1, "acronym Http"), (3, "fewer than 2 words")]


def test_concern_sections(spark):
    texts = ["// Package Concerns:\n// - a\n// - b\npackage x", "// none\n// - a", "// Package Concerns:\n//\n// - late", "// Package Concerns:\n// - one\n// said\n"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(structure.concern_section(F.col("t")).alias("c"))
    assert [tuple(r.c) for r in df.collect()] == [(True, 2), (False, 0), (True, 0), (True, 1), (False, 0)]


def test_packages(spark):
    doc = "// Package p Does it.\n//\n// Package Concerns:\n// - one\npackage p\n"
    files = [("a/doc.go", doc), ("a/x.go", ""), ("a/x_test.go", ""), ("b/x.go", ""), ("c/doc.go", doc.replace("Does", "does")), *[(f"c/{i}.go", "") for i in range(11)], ("d/x_test.go", "")]
    stats = structure.package_stats(spark.createDataFrame(files, "rel string, content string"))
    assert pytest.rows(structure.package_verdicts(stats)) == [("b", "no doc.go"), ("c", "doc prefix"), ("c", "too many files")]


def test_layers(spark):
    """One case for each branch of the rule, in a made-up shop: sales is business, db and mail are adapters, hub is core, hub/wire starts the program."""
    problems = {
        ("shop/sales/cart.go", "shop/db/sql"): "forbidden path",
        ("shop/sales/tax/rate.go", "shop/hub/secret"): "forbidden path",
        ("shop/sales/cart.go", "shop/lab"): None,
        ("shop/sales/cart.go", "internal/lab"): "outside boundaries",
        ("shop/sales/cart.go", "internal/clock"): None,
        ("shop/sales/cart.go", "shop/sales/tax"): None,
        ("shop/sales/cart.go", "fmt"): None,
        ("shop/mail/send.go", "shop/sales"): "business package",
        ("shop/mail/send.go", "shop/db"): "another adapter",
        ("shop/mail/send.go", "shop/mail/mime"): None,
        ("shop/mail/mime/part.go", "shop/mail"): None,
        ("shop/mailer/x.go", "shop/db"): None,
        ("shop/hub/loop.go", "shop/db/sql"): "core to adapter",
        ("shop/hub/loop.go", "shop/sales/tax"): "core to business",
        ("shop/hub/loop.go", "shop/hub/wire"): None,
        ("shop/hub/wire/start.go", "shop/db"): None,
        ("shop/hub/wire/start.go", "shop/sales"): None,
        ("main.go", "shop/sales"): None,
    }
    imports = spark.createDataFrame([(rel, 1, f"w.test/{path}") for rel, path in problems], "rel string, line int, path string")
    full = lambda *paths: [f"w.test/{p}" for p in paths]
    got = structure.layer_violations(imports, "w.test", ["shop/sales"], ["shop/db", "shop/mail"], ["shop/hub"], ["shop/hub/wire"], full("shop/db", "shop/hub/secret"), full("internal/clock"))
    assert {(r.rel, r.path.removeprefix("w.test/")): r.problem for r in got.collect()} == {k: v for k, v in problems.items() if v}


def test_imports_tests_children_paths(spark):
    go = 'package a\n\nimport (\n\t"fmt"\n\tx "m/internal/cmd/y"\n)\n\nvar s = "no"\n'
    files = spark.createDataFrame([("internal/a.go", go), ("b.go", 'package b\nimport "os"\n')], "rel string, content string")
    imports = structure.go_imports(files)
    assert pytest.rows(imports) == [("b.go", 2, "os"), ("internal/a.go", 4, "fmt"), ("internal/a.go", 5, "m/internal/cmd/y")]
    assert pytest.rows(structure.upward_imports(imports), "line") == [(5,)]
    paths = spark.createDataFrame([("internal/app/bad_test.go",), ("internal/tests/ok_test.go",), ("internal/x.go",), ("scripts/a.py",), ("a.toml",)], "rel string")
    assert pytest.rows(structure.misplaced_tests(paths, ["internal/tests"])) == [("internal/app/bad_test.go",)]
    allowed = spark.createDataFrame([("app",)], "child string")
    assert pytest.rows(structure.unexpected_children(paths, "internal", allowed)) == [("tests",)]
    wanted = spark.createDataFrame([("internal",), ("internal/app",), ("gone",)], "path string")
    assert pytest.rows(structure.missing_paths(wanted, paths)) == [("gone",)]
    assert pytest.rows(structure.walked(paths)) == [("internal/app/bad_test.go",), ("internal/x.go",)]


BANG = "#!/usr/bin/env python3\n"
# What a file may begin with, and where its own path then stands.
HEADERS = [
    ("go", "k/plain.go", "package k\n\nvar x = 1", "// k/plain.go\npackage k\n\nvar x = 1\n"),
    ("go", "k/moved.go", "// was/elsewhere.go\npackage k\n", "// k/moved.go\npackage k\n"),
    ("go", "k/two.go", "// a/b.go\n// c/d.go\npackage k\n", "// k/two.go\npackage k\n"),
    ("go", "k/told.go", "// Package k counts sheep.\npackage k\n", "// k/told.go\n\n// Package k counts sheep.\npackage k\n"),
    ("go", "k/tags.go", "//go:build linux\n// +build linux\n\npackage k\n", "//go:build linux\n// +build linux\n\n// k/tags.go\npackage k\n"),
    ("go", "k/win.go", "package k\r\nvar y int\r\n", "// k/win.go\r\npackage k\r\nvar y int\r\n"),
    ("go", "k/none.go", "", "// k/none.go\n"),
    ("python", "t/with.py", BANG + "x = 1\n", BANG + "# t/with.py\nx = 1\n"),
    ("python", "t/other.py", "#!/bin/py\n# old/name.py\nx = 1", "#!/bin/py\n# t/other.py\nx = 1\n"),
    ("python", "t/bare.py", "x = 1\n", BANG + "# t/bare.py\nx = 1\n"),
    ("typescript", "w/a.tsx", "let a = <b/>;\n", "// w/a.tsx\nlet a = <b/>;\n"),
    ("typescript", "w/b.ts", "\n// w/old.ts\nlet b;\n", "// w/b.ts\n\nlet b;\n"),
]


@pytest.mark.parametrize("language,rel,content,want", HEADERS)
def test_headers(spark, language, rel, content, want):
    df = spark.createDataFrame([(content, rel)], "content string, rel string")
    assert df.select(headers.with_header(F.col("content"), F.col("rel"), language)).first()[0] == want
    once = headers.formatted(df)
    assert tuple(once.select("content", "changed").first()) == (want, True)
    assert tuple(headers.formatted(once.select("rel", "content")).select("content", "changed").first()) == (want, False)


def test_header_filter(spark):
    files = spark.createDataFrame([("a.go", "package a\n"), ("b.md", "x"), ("x/vendor/c.go", "package c\n"), ("vendor.go/../d.md", "")], "rel string, content string")
    assert pytest.rows(headers.run_report(files)) == [("go", 1, 1)]
    with pytest.raises(ValueError):
        headers.formatted(files, ("rust",))


def test_custom_rules_equal_brute_force(spark, sf):
    import re

    from corpusgate import schema
    from corpusgate.session import read_table

    files, rules = schema.files(spark, sf), read_table(spark, sf, "custom_rules")
    extra = spark.createDataFrame([("any-line", "m", r"^\s+return|x{3}", "warn", "", "go", True), ("off", "m", "return", "warn", "", "", False)], rules.schema)
    rules = rules.unionByName(extra)
    got = {(r.rel, r.line, r.rule_id) for r in contracts.rule_hits(files, rules).collect()}
    scopes = {(r.language, r.file_glob, r.rel) for r in contracts.scope_matches(rules, files).collect()}
    table, want = rules.where("enabled").collect(), set()
    for f in files.collect():
        for rule in table:
            if (rule.language or "", rule.file_glob or "", f.rel) in scopes:
                p = re.compile(rule.pattern)
                lines = f.content.split("\n")[: -1 if f.content.endswith("\n") else None]
                want |= {(f.rel, n, f"custom.{rule.id}") for n, line in enumerate(lines, 1) if p.search(line.removesuffix("\r"))}
    assert (sorted(got - want)[:3], sorted(want - got)[:3]) == ([], []) and len(got) > 10


def test_needed_literal():
    assert contracts.needed_literal(r"db\.Query") == "db.query" or contracts.needed_literal(r"db\.Query") in "db.query"
    assert contracts.needed_literal(r"(?i)cfg[ _-]?Glob") in ("cfg", "glob")
    assert contracts.needed_literal(r"a|b") == ""
    assert contracts.needed_literal(r"\s+") == ""


def test_escaped_signs_are_part_of_the_needed_text(spark):
    import re

    patterns = [r"\bbatch\.Fact\(", r"\bdb\.LongName\(", r"\blongname\.B\(", r"(?i)\bcfg\.Missing\(", r"a\|b{2}", r"(?:x|y)\.(?:Go)?Run\("]
    lines = ["v := batch.Fact(1)", "db.LongName(2)", "longname.B(3) // batch\\Fact(", "CFG.M\u0131\u017fsing(4)", "a|bb", "y.Run(5) x.GoRun(6)", "batchxFact(7)"]
    files = spark.createDataFrame([("a.go", "\n".join(lines))], "rel string, content string")
    rules = spark.createDataFrame([(str(i), "m", p, "warn", "", "go", True) for i, p in enumerate(patterns)], "id string, message string, pattern string, severity string, file_glob string, language string, enabled boolean")
    want = {(n, f"custom.{i}") for n, line in enumerate(lines, 1) for i, p in enumerate(patterns) if re.search(p, line)}
    assert {(r.line, r.rule_id) for r in contracts.rule_hits(files, rules).collect()} == want and len(want) == 6
    assert contracts.needed_literal(r"\bbatch\.Fact\(") == "batch.fact("


def test_rules_in_blocks_hit_what_they_hit_at_once(spark):
    schema = "id string, message string, pattern string, severity string, file_glob string, language string, enabled boolean"
    rows = [("a", "m", "fmt", "warn", "", "go", True), ("b", "m", "^x", "error", None, None, True), ("c", "m", "os", "warn", "cmd/*.go", "any", True), ("d", "m", "fmt", "warn", "", "", False), ("e", "m", None, "warn", "", "", True), ("f", "m", "print", None, "", "python", True)]
    rules = spark.createDataFrame(rows, schema)
    files = spark.createDataFrame([("cmd/a.go", "fmt os\nx fmt"), ("b.py", "x print\nfmt"), ("c.go", "os"), ("d.go", ""), ("e.go", None), (None, "fmt")], "rel string, content string")
    want = [("b.py", 1, "custom.b", "error"), ("b.py", 1, "custom.f", ""), ("cmd/a.go", 1, "custom.a", "warn"), ("cmd/a.go", 1, "custom.c", "warn"), ("cmd/a.go", 2, "custom.a", "warn"), ("cmd/a.go", 2, "custom.b", "error")]
    for block in (1, 2, 100):
        assert pytest.rows(contracts.rule_hits(files, rules, block)) == want
    assert pytest.rows(contracts.rule_hits(files, rules.where("false"))) == []
    paths = files.where("rel IS NOT NULL")
    assert pytest.rows(contracts.scope_matches(rules, paths, 1)) == pytest.rows(contracts.scope_matches(rules, paths)) and contracts.scope_matches(rules, paths).count() > 5
    assert pytest.rows(contracts.scope_matches(rules.where("false"), paths)) == []


def test_calls_words_secrets(spark):
    files = spark.createDataFrame([("a.go", 'x := os.Exit(1) // fmt.Println(2)\ns := "os.Getenv(3)"'), ("cmd/b.go", "os.Exit(1)")], "rel string, content string")
    assert pytest.rows(contracts.forbidden_calls(files, ["os.Exit", "fmt.Println"], "restrict", ("cmd",))) == [("a.go", "os.Exit")]
    assert contracts.forbidden_calls(files, ["os.Exit"], "ban").count() == 2 and contracts.forbidden_calls(files, ["os.Exit"], "allow").count() == 0
    assert contracts.required_words(files, "rel", "content", ["os.Exit"]).count() == 0
    assert pytest.rows(contracts.required_words(files, "rel", "content", ["os.Exit", "zzz"]), "rel") == [("a.go",), ("cmd/b.go",)]
    lines = spark.createDataFrame([(1, "password = hunter22x\nexample token: abcdefgh\ntoken"), (2, None)], "id int, t string")
    assert pytest.rows(contracts.keyword_lines(lines, ["id"], "t")) == [(1, 1, "password", "HIGH"), (1, 3, "token", "LOW")]


def test_registries(spark):
    f = lambda rows: spark.createDataFrame(rows, "file string, checksum string")
    assert pytest.rows(registry.lock_verdicts(f([("a", "1"), ("b", "2"), ("c", "3")]), f([("a", "1"), ("b", "9"), ("d", "4")]))) == [("b", "changed"), ("c", "missing"), ("d", "unexpected")]
    g = lambda rows: spark.createDataFrame(rows, "k string, v int")
    assert pytest.rows(registry.merged(g([("a", 1), ("b", 2)]), g([("b", 3), ("c", None)]), "k", ["v"])) == [("a", 1, "base"), ("b", 3, "over"), ("c", None, "over")]
    assert pytest.rows(registry.set_differences(g([("a", 1), ("b", 1)]), g([("b", 1), ("c", 1)]), "k")) == [("a", "left"), ("c", "right")]


def matching(items, rnd):
    """A text for a parsed pattern; most tries match."""
    from re import _constants as K

    out = ""
    for op, value in items:
        if op is K.LITERAL:
            out += chr(value)
        elif op is K.NOT_LITERAL:
            out += "a" if value != ord("a") else "b"
        elif op is K.ANY:
            out += "q"
        elif op is K.IN:
            kind, what = rnd.choice([v for v in value if v[0] is not K.NEGATE])
            out += {K.LITERAL: lambda: chr(what), K.RANGE: lambda: chr(what[0]), K.CATEGORY: lambda: " " if "SPACE" in str(what) else "7" if "DIGIT" in str(what) else "w"}[kind]()
        elif op is K.BRANCH:
            out += matching(rnd.choice(value[1]), rnd)
        elif op is K.SUBPATTERN:
            out += matching(value[3], rnd)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            out += "".join(matching(value[2], rnd) for _ in range(value[0] + rnd.randint(0, 1) if value[1] > value[0] else value[0]))
    return out


def test_every_given_pattern_finds_a_line_made_for_it(spark, sf):
    import random
    import re
    from re import _parser

    from corpusgate.session import read_table

    rnd, lines, made = random.Random(1), [], set()
    patterns = {r.pattern for r in read_table(spark, sf, "custom_rules").where("enabled AND pattern <> ''").collect()}
    own = [r"\bresult\.Prefix\(", r"foo.*?barbaz", r"foo\tbar", r"^password\Z", r"foo((a(b)?)c)", r"\x41bcdef", r"(?:ab|cd)efg", r"[xy]tail", r"(?i)MiXed\.Case"]
    table = sorted(patterns) + own
    for p in table:
        for _ in range(6):
            text = matching(_parser.parse(p), rnd)
            for line in (text, f"x {text} y", f"x {text.upper()}"):
                if re.search(p, line) and "\n" not in line:
                    lines.append(line)
                    made.add(p)
    assert len(patterns) > 700 and len(made) > 0.99 * len(table) and made >= set(own)
    files = spark.createDataFrame([("a.go", "\n".join(lines))], "rel string, content string")
    rules = spark.createDataFrame([(str(i), "m", p, "warn", "", "", True) for i, p in enumerate(table)], "id string, message string, pattern string, severity string, file_glob string, language string, enabled boolean")
    got = {(r.line, r.rule_id) for r in contracts.rule_hits(files, rules).collect()}
    compiled = [(f"custom.{i}", re.compile(p)) for i, p in enumerate(table)]
    assert got == {(n, rule) for n, line in enumerate(lines, 1) for rule, p in compiled if p.search(line)}


def test_long_chains_have_levels(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, 12)], "node string, needs string")
    assert {r.node: (r.level, r.in_circle) for r in registry.dependency_levels(chain).collect()} == {f"n{i}": (i, False) for i in range(12)}


def test_ports_and_strictness(spark):
    c = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", None)], "consumer string, port string")
    p = spark.createDataFrame([("x", "p"), ("y", None), ("z", "r")], "provider string, port string")
    links, open_ = registry.port_links(c, p)
    assert pytest.rows(links, "consumer", "provider", "port") == [("a", "x", "p")] and pytest.rows(open_, "consumer", "port") == [("b", "q")]
    base = spark.createDataFrame([("r1",), ("r2",), (None,)], "rule string")
    over = spark.createDataFrame([("g", "r1"), ("g", "r9"), ("h", "r2"), ("h", "r1"), ("i", "r9"), ("k", None), (None, "r1")], "file string, rule string")
    assert {r.file: r.lacking for r in registry.not_stricter(base, over, "file", "rule").collect()} == {"g": ["r2"], "i": ["r1", "r2"], "k": ["r1", "r2"]}
    with pytest.raises(ValueError):
        registry.not_stricter(base, over, "file", "rule", most=1)


def test_roll_up_with_a_higher_limit(spark):
    mild = report.MILD
    data = [(mild, f"{n}.go", f"f{i}", "m", "warn", i) for n in range(1, 6) for i in range(n)]
    got = report.roll_up(violations(spark, data), report.RollUp(per_file=4, least=100)).collect()
    assert sorted((r.file, r.function) for r in got) == sorted([("4.go", ""), ("5.go", "")] + [(f"{n}.go", f"f{i}") for n in range(1, 4) for i in range(n)])


def test_dependency_levels_and_circles(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("d", None)], "node string, needs string")
    got = {r.node: r.level for r in registry.dependency_levels(edges).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}


def test_commands(spark):
    df = spark.createDataFrame([("go get x",), ("pip install a -q b",), ("npm i lodash",), ("go build",), ("pip list",), ("rustc x",), ("run-job go get",), ("fmt headers",)], "command string")
    assert [r[0] for r in df.select(commands.command_kind(F.col("command"))).collect()] == ["package", "package", "package", "tool", "tool", "passthrough", "macro", "format"]
    assert [r.packages for r in commands.install_requests(df, []).collect()] == ["x", "a b", "lodash"]
    s = spark.createDataFrame([(1, "a && b; c\\\n  d\n\ne"), (2, None), (3, "")], "id int, t string")
    assert [r.command for r in commands.simple_commands(s, ["id"], "t").orderBy("part").collect()] == ["a", "b", "cd", "e"]


def test_extracted_facts(spark):
    py = "class A:\n    def m(self, value, /, extra, *args, flag=False, **kwargs):\n        if value and flag:\n            pass\n"
    ts = "class A {\n  m(value, flag) {\n    if (value && flag) { return 1; }\n  }\n}\nconst helper = (value, flag, extra) => {\n  if (value || flag) { return extra ? 1 : 2; }\n};\n"
    go = "package a\n\nfunc (s *S) F(a, b int, c string) error {\n\tif err != nil {\n\t\treturn err\n\t}\n\tif a == nil {\n\t}\n\tif a == nil {\n\t}\n\tfor {\n\t}\n\treturn nil\n}\n"
    files = spark.createDataFrame([("a.py", py), ("a.ts", ts), ("a.go", go), ("bad.py", "def f(:\n  pass"), ("x.md", "def f(): pass"), ("n.py", None)], "rel string, content string")
    facts = source_facts(files)
    assert facts.columns == [c.split()[0] for c in FACT.split(", ")]
    got = {(r.file_path, r.symbol_name): (r.symbol_kind, r.param_count, r.complexity) for r in facts.collect()}
    assert got == {("a.py", "m"): ("method", 6, 3), ("a.ts", "m"): ("method", 2, 3), ("a.ts", "helper"): ("function", 3, 4), ("a.go", "F"): ("method", 3, 3)}


def test_sessions(spark):
    seen = []
    assert [advance(seen, ["a", "b"], r, s) for r, s in (("a", "success"), ("a", "success"), ("c", "success"), ("b", "error"), ("b", "success"))] == [None, "duplicate", "unknown", "failed", "complete"]
    data = [("1", "a", "success", 1), ("1", "b", "success", 2), ("1", "b", "success", 3), ("2", "a", "success", 1), ("2", "c", "success", 2), ("3", "a", "success", 1), ("4", "b", "error", 1), ("5", "a", "success", 1), ("5", "a", "success", 2)]
    reports = spark.createDataFrame(data, "session string, reporter string, status string, at int")
    want = [("1", "complete", "b"), ("2", "unknown", "c"), ("3", "open", None), ("4", "failed", "b"), ("5", "duplicate", "a")]
    assert pytest.rows(finished_sessions(reports, ["a", "b"])) == want


def test_session_stream(spark, tmp_path):
    schema = "session string, reporter string, status string, at int"
    spark.createDataFrame([("1", "a", "success", 1), ("1", "b", "success", 2), ("2", "z", "success", 1), ("3", "a", "success", 1)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = session_outcomes(stream, ["a", "b"], 3_600_000).writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        # The timer keeps such a query busy, so it never counts as idle.
        until = time.time() + 90
        while time.time() < until and spark.table("ended").count() < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    assert pytest.rows(spark.table("ended"), "session", "outcome") == [("1", "complete"), ("2", "unknown")]


def test_sources(spark, tmp_path):
    from corpusgate.sources import tables

    (tmp_path / "t/internal").mkdir(parents=True)
    (tmp_path / "t/internal/a.go").write_text("package a\n")
    (tmp_path / "t/.hidden.py").write_text("x = 1\n")
    (tmp_path / "t/c.toml").write_text("")
    assert pytest.rows(tables.tree(spark, str(tmp_path / "t")).where("rel not like '%.toml'")) == [("internal/a.go", "package a\n")]
    for folder in ("internal/deep/er", "internal/router/x", "node_modules"):
        (tmp_path / "t" / folder).mkdir(parents=True)
        (tmp_path / "t" / folder / "f.ts").write_text("")
    assert pytest.rows(tables.listed_tree(spark, str(tmp_path / "t")), "rel") == [(".hidden.py",), ("internal/a.go",), ("internal/deep/er/f.ts",)]
    mods = spark.createDataFrame([("go.mod", "// x\nmodule w.test/m\ngo 1.24\n"), ("a/go.mod", "go 1.2"), ("b.go", "module x")], "rel string, content string")
    assert pytest.rows(tables.module_path(mods)) == [("a/go.mod", ""), ("go.mod", "w.test/m")]
    (tmp_path / "l.json").write_text('{"file":"a","checksum":"1"}\nbroken\n')
    assert pytest.rows(tables.lock_records(spark, str(tmp_path / "l.json"))) == [(None, None, "broken"), ("a", "1", None)]
    assert tables.ndjson(spark, str(tmp_path / "l.json"), "file string", strict=False).count() == 1
    tables.write_lines(spark.createDataFrame([("x",)], "l string"), "l", str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first()[0] == "x"
