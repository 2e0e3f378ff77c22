"""Registered queries over violations, facts, files, rules, macros and gates, each beside its SQL.

The limits are scaled to the size of the given files, so that every branch of a rule has rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate import schema
from corpusgate.functions import paths as P
from corpusgate.functions import severity as S
from corpusgate.functions import text as T
from corpusgate.operators import all_rules, commands, contracts, headers, hygiene, quality, registry, report, structure
from corpusgate.operators.skew import latest_rows
from corpusgate.session import read_table
from corpusgate.sources.extract import source_facts
from corpusgate.streaming.sessions import finished_sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Views of the given tables in SQL: repeats once, nulls and spellings cleaned, as in corpusgate.schema.
_CLEAN = r"regexp_replace(regexp_replace(replace(trim(coalesce({c}, '')), '\', '/'), '/(\./)+|//+', '/', 'g'), '^(\./)+', '')"
_SEV = "CASE lower(trim(coalesce(severity, ''))) WHEN 'warning' THEN 'warn' ELSE lower(trim(coalesce(severity, ''))) END"
_V = f"""v AS (SELECT violation_id, coalesce(rule_id, '') AS rule_id, {_CLEAN.format(c="file")} AS file, coalesce(function, '') AS function,
  coalesce(message, '') AS message, {_SEV} AS severity, coalesce(line, 0) AS line
  FROM (SELECT *, row_number() OVER (PARTITION BY violation_id ORDER BY ingested_at DESC) AS rn FROM violations) WHERE rn = 1)"""
_FACTS = f"""f AS (SELECT * REPLACE (coalesce(symbol_name, '') AS symbol_name, coalesce(symbol_kind, '') AS symbol_kind, coalesce(docstring, '') AS docstring,
  CASE WHEN trim(coalesce(language, '')) = '' THEN 'unknown' ELSE lower(trim(language)) END AS language, {_CLEAN.format(c="file_path")} AS file_path)
  FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY ingested_at DESC) AS rn FROM policy_facts) WHERE rn = 1)"""
_FILES = """fl AS (SELECT rel, regexp_replace(content, '^﻿', '') AS content FROM source_files WHERE rel IS NOT NULL AND content IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY rel ORDER BY captured_at DESC NULLS LAST, content DESC) = 1)"""
_LINES = """ln AS (SELECT rel, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (
  SELECT rel, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT rel, list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, chr(13) || '$', '')) AS l FROM fl)))"""
_DIR = "CASE WHEN contains(rel, '/') THEN regexp_extract(rel, '^(.*)/[^/]*$', 1) ELSE '.' END"


def registered(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# Quality

_FILE_LIMITS = quality.FileLimits(warn=90, most=140, warn_penalty=4, most_penalty=6, least_warn=60, least_most=90, gap=20, mild=6, hard=10)


@registered(
    f"""WITH {_FACTS}, {_FILES},
p AS (SELECT file_path AS file, count(*) FILTER (complexity >= 6) AS mild, count(*) FILTER (complexity >= 10) AS hard FROM f WHERE file_path <> '' GROUP BY 1),
t AS (SELECT rel AS file, len(string_split(content, chr(10))) AS lines, greatest(90 - coalesce(mild, 0) * 4, 60) AS warn, greatest(140 - coalesce(hard, 0) * 6, 90) AS m0 FROM fl LEFT JOIN p ON rel = p.file),
u AS (SELECT file, CAST(lines AS INTEGER) AS lines, CAST(warn AS INTEGER) AS warn, CAST(greatest(m0, warn + 20) AS INTEGER) AS most FROM t)
SELECT *, CASE WHEN lines > most THEN 'error' ELSE 'warn' END AS severity FROM u WHERE lines > warn OR lines > most"""
)
def file_size_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return quality.file_verdicts(schema.files(spark, sf), schema.facts(spark, sf), _FILE_LIMITS)


@registered(
    f"""WITH {_FACTS},
j AS (SELECT fact_id, file_path AS file, symbol_name AS function, coalesce(line_number, 0) AS line, coalesce(complexity, 0) AS cx, coalesce(end_line - line_number + 1, 0) AS loc,
  coalesce(param_count, 0) AS pc, coalesce(repeated_nil_guards, 0) AS ng, CASE language WHEN 'go' THEN 80 ELSE 100 END AS wl, CASE language WHEN 'go' THEN 120 ELSE 150 END AS ml
  FROM f WHERE language IN ('go', 'python') AND symbol_kind IN ('function', 'method')),
h AS (SELECT *, CASE WHEN cx >= 10 AND loc >= 80 THEN format('function {{}} is both complex and long (CTX:{{}}, LOC:{{}}); must be refactored', function, cx, loc)
  WHEN cx >= 18 THEN format('function {{}} is excessively complex (CTX:{{}}); hard limit is 18', function, cx)
  WHEN loc >= ml THEN format('function {{}} is excessively long (LOC:{{}}); hard limit is {{}}', function, loc, ml) END AS hard FROM j),
a AS (SELECT fact_id, file, function, line, 'function-quality' AS rule_id, 'error' AS severity, hard AS message FROM h WHERE hard IS NOT NULL
  UNION ALL SELECT fact_id, file, function, line, CASE WHEN cx >= 14 THEN 'function-quality' ELSE 'function-quality.mild-ctx' END, 'warn',
    CASE WHEN cx >= 16 THEN format('function {{}} requires immediate refactoring (CTX:{{}}); exceeds refactor threshold 16', function, cx)
    WHEN cx >= 14 THEN format('function {{}} has elevated complexity (CTX:{{}}); exceeds elevated threshold 14', function, cx)
    ELSE format('function {{}} has mild complexity (CTX:{{}}); exceeds mild threshold 12', function, cx) END FROM h WHERE hard IS NULL AND cx >= 12
  UNION ALL SELECT fact_id, file, function, line, 'function-quality', 'warn', format('function {{}} is approaching size limit (LOC:{{}}); warn threshold is {{}}', function, loc, wl) FROM h WHERE hard IS NULL AND loc >= wl
  UNION ALL SELECT fact_id, file, function, line, 'function-quality', CASE WHEN pc >= 7 THEN 'error' ELSE 'warn' END,
    CASE WHEN pc >= 7 THEN format('function {{}} has excessive parameters ({{}}); hard limit is 7', function, pc) ELSE format('function {{}} has many parameters ({{}}); warn threshold is 5', function, pc) END
    FROM h WHERE hard IS NULL AND pc >= 5
  UNION ALL SELECT fact_id, file, function, line, 'function-quality', 'warn', format('function {{}} repeats plain nil-guard checks {{}} times; CTX may be inflated by distant repeated guards', function, ng) FROM h WHERE hard IS NULL AND ng >= 2)
SELECT * FROM a"""
)
def function_quality_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return quality.function_violations(schema.facts(spark, sf), quality.FunctionLimits(nil_guards=2))


@registered(
    f"""WITH {_FACTS} SELECT file_path AS file, count(*) FILTER (complexity >= 12) AS mild, count(*) FILTER (complexity >= 18) AS hard FROM f WHERE file_path <> '' GROUP BY 1"""
)
def file_penalties(spark: SparkSession, sf: str) -> DataFrame:
    return quality.file_penalties(schema.facts(spark, sf))


@registered()
def extracted_facts(spark: SparkSession, sf: str) -> DataFrame:
    return source_facts(schema.files(spark, sf)).drop("params")


# Reports


@registered(
    f"""WITH {_V}, m AS (SELECT * FROM v WHERE rule_id = 'function-quality.mild-ctx'), c AS (SELECT file, count(*) AS n FROM m GROUP BY file),
r AS (SELECT coalesce(sum(n), 0) AS n FROM c WHERE n < 2),
o AS (SELECT rule_id, file, function, message, severity, line FROM v WHERE rule_id <> 'function-quality.mild-ctx'
UNION ALL SELECT 'function-quality', file, '', file || ' has ' || n || ' low CTX violations (CTX 12-13)' || CASE WHEN n >= 4 THEN '; hotspot threshold is 4' ELSE '' END, 'warn', 0 FROM c WHERE n >= 2
UNION ALL SELECT 'function-quality', m.file, m.function, m.message, m.severity, m.line FROM m JOIN c USING (file) CROSS JOIN r WHERE c.n < 2 AND r.n < 3
UNION ALL SELECT 'function-quality', '', '', n || ' functions have low CTX violations (CTX 12-13)', 'warn', 0 FROM r WHERE n >= 3)
SELECT rule_id, file, function, message, severity, CAST(line AS INTEGER) AS line FROM o"""
)
def mild_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return report.roll_up(schema.violations(spark, sf))


@registered(
    f"""WITH {_V} SELECT file, line, function, rule_id, message, arg_min(severity, (CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, severity)) AS severity FROM v GROUP BY file, line, function, rule_id, message"""
)
def violation_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return report.deduped(schema.violations(spark, sf))


@registered(
    f"""WITH {_V} SELECT violation_id, row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, rule_id, file, function, line, message, violation_id) - 1 AS position FROM v"""
)
def violation_order(spark: SparkSession, sf: str) -> DataFrame:
    return report.positions(schema.violations(spark, sf), "violation_id").select("violation_id", "position")


@registered(
    f"""WITH {_V} SELECT severity, rule_id, count(*) AS rows, min((file, function, line, message)).file AS file, min((file, function, line, message)).function AS function,
min((file, function, line, message)).line AS line, min((file, function, line, message)).message AS message FROM (SELECT * FROM v) GROUP BY severity, rule_id""".replace(
        "min((file, function, line, message))", "min({'file': file, 'function': function, 'line': line, 'message': message})"
    )
)
def group_starts(spark: SparkSession, sf: str) -> DataFrame:
    return report.group_starts(schema.violations(spark, sf))


@registered(
    f"""WITH {_V} SELECT violation_id, upper(severity) || ' ' || CASE WHEN file = '' THEN '(repo)' ELSE file END || CASE WHEN function <> '' THEN ':' || function ELSE '' END
|| CASE WHEN line > 0 THEN ':' || line ELSE '' END || ': ' || message || ' [' || rule_id || ']' AS text FROM v"""
)
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return report.report_lines(schema.violations(spark, sf))


@registered(
    f"""WITH {_V} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity <> 'error') AS warnings, count(DISTINCT file) AS files,
CAST(count(*) FILTER (severity = 'error') > 0 AS INTEGER) AS exit_code FROM v"""
)
def report_totals(spark: SparkSession, sf: str) -> DataFrame:
    return report.totals(schema.violations(spark, sf))


@registered(
    f"""WITH {_V} SELECT CASE WHEN file = '' THEN '(repo)' ELSE file END AS file, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity <> 'error') AS warnings,
count(DISTINCT rule_id) AS rules, min(line) FILTER (line > 0) AS first_line, CAST(file = '' AS INTEGER) AS repo_last FROM v GROUP BY v.file"""
)
def report_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return report.per_file(schema.violations(spark, sf))


@registered(
    f"""WITH {_V}, r AS (SELECT *, CASE severity WHEN 'error' THEN 2 WHEN 'warn' THEN 1 WHEN 'info' THEN 0 ELSE 3 END AS rk FROM v),
b AS (SELECT * FROM r WHERE rk >= 2 OR rule_id = 'go-version-mismatch'),
n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, rule_id, violation_id) AS rn, count(*) OVER (PARTITION BY file) AS blocking FROM b)
SELECT file, line, rule_id, violation_id, severity, blocking FROM n WHERE rn = 1"""
)
def first_blocking(spark: SparkSession, sf: str) -> DataFrame:
    return report.first_blocking(schema.violations(spark, sf), "error", ("go-version-mismatch",))


_CATS = ", ".join(f"('{r}', '{c}')" for r, c in report.CATEGORIES.items())


@registered(
    f"""WITH {_V}, k(rule_id, category) AS (VALUES {_CATS}), cats AS (SELECT DISTINCT category FROM k UNION SELECT 'unlisted'),
s AS (SELECT v.rule_id, coalesce(k.category, CASE WHEN starts_with(v.rule_id, 'custom.') THEN 'custom' WHEN starts_with(v.rule_id, 'function-quality.') THEN 'quality'
  WHEN starts_with(v.rule_id, 'structure.') THEN 'structure' ELSE 'unlisted' END) AS category FROM v LEFT JOIN k USING (rule_id))
SELECT cats.category, count(DISTINCT s.rule_id) AS rules, count(s.rule_id) AS rows FROM cats LEFT JOIN s USING (category) GROUP BY cats.category"""
)
def catalog_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.by_category(schema.violations(spark, sf))


@registered(
    """WITH s AS (SELECT severity AS label, count(*) AS n FROM violations GROUP BY severity UNION ALL SELECT severity, count(*) FROM custom_rules GROUP BY severity)
SELECT label, CASE lower(trim(coalesce(label, ''))) WHEN 'warning' THEN 'warn' ELSE lower(trim(coalesce(label, ''))) END AS severity,
CASE lower(trim(coalesce(label, ''))) WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END AS advisory_rank, CAST(sum(n) AS BIGINT) AS n
FROM s GROUP BY label"""
)
def severity_normalise(spark: SparkSession, sf: str) -> DataFrame:
    labels = read_table(spark, sf, "violations").select("severity").unionByName(read_table(spark, sf, "custom_rules").select("severity"))
    label = F.col("severity")
    counted = labels.groupBy("severity").agg(F.count("*").alias("n"))
    return counted.select(label.alias("label"), S.violation_severity(label).alias("severity"), S.advisory_rank(label).alias("advisory_rank"), "n")


# Paths


@registered(
    f"""SELECT file AS path, {_CLEAN.format(c="file")} AS clean, regexp_matches(trim(coalesce(file, '')), '^(/|\\\\\\\\|[A-Za-z]:[\\\\/])') AS absolute,
CASE WHEN contains({_CLEAN.format(c="file")}, '/') THEN regexp_extract({_CLEAN.format(c="file")}, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir,
lower(regexp_extract({_CLEAN.format(c="file")}, '(\\.[^./]*)$', 1)) AS ext, count(*) AS n FROM violations GROUP BY file"""
)
def path_normalise(spark: SparkSession, sf: str) -> DataFrame:
    clean = P.clean_path(F.col("file"))
    counted = read_table(spark, sf, "violations").groupBy("file").agg(F.count("*").alias("n"))
    return counted.select(F.col("file").alias("path"), clean.alias("clean"), P.is_absolute(F.coalesce("file", F.lit(""))).alias("absolute"), P.directory(clean).alias("dir"), P.extension(clean).alias("ext"), "n")


@registered(
    f"""WITH {_FACTS} SELECT file_path, count(*) AS n FROM f WHERE file_path = 'internal/utils' OR starts_with(file_path, 'internal/utils/') OR file_path = 'web' OR starts_with(file_path, 'web/') GROUP BY file_path"""
)
def path_prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    return schema.facts(spark, sf).where(P.under_any(F.col("file_path"), ["internal/utils", "web", ""])).groupBy("file_path").agg(F.count("*").alias("n"))


_PATHS = f"paths AS (SELECT DISTINCT file_path AS rel FROM f WHERE file_path <> '' UNION SELECT rel FROM fl)"


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return schema.facts(spark, sf).where("file_path <> ''").select(F.col("file_path").alias("rel")).union(schema.files(spark, sf).select("rel")).distinct()


@registered(f"""WITH {_FACTS}, {_FILES}, {_PATHS} SELECT rel FROM paths WHERE rel LIKE '%\\_test.go' ESCAPE '\\' AND NOT (starts_with(rel, 'internal/tests/') OR starts_with(rel, 'cmd/'))""")
def test_location(spark: SparkSession, sf: str) -> DataFrame:
    return structure.misplaced_tests(_paths(spark, sf), ["internal/tests", "cmd"])


test_location.__test__ = False


@registered(
    f"""WITH {_FACTS}, {_FILES}, {_PATHS} SELECT DISTINCT string_split(rel, '/')[2] AS child FROM paths WHERE starts_with(rel, 'internal/') AND len(string_split(rel, '/')) > 2
AND string_split(rel, '/')[2] NOT IN ('adapters', 'ports', 'router', 'app', 'cliwrapper')"""
)
def allowed_children(spark: SparkSession, sf: str) -> DataFrame:
    allowed = spark.createDataFrame([(c,) for c in ("adapters", "ports", "router", "app", "cliwrapper")], "child string")
    return structure.unexpected_children(_paths(spark, sf), "internal", allowed)


@registered(
    f"""WITH {_V}, {_FACTS}, {_FILES}, {_PATHS}, up AS (SELECT DISTINCT unnest(list_transform(range(1, len(s) + 1), lambda n: array_to_string(s[1:n], '/'))) AS path FROM (SELECT string_split(rel, '/') AS s FROM paths)),
d AS (SELECT DISTINCT CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir FROM v WHERE file <> '')
SELECT path FROM (SELECT dir AS path FROM d UNION SELECT dir || '/doc.go' FROM d) WHERE path NOT IN (SELECT path FROM up)"""
)
def missing_paths(spark: SparkSession, sf: str) -> DataFrame:
    dirs = schema.violations(spark, sf).where("file <> ''").select(P.directory(F.col("file")).alias("dir")).distinct()
    configured = dirs.select(F.explode(F.array("dir", F.concat("dir", F.lit("/doc.go")))).alias("path"))
    return structure.missing_paths(configured, _paths(spark, sf))


@registered(
    f"""WITH {_FACTS}, {_FILES}, {_PATHS}, s AS (SELECT rel, string_split(rel, '/')[:-2] AS above FROM paths)
SELECT rel FROM s WHERE NOT list_has_any(above, [{", ".join(f"'{d}'" for d in structure.SKIPPED_DIRECTORIES)}]) AND NOT regexp_matches(rel, '(^|/)internal/router/') AND NOT rel LIKE '%.toml'"""
)
def walked_paths(spark: SparkSession, sf: str) -> DataFrame:
    return structure.walked(_paths(spark, sf))


@registered(
    f"""WITH {_FACTS}, a AS (SELECT DISTINCT file_path FROM f WHERE file_path <> ''), b AS (SELECT DISTINCT rel FROM source_files WHERE rel IS NOT NULL)
SELECT file_path AS path, 'left' AS side FROM a WHERE file_path NOT IN (SELECT rel FROM b) UNION ALL SELECT rel, 'right' FROM b WHERE rel NOT IN (SELECT file_path FROM a)"""
)
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    a = schema.facts(spark, sf).where("file_path <> ''").select(F.col("file_path").alias("path"))
    return registry.set_differences(a, read_table(spark, sf, "source_files").where("rel IS NOT NULL").select(F.col("rel").alias("path")), "path")


# Structure


# A section runs from its heading to the first empty comment or other line; a later heading opens it again.
_STATS = f"""{_FILES}, g AS (SELECT {_DIR} AS dir, rel, content, regexp_extract(rel, '([^/]*)$', 1) AS name FROM fl WHERE rel LIKE '%.go'),
dl AS (SELECT rel, unnest(range(1, len(l) + 1)) AS i, trim(unnest(l)) AS t FROM (SELECT rel, list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, chr(13) || '$', '')) AS l FROM g WHERE name = 'doc.go')),
ds AS (SELECT rel, i, CASE WHEN starts_with(t, '//') THEN trim(substr(t, 3)) ELSE '' END AS said FROM dl),
dm AS (SELECT *, max(CASE WHEN said = 'Package Concerns:' THEN i END) OVER w AS opened, max(CASE WHEN said = '' THEN i END) OVER w AS closed FROM ds WINDOW w AS (PARTITION BY rel ORDER BY i)),
dc AS (SELECT rel, bool_or(said = 'Package Concerns:') AS found, count(*) FILTER (opened IS NOT NULL AND opened > coalesce(closed, 0) AND said <> 'Package Concerns:' AND starts_with(said, '- ')) AS items FROM dm GROUP BY rel),
st AS (SELECT dir, count(*) FILTER (name <> 'doc.go' AND NOT name LIKE '%\\_test.go' ESCAPE '\\') AS production_go, bool_or(name = 'doc.go') AS has_doc, coalesce(max(rel) FILTER (name = 'doc.go'), '') AS doc_path,
  coalesce(bool_or(regexp_matches(regexp_extract(regexp_extract(content, '(?m)^// Package ([^\\n\\r]*)', 1), '^\\S+\\s+(\\S)', 1), '^[A-Z]')) FILTER (name = 'doc.go'), false) AS doc_prefix_ok,
  coalesce(bool_or(dc.found), false) AS has_concerns, CAST(coalesce(max(dc.items), 0) AS INTEGER) AS concern_count FROM g LEFT JOIN dc USING (rel) GROUP BY dir)"""


@registered(f"WITH {_STATS} SELECT * FROM st")
def package_stats(spark: SparkSession, sf: str) -> DataFrame:
    return structure.package_stats(schema.files(spark, sf))


@registered(
    f"""WITH {_STATS}, p AS (SELECT dir, unnest([CASE WHEN production_go > 10 THEN 'too many files' END, CASE WHEN NOT has_doc THEN 'no doc.go' END, CASE WHEN has_doc AND NOT doc_prefix_ok THEN 'doc prefix' END,
  CASE WHEN has_doc AND has_concerns AND concern_count < 1 THEN 'too few concerns' END, CASE WHEN has_doc AND NOT has_concerns THEN 'no concerns' END, CASE WHEN has_doc AND concern_count > 2 THEN 'too many concerns' END]) AS problem
  FROM st WHERE production_go > 0) SELECT * FROM p WHERE problem IS NOT NULL"""
)
def package_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return structure.package_verdicts(structure.package_stats(schema.files(spark, sf)))


@registered(
    f"""WITH {_FILES}, {_LINES},
s AS (SELECT l.rel, l.line, l.text, f.content FROM ln l JOIN fl f USING (rel) WHERE l.rel LIKE '%.go'),
b AS (SELECT rel, len(string_split(regexp_extract(content, '(?s)^(.*?\\nimport\\s*\\()', 1), chr(10))) AS a, len(string_split(regexp_extract(content, '(?s)^(.*?\\nimport\\s*\\([^)]*\\))', 1), chr(10))) AS z,
  regexp_extract(content, '(?s)^(.*?\\nimport\\s*\\()', 1) <> '' AS has FROM fl WHERE rel LIKE '%.go')
SELECT s.rel, CAST(s.line AS INTEGER) AS line, p AS path FROM (SELECT s.*, CASE WHEN regexp_extract(text, '^import\\s+(?:[\\w.]+\\s+)?"([^"]+)"', 1) <> '' THEN regexp_extract(text, '^import\\s+(?:[\\w.]+\\s+)?"([^"]+)"', 1)
  WHEN b.has AND s.line > b.a AND s.line <= b.z THEN regexp_extract(text, '^\\s*(?:[\\w.]+\\s+)?"([^"]+)"', 1) ELSE '' END AS p FROM s JOIN b USING (rel)) s WHERE p <> ''"""
)
def go_imports(spark: SparkSession, sf: str) -> DataFrame:
    return structure.go_imports(schema.files(spark, sf))


# The given Go files import the standard library only, so the paths that documents of a source mention stand for imports of that source.
_REFS = r"r AS (SELECT DISTINCT source || '/a.go' AS rel, 'corp.test/tool/' || d AS path FROM (SELECT 'internal/' || source AS source, unnest(regexp_extract_all(text, '(internal/[a-z_]+/[a-z_]+)/', 1)) AS d FROM documents WHERE source IS NOT NULL))"
_LAYERS = {"business": ["internal/review_threads", "internal/utils", "internal/cliwrapper"], "adapters": ["internal/commit_log", "internal/adapters"], "core": ["internal/design_notes", "internal/router"], "boot": ["internal/router/ext"]}


@registered(
    f"""WITH {_REFS}, k AS (SELECT rel, path, rel = 'internal/review_threads/a.go' AS biz, rel = 'internal/commit_log/a.go' AS ad, rel = 'internal/design_notes/a.go' AS core,
regexp_matches(path, '^corp.test/tool/internal/(utils|cliwrapper|review_threads)(/|$)') AS tb, regexp_matches(path, '^corp.test/tool/internal/(adapters|commit_log)(/|$)') AS ta FROM r),
j AS (SELECT rel, path, 0 AS line, CASE WHEN biz AND starts_with(path, 'corp.test/tool/internal/adapters/') THEN 'forbidden path' WHEN biz AND NOT tb AND path NOT IN ('corp.test/tool/internal/ports/scope') THEN 'outside boundaries'
WHEN ad AND tb THEN 'business package' WHEN ad AND ta THEN 'another adapter' WHEN core AND ta THEN 'core to adapter' WHEN core AND tb THEN 'core to business' END AS problem FROM k)
SELECT * FROM j WHERE problem IS NOT NULL"""
)
def layer_violations(spark: SparkSession, sf: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all("text", F.lit(r"(internal/[a-z_]+/[a-z_]+)/"), F.lit(1)))
    docs = read_table(spark, sf, "documents").where("source IS NOT NULL AND text IS NOT NULL")
    refs = docs.select(F.concat(F.lit("internal/"), F.col("source"), F.lit("/a.go")).alias("rel"), found.alias("d")).distinct()
    imports = refs.select("rel", F.lit(0).alias("line"), F.concat(F.lit("corp.test/tool/"), F.col("d")).alias("path"))
    return structure.layer_violations(imports, "corp.test/tool", *_LAYERS.values(), ["corp.test/tool/internal/adapters"], ["corp.test/tool/internal/ports/scope"])


@registered(
    f"""WITH {_FILES} SELECT rel, contains(left(content, 512), 'Code generated') AND contains(left(content, 512), 'DO NOT EDIT') AS generated,
regexp_matches(rel, '(_test\\.go|\\.gen\\.go|_mock\\.go)$') OR starts_with(regexp_extract(rel, '([^/]*)$', 1), 'zz_generated') AS skipped FROM fl"""
)
def generated_files(spark: SparkSession, sf: str) -> DataFrame:
    return structure.generated_or_skipped(schema.files(spark, sf))


# Hygiene

_TOKENS = r"CASE WHEN {n} = 'main' THEN 2 ELSE len(regexp_extract_all(regexp_replace({n}, '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '[A-Z][a-z][^_A-Z]*|[A-Z]+|[^_A-Z]+')) END"
_ACRO = "coalesce(" + ", ".join(f"CASE WHEN strpos({{n}}, '{a}') > 0 AND NOT regexp_matches(substr({{n}}, strpos({{n}}, '{a}') + {len(a)}, 1), '^\\p{{{{Ll}}}}') THEN '{a}' END" for a in T.ACRONYM_FORMS) + ")"


@registered(f"""WITH n AS (SELECT coalesce(symbol_name, '') AS name, count(*) AS n FROM policy_facts GROUP BY 1) SELECT name, CAST({_TOKENS.format(n="name")} AS INTEGER) AS tokens, {_ACRO.format(n="name")} AS acronym, n FROM n""")
def token_count(spark: SparkSession, sf: str) -> DataFrame:
    names = read_table(spark, sf, "policy_facts").groupBy(F.coalesce("symbol_name", F.lit("")).alias("name")).agg(F.count("*").alias("n"))
    return names.select("name", T.token_count(F.col("name")).alias("tokens"), T.acronym_casing(F.col("name")).alias("acronym"), "n")


@registered(
    f"""WITH {_FACTS}, j AS (SELECT fact_id, file_path AS file, symbol_name AS function, line_number AS line, CAST({_TOKENS.format(n="symbol_name")} AS INTEGER) AS tokens, {_ACRO.format(n="symbol_name")} AS a,
CASE WHEN contains(file_path, 'ports') OR contains(file_path, 'types') OR contains(file_path, 'contracts') THEN 3 ELSE 2 END AS needed FROM f
WHERE regexp_matches(symbol_name, '^\\p{{Lu}}') AND NOT (symbol_kind = 'function' AND symbol_name IN ('main', 'init', 'New', 'Run', 'String', 'Error')))
SELECT fact_id, file, function, line, tokens, CASE WHEN a IS NOT NULL THEN 'acronym ' || a ELSE 'fewer than ' || needed || ' words' END AS problem FROM j WHERE a IS NOT NULL OR tokens < needed"""
)
def symbol_names(spark: SparkSession, sf: str) -> DataFrame:
    return hygiene.symbol_name_violations(schema.facts(spark, sf))


_DOC_LINES = r"list_transform(string_split(docstring, chr(10)), lambda x: trim(regexp_replace(regexp_replace(trim(x), '^(//|/\*)', ''), '\*/$', '')))"


@registered(
    f"""WITH {_FACTS}, d AS (SELECT fact_id, symbol_name AS s, {_DOC_LINES} AS l FROM f WHERE trim(docstring) <> '')
SELECT fact_id, 'name' AS problem FROM d WHERE NOT list_bool_or(list_transform(l, lambda x: x = s OR starts_with(x, s || ' ') OR starts_with(x, s || chr(9))))
UNION ALL SELECT fact_id, 'todo' FROM d WHERE list_bool_or(list_transform(l, lambda x: regexp_matches(x, '(?i)todo|fixme')))
UNION ALL SELECT fact_id, 'short' FROM d WHERE len(list_filter(regexp_split_to_array(trim(array_to_string(l, ' ')), '\\s+'), lambda w: w <> '')) < 5"""
)
def doc_style(spark: SparkSession, sf: str) -> DataFrame:
    return hygiene.doc_style_problems(schema.facts(spark, sf))


@registered(
    f"""WITH {_FACTS}, s AS (SELECT fact_id, symbol_name, coalesce(list_filter(list_transform(string_split(docstring, chr(10)), lambda x: trim(regexp_replace(x, '[\\r\\t]', ' ', 'g'))), lambda x: x <> '')[1], '') AS t
  FROM f WHERE language IN ('python', 'typescript')),
p AS (SELECT fact_id, t, CASE WHEN t = '' THEN 'empty' WHEN regexp_replace(lower(t), '[.\\s]+$', '') = lower(symbol_name) THEN 'symbol' WHEN length(t) < 10 THEN 'short'
  WHEN starts_with(lower(t), 'this function') OR starts_with(lower(t), 'this method') OR starts_with(lower(t), 'helper') THEN 'weak' END AS problem FROM s)
SELECT fact_id, CASE WHEN length(t) > 200 THEN left(t, 200) || '...' ELSE t END AS summary, problem FROM p WHERE problem IS NOT NULL"""
)
def summary_quality(spark: SparkSession, sf: str) -> DataFrame:
    return hygiene.summary_problems(schema.facts(spark, sf))


@registered(
    f"""WITH {_FACTS}, j AS (SELECT fact_id, docstring AS d, params, CASE WHEN language = 'typescript' THEN 'tsdoc' WHEN regexp_matches(docstring, '(?m)^\\s*Args:\\s*$') THEN 'google'
  WHEN regexp_matches(docstring, '(?m)^\\s*Parameters\\s*\\n\\s*-{{3,}}\\s*$') THEN 'numpy' ELSE 'rest' END AS style FROM f WHERE language IN ('python', 'typescript') AND trim(docstring) <> ''),
u AS (SELECT fact_id, d, style, unnest(params) AS param FROM j)
SELECT fact_id, style, param FROM u WHERE param NOT IN ('self', 'cls', '') AND NOT CASE style WHEN 'tsdoc' THEN contains(d, '@param ' || param) WHEN 'rest' THEN contains(d, ':param ' || param || ':') ELSE contains(d, param || ':') END"""
)
def missing_parameters(spark: SparkSession, sf: str) -> DataFrame:
    return hygiene.missing_parameters(schema.facts(spark, sf))


@registered(
    f"""WITH {_FACTS}, l AS (SELECT fact_id, list_transform(string_split(docstring, chr(10)), lambda x: trim(x)) AS l FROM f WHERE trim(docstring) <> '')
SELECT fact_id, CASE WHEN len(l) < 2 THEN false ELSE NOT list_contains(l, '') AND l[1] LIKE '%.' AND left(l[2], 1) = upper(left(l[2], 1)) END AS needs_gap FROM l"""
)
def paragraph_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return hygiene.paragraph_gaps(schema.facts(spark, sf))


@registered(
    f"""WITH {_FILES}, h AS (SELECT rel, regexp_extract(rel, '(\\.[^./]*)$', 1) AS ext, CASE WHEN rel LIKE '%.py' THEN '#' ELSE '//' END AS sign,
  list_transform(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END, lambda x: trim(x)) AS ls FROM (SELECT rel, list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, chr(13) || '$', '')) AS l FROM fl WHERE regexp_matches(rel, '\\.(go|ts|py)$'))),
s AS (SELECT rel, ext, list_transform(ls, lambda x: CASE WHEN starts_with(x, sign) THEN trim(substr(x, length(sign) + 1)) END) AS said FROM h),
o AS (SELECT *, coalesce(list_position(said[1:6], rel), 0) AS ok_at FROM s),
d AS (SELECT *, coalesce(list_position(list_transform(said[ok_at + 1:], lambda x: coalesce(x = '', true)), true), 0) AS stop, len(said[ok_at + 1:]) AS rest FROM o)
SELECT rel, CASE WHEN ok_at > 0 THEN 'ok' WHEN coalesce(list_bool_or(list_transform(said[1:6], lambda x: contains(x, '/') AND NOT contains(x, ' ') AND ends_with(x, ext))), false) THEN 'stale' ELSE 'missing' END AS status,
CAST(CASE WHEN ok_at = 0 THEN 0 WHEN stop = 0 THEN rest ELSE stop - 1 END AS INTEGER) AS described FROM d"""
)
def header_status(spark: SparkSession, sf: str) -> DataFrame:
    return hygiene.header_status(schema.files(spark, sf))


_IS_PATH = "regexp_matches({x}, '^' || sign || '\\s*\\S*[^\\s/]\\S*(?:' || exts || ')\\s*$')"
_FIRST_NOT = "coalesce(nullif(list_position(list_transform({l}, lambda x: {c}), false), 0), len({l}) + 1)"
_BUILD = "starts_with(x, '//go:build') OR starts_with(x, '// +build')"


@registered(
    f"""WITH {_FILES}, a AS (SELECT rel, content, CASE WHEN regexp_matches(lower(rel), '\\.go$') THEN 'go' WHEN regexp_matches(lower(rel), '\\.py$') THEN 'python' WHEN regexp_matches(lower(rel), '\\.tsx?$') THEN 'typescript' END AS language FROM fl
  WHERE NOT list_has_any(string_split(rel, '/')[:-2], [{", ".join(f"'{d}'" for d in headers.SKIPPED_DIRECTORIES)}])),
b AS (SELECT *, CASE language WHEN 'python' THEN '#' ELSE '//' END AS sign, CASE language WHEN 'go' THEN '\\.go' WHEN 'python' THEN '\\.py' ELSE '\\.ts|\\.tsx' END AS exts, contains(content, chr(13) || chr(10)) AS crlf,
  string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS p, list_transform(string_split(content, chr(10))[1:6], lambda x: regexp_replace(x, chr(13) || '$', '')) AS head FROM a WHERE language IS NOT NULL),
c AS (SELECT *, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS l, coalesce(list_filter(head, lambda x: {_IS_PATH.format(x="x")})[1] = sign || ' ' || rel, false) AS own FROM b),
d AS (SELECT *, coalesce(l[1], '') AS first, {_FIRST_NOT.format(l="l", c="x = '' OR starts_with(x, '//')")} AS rest_at FROM c),
e AS (SELECT *, CASE WHEN starts_with(first, '#!') THEN l[2:] ELSE l END AS py, list_concat(list_filter(l[1:rest_at - 1], lambda x: NOT {_IS_PATH.format(x="x")}), l[rest_at:]) AS body FROM d),
f AS (SELECT *, CASE language WHEN 'go' THEN {_FIRST_NOT.format(l="body", c=_BUILD)} ELSE 1 END AS a1 FROM e),
g AS (SELECT *, CASE language WHEN 'go' THEN a1 + {_FIRST_NOT.format(l="body[a1:]", c="x = ''")} - 1 ELSE 1 END AS k FROM f),
o AS (SELECT rel, language, content, own, crlf, CASE WHEN language = 'python' THEN list_concat([CASE WHEN starts_with(first, '#!') THEN first ELSE '#!/usr/bin/env python3' END, '# ' || rel], CASE WHEN coalesce({_IS_PATH.format(x="py[1]")}, false) THEN py[2:] ELSE py END)
  ELSE list_concat(list_concat(body[1:k - 1], ['// ' || rel]), list_concat(CASE WHEN starts_with(coalesce(body[k], ''), '//') THEN [''] ELSE [] END, body[k:])) END AS made FROM g),
m AS (SELECT rel, language, content, CASE WHEN own THEN content WHEN crlf THEN array_to_string(made, chr(13) || chr(10)) || chr(13) || chr(10) ELSE array_to_string(made, chr(10)) || chr(10) END AS made FROM o)
SELECT rel, language, made <> content AS changed, sha256(made) AS checksum FROM m"""
)
def header_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    return headers.formatted(schema.files(spark, sf)).select("rel", "language", "changed", F.sha2("content", 256).alias("checksum"))


# Contracts


@registered(f"""WITH {_FILES}, {_LINES} SELECT rel, count(*) AS lines, CAST(max(length(text)) AS INTEGER) AS longest FROM ln GROUP BY rel""")
def line_records(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.line_table(schema.files(spark, sf)).groupBy("rel").agg(F.count("*").alias("lines"), F.max(F.length("text")).alias("longest"))


@registered(
    f"""WITH {_FILES}, {_LINES}, m AS (SELECT rel, CAST(line AS INTEGER) AS line, CASE WHEN contains(text, 'fmt.Print(') THEN 'fmt.Print(' WHEN contains(text, 'fmt.Printf(') THEN 'fmt.Printf(' WHEN contains(text, 'fmt.Println(') THEN 'fmt.Println('
WHEN contains(text, 'console.log(') THEN 'console.log(' WHEN contains(text, 'print(') THEN 'print(' WHEN contains(text, 'log(') THEN 'log(' END AS form FROM (SELECT rel, line, trim(text) AS text FROM ln) WHERE NOT starts_with(text, '//') AND NOT starts_with(text, '#'))
SELECT * FROM m WHERE form IS NOT NULL"""
)
def forbidden_prints(spark: SparkSession, sf: str) -> DataFrame:
    forms = ("fmt.Print(", "fmt.Printf(", "fmt.Println(", "console.log(", "print(", "log(")
    return contracts.forbidden_prints(schema.files(spark, sf), forms)


@registered(
    f"""WITH {_FILES}, c AS (SELECT rel, regexp_replace(content, '(?s)//[^\\n]*|/\\*.*?\\*/|"(?:\\\\.|[^"\\\\\\n])*"', ' ', 'g') AS code FROM fl),
u AS (SELECT DISTINCT rel, unnest(regexp_extract_all(code, '\\b([A-Za-z_]\\w*\\.[A-Za-z_]\\w*)\\(', 1)) AS call FROM c)
SELECT rel, call FROM u WHERE call IN ('fmt.Errorf', 'fmt.Println', 'os.Exit', 'owner.push', 'line.append') AND NOT starts_with(rel, 'cmd/')"""
)
def forbidden_calls(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.forbidden_calls(schema.files(spark, sf), ["fmt.Errorf", "fmt.Println", "os.Exit", "owner.push", "line.append"], "restrict", ("cmd",))


@registered(
    f"""WITH {_FILES}, m AS (SELECT rel, list_filter(['func ', 'return', 'quux_flag', 'error'], lambda w: NOT contains(content, w)) AS missing FROM fl)
SELECT rel, missing FROM m WHERE NOT (SELECT bool_or(len(missing) = 0) FROM m)"""
)
def required_words(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.required_words(schema.files(spark, sf), "rel", "content", ["func ", "return", "quux_flag", "error"])


_KNOB = r"^\s*(?:var|const|let|self\.)?\s*"


@registered(
    f"""WITH {_FILES}, {_LINES}, k AS (SELECT rel, CAST(line AS INTEGER) AS line, regexp_extract(text, '{_KNOB}([A-Za-z_]\\w*)\\s*(?::=|=|:)\\s*', 1) AS name,
regexp_extract(text, '{_KNOB}[A-Za-z_]\\w*\\s*(?::=|=|:)\\s*(-?\\d[\\w.]*|"[^"]*")', 1) AS value FROM ln)
SELECT * FROM k WHERE value <> '' AND (name LIKE '%Timeout' OR name LIKE '%Port' OR name LIKE '%Retries' OR name LIKE '%limit' OR name LIKE '%depth')"""
)
def hardcoded_knobs(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.hardcoded_knobs(schema.files(spark, sf))


@registered(
    """WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS line_no, unnest(s) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
m AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN contains(l, 'toolchain') THEN 'toolchain' WHEN contains(l, 'version') THEN 'version' WHEN contains(l, 'Since') THEN 'Since' END AS marker FROM l WHERE contains(l, '1.2') AND NOT contains(l, '1.24'))
SELECT * FROM m WHERE marker IS NOT NULL"""
)
def version_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.version_mentions(read_table(spark, sf, "documents"))


_STRINGS = """st AS (SELECT DISTINCT 'macros' AS src, macro_id AS id, 'steps' AS field, CAST(unnest(range(0, len(steps))) AS INTEGER) AS pos, unnest(steps) AS text FROM macros
UNION SELECT 'tooling_gates', gate_id, 'gate', 0, gate FROM tooling_gates UNION SELECT 'tooling_gates', gate_id, 'run', 0, run FROM tooling_gates)"""
_KEYS = ["src", "id", "field", "pos"]


def _strings(spark: SparkSession, sf: str) -> DataFrame:
    m = read_table(spark, sf, "macros").select(F.lit("macros").alias("src"), F.col("macro_id").alias("id"), F.lit("steps").alias("field"), F.posexplode("steps").alias("pos", "text"))
    for field in ("gate", "run"):
        m = m.unionByName(read_table(spark, sf, "tooling_gates").select(F.lit("tooling_gates").alias("src"), F.col("gate_id").alias("id"), F.lit(field).alias("field"), F.lit(0).alias("pos"), F.col(field).alias("text")))
    return m.distinct()


_BENIGN = " OR ".join(f"contains(l, '{b}')" for b in contracts.BENIGN)
_KW = " ".join(f"WHEN contains(l, '{k}') THEN '{k}'" for k in contracts.KEYWORDS)
_KWRE = "|".join(contracts.KEYWORDS)


@registered(
    f"""WITH {_STRINGS}, l AS (SELECT src, id, field, pos, unnest(range(1, len(s) + 1)) AS line_no, unnest(s) AS l FROM (SELECT *, string_split(lower(text), chr(10)) AS s FROM st WHERE text IS NOT NULL)),
m AS (SELECT src, id, field, pos, CAST(line_no AS INTEGER) AS line_no, CASE {_KW} END AS keyword, CASE WHEN regexp_matches(l, '(?:{_KWRE})\\w*["'']?\\s*[:=]\\s*["'']?[^\\s"'']{{6,}}') THEN 'HIGH' ELSE 'LOW' END AS tier FROM l WHERE NOT ({_BENIGN}))
SELECT * FROM m WHERE keyword IS NOT NULL"""
)
def secret_keyword(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.keyword_lines(_strings(spark, sf), _KEYS, "text")


@registered(
    f"""WITH {_STRINGS}, u AS (SELECT DISTINCT src, id, field, pos, unnest(regexp_extract_all(text, '([A-Za-z0-9+/_=-]{{33,}})', 1)) AS value FROM st WHERE text IS NOT NULL),
e AS (SELECT *, round(list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: -(length(value) - length(replace(value, c, ''))) / length(value) * log2((length(value) - length(replace(value, c, ''))) / length(value)))), 6) AS bits FROM u)
SELECT * FROM e WHERE bits >= 4.0"""
)
def secret_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.dense_strings(_strings(spark, sf), _KEYS, "text")


_EXTS = "(lower(r.language) IN ('', 'any') OR (lower(r.language) = 'go' AND ext = '.go') OR (lower(r.language) = 'python' AND ext = '.py') OR (lower(r.language) = 'typescript' AND ext IN ('.ts', '.tsx')))"


# The given patterns mean the same in both dialects. None looks at a text's ends, so a line can only match where its file does.
@registered(
    f"""WITH {_FILES}, {_LINES}, r AS (SELECT id, pattern, coalesce(severity, '') AS severity, coalesce(language, '') AS language, coalesce(file_glob, '') AS file_glob FROM custom_rules WHERE enabled AND pattern <> ''),
t AS (SELECT rel, string_agg(text, chr(10) ORDER BY line) AS content, lower(regexp_extract(rel, '(\\.[^./]*)$', 1)) AS ext FROM ln GROUP BY rel),
sc AS MATERIALIZED (SELECT rel, content, id, pattern, severity FROM t JOIN r ON {_EXTS}
AND (file_glob = '' OR regexp_full_match(rel, replace(replace(replace(replace(file_glob, '.', '\\.'), '**', chr(1)), '*', '[^/]*'), chr(1), '.*')))),
fit AS MATERIALIZED (SELECT rel, id, pattern, severity FROM sc WHERE regexp_matches(content, '(?m)' || pattern))
SELECT rel, CAST(line AS INTEGER) AS line, 'custom.' || id AS rule_id, severity FROM fit JOIN ln USING (rel) WHERE regexp_matches(text, pattern)"""
)
def custom_rule_hits(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.rule_hits(schema.files(spark, sf), read_table(spark, sf, "custom_rules"))


@registered(
    f"""WITH {_FILES}, sc AS (SELECT DISTINCT coalesce(language, '') AS language, coalesce(file_glob, '') AS file_glob FROM custom_rules WHERE enabled),
p AS (SELECT rel, lower(regexp_extract(rel, '(\\.[^./]*)$', 1)) AS ext FROM fl)
SELECT language, file_glob, rel FROM sc JOIN p ON (lower(language) IN ('', 'any') OR (lower(language) = 'go' AND ext = '.go') OR (lower(language) = 'python' AND ext = '.py') OR (lower(language) = 'typescript' AND ext IN ('.ts', '.tsx')))
AND (file_glob = '' OR regexp_full_match(rel, replace(replace(replace(replace(file_glob, '.', '\\.'), '**', chr(1)), '*', '[^/]*'), chr(1), '.*')))"""
)
def custom_rule_scopes(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.scope_matches(read_table(spark, sf, "custom_rules"), schema.files(spark, sf))


# Registries and commands


@registered(f"""WITH {_FILES} SELECT rel AS file, sha256(content) AS checksum FROM fl""")
def sha256_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return registry.checksums(schema.files(spark, sf))


@registered(
    """WITH a AS (SELECT rel AS file, sha256(content) AS c FROM source_files WHERE content IS NOT NULL AND captured_at < TIMESTAMP '2025-10-10' QUALIFY row_number() OVER (PARTITION BY rel ORDER BY captured_at DESC, content DESC) = 1),
b AS (SELECT rel AS file, sha256(CASE WHEN rel LIKE '%.py' THEN content || '#' ELSE content END) AS c FROM source_files WHERE content IS NOT NULL AND captured_at >= TIMESTAMP '2025-09-10' QUALIFY row_number() OVER (PARTITION BY rel ORDER BY captured_at DESC, content DESC) = 1)
SELECT coalesce(a.file, b.file) AS file, CASE WHEN b.c IS NULL THEN 'missing' WHEN a.c IS NULL THEN 'unexpected' ELSE 'changed' END AS verdict FROM a FULL JOIN b ON a.file = b.file WHERE a.c IS DISTINCT FROM b.c"""
)
def lock_verify(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "source_files").where("content IS NOT NULL")
    once = lambda df: df.groupBy("rel").agg(F.max_by("content", F.struct("captured_at", "content")).alias("content"))
    lock = once(rows.where("captured_at < TIMESTAMP '2025-10-10'"))
    now = once(rows.where("captured_at >= TIMESTAMP '2025-09-10'")).withColumn("content", F.when(F.col("rel").endswith(".py"), F.concat("content", F.lit("#"))).otherwise(F.col("content")))
    return registry.lock_verdicts(registry.checksums(lock), registry.checksums(now))


@registered(
    """WITH g AS (SELECT name, max({'repo': repo, 'gate_id': gate_id, 'run': run}) AS r FROM tooling_gates WHERE name IS NOT NULL AND repo < 'm' GROUP BY name),
o AS (SELECT name, max({'repo': repo, 'gate_id': gate_id, 'run': run}) AS r FROM tooling_gates WHERE name IS NOT NULL AND repo >= 'm' GROUP BY name)
SELECT coalesce(g.name, o.name) AS name, coalesce(o.r, g.r).repo AS repo, coalesce(o.r, g.r).gate_id AS gate_id, coalesce(o.r, g.r).run AS run, CASE WHEN o.r IS NOT NULL THEN 'over' ELSE 'base' END AS origin
FROM g FULL JOIN o ON g.name = o.name"""
)
def config_merge(spark: SparkSession, sf: str) -> DataFrame:
    gates = read_table(spark, sf, "tooling_gates").where("name IS NOT NULL")
    # The latest by repo and id of each name stands for a repository's configuration.
    top = lambda df: df.groupBy("name").agg(F.max(F.struct("repo", "gate_id", "run")).alias("r")).select("name", "r.*")
    return registry.merged(top(gates.where("repo < 'm'")), top(gates.where("repo >= 'm'")), "name", ["repo", "gate_id", "run"])


@registered("""SELECT repo, name, count(DISTINCT macro_id) AS n FROM macros GROUP BY repo, name HAVING count(DISTINCT macro_id) > 1""")
def repeated_names(spark: SparkSession, sf: str) -> DataFrame:
    return registry.repeated_keys(read_table(spark, sf, "macros").select("macro_id", "repo", "name").distinct(), ["repo", "name"])


@registered(
    f"""WITH {_V}, must AS (SELECT DISTINCT rule_id FROM v WHERE severity = 'error' AND rule_id NOT LIKE 'custom.%' AND rule_id <> ''), h AS (SELECT DISTINCT file, rule_id FROM v),
g AS (SELECT DISTINCT file FROM v) SELECT file, list(must.rule_id ORDER BY must.rule_id) AS lacking FROM g CROSS JOIN must WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.file = g.file AND h.rule_id = must.rule_id) GROUP BY file"""
)
def strictness_subset(spark: SparkSession, sf: str) -> DataFrame:
    v = schema.violations(spark, sf)
    must = v.where("severity = 'error' AND rule_id NOT LIKE 'custom.%' AND rule_id <> ''")
    return registry.not_stricter(must, v, "file", "rule_id")


@registered(
    f"""WITH RECURSIVE {_FACTS}, d AS (SELECT DISTINCT CASE WHEN contains(file_path, '/') THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir FROM f WHERE file_path <> ''),
e AS (SELECT DISTINCT unnest(list_transform(range(2, len(s) + 1), lambda n: {{'node': array_to_string(s[1:n], '/'), 'needs': array_to_string(s[1:n - 1], '/')}}), recursive := true) FROM (SELECT string_split(dir, '/') AS s FROM d) WHERE len(s) > 1),
w(node, level) AS (SELECT DISTINCT needs, 0 FROM e WHERE needs NOT IN (SELECT node FROM e) UNION SELECT e.node, w.level + 1 FROM w JOIN e ON e.needs = w.node)
SELECT node, max(level) AS level, false AS in_circle FROM w GROUP BY node"""
)
def dependency_levels(spark: SparkSession, sf: str) -> DataFrame:
    dirs = schema.facts(spark, sf).where("file_path <> ''").select(P.directory(F.col("file_path")).alias("dir")).distinct()
    return registry.dependency_levels(registry.parent_edges(dirs))


@registered(
    """WITH o AS (SELECT * FROM macros QUALIFY row_number() OVER (PARTITION BY macro_id ORDER BY ingested_at DESC) = 1),
c AS (SELECT *, CASE WHEN lower(trim(coalesce(on_failure, ''))) IN ('', 'stop') THEN 'stop' WHEN lower(trim(on_failure)) = 'continue' THEN 'continue' ELSE 'invalid' END AS mode,
  coalesce(len(list_filter(steps, lambda s: coalesce(trim(s) <> '', false))), 0) AS k, coalesce(len(steps), 0) AS n FROM o)
SELECT macro_id, mode, CAST(k AS INTEGER) AS steps, array_to_string(list_filter([CASE WHEN coalesce(trim(name), '') = '' THEN 'no name' END, CASE WHEN k = 0 THEN 'no steps' END, CASE WHEN k > 0 AND k < n THEN 'blank step' END,
  CASE WHEN description IS NULL THEN 'no description' END, CASE WHEN mode = 'invalid' THEN 'bad mode' END], lambda x: x IS NOT NULL), ',') AS problems FROM c"""
)
def macro_lint(spark: SparkSession, sf: str) -> DataFrame:
    return commands.macro_lint(read_table(spark, sf, "macros"))


_COMMANDS = f"""{_STRINGS}, cm AS (SELECT src, id, field, pos, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\\\\\\r?\\n\\s*', '', 'g'), '\\s*&&\\s*|;\\s|\\n'), lambda x: trim(x)), lambda x: x <> '')) AS command FROM st WHERE text IS NOT NULL)"""
_KIND = """CASE WHEN a[1] = 'run-job' THEN 'macro' WHEN a[1] = 'fmt' AND a[2] = 'headers' THEN 'format' WHEN (a[1] = 'go' AND a[2] IN ('get', 'install')) OR (a[1] = 'npm' AND a[2] IN ('install', 'i', 'add', 'ci')) OR (a[1] = 'pip' AND a[2] = 'install')
 OR (a[1] = 'uv' AND a[2] IN ('add', 'pip')) OR (a[1] IN ('pnpm', 'yarn') AND a[2] = 'add') THEN 'package'
 WHEN a[1] IN ('go', 'npm', 'npx', 'pip', 'uv', 'pytest', 'eslint', 'mypy', 'ruff', 'make', 'docker', 'gofumpt', 'golangci-lint', 'staticcheck') THEN 'tool' ELSE 'passthrough' END"""


@registered(f"""WITH {_COMMANDS}, s AS (SELECT src, field, regexp_split_to_array(command, '\\s+') AS a FROM cm) SELECT src, field, {_KIND} AS kind, count(*) AS n FROM s GROUP BY ALL""")
def command_kinds(spark: SparkSession, sf: str) -> DataFrame:
    c = commands.simple_commands(_strings(spark, sf), _KEYS, "text")
    return c.groupBy("src", "field", commands.command_kind(F.col("command")).alias("kind")).agg(F.count("*").alias("n"))


@registered(
    f"""WITH {_COMMANDS}, s AS (SELECT src, id, field, pos, regexp_split_to_array(command, '\\s+') AS a FROM cm)
SELECT src, id, field, pos, a[1] AS manager, a[2] AS action, CASE a[1] WHEN 'go' THEN 'Go' WHEN 'pip' THEN 'PyPI' WHEN 'uv' THEN 'PyPI' ELSE 'npm' END AS ecosystem, array_to_string(list_filter(a[3:], lambda x: NOT starts_with(x, '-')), ' ') AS packages
FROM s WHERE {_KIND} = 'package'"""
)
def install_requests(spark: SparkSession, sf: str) -> DataFrame:
    return commands.install_requests(commands.simple_commands(_strings(spark, sf), _KEYS, "text"), _KEYS)


@registered(
    f"""WITH {_STRINGS} SELECT DISTINCT src, id, field, pos, unnest(regexp_extract_all(text, '\\{{\\{{\\s*\\.?(\\w+)\\s*\\}}\\}}', 1)) AS name FROM st WHERE text IS NOT NULL"""
)
def template_names(spark: SparkSession, sf: str) -> DataFrame:
    return commands.placeholders(_strings(spark, sf), _KEYS, "text")


@registered("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


_EXPECTED = ["file-size", "function-quality", "hygiene.documentation"]


@registered(
    f"""WITH r AS (SELECT DISTINCT coalesce(file, '') AS session, coalesce(rule_id, '') AS reporter, CASE WHEN lower(trim(severity)) = 'error' THEN 'failed' ELSE 'success' END AS status, reported_at AS ts, violation_id FROM violations),
n AS (SELECT *, row_number() OVER (PARTITION BY session, reporter ORDER BY ts, violation_id) AS k, row_number() OVER (PARTITION BY session ORDER BY ts, reporter) AS pos FROM r),
e AS (SELECT *, CASE WHEN reporter NOT IN ('file-size', 'function-quality', 'hygiene.documentation') THEN 'unknown' WHEN k > 1 AND status = 'success' THEN 'duplicate' WHEN status <> 'success' THEN 'failed' END AS bad,
  count(*) FILTER (k = 1 AND status = 'success' AND reporter IN ('file-size', 'function-quality', 'hygiene.documentation')) OVER (PARTITION BY session ORDER BY ts, reporter ROWS UNBOUNDED PRECEDING) AS good FROM n),
d AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN good = 3 THEN 'complete' END AS outcome FROM e)
SELECT s.session, coalesce(x.outcome, 'open') AS outcome, x.reporter FROM (SELECT DISTINCT session FROM r) s LEFT JOIN (SELECT session, arg_min(outcome, pos) AS outcome, arg_min(reporter, pos) AS reporter FROM d WHERE outcome IS NOT NULL GROUP BY session) x USING (session)"""
)
def session_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "violations")
    reports = rows.select(
        F.coalesce("file", F.lit("")).alias("session"), F.coalesce("rule_id", F.lit("")).alias("reporter"),
        F.when(F.lower(F.trim("severity")) == "error", "failed").otherwise("success").alias("status"), F.col("reported_at").alias("at"), "violation_id",
    ).distinct()
    return finished_sessions(reports.drop("violation_id"), _EXPECTED)


# Documentation and headers

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_SUMMARY = "CASE WHEN {t} = '' THEN 'empty' WHEN regexp_replace(lower({t}), '[.\\s]+$', '') = lower(s) THEN 'symbol' WHEN length({t}) < 10 THEN 'short' WHEN starts_with(lower({t}), 'this function') OR starts_with(lower({t}), 'this method') OR starts_with(lower({t}), 'helper') THEN 'weak' END"


def _documentation_sql(python: str) -> str:
    """SQL of the strict documentation rule; ``python`` is an expression over the docstring ``d`` and parameters ``ps``."""
    return f"""WITH {_FACTS}, j AS (SELECT fact_id, language, symbol_name AS s, docstring AS d, list_filter(coalesce(params, []), lambda p: p NOT IN ('self', 'cls', '')) AS ps FROM f
  WHERE language IN ('python', 'typescript') AND symbol_kind IN ('function', 'method')),
t AS (SELECT *, coalesce(list_filter(list_transform(string_split(d, chr(10)), lambda x: trim(regexp_replace(x, '[\\r\\t]', ' ', 'g'))), lambda x: x <> '')[1], '') AS first,
  coalesce(list_filter(list_transform(string_split(d, chr(10)), lambda x: {_STRIP.format(x="regexp_replace(regexp_replace(regexp_replace(" + _STRIP.format(x="x") + ", '^/[*][*]', ''), '^[*]/', ''), '^\\s*[*]', '')")}), lambda x: x <> '' AND NOT starts_with(x, '@'))[1], '') AS tagged FROM j),
p AS (SELECT fact_id, CASE WHEN {_STRIP.format(x="d")} = '' THEN ['missing documentation']
  WHEN language = 'python' THEN CASE WHEN {_SUMMARY.format(t="first")} IS NOT NULL THEN ['summary ' || {_SUMMARY.format(t="first")}] ELSE {python} END
  WHEN NOT starts_with({_STRIP.format(x="d")}, '/**') THEN ['no documentation block']
  WHEN {_SUMMARY.format(t="tagged")} IS NOT NULL THEN ['summary ' || {_SUMMARY.format(t="tagged")}]
  ELSE list_concat(list_transform(list_filter(ps, lambda p: NOT contains(d, '@param ' || p)), lambda p: 'missing @param ' || p), CASE WHEN contains(d, '@return') THEN [] ELSE ['missing @returns'] END) END AS problems FROM t)
SELECT fact_id, unnest(problems) AS problem FROM p"""


_GOOGLE = "list_filter([CASE WHEN len(ps) > 0 AND NOT regexp_matches(d, '(?m)^\\s*Args:\\s*$') THEN 'missing Args' END, CASE WHEN NOT regexp_matches(d, '(?m)^\\s*(Returns|Yields):\\s*$') THEN 'missing Returns' END], lambda x: x IS NOT NULL)"
_NUMPY = "list_filter([CASE WHEN len(ps) > 0 AND NOT regexp_matches(d, '(?m)^\\s*Parameters\\s*\\n\\s*-{3,}\\s*$') THEN 'missing Parameters' END, CASE WHEN NOT regexp_matches(d, '(?m)^\\s*Returns\\s*\\n\\s*-{3,}\\s*$') THEN 'missing Returns' END], lambda x: x IS NOT NULL)"
_REST = "list_concat(list_transform(list_filter(ps, lambda p: NOT contains(d, ':param ' || p || ':')), lambda p: 'missing :param ' || p), CASE WHEN contains(d, ':returns:') OR contains(d, ':return:') THEN [] ELSE ['missing :returns:'] END)"


@registered(_documentation_sql(_GOOGLE))
def documentation_google(spark: SparkSession, sf: str) -> DataFrame:
    return hygiene.documentation_problems(schema.facts(spark, sf))


@registered(_documentation_sql(_NUMPY))
def documentation_numpy(spark: SparkSession, sf: str) -> DataFrame:
    return hygiene.documentation_problems(schema.facts(spark, sf), python_style="numpy")


@registered(_documentation_sql(_REST))
def documentation_rest(spark: SparkSession, sf: str) -> DataFrame:
    return hygiene.documentation_problems(schema.facts(spark, sf), python_style="restructuredtext")


def _header_sql(strict: bool) -> str:
    window, word = (1, "incorrect") if strict else (6, "missing")
    root = "ext = '.py' AND starts_with(rel, 'tools/')" if strict else "false"
    return f"""WITH {_FILES}, h AS (SELECT rel, lower(regexp_extract(rel, '(\\.[^./]*)$', 1)) AS ext, list_transform(string_split(content, chr(10)), lambda x: {_STRIP.format(x="x")}) AS ls FROM fl WHERE regexp_matches(lower(rel), '\\.(go|ts|py)$')),
g AS (SELECT rel, ext, ls, CASE WHEN ext = '.py' THEN '#' ELSE '//' END AS sign, CASE WHEN ext = '.py' AND CASE WHEN {root} THEN ls[1] = '#!/usr/bin/env python3' ELSE starts_with(ls[1], '#!') END THEN 2 ELSE 1 END AS start FROM h),
s AS (SELECT *, list_transform(ls, lambda x: CASE WHEN starts_with(x, sign) THEN {_STRIP.format(x="substr(x, length(sign) + 1)")} ELSE '' END) AS said FROM g),
a AS (SELECT *, start + nullif(list_position(said[start:start + {window - 1}], rel), 0) - 1 AS header FROM s),
n AS (SELECT *, CASE WHEN coalesce(list_position(said[header + 1:], ''), 0) = 0 THEN len(said[header + 1:]) ELSE list_position(said[header + 1:], '') - 1 END AS n FROM a)
SELECT rel, CAST(1 AS INTEGER) AS line, 'missing shebang' AS problem FROM n WHERE {root} AND ls[1] <> '#!/usr/bin/env python3'
UNION ALL SELECT rel, CAST(start AS INTEGER), 'header is {word}' FROM n WHERE header IS NULL
UNION ALL SELECT rel, CAST(header + 1 AS INTEGER), 'description has ' || n || ' line(s)' FROM n WHERE header IS NOT NULL AND (n < 2 OR n > 5)"""


@registered(_header_sql(False))
def header_loose(spark: SparkSession, sf: str) -> DataFrame:
    return hygiene.header_problems(schema.files(spark, sf))


@registered(_header_sql(True))
def header_strict(spark: SparkSession, sf: str) -> DataFrame:
    return hygiene.header_problems(schema.files(spark, sf), "strict", ("tools",))


# Flags, knobs and versions

_FLAGS = ["flag.String(", "--json", "quux_flag"]


@registered(
    f"""WITH {_FILES}, m AS (SELECT rel, list_filter(['flag.String(', '--json', 'quux_flag'], lambda w: NOT contains(content, w)) AS missing FROM fl
  WHERE rel LIKE '%.go' AND NOT (contains(content, 'RunCLI(') AND NOT contains(content, 'flag.') AND NOT contains(content, 'cobra.')))
SELECT rel AS file, 'missing required flags: ' || array_to_string(missing, ' ') AS message FROM m WHERE NOT (SELECT bool_or(len(missing) = 0) FROM m)
UNION ALL SELECT '', 'no required flags found in any file' WHERE NOT EXISTS (SELECT 1 FROM m)"""
)
def ai_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.ai_compatibility(schema.files(spark, sf), _FLAGS)


_SIDES = r"^\s*(?:var|const|let)?\s*((?:(?:self\.)?[A-Za-z_]\w*\s*,\s*)*(?:self\.)?[A-Za-z_]\w*)(?:\s+[\w.*\[\]]+)?\s*(?::=|=|:)\s*([^=\s].*)$"


@registered(
    f"""WITH {_FILES}, {_LINES}, b AS (SELECT rel, line, regexp_extract(text, '{_SIDES}', 1) AS l, regexp_extract(text, '{_SIDES}', 2) AS r FROM ln WHERE regexp_extract(text, '{_SIDES}', 1) <> ''),
n AS (SELECT rel, line, list_transform(string_split(l, ','), lambda x: regexp_replace({_STRIP.format(x="x")}, '^self[.]', '')) AS names, list_transform(string_split(r, ','), lambda x: {_STRIP.format(x="x")}) AS vals, {_STRIP.format(x="r")} AS r FROM b),
z AS (SELECT rel, CAST(line AS INTEGER) AS line, unnest(names) AS name, unnest(CASE WHEN len(names) = len(vals) THEN vals ELSE list_transform(names, lambda _: r) END) AS value FROM n)
SELECT * FROM z WHERE regexp_matches(name, '(Timeout|Port|Retries|limit|depth)$') AND regexp_matches(value, '(?:^|[^\\w.])\\d|"[^"]*"')"""
)
def knob_sites(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.knob_sites(schema.files(spark, sf))


# No go.mod is given; the documents' lines stand for its lines.
_DIRECTIVES = f"""dv AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), dl AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format(x="x")}) AS l FROM dv),
gd AS (SELECT doc_id, substr(list_filter(l, lambda x: starts_with(x, 'go '))[-1], 4) AS go, substr(list_filter(l, lambda x: starts_with(x, 'toolchain '))[-1], 11) AS toolchain FROM dl)"""


@registered(f"WITH {_DIRECTIVES} SELECT * FROM gd WHERE go IS NOT NULL OR toolchain IS NOT NULL")
def go_directives(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text").distinct()
    return contracts.go_directives(docs, "doc_id", "text").where("go IS NOT NULL OR toolchain IS NOT NULL")


@registered(
    f"""WITH {_DIRECTIVES}, p AS (SELECT doc_id, unnest(CASE WHEN go IS NULL THEN ['missing go'] ELSE list_filter([CASE WHEN toolchain IS NULL THEN 'missing toolchain' END,
  CASE WHEN NOT (starts_with(go, '1.24') OR starts_with(go, 'test')) THEN 'version ' || go || ' is not allowed' END], lambda x: x IS NOT NULL) END) AS problem FROM gd) SELECT * FROM p"""
)
def go_version_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text").distinct()
    return contracts.go_version_problems(contracts.go_directives(docs, "doc_id", "text"), ("1.24", "test"), "doc_id")


@registered(f"""WITH {_FILES} SELECT rel, sha256(replace(content, '"fmt"', '"corp.test/fmt"')) AS checksum FROM fl WHERE starts_with(rel, 'internal/') AND rel LIKE '%.go' AND contains(content, '"fmt"')""")
def module_rename(spark: SparkSession, sf: str) -> DataFrame:
    return structure.renamed_modules(schema.files(spark, sf), "internal", '"fmt"', '"corp.test/fmt"').select("rel", F.sha2("content", 256).alias("checksum"))


# Advisories and ports

# No advisories are given; violations are put into the three forms that reports use.


@registered(
    f"""WITH {_V} SELECT violation_id, CASE WHEN trim(severity) = '' THEN 'unknown' ELSE severity END AS label FROM v"""
)
def advisory_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _advisories(spark, sf).select("violation_id", S.advisory_label(F.col("vuln")).alias("label"))


def _advisories(spark: SparkSession, sf: str) -> DataFrame:
    v, form = schema.violations(spark, sf), F.col("violation_id") % 3
    plain = F.to_json(F.struct(F.col("rule_id").alias("id"), F.col("message").alias("summary"), F.upper("severity").alias("severity")))
    scored = F.to_json(F.struct(F.col("rule_id").alias("id"), F.col("message").alias("summary"), F.array(F.struct(F.lit(" ").alias("score")), F.struct(F.concat(F.lit(" "), F.col("severity")).alias("score"))).alias("severity")))
    own = F.to_json(F.struct(F.col("rule_id").alias("id"), F.col("message").alias("summary"), F.struct("severity").alias("database_specific")))
    return v.select("violation_id", "rule_id", "message", "severity", F.when(form == 0, plain).when(form == 1, scored).otherwise(own).alias("vuln"))


@registered(
    f"""WITH {_V}, a AS (SELECT rule_id AS id, message AS summary, CASE WHEN trim(severity) = '' THEN 'unknown' ELSE severity END AS severity FROM v WHERE rule_id <> '')
SELECT id, min({{'summary': summary, 'severity': severity}}).summary AS summary, min({{'summary': summary, 'severity': severity}}).severity AS severity FROM a GROUP BY id"""
)
def advisories(spark: SparkSession, sf: str) -> DataFrame:
    reports = _advisories(spark, sf).select(F.concat(F.lit('{"results":[{"packages":[{"vulnerabilities":['), F.col("vuln"), F.lit("]}]}]}")).alias("report"))
    return S.advisories(reports, "report")


@registered(
    f"""WITH {_V}, c AS (SELECT DISTINCT file AS consumer, substr(rule_id, 8) AS port FROM v WHERE starts_with(rule_id, 'custom.'))
SELECT port, count(*) AS consumers FROM c WHERE port NOT IN (SELECT id FROM custom_rules WHERE enabled AND id IS NOT NULL) GROUP BY port"""
)
def unprovided_rules(spark: SparkSession, sf: str) -> DataFrame:
    return registry.port_links(*_ports(spark, sf))[1].groupBy("port").agg(F.count("*").alias("consumers"))


@registered(
    f"""WITH {_V}, c AS (SELECT DISTINCT file AS consumer, substr(rule_id, 8) AS port FROM v WHERE starts_with(rule_id, 'custom.'))
SELECT consumer, severity AS provider, port FROM c JOIN custom_rules ON id = port WHERE enabled"""
)
def rule_providers(spark: SparkSession, sf: str) -> DataFrame:
    return registry.port_links(*_ports(spark, sf))[0]


def _ports(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Files consume the custom rules that they violate; each enabled rule is provided with its severity."""
    v = schema.violations(spark, sf).where(F.col("rule_id").startswith("custom."))
    consumers = v.select(F.col("file").alias("consumer"), F.substring("rule_id", F.lit(8), F.length("rule_id")).alias("port")).distinct()
    return consumers, read_table(spark, sf, "custom_rules").where("enabled").select(F.col("severity").alias("provider"), F.col("id").alias("port"))


# Words of commands

_VALUES = {"message": "say \"hi\" {{.branch}}", "branch": "main", "password": "x y"}
_NAME = "\\{\\{\\.([A-Za-z0-9_-]+)\\}\\}"
_FILLED = f"""{_STRINGS}, tm AS (SELECT src, id, field, pos, text, regexp_extract_all(text, '{_NAME}', 1) AS names, regexp_split_to_array(text, '{_NAME}') AS pieces FROM st WHERE text IS NOT NULL),
ip AS (SELECT src, id, field, pos, list_filter(names, lambda n: n NOT IN ('message', 'branch', 'password'))[-1] AS missing,
  array_to_string(list_transform(pieces, lambda p, i: p || CASE names[i] WHEN 'message' THEN 'say "hi" {{{{.branch}}}}' WHEN 'branch' THEN 'main' WHEN 'password' THEN 'x y' ELSE '' END), '') AS filled FROM tm)"""


@registered(f"WITH {_FILLED} SELECT src, id, field, pos, CASE WHEN missing IS NULL THEN filled END AS command, missing FROM ip")
def interpolated_commands(spark: SparkSession, sf: str) -> DataFrame:
    made = commands.interpolated(F.col("text"), _VALUES)
    return _strings(spark, sf).where("text IS NOT NULL").select(*_KEYS, made.alias("c")).select(*_KEYS, "c.command", "c.missing")


_ATOMS = """\\\\.|''(?:\\\\.|[^''\\\\])*''|"(?:\\\\.|[^"\\\\])*\""""
_WORDS = f"(?s)(?:{_ATOMS}|[^''\"\\\\ \\t\\n])+"
_UNQUOTE = "array_to_string(list_transform(regexp_extract_all({w}, '(?s)" + _ATOMS + "|[^''\"\\\\]+'), lambda a: regexp_replace(CASE WHEN left(a, 1) IN (chr(39), chr(34)) THEN substr(a, 2, length(a) - 2) ELSE a END, '(?s)\\\\(.)', '\\1', 'g')), '')"
# What stays when all whole words are taken out: nothing, or an open quote or escape.
_REST_OF = f"regexp_replace(text, '(?s)(?:{_ATOMS}|[^''\"\\\\])*', '')"


@registered(
    f"""WITH {_STRINGS}, w AS (SELECT src, id, field, pos, text, {_REST_OF} AS rest FROM st WHERE text IS NOT NULL)
SELECT src, id, field, pos, CASE WHEN rest = '' THEN list_filter(list_transform(regexp_extract_all(text, '{_WORDS}'), lambda w: {_UNQUOTE.format(w="w")}), lambda x: x <> '') END AS tokens,
CASE WHEN rest <> '' THEN CASE WHEN length(regexp_extract(rest, '(\\\\*)$', 1)) % 2 = 1 THEN 'trailing escape' ELSE 'unterminated quote' END END AS error FROM w"""
)
def command_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return commands.tokens(_strings(spark, sf), _KEYS, "text")


@registered(
    """WITH o AS (SELECT * FROM macros QUALIFY row_number() OVER (PARTITION BY macro_id ORDER BY ingested_at DESC) = 1),
a AS (SELECT macro_id, regexp_split_to_array(replace(array_to_string(list_filter(steps, lambda s: s IS NOT NULL), ' -then '), chr(10), ' '), ' +') AS args FROM o WHERE steps IS NOT NULL),
p AS (SELECT macro_id, args, coalesce(list_position(args, '-then'), 0) AS k FROM a)
SELECT macro_id, CASE WHEN k > 0 THEN array_to_string(args[:k - 1], ' ') END AS gate, array_to_string(args[k + 1:], ' ') AS main, k > 0 AS chained FROM p"""
)
def chained_steps(spark: SparkSession, sf: str) -> DataFrame:
    once = latest_rows(read_table(spark, sf, "macros"), "macro_id", "ingested_at", ["steps"]).where("steps IS NOT NULL")
    args = F.split(F.replace(F.array_join("steps", " -then "), F.lit("\n"), F.lit(" ")), " +", -1)
    parts = once.select("macro_id", commands.chain_parts(args).alias("p"))
    return parts.select("macro_id", F.array_join("p.gate", " ").alias("gate"), F.array_join("p.main", " ").alias("main"), "p.chained")


@registered(
    f"""WITH o AS (SELECT * FROM macros QUALIFY row_number() OVER (PARTITION BY macro_id ORDER BY ingested_at DESC) = 1),
s AS (SELECT macro_id, CASE WHEN lower(trim(coalesce(on_failure, ''))) IN ('', 'stop') THEN 'stop' WHEN lower(trim(on_failure)) = 'continue' THEN 'continue' ELSE 'invalid' END AS mode, unnest(range(1, len(steps) + 1)) AS n, unnest(steps) AS raw FROM o),
m AS (SELECT *, regexp_extract_all(raw, '{_NAME}', 1)[-1] AS missing FROM s WHERE raw IS NOT NULL),
t AS (SELECT *, raw AS text FROM m), w AS (SELECT *, {_REST_OF} AS rest FROM t),
r AS (SELECT macro_id, mode, n, CASE WHEN missing IS NOT NULL THEN 'missing template variable ' || missing WHEN rest <> '' THEN CASE WHEN length(regexp_extract(rest, '(\\\\*)$', 1)) % 2 = 1 THEN 'trailing escape' ELSE 'unterminated quote' END
  WHEN regexp_matches(text, '^(?:[ \\t\\n]|""|[''][''])*$') THEN 'empty command' END AS reason FROM w),
l AS (SELECT macro_id, mode, list('step ' || n || ': ' || reason ORDER BY n) AS f FROM r WHERE reason IS NOT NULL GROUP BY macro_id, mode)
SELECT macro_id, mode, CASE WHEN mode = 'continue' THEN array_to_string(f, '; ') ELSE f[1] END AS failures FROM l"""
)
def macro_failures(spark: SparkSession, sf: str) -> DataFrame:
    return commands.macro_failures(read_table(spark, sf, "macros"), {})


# Findings, header counts and relative paths

_TIER = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
_BITS = "list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -(length(v) - length(replace(v, c, ''))) / length(v) * log2((length(v) - length(replace(v, c, ''))) / length(v))))"
_FORMS = ", ".join(f"CASE WHEN regexp_matches(l, '{form}') THEN {{'rank': {_TIER[tier]}, 'finding': '{name}', 'tier': '{tier}'}} END" for name, form, tier in contracts.SECRET_FORMS if name != "web-token")
_VALUED = f"""regexp_matches(w, '(?:{_KWRE})\\w*["'']?\\s*[:=]\\s*["'']?[^\\s"'']{{6,}}')"""


@registered(
    f"""WITH {_STRINGS}, ln2 AS (SELECT src, id, field, pos, unnest(range(1, len(s) + 1)) AS line_no, unnest(s) AS l FROM (SELECT *, string_split(text, chr(10)) AS s FROM st WHERE text IS NOT NULL)),
lw AS (SELECT *, lower(l) AS w FROM ln2),
b AS (SELECT src, id, field, pos, CAST(line_no AS INTEGER) AS line_no, list_max(list_filter([{_FORMS}, CASE WHEN {_VALUED} THEN {{'rank': 2, 'finding': 'keyword', 'tier': 'HIGH'}} END,
  CASE WHEN regexp_matches(w, '(?:{_KWRE})') AND NOT {_VALUED} THEN {{'rank': 0, 'finding': 'keyword', 'tier': 'LOW'}} END,
  CASE WHEN len(list_filter(regexp_extract_all(l, '([A-Za-z0-9+/_=-]{{33,}})', 1), lambda v: round({_BITS}, 6) >= 4.0)) > 0 THEN {{'rank': 0, 'finding': 'entropy', 'tier': 'LOW'}} END], lambda x: x IS NOT NULL)) AS f
  FROM lw WHERE NOT ({_BENIGN.replace("(l, ", "(w, ")} OR contains(w, 'sha256sum')))
SELECT src, id, field, pos, line_no, f.finding AS finding, f.tier AS tier FROM b WHERE f IS NOT NULL"""
)
def secret_findings(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.secret_findings(_strings(spark, sf), _KEYS, "text", ("sha256sum",), ("web-token",), {"entropy": "LOW"})


@registered(f"SELECT language, count(*) AS checked, count(*) FILTER (changed) AS modified FROM ({ORACLES['header_rewrite']}) GROUP BY language")
def header_counts(spark: SparkSession, sf: str) -> DataFrame:
    return headers.run_report(schema.files(spark, sf))


@registered(
    f"""WITH {_V}, p AS (SELECT DISTINCT file FROM v WHERE file <> '' AND NOT starts_with(file, '/') AND NOT contains(file, '..')), s AS (SELECT file, list_filter(string_split(file, '/'), lambda x: x <> '') AS a FROM p),
c AS (SELECT file, a, CASE WHEN a[1] = 'internal' THEN CASE WHEN a[2] = 'app' THEN 2 ELSE 1 END ELSE 0 END AS k FROM s)
SELECT file, array_to_string(list_concat(list_transform(range(0, 2 - k), lambda x: '..'), a[k + 1:]), '/') AS relative FROM c"""
)
def relative_paths(spark: SparkSession, sf: str) -> DataFrame:
    files = schema.violations(spark, sf).where(~F.col("file").startswith("/") & ~F.col("file").contains("..") & (F.col("file") != "")).select("file").distinct()
    return files.select("file", P.relative_to(F.col("file"), F.lit("internal/app")).alias("relative"))


@registered(
    f"""WITH {_V}, c AS (SELECT DISTINCT id, coalesce(severity, '') AS override FROM custom_rules), j AS (SELECT violation_id, severity, override FROM v JOIN c ON rule_id = 'custom.' || id),
k AS (SELECT *, CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS b, CASE lower(trim(override)) WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END AS o FROM j)
SELECT violation_id, coalesce(o >= b, false) AS covered FROM k"""
)
def severity_overrides(spark: SparkSession, sf: str) -> DataFrame:
    rules = read_table(spark, sf, "custom_rules").select(F.concat(F.lit("custom."), F.col("id")).alias("rule_id"), F.coalesce("severity", F.lit("")).alias("override")).distinct()
    return schema.violations(spark, sf).join(F.broadcast(rules), "rule_id").select("violation_id", S.override_covers(F.col("override"), F.col("severity")).alias("covered"))


@registered(
    f"""WITH {_V}, o AS (SELECT *, CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS rk FROM v),
d AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY file, line, function, rule_id, message ORDER BY rk, violation_id) = 1),
p AS (SELECT violation_id, CASE WHEN file = '' THEN '(repo)' ELSE file END AS file, row_number() OVER (ORDER BY rk, rule_id, file, function, line, message, violation_id) - 1 AS position FROM d)
SELECT position, file, min(position) OVER (PARTITION BY file) AS "group", violation_id FROM p"""
)
def grouped_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.grouped_report(schema.violations(spark, sf), "violation_id")


# All rules in one run

_POLICY = all_rules.Policy(
    files=_FILE_LIMITS, functions=quality.FunctionLimits(nil_guards=2), test_roots=("internal/tests", "cmd"), calls=("fmt.Errorf", "fmt.Println", "os.Exit", "owner.push", "line.append"), calls_allowed=("cmd",),
    print_forms=("fmt.Print(", "fmt.Printf(", "fmt.Println(", "console.log(", "print(", "log("), flags=tuple(_FLAGS), documentation="loose",
)
_LOOSE = f"""WITH {_FACTS} SELECT fact_id, 'missing documentation' AS problem FROM f WHERE language IN ('python', 'typescript') AND symbol_kind IN ('function', 'method') AND {_STRIP.format(x="docstring")} = ''"""
_OF_FACT = "fk.file_path AS file, fk.symbol_name AS function, coalesce(fk.line_number, 0) AS line"
_ALL = f"""WITH {_FACTS.replace("f AS (", "fk AS (", 1)}, al AS (
SELECT 'file-size' AS rule_id, file, '' AS function, 0 AS line, severity, lines || ' lines, limits ' || warn || ' and ' || most AS message FROM ({ORACLES["file_size_verdict"]})
UNION ALL SELECT rule_id, file, function, line, severity, message FROM ({ORACLES["function_quality_ladder"]})
UNION ALL SELECT 'hygiene.symbol_names', file, function, coalesce(line, 0), 'error', problem FROM ({ORACLES["symbol_names"]})
UNION ALL SELECT 'hygiene.doc_style', {_OF_FACT}, 'error', problem FROM ({ORACLES["doc_style"]}) x JOIN fk USING (fact_id)
UNION ALL SELECT 'hygiene.documentation', {_OF_FACT}, 'error', problem FROM ({_LOOSE}) x JOIN fk USING (fact_id)
UNION ALL SELECT 'hygiene.documentation', rel, '', line, 'error', problem FROM ({_header_sql(False)})
UNION ALL SELECT 'structure.test_location', rel, '', 0, 'error', 'test outside of its roots' FROM ({ORACLES["test_location"].replace(" UNION SELECT rel FROM fl", "").replace("SELECT DISTINCT file_path AS rel FROM f WHERE file_path <> ''", "SELECT rel FROM fl")})
UNION ALL SELECT 'structure.package_rules', dir, '', 0, 'error', problem FROM ({ORACLES["package_verdicts"]})
UNION ALL SELECT 'cli-formatter', rel, '', line, 'error', form FROM ({ORACLES["forbidden_prints"]})
UNION ALL SELECT 'scope-guard', rel, '', 0, 'error', call FROM ({ORACLES["forbidden_calls"]})
UNION ALL SELECT 'hardcoded-runtime-knob', rel, '', line, 'warn', name FROM ({ORACLES["knob_sites"]})
UNION ALL SELECT rule_id, rel, '', line, x.severity, coalesce(message, '') FROM ({ORACLES["custom_rule_hits"]}) x LEFT JOIN custom_rules ON rule_id = 'custom.' || id
UNION ALL SELECT 'ai-compatibility', file, '', 0, 'error', message FROM ({ORACLES["ai_compatibility"]}))
SELECT file, CAST(line AS INTEGER) AS line, function, rule_id, message, arg_min(severity, (CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, severity)) AS severity FROM al GROUP BY ALL"""


@registered(_ALL.replace("GROUP BY ALL", "GROUP BY file, line, function, rule_id, message"))
def all_rules_run(spark: SparkSession, sf: str) -> DataFrame:
    found = all_rules.check(schema.files(spark, sf), schema.facts(spark, sf), read_table(spark, sf, "custom_rules"), _POLICY)
    return report.deduped(found)
