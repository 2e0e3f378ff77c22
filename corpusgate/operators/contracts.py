"""Rules about what files may contain: calls, prints, flags, knobs, versions, secrets, custom patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from re import _parser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.functions import text as T
from corpusgate.functions.paths import extension, glob_regex, glob_regex_column, under_any


def line_table(files: DataFrame) -> DataFrame:
    """``rel, line, text``: lines from 1, as a line reader gives them."""
    return files.select("rel", F.posexplode(T.reader_lines(F.col("content"))).alias("pos", "text")).select("rel", (F.col("pos") + 1).alias("line"), "text")


def forbidden_prints(files: DataFrame, forms: tuple[str, ...] = ("fmt.Print(", "fmt.Printf(", "fmt.Println(", "console.log(", "print(")) -> DataFrame:
    """``rel, line, form``: lines, not comments, with one of ``forms``; the first of the list counts."""
    trimmed, found = F.trim("text"), F.lit(None).cast("string")
    for form in reversed(forms):
        found = F.when(trimmed.contains(form), form).otherwise(found)
    rows = line_table(files).where(~trimmed.startswith("//") & ~trimmed.startswith("#"))
    return rows.select("rel", "line", found.alias("form")).where("form IS NOT NULL")


def called_names(files: DataFrame) -> DataFrame:
    """Distinct ``rel, call`` of selector calls ``a.B(`` in source files, comments and quoted strings left out."""
    code = F.regexp_replace("content", r'(?s)//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"', " ")
    return files.select("rel", F.explode(F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_]\w*\.[A-Za-z_]\w*)\("), F.lit(1))).alias("call")).distinct()


#: Files beside Go in which forbidden calls are looked for.
CALL_EXTENSIONS = (".py", ".ts", ".tsx", ".js")


def forbidden_calls(files: DataFrame, calls: list[str], mode: str = "restrict", allowed: tuple[str, ...] = ()) -> DataFrame:
    """``rel, call``: once for each file and forbidden call; Go files by what they call, others by their text.

    ``mode``: ``allow`` forbids nothing, ``restrict`` spares the paths below ``allowed``, ``ban`` spares none.
    """
    if mode not in ("allow", "restrict", "ban"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "allow" or not calls:
        return called_names(files).where(F.lit(False))
    if mode == "restrict":
        files = files.where(~under_any(F.col("rel"), list(allowed)))
    go = F.col("rel").endswith(".go")
    called = called_names(files.where(go)).where(F.col("call").isin(*calls))
    held = files.where(~go & extension(F.col("rel")).isin(*CALL_EXTENSIONS))
    return called.unionByName(held.select("rel", F.explode(F.filter(F.array(*map(F.lit, calls)), lambda c: F.col("content").contains(c))).alias("call")).distinct())


def required_words(rows: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """``key, missing``: the words that a text lacks, in the list's order; nothing at all if one text has every word.

    An empty result therefore says that the words are there somewhere.
    """
    lacking = F.filter(F.array(*map(F.lit, words)), lambda w: ~F.col(text).contains(w))
    judged = rows.where(F.col(text).isNotNull()).select(key, lacking.alias("missing"))
    complete = judged.agg(F.bool_or(F.size("missing") == 0).alias("__any"))
    return judged.join(F.broadcast(complete), ~F.col("__any")).select(key, "missing")


def ai_compatibility(files: DataFrame, flags: list[str]) -> DataFrame:
    """``file, message`` of Go files without all of ``flags``; nothing if one file has them all, one row without file if no file counts.

    A file that only runs another command line (``RunCLI(`` and neither ``flag.`` nor ``cobra.``) does not count.
    """
    content = F.col("content")
    thin = content.contains("RunCLI(") & ~content.contains("flag.") & ~content.contains("cobra.")
    lacking = F.filter(F.array(*map(F.lit, flags)).cast("array<string>"), lambda w: ~content.contains(w))
    judged = files.where(F.col("rel").endswith(".go") & ~thin).select(F.col("rel").alias("file"), lacking.alias("missing"))
    whole = judged.agg(F.count("*").alias("__n"), F.coalesce(F.bool_or(F.size("missing") == 0), F.lit(False)).alias("__any"))
    each = judged.join(F.broadcast(whole), ~F.col("__any")).select("file", F.concat(F.lit("missing required flags: "), F.array_join("missing", " ")).alias("message"))
    return each.unionByName(whole.where("__n = 0").select(F.lit("").alias("file"), F.lit("no required flags found in any file").alias("message")))


def knob_sites(files: DataFrame, knobs: tuple[str, ...] = ("Timeout", "Port", "Retries", "limit", "depth")) -> DataFrame:
    """``rel, line, name, value``: names that are, or end with, one of ``knobs`` and the value beside them, if it holds a literal.

    ``a, b := 1, f(2)`` pairs names and values by place; a value may hold its literal anywhere, as
    an operand, an argument or an element. With other numbers of names and values each name gets
    the whole right side.
    """
    pattern = r"^\s*(?:var|const|let)?\s*((?:(?:self\.)?[A-Za-z_]\w*\s*,\s*)*(?:self\.)?[A-Za-z_]\w*)(?:\s+[\w.*\[\]]+)?\s*(?::=|=|:)\s*([^=\s].*)$"
    sides = line_table(files).select("rel", "line", F.regexp_extract("text", pattern, 1).alias("left"), F.regexp_extract("text", pattern, 2).alias("right")).where("left <> ''")
    names = F.transform(F.split("left", ","), lambda x: F.regexp_replace(T.stripped(x), r"^self\.", ""))
    values = F.transform(F.split("right", ","), T.stripped)
    paired = F.when(F.size(names) == F.size(values), values).otherwise(F.transform(names, lambda _: T.stripped(F.col("right"))))
    sites = sides.select("rel", "line", F.explode(F.arrays_zip(names.alias("name"), paired.alias("value"))).alias("s")).select("rel", "line", "s.name", "s.value")
    ends = F.lit(False)
    for k in knobs:
        ends = ends | F.col("name").endswith(k)
    return sites.where(ends & F.col("value").rlike(r"(?:^|[^\w.])\d|\"[^\"]*\""))


def go_directives(files: DataFrame, key: str = "rel", text: str = "content") -> DataFrame:
    """``key, go, toolchain``: what the last line of each kind says; null where no line does."""
    lines = F.transform(T.lines_of(F.col(text)), T.stripped)
    last = lambda word: F.substring(F.element_at(F.reverse(F.filter(lines, lambda x: x.startswith(word + " "))), 1), F.lit(len(word) + 2), F.length(text))
    kept = F.when(F.exists(lines, lambda x: x.startswith("go ")), last("go")), F.when(F.exists(lines, lambda x: x.startswith("toolchain ")), last("toolchain"))
    return files.where(F.col(text).isNotNull()).select(key, kept[0].alias("go"), kept[1].alias("toolchain"))


def go_version_problems(directives: DataFrame, allowed: tuple[str, ...], key: str = "rel") -> DataFrame:
    """``key, problem`` of ``go_directives``: without a go version nothing more is judged."""
    fits = F.lit(False)
    for prefix in allowed:
        fits = fits | F.col("go").startswith(prefix)
    judged = F.array(F.when(F.col("toolchain").isNull(), "missing toolchain"), F.when(~fits, F.concat(F.lit("version "), F.col("go"), F.lit(" is not allowed"))))
    found = F.when(F.col("go").isNull(), F.array(F.lit("missing go"))).otherwise(F.filter(judged, lambda x: x.isNotNull()))
    return directives.select(key, F.explode(found).alias("problem"))


# Files that name the Go version again, and marks of the lines that do.
VERSION_FILES = ("Dockerfile", ".github/workflows/ci.yml", ".github/workflows/test.yml", ".gitlab-ci.yml")
VERSION_MARKS = ("GO_VERSION", "go:", "golang:")


def check_go_version(files: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """``rule_id, file, line, message, severity`` of a repository's ``go.mod`` and of the files that name another version than it does."""
    mods = go_directives(files.where("rel = 'go.mod'"))
    found = go_version_problems(mods, allowed)
    missing = mods.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("go.mod").alias("rel"), F.lit("missing go.mod").alias("problem"))
    errors = found.unionByName(missing).select(F.lit("go-version").alias("rule_id"), F.col("rel").alias("file"), F.lit(0).alias("line"), F.col("problem").alias("message"), F.lit("error").alias("severity"))
    lines = line_table(files.where(F.col("rel").isin(*VERSION_FILES)))
    marked = F.lit(False)
    for m in VERSION_MARKS:
        marked = marked | F.col("text").contains(m)
    other = lines.where(F.col("text").contains("1.2") & marked).join(F.broadcast(mods.where("go IS NOT NULL").select("go")), ~F.col("text").contains(F.col("go")))
    warned = other.select(F.lit("go-version-mismatch").alias("rule_id"), F.col("rel").alias("file"), "line", F.concat(F.lit("go.mod is "), F.col("go"), F.lit(" but found: "), T.stripped(F.col("text"))).alias("message"), F.lit("warn").alias("severity"))
    return errors.unionByName(warned)


def hardcoded_knobs(files: DataFrame, knobs: tuple[str, ...] = ("Timeout", "Port", "Retries", "limit", "depth")) -> DataFrame:
    """``rel, line, name, value``: assignments of a literal to a name that is, or ends with, one of ``knobs``."""
    name, value = F.regexp_extract("text", r"^\s*(?:var|const|let|self\.)?\s*([A-Za-z_]\w*)\s*(?::=|=|:)\s*", 1), F.regexp_extract("text", r"^\s*(?:var|const|let|self\.)?\s*[A-Za-z_]\w*\s*(?::=|=|:)\s*(-?\d[\w.]*|\"[^\"]*\")", 1)
    ends = F.lit(False)
    for k in knobs:
        ends = ends | name.endswith(k)
    return line_table(files).withColumns({"name": name, "value": value}).where(ends & (value != "")).select("rel", "line", "name", "value")


def version_mentions(documents: DataFrame, version: str = "1.24", markers: tuple[str, ...] = ("toolchain", "version", "Since")) -> DataFrame:
    """``doc_id, line_no, marker``: lines with another 1.2x version and a marker; the first marker of the list counts."""
    lines = documents.where("text IS NOT NULL").select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("pos", "l"))
    marker = F.coalesce(*[F.when(F.col("l").contains(m), m) for m in markers])
    hit = F.col("l").contains("1.2") & ~F.col("l").contains(version)
    return lines.where(hit).select("doc_id", (F.col("pos") + 1).alias("line_no"), marker.alias("marker")).where("marker IS NOT NULL")


# Words that name secrets, and words that make a line harmless.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "private_key", "dsn", "credential")
BENIGN = ("example", "placeholder", "your_", "_here", "dummy", "{{", "${", "$(", "secrets.", "--password-stdin", "password-file", "max-tokens")


def keyword_lines(rows: DataFrame, keys: list[str], text: str, keywords: tuple[str, ...] = KEYWORDS, benign: tuple[str, ...] = BENIGN) -> DataFrame:
    """``keys, line_no, keyword, tier``: lines with a secret's keyword and no benign hint; tier HIGH where a value follows, else LOW."""
    lines = rows.where(F.col(text).isNotNull()).select(*keys, F.posexplode(T.lines_of(F.lower(text))).alias("__pos", "l"))
    keyword = F.coalesce(*[F.when(F.col("l").contains(k), k) for k in keywords])
    harmless = F.lit(False)
    for b in benign:
        harmless = harmless | F.col("l").contains(b)
    valued = F.col("l").rlike(r"(?:" + "|".join(map(re.escape, keywords)) + r")\w*[\"']?\s*[:=]\s*[\"']?[^\s\"']{6,}")
    found = lines.where(~harmless).select(*keys, (F.col("__pos") + 1).alias("line_no"), keyword.alias("keyword"), F.when(valued, "HIGH").otherwise("LOW").alias("tier"))
    return found.where("keyword IS NOT NULL")


def dense_strings(rows: DataFrame, keys: list[str], text: str, least_length: int = 33, least_entropy: float = 4.0) -> DataFrame:
    """``keys, value, bits``: distinct unbroken strings of ``least_length`` characters whose entropy is ``least_entropy`` or more."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(rf"([A-Za-z0-9+/_=-]{{{least_length},}})"), F.lit(1))))
    rows = rows.where(F.col(text).isNotNull()).select(*keys, found.alias("value")).distinct()
    return rows.withColumn("bits", T.entropy(F.col("value"))).where(F.col("bits") >= least_entropy)


# Forms of secrets, each with its tier.
SECRET_FORMS = (
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "CRITICAL"), ("github-token", r"gh[opsur]_[A-Za-z0-9]{30,}", "CRITICAL"), ("package-token", r"(?:npm_|glpat-|pypi-)[A-Za-z0-9_-]{16,}", "CRITICAL"),
    ("cloud-key-id", r"AKIA[0-9A-Z]{16}", "HIGH"), ("chat-token", r"xox[abprs]-[A-Za-z0-9-]{10,}", "HIGH"), ("url-login", r"://[^/\s:@]+:[^/\s:@${]{3,}@", "HIGH"), ("web-token", r"eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}", "MEDIUM"),
)
TIERS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def secret_findings(
    rows: DataFrame, keys: list[str], text: str, allowed_texts: tuple[str, ...] = (), allowed_ids: tuple[str, ...] = (), overrides: dict[str, str] | None = None, least_entropy: float = 4.0
) -> DataFrame:
    """``keys, line_no, finding, tier``: of each line its gravest finding, of equal ones the last by name.

    Findings are the ``SECRET_FORMS``, ``keyword`` (an assigned value HIGH, else LOW) and ``entropy``
    (an unbroken string of more than 32 characters, MEDIUM). Lines with a benign hint or one of
    ``allowed_texts`` have none; ``allowed_ids`` are not looked for; ``overrides`` give a finding
    another tier, or ``OFF``. Null texts give no rows.
    """
    overrides = overrides or {}
    if unknown := {t for t in overrides.values() if t not in (*TIERS, "OFF")}:
        raise ValueError(f"unknown tiers {sorted(unknown)}")
    lines = rows.where(F.col(text).isNotNull()).select(*keys, F.posexplode(T.lines_of(text)).alias("__pos", "l"))
    low, harmless = F.lower("l"), F.lit(False)
    for b in (*BENIGN, *(a.lower() for a in allowed_texts)):
        harmless = harmless | low.contains(b)
    words = "(?:" + "|".join(map(re.escape, KEYWORDS)) + ")"
    valued, dense = low.rlike(words + r"\w*[\"']?\s*[:=]\s*[\"']?[^\s\"']{6,}"), F.regexp_extract_all("l", F.lit(r"([A-Za-z0-9+/_=-]{33,})"), F.lit(1))
    tests = [(name, F.col("l").rlike(form), tier) for name, form, tier in SECRET_FORMS]
    tests += [("keyword", valued, "HIGH"), ("keyword", low.rlike(words) & ~valued, "LOW"), ("entropy", F.exists(dense, lambda v: T.entropy(v) >= least_entropy), "MEDIUM")]
    found = []
    for name, test, tier in tests:
        tier = overrides.get(name, tier)
        if name not in allowed_ids and tier != "OFF":
            found.append(F.when(test, F.struct(F.lit(TIERS.index(tier)).alias("rank"), F.lit(name).alias("finding"), F.lit(tier).alias("tier"))))
    if not found:
        return lines.where(F.lit(False)).select(*keys, F.col("__pos").alias("line_no"), F.lit("").alias("finding"), F.lit("").alias("tier"))
    best = F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return lines.where(~harmless).select(*keys, (F.col("__pos") + 1).alias("line_no"), best.alias("b")).where("b IS NOT NULL").select(*keys, "line_no", "b.finding", "b.tier")


# Custom rules

LANGUAGE_EXTENSIONS = {"go": [".go"], "python": [".py"], "typescript": [".ts", ".tsx"]}


#: Rules, or scopes of rules, in one broadcast; more of them take one more pass each.
BLOCK_RULES = 100_000


def scope_matches(rules: DataFrame, files: DataFrame, block_rules: int = BLOCK_RULES) -> DataFrame:
    """``language, file_glob, rel``: the files that each distinct scope of enabled rules covers.

    Rules share few scopes, so the pairs are (scope, file), not (rule, file). The distinct scopes
    are broadcast in blocks of about ``block_rules``, each of them one pass over the paths. An
    empty or ``any`` language covers all files, an unknown one is an extension.
    """
    scopes = rules.where("enabled").select(F.coalesce("language", F.lit("")).alias("language"), F.coalesce("file_glob", F.lit("")).alias("file_glob")).distinct()
    low = F.lower("language")
    wanted = F.when(low.isin("", "any"), F.lit(None)).otherwise(F.array(F.concat(F.lit("."), low)))
    for name, exts in LANGUAGE_EXTENSIONS.items():
        wanted = F.when(low == name, F.array(*map(F.lit, exts))).otherwise(wanted)
    scoped = scopes.select("language", "file_glob", wanted.alias("__exts"), glob_regex_column(F.col("file_glob")).alias("__glob"))
    paths = files.select("rel", extension(F.col("rel")).alias("__ext"))
    fits = (F.col("__exts").isNull() | F.array_contains("__exts", F.col("__ext"))) & ((F.col("__glob") == "") | F.expr("rel RLIKE __glob"))
    blocks = max(1, -(-scopes.count() // block_rules))
    block = F.pmod(F.xxhash64("language", "file_glob"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [paths.join(F.broadcast(scoped.where(block == b)), fits).select("language", "file_glob", "rel") for b in range(blocks)])


def scope_test(language: str, file_glob: str) -> tuple[list[str] | None, re.Pattern | None]:
    """The extensions and the pattern of paths that a scope covers, None for all; as in ``scope_matches``."""
    low = language.lower()
    exts = None if low in ("", "any") else LANGUAGE_EXTENSIONS.get(low, [f".{low}"])
    return exts, re.compile(glob_regex(file_glob)) if file_glob else None


def folded(text: str) -> str:
    """Lower case; the signs beyond ASCII that equal ``i`` and ``s`` where a pattern ignores case become those."""
    return text.replace("İ", "i").lower().replace("ı", "i").replace("ſ", "s")


def needed_literal(pattern: str) -> str:
    """An ASCII text, in lower case, that every match of ``pattern`` holds in ``folded``; '' if none is plain to see.

    Read from the parsed pattern, so that escaped signs are text.
    """
    runs = [""]

    def walk(items) -> None:
        for op, value in items:
            if op is _parser.LITERAL and value < 128:
                runs[-1] += chr(value)
            elif op is _parser.SUBPATTERN:
                walk(value[3])
            elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT) and value[0] > 0:
                runs.append("")
                walk(value[2])
                runs.append("")
            elif op is not _parser.AT:
                runs.append("")

    walk(_parser.parse(pattern))
    return max(runs, key=len).lower()


def rule_hits(files: DataFrame, rules: DataFrame, block_rules: int = BLOCK_RULES, roots: tuple[str, ...] = ()) -> DataFrame:
    """``rel, line, rule_id, severity``: each line that matches an enabled rule in its scope, once per rule.

    One automaton over the literals that the patterns need picks the (line, rule) pairs to try, so
    the work does not grow with lines times rules; the patterns themselves decide. Patterns that
    need no literal are tried on every line of their scope. ``rules`` is a config table; each
    ``block_rules`` of its rows are one automaton and one pass over the files. A pattern that does
    not compile raises at once; no rules give no rows. With ``roots``, rules without a glob look at
    files below them only.
    """
    rows = rules.where("enabled AND pattern IS NOT NULL AND pattern <> ''").select("id", "pattern", "severity", "language", "file_glob").toLocalIterator()
    parts = []
    while block := list(islice(rows, block_rules)):
        table = [(r.id, r.pattern, r.severity or "", (r.language or "", r.file_glob or ""), needed_literal(r.pattern)) for r in block]
        for _, pattern, *_ in table:
            re.compile(pattern)
        parts.append(_table_hits(files, table, roots))
    return reduce(DataFrame.unionByName, parts) if parts else _table_hits(files.limit(0), [], roots)


def _table_hits(files: DataFrame, table: list[tuple], roots: tuple[str, ...]) -> DataFrame:
    """The hits of the rules of ``table``: id, pattern, severity, scope and needed literal of each."""
    sent = files.sparkSession.sparkContext.broadcast(table)
    schema = "rel string, line int, rule_id string, severity string"
    below = tuple(r.rstrip("/") + "/" for r in roots if r)

    def inside(rel: str) -> bool:
        return not below or rel.startswith(below)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        table = sent.value
        scopes = [(scope, *scope_test(*scope)) for scope in sorted({t[3] for t in table})]
        compiled = [re.compile(p) for _, p, *_ in table]
        finder, by_literal, always = ahocorasick.Automaton(), {}, []
        for i, (*_, literal) in enumerate(table):
            (by_literal.setdefault(literal, []) if literal else always).append(i)
        for literal, ids in by_literal.items():
            finder.add_word(literal, ids)
        if by_literal:
            finder.make_automaton()
        for pdf in batches:
            out = []
            for rel, content in zip(pdf["rel"], pdf["content"]):
                ext = re.search(r"(\.[^./]*)?$", rel).group().lower()
                covered = {scope for scope, exts, glob in scopes if (exts is None or ext in exts) and (inside(rel) if glob is None else glob.search(rel))}
                low = folded(content)
                hits = {i for _, ids in finder.iter(low) for i in ids} if by_literal else set()
                tried = [i for i in sorted({*hits, *always}) if table[i][3] in covered]
                if not tried:
                    continue
                pieces = content.split("\n")
                if pieces[-1] == "":
                    pieces.pop()
                for n, line in enumerate(pieces, 1):
                    line = line.removesuffix("\r")
                    small = folded(line)
                    out += [(rel, n, f"custom.{table[i][0]}", table[i][2]) for i in tried if table[i][4] in small and compiled[i].search(line)]
            yield pd.DataFrame(out, columns=["rel", "line", "rule_id", "severity"])

    return files.where("rel IS NOT NULL AND content IS NOT NULL").select("rel", "content").mapInPandas(scan, schema)
