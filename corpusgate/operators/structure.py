"""Rules about where files, packages and imports may be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.functions.paths import base_name, directory, extension, starts_with_any, under_any
from corpusgate.functions.text import comment_doc_prefix, lines_of


def package_stats(files: DataFrame) -> DataFrame:
    """``dir, production_go, has_doc, doc_path, doc_prefix_ok, has_concerns, concern_count`` of every directory with Go files.

    Production files are ``.go`` files other than ``doc.go`` and tests.
    """
    name = base_name(F.col("rel"))
    go = files.where(F.col("rel").endswith(".go")).select("rel", directory(F.col("rel")).alias("dir"), (name == "doc.go").alias("doc"), name.endswith("_test.go").alias("test"), "content")
    docs = F.when(F.col("doc"), F.col("content"))
    flat = go.select("rel", "dir", "doc", "test", comment_doc_prefix(docs).alias("prefix"), concern_section(docs).alias("concern"))
    return flat.groupBy("dir").agg(
        F.count_if(~F.col("doc") & ~F.col("test")).alias("production_go"),
        F.bool_or("doc").alias("has_doc"),
        F.coalesce(F.max(F.when(F.col("doc"), F.col("rel"))), F.lit("")).alias("doc_path"),
        F.coalesce(F.bool_or("prefix"), F.lit(False)).alias("doc_prefix_ok"),
        F.coalesce(F.bool_or("concern.found"), F.lit(False)).alias("has_concerns"),
        F.coalesce(F.max("concern.items"), F.lit(0)).alias("concern_count"),
    )


def concern_section(text: Column, header: str = "Package Concerns:") -> Column:
    """``found, items``: bullet lines below a comment line ``header``; an empty comment or any other line closes the section."""
    start = F.struct(F.lit(False).alias("found"), F.lit(False).alias("open"), F.lit(0).alias("items"))

    def step(acc: Column, line: Column) -> Column:
        trimmed = F.trim(F.regexp_replace(line, "\r$", ""))
        comment = trimmed.startswith("//")
        said = F.when(comment, F.trim(F.substring(trimmed, F.lit(3), F.length(trimmed)))).otherwise(F.lit(""))
        opens = comment & (said == header)
        goes_on = acc["open"] & comment & (said != "")
        return F.struct(
            (acc["found"] | opens).alias("found"), (opens | goes_on).alias("open"), (acc["items"] + F.when(goes_on & ~opens & said.startswith("- "), 1).otherwise(0)).alias("items")
        )

    return F.reduce(F.coalesce(lines_of(text), F.array().cast("array<string>")), start, step, lambda acc: F.struct(acc["found"].alias("found"), acc["items"].alias("items")))


def package_verdicts(stats: DataFrame, most_files: int = 10, least_concerns: int = 1, most_concerns: int = 2) -> DataFrame:
    """``dir, problem`` of packages with production files; a missing doc.go ends the judgement after the file count."""
    p = lambda cond, name: F.when(cond, name)
    c = F.col
    with_doc = c("has_doc")
    problems = F.array(
        p(c("production_go") > most_files, "too many files"),
        p(~with_doc, "no doc.go"),
        p(with_doc & ~c("doc_prefix_ok"), "doc prefix"),
        p(with_doc & c("has_concerns") & (c("concern_count") < least_concerns), "too few concerns"),
        p(with_doc & ~c("has_concerns"), "no concerns"),
        p(with_doc & (c("concern_count") > most_concerns), "too many concerns"),
    )
    return stats.where("production_go > 0").select("dir", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))


def misplaced_tests(paths: DataFrame, allowed: list[str]) -> DataFrame:
    """Distinct ``rel`` of ``_test.go`` files outside of ``allowed``."""
    rel = F.col("rel")
    return paths.where(rel.endswith("_test.go") & ~under_any(rel, allowed)).select("rel").distinct()


def unexpected_children(paths: DataFrame, root: str, allowed: DataFrame) -> DataFrame:
    """Directories right below ``root`` that are not in ``allowed`` (``child``)."""
    rest = F.substring(F.col("rel"), F.lit(len(root) + 2), F.length("rel"))
    below = paths.where(F.col("rel").startswith(root + "/")).select(F.split(rest, "/").alias("parts")).where(F.size("parts") > 1)
    return below.select(F.col("parts")[0].alias("child")).distinct().join(allowed, "child", "left_anti")


def missing_paths(configured: DataFrame, paths: DataFrame) -> DataFrame:
    """Configured ``path``s that are neither a file nor a directory above one."""
    parts = F.split("rel", "/")
    known = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).distinct()
    return configured.join(known, "path", "left_anti")


def go_imports(files: DataFrame) -> DataFrame:
    """``rel, line, path`` of the imports of Go files, from single imports and import blocks."""
    content = F.col("content")
    block = F.regexp_extract(content, r"(?s)^(.*?\nimport\s*\()", 1)
    until = F.regexp_extract(content, r"(?s)^(.*?\nimport\s*\([^)]*\))", 1)
    # The block's lines are known before the file is cut into lines.
    go = files.where(F.col("rel").endswith(".go")).select(
        "rel", (block != "").alias("has"), F.size(lines_of(block)).alias("first"), F.size(lines_of(until)).alias("last"), lines_of(content).alias("lines")
    )
    rows = go.select("rel", "has", "first", "last", F.posexplode("lines").alias("pos", "text"))
    inside = F.col("has") & (F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("last"))
    quoted = F.regexp_extract("text", r'^\s*(?:[\w.]+\s+)?"([^"]+)"', 1)
    single = F.regexp_extract("text", r'^import\s+(?:[\w.]+\s+)?"([^"]+)"', 1)
    path = F.when(F.col("text").startswith("import"), single).when(inside, quoted).otherwise(F.lit(""))
    return rows.select("rel", (F.col("pos") + 1).alias("line"), path.alias("path")).where("path <> ''")


def upward_imports(imports: DataFrame) -> DataFrame:
    """Imports under ``internal/`` that lead to commands."""
    return imports.where(F.col("rel").startswith("internal/") & (F.col("path").contains("/cmd/") | F.col("path").startswith("cmd/")))


def layer_violations(
    imports: DataFrame, module: str, business: list[str], adapters: list[str], core: list[str], boot: list[str], forbidden: list[str], allowed: list[str]
) -> DataFrame:
    """``rel, line, path, problem``: the first broken layer rule of each import, in the order of the columns tested.

    Roots are repository paths; ``forbidden`` and ``allowed`` are module paths.
    """
    rel, path = F.col("rel"), F.col("path")
    full = lambda roots: [f"{module}/{r}" for r in roots]
    to_business, to_adapter = under_any(path, full(business)), under_any(path, full(adapters))
    in_boot = under_any(rel, boot)
    in_business, in_adapter = under_any(rel, business) & ~in_boot, under_any(rel, adapters)
    in_core = under_any(rel, core) & ~in_boot
    internal = under_any(path, [f"{module}/internal"])
    own = F.concat(F.lit(module + "/"), directory(rel))
    related = (path == own) | own.startswith(F.concat(path, F.lit("/"))) | path.startswith(F.concat(own, F.lit("/")))
    problem = (
        F.when(in_business & under_any(path, forbidden), "forbidden path")
        .when(in_business & internal & ~to_business & ~path.isin(*allowed), "outside boundaries")
        .when(in_adapter & to_business, "business package")
        .when(in_adapter & to_adapter & ~related, "another adapter")
        .when(in_core & to_adapter, "core to adapter")
        .when(in_core & to_business, "core to business")
    )
    return imports.withColumn("problem", problem).where("problem IS NOT NULL")


# Directories that a tree walk leaves out.
SKIPPED_DIRECTORIES = (
    "test", "tests", ".backup", ".agents", "script", "scripts", ".claude", ".gemini", ".codex", ".kilocode", ".antigravity", ".mypy_cache", ".qodo", "__pycache__",
    ".ruff_cache", ".git", "node_modules", ".vscode", ".idea",
)


def walked(paths: DataFrame, skipped: tuple[str, ...] = SKIPPED_DIRECTORIES) -> DataFrame:
    """``rel`` that a walk reaches: no skipped directory above it, nothing below an ``internal/router``, no ``.toml`` file."""
    above = F.split(directory(F.col("rel")), "/")
    router = F.col("rel").rlike(r"(^|/)internal/router/")
    return paths.where(~F.arrays_overlap(above, F.array(*map(F.lit, skipped))) & ~router & (extension(F.col("rel")) != ".toml"))


def generated_or_skipped(files: DataFrame) -> DataFrame:
    """``rel, generated, skipped``: both marks of generated code in the first 512 bytes; test, mock and generated names."""
    head = F.decode(F.substring(F.encode("content", "UTF-8"), 1, 512), "UTF-8")
    name = base_name(F.col("rel"))
    skipped = name.endswith("_test.go") | name.endswith(".gen.go") | name.endswith("_mock.go") | starts_with_any(name, ["zz_generated"])
    return files.select("rel", (head.contains("Code generated") & head.contains("DO NOT EDIT")).alias("generated"), skipped.alias("skipped"))


def renamed_modules(files: DataFrame, root: str, old: str, new: str) -> DataFrame:
    """``rel, content`` of the Go files below ``root`` ('' for all) that change when every ``old`` becomes ``new``."""
    inside = under_any(F.col("rel"), [root]) if root else F.lit(True)
    made = F.replace(F.col("content"), F.lit(old), F.lit(new))
    return files.where(inside & F.col("rel").endswith(".go") & F.col("content").contains(old)).select("rel", made.alias("content")) if old and old != new else files.where(F.lit(False)).select("rel", "content")
