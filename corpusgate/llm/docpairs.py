"""Functions paired with their documentation (problem 1).

Each distinct file is parsed once, where it lies. A method without telling documentation takes
that of the method it overrides: the class hierarchy is a table of (class, base) edges, made from
every class and interface, and each round joins the open methods with the documented ones of their bases, one level up at a time.
Methods still open when no base is left are dropped, as are all other symbols without telling
documentation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.session import materialize

SYMBOL = "rel string, repos array<string>, version long, symbol_name string, symbol_kind string, owner string, bases array<string>, sources array<string>, line_number int, end_line int, code string, documentation string, telling boolean"
#: Rows that are no symbols: classes with their bases, and members without a body.
HIERARCHY = ("class", "member")


def source_symbols(files: DataFrame, texts: bool = True) -> DataFrame:
    """One row per named function and method of ``files`` (``rel, content``, if known ``repo``), documented or not.

    Further rows of the kinds ``class`` and ``member`` hold the hierarchy. Without ``texts``, code
    and documentation stay empty, for callers that only ask what is documented.

    Rows repeated in rel and content count once. Null contents, other extensions and files
    without functions give no rows. ``documentation`` is what describes the symbol, without
    tags, directives, commented-out code and placeholders; ``telling`` says that enough is left.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from corpusgate.llm import sourcecode as S
        from corpusgate.sources.sourcecode import symbols_and_hierarchy

        for pdf in batches:
            rows = []
            for rel, repos, version, content in zip(pdf["rel"], pdf["repos"], pdf["version"], pdf["content"]):
                symbols, classes, members = symbols_and_hierarchy(rel, content)
                for s in [*symbols, *members]:
                    text = S.described(s.doc) if s.doc else ""
                    told = S.tells(text, s.name)
                    rows.append((rel, repos, version, s.name, s.kind, s.owner, list(s.bases), [], s.line, s.end_line, *((s.code, text) if texts else ("", "")), told))
                rows += [(rel, repos, version, c.name, "class", c.name, list(c.bases), list(c.sources), c.line, c.line, "", "", False) for c in classes]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SYMBOL.split(", ")])

    code = F.lower(F.col("rel")).rlike(r"\.(go|py|ts|tsx|js|jsx)$")
    repo = F.coalesce("repo", F.lit("")) if "repo" in files.columns else F.lit("")
    once = files.where(F.col("content").isNotNull() & code).groupBy("rel", F.xxhash64("content").alias("version"), F.length("content").alias("__n")).agg(F.first("content").alias("content"), F.collect_set(repo).alias("repos"))
    return once.select("rel", "repos", "version", "content").mapInPandas(parse, SYMBOL)


def _module(rel: Column, source: Column) -> Column:
    """The path, without extension, of the module ``source`` as the file ``rel`` imports it; null for none."""
    folder = F.regexp_replace(rel, r"[^/]*$", "")
    ups = F.length(F.regexp_extract(source, r"^(\.*)", 1)) - 1
    # Python: the first dot is the file's folder, each further one its parent.
    above = F.array_join(F.slice(F.split(folder, "/"), F.lit(1), F.greatest(F.size(F.split(folder, "/")) - 1 - ups, F.lit(0))), "/")
    tail = F.translate(F.regexp_replace(source, r"^\.*", ""), ".", "/")
    python = F.when(source.startswith("."), F.concat_ws("/", F.when(above != "", above), F.when(tail != "", tail))).otherwise(tail)
    steps = F.filter(F.split(F.concat(folder, source), "/"), lambda x: ~x.isin("", "."))
    path = F.reduce(steps, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    script = F.when(source.startswith("."), _stem(F.array_join(path, "/")))
    return F.when(source == "", None).when(rel.endswith(".py"), python).otherwise(script)


def _stem(rel: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(rel, r"\.(?:go|py|tsx?|jsx?)$", ""), r"/(?:index|__init__)$", "")


def resolved_bases(classes: DataFrame) -> DataFrame:
    """``rel, node, owner, base``: each base (``owner`` is its name) of ``classes`` (``family, repo, rel, version, node, owner, bases, sources``) with its node.

    A base is looked for in the same file, then in the module it is imported from, then in the
    folder, the repo and the whole corpus; behind the file only where one file alone has the name.
    ``base`` is null where none of these tells it.
    """
    folder = F.regexp_replace("rel", r"[^/]*$", "")
    places = classes.select("family", "repo", "rel", "version", "owner", "node", _stem(F.col("rel")).alias("module"), folder.alias("folder"))
    edges = classes.select("family", "repo", "rel", "version", "node", folder.alias("folder"), F.explode(F.arrays_zip("bases", "sources")).alias("b"))
    edges = edges.select("*", F.col("b.bases").alias("owner"), _module(F.col("rel"), F.col("b.sources")).alias("module")).where("owner <> ''").drop("b").distinct()
    tiers = (["rel", "repo", "version"], ["repo", "module"], ["repo", "folder"], ["repo"], [])
    for i, keys in enumerate(tiers):
        on = ["family", "owner", *keys]
        only = places.groupBy(*on).agg(F.min("node").alias(f"t{i}"), F.min(F.struct("repo", "rel")).alias("lo"), F.max(F.struct("repo", "rel")).alias("hi")).where("lo = hi").drop("lo", "hi")
        edges = edges.join(only, on, "left")
    return edges.select("rel", "node", "owner", F.coalesce(*[f"t{i}" for i in range(len(tiers))]).alias("base")).distinct()


def class_edges(classes: DataFrame) -> DataFrame:
    """``node, base`` of the bases that are known."""
    return resolved_bases(classes).where("base IS NOT NULL AND base <> node").select("node", "base").distinct()


def _nodes(symbols: DataFrame) -> DataFrame:
    family = F.when(F.col("rel").endswith(".go"), "go").when(F.col("rel").endswith(".py"), "py").otherwise("script")
    rows = symbols.where("owner IS NOT NULL").drop("code", "end_line").withColumn("family", family).withColumn("repo", F.explode("repos"))
    return rows.withColumn("node", F.to_json(F.array(F.col("family"), F.col("repo"), F.col("rel"), F.col("version").cast("string"), F.col("owner"))))


def unknown_bases(files: DataFrame) -> DataFrame:
    """``rel, class_name, base_name``: bases that several files could mean, or none has; no documentation is taken from them."""
    classes = _nodes(source_symbols(files, texts=False)).where("symbol_kind = 'class'")
    open_ = resolved_bases(classes).where("base IS NULL")
    return open_.select("rel", F.get(F.from_json("node", "array<string>"), 4).alias("class_name"), F.col("owner").alias("base_name")).distinct()


def inherited(symbols: DataFrame) -> DataFrame:
    """``rel, version, symbol_name, line_number, documentation, inherited_from`` of open methods that some base documents.

    The nearest documented base wins, of equally near ones the first by name; no class is visited
    twice for a method, so a hierarchy that runs in a circle ends. For ``version`` see ``class_edges``:
    it tells contents of one path apart.
    """
    rows = _nodes(symbols)
    none = symbols.sparkSession.createDataFrame([], "rel string, version long, symbol_name string, line_number int, documentation string, inherited_from string")
    edges = materialize(class_edges(rows.where("symbol_kind = 'class'")), "class_edges")
    if edges.isEmpty():
        return none
    told = rows.where("telling").groupBy("node", "symbol_name").agg(F.min("documentation").alias("documentation"), F.first("owner").alias("owner"))
    told = materialize(told, "told")
    key = ["rel", "version", "repo", "symbol_name", "line_number"]
    open_ = rows.where(~F.col("symbol_kind").isin(*HIERARCHY) & ~F.col("telling")).select(*key, "node")
    seen, found, level = open_, None, 0
    while True:
        up = open_.join(edges, "node").select(*key, F.col("base").alias("node")).distinct().join(seen, [*key, "node"], "left_anti")
        up = materialize(up, f"open_{level}")
        if up.isEmpty():
            break
        first = F.struct("owner", "node")
        hit = up.join(told, ["node", "symbol_name"]).groupBy(*key).agg(F.min_by("documentation", first).alias("documentation"), F.min_by("owner", first).alias("inherited_from"))
        hit = materialize(hit, f"hit_{level}")
        found = hit if found is None else found.unionByName(hit)
        seen, open_, level = seen.unionByName(up), up.join(hit.select(*key), key, "left_anti"), level + 1
    return none if found is None else found.drop("repo").distinct()


def documented_pairs(files: DataFrame, texts: bool = True) -> DataFrame:
    """``rel, symbol_name, symbol_kind, line_number, end_line, code, documentation, inherited_from``.

    ``inherited_from`` is null where the documentation is the symbol's own. Without ``texts``,
    code and documentation are empty.
    """
    columns = ["rel", "symbol_name", "symbol_kind", "line_number", "end_line", "code"]
    symbols = materialize(source_symbols(files, texts), "symbols")
    written = symbols.where(~F.col("symbol_kind").isin(*HIERARCHY))
    own = written.where("telling").select(*columns, "documentation", F.lit(None).cast("string").alias("inherited_from"))
    key = ["rel", "version", "symbol_name", "line_number"]
    taken = written.where("NOT telling").select(*columns, "version").join(inherited(symbols), key).select(*columns, "documentation", "inherited_from")
    return own.unionByName(taken)


def documented_symbols(files: DataFrame) -> DataFrame:
    """``rel, symbol_name, line_number``, once each, of ``documented_pairs``."""
    return documented_pairs(files, texts=False).select("rel", "symbol_name", "line_number").distinct()
