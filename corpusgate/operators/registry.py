"""Tables against tables: manifests, locks, merged configurations, sets and dependency levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.session import materialize


def checksums(files: DataFrame) -> DataFrame:
    """``file, checksum``: SHA-256 of each file's text, in hex."""
    return files.select(F.col("rel").alias("file"), F.sha2(F.encode("content", "UTF-8"), 256).alias("checksum"))


def lock_verdicts(lock: DataFrame, current: DataFrame) -> DataFrame:
    """``file, verdict``: ``missing`` from current, ``unexpected`` in it, ``changed``; equal ones are left out."""
    both = lock.select("file", F.col("checksum").alias("locked")).join(current.select("file", F.col("checksum").alias("now")), "file", "full_outer")
    verdict = F.when(F.col("now").isNull(), "missing").when(F.col("locked").isNull(), "unexpected").when(F.col("locked") != F.col("now"), "changed")
    return both.select("file", verdict.alias("verdict")).where("verdict IS NOT NULL")


def merged(base: DataFrame, over: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows of both by ``key``; where both have one, that of ``over`` wins as a whole; ``origin`` says which."""
    a = base.select(F.col(key), F.struct(*values).alias("__a"))
    b = over.select(F.col(key), F.struct(*values).alias("__b"))
    chosen = F.coalesce("__b", "__a")
    origin = F.when(F.col("__b").isNotNull(), "over").otherwise("base")
    return a.join(b, key, "full_outer").select(key, *[chosen[v].alias(v) for v in values], origin.alias("origin"))


def set_differences(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """``column, side``: values of one side only, ``left`` or ``right``."""
    l, r = left.select(column).distinct(), right.select(column).distinct()
    return l.exceptAll(r).withColumn("side", F.lit("left")).unionByName(r.exceptAll(l).withColumn("side", F.lit("right")))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n`` of keys with more than one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def not_stricter(base: DataFrame, over: DataFrame, group: str, value: str, most: int = 10_000) -> DataFrame:
    """``group, lacking``: groups of ``over`` that lack some value which every group must have (those of ``base``), with these values in order.

    The demanded values are a configuration of at most ``most``; more raise. Null groups and
    values are left out.
    """
    must = base.where(F.col(value).isNotNull()).select(value).distinct()
    if must.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} demanded values")
    wanted = must.agg(F.array_sort(F.collect_list(value)).alias("__must"))
    # A group holds no more of them than there are.
    held = over.where(F.col(group).isNotNull()).join(F.broadcast(must.withColumn("__m", F.lit(True))), value, "left")
    held = held.groupBy(group).agg(F.collect_set(F.when(F.col("__m"), F.col(value))).alias("__held"))
    lacking = held.join(F.broadcast(wanted)).select(group, F.array_except("__must", "__held").alias("lacking"))
    return lacking.where(F.size("lacking") > 0)


def dependency_levels(edges: DataFrame) -> DataFrame:
    """``node, level, in_circle``: 0 for nodes that need nothing, else one more than the highest node needed.

    ``edges`` (``node, needs``): a need that is no node of its own is level 0. Nodes in or behind a
    circle have no level and ``in_circle`` true. Nodes leave in rounds when all their needs have a
    level; a round joins the edges that are still open with the nodes that just got theirs, ends
    the lineage, and the next one reads only what it left. Rounds go on until no node leaves.
    """
    edges = materialize(edges.where("node IS NOT NULL AND needs IS NOT NULL").select("node", "needs").distinct(), "edges")
    nodes = edges.select("node").union(edges.select("needs")).distinct()
    done = materialize(nodes.join(edges.select("node").distinct(), "node", "left_anti").withColumn("level", F.lit(0)), "level_0")
    levels, open_ = [done], edges
    while True:
        rest = materialize(open_.join(done.select(F.col("node").alias("needs")), "needs", "left_anti").select("node", "needs"), f"open_{len(levels)}")
        leaving = open_.select("node").distinct().join(rest.select("node").distinct(), "node", "left_anti")
        done = materialize(leaving.withColumn("level", F.lit(len(levels))), f"level_{len(levels)}")
        if done.isEmpty():
            break
        levels.append(done)
        open_ = rest
    known = levels[0]
    for level in levels[1:]:
        known = known.unionByName(level)
    return nodes.join(known, "node", "left").withColumn("in_circle", F.col("level").isNull())


def port_links(consumers: DataFrame, providers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links ``consumer, provider`` of ``consumers`` (``consumer, port``) with ``providers`` (``provider, port``) by port, and the consumers' rows that nobody provides for.

    Rows with a null port are neither.
    """
    wants, has = consumers.where("port IS NOT NULL"), providers.where("port IS NOT NULL")
    return wants.join(has, "port").select("consumer", "provider", "port"), wants.join(has.select("port").distinct(), "port", "left_anti").select("consumer", "port")


def parent_edges(paths: DataFrame) -> DataFrame:
    """``node, needs``: each directory needs the one above it."""
    parts = F.split("dir", "/")
    chain = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("node"), F.array_join(F.slice(parts, 1, n - 1), "/").alias("needs")))
    return paths.where(F.size(parts) > 1).select(F.explode(chain).alias("e")).select("e.node", "e.needs").distinct()


def lock_lines(text: Column) -> Column:
    """A line of a lock file as a struct; null for a corrupt one."""
    return F.from_json(text, "file string, checksum string")
