"""Per-key results where a few keys hold most rows (problem 2).

Exact offset chunking. The rows lie in input partitions that are ranges of the row order, so
no key is whole in one of them. Each partition counts its keys; a prefix sum of the counts over
the partitions gives the key's offset in every partition; offset plus rank inside the partition
is the row's exact number within its key. Equal-sized chunks of these numbers are reduced to
boundary states, and the ordered states are merged, a bounded number at a time. A key with a
third of all rows is as many independent chunks as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.session import materialize, parallelism

#: Rows in a chunk and states merged at a time.
CHUNK_ROWS = 20_000
FAN_IN = 500
#: Most rows of an input partition; more rows make more partitions than the shuffle has.
RANGE_ROWS = 2_000_000

_STATE = "struct<n:bigint,first:string,last:string,changes:bigint,pre:bigint,suf:bigint,best:bigint>"


def offset_numbers(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``seq``: the row's number from 0 within its key, in ``order``.

    ``order`` must identify a row; rows equal in all of it are numbered in no fixed order.
    Null is a key and an order value like any other (nulls first). An empty ``df`` stays empty.
    """
    spark = df.sparkSession
    taken = [c for c in ("__part", "__rank", "__before", "seq") if c in df.columns]
    if taken:
        raise ValueError(f"columns {taken} are made here; rename them first")
    ranged = df.repartitionByRange(partitions or parallelism(spark), *[F.col(c).asc_nulls_first() for c in order])
    placed = materialize(ranged.withColumn("__part", F.spark_partition_id()), "ranged")
    return number_placed(placed, keys, order)


def number_placed(placed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``seq`` for rows whose ``__part`` ascends with ``order``; see ``offset_numbers``."""
    in_order = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "__part")
        .agg(F.count("*").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(in_order), F.lit(0)))
        .drop("__n")
    )
    here = Window.partitionBy(*keys, "__part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = placed.withColumn("__rank", F.row_number().over(here)).alias("r")
    same = F.lit(True)
    for c in [*keys, "__part"]:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}"))
    return ranked.join(offsets.alias("o"), same).select(
        *[F.col(f"r.{c}") for c in placed.columns if c != "__part"],
        (F.col("o.__before") + F.col("r.__rank") - 1).alias("seq"),
    )


def _leaf(value: Column) -> Column:
    return F.struct(
        F.lit(1).cast("long").alias("n"), value.alias("first"), value.alias("last"), F.lit(0).cast("long").alias("changes"),
        F.lit(1).cast("long").alias("pre"), F.lit(1).cast("long").alias("suf"), F.lit(1).cast("long").alias("best"),
    )


def _merge(a: Column, b: Column) -> Column:
    """State of a stretch followed by another: runs that touch at the boundary are joined."""
    joined = a["last"] == b["first"]
    across = F.when(joined, a["suf"] + b["pre"]).otherwise(F.lit(0))
    both = F.struct(
        (a["n"] + b["n"]).alias("n"),
        a["first"].alias("first"),
        b["last"].alias("last"),
        (a["changes"] + b["changes"] + F.when(joined, 0).otherwise(1)).alias("changes"),
        (a["pre"] + F.when(joined & (a["pre"] == a["n"]), b["pre"]).otherwise(0)).alias("pre"),
        (b["suf"] + F.when(joined & (b["suf"] == b["n"]), a["suf"]).otherwise(0)).alias("suf"),
        F.greatest(a["best"], b["best"], across).alias("best"),
    )
    return F.when(a.isNull(), b).otherwise(both)


def ordered_states(numbered: DataFrame, keys: list[str], value: str, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Per key: ``n``, ``changes`` of ``value`` along ``seq`` and the ``longest`` run of one value.

    ``value`` is a string; null counts as the value ''. Chunks of ``chunk_rows`` rows come first,
    then rounds that merge ``fan_in`` neighbouring states, until every key has one.
    """
    at = "__chunk"
    cut = numbered.select(*keys, "seq", F.coalesce(F.col(value), F.lit("")).alias("__v")).withColumn(at, F.expr(f"seq div {chunk_rows}"))
    # Runs inside a chunk by lag and a running count, so the rows never meet in one array.
    within = Window.partitionBy(*keys, at).orderBy("seq")
    turn = F.coalesce((F.lag("__v").over(within) != F.col("__v")).cast("int"), F.lit(0))
    runs = (
        cut.withColumn("__turn", turn)
        .withColumn("__run", F.sum("__turn").over(within))
        .groupBy(*keys, at, "__run")
        .agg(F.count("*").alias("len"), F.first("__v").alias("__v"))
    )
    states = runs.groupBy(*keys, at).agg(
        F.struct(
            F.sum("len").alias("n"),
            F.min_by("__v", "__run").alias("first"),
            F.max_by("__v", "__run").alias("last"),
            F.max("__run").cast("long").alias("changes"),
            F.min_by("len", "__run").alias("pre"),
            F.max_by("len", "__run").alias("suf"),
            F.max("len").alias("best"),
        ).cast(_STATE).alias("state")
    )
    states = materialize(states, "chunk_states")
    top = states.agg(F.max(at)).first()[0] or 0
    while True:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), F.col("state")))), lambda x: x["state"])
        states = (
            states.withColumn("__up", F.expr(f"{at} div {fan_in}"))
            .groupBy(*keys, F.col("__up"))
            .agg(F.reduce(ordered, F.lit(None).cast(_STATE), _merge).alias("state"))
            .withColumnRenamed("__up", at)
        )
        if top < fan_in:
            break
        top //= fan_in
    return states.select(*keys, F.col("state.n").alias("n"), F.col("state.changes").alias("changes"), F.col("state.best").alias("longest"))


def latest_rows(df: DataFrame, key: str, by: str, columns: list[str]) -> DataFrame:
    """One row per ``key``: the one with the latest ``by``; ties go to the greater values.

    Aggregated before the shuffle, so repeats of one key never meet in a window.
    """
    picked = F.max(F.struct(F.col(by), *[F.col(c) for c in columns]))
    return df.groupBy(key).agg(picked.alias("__r")).select(key, *[F.col("__r")[c].alias(c) for c in columns])


def key_profiles(violations: DataFrame, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per rule and one per file of ``violations``.

    ``key_kind`` is ``rule`` or ``file``; ``key`` the rule or the file, null and empty kept apart.
    ``n`` distinct violations, ``others`` distinct files of a rule or rules of a file (null not
    counted), ``errors``/``warnings``/``infos``/``unrated`` by lower-cased severity, where
    ``warning`` is ``warn`` and an unknown or missing one is unrated, ``first_at``/``last_at``
    of reported_at, and along (reported_at, violation_id) the number of severity ``changes`` and
    the ``longest`` run of one severity. A repeated violation_id counts once, as last ingested;
    an empty table gives no rows; other columns are ignored.
    """
    sev = F.lower(F.trim(F.col("severity")))
    rated = F.when(sev.isin("error", "err"), "e").when(sev.isin("warn", "warning"), "w").when(sev.isin("info", "note"), "i").otherwise("u")
    slim = violations.select("violation_id", "ingested_at", "reported_at", "rule_id", "file", rated.alias("sev"))
    once = latest_rows(slim, "violation_id", "ingested_at", ["reported_at", "rule_id", "file", "sev"])
    spark = violations.sparkSession
    # The count comes from the files' metadata.
    partitions = max(parallelism(spark), violations.count() // RANGE_ROWS + 1)
    ranged = once.repartitionByRange(partitions, F.col("reported_at").asc_nulls_first(), F.col("violation_id").asc_nulls_first())
    placed = materialize(ranged.withColumn("__part", F.spark_partition_id()), "violations_ranged")

    def of(kind: str, key: str, other: str) -> DataFrame:
        keyed = placed.select(F.lit(kind).alias("key_kind"), F.col(key).alias("key"), F.col(other).alias("other"), "reported_at", "violation_id", "sev", "__part")
        return keyed

    keyed = of("rule", "rule_id", "file").unionByName(of("file", "file", "rule_id"))
    keys = ["key_kind", "key"]
    counts = (
        keyed.groupBy(*keys, "other")
        .agg(
            *[F.count_if(F.col("sev") == s).alias(name) for s, name in (("e", "errors"), ("w", "warnings"), ("i", "infos"), ("u", "unrated"))],
            F.min("reported_at").alias("first_at"), F.max("reported_at").alias("last_at"),
        )
        .groupBy(*keys)
        .agg(
            F.count("other").alias("others"),
            *[F.sum(c).alias(c) for c in ("errors", "warnings", "infos", "unrated")],
            F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        )
    )
    numbered = number_placed(keyed.drop("other"), keys, ["reported_at", "violation_id"])
    along = ordered_states(numbered, keys, "sev", chunk_rows, fan_in)
    same = F.col("c.key_kind").eqNullSafe(F.col("a.key_kind")) & F.col("c.key").eqNullSafe(F.col("a.key"))
    return counts.alias("c").join(along.alias("a"), same).select(
        "c.key_kind", "c.key", "a.n", "c.others", "c.errors", "c.warnings", "c.infos", "c.unrated", "c.first_at", "c.last_at", "a.changes", "a.longest",
    )
