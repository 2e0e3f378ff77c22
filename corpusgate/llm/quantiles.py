"""Percentiles of large numeric columns from summaries that can be combined (problem 5).

Deterministic buffer collapsing: values fill sorted buffers of ``K`` elements of weight 1; two
buffers of one weight merge into one of twice the weight by taking every second position of the
merged order, the lower and the upper one in turn. Each collapse moves a rank by at most the
inputs' weight, so a summary carries the sum as its proven bound.

Summaries are rows. Every task sorts its rows by key and folds them one key after the other, so it
holds the buffers of one key, however many keys there are; keys with fewer than ``K`` values pass
as columns, without a step in Python for each. Summaries of one key merge in a tree of fixed
fan-in, again in sorted order. What a summary holds follows from the values of each task, not from
the order in which they arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements of a buffer, and summaries merged at a time.
K = 2048
FAN_IN = 32

#: One row per buffer; ``err`` stands on the first row of a summary. Raw values have weight 1.
BUFFER = "weight long, vals array<double>, err double"


class Summary:
    """Buffers of one key: ``full[w]`` has at most one buffer of ``K`` values of weight ``w``."""

    def __init__(self, k: int = K) -> None:
        self.k, self.err = k, 0.0
        self.rest = np.empty(0)
        self.full: dict[int, np.ndarray] = {}
        self.turn: dict[int, int] = {}

    def add(self, values: np.ndarray) -> None:
        values = np.concatenate([self.rest, values])
        whole = len(values) // self.k * self.k
        for i in range(0, whole, self.k):
            self.place(1, np.sort(values[i : i + self.k]))
        self.rest = values[whole:]

    def place(self, weight: int, buffer: np.ndarray) -> None:
        while (other := self.full.pop(weight, None)) is not None:
            merged = np.sort(np.concatenate([buffer, other]), kind="stable")
            self.turn[weight] = 1 - self.turn.get(weight, 1)
            buffer = merged[self.turn[weight] :: 2]
            self.err += weight
            weight *= 2
        self.full[weight] = buffer

    def rows(self) -> list[tuple[int, np.ndarray, float]]:
        out = [(w, b) for w, b in sorted(self.full.items())]
        if len(self.rest):
            out.insert(0, (1, self.rest))
        return [(w, v, self.err if i == 0 else 0.0) for i, (w, v) in enumerate(out)]

    def take(self, weights: np.ndarray, offsets: np.ndarray, flat: np.ndarray, errs: np.ndarray) -> None:
        """Buffers as columns: row ``i`` has ``flat[offsets[i]:offsets[i + 1]]``; loose values first, then by weight."""
        sizes = np.diff(offsets)
        loose = sizes < self.k
        if loose.any():
            self.add(flat[offsets[0] : offsets[-1]][np.repeat(loose, sizes)])
        for i in sorted(np.flatnonzero(~loose), key=lambda i: weights[i]):
            self.place(int(weights[i]), flat[offsets[i] : offsets[i + 1]])
        self.err += float(errs.sum())


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _run_starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows at which a new key begins; null equals null."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _collapsed(batches: Iterator[pa.RecordBatch], keys: list[str], k: int) -> Iterator[pa.RecordBatch]:
    """One summary for each key of rows ``keys, weight, vals, err`` that are sorted by ``keys``; one open summary at a time."""
    open_key: tuple | None = None
    open_: Summary | None = None
    fields: list[pa.Field] = []

    def made(key_columns: list[pa.Array], weights, offsets, flat, errs) -> pa.RecordBatch:
        vals = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.float64()))
        columns = [*key_columns, pa.array(weights, pa.int64()), vals, pa.array(errs, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "weight", "vals", "err"])

    def closed(key: tuple, s: Summary) -> pa.RecordBatch:
        rows = s.rows()
        offsets = np.cumsum([0, *[len(v) for _, v, _ in rows]])
        flat = np.concatenate([v for _, v, _ in rows]) if rows else np.empty(0)
        return made([pa.array([x] * len(rows), f.type) for x, f in zip(key, fields)], [w for w, *_ in rows], offsets, flat, [e for *_, e in rows])

    for batch in batches:
        if not batch.num_rows:
            continue
        fields = [batch.schema.field(x) for x in keys]
        starts = _run_starts(batch, keys)
        ends = np.append(starts[1:], batch.num_rows)
        lists = batch.column("vals")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy(zero_copy_only=False)
        weights, errs = batch.column("weight").to_numpy(), batch.column("err").to_numpy()
        totals = offsets[ends] - offsets[starts]
        # Keys that lie whole inside this batch and fit in one loose buffer need no summary object.
        plain = (totals < k) & (np.maximum.reduceat(weights, starts) == 1)
        plain[-1] = False
        first = tuple(batch.column(x)[0].as_py() for x in keys)
        if open_ is not None and first == open_key:
            plain[0] = False
        elif open_ is not None:
            yield closed(open_key, open_)
            open_ = None
        if plain.any():
            rows = np.repeat(plain, ends - starts)
            kept = flat[offsets[0] : offsets[-1]][np.repeat(rows, np.diff(offsets))]
            at = pa.array(starts[plain])
            yield made([batch.column(x).take(at) for x in keys], np.ones(int(plain.sum()), dtype=np.int64), np.append(0, np.cumsum(totals[plain])), kept, np.add.reduceat(errs, starts)[plain])
        for i in np.flatnonzero(~plain):
            a, b = starts[i], ends[i]
            if i or open_ is None:
                if open_ is not None:
                    yield closed(open_key, open_)
                open_key, open_ = tuple(batch.column(x)[int(a)].as_py() for x in keys), Summary(k)
            open_.take(weights[a:b], offsets[a : b + 1], flat, errs[a:b])
    if open_ is not None:
        yield closed(open_key, open_)


def summarise(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """Rows ``keys, slot, weight, vals, err``: a summary of ``value`` for each key and task; ``slot`` is the task's number.

    Null and NaN values are left out; null keys are kept as null.
    """
    slim = df.select(*keys, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v")).sortWithinPartitions(*keys, "__v")
    raw = slim.select(*keys, F.lit(1).cast("long").alias("weight"), F.array("__v").alias("vals"), F.lit(0.0).alias("err"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId()
        for b in _collapsed(batches, keys, k):
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(np.full(b.num_rows, slot), pa.int64()), *b.columns[len(keys) :]], names=[*keys, "slot", "weight", "vals", "err"])

    return raw.mapInArrow(fold, f"{_ddl(slim, keys)}, slot long, {BUFFER}")


def merge_summaries(summaries: DataFrame, keys: list[str], slots: int, k: int = K, fan_in: int = FAN_IN) -> DataFrame:
    """One summary for each of ``keys``: rounds that merge at most ``fan_in`` neighbouring slots.

    ``slots`` is an upper bound of slot + 1. A key of any size comes to a task as at most
    ``fan_in`` summaries, each of about log2(n / K) buffers.
    """
    ddl = f"{_ddl(summaries, keys)}, slot long, {BUFFER}"
    on = [*keys, "slot"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _collapsed(batches, on, k)

    level = summaries
    while True:
        placed = level.withColumn("__was", F.col("slot")).withColumn("slot", F.expr(f"slot div {fan_in}")).repartition(*on)
        level = placed.sortWithinPartitions(*on, "__was", "weight", F.size("vals")).select(*on, "weight", "vals", "err").mapInArrow(merge, ddl)
        slots = (slots + fan_in - 1) // fan_in
        if slots <= 1:
            return level


def quantile_values(summary: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """``keys, n, rank_error, p<at>...``: values at rank ceil(q * n) and the bound of their rank error.

    A fraction of 0 gives the least value kept, 1 the greatest. A key has at most K values for each
    doubling of its rows, so its buffers fit in one array.
    """
    weight = F.col("weight")
    points = F.transform("vals", lambda v: F.struct(v.alias("v"), weight.alias("w")))
    one = summary.groupBy(*keys).agg(
        F.sum(weight * F.size("vals")).alias("n"), F.sum("err").alias("__err"), F.max("weight").alias("__most"), F.array_sort(F.flatten(F.collect_list(points))).alias("__points")
    )
    out = []
    for q in at:
        need = F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(q) * F.col("n") - F.lit(1e-9)))
        # The first point at which the weights so far reach the rank.
        start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("v"))
        walked = F.reduce(
            "__points", start, lambda acc, p: F.struct((acc["upto"] + p["w"]).alias("upto"), F.when(acc["v"].isNull() & (acc["upto"] + p["w"] >= need), p["v"]).otherwise(acc["v"]).alias("v")), lambda acc: acc["v"]
        )
        direct = F.element_at("__points", need.cast("int"))["v"]
        out.append(F.when(F.col("__most") == 1, direct).otherwise(walked).alias(f"p{q * 100:g}".replace(".", "_")))
    # A value kept for w others may also stand w ranks away from where it is counted.
    return one.select(*keys, "n", (F.col("__err") + F.col("__most") - 1).alias("rank_error"), *out)


def clean_language(language: Column) -> Column:
    """Trimmed lower case; null and blank are ``unknown``."""
    low = F.lower(F.trim(language))
    return F.when(low.isNull() | (low == ""), "unknown").otherwise(low)


def fact_measures(facts: DataFrame) -> DataFrame:
    """``language, file_path, metric, day, value`` of distinct facts: complexity and param_count, nulls left out.

    A repeated fact_id counts once; a fact without scanned_at has a null day. Null and empty
    file_path are kept apart.
    """
    once = facts.groupBy("fact_id").agg(F.min(F.struct("language", "file_path", "complexity", "param_count", "scanned_at")).alias("f"))
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"f.{m}").cast("double").alias("value")) for m in ("complexity", "param_count")]
    )
    return (
        once.select(clean_language(F.col("f.language")).alias("language"), F.col("f.file_path").alias("file_path"), F.to_date("f.scanned_at").alias("day"), F.explode(pairs).alias("m"))
        .select("language", "file_path", "day", "m.metric", "m.value")
        .where("value IS NOT NULL")
    )


def daily_summaries(facts: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """A summary per ``keys``, metric and scanned_at day; they can be stored and combined later."""
    tasks = summarise(fact_measures(facts), [*keys, "metric", "day"], "value", k)
    # A slot is a task's number, which stays below the shuffle's number of partitions.
    spark = facts.sparkSession
    return merge_summaries(tasks, [*keys, "metric", "day"], max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), k)


def combine_days(daily: DataFrame, keys: list[str], days: int = 1024, k: int = K) -> DataFrame:
    """A summary per ``keys`` and metric from those of all days.

    Days are neighbours by their number modulo ``days``, so a round merges at most 32 of them for
    any range of up to ``days`` days; a longer range only makes the groups larger.
    """
    slotted = daily.withColumn("slot", F.pmod(F.coalesce(F.datediff("day", F.lit("1970-01-01")), F.lit(-1)).cast("long"), F.lit(days)))
    return merge_summaries(slotted.drop("day"), [*keys, "metric"], days, k)


AT = (0.5, 0.9, 0.95, 0.99)


def percentiles(facts: DataFrame, keys: list[str], at: tuple[float, ...] = AT, k: int = K) -> DataFrame:
    """Per ``keys`` (of language, file_path) and metric: ``n``, the percentiles ``at`` and their proven ``rank_error``.

    ``rank_error`` is in rows: the true rank of each value is that close to the one asked for; it
    is 0 for keys of fewer than ``k`` values. An empty table gives no rows.
    """
    return quantile_values(combine_days(daily_summaries(facts, keys, k), keys, k=k), [*keys, "metric"], list(at))


def language_percentiles(facts: DataFrame, at: tuple[float, ...] = AT, k: int = K) -> DataFrame:
    """``percentiles`` of each language."""
    return percentiles(facts, ["language"], at, k)


def file_percentiles(facts: DataFrame, at: tuple[float, ...] = AT, k: int = K) -> DataFrame:
    """``percentiles`` of each language and file_path, many small groups beside a few very large ones."""
    return percentiles(facts, ["language", "file_path"], at, k)
