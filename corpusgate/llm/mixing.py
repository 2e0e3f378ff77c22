"""Sources mixed to target shares of all tokens (problem 7).

Capped water-filling over the sources' token counts: a source is clamped at its documents used
``max_repeats`` times each, the weight it cannot take goes to the others in proportion to their
targets, until no further source is clamped. A source's amount is whole passes over all its
documents plus a seeded sample for the fractional pass: documents are ordered by a seeded hash,
a histogram of hash ranges finds the range in which the wanted tokens are reached, that range is
cut into finer ones as long as it holds many documents, and only the documents of the last one
are ranked, so no source is ever sorted as one group.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.session import materialize

VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZERS = "/opt/tokenizers"
#: Bits of the hash by which a range is cut, how often at most, and the documents of a range that are ranked in one task.
RANGE_BITS = 12
LEVELS = 5
RANKED = 50_000

_ENCODERS: dict[str, object] = {}


def encoder(folder: str, vocabulary: str):
    """The public tokenizer of ``folder``, loaded once per process."""
    path = f"{folder}/{vocabulary}"
    if path not in _ENCODERS:
        import sys

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        try:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        except ImportError as missing:
            raise RuntimeError(f"no split pattern for {path} on {sys.executable}") from missing
        _ENCODERS[path] = tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of every row with a doc_id; null and empty texts have 0 tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from corpusgate.llm.mixing import encoder

        encode = encoder(folder, vocabulary).encode_ordinary
        for pdf in batches:
            n = [len(encode(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": pd.Series(n, dtype="int64")})

    return documents.where("doc_id IS NOT NULL").select("doc_id", "source", "text").mapInPandas(count, "doc_id long, source string, n_tokens long")


@dataclass(frozen=True)
class Share:
    source: str
    target: float
    max_repeats: int
    available: int
    tokens: float

    @property
    def epochs(self) -> float:
        return self.tokens / self.available if self.available else 0.0


def water_fill(wanted: list[tuple[str, float, int, int]], total: float) -> list[Share]:
    """Tokens of each source of ``(source, target, max_repeats, available)`` for ``total`` tokens in all.

    Sources without tokens, target or repeats get none. If all sources together hold less than
    ``total`` at their maximum, each gets its maximum.
    """
    room = {s: max(0, r) * a for s, _, r, a in wanted}
    goal = {s: max(0.0, t) for s, t, _, _ in wanted}
    got = {s: 0.0 for s, *_ in wanted}
    open_, left = {s for s in got if room[s] > 0 and goal[s] > 0}, float(total)
    while open_ and left > 0:
        weight = sum(goal[s] for s in open_)
        full = {s for s in open_ if goal[s] / weight * left >= room[s]}
        if not full:
            for s in open_:
                got[s] = goal[s] / weight * left
            break
        for s in full:
            got[s] = float(room[s])
            left -= room[s]
        open_ -= full
    return [Share(s, t, r, a, got[s]) for s, t, r, a in wanted]


def largest_exact_total(wanted: list[tuple[str, float, int, int]]) -> float:
    """The largest total for which no source that has documents is clamped."""
    weight = sum(t for _, t, r, a in wanted if a > 0 and r > 0 and t > 0)
    return min((r * a / (t / weight) for _, t, r, a in wanted if a > 0 and r > 0 and t > 0), default=0.0)


def source_shares(counted: DataFrame, targets: DataFrame, total_tokens: float | str | None = None) -> list[Share]:
    """The water-filled amount of every row of ``targets`` (a small, fixed table; at most 10,000 sources).

    ``total_tokens``: a number, ``"exact"`` for the largest total that reaches all targets, or None
    for the size of all listed sources together.
    """
    rows = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("t"), F.max("max_repeats").alias("r")).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 target sources")
    have = dict(
        counted.groupBy("source").agg(F.sum("n_tokens").alias("n"))
        .join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").collect()
    )
    wanted = sorted((r.source, float(r.t or 0), int(r.r or 0), int(have.get(r.source) or 0)) for r in rows)
    if total_tokens is None:
        total_tokens = sum(a for *_, a in wanted)
    elif total_tokens == "exact":
        total_tokens = largest_exact_total(wanted)
    return water_fill(wanted, float(total_tokens))


def _range(level: int) -> Column:
    """The number of a document's hash range; ranges of a higher level are parts of one below."""
    return F.shiftrightunsigned("__h", 64 - RANGE_BITS * (level + 1))


def edge_ranges(used: DataFrame, ranked: int = RANKED) -> tuple[int, list[tuple[str, int, float]]]:
    """The level, and of each source the range in which ``wanted`` is reached and the tokens left for it.

    ``used`` has ``source, n_tokens, wanted, __h``. Sources that fit whole have no range. Each
    level reads the documents once; the driver holds a row per source.
    """
    spark, edges, level = used.sparkSession, None, 0
    rising = Window.partitionBy("source").orderBy("__range")
    while True:
        rows = used
        if edges is not None:
            at = F.broadcast(spark.createDataFrame(edges, "source string, __edge long, __left double"))
            rows = used.join(at, "source").where(_range(level - 1) == F.col("__edge")).withColumn("wanted", F.col("__left"))
        hist = rows.groupBy("source", _range(level).alias("__range")).agg(F.sum("n_tokens").alias("__n"), F.count("*").alias("__docs"), F.first("wanted").alias("__wanted"))
        # The first range that does not fit whole; a source has at most 2 ** RANGE_BITS rows here.
        first = (
            hist.withColumn("__upto", F.sum("__n").over(rising))
            .where(F.col("__upto") > F.col("__wanted"))
            .groupBy("source")
            .agg(F.min_by(F.struct("__range", (F.col("__wanted") - (F.col("__upto") - F.col("__n"))).alias("left"), "__docs"), "__range").alias("e"))
            .select("source", "e.*")
        )
        found = first.collect()
        edges = [(r.source, r["__range"], float(r.left)) for r in found]
        if level + 1 == LEVELS or all(r["__docs"] <= ranked for r in found):
            return level, edges
        level += 1


def mix(counted: DataFrame, shares: list[Share], seed: int = 42, ranked: int = RANKED) -> DataFrame:
    """``doc_id, source, n_tokens, copies`` of the documents used: whole passes and the seeded fractional one.

    ``copies`` is never above max_repeats. The fractional pass takes documents in hash order while
    they fit in the wanted tokens, so it falls short by less than one document. Documents without
    tokens, of a null source or of a source that is not listed are not used.
    """
    spark = counted.sparkSession
    plan = [(s.source, int(s.epochs + 1e-12), max(0.0, s.tokens - int(s.epochs + 1e-12) * s.available)) for s in shares if s.tokens > 0]
    if not plan:
        return counted.where(F.lit(False)).withColumn("copies", F.lit(0))
    plans = spark.createDataFrame(plan, "source string, whole int, wanted double")
    used = counted.where("n_tokens > 0").join(F.broadcast(plans), "source").withColumn("__h", F.xxhash64(F.lit(seed), F.col("doc_id")))
    level, edges = edge_ranges(used, ranked)
    edge = spark.createDataFrame(edges, "__s string, edge long, left double")
    placed = used.join(F.broadcast(edge), F.col("source") == F.col("__s"), "left").withColumn("__range", _range(level))
    inside = Window.partitionBy("source").orderBy(F.shiftrightunsigned("__h", 1), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = placed.where(F.col("__range") == F.col("edge")).withColumn("extra", (F.sum("n_tokens").over(inside) <= F.col("left")).cast("int"))
    rest = placed.where(F.col("edge").isNull() | (F.col("__range") != F.col("edge"))).withColumn(
        "extra", F.when(F.col("edge").isNotNull() & (F.col("__range") < F.col("edge")), 1).when(F.col("edge").isNull() & (F.col("wanted") > 0), 1).otherwise(0)
    )
    return rest.unionByName(at_edge).withColumn("copies", F.col("whole") + F.col("extra")).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def _counted(documents: DataFrame, folder: str) -> DataFrame:
    """Token counts as a table; a repeated doc_id counts once, by the row with most tokens."""
    once = token_counts(documents, folder).groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("d"))
    return materialize(once.select("doc_id", "d.source", "d.n_tokens"), "token_counts")


def mixed_documents(documents: DataFrame, targets: DataFrame, total_tokens: float | str | None = None, seed: int = 42, folder: str = TOKENIZERS) -> DataFrame:
    """The mixture: each document used, with its ``copies``; see ``mix`` and ``source_shares``."""
    counted = _counted(documents, folder)
    return mix(counted, source_shares(counted, targets, total_tokens), seed)


def mix_report(documents: DataFrame, targets: DataFrame, total_tokens: float | str | None = None, seed: int = 42, folder: str = TOKENIZERS) -> DataFrame:
    """Per listed source: target and planned share, tokens available, planned and used, documents, copies, ``actual_share`` and how far it is from the plan, ``share_gap``."""
    counted = _counted(documents, folder)
    shares = source_shares(counted, targets, total_tokens)
    spark = documents.sparkSession
    all_ = sum(s.tokens for s in shares) or 1.0
    plan = spark.createDataFrame(
        [(s.source, s.target, s.max_repeats, s.available, s.tokens / all_) for s in shares],
        "source string, target_share double, max_repeats int, available_tokens long, planned_share double",
    )
    got = mix(counted, shares, seed).groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens")
    )
    zero = ("documents", "copies", "most_copies", "used_tokens")
    out = plan.join(got, "source", "left").select(*plan.columns, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in zero])
    whole = out.agg(F.sum("used_tokens").alias("__all"))
    return out.join(F.broadcast(whole)).withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.nullif(F.col("__all"), F.lit(0)), F.lit(0.0))).withColumn("share_gap", F.col("actual_share") - F.col("planned_share")).drop("__all")
