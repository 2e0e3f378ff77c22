"""The N best items of every group, also of groups with a large share of all rows (problem 3).

Per-group score histograms give a lower threshold that at least N rows reach; rows below it are
dropped before anything is sorted, and the survivors are ranked exactly with the tie keys. Every
group of more than N rows has a threshold. Those of groups above a share of all rows are at most
one over that share, so they are a broadcast of proven size; the others are joined by group, and
no group among them is a large part of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group's threshold is broadcast from this share of all rows; at most 1 / LARGE_SHARE groups are so large.
LARGE_SHARE = 0.0005
#: Histogram steps for each doubling of the score above STEADY, below which each integer is a step.
STEPS = 8
STEADY = 32


def score_bin(score: Column) -> Column:
    """A step function that never falls as ``score`` rises; about 40 bits of scores fit 300 steps, any double 17,000."""
    size = F.abs(score.cast("double"))
    # The last step holds the infinite ones.
    far = F.floor(F.least(F.log2(size / F.lit(STEADY)), F.lit(2000.0)) * STEPS).cast("int") + STEADY
    up = F.when(size < STEADY, F.floor(size).cast("int")).otherwise(far)
    return F.when(score >= 0, up).otherwise(-up - 1)


def top_n(df: DataFrame, group: list[str], score: str, ties: list[Column], n: int, large_share: float = LARGE_SHARE) -> DataFrame:
    """The first ``n`` rows of every ``group`` by ``score`` descending, then ``ties``; ``rank`` from 1.

    Rows with a null or NaN ``score`` are not items, infinite ones are. A null in ``group`` is a group of its own.
    Rows equal in score and all ties share no order among themselves, but never make more than
    ``n``. ``n`` below 1 or an empty ``df`` gives no rows. A column named ``rank`` is refused.
    """
    if "rank" in df.columns:
        raise ValueError("column 'rank' is made here; rename it first")
    items = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    if n < 1:
        return items.where(F.lit(False)).withColumn("rank", F.lit(1))
    keys = [f"__k{i}" for i in range(len(group))]
    hist = items.groupBy(*group, score_bin(F.col(score)).alias("__bin")).agg(F.count("*").alias("__n"))
    whole = hist.groupBy().agg(F.sum("__n").alias("__all"))
    per_group = Window.partitionBy(*group)
    falling = per_group.orderBy(F.col("__bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = (
        hist.withColumn("__size", F.sum("__n").over(per_group))
        .withColumn("__reached", F.sum("__n").over(falling))
        .where((F.col("__size") > n) & (F.col("__reached") >= n))
        .groupBy(*group)
        .agg(F.max("__bin").alias("__least"), F.first("__size").alias("__size"))
        .select(*[F.col(g).alias(k) for g, k in zip(group, keys)], "__least", "__size")
    )
    marked = least.join(F.broadcast(whole)).withColumn("__large", F.col("__size") > F.col("__all") * F.lit(large_share)).drop("__size", "__all")
    large, others = F.broadcast(marked.where("__large")).drop("__large"), marked.where("NOT __large").drop("__large")
    same = F.lit(True)
    for g, k in zip(group, keys):
        same = same & F.col(g).eqNullSafe(F.col(k))
    reached = F.col("__least").isNull() | (score_bin(F.col(score)) >= F.col("__least"))
    of_large = items.join(large, same).where(reached)
    of_others = items.join(large, same, "left_anti").join(others, same, "left").where(reached)
    kept = of_large.unionByName(of_others).drop(*keys, "__least")
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), *ties)
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def most_complex_facts(facts: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most complex distinct facts of every file_path: ``file_path, fact_id, complexity, line_number, rank``.

    Order: complexity descending, line_number ascending (nulls last), fact_id ascending. Facts
    without complexity or with a null or empty file_path are left out; repeats of a fact (equal
    in all but ingested_at) count once.
    """
    slim = facts.where(F.col("complexity").isNotNull() & (F.col("file_path") != "")).select("file_path", "fact_id", "complexity", "line_number")
    return top_n(slim.distinct(), ["file_path"], "complexity", [F.col("line_number").asc_nulls_last(), F.col("fact_id").asc()], n)
