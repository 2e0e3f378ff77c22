"""Personal information in free text, found and replaced (problem 8).

Bootstrapped contextual extraction. One pass over the distinct texts lists the candidates (see
``pii_mentions``), each with the keys of its instances (given name, family name, shape of a
number, domain of an address) and of the lexical patterns around it. Some are seeds by their own
form: a title before a family name, a name beside its own e-mail address or number, a number
behind its kind's word or in a form that only such numbers have, numbers that machines write, an
address with an at sign, a street with a house number and a town. Patterns take the mean score of
their instances and instances that of their patterns, in rounds over the graph of all (instance,
pattern) pairs; an instance that is never a seed is found by the patterns it shares with others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.llm.credentials import spliced
from corpusgate.session import materialize

ROUNDS = 3
#: Weight of doubt: evidence of this many neutral neighbours is added to every node.
DOUBT = 2.0
#: Weight of a seed against one neighbour in the graph.
SEED_WEIGHT = 3.0
#: Least scores: of a given name, of a family name behind an initial, of a number's shape, of an e-mail or street address.
#: In large corpora false names stay below 0.2 and true ones reach 0.6.
GIVEN, FAMILY, SHAPE, ADDRESS = 0.25, 0.05, 0.1, 0.1
#: A node with more edges is joined by broadcast, if it also has more than one in ``HOT_SHARE`` of all; so there are at most ``HOT_SHARE`` of them.
HOT_ROWS = 200_000
HOT_SHARE = 10_000

#: What a candidate of each kind can be; a seed is the label's number, -1 for none.
LABELS = {"name": ("name",), "number": ("id_number", "phone", "other"), "email": ("email",), "address": ("address",)}
_SCORES = ("s_0", "s_1", "s_2")
MENTION = "text_key binary, line_no int, start int, end int, kind string, seed int, instances array<string>, patterns array<string>"


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def mentions(documents: DataFrame) -> DataFrame:
    """All candidates of the distinct texts of ``documents``; null, empty and blank texts have none."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from corpusgate.llm.pii_mentions import Text, mentions_in

        names = [c.split()[0] for c in MENTION.split(", ")]
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["text_key"], pdf["text"]):
                found = mentions_in(text)
                if found:
                    places = Text(text)
                    rows += [(key, places.line(m.start), m.start, m.end, m.kind, LABELS[m.kind].index(m.seed) if m.seed else -1, list(m.instances), list(m.patterns)) for m in found]
            yield pd.DataFrame(rows, columns=names)

    texts = documents.where("length(trim(text)) > 0").select(text_key(F.col("text")).alias("text_key"), "text").distinct()
    return texts.mapInPandas(scan, MENTION)


def hot_nodes(edges: DataFrame, key: str, total: int, hot_rows: int) -> DataFrame | None:
    """``kind, key`` of the nodes with so many edges that they are joined by broadcast; None if there are none."""
    many = edges.groupBy("kind", key).agg(F.count("*").alias("__n")).where(F.col("__n") > max(hot_rows, total // HOT_SHARE)).select("kind", key)
    hot = materialize(many, "hot")
    return None if hot.isEmpty() else hot


def with_scores(df: DataFrame, scores: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``df`` with the scores of its ``key``, inner join; the keys of ``hot`` by broadcast, so that no task gets all of one."""
    on = ["kind", key]
    if hot is None:
        return df.join(scores, on)
    few = scores.join(F.broadcast(hot), on, "left_semi")
    return df.join(F.broadcast(few), on).unionByName(df.join(F.broadcast(hot), on, "left_anti").join(scores, on))


def instance_scores(found: DataFrame, rounds: int = ROUNDS, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """``kind, inst`` and a score between 0 and 1 for each label, of every instance of ``found``; and the hot instances."""
    single = found.select("kind", "seed", "patterns", F.explode("instances").alias("inst"))
    counts = [F.count_if(F.col("seed") == i).alias(f"n_{i}") for i in range(len(_SCORES))]
    seeds = materialize(single.groupBy("kind", "inst").agg(F.count("*").alias("deg"), F.count_if(F.col("seed") >= 0).alias("known"), *counts), "seeds")
    edges = materialize(single.select("kind", "inst", F.explode("patterns").alias("pat")).groupBy("kind", "inst", "pat").agg(F.count("*").alias("n")), "edges")
    total = edges.count()
    hot_inst, hot_pat = (hot_nodes(edges, key, total, hot_rows) for key in ("inst", "pat"))
    weighted = [F.sum(F.col("n") * F.col(s)).alias(s) for s in _SCORES]
    scores = seeds.select("kind", "inst", *[(F.col(f"n_{i}") / (F.col("deg") + DOUBT)).alias(s) for i, s in enumerate(_SCORES)])
    for _ in range(rounds):
        of_pattern = with_scores(edges, scores, "inst", hot_inst).groupBy("kind", "pat").agg(F.sum("n").alias("__n"), *weighted)
        of_pattern = of_pattern.select("kind", "pat", *[(F.col(s) / (F.col("__n") + DOUBT)).alias(s) for s in _SCORES])
        taken = with_scores(edges, of_pattern, "pat", hot_pat).groupBy("kind", "inst").agg(F.sum("n").alias("__n"), *weighted)
        both = [((SEED_WEIGHT * F.col(f"n_{i}") + F.col(s)) / (SEED_WEIGHT * F.col("known") + F.col("__n") + DOUBT)).alias(s) for i, s in enumerate(_SCORES)]
        scores = seeds.join(taken, ["kind", "inst"]).select("kind", "inst", *both)
    return materialize(scores, "scores"), hot_inst


def text_mentions(documents: DataFrame, rounds: int = ROUNDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``text_key, line_no, start, end, kind`` of every mention of personal information in each distinct text.

    Characters are counted from 0, lines from 1. Kinds: email, phone, id_number, address, name.
    Spans of one text may overlap.
    """
    found = materialize(mentions(documents), "mentions")
    scores, hot = instance_scores(found, rounds, hot_rows)
    place = ["text_key", "line_no", "start", "end"]
    best = lambda prefix: F.max(F.when(F.col("inst").startswith(prefix), F.col("s_0")))
    judged = (
        with_scores(found.select(*place, "kind", "seed", F.explode("instances").alias("inst")), scores, "inst", hot)
        .groupBy(*place, "kind")
        .agg(F.max("seed").alias("seed"), best("G ").alias("given"), best("F ").alias("family"), *[F.max(s).alias(s) for s in _SCORES])
    )
    seed, top = F.col("seed"), F.greatest(*_SCORES)
    named = (seed == 0) | F.when(F.col("given").isNotNull(), F.col("given") >= GIVEN).otherwise(F.col("family") >= FAMILY)
    number = F.when(seed == 0, "id_number").when(seed == 1, "phone").when(top < SHAPE, None).when(F.col("s_0") == top, "id_number").when(F.col("s_1") == top, "phone")
    kind = F.when(F.col("kind") == "name", F.when(named, "name")).when(F.col("kind") == "number", number).when((seed == 0) | (F.col("s_0") >= ADDRESS), F.col("kind"))
    return judged.select(*place, kind.alias("kind")).where("kind IS NOT NULL")


def _ids(documents: DataFrame) -> DataFrame:
    return documents.where("length(trim(text)) > 0").select("doc_id", text_key(F.col("text")).alias("text_key")).distinct()


def personal_mentions(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, line_no, start, end, kind`` of every mention in every document, rows with a null id included.

    Copies of a text are scanned once and weigh once in the graph; rows repeated in doc_id and text count once.
    """
    return _ids(documents).join(text_mentions(documents, rounds), "text_key").drop("text_key")


def personal_lines(documents: DataFrame) -> DataFrame:
    """``doc_id, line_no, kind``, once each: the lines with personal information; rows with a null id are left out."""
    lines = text_mentions(documents).select("text_key", "line_no", "kind").distinct()
    return _ids(documents.where("doc_id IS NOT NULL")).join(lines, "text_key").select("doc_id", "line_no", "kind").distinct()


def merged_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, spans``: the spans of each key in order; of those that overlap only the first, up to the farthest end."""
    in_order = Window.partitionBy(*keys).orderBy("start", F.col("end").desc(), "kind")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    first = spans.withColumn("__new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    grouped = first.withColumn("__g", F.sum("__new").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = grouped.groupBy(*keys, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("kind", "__new").alias("kind"))
    return one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))


def anonymised(documents: DataFrame) -> DataFrame:
    """``doc_id, text, n_mentions``: texts with ``<NAME>``, ``<PHONE>``, ... in place of what was found.

    Null and empty texts stay as they are, texts with a null id are masked too; rows repeated in doc_id and text give one row.
    """
    once = documents.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).distinct()
    joined = once.join(merged_spans(text_mentions(documents), ["text_key"]), "text_key", "left")
    return joined.select("doc_id", spliced(F.col("text"), F.col("spans")).alias("text"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_mentions"))
