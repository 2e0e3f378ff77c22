"""Evaluation passages inside a corpus (problem 6).

The test items are cut into blocks of half of ``WORDS`` words; all blocks are patterns of one
Aho-Corasick automaton. A document that repeats at least ``WORDS`` consecutive words of an item
contains one of its blocks; from there both texts are compared in both directions, which tells
exactly how far they agree. Words are runs of letters and digits, compared in lower case. Each
distinct word of the items is one character of the automaton's alphabet and any other word of a
document one that occurs in no pattern, so a text is scanned once, word by word, and a hit's words
lead back to its offsets.

The items are a stated set. Cut this way an item needs about one node for each of its words, so
one automaton, built once and sent to the tasks as a broadcast of that bound, holds
``BLOCK_WORDS`` words; a larger set is as many automata, each of them one more pass.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least number of consecutive words that count as a leak.
WORDS = 13
#: Words of the items in one automaton: bounds it to about 100 MB in a process, and its words to fewer than the alphabet has letters.
BLOCK_WORDS = 1_000_000

_WORD = re.compile(r"[^\W_]+")
#: The automaton's alphabet begins here; the characters before stand for no word of an item.
_FIRST, _OTHER = 0x100, "\x00"
_SURROGATES = range(0xD800, 0xE000)
#: Distinct words that one automaton can tell apart.
LETTERS = 0x110000 - _FIRST - len(_SURROGATES)


def _letters() -> Iterator[str]:
    return (chr(c) for c in range(_FIRST, 0x110000) if c not in _SURROGATES)


def words_of(text: str) -> list[str]:
    """The text's words in lower case."""
    low = text.lower()
    if len(low) == len(text):
        return _WORD.findall(low)
    return [w.lower() for w in _WORD.findall(text)]


class Passages:
    """The automaton over the blocks of some items that have ``words`` words or more."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS) -> None:
        import ahocorasick

        self.words, self.alphabet, self.ids, self.coded_items = words, {}, [], []
        self.block = (words + 1) // 2
        letters, places = _letters(), {}
        for item_id, text in items:
            coded = []
            for w in words_of(text or ""):
                if w not in self.alphabet:
                    self.alphabet[w] = next(letters)
                coded.append(self.alphabet[w])
            if len(coded) < words:
                continue
            code = "".join(coded)
            for at in range(0, len(code) - self.block + 1, self.block):
                places.setdefault(code[at : at + self.block], []).append((len(self.ids), at))
            self.ids.append(item_id)
            self.coded_items.append(code)
        self.automaton = ahocorasick.Automaton()
        for block, held in places.items():
            self.automaton.add_word(block, tuple(held))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def coded(self, text: str) -> str:
        get = self.alphabet.get
        return "".join([get(w, _OTHER) for w in words_of(text)])

    def _agreements(self, code: str, done: set[int] | None = None) -> Iterator[tuple[int, int, int]]:
        """``item, first, last`` words of the document for each stretch of ``words`` or more in which both agree; items of ``done`` are skipped."""
        seen: dict[tuple[int, int], int] = {}
        for end, held in self.automaton.iter(code):
            start = end - self.block + 1
            for item, at in held:
                if done is not None and item in done:
                    continue
                # The same shift of the same item agrees up to there already.
                if seen.get((item, start - at), -1) >= end:
                    continue
                text, first, last = self.coded_items[item], start, end
                shift = at - start
                while first and first + shift and code[first - 1] == text[first + shift - 1]:
                    first -= 1
                while last + 1 < len(code) and last + shift + 1 < len(text) and code[last + 1] == text[last + shift + 1]:
                    last += 1
                seen[item, start - at] = last
                if last - first + 1 >= self.words:
                    yield item, first, last

    def items_in(self, text: str | None) -> set[int]:
        """Items of which the text repeats a run."""
        if self.empty or not text:
            return set()
        done: set[int] = set()
        for item, _, _ in self._agreements(self.coded(text), done):
            done.add(item)
        return {self.ids[i] for i in done}

    def spans_in(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``item_id, start, end, words`` of each longest stretch whose every run of ``words`` words is one of the item, in characters of the text."""
        if self.empty or not text:
            return []
        runs: dict[int, list[tuple[int, int]]] = {}
        for item, first, last in self._agreements(self.coded(text)):
            runs.setdefault(self.ids[item], []).append((first, last - self.words + 1))
        if not runs:
            return []
        places = [m.span() for m in _WORD.finditer(text)]
        out = []
        for item_id, starts in runs.items():
            starts.sort()
            joined = [starts[0]]
            for a, b in starts[1:]:
                if a <= joined[-1][1] + 1:
                    joined[-1] = (joined[-1][0], max(joined[-1][1], b))
                else:
                    joined.append((a, b))
            out += [(item_id, places[a][0], places[b + self.words - 1][1], b + self.words - a) for a, b in joined]
        return sorted(set(out))


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``block_words`` words, an item with more being its own block.

    A single item of more distinct words than the alphabet has letters (1,111,808) raises here.
    """
    block, size = [], 0
    for row in items.select("item_id", "item_text").where("item_id IS NOT NULL AND item_text IS NOT NULL").distinct().orderBy("item_id").toLocalIterator():
        listed = words_of(row.item_text)
        n = len(listed)
        if n > LETTERS and len(set(listed)) > LETTERS:
            raise ValueError(f"item {row.item_id} has more than {LETTERS} distinct words")
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.item_text))
        size += n
    if block:
        yield block


def _each_block(documents: DataFrame, items: DataFrame, words: int, block_words: int, schema: str, found) -> DataFrame:
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    parts = []
    for block in item_blocks(items, block_words):
        sent = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pd.DataFrame], sent=sent, key=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            from corpusgate.llm import leakage

            passages = leakage.READY.get(key)
            if passages is None:
                leakage.READY.clear()
                passages = leakage.READY[key] = leakage.Passages(sent.value, words)
            for pdf in batches:
                rows = [(d, *hit) for d, t in zip(pdf["doc_id"], pdf["text"]) for hit in found(passages, t)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

        parts.append(texts.mapInPandas(scan, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The automaton of the block that this Python process worked on last.
READY: dict[str, Passages] = {}


def leaked_items(documents: DataFrame, items: DataFrame, words: int = WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id``, once each, where the document repeats ``words`` consecutive words of the item.

    Null and empty texts, rows without doc_id and items of fewer words match nothing; a doc_id that occurs in several
    rows matches if one of them does. No items or no documents give no rows.
    """
    hits = _each_block(documents, items, words, block_words, "doc_id long, item_id long", lambda p, t: [(i,) for i in sorted(p.items_in(t))])
    return hits.distinct()


def leaked_spans(documents: DataFrame, items: DataFrame, words: int = WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, start, end, words``: the longest repeated stretches, in characters of the text from 0."""
    schema = "doc_id long, item_id long, start int, end int, words int"
    return _each_block(documents, items, words, block_words, schema, lambda p, t: p.spans_in(t)).distinct()


def leak_report(documents: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """Per item: ``suite``, the number of ``documents`` with it and the ``longest`` stretch in words (0 where it leaked nowhere)."""
    spans = leaked_spans(documents, items, words)
    per_item = spans.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("words").alias("longest"))
    known = items.groupBy("item_id").agg(F.min("suite").alias("suite"))
    return known.join(per_item, "item_id", "left").select("item_id", "suite", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "longest")])
