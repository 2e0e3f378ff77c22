"""Facts of source files: every named function and method with its measures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.schema import FACT

LANGUAGES = {"go": "go", "python": "python", "typescript": "typescript", "javascript": "typescript"}


def source_facts(files: DataFrame) -> DataFrame:
    """The fact relation of ``files`` (``rel, content``) in the six code extensions; others give no rows.

    Go facts carry no parameter names and no documentation; JavaScript counts as typescript. What
    does not parse gives what was found. Null contents give no rows.
    """
    names = [c.split()[0] for c in FACT.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from corpusgate.sources.sourcecode import language_of, symbols_of

        for pdf in batches:
            rows = []
            for rel, content in zip(pdf["rel"], pdf["content"]):
                lang = LANGUAGES.get(language_of(rel) or "", "")
                for s in symbols_of(rel, content):
                    go = lang == "go"
                    rows.append(("function_quality_fact", s.name, lang, s.kind, rel, s.line, s.end_line, s.complexity, s.param_count, [] if go else list(s.params), s.nil_guards, "" if go else s.doc))
            yield pd.DataFrame(rows, columns=names)

    code = F.lower("rel").rlike(r"\.(go|py|ts|tsx|js|jsx)$")
    return files.where(code & F.col("content").isNotNull()).select("rel", "content").mapInPandas(scan, FACT)
