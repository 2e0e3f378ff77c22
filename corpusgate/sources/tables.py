"""Files, trees and line records as tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.functions.paths import base_name
from corpusgate.operators.structure import SKIPPED_DIRECTORIES
from corpusgate.session import materialize


def tree(spark: SparkSession, root: str) -> DataFrame:
    """``rel, content`` of a file tree, read by the executors; hidden names are not listed by Spark's readers."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.col("path"), "^(file:)?/*" + root.strip("/").replace(".", "\\.") + "/", "")
    return found.select(rel.alias("rel"), F.decode("content", "UTF-8").alias("content"))


def listed_tree(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED_DIRECTORIES) -> DataFrame:
    """``rel, path`` of a tree that the executors see, hidden names too, without the skipped directories and ``.toml`` files.

    The tasks list the directories, one level a round.
    """

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(e.path, e.name, e.is_dir(follow_symlinks=False)) for folder in pdf["path"] for e in os.scandir(folder)]
            yield pd.DataFrame(rows, columns=["path", "name", "folder"])

    level, found, n = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), None, 0
    while True:
        listed = materialize(level.repartition("path").mapInPandas(below, "path string, name string, folder boolean"), f"listed_{n}")
        files = listed.where(~F.col("folder") & ~F.col("name").endswith(".toml"))
        found = files if found is None else found.unionByName(files)
        level = listed.where(F.col("folder") & ~F.col("name").isin(*skipped) & ~F.col("path").endswith("internal/router")).select("path")
        if level.isEmpty():
            start = 2 if root == "/" else len(root.rstrip("/")) + 2
            return found.select(F.substring("path", F.lit(start), F.length("path")).alias("rel"), "path")
        n += 1


def module_path(files: DataFrame) -> DataFrame:
    """``rel, module``: what each ``go.mod`` of ``files`` calls its module; '' where it does not say."""
    mods = files.where(base_name(F.col("rel")) == "go.mod")
    return mods.select("rel", F.regexp_extract("content", r"(?m)^module (\S+)", 1).alias("module"))


def ndjson(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON object per line; a bad line fails the read if ``strict``, else it is left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def lock_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, checksum, corrupt`` of an NDJSON lock file; ``corrupt`` holds a line that does not parse."""
    rows = spark.read.schema("file string, checksum string, _corrupt_record string").json(path)
    return rows.select("file", "checksum", F.col("_corrupt_record").alias("corrupt"))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """``created_at, reason, file, exists, checksum, content`` of a snapshot document."""
    files = "array<struct<file:string,exists:boolean,checksum:string,content:string>>"
    doc = spark.read.schema(f"created_at string, reason string, files {files}").option("multiLine", "true").json(path)
    return doc.select("created_at", "reason", F.explode("files").alias("f")).select("created_at", "reason", "f.*")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One column as text lines; refuses to overwrite."""
    df.select(column).write.mode("errorifexists").text(path)
