"""Session settings and tables written on the way.

A step that is read more than once, or whose row order must not change when a lost
executor's work is repeated, is written as a Parquet table under the shared folder that the
session names in ``spark.checkpoint.dir`` and read back. Nothing is kept only on an executor.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def _own_folder() -> str:
    """A folder of this process on this machine, which for a local session all tasks share; gone when the process ends."""
    made = tempfile.mkdtemp(prefix="spark-corpusgate-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, name: str = "corpusgate") -> SparkSession:
    """A local session with the settings that the queries expect; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", os.environ.get("CORPUSGATE_SHARED_DIR") or _own_folder())
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of its own only where none is set, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", _own_folder())
    return spark.conf.get("spark.checkpoint.dir")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpusgate/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget_tables(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` wrote for this session; returns their number."""
    mine = [p for s, p in _WRITTEN if s is spark]
    jvm = spark.sparkContext._jvm
    for path in mine:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN[:] = [(s, p) for s, p in _WRITTEN if s is not spark]
    return len(mine)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions, at least the cluster's cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
