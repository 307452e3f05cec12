"""Intermediate tables on storage every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_local_base: dict[str, str] = {}
_shared: dict[tuple, str] = {}


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder the session names; it goes when the session's JVM ends.

    Only a single-process session without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get(_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder all executors share")
        app = spark.sparkContext.applicationId
        base = _local_base.setdefault(app, "") or tempfile.mkdtemp(prefix="dugout-")
        _local_base[app] = base
    path = f"{base.rstrip('/')}/dugout/{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    files.deleteOnExit(target)
    return path


#: Makes Spark delete a statement's shuffle files when it ends, not when the driver's garbage collector finds them.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Statements run inside leave no shuffle files; only for results that are read back from storage."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)


#: Rows in a file of a table that models are fitted on. Spark counts 4 MB for opening a file, so a scan task of
#: 128 MB gets at most 32 such files, however well their columns compress. Trees hold up to 1.2 KB a row of it.
FITTED_FILE_ROWS = 8_000
#: The same for the rows of many fits, whose statistics are shuffled once per task, tree and level.
FOLDED_FILE_ROWS = 25_000


def materialize(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """Cut the lineage by writing a table and reading it back.

    Unlike a cache, the files outlive any executor, so an iterative job that reads them many
    times never recomputes the plan behind them. ``file_rows`` bounds the rows of a file, and so those of a scan task.
    What was shuffled on the way is deleted once the table is there.
    """
    path = scratch_dir(df.sparkSession, label)
    with releasing_shuffles(df.sparkSession):
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession, label: str, *key: object) -> tuple[str, bool]:
    """(path, is it new): the one scratch folder of this application for a key, such as a data directory.

    For results that several queries of a session read; whoever finds it new fills it.
    """
    name = (spark.sparkContext.applicationId, label, *key)
    fresh = name not in _shared
    if fresh:
        _shared[name] = scratch_dir(spark, label)
    return _shared[name], fresh
