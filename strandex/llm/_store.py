"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
#: The setting by which an execution removes its shuffle files at its end (Spark 4.1).
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def column(name: str) -> Column:
    """The column of that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by bytes, so that very long texts do not meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local folder only where that is unset and the session has one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strandex-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Paths of the working tables of the scopes that are open, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Working tables that persist() writes inside are deleted at the end, but for those written for outside."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Executions inside remove their shuffle files when they end, not when the driver's garbage is next collected."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, True)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def persist(df: DataFrame, name: str, outside: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back; outside keeps it beyond the innermost scope.

    This cuts the lineage: a later stage rereads files that every executor can
    see, so that a lost executor costs only its own unfinished tasks. The shuffle files of the
    write go with it, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _without_shuffle_files(spark):
        df.write.parquet(path)
    if len(_scopes) > outside:
        _scopes[-2 if outside else -1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that persist() wrote and nothing reads any more."""
    files = table.inputFiles()
    if files:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
