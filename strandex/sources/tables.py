"""Reading the input tables, the corpora derived from them, and working tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.functions import encoding as E


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Symbols and small numbers take a third of the space that the default codec needs.
CODEC = "zstd"
#: The setting by which an execution removes its shuffle files at its end (Spark 4.1).
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the working tables of the scopes that are open, the innermost last.
_scopes: list[list[str]] = []


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df into the cluster's shared folder (spark.checkpoint.dir) and read it back.

    Iterative operators cut their lineage with this; every executor can read the files. The shuffle files of the write go with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _without_shuffle_files(spark):
        df.write.option("compression", CODEC).parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Working tables that materialise() writes inside are deleted at the end."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def drop(table: DataFrame) -> None:
    """Delete a table that materialise() wrote and nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        delete(table.sparkSession, path)


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, True)
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLE_CLEANUP) if before is None else spark.conf.set(_SHUFFLE_CLEANUP, before)


def measured_joins(spark: SparkSession) -> None:
    """Tables are broadcast by the size that they were measured to have, not by Spark's guess from the bytes of the files.

    The guess takes the rows of an exploded text to be as few as the texts, so that all suffixes of a corpus would be sent to the driver.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    now = spark.conf.get(static)
    if now != "-1":
        if spark.conf.get(adaptive, None) is None:
            spark.conf.set(adaptive, now)
        spark.conf.set(static, "-1")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where that is unset and the session has one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strandex-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def dna_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, enc, n: the nucleotide letters of each document, upper-cased, as digits with a terminator."""
    docs = read(spark, sf_dir, "documents").filter("doc_id is not null and text is not null")
    enc = F.concat(E.encode(F.regexp_replace(F.upper("text"), "[^ACGT]", "")), F.lit("0"))
    return docs.select("doc_id", enc.alias("enc")).withColumn("n", F.length("enc").cast("long"))


def fasta_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, raw: each document as a FASTA record."""
    docs = read(spark, sf_dir, "documents").filter("doc_id is not null and text is not null")
    return docs.select("doc_id", F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")).alias("raw"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """name, raw: plain-text or FASTA files, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("raw"))


def index_path(base: str, stage: str, d: int) -> str:
    """Where an index stage of d-letter symbols is kept."""
    E.check_d(d)
    return f"{base.rstrip('/')}/stage={stage}/d={d}"


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    system, mark = _folder(spark, f"{path}/_SUCCESS")
    return system.exists(mark)


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    system, where = _folder(spark, path)
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    system, where = _folder(spark, path)
    system.delete(where, True)


def write_index(df: DataFrame, base: str, stage: str, d: int, sort: list[str], by: str | None = None) -> str:
    """Write an index table, each of its files sorted (as it comes, if by nothing); by: a column with a directory for each of its values."""
    path = index_path(base, stage, d)
    with _without_shuffle_files(df.sparkSession):
        if by:
            df.repartition(by).sortWithinPartitions(by, *sort).write.mode("overwrite").option("compression", CODEC).partitionBy(by).parquet(path)
        else:
            (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite").option("compression", CODEC).parquet(path)
    return path
