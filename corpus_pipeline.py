"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of documents.

Defined results: null texts stay null to the end and make no piece, as do empty ones; rows with a null
doc_id are scored, deduplicated, mixed and packed like others, but neither have nor cause repeated
passages; of rows that repeat id and text one stays after the second stage, while documents without words
all stay; ties go to the smaller id; an empty table gives no rows; columns beyond those of documents
pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm import mixing, neardup, packing, substrings, toxicity
from strandex.llm._store import bound_batches, persist
from strandex.llm.registry import _held_out

#: Words from which a passage that stands in an earlier document too is cut out.
PASSAGE_WORDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model scores 0.5 or more go."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train_toxicity(docs, labels, usable=~_held_out(5, 0))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the row of the smallest doc_id stays."""
    bound_batches(spark)
    return neardup.without_copies(docs, k=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words and more that an earlier document has too are cut out; every document stays."""
    bound_batches(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = substrings.repeated_spans(docs, min_words=PASSAGE_WORDS, carry=others, outcome=substrings.WITHOUT_REPEATS)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("carried").getField("n_chars"))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": n_chars}
    return cut.select([own.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order and as often as the mix takes them."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their text, length bucket, batch and slot; text_hash tells which of the mixed texts of a doc_id a piece is from."""
    return packing.pack_documents(docs, texts=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trained models and hashed shuffles have no SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = persist(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
