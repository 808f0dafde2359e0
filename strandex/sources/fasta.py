"""FASTA and plain nucleotide files of any size, read by byte ranges.

A header reaches from a `>` to the end of its line, so lines are independent of each other, and Spark's line reader gives each
line to the split in which it begins. What a split cannot know is how many symbols come before
it: lines are numbered within their split, splits are known by file and first byte, and the
symbols before a line are the sum of those before its split and of those before it in its split. The symbols then meet in
parts of PART symbols, cut at multiples of PART, and no row ever holds more of a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandex.functions import encoding as E
from strandex.operators.suffix import KEY, PART
from strandex.sources.tables import materialise


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """name, split, line, symbols: the nucleotides of each line, encoded; split is the first byte of its byte range, line rises within it."""
    raw = spark.read.option("lineSep", "\n").text(path)
    body = F.regexp_replace(F.regexp_replace("value", "(?s)>.*", ""), "[^ACGT\\x00]", "")
    where = F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_block_start").alias("split")
    return raw.select(*where, F.monotonically_increasing_id().alias("line"), E.encode(body).alias("symbols"))


def fasta_parts(spark: SparkSession, path: str) -> DataFrame:
    """name, part, here: each file as one text, in numbered parts of PART symbols, the last with the terminator.

    A file without nucleotides is its terminator.
    """
    lines = materialise(fasta_lines(spark, path), "lines")
    size, nothing = F.length("symbols").cast("long"), F.lit(0).cast("long")
    inside = Window.partitionBy("name", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    within = lines.filter("symbols <> ''").withColumn("within", F.coalesce(F.sum(size).over(inside), nothing))
    sums = lines.groupBy("name", "split").agg(F.sum(size).alias("n"))
    # One row a byte range.
    earlier = Window.partitionBy("name").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("name", "split", F.coalesce(F.sum("n").over(earlier), nothing).alias("start"))
    placed = within.join(starts, ["name", "split"]).select("name", (F.col("start") + F.col("within")).alias("at"), "symbols")
    last = placed.groupBy("name").agg(F.max(F.struct("at", "symbols")).alias("l")).select("name", F.col("l.at").alias("at"), F.col("l.symbols").alias("symbols"))
    files = lines.select("name").distinct().join(last, "name", "left")
    end = files.select("name", F.coalesce(F.col("at") + F.length("symbols"), nothing).alias("at"), F.when(F.col("symbols").endswith("0"), F.lit("")).otherwise(F.lit("0")).alias("symbols"))
    # Blanks before a line's begin make its cuts fall on multiples of PART.
    every = placed.unionByName(end.filter("symbols <> ''"))
    filled = F.concat(F.repeat(F.lit(" "), F.pmod("at", F.lit(PART)).cast("int")), F.col("symbols"))
    pieces = every.select("name", "at", F.posexplode(F.regexp_extract_all(filled, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))).alias("i", "piece"))
    pieces = pieces.select("name", (F.floor(F.col("at") / PART) + F.col("i")).alias("part"), F.struct("at", F.ltrim("piece").alias("piece")).alias("p"))
    met = pieces.groupBy("name", "part").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return met.select("name", "part", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("here"))


def numbered_parts(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fasta_parts() -> doc_id, part, body (each part with the KEY symbols that follow), as an index takes them; and name, doc_id of the files."""
    rows = materialise(parts, "parts")
    # One row a file.
    names = materialise(rows.select("name").distinct().select("name", (F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("doc_id")), "names")
    own = rows.join(names, "name").select("doc_id", "part", "here")
    following = own.select("doc_id", (F.col("part") - 1).alias("part"), F.substring("here", 1, KEY).alias("next"))
    return own.join(following, ["doc_id", "part"], "left").select("doc_id", "part", F.concat("here", F.coalesce("next", F.lit(""))).alias("body")), names
