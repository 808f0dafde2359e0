"""Packing by optimal length buckets.

A document longer than `context` tokens is cut into whole pieces of that length and a rest, so
that lengths lie in 1..context and their global histogram has at most `context` rows, however
many documents there are. Dynamic programming over the histogram chooses `buckets` upper
bounds that minimise all padding; a piece goes into the lowest bucket that holds it.
Inside a bucket, pieces in shuffled order fill batches of at most `batch_tokens` padded
tokens, that is floor(batch_tokens / bound) pieces each.

Numbers inside a bucket come from sums over hash slices, so that a bucket with most of
the corpus is not one task.

Defined results: documents without tokens (null or empty texts) make no piece; repeated rows
are packed each, in slots of their own; a batch holds one piece at least; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.llm._prefix import running_sum, shuffle_key, with_row_numbers
from strandex.llm._store import persist
from strandex.llm.mixing import WORD, word_count

#: A word with the white space behind it, the first of a text also with that before it.
UNIT = rf"\A[\x20\x09-\x0D]*{WORD}[\x20\x09-\x0D]*|{WORD}[\x20\x09-\x0D]*"


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper bounds of at most `buckets` buckets with the least total padding.

    best[k][j] = min over i of best[k-1][i] + padding of lengths i..j under length j;
    the minimising i never falls as j grows, so each layer is solved by halving.
    """
    n = len(lengths)
    if not n:
        return []
    c, t = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = lengths * c[1:] - t[1:]
    choice = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, came = np.empty(n, np.int64), np.empty(n, np.int64)
        before = np.concatenate([[0], best])
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(j, last) + 1)
            cost = before[i] + lengths[j] * (c[j + 1] - c[i]) - (t[j + 1] - t[i])
            at = int(np.argmin(cost))
            new[j], came[j] = cost[at], i[at]
            todo += [(lo, j - 1, first, int(i[at])), (j + 1, hi, int(i[at]), last)]
        best = new
        choice.append(came)
    bounds, j = [], n - 1
    for came in reversed(choice):
        bounds.append(int(lengths[j]))
        j = int(came[j]) - 1
        if j < 0:
            break
    return sorted(bounds)


def piece_texts(units: Column, n_tokens: Column, text: Column, context: int) -> Column:
    """The texts of a document's pieces, given its words with the white space around them; put together they are the text."""
    part = lambda i: F.array_join(F.slice(units, (i * context + 1).cast("int"), F.lit(context)), "")
    several = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((n_tokens - 1) / context)), part)
    return F.when(n_tokens > context, several).otherwise(F.array(text))


def pack_pieces(
    sizes: DataFrame, *, also: tuple[str, ...] = (), parts: str | None = None, context: int = 2048, buckets: int = 16, batch_tokens: int = 65536, seed: str = "pack"
) -> DataFrame:
    """sizes (doc_id, n_tokens) -> doc_id, piece, begin, n_tokens, bucket, batch, slot, and the columns `also` of sizes.

    begin is the piece's first token in its document, bucket the padded length, batch a number
    from 0 within the bucket and slot the place in the batch. `parts` names a column of sizes with the texts of a
    document's pieces; each piece then comes with its text. Only their numbers go through the
    windows; the texts are shuffled once, to meet them.
    """
    carried = () if parts is None else (F.col(parts).alias("parts"),)
    docs = with_row_numbers(sizes.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), *also, *carried).filter(F.col("n_tokens") > 0), "row")
    docs = persist(docs.withColumn("key", shuffle_key(seed, "doc_id")), "pack-sizes")
    pieces = docs.drop("parts").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / context))))
    pieces = pieces.withColumn("begin", F.col("piece") * context).withColumn("length", F.least(F.lit(context), F.col("n_tokens") - F.col("begin")).cast("long"))
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `context` rows
    digits = max(3, math.ceil(math.log(max(1, sum(r["n"] for r in histogram) / 50_000), 16)))
    table = sorted((r["length"], r["n"]) for r in histogram)
    bounds = optimal_bounds(np.array([x for x, _ in table], np.int64), np.array([n for _, n in table], np.int64), buckets)
    rising = F.lit(bounds).cast("array<long>") if bounds else F.lit([context]).cast("array<long>")
    placed = pieces.withColumn("bucket", F.filter(rising, lambda b: b >= F.col("length"))[0]).withColumn("one", F.lit(1).cast("long"))
    # The slices must cut a bucket evenly; the pieces of one document share its hash but for their number.
    placed = placed.withColumn("key", F.md5(F.concat_ws(":", "key", "row", "piece").cast("binary")))
    numbered = running_sum(placed.withColumn("slice", F.substring("key", 1, digits)), "bucket", ["key", "doc_id", "n_tokens", "row", "piece"], "one", name="nth")
    if parts is not None:
        texts = docs.select(F.col("row").alias("_row"), F.posexplode("parts").alias("_piece", "text"))
        numbered = numbered.join(texts, (F.col("row") == F.col("_row")) & (F.col("piece") == F.col("_piece")))
        also = (*also, "text")
    room = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("bucket")))
    return numbered.select(
        "doc_id", "piece", "begin", F.col("length").alias("n_tokens"), "bucket", F.floor(F.col("nth") / room).cast("long").alias("batch"), (F.col("nth") % room).cast("long").alias("slot"), *also
    )


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, context: int = 2048, **options) -> DataFrame:
    """pack_pieces over the words of each text, with text_hash: the piece is words begin to begin + n_tokens of the text with that hash.

    With `texts` each piece has its own text too, white space and all.
    """
    text = F.col(text_col)
    sizes = docs.select(F.col(id_col).alias("doc_id"), word_count(text).alias("n_tokens"), F.xxhash64(text_col).alias("text_hash"), *([text.alias("whole")] if texts else []))
    if not texts:
        return pack_pieces(sizes, also=("text_hash",), context=context, **options)
    units = F.when(F.col("n_tokens") > context, F.regexp_extract_all("whole", F.lit(UNIT), F.lit(0)))
    # A generator keeps the words a column: inside the pieces they would be cut anew for every piece.
    cut = sizes.withColumn("units", F.explode(F.array(units)))
    cut = cut.withColumn("parts", piece_texts(F.col("units"), F.col("n_tokens"), F.col("whole"), context))
    return pack_pieces(cut.drop("units", "whole"), also=("text_hash",), parts="parts", context=context, **options)
