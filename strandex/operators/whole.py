"""Suffix arrays of texts that one task can hold: a row a text, sorted where the text is read.

A text of at most LOCAL symbols is sorted by numpy in the task that reads it, many texts at a time: first by as many symbols as
fit into 63 bits, then by doubling inside ties, as suffix.rank_rounds() does over tables. Nothing is shuffled or written, and
arrays for each d, Burrows-Wheeler sequences and common prefixes are narrow maps of these rows. Longer texts go
through the rounds of suffix.py.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.functions import encoding as E

#: Symbols of the longest text that is sorted in a task, and of the texts that are sorted together.
LOCAL, TOGETHER = 1 << 20, 1 << 19
#: Bytes of an Arrow batch, so that long texts do not meet in one.
BATCH_BYTES = 4 << 20


def _coded(texts: list[str]) -> tuple[np.ndarray, int]:
    """The symbols of all texts as numbers from 1 in code point order, and the bits that one takes."""
    joined = "".join(texts)
    if joined.isascii():
        points = np.frombuffer(joined.encode("ascii"), np.uint8)
        numbers = np.cumsum(np.bincount(points, minlength=128) > 0)
        return numbers[points].astype(np.int64), int(numbers[-1]).bit_length()
    kinds, points = np.unique(np.frombuffer(joined.encode("utf-32-le"), np.uint32), return_inverse=True)
    return points.astype(np.int64) + 1, len(kinds).bit_length()


def _ahead(values: np.ndarray, at: np.ndarray, ends: np.ndarray, none: int) -> np.ndarray:
    """values at the places, none where these lie beyond the end of their text."""
    return np.where(at < ends, values[np.minimum(at, len(values) - 1)], none)


def _bit_length(x: np.ndarray) -> np.ndarray:
    high = x >> 32
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp((x & 0xFFFFFFFF).astype(np.float64))[1])


def sorted_suffixes(texts: list[str], prefixes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Where each text begins (and the last one ends), the suffixes' places in order, text after text, and if asked for their common prefixes with those before."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    total = int(starts[-1])
    if not total:
        return starts, np.zeros(0, np.int32), np.zeros(0, np.int32) if prefixes else None
    symbols, bits = _coded(texts)
    sizes, place = np.diff(starts), np.arange(total)
    text, ends = np.repeat(np.arange(len(texts)), sizes), np.repeat(starts[1:], sizes)
    width, key, known = 63 // bits, symbols, 1
    while known < width:
        step = min(known, width - known)
        key, known = (key << bits * step) | (_ahead(key, place + known, ends, 0) >> bits * (known - step)), known + step
    order = np.lexsort((key, text))
    fresh = np.ones(total, bool)
    fresh[1:] = (text[order[1:]] != text[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
    slot, rank, h, levels = place, np.empty(total, np.int64), width, []
    rank[order] = np.maximum.accumulate(np.where(fresh, slot, 0))
    while not fresh.all():
        levels.append((h, rank.astype(np.int32))) if prefixes else None
        tied = ~(fresh & np.append(fresh[1:], True))
        slot = slot[tied]
        at = order[slot]
        following = _ahead(rank, at + h, ends[at], -1)
        own = rank[at]
        by = np.lexsort((following, own))
        at, own, following = at[by], own[by], following[by]
        order[slot] = at
        fresh = np.ones(len(slot), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (following[1:] != following[:-1])
        rank[at] = np.maximum.accumulate(np.where(fresh, slot, 0))
        h *= 2
    if not prefixes:
        return starts, order, None
    common, later = np.zeros(total, np.int64), place[1:][text[order[1:]] == text[order[:-1]]]
    one, two = order[later - 1], order[later]
    end, size = ends[two], np.zeros(len(later), np.int64)
    for h, ranks in reversed(levels):
        size += h * (_ahead(ranks, one + size, end, -1) == _ahead(ranks, two + size, end, -2))
    differ = _ahead(key, one + size, end, 0) ^ _ahead(key, two + size, end, 0)
    common[later] = size + (width * bits - _bit_length(differ)) // bits
    return starts, order, common


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are sorted together."""
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and held + n > TOGETHER:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def orders(texts: DataFrame, prefixes: bool = False) -> DataFrame:
    """doc_id, enc, sa and, if asked for, lcp: each text with its suffix array (positions in order) and the common prefixes of neighbours there."""
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = batch.column(1).to_pylist()
            for i, j in _groups([len(t) for t in plain]):
                starts, order, common = sorted_suffixes(plain[i:j], prefixes)
                offsets = pa.array(starts, pa.int32())
                lists = [order - np.repeat(starts[:-1], np.diff(starts)), *([common] if prefixes else [])]
                columns = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in lists]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "enc", "sa", *(["lcp"] if prefixes else [])])

    return texts.select("doc_id", "enc").mapInArrow(run, "doc_id long, enc string, sa array<int>" + ", lcp array<int>" * prefixes)


def places(d: int) -> Column:
    """Of a row of orders() the suffix array in units of d symbols; that for d is that of single symbols without the positions between."""
    E.check_d(d)
    return F.col("sa") if d == 1 else F.transform(F.filter("sa", lambda p: p % d == 0), lambda p: (p / d).cast("int"))


def array_of(ordered: DataFrame, d: int = 1) -> DataFrame:
    """orders() -> doc_id, sa_pos, pos: the suffix array in units of d symbols."""
    rows = ordered.select("doc_id", F.posexplode(places(d)).alias("sa_pos", "pos"))
    return rows.select("doc_id", F.col("sa_pos").cast("long").alias("sa_pos"), F.col("pos").cast("long").alias("pos"))


def _numbered(ordered: DataFrame, d: int) -> tuple[DataFrame, Column]:
    """Rows of orders() with what the column needs: the suffix array in units of d symbols as (pos, rev_bwt)."""
    numbers = F.transform(E.meta_symbols(F.col("enc"), d), lambda s: E.octal(F.reverse(s)))
    # Before a text's begin comes its end.
    before = lambda p: F.get("numbers", F.pmod(p - 1, F.size("numbers")))
    return ordered.select("doc_id", places(d).alias("places"), numbers.alias("numbers")), F.transform("places", lambda p: F.struct(p.cast("long").alias("pos"), before(p).alias("rev_bwt")))


def bwt_of(ordered: DataFrame, d: int = 1) -> DataFrame:
    """orders() -> doc_id, sa_pos, pos, rev_bwt, as suffix.bwt() has them: the octal number of the reversed symbol before each suffix, cyclic."""
    held, pairs = _numbered(ordered, d)
    # The pairs are made in the generator: as a column they would also be a filter's, and the numbers made anew for each place.
    rows = held.select("doc_id", F.posexplode(pairs).alias("sa_pos", "s"))
    return rows.select("doc_id", F.col("sa_pos").cast("long").alias("sa_pos"), "s.pos", "s.rev_bwt")


def bwt_rows(ordered: DataFrame, d: int) -> DataFrame:
    """rows: how many bwt_of() has, over all texts."""
    held, pairs = _numbered(ordered, d)
    return held.agg(F.sum(F.size(pairs)).alias("rows"))


def lcp_of(ordered: DataFrame) -> DataFrame:
    """orders(prefixes=True) -> doc_id, sa_pos, pos, lcp."""
    rows = ordered.select("doc_id", F.posexplode(F.arrays_zip("sa", "lcp")).alias("sa_pos", "s"))
    return rows.select("doc_id", F.col("sa_pos").cast("long").alias("sa_pos"), F.col("s.sa").cast("long").alias("pos"), F.col("s.lcp").cast("long").alias("lcp"))
