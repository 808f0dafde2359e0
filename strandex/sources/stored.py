"""A stored index: its tables are written once and read by every search."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.functions import encoding as E
from strandex.operators import fences, suffix, tree, wavelet, whole
from strandex.operators.rankselect import sequence_of
from strandex.sources.tables import finished, index_path, materialise, measured_joins, scratch, write_index


class StoredIndex:
    """The tables of an index in a folder that all executors share.

    texts (doc_id, enc, n), orders (doc_id, enc, sa: a row a text, with its suffix array), keys (doc_id, pos, key: the first 64 symbols of each suffix),
    and for each d suffixes: the array with the head of each suffix and the symbol before it. Ranks (doc_id, pos, rank), arrays (doc_id, sa_pos, pos), Burrows-Wheeler
    sequences and common prefixes are read from the orders; texts that are too long for these (whole.LOCAL) have their ranks stored. Over all texts together: blocks of the suffixes in one order, a directory each, the fences above them, parts
    of the texts, checkpoints of the symbols before the suffixes, and for each d the suffixes at multiples of d with a wavelet tree
over the symbols before them. Without texts, a folder is opened that has them; a table that it
    lacks, or whose writing did not end, is written when first asked for.

    An index of texts that are too long for a row is given their parts (doc_id, part, body) instead: it has parts, blocks, fences and
    checkpoints, and answers ranges, occurrences, first hits and backward search.
    """

    def __init__(self, spark: SparkSession, base: str, texts: DataFrame | None = None, block_rows: int = 1 << 18, parts: DataFrame | None = None):
        self.spark, self.base, self.block_rows, self._given, self._open, self._parts = spark, base, block_rows, texts, {}, parts
        self._rounds: tuple | None = None
        measured_joins(spark)

    def _stage(self, stage: str, d: int, build: Callable[[], DataFrame], sort: list[str], by: str | None = None) -> DataFrame:
        if (stage, d) not in self._open:
            path = index_path(self.base, stage, d)
            if not finished(self.spark, path):
                with scratch(self.spark):
                    write_index(build(), self.base, stage, d, sort, by)
            self._open[stage, d] = self.spark.read.parquet(path)
        return self._open[stage, d]

    def texts(self) -> DataFrame:
        def given() -> DataFrame:
            if self._given is None:
                raise ValueError(f"no index in {self.base}")
            return self._given.select("doc_id", "enc", F.length("enc").cast("long").alias("n"))

        return self._stage("text", 1, given, ["doc_id"])

    def keys(self) -> DataFrame:
        # In the order of the texts each key is the one before but for a symbol, and takes a few bytes.
        return self._stage("keys", 1, lambda: suffix.positions(self.texts(), suffix.KEY), [])

    def orders(self) -> DataFrame:
        """doc_id, enc, sa of the texts of at most whole.LOCAL symbols."""
        return self._stage("orders", 1, lambda: whole.orders(self.texts().filter(F.col("n") <= whole.LOCAL)), [])

    def _long(self) -> tuple[DataFrame, DataFrame] | None:
        """The texts of more symbols, and their ranks by rounds; None if there are none."""
        if self._rounds is None:
            over = self.texts().filter(F.col("n") > whole.LOCAL)
            self._rounds = () if over.isEmpty() else (over, self._stage("long-ranks", 1, lambda: suffix.rank_rounds(over)[0], ["doc_id", "rank"]))
        return self._rounds or None

    def ranks(self) -> DataFrame:
        return self.array().select("doc_id", "pos", F.col("sa_pos").alias("rank"))

    def ties(self) -> DataFrame:
        """h, doc_id, pos, rank: the suffixes that tie with others of their text in h symbols."""
        return self._stage("ties", 1, lambda: suffix.rank_rounds(self.texts(), keys=self.keys())[1], ["h", "doc_id", "pos"])

    def leaf_rows(self) -> DataFrame:
        """The leaves of the tree over each text, a row each, with what their tries are made of."""
        return self._stage("leaves", 1, lambda: tree.leaf_rows(self.array(), self.keys(), self.ties()), ["doc_id", "node_id"])

    def array(self, d: int = 1) -> DataFrame:
        """doc_id, sa_pos, pos: the suffix array of each text in units of d symbols."""
        found, long = whole.array_of(self.orders(), d), self._long()
        return found.unionByName(suffix.suffix_array(long[0], d, long[1])) if long else found

    def bwt(self, d: int = 1) -> DataFrame:
        """doc_id, sa_pos, pos, rev_bwt: the number of the reversed symbol before each suffix, cyclic."""
        found, long = whole.bwt_of(self.orders(), d), self._long()
        return found.unionByName(suffix.bwt(long[0], suffix.suffix_array(long[0], d, long[1]), d)) if long else found

    def sizes(self, ds: Iterable[int]) -> DataFrame:
        """d, stage, rows: the rows of the texts, arrays (sa) and Burrows-Wheeler sequences (bwt) for each d, which are made but not taken apart."""
        count = lambda table, d, stage, rows: table.agg(rows.alias("rows")).select(F.lit(d).cast("long").alias("d"), F.lit(stage).alias("stage"), "rows")
        parts, long = [], self._long()
        for d in ds:
            parts.append(count(self.texts(), d, "text", F.count("*")))
            parts.append(count(self.orders().select(whole.places(d).alias("sa")), d, "sa", F.sum(F.size("sa"))))
            parts.append(count(whole.bwt_rows(self.orders(), d), d, "bwt", F.sum("rows")))
            if long:
                array = suffix.suffix_array(long[0], d, long[1])
                parts += [count(array, d, "sa", F.count("*")), count(suffix.bwt(long[0], array, d), d, "bwt", F.count("*"))]
        return reduce(DataFrame.unionByName, parts).groupBy("d", "stage").agg(F.sum("rows").alias("rows")).filter("rows > 0")

    def lcp(self) -> DataFrame:
        """doc_id, sa_pos, pos, lcp: common prefix of each suffix with the one before."""
        found, long = whole.lcp_of(whole.orders(self.texts().filter(F.col("n") <= whole.LOCAL), prefixes=True)), self._long()
        if not long:
            return found
        ranks, ties = suffix.rank_rounds(long[0])
        return found.unionByName(suffix.lcp_array(suffix.suffix_array(long[0], 1, ranks), suffix.positions(long[0], suffix.KEY), ties))

    def suffixes(self, d: int) -> DataFrame:
        return self._stage("suffixes", d, lambda: suffix.suffix_heads(self.texts(), self.array(d), d), ["head"])

    def blocks(self) -> DataFrame:
        """block, sa_pos, doc_id, pos, key, before: all suffixes in one order, block_rows of them in a directory."""
        return self._stage("blocks", 1, self._blocks, ["sa_pos"], "block")

    def _blocks(self) -> DataFrame:
        if self._parts is None:
            return fences.blocks_of(suffix.positions(self.texts(), suffix.KEY, 1), fences.global_order(self.keys()), self.block_rows)
        keys = materialise(fences.part_positions(self.parts()), "part-keys")
        return fences.blocks_of(keys, fences.global_order(keys), self.block_rows)

    def fences(self) -> DataFrame:
        return self._stage("fences", 1, lambda: fences.fence_tree(self.blocks()), ["level", "node"])

    def parts(self) -> DataFrame:
        return self._stage("parts", 1, lambda: fences.parts_of(self.texts()) if self._parts is None else self._parts, ["doc_id", "part"])

    def checkpoints(self) -> DataFrame:
        return self._stage("checkpoints", 1, lambda: fences.checkpoints(self.blocks()), ["chunk"])

    def flags(self, d: int) -> DataFrame:
        """Bit strings: which suffixes of the order are at multiples of d."""
        return self._stage("flags", d, lambda: wavelet.sampled_flags(self.blocks(), d), ["block"])

    def grouped(self, d: int) -> DataFrame:
        """idx, doc_id, pos, val: these suffixes in order, and the number of the reversed symbol before each."""
        return self._stage("grouped", d, lambda: wavelet.grouped_sequence(self.texts(), self.blocks(), d), ["idx"])

    def _sequence(self, d: int) -> DataFrame:
        return self.grouped(d).select(F.lit(0).cast("long").alias("doc_id"), "idx", "val")

    def wavelet(self, d: int) -> DataFrame:
        """doc_id, level, node, block, bits, ones_before: the levels of the tree over these numbers."""
        return self._stage("wavelet", d, lambda: wavelet.wavelet_levels(self._sequence(d), 3 * d), ["level", "node", "block"])

    def select(self, d: int) -> DataFrame:
        """doc_id, level, node, place, idx: the way back from the tree's nodes of whole letters."""
        return self._stage("select", d, lambda: wavelet.select_places(self._sequence(d), 3 * d, [3 * k for k in range(1, d + 1)]), ["level", "node", "place"])

    def symbol_levels(self) -> DataFrame:
        """The wavelet tree over the symbols of each text."""
        return self._stage("symbol-levels", 1, lambda: wavelet.wavelet_levels(sequence_of(self.texts()), 3), ["doc_id", "level", "node", "block"])

    def symbol_places(self) -> DataFrame:
        """Where each symbol of each text stands, by its number among equal ones."""
        return self._stage("symbol-places", 1, lambda: wavelet.select_places(sequence_of(self.texts()), 3, [3]), ["doc_id", "node", "place"])

    # Searches of patterns (pattern_id, pattern)

    def ranges(self, patterns: DataFrame) -> DataFrame:
        """pattern_id, sa_lo, sa_hi: the places of each pattern in the order of all suffixes."""
        return fences.ranges(self.blocks(), self.block_rows, self.fences(), self.parts(), patterns)

    def at(self, ranges: DataFrame, *columns: str) -> DataFrame:
        """pattern_id, sa_pos, doc_id, pos and further columns of the blocks: the suffixes at the places of the ranges."""
        return fences.at_places(self.blocks(), self.block_rows, ranges, *columns)

    def occurrences(self, patterns: DataFrame) -> DataFrame:
        """pattern_id, doc_id, pos: every place of every pattern."""
        return self.at(self.ranges(patterns)).select("pattern_id", "doc_id", "pos")

    def first_hits(self, patterns: DataFrame) -> DataFrame:
        """pattern_id, sa_lo, sa_hi, doc_id, pos: the range and its first suffix (-1 where the pattern is absent)."""
        found = self.ranges(patterns)
        first = self.at(found.withColumn("sa_hi", F.least("sa_hi", F.col("sa_lo") + 1))).select("pattern_id", "doc_id", "pos")
        return found.join(first, "pattern_id", "left").fillna(-1, ["doc_id", "pos"])

    def backward_ranges(self, patterns: DataFrame) -> DataFrame:
        """ranges() by backward search."""
        return fences.backward_ranges(self.checkpoints(), patterns)

    def grouped_search(self, patterns: DataFrame, d: int) -> DataFrame:
        """pattern_id, doc_id, k, sa_pos, pos: occurrences through the wavelet tree of d-letter symbols."""
        return wavelet.grouped_search(self, patterns, d)
