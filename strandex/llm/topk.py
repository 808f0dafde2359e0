"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers. A block of rows is indexed by dimension and bit: one
bitmap over the rows for each bit of (value - the block's least value). A query's scores
over the block are built by bitmap arithmetic alone: from the highest bit of the query's
components down, the running sum is doubled (its slices move up one place) and the slices of
every dimension with that bit set are added by full adders; a negative component adds
the complement. Every operation works on a batch of queries at a time. The best rows are
then selected from the most significant slice downward, with a set of rows that are surely in
and a set that still ties; the boundary rows left at the end have equal scores and are
resolved by the smaller id.

A block of rows, of bounded size, is shuffled once and indexed once; groups of queries, of bounded
size too, follow it into its task. What leaves a task is k rows a query.

Defined results: vectors that are null or hold null or non-finite components, and rows
without id, take no part; rows that repeat an id are rows of their own: each is a candidate, and each of a query id asks, for
every row but itself, so that such an id has its ranks once for each of its rows; only
vectors of one length are compared; ties go to the smaller id; a component whose quantised value needs more than
62 bits, or a score that needs more than 64, is an error; with fewer than k candidates all are returned; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.llm._store import persist

_U = np.uint64


def quantise(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """id and the integers floor(scale * x) of each row, without the vectors that take no part."""
    x = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = rows.filter(F.col("id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
    value = F.transform("v", lambda e: F.floor(F.lit(float(scale)) * e))
    small = F.forall("v", lambda e: F.abs(e) < F.lit(float(1 << 62) / scale))
    checked = F.when(small, value.cast("array<long>")).otherwise(F.raise_error(F.lit("a quantised component needs more than 62 bits")).cast("array<long>"))
    return fine.select("id", checked.alias("v"))


class SlicedBlock:
    """The bitmaps of one block of rows; rows are in ascending order of id, and of their own number."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, values: np.ndarray):
        order = np.lexsort((own, ids))
        self.ids, self.own, self.values = ids[order], own[order], values[order].astype(np.int64)
        self.place = {int(x): i for i, x in enumerate(self.own)}
        n, self.dims = self.values.shape
        self.low = self.values.min(0) if n else np.zeros(self.dims, np.int64)
        raised = self.values - self.low
        self.words = max(1, -(-n // 64))
        self.slices: list[np.ndarray] = []
        for d in range(self.dims):
            bits = int(raised[:, d].max()).bit_length() if n else 0
            plane = np.zeros((bits, self.words * 64), np.uint8)
            plane[:, :n] = (raised[:, d] >> np.arange(bits)[:, None]) & 1
            self.slices.append(np.packbits(plane, axis=1, bitorder="little").view(_U))
        inside = np.zeros(self.words * 64, np.uint8)
        inside[:n] = 1
        self.rows = np.packbits(inside, bitorder="little").view(_U)

    def scores(self, queries: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of each query's score over the rows, up to a constant for each query."""
        size, negative = np.abs(queries), np.where(queries < 0, ~_U(0), _U(0))
        shape = (len(queries), self.words)
        total: list[np.ndarray] = []
        bound = 0  # no running sum is above it
        for j in range(int(size.max()).bit_length() - 1 if size.size else -1, -1, -1):
            if total:
                total.insert(0, np.zeros(shape, _U))
            bound *= 2
            for d in range(self.dims):
                here = ((size[:, d] >> j) & 1).astype(bool)
                slices = self.slices[d]
                if not here.any() or not len(slices):
                    continue
                bound += (1 << len(slices)) - 1
                while len(total) < bound.bit_length():
                    total.append(np.zeros(shape, _U))
                use, flip = np.where(here, ~_U(0), _U(0))[:, None], negative[:, d][:, None]
                carry = None
                for i, plane in enumerate(slices):
                    b = (plane ^ flip) & use
                    a = total[i]
                    if carry is None:
                        total[i], carry = a ^ b, a & b
                    else:
                        half = a ^ b
                        total[i] = half ^ carry
                        b &= a
                        half &= carry
                        b |= half
                        carry = b
                for i in range(len(slices), len(total)):
                    a = total[i]
                    total[i] = a ^ carry
                    carry = a & carry
                    if not carry.any():
                        break
        return total

    def top(self, query_rows: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(number of the query's row, vec_id, score) of the k best rows of each query, but for the query's own row."""
        total = self.scores(queries)
        q = len(queries)
        sure = np.zeros((q, self.words), _U)
        tie = np.repeat(self.rows[None, :], q, 0)
        for i in range(q):
            row = self.place.get(int(query_rows[i]))
            if row is not None:
                tie[i, row // 64] &= ~(_U(1) << _U(row % 64))
        for plane in reversed(total):
            ones = tie & plane
            some = sure | ones
            enough = np.bitwise_count(some).sum(1) > k
            sure = np.where(enough[:, None], sure, some)
            tie = np.where(enough[:, None], ones, tie & ~plane)
        for i in range(q):
            first = np.flatnonzero(np.unpackbits(sure[i].view(np.uint8), bitorder="little"))
            rest = np.flatnonzero(np.unpackbits(tie[i].view(np.uint8), bitorder="little"))
            for row in np.concatenate([first, rest[: max(0, k - len(first))]]):
                yield int(query_rows[i]), int(self.ids[row]), sum(int(x) * int(y) for x, y in zip(self.values[row], queries[i]))


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, block_rows: int = 8192, query_rows: int = 1024, batch: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query against all other rows.

    is_query is a condition over `id`. Rows are dealt into blocks and queries into
    groups by hash; a group is copied to each block.
    """
    rows = persist(quantise(vectors, id_col=id_col, vector_col=vector_col, scale=scale).withColumn("own", F.monotonically_increasing_id()), "quantised")
    size = rows.agg(F.count("id").alias("n"), F.sum(is_query.cast("long")).alias("q")).first()
    blocks, groups = max(1, -(-size["n"] // block_rows)), max(1, -(-(size["q"] or 0) // query_rows))
    keyed = rows.select(F.size("v").alias("dims"), "id", "own", "v")
    members = F.collect_list(F.struct("id", "own", "v")).alias("members")
    placed = keyed.withColumn("block", F.pmod(F.xxhash64("own"), F.lit(blocks))).groupBy("dims", "block").agg(members)
    asked = keyed.filter(is_query).withColumn("grp", F.pmod(F.xxhash64("own", F.lit(1)), F.lit(groups)).cast("int")).groupBy("dims", "grp").agg(members)
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    both = placed.select("dims", "block", F.lit(0).alias("turn"), "members").unionAll(asked.select("dims", "block", F.lit(1).alias("turn"), "members"))
    # A block comes before the queries that are put to it.
    dealt = both.repartition("dims", "block").sortWithinPartitions("dims", "block", "turn").select("dims", "block", "turn", "members")

    def table(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = column.flatten()
        ids, own = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("id", "own"))
        return ids, own, flat.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, index = None, None
        for part in batches:
            for i in range(part.num_rows):
                here = part.column(0)[i].as_py(), part.column(1)[i].as_py()
                ids, own, values = table(part.column(3).slice(i, 1))
                if part.column(2)[i].as_py() == 0:
                    place, index = here, SlicedBlock(ids, own, values)
                    continue
                if here != place:  # no rows in this block
                    continue
                for lo in range(0, len(ids), batch):
                    found = list(index.top(own[lo : lo + batch], values[lo : lo + batch].astype(np.int64), k))
                    columns = list(zip(*found)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["asks", "vec_id", "score"])

    best = dealt.mapInArrow(run, "asks long, vec_id long, score long")
    order = Window.partitionBy("asks").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = rows.filter(is_query).select(F.col("own").alias("asks"), F.col("id").alias("query_id"))
    return ranked.join(names, "asks").select("query_id", "rank", "vec_id", "score")
