"""An index that grows: segments that are searched together and merged.

Each batch of new texts is an index of its own in the stored layout, a segment. The suffixes that
are smaller than a pattern are those of all segments added up, and so are its places; a search asks
every segment and adds. merge() writes the texts of all segments as one and drops them, so that their number
stays small. A segment counts from when its texts were written to their end (its other tables are made from these when they are first
asked for, if a failure left them out), and a merged segment names those that it stands for, so that a failure at any point leaves each text in
exactly one segment that counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.sources.stored import StoredIndex
from strandex.sources.tables import children, delete, finished


class SegmentedIndex:
    """The segments in a folder that all executors share: base/segment=<name>."""

    def __init__(self, spark: SparkSession, base: str, block_rows: int = 1 << 18):
        self.spark, self.base, self.block_rows = spark, base.rstrip("/"), block_rows

    def _path(self, name: str) -> str:
        return f"{self.base}/segment={name}"

    def _merged(self, name: str) -> set[str]:
        path = f"{self._path(name)}/merged"
        return {r.name for r in self.spark.read.parquet(path).collect()} if finished(self.spark, path) else set()

    def names(self) -> list[str]:
        """The segments that count: those whose texts are whole, without those that another one has taken in."""
        found = [c.removeprefix("segment=") for c in children(self.spark, self.base) if c.startswith("segment=")]
        whole = [n for n in found if finished(self.spark, f"{self._path(n)}/stage=text/d=1")]
        gone = set().union(*(self._merged(n) for n in whole))
        return sorted(n for n in whole if n not in gone)

    def segments(self) -> list[StoredIndex]:
        return [StoredIndex(self.spark, self._path(n), block_rows=self.block_rows) for n in self.names()]

    def append(self, texts: DataFrame, name: str) -> None:
        """Index texts (doc_id, enc) as a segment; one of that name, as of an attempt that failed, is replaced."""
        delete(self.spark, self._path(name))
        self._write(texts, name)

    def _write(self, texts: DataFrame, name: str) -> None:
        segment = StoredIndex(self.spark, self._path(name), texts, self.block_rows)
        for stage in (segment.texts, segment.fences, segment.parts):
            stage()

    def merge(self, name: str) -> None:
        """One segment of that name in place of all that there are."""
        old = self.names()
        if len(old) < 2 or name in old:
            return
        delete(self.spark, self._path(name))
        texts = reduce(DataFrame.unionByName, (s.texts() for s in self.segments()))
        # Named first: from the moment its texts are whole the new segment stands for the old ones.
        self.spark.createDataFrame([(n,) for n in old], "name string").write.parquet(f"{self._path(name)}/merged")
        self._write(texts, name)
        for n in old:
            delete(self.spark, self._path(n))

    def ranges(self, patterns: DataFrame) -> DataFrame:
        """pattern_id, sa_lo, sa_hi: the suffixes of all segments below each pattern, and those and its places."""
        each = reduce(DataFrame.unionByName, (s.ranges(patterns) for s in self.segments()))
        return each.groupBy("pattern_id").agg(F.sum("sa_lo").alias("sa_lo"), F.sum("sa_hi").alias("sa_hi"))

    def occurrences(self, patterns: DataFrame) -> DataFrame:
        """pattern_id, doc_id, pos: every place of every pattern in all segments."""
        return reduce(DataFrame.unionByName, (s.occurrences(patterns) for s in self.segments()))
