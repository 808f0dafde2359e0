"""Indexing of texts as they arrive.

A micro-batch of new texts becomes a segment of an index, under the batch's own number: a rerun after a failure
replaces what the attempt left. Whenever `merge_at` segments have gathered they become one, which is named after the batch too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandex.sources.segments import SegmentedIndex


def index_stream(texts: DataFrame, base: str, checkpoint: str, block_rows: int = 1 << 18, merge_at: int = 16) -> StreamingQuery:
    """Start indexing a stream of texts (doc_id, enc) into a SegmentedIndex; it ends when all available input is done."""

    def write(batch: DataFrame, number: int) -> None:
        index = SegmentedIndex(batch.sparkSession, base, block_rows)
        if f"merged-{number:09d}" in index.names():  # an attempt that failed had come to its end
            return
        index.append(batch.select("doc_id", "enc"), f"batch-{number:09d}")
        if len(index.names()) >= merge_at:
            index.merge(f"merged-{number:09d}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
