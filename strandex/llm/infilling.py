"""Fill-in-middle examples, cut at units that a sparse checkpoint index finds.

A text is a sequence of units: its lines (each with its line feed, the last perhaps without).
Counting the units is one pass over blocks of the text's bytes; on its way it records, every
`every` units, a checkpoint: the byte and the code point at which the next unit begins. A cut after u units is
found by binary search among the checkpoints and a rescan of less than `every` units. So a
text costs its bytes once, a cut costs `every` lines, and the index is 24 bytes for `every` units.

Where a text is cut, and in which form it is written, is decided by a hash of its id, so that
reruns agree. Sentinels tell the parts of an example apart; a text that holds one itself stays plain,
and so does an empty one. As no part holds a sentinel, an example can be
turned back into its text (`restored_text`).

Each row is worked on alone: no shuffle, and a lost executor costs its unfinished tasks only.

Defined results: a null text counts as empty; a null doc_id is hashed as the text `null`; rows that repeat an id are
cut by the same hash, each in its own lines; a text without line feeds is one unit, so both of its cuts are
its ends; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.llm import _bytes as B

#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Units between two checkpoints.
EVERY = 64
#: Bytes that are counted at a time.
_BLOCK = 1 << 18
_FEED = 10


def _points(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes: those that continue none."""
    return len(data) - int(np.count_nonzero((data & 0xC0) == 0x80))


class UnitIndex:
    """Counts a text's lines and finds the byte and code point at which any of them ends."""

    def __init__(self, data: np.ndarray, every: int = EVERY):
        self.data, self.every = data, every
        units, points = 0, 0
        self.units, self.bytes, self.points = [0], [0], [0]
        for lo in range(0, len(data), _BLOCK):
            block = data[lo : lo + _BLOCK]
            ends = np.flatnonzero(block == _FEED) + 1
            marked = ends[every - 1 - units % every :: every]  # the ends of units number every, 2 * every, ...
            if len(marked):
                begins = np.cumsum((block & 0xC0) != 0x80)
                first = units - units % every + every
                self.units += range(first, first + every * len(marked), every)
                self.bytes += (lo + marked).tolist()
                self.points += (points + begins[marked - 1]).tolist()
            units += len(ends)
            points += _points(block)
        self.n = units + bool(len(data) and data[-1] != _FEED)
        self.n_points = points

    def cut(self, unit: int) -> tuple[int, int]:
        """(byte, code point) at which `unit` units have ended."""
        if unit >= self.n:
            return len(self.data), self.n_points
        at = int(np.searchsorted(self.units, unit, "right")) - 1
        byte, missing = self.bytes[at], unit - self.units[at]
        start = byte
        while missing:
            ends = np.flatnonzero(self.data[byte : byte + _BLOCK] == _FEED) + 1
            if len(ends) >= missing:
                byte, missing = byte + int(ends[missing - 1]), 0
            else:
                byte, missing = byte + _BLOCK, missing - len(ends)
        return byte, self.points[at] + _points(self.data[start:byte])


def _draws(seed: str, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def _example(text: bytes, doc_id: int | None, seed: str, fim_percent: int, spm_percent: int, sentinels: tuple[bytes, ...], every: int) -> tuple[int, str, int | None, int | None, bytes]:
    index = UnitIndex(np.frombuffer(text, np.uint8), every)
    one, two, rate, form = _draws(seed, doc_id)
    if not text or any(s in text for s in sentinels) or rate % 100 >= fim_percent:
        return index.n, "plain", None, None, text
    low, high = sorted((one % (index.n + 1), two % (index.n + 1)))
    (a, prefix_chars), (b, middle_end) = index.cut(low), index.cut(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = sentinels
    if form % 100 < spm_percent:
        return index.n, "spm", prefix_chars, middle_end - prefix_chars, b"".join((s, suffix, p, prefix, m, middle))
    return index.n, "psm", prefix_chars, middle_end - prefix_chars, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(
    docs: DataFrame, *, seed: str = "7", fim_percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output: the example of each document."""
    if every < 1 or len(set(sentinels)) < 3 or not all(s.startswith("<") and s.find(">") == len(s) - 1 and s.count("<") == 1 for s in sentinels):
        raise ValueError("every is 1 or more; sentinels are three different <names>, so that none overlaps another")
    marks = tuple(s.encode() for s in sentinels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.string_buffer(batch.column(1))
            ids = batch.column(0).to_pylist()
            for lo, hi in B.slices(offsets, 1 << 22):
                found = [_example(data[offsets[i] : offsets[i + 1]].tobytes(), ids[i], seed, fim_percent, spm_percent, marks, every) for i in range(lo, hi)]
                n, form, prefix, middle, output = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored_text(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an example was made from, from the example and its form alone."""
    parts = F.split(output, "|".join(sentinels), -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    joined = {name: F.concat(*(F.get(parts, F.lit(i)) for i in at)) for name, at in order.items()}
    return F.when(form == "psm", joined["psm"]).when(form == "spm", joined["spm"]).otherwise(output)
