"""Removal of repeated passages by seed and extend.

A window is `min_words` consecutive words. A window is a repeat if its words also start in a
document with a smaller doc_id; overlapping repeats form maximal repeated spans.

Seeds. Every window picks one anchor among its word 5-grams, the one with the least hash
(the last of equals). The choice depends on the window's words alone, so two equal windows
have equal anchors: joining on anchors loses nothing. Consecutive windows mostly pick the
same anchor, which leaves about one seed for five words.

Extension. A seed's context is all its windows put together: up to min_words - 5 words to
either side of the anchor.
1. Seeds with equal anchor and equal context repeat each other in all their windows; all
   but those of the smallest doc_id are repeats, without looking further.
2. An anchor that occurs with different contexts needs the single windows compared: for the
   first document of each context they are hashed, and each takes the smallest doc_id of
   its hash.
3. An anchor with one context only is done.

Skew. Equal seeds meet first inside an Arrow batch, where only the smallest doc_id goes
on; an anchor with more than `hot` contexts in a batch skips the shuffle by anchor (its
windows are compared by their own hashes) and leaves one marker there. So a batch sends a
bounded number of rows for any anchor, however common. Windows are joined to their
first documents by an equi-join that adaptive execution can split.

Equality is that of 64-bit word hashes; anchors, contexts and windows are compared by two
independent 64-bit hashes of these.

Defined results: null and empty texts have no words; a text shorter than a window has no
repeats; rows with null doc_id neither have nor cause repeats; rows that share a doc_id
are compared with smaller ids only, never with each other, and told apart by a 64-bit hash of their texts; other columns are kept or
ignored, as stated by each function.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandex.llm import _bytes as B
from strandex.llm._store import column, persist

K = 5
_U = B.U64
SEED, MARKER, REPEAT, COMPARE = 0, 1, 2, 3


def _pack(word: np.ndarray, text: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two longs: first word of the anchor (30 bits), words from the first and last window start to it (16 bits each), and the hash of the text (33 and 31 bits)."""
    bits = text.view(_U)
    return (word << 33) | (bits >> _U(31)).view(np.int64), (before << 47) | (after << 31) | (bits & _U(0x7FFFFFFF)).view(np.int64)


def _text_of(place: Column, reach: Column) -> Column:
    """The hash of the text that a seed is from."""
    return F.shiftleft(place, 31).bitwiseOR(reach.bitwiseAND(0x7FFFFFFF))


def _seed_of(place: Column, reach: Column, repeat: Column) -> Column:
    """One long: what is left once the text is known, and whether the seed is surely a repeat."""
    before, after = F.shiftright(reach, 47), F.shiftright(reach, 31).bitwiseAND(0xFFFF)
    word = F.shiftleft(F.shiftright(place, 33), 33)
    return word.bitwiseOR(F.shiftleft(before, 17)).bitwiseOR(F.shiftleft(after, 1)).bitwiseOR(repeat.cast("long"))


def _unpack(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, and whether surely repeated."""
    word = seed >> 33
    return word - ((seed >> 17) & 0xFFFF), word - ((seed >> 1) & 0xFFFF), (seed & 1).astype(bool)


def _seeds(items: np.ndarray, before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors picked by the windows of each row: anchor position, first and last window that picked it, hash."""
    grams = B.gram_hashes(items, K, 0)
    width = length - K + 1
    sizes = np.maximum(np.diff(before) - length + 1, 0)
    if not sizes.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, _U)
    # Sliding minimum over `width` grams by doubling; of equal hashes the last.
    best, at, span = grams, np.arange(len(grams)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        take = right <= left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        span += step
    first = np.concatenate([[0], np.cumsum(sizes)])
    windows = np.arange(first[-1]) + np.repeat(before[:-1] - first[:-1], sizes)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    picked = at[windows]
    new = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1]) | (rows[1:] != rows[:-1])]))
    last = np.append(new[1:], len(windows)) - 1
    return picked[new], windows[new], windows[last], grams[picked[new]]


def _context_hashes(items: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """A hash of words first .. last + length - 1 and of the anchor's place in them."""
    found = B.range_hashes(items, first, last + length)
    return B.mix(found ^ B.mix(((anchor - first) << 32 | (last - first)).astype(_U) + _U(1)))


def _find_seeds(ids: np.ndarray, texts: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int, hot: int) -> list[np.ndarray]:
    """Rows (kind, anchor, context, doc_id, place, reach) of one batch, equal seeds met."""
    found = []
    for lo, hi in B.slices(offsets):
        o = offsets[lo : hi + 1] - offsets[lo]
        part = data[offsets[lo] : offsets[hi]]
        at, to, before = B.words(part, o)
        items = B.run_hashes(part, at, to)
        anchor, first, last, hashes = _seeds(items, before, length)
        if not len(anchor):
            continue
        rows = np.searchsorted(before, first, "right") - 1
        place, reach = _pack(anchor - before[rows], texts[lo + rows], anchor - first, anchor - last)
        found.append((hashes.view(np.int64), _context_hashes(items, first, last, anchor, length).view(np.int64), ids[lo + rows], place, reach))
    if not found:
        return [np.zeros(0, np.int64)] * 6
    h, c, doc, place, reach = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((doc, c, h))
    h, c, doc, place, reach = h[order], c[order], doc[order], place[order], reach[order]
    new_anchor = np.concatenate([[True], h[1:] != h[:-1]])
    new_context = new_anchor | np.concatenate([[True], c[1:] != c[:-1]])
    smallest = doc[np.flatnonzero(new_context)][np.cumsum(new_context) - 1]
    kind = np.where(doc > smallest, REPEAT, SEED)
    group = np.cumsum(new_anchor) - 1
    contexts = np.bincount(group, new_context)
    kind[(kind == SEED) & (contexts[group] > hot)] = COMPARE
    bypass = kind >= REPEAT  # done with anchors: spread evenly
    marks = np.flatnonzero(new_anchor & (contexts[group] > hot))
    anchor = np.where(bypass, B.mix(place.view(_U) ^ doc.view(_U)).view(np.int64), h)
    none = np.zeros(len(marks), np.int64)
    own = ((kind, none + MARKER), (anchor, h[marks]), (np.where(bypass, 0, c), none), (doc, none), (place, none), (reach, none))
    return [np.concatenate(x) for x in own]


def _window_hashes(items: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows that start at the given words."""
    one, two = np.zeros(len(windows), _U), np.zeros(len(windows), _U)
    for j in range(length):
        item = items[windows + j]
        one = one * _U(0x9FB21C651E98DF25) + item
        two = (two ^ item) * _U(0xD1342543DE82EF95)
        two ^= two >> _U(29)
    return B.mix(one), B.mix(two)


def _covered(n: int, firsts: np.ndarray, lasts: np.ndarray, length: int) -> np.ndarray:
    """Which of n words the windows from each first to each last cover."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.clip(firsts, 0, n), 1)
    np.add.at(mark, np.clip(lasts + length, 0, n), -1)
    return np.cumsum(mark[:-1]) > 0


def _spans(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


class Outcome(NamedTuple):
    """Columns made from (text as bytes, spans) of each row, in place of text and spans."""

    schema: str
    types: list[pa.DataType]
    work: Callable[[bytes | None, list[dict]], tuple]


def repeated_spans(docs: DataFrame, *, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), hot: int = 4, outcome: Outcome | None = None) -> DataFrame:
    """One row a document: doc_id, text, n_words, spans (array of [begin, end) in words): its maximal repeated passages.

    carry: columns of docs to keep beside these, in a struct named carried.
    outcome: made where the spans are found, so that a text goes to one Python worker and
    not, with its spans, on to another; the columns are then those of kept_digest() or without_repeats().
    """
    if not K < min_words < 1 << 16:
        raise ValueError(f"min_words must be {K + 1} to 65535")
    length = min_words
    kept = [F.struct(*map(column, carry)).alias("carried")] if carry else []
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"), *kept)
    carried = texts.columns[3:]

    def seed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(whole.column(0).is_valid())
            for start in range(0, whole.num_rows, 2500):
                batch = whole.slice(start, 2500)
                columns = _find_seeds(batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), *B.string_buffer(batch.column(1)), length, hot)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int8)), *(pa.array(x) for x in columns[1:])], ["kind", "anchor", "context", "doc_id", "place", "reach"])

    seeds = texts.select("doc_id", "text", "text_hash").mapInArrow(seed, "kind byte, anchor long, context long, doc_id long, place long, reach long")
    by_anchor = Window.partitionBy("anchor")
    by_context = Window.partitionBy("anchor", "context")
    met = seeds.select(
        "kind", "doc_id", "place", "reach",
        F.min("doc_id").over(by_context).alias("first"),
        ((F.min("context").over(by_anchor) != F.max("context").over(by_anchor)) | (F.max((F.col("kind") == MARKER).cast("int")).over(by_anchor) == 1)).alias("several"),
    )
    repeat = (F.col("kind") == REPEAT) | ((F.col("kind") == SEED) & (F.col("first") < F.col("doc_id")))
    compare = (F.col("kind") == COMPARE) | ((F.col("kind") == SEED) & F.col("several"))
    open_seeds = met.filter((F.col("kind") != MARKER) & (repeat | compare)).select("doc_id", _text_of(F.col("place"), F.col("reach")).alias("text_hash"), _seed_of(F.col("place"), F.col("reach"), repeat).alias("seed"))
    # Rows that repeat id and text have the same seeds, each of which is met once.
    per_doc = persist(open_seeds.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.collect_list("seed")).alias("seeds")), "repeat-seeds")

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows that anchors with several contexts leave open, by their hashes."""
        for batch in _small(batches):
            before, items = _items(batch.column(2))
            found = []
            for i in range(batch.num_rows):
                first, last, known = _places(batch.column(3).slice(i, 1))
                size = (last - first + 1)[~known]
                starts = np.unique(np.repeat(first[~known] - np.cumsum(size) + size, size) + np.arange(size.sum()))
                found.append((np.full(len(starts), i), starts))
            rows, starts = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
            one, two = _window_hashes(items, before[rows] + starts, length)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(starts)], ["one", "two", "doc_id", "text_hash", "at"])

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All repeated windows of each text, as maximal spans."""
        for batch in _small(batches):
            counts, spans = np.diff(_items(batch.column(1), hashed=False)[0]), []
            for i in range(batch.num_rows):
                first, last, known = _places(batch.column(2).slice(i, 1))
                first, last = first[known], last[known]
                if batch.column(3)[i].is_valid:
                    at = batch.column(3).slice(i, 1).flatten().to_numpy(zero_copy_only=False)
                    first, last = np.concatenate([first, at]), np.concatenate([last, at])
                spans.append([{"begin": b, "end": e} for b, e in _spans(_covered(counts[i], first, last, length))] if len(first) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), *batch.columns[4:]], ["doc_id", "text", "n_words", "spans", *carried])

    # One plan, in which both joins read the same shuffle of the texts, and so need the same columns.
    known, row = texts.filter("doc_id is not null"), ["doc_id", "text_hash"]
    each = known.join(per_doc, row).select(*row, "text", "seeds", *carried).mapInArrow(ask, "one long, two long, doc_id long, text_hash long, at long")
    first = each.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(F.col("first") < F.col("last"))
    found = each.join(first, ["one", "two"]).filter(F.col("first") < F.col("doc_id"))
    more = found.groupBy(*row).agg(F.collect_set("at").alias("more"))
    rows = known.join(per_doc, row, "left").join(more, row, "left").select("doc_id", "text", "seeds", "more", *carried)
    rows = rows.unionByName(texts.drop("text_hash").filter("doc_id is null"), allowMissingColumns=True)
    span = T.ArrayType(T.StructType().add("begin", T.IntegerType()).add("end", T.IntegerType()))
    schema = T.StructType().add("doc_id", T.LongType()).add("text", T.StringType()).add("n_words", T.LongType()).add("spans", span)
    full = T.StructType([*schema.fields, *(texts.schema[c] for c in carried)])
    if outcome is None:
        return rows.mapInArrow(close, full)
    made = _made(outcome, full)
    return rows.mapInArrow(lambda batches: _apply(close(batches), outcome, made.fieldNames()), made)


def _small(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            yield whole.slice(start, rows)


def _items(texts: pa.Array, hashed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Words before each row, and word hashes, of a batch, slice by slice."""
    data, offsets = B.string_buffer(texts)
    counts, items = [np.zeros(1, np.int64)], []
    total = 0
    for lo, hi in B.slices(offsets):
        o = offsets[lo : hi + 1] - offsets[lo]
        part = data[offsets[lo] : offsets[hi]]
        at, to, before = B.words(part, o)
        counts.append(before[1:] + total)
        total += before[-1]
        if hashed:
            items.append(B.run_hashes(part, at, to))
    return np.concatenate(counts), np.concatenate(items) if items else np.zeros(0, _U)


def _places(seeds: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window and whether surely repeated, of one row's seeds."""
    return _unpack(seeds.flatten().to_numpy(zero_copy_only=False).astype(np.int64))


def _made(outcome: Outcome, spans: T.StructType) -> T.StructType:
    """The columns of an outcome; doc_id, n_words and what was carried stay."""
    return T.StructType([*T.StructType.fromDDL(f"doc_id long, n_words long, {outcome.schema}").fields, *spans.fields[4:]])


def _apply(batches: Iterable[pa.RecordBatch], outcome: Outcome, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        found = [outcome.work(x, s) for x, s in zip(texts, batch.column(3).to_pylist())]
        columns = list(zip(*found)) or [() for _ in outcome.types]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(columns, outcome.types)), *batch.columns[4:]], names)


def _per_row(spans: DataFrame, outcome: Outcome) -> DataFrame:
    made = _made(outcome, spans.schema)
    return spans.mapInArrow(lambda batches: _apply(batches, outcome, made.fieldNames()), made)


def _digest(text: bytes | None, found: list[dict]) -> tuple[int, str]:
    words = (text or b"").split()
    kept, at = [], 0
    for s in found:
        kept += words[at : s["begin"]]
        at = s["end"]
    kept += words[at:]
    return len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _cut(text: bytes | None, found: list[dict]) -> tuple[int, str | None]:
    if not found:
        return 0, None if text is None else text.decode()
    data = np.frombuffer(text, np.uint8)
    at, to, _ = B.words(data, np.array([0, len(data)]))
    kept, done = [], 0
    for s in found:
        kept.append(text[done : at[s["begin"]]])
        done = to[s["end"] - 1]
    kept.append(text[done:])
    return sum(s["end"] - s["begin"] for s in found), b"".join(kept).decode()


KEPT_DIGEST = Outcome("n_removed long, kept_sha256 string", [pa.int64(), pa.string()], _digest)
WITHOUT_REPEATS = Outcome("n_removed long, text string", [pa.int64(), pa.string()], _cut)


def kept_digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by single spaces."""
    return _per_row(spans, KEPT_DIGEST)


def without_repeats(spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and text: the text without its repeated passages.

    Texts without repeats stay as they are, null too; elsewhere the passages' bytes, from their first
    word to their last, are cut out, and the white space around them stays.
    """
    return _per_row(spans, WITHOUT_REPEATS)
