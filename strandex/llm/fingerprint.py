"""Similarity digests from statistically improbable byte windows.

Every window of 16 bytes gets the entropy of its bytes, put into one of 1001 classes.
Over all documents the classes are counted; the rarer a window's class, the better it
ranks. In each run of 16 neighbouring windows the best one (the first of equals) scores a
point, and windows with at least 4 points are the text's features. A stretch of 32 bytes or more that no
feature covers (any in a text without features), as in repetitive text, has its 6-byte windows as
features, or its whole if it is shorter. All of this is the same at every length, so a text and its beginning share
their features. Features, in text order and each once, go into a chain of Bloom filters of 2048 bits, 160 features and 5 bits a feature to a filter.

Two chains are compared filter by filter: the bits two filters share, less what chance
gives, are set against the most they could share; each filter of the shorter chain takes
its best partner, and the mean of these is the likeness, 0 to 1.

Defined results: null and empty texts have the fingerprint '0:' and are like each other (1)
and unlike everything else (0). Neighbours are found in the order of (doc_id, text), null
first, so repeated ids are neighbours of each other. A lone document follows itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.llm import _bytes as B

BITS, FEATURES, HASHES, CLASSES, SHORT = 2048, 160, 5, 1001, 6
#: Bytes of a window, windows of a run, points of a feature, and the bytes without feature that get 6-byte windows.
WINDOW, RUN, POINTS, STRETCH = 16, 16, 4, 32
#: Classes below this are runs of few symbols; they are no features.
WEAK = 100


def entropy_classes(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The entropy class of every window of the buffer, by rolling counts."""
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    share = np.arange(window + 1) / window
    part = np.rint(-share * np.log2(np.where(share > 0, share, 1)) * 1e6).astype(np.int64)
    remove, add = np.concatenate([[0], part[:-1] - part[1:]]), np.append(part[1:] - part[:-1], 0)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for lag in range(1, window):  # equal bytes among those before and those after each byte in its window
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    total = np.empty(n, np.int64)
    total[0] = part[np.bincount(data[:window], minlength=256)].sum()
    np.cumsum(remove[after[: n - 1] + 1] + add[before[window : window + n - 1]], out=total[1:])
    total[1:] += total[0]
    return total * (CLASSES - 1) // round(1e6 * np.log2(window))


def _parts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    return B.slices(offsets, 1 << 18)


def class_counts(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """How many windows of all documents fall into each class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            data, offsets = B.string_buffer(batch.column(0))
            for lo, hi in _parts(offsets):
                o = offsets[lo : hi + 1]
                found = entropy_classes(data[o[0] : o[-1]])
                total += np.bincount(found[_inside(o - o[0], WINDOW)], minlength=CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["class", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()  # at most 1001
    out = np.zeros(CLASSES, np.int64)
    for r in rows:
        out[r["class"]] = r["n"]
    return out


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each class, the rarest first; weak classes last."""
    order = np.lexsort((np.arange(CLASSES), counts, np.arange(CLASSES) < WEAK))
    ranks = np.empty(CLASSES, np.int64)
    ranks[order] = np.arange(CLASSES)
    return ranks


def _inside(offsets: np.ndarray, span: int) -> np.ndarray:
    """Positions of the buffer at which span bytes of one row begin."""
    size = np.maximum(np.diff(offsets) - span + 1, 0)
    first = np.concatenate([[0], np.cumsum(size)])
    return np.arange(first[-1]) + np.repeat(offsets[:-1] - first[:-1], size)


def _improbable(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Starts of the popular windows."""
    position = (1 << 40) - 1
    groups = _inside(offsets, WINDOW + RUN - 1)
    if not len(groups):
        return groups
    classes = entropy_classes(data)
    best = (ranks[classes] << 40) | np.arange(len(classes))
    step = 1
    while step < RUN:  # the best of 2, 4, ... neighbours, the first of equals
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    chosen = best[groups]
    edge = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    points = np.diff(np.append(edge, len(chosen)))
    return (chosen[edge] & position)[(points >= POINTS) & (chosen[edge] >> 40 < CLASSES - WEAK)]


def _bare(offsets: np.ndarray, start: np.ndarray, end: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """6-byte windows, or whole stretches that are shorter, in the stretches that no feature covers and that have at least least[row] bytes."""
    size = offsets[-1]
    none = np.zeros(0, np.int64)
    if not size:
        return none, none
    depth = np.cumsum(np.bincount(start, minlength=size + 1) - np.bincount(end, minlength=size + 1))[:size]
    row = np.repeat(np.arange(len(least)), np.diff(offsets))
    cuts = np.flatnonzero(((depth[1:] == 0) != (depth[:-1] == 0)) | (row[1:] != row[:-1])) + 1
    begin, stop = np.concatenate([[0], cuts]), np.append(cuts, size)
    wanted = (depth[begin] == 0) & (stop - begin >= least[row[begin]])
    begin, stop = begin[wanted], stop[wanted]
    count = np.maximum(stop - begin - SHORT + 1, 1)
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) + np.repeat(begin - first[:-1], count)
    return at, np.minimum(at + SHORT, np.repeat(stop, count))


def digests(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    """The filter chain of each row: an array of filters by 256 bytes."""
    out: list[np.ndarray] = []
    for lo, hi in _parts(offsets):
        o = offsets[lo : hi + 1]
        out += _digests(data[o[0] : o[-1]], o - o[0], ranks)
    return out


def _digests(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    start = _improbable(data, offsets, ranks)
    end = start + WINDOW
    known = np.bincount(np.searchsorted(offsets, start, "right") - 1, minlength=n)
    bare, bare_end = _bare(offsets, start, end, np.where(known == 0, 1, STRETCH))
    start, end = np.concatenate([start, bare]), np.concatenate([end, bare_end])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    rows = np.searchsorted(offsets, start, "right") - 1
    hashes = B.run_hashes(data, start, end)
    # Each feature once a row, at its first place.
    order = np.lexsort((hashes, rows))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    first = np.sort(order[new])
    rows, hashes = rows[first], hashes[first]
    count = np.bincount(rows, minlength=n)
    filters = -(-count // FEATURES)
    base = np.concatenate([[0], np.cumsum(filters)])
    nth = np.arange(len(rows)) - np.concatenate([[0], np.cumsum(count)])[rows]
    flat = np.zeros((base[-1], BITS), bool)
    for h in range(HASHES):
        flat[base[rows] + nth // FEATURES, (hashes >> B.U64(11 * h)).astype(np.int64) & (BITS - 1)] = True
    packed = np.packbits(flat, axis=1)
    return [packed[base[i] : base[i + 1]] for i in range(n)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the shorter chain of each filter's best normalised overlap."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    x, y = a.view(np.uint64), b.view(np.uint64)
    nx, ny = np.bitwise_count(x).sum(1).astype(float), np.bitwise_count(y).sum(1).astype(float)
    best = []
    for i in range(len(a)):
        shared = np.bitwise_count(x[i] & y).sum(1).astype(float)
        most = np.minimum(nx[i], ny)
        chance = nx[i] * ny / BITS
        floor = chance + 0.1 * (most - chance)
        best.append(np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1).max())
    return float(np.mean(best))


def text_of(chain: np.ndarray) -> str:
    """The printed fingerprint: number of filters and their bytes in base 64."""
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def with_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 4000, most_ranges: int = 10_000) -> DataFrame:
    """Rows (bucket, context, doc_id, text) so that in each bucket, sorted, every row follows its predecessor.

    Buckets are doc_id ranges between existing ids, at most most_ranges of them. The last row of each range, whose
    id is the range's bound, is sent to the following range too, as context; the
    greatest id is the context of the first. One shuffle, no row is held for another.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = rows.count()
    parts = int(min(max(1, n // rows_per_range), most_ranges))
    probe = [i / parts for i in range(1, parts)] or [0.5]
    got = rows.select("doc_id").agg(F.percentile_approx("doc_id", probe, 10 * max(1000, parts)).alias("q"), F.max("doc_id").alias("top")).first()
    top = got["top"]
    bounds = np.array(sorted(x for x in set(got["q"] or []) if x != top), np.int64)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            value = ids.fill_null(0).to_numpy(zero_copy_only=False)
            bucket = np.where(known, np.searchsorted(bounds, value, "left"), 0)
            hit = np.searchsorted(bounds, value, "left")
            bound = known & (hit < len(bounds)) & (bounds[np.minimum(hit, len(bounds) - 1)] == value) if len(bounds) else np.zeros(len(value), bool)
            last = known & (value == top) if top is not None else ~known
            for mask, where in ((None, bucket), (bound, bucket + 1), (last, np.zeros_like(bucket))):
                part = batch if mask is None else batch.filter(pa.array(mask))
                if part.num_rows:
                    where = where if mask is None else where[mask]
                    yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int64)), pa.array(np.full(part.num_rows, int(mask is None), np.int32)), part.column(0), part.column(1)], ["bucket", "own", "doc_id", "text"])

    return rows.mapInArrow(deal, "bucket long, own int, doc_id long, text string").repartition("bucket").sortWithinPartitions("bucket", "own", "doc_id", "text")


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counts: np.ndarray | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness to that and to the next document.

    The edited text has its last third replaced by the beginning of the next
    document in descending doc_id.
    """
    counts = class_counts(docs, text_col=text_col) if counts is None else counts
    ranks = rarity_ranks(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before_text, before_chain = "", np.zeros((0, BITS // 8), np.uint8)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                own = np.asarray(part.column(1).to_numpy(zero_copy_only=False))
                texts = [x or "" for x in part.column(3).to_pylist()]
                chains = digests(*B.string_buffer(part.column(3)), ranks)
                neighbours = [before_text, *texts[:-1]]
                edited = [x[: len(x) - len(x) // 3] + y[: len(x) // 3] for x, y in zip(texts, neighbours)]
                edited_chains = digests(*B.string_buffer(pa.array(edited, pa.large_string())), ranks)
                near = [before_chain, *chains[:-1]]
                keep = np.flatnonzero(own)
                before_text, before_chain = texts[-1], chains[-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(2).take(pa.array(keep)),
                        pa.array([len(texts[i]) for i in keep], pa.int64()),
                        pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in keep], pa.string()),
                        pa.array([text_of(chains[i]) for i in keep], pa.string()),
                        pa.array([text_of(edited_chains[i]) for i in keep], pa.string()),
                        pa.array([likeness(chains[i], edited_chains[i]) for i in keep], pa.float64()),
                        pa.array([likeness(chains[i], near[i]) for i in keep], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_neighbours(docs, id_col=id_col, text_col=text_col).mapInArrow(run, schema)
