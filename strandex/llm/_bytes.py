"""Vectorised text primitives over Arrow string buffers (used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: [\x20\x09-\x0D], the bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Longer runs are hashed one by one.
_LONG = 64
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def string_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n+1 offsets of the rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or one row if that alone is longer."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true within each row, and the runs before each row (n+1)."""
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(inside))]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets).astype(np.int64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of each row, and the words before each row."""
    return runs(~SPACE[data], offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run, eight bytes at a time, each mixed before the next joins.

    Runs of at most eight bytes and equal length never collide, as the mixer is a bijection.
    """
    size = ends - starts
    if not len(starts):
        return np.zeros(0, U64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each position on
    out = mix(mix(size.astype(U64) + U64(0x9E3779B97F4A7C15)) ^ (eight[starts] & _LOW_BYTES[np.minimum(size, 8)]))
    done, open_runs = 8, np.flatnonzero((size > 8) & (size <= _LONG))
    while len(open_runs):
        here = eight[starts[open_runs] + done] & _LOW_BYTES[np.minimum(size[open_runs] - done, 8)]
        out[open_runs] = mix(out[open_runs] * U64(0xD6E8FEB86659FD93) ^ here)
        done += 8
        open_runs = open_runs[size[open_runs] > done]
    view = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(view[starts[i] : ends[i]])
    return out


def gram_hashes(items: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive items; shorter input gives none."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = items[:n] + U64((0xD6E8FEB86659FD93 * (2 * seed + 1)) & (2**64 - 1))
    for j in range(1, k):  # neither linear in the ring nor in the bits, so that no sequence cancels itself
        out *= U64(0x9FB21C651E98DF25)
        out ^= out >> U64(29)
        out ^= items[j : j + n]
    return mix(out)


def range_hashes(items: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of items first .. stop - 1 of each pair, by the two overlapping powers of two that cover it."""
    out = np.zeros(len(first), U64)
    if not len(first):
        return out
    size = stop - first
    level, block, width = mix(items ^ U64(0x51ED270B27D4EB4F)), 0, 1
    power = np.frexp(size.astype(float))[1] - 1
    while True:
        here = np.flatnonzero(power == block)
        left, right = level[first[here]], level[stop[here] - width]
        out[here] = mix((left * U64(0x9FB21C651E98DF25)) ^ mix(right ^ size[here].astype(U64)))
        if not (power > block).any():
            return out
        level = mix(level[:-width] * U64(0xD1342543DE82EF95) ^ level[width:])
        block, width = block + 1, 2 * width


def row_of(counts_before: np.ndarray) -> np.ndarray:
    """The row that each item belongs to, from the items before each row (n+1)."""
    return np.repeat(np.arange(len(counts_before) - 1), np.diff(counts_before))
