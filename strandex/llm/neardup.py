"""Near-duplicate groups by SetSketch registers, banding, joint likelihood and verification.

Each document is the set of its distinct k-word shingles. A SetSketch keeps, for each of m
registers, the least of exponentially spaced, truncated hashes of the set's elements:
K = clamp(floor(1 - log_b(h)), 0, q + 1) with h the minimum of exponential variables. Two
sketches merge by the larger register, and registers agree with a probability that grows
with the Jaccard similarity.

1. Documents with equal sets are one node, found by a 128-bit sum of their shingle hashes;
   copies never meet as pairs. Nodes are numbered so that sets with many copies come first.
2. The registers are cut into bands; equal bands make a bucket, and its first node is its hub.
   The first of a node's hubs is its home. Every node is compared with its home: one pair a node.
3. What that leaves open are buckets whose nodes lie in several components. Nodes are
   dealt into cells by home, by whether they are in their home's component, and, in
   large homes, by hash, so that a cell has a bounded size; small homes around one crowd share
   cells. Two cells that share such a bucket
   meet once in a task, whatever the number of bands they share. There the pairs of
   different components that share a band are compared, and only those links
   leave the task that join two components: fewer rows than the cells have components.
4. To compare is, in both steps: sizes that can reach the threshold, then the maximum-likelihood similarity of
   both sketches (the exact set sizes are known), which gives a pair up only if the threshold
   is rejected by its likelihood ratio at five deviations, then the full
   shingle sets, with integers.
5. Components come from the links by alternating large-star and small-star steps, which take a
   number of rounds that is logarithmic for chains, until nothing changes.

With 50 bands of 5 registers a pair of similarity 0.8 shares no band with probability 2e-9.
The work of step 3 is quadratic in cells of one crowd of unconnected near-duplicates; the rows are not.

Defined results: null and empty texts have an empty set, are linked with nothing and are their
own components; with fewer words than k the whole sequence is the one shingle; repeated rows,
and rows that share an id but not a text, are documents of their own; a null doc_id is sketched, but neither linked nor kept back by others
(`without_copies` links it like any other); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandex.llm import _bytes as B
from strandex.llm._store import column, persist, scratch

_U = B.U64
BANDS, ROWS = 50, 5
REGISTERS = BANDS * ROWS
#: SetSketch base, rate and register limit: sets of 1 to 1e12 elements stay inside 0..LIMIT.
BASE, RATE, LIMIT = 1.02, 20.0, 4000
#: A likelihood ratio that rejects at five deviations: half of their square.
REJECT = 12.5
#: Size of a cell, about, in shingles and a quarter of the registers a node: two cells meet in a task.
CELL = 1 << 17
_MULTIPLY = np.random.default_rng(20240602).integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * _U(2) + _U(1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each row."""
    out: list[np.ndarray] = []
    for lo, hi in B.slices(offsets):
        o = offsets[lo : hi + 1] - offsets[lo]
        low = B.LOWER[data[offsets[lo] : offsets[hi]]]
        at, to, before = B.words(low, o)
        items = B.run_hashes(low, at, to)
        grams = B.gram_hashes(items, k, k)
        for i in range(hi - lo):
            a, z = before[i], before[i + 1]
            if z - a >= k:
                out.append(np.unique(grams[a : z - k + 1]))
            elif z > a:  # the whole sequence, told apart from longer ones by its length
                out.append(B.gram_hashes(items[a:z], int(z - a), k) ^ _U(z - a))
            else:
                out.append(np.zeros(0, _U))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch registers of a set of 64-bit hashes."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, ~_U(0))
    for lo in range(0, len(shingles), 512):
        block = shingles[lo : lo + 512, None] * _MULTIPLY
        np.minimum(least, block.min(0), out=least)
    u = np.clip(least.astype(np.float64) / 2.0**64, 2.0**-64, 1 - 2.0**-53)
    h = -np.log1p(-u) / RATE  # the least of exponential variables is the exponential of the least uniform one
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sketched sets."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of registers."""
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(_U)
    key = np.repeat(np.arange(1, BANDS + 1, dtype=_U)[None, :], len(registers), 0)
    for r in range(ROWS):
        key = B.mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def _log_likelihood(j: np.ndarray, u: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    v = 1 - u
    a, b = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    return more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1))


def likely_similarity(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, threshold: float, steps: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood similarity of rows of registers, and how far the log-likelihood of `threshold` lies below it."""
    return _likely((x > y).sum(1), (x < y).sum(1), x.shape[1], nx, ny, threshold, steps)


def _likely(more: np.ndarray, less: np.ndarray, registers: int, nx: np.ndarray, ny: np.ndarray, threshold: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    same = registers - more - less
    u = nx / (nx + ny)
    most = np.minimum(nx, ny) / np.maximum(nx, ny)
    lo, hi = np.zeros(len(u)), most.copy()
    for _ in range(steps):  # the likelihood is concave: golden-section search
        a, b = hi - 0.618 * (hi - lo), lo + 0.618 * (hi - lo)
        left = _log_likelihood(a, u, more, less, same) > _log_likelihood(b, u, more, less, same)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    best = (lo + hi) / 2
    short = _log_likelihood(best, u, more, less, same) - _log_likelihood(np.minimum(threshold, most), u, more, less, same)
    # A similarity above the ratio of sizes is impossible.
    return best, np.where(most < threshold, np.inf, np.where(best >= threshold, 0.0, short))


def plausible(more: np.ndarray, less: np.ndarray, nx: np.ndarray, ny: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the likelihood of pairs with so many larger and smaller registers does not reject the threshold."""
    out = np.minimum(nx, ny) >= threshold * np.maximum(nx, ny)
    # Fewer agreements only happen at more than five deviations from the threshold.
    out &= REGISTERS - more - less >= (threshold - 0.25) * REGISTERS
    at = np.flatnonzero(out)
    for lo in range(0, len(at), 4096):
        i = at[lo : lo + 4096]
        x, y = nx[i].astype(float), ny[i].astype(float)
        u, d = x / (x + y), [more[i], less[i], REGISTERS - more[i] - less[i]]
        top = np.minimum(x, y) / np.maximum(x, y)
        there = np.minimum(threshold, top)
        # Where the likelihood still rises at the threshold, its maximum is at or above it.
        falls = np.flatnonzero(_log_likelihood(np.minimum(there + 1e-4, top), u, *d) < _log_likelihood(there, u, *d))
        if len(falls):
            out[i[falls]] = _likely(d[0][falls], d[1][falls], REGISTERS, x[falls], y[falls], threshold, 16)[1] <= REJECT
    return out


def sketch_documents(docs: DataFrame, *, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, two sums of the set's hashes and registers (uint16 bytes) of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                sets = shingle_hashes(*B.string_buffer(batch.column(2)), k)
                registers = np.stack([sketch(s) for s in sets])
                one = np.array([s.sum(dtype=_U) for s in sets], _U)
                two = np.array([B.mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U) for s in sets], _U)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([r.tobytes() for r in registers], pa.binary())],
                    ["doc_id", "text_hash", "n_shingles", "one", "two", "registers"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, one long, two long, registers binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def banded(sketches: DataFrame, *columns: str) -> DataFrame:
    """The given columns and band: a row for each band of each sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                keys = band_keys(_registers(batch.column(0))).view(np.int64)
                each = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([*(c.take(each) for c in batch.columns[1:]), pa.array(keys.ravel())], [*columns, "band"])

    rows = sketches.select("registers", *columns)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField("band", T.LongType())]))


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, component: the smallest node that each node reaches.

    Large-star: every node's larger neighbours move to its smallest neighbour; small-star: so
    do its smaller ones. Both keep the components, and end in one star each.
    Neighbours are never gathered: the smallest is an aggregate, and the move a join.
    """
    pair = lambda a, b: (F.col(a).alias("a"), F.col(b).alias("b"))
    ordered = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges, before = persist(ordered.distinct(), "links"), None
    while True:
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        before = state
        both = edges.select("a", "b").unionAll(edges.select(*pair("b", "a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        edges = persist(small.filter("a <> b").distinct(), "links")


def _roots(links: DataFrame) -> DataFrame:
    """links (a, b), at most one a below each b -> node, component: the root above each b, by pointer jumping."""
    known = persist(links.select(F.col("b").alias("node"), F.col("a").alias("component")), "roots")
    while True:
        up = known.select(F.col("node").alias("_node"), F.col("component").alias("_up"))
        joined = known.join(up, F.col("component") == F.col("_node"), "left")
        known = persist(joined.select("node", F.coalesce("_up", "component").alias("component"), F.col("_up").isNotNull().alias("moved")), "roots")
        if known.filter("moved").isEmpty():
            return known.select("node", "component")


def _sets_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, _U) for x in column.to_pylist()]


def _home_links(nodes: DataFrame, percent: int) -> DataFrame:
    """nodes (node, home, n_shingles, registers, items) -> a, b: nodes that are linked with their homes."""
    theirs = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"), F.col("items").alias("ia"))
    pairs = nodes.filter("node <> home").join(theirs, F.col("home") == F.col("a")).select("a", F.col("node").alias("b"), "na", F.col("n_shingles").alias("nb"), "ra", F.col("registers").alias("rb"), "ia", F.col("items").alias("ib"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                x, y = _registers(batch.column(4)), _registers(batch.column(5))
                na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                keep = plausible((x > y).sum(1), (x < y).sum(1), na, nb, percent / 100)
                left, right = _sets_of(batch.column(6)), _sets_of(batch.column(7))
                for i in np.flatnonzero(keep):
                    both = len(np.intersect1d(left[i], right[i], assume_unique=True))
                    keep[i] = 100 * both >= percent * (int(na[i]) + int(nb[i]) - both)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


class _Overlaps:
    """Exact intersection sizes of one set with others: frequent elements by bitmaps, rare ones by lists."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        _, number, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        frequent = many > max(4, len(sets) // 32)
        place = np.cumsum(frequent) - 1
        hit = frequent[number]
        bits = np.zeros((len(sets), -(-max(1, int(frequent.sum())) // 64) * 64), bool)
        bits[row[hit], place[number[hit]]] = True
        self.bits = np.packbits(bits, axis=1).view(_U)
        rare = ~hit & (many[number] > 1)
        self.rare_row, self.rare = row[rare], number[rare]
        order = np.argsort(self.rare, kind="stable")
        self.by_element, self.sorted = self.rare_row[order], self.rare[order]
        self.first = np.searchsorted(self.rare_row, np.arange(len(sets) + 1))

    def of(self, r: int, others: np.ndarray) -> np.ndarray:
        out = np.bitwise_count(self.bits[others] & self.bits[r]).sum(1).astype(np.int64)
        mine = self.rare[self.first[r] : self.first[r + 1]]
        if len(mine):
            lo, hi = np.searchsorted(self.sorted, mine, "left"), np.searchsorted(self.sorted, mine, "right")
            n = hi - lo
            at = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            out += np.bincount(self.by_element[at], minlength=len(self.bits))[others]
        return out


def _join_cells(components: np.ndarray, sizes: np.ndarray, registers: np.ndarray, sets: list[np.ndarray], cut: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of components that links between nodes join, at most one for each join; cut > 0: only pairs across it count."""
    _, label = np.unique(components, return_inverse=True)
    name = components[np.unique(label, return_index=True)[1]]
    overlaps, joined = _Overlaps(sets), []
    probes = np.arange(cut) if cut else np.arange(len(sizes))
    if cut and len(sizes) - cut < cut:
        probes = np.arange(cut, len(sizes))
    threshold = percent / 100
    for r in probes:
        other = np.arange(r + 1, len(sizes)) if not cut else (np.arange(cut, len(sizes)) if r < cut else np.arange(cut))
        fits = (label[other] != label[r]) & (np.minimum(sizes[other], sizes[r]) >= threshold * np.maximum(sizes[other], sizes[r]))
        other = other[fits]
        if not len(other):
            continue
        theirs = registers[other]
        share = (theirs == registers[r]).reshape(-1, BANDS, ROWS).all(2).any(1)
        other, theirs = other[share], theirs[share]
        keep = plausible((registers[r] > theirs).sum(1), (registers[r] < theirs).sum(1), np.full(len(other), sizes[r]), sizes[other], threshold)
        other = other[keep]
        if not len(other):
            continue
        both = overlaps.of(r, other)
        linked = other[100 * both >= percent * (sizes[other] + sizes[r] - both)]
        for found in np.unique(label[linked]):
            joined.append((int(name[label[r]]), int(name[found])))
            label = np.where(label == found, label[r], label)
    return joined


def _gathered(per: DataFrame, totals: DataFrame) -> DataFrame:
    """_from, _to: cells that are their home's only one go into cells of the least home with which theirs shares an open bucket.

    Without this a large cell would be sent once for each of the many cells of a few nodes around it.
    One step only, and homes stay whole, so that a cell meets no more cells than its homes did.
    """
    crowds = per.groupBy("band").agg(F.min("lo").alias("x"), F.max("hi").alias("y"), F.min("cell.home").alias("lead")).filter("x < y").select("band", "lead")
    leads = per.select("band", F.col("cell.home").alias("_home")).join(crowds, "band").groupBy("_home").agg(F.min("lead").alias("_lead"))
    lone = totals.filter("_blocks = 1").join(leads, "_home")
    blocks = lone.groupBy("_lead", "_apart").agg(F.ceil(F.sum("_size") / CELL).cast("long").alias("_n"))
    block = -1 - F.pmod(F.xxhash64("_home"), F.col("_n"))
    named = lambda home, at: F.struct(F.col(home).alias("home"), F.col("_apart").alias("apart"), at.alias("block"))
    return persist(lone.join(blocks, ["_lead", "_apart"]).select(named("_home", F.lit(0).cast("long")).alias("_from"), named("_lead", block).alias("_to")), "moves")


def _cell_links(nodes: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """nodes (node, n_shingles, registers, items) and placed (node, home, component, n_shingles) -> a, b: pairs of components that further links join."""
    own = placed.select(F.col("node").alias("_home"), F.col("component").alias("_main"))
    sided = placed.join(own, F.col("home") == F.col("_home")).select("node", "home", "component", "n_shingles", (F.col("component") != F.col("_main")).alias("apart"))
    sided = persist(sided, "sided")
    totals = sided.groupBy("home", "apart").agg(F.sum(F.col("n_shingles") + REGISTERS // 4).alias("_size")).withColumnsRenamed({"home": "_home", "apart": "_apart"})
    totals = persist(totals.withColumn("_blocks", F.ceil(F.col("_size") / CELL).cast("long")), "totals")
    cell = F.struct("home", "apart", F.pmod(F.xxhash64("node"), F.col("_blocks")).alias("block"))
    keyed = sided.join(totals, (F.col("home") == F.col("_home")) & (F.col("apart") == F.col("_apart"))).select("node", "component", cell.alias("cell"))
    dealt = persist(nodes.select("node", "n_shingles", "registers", "items").join(keyed, "node"), "cells")
    per = persist(banded(dealt, "component", "cell").groupBy("band", "cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi")), "bands")
    moves = _gathered(per, totals)
    move = lambda rows: rows.join(moves, F.col("cell") == F.col("_from"), "left").withColumn("cell", F.coalesce("_to", "cell")).drop("_from", "_to")
    per = move(per).groupBy("band", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    several = per.groupBy("band").agg(F.min("lo").alias("x"), F.max("hi").alias("y")).filter("x < y").select("band")
    opened = persist(per.join(several, "band"), "open-bands")
    # Pairs of cells leave a task as rows, each once for all bands of the task; no band's cells are gathered.
    side = lambda s: opened.select("band", F.col("cell").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))
    differ = F.least("lo_i", "lo_j") < F.greatest("hi_i", "hi_j")
    units = persist(side("i").join(side("j"), "band").filter((F.col("i") <= F.col("j")) & differ).select("i", "j").distinct(), "units")
    packed = move(dealt).groupBy("cell").agg(F.collect_list(F.struct("component", "n_shingles", "registers", "items")).alias("members"))
    of = lambda c: packed.select(F.col("cell").alias(c), F.col("members").alias(f"m{c}"))
    met = units.join(of("i"), "i").join(of("j"), "j").select("mi", F.when(F.col("i") != F.col("j"), F.col("mj")).alias("mj"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u in range(batch.num_rows):
                sides = [batch.column(c).slice(u, 1).flatten() for c in (0, 1) if batch.column(c)[u].is_valid]
                field = lambda name: pa.concat_arrays([s.field(name) for s in sides])  # noqa: E731, B023
                found = _join_cells(field("component").to_numpy(), field("n_shingles").to_numpy(), _registers(field("registers")), _sets_of(field("items")), len(sides[0]) if len(sides) > 1 else 0, percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _label(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """rows with column mapped to its component, where it has one."""
    known = labels.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return rows.join(known, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_component", column)).drop("_node", "_component")


def _labelled_sets(texts: DataFrame, sketched: DataFrame, k: int, percent: int, null_ids: bool) -> DataFrame:
    """one, two, n_shingles, first, component: a row for each set."""
    key = ["one", "two", "n_shingles"]
    some = sketched.filter((F.col("n_shingles") > 0) & (F.lit(null_ids) | F.col("doc_id").isNotNull()))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    sets = some.groupBy(*key).agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.first("registers").alias("registers"))
    popular = F.lit(15) - F.least(F.lit(15), F.floor(F.log2("copies")))
    sets = persist(sets.withColumn("node", F.monotonically_increasing_id() + F.shiftleft(popular.cast("long"), 56)), "sets")

    each = banded(sets, "node")
    buckets = each.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("band", "hub")
    crowded = persist(each.join(buckets, "band").groupBy("node").agg(F.min("hub").alias("home")), "crowded")
    wanted = sets.join(crowded, "node").select("node", "home", "n_shingles", "registers", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")))

    def items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_hashes(*B.string_buffer(batch.column(4)), k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "home", "n_shingles", "registers", "items"])

    found = found.select("node", "home", "n_shingles", "registers", "text").mapInArrow(items, "node long, home long, n_shingles long, registers binary, items binary")
    nodes = persist(found.dropDuplicates(["node"]), "nodes")

    stars = _roots(_home_links(nodes, percent))
    placed = _label(nodes.select("node", "home", "n_shingles", F.col("node").alias("component")), stars, "component")
    crossed = connected_components(_cell_links(nodes, placed, percent))
    labelled = _label(_label(sets.select(*key, "first", F.col("node").alias("component")), stars, "component"), crossed, "component")
    return persist(labelled, "labelled", outside=True)


def grouped_rows(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", null_ids: bool = False) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and the first (doc_id, text_hash) of the component: one row a document.

    component_id and first are null for documents that are linked with nothing by definition.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = persist(sketch_documents(texts, k=k), "sketches")
    key = ["one", "two", "n_shingles"]
    with scratch(docs.sparkSession):
        labelled = _labelled_sets(texts, sketched, k, percent, null_ids)
    least = labelled.groupBy("component").agg(F.min("first").alias("first")).withColumnRenamed("component", "_component")
    groups = labelled.drop("first").join(least, F.col("component") == F.col("_component")).select(*(F.col(c).alias(f"_{c}") for c in key), "first")
    same = [F.col(c) == F.col(f"_{c}") for c in key]
    if not null_ids:
        same.append(F.col("doc_id").isNotNull())
    return sketched.join(groups, same, "left").select("doc_id", "text_hash", "n_shingles", F.col("first.doc_id").alias("component_id"), F.struct("first.doc_id", "first.text_hash").alias("first"), F.col("_one").isNotNull().alias("grouped"))


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document."""
    rows = grouped_rows(docs, k=k, percent=percent, id_col=id_col, text_col=text_col)
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, in all their columns, of which one of each group stays: that of the smallest id.

    Null ids come last and are linked like any other; of rows that repeat id and text, one
    stays. Documents without words are linked with nothing, so all of them stay.
    """
    with scratch(docs.sparkSession):
        rows = persist(grouped_rows(docs, k=k, percent=percent, id_col=id_col, text_col=text_col, null_ids=True).filter("grouped"), "grouped")
        keys = rows.groupBy("doc_id", "text_hash").agg(F.first("first").alias("first"), F.count("*").alias("n"))
        stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
        acted = persist(keys.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), stays.alias("stays"), "n").filter("n > 1 or not stays"), "acted", outside=True)
    nested = docs.select(F.struct(*map(column, docs.columns)).alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))
    of = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    once = nested.join(acted.filter("stays").select("_id", "_hash"), of, "left_semi").dropDuplicates(["id", "hash"])
    rest = nested.join(acted.select("_id", "_hash"), of, "left_anti")
    return rest.unionAll(once).select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
