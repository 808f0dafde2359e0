"""N-gram Jaccard join by T-occurrence search over inverted lists (DivideSkip).

A document is the set of its distinct k-word shingles. Two sets of sizes a and b have a Jaccard similarity
of p percent or more exactly if they share T(a, b) = ceil(p (a + b) / (100 + p)) shingles: a document answers a query if it occurs
on T of the inverted lists of the query's shingles. No such pair shares less than p percent of the larger set, so
sizes beyond that ratio never meet.

1. *Long and short lists.* A count of all shingles in a fixed number of hash buckets says how long an inverted list
   will be. A document's shingles are ordered by it; lists of the common ones are long. Of its n lists all but the
   ceil(p n / 100) - m longest are its short lists, with m = 1 + n / 12: two documents that link share as many short lists as the smaller one's m says, whatever the counts
   are, so their error costs time only. A document of whose short lists fewer hold others links with none, and is left out from
   here on. Common shingles, as those of passages that many documents hold, are never shuffled
   by their list unless a document has hardly anything else.
2. Documents with equal sets are one node, known by two 64-bit sums and the size; nodes with many copies have
   the smallest numbers. The inverted short lists are made by a shuffle; a list's first node is its hub, and the hub
   that most of a node's lists have is its home. Every node is compared with its home, which joins groups of near copies in one step.
3. *Cells.* What is open are lists whose nodes lie in several components. Nodes are dealt into cells by home, by whether they
   are in its component, by size class and, where that is too much for a task, by hash. Cells that share as many open lists as
   their smallest sets must, differ in
   components and have sizes in reach of each other meet once, in one task.
4. *DivideSkip.* There one cell is indexed by shingle. A query's lists are divided: up to T - 1 long ones, as many as the
   method's cost formula says, and the short rest. The short lists are merged on a heap, which skips by binary search over rows
   that too few lists are left to reach; rows that occur on T - L of them are probed for in the L long lists by
   binary search, and kept from T occurrences. Only links that join two components leave the task.
5. Components come from the links by alternating star steps.

Recovery and memory: each step reads a written table; lists, pairs of cells and links are aggregated before they are
shuffled, cells have a bounded size and no group is gathered whole.

Equality is that of 64-bit hashes of shingles that are mixed after each eight bytes and word.

Defined results: null and empty texts, or texts without words, have an empty set, are linked with nothing and are their own components; with fewer
words than k the whole sequence is the one shingle; rows that repeat an id, with equal texts or others, are documents of their own,
linked by their sets; a null doc_id is counted, but neither linked nor another's component; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.llm import _bytes as B
from strandex.llm._store import persist, scratch
from strandex.llm.neardup import _label, _roots, _sets_of, connected_components, shingle_hashes

_U = B.U64
#: Bits of the number of buckets by which the lengths of inverted lists are estimated, and buckets that travel in a row.
BITS, CHUNK = 20, 1 << 12
#: Bits of a bitmap of text hashes.
MARKS = 23
#: Size of a cell, about, in shingles: two cells meet in a task.
CELL = 1 << 18
#: A shingle more on the short lists, and one more that must be shared, for so many shingles of a set.
MORE = 12
#: Cost of a heap step against a binary search, in the method's formula for the number of long lists.
MU = 0.0085


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shared shingles from which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def required(size: int, percent: int) -> int:
    """How many short lists a set of that size shares with any set that it links with."""
    return min(1 + size // MORE, -(-percent * size // 100))


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The highest bits of hashes, as a bucket."""
    return (hashes >> _U(64 - bits)).astype(np.int64)


def list_lengths(texts: DataFrame, k: int) -> np.ndarray:
    """For each bucket the bit length of the number of its shingles in all documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            sets = shingle_hashes(*B.string_buffer(batch.column(0)), k)
            if sets:
                total += np.bincount(_top(np.concatenate(sets), BITS), minlength=1 << BITS)
        if total.any():
            # What one task counts beyond 16 bits is a long list already.
            rows = np.minimum(total, 65535).astype(np.uint16).reshape(-1, CHUNK)
            some = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([rows[i].tobytes() for i in some], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(counts, np.uint16).astype(np.int64)
        if total:
            length = [np.frexp(c.astype(float))[1].astype(np.uint8).tobytes() for c in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(length, pa.binary())], ["chunk", "length"])

    counted = texts.select("text").mapInArrow(count, "chunk long, counts binary").repartition(16, "chunk").mapInArrow(add, "chunk long, length binary")
    out = np.zeros(((1 << BITS) // CHUNK, CHUNK), np.uint8)
    for r in counted.collect():  # a byte a bucket, 1 MiB
        out[r.chunk] = np.frombuffer(r.length, np.uint8)
    return out.ravel()


def marked(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the highest MARKS bits of the column `hash`: 1 MiB, whatever the number of hashes."""
    place = F.shiftrightunsigned("hash", 64 - MARKS)
    words = hashes.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("bit"))
    out = np.zeros(1 << MARKS - 6, np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[r.word] = r.bits
    return out.view(_U)


def with_short_lists(texts: DataFrame, lengths: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, two sums of the set's hashes, and the shingles of its short lists."""
    bits = len(lengths).bit_length() - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                sets = shingle_hashes(*B.string_buffer(batch.column(2)), k)
                one = np.array([s.sum(dtype=_U) for s in sets], _U)
                two = np.array([B.mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U) for s in sets], _U)
                short = []
                for s in sets:
                    many = len(s) + (-percent * len(s) // 100) + required(len(s), percent)
                    short.append(s[np.argsort(lengths[_top(s, bits)], kind="stable")[:many]].view(np.int64))  # equal lengths: by hash
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(short, pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "n_shingles", "one", "two", "short"],
                )

    return texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, one long, two long, short array<long>")


def heap_merge(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(row, occurrences) of the rows on `need` or more of the ascending lists; skips rows that cannot get there."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    found = []
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            found.append((top, len(popped)))
            onward = top + 1
        else:  # the first need - 1 lists cannot reach a row before the next list's
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            onward = heap[0][0]
        for _, i, at in popped:
            x = lists[i]
            at = bisect_left(x, onward, at)
            if at < len(x):
                heapq.heappush(heap, (x[at], i, at))
    return found


class InvertedLists:
    """The inverted lists of a cell: for each shingle the ascending rows whose sets hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(tokens, kind="stable")
        self.rows = row[order]
        self.tokens, self.first = np.unique(tokens[order], return_index=True)
        self.first = np.append(self.first, len(tokens))
        #: (list, row) as one ascending number, for binary search in any list.
        self.pairs = np.repeat(np.arange(len(self.tokens)), np.diff(self.first)) * len(sets) + self.rows

    def search(self, query: np.ndarray, percent: int, wanted: np.ndarray) -> np.ndarray:
        """Rows among the wanted ones that link with the query's set."""
        at = np.searchsorted(self.tokens, query)
        at[at == len(self.tokens)] = 0
        lists = at[self.tokens[at] == query]
        fits = wanted & (100 * np.minimum(self.size, len(query)) >= percent * np.maximum(self.size, len(query)))
        if not fits.any():
            return np.zeros(0, np.int64)
        least = int(needed(len(query), int(self.size[fits].min()), percent))
        if len(lists) < least:
            return np.zeros(0, np.int64)
        length = self.first[lists + 1] - self.first[lists]
        lists = lists[np.argsort(-length, kind="stable")]
        many = min(least - 1, int(least / (MU * math.log2(max(2, int(length.max()))) + 1)))
        long, short = lists[:many], lists[many:]
        merged = heap_merge([self.rows[self.first[i] : self.first[i + 1]].tolist() for i in short], least - many)
        if not merged:
            return np.zeros(0, np.int64)
        row, count = np.array(merged).T
        keep = fits[row]
        row, count = row[keep], count[keep]
        if len(long) and len(row):
            probe = np.sort(long)[:, None] * len(self.size) + row
            where = np.searchsorted(self.pairs, probe)
            where[where == len(self.pairs)] = 0
            count = count + (self.pairs[where] == probe).sum(0)
        return row[count >= needed(len(query), self.size[row], percent)]


def _join_cells(components: np.ndarray, sets: list[np.ndarray], cut: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of components that links join, at most one for each join; cut > 0: rows before it are one cell, the rest the other."""
    _, first, label = np.unique(components, return_index=True, return_inverse=True)
    name, joined = components[first], []
    inside, asking = slice(cut, None), range(cut) if cut else range(len(sets))
    if cut and len(sets) - cut < cut:  # the smaller cell asks
        inside, asking = slice(0, cut), range(cut, len(sets))
    index = InvertedLists(sets[inside])
    shift = inside.start
    for r in asking:
        wanted = label[inside] != label[r]
        if not wanted.any():
            continue
        for row in index.search(sets[r], percent, wanted):
            mine, theirs = label[r], label[shift + row]
            if mine != theirs:
                joined.append((int(name[mine]), int(name[theirs])))
                label[label == theirs] = mine
    return joined


def _home_links(nodes: DataFrame, percent: int) -> DataFrame:
    """nodes (node, home, n_shingles, items) -> a, b: nodes that link with their homes."""
    theirs = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("items").alias("ia"))
    mine = nodes.filter("node <> home").select("home", F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("items").alias("ib"))
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    pairs = mine.join(theirs, (F.col("home") == F.col("a")) & near).select("a", "b", "ia", "ib")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_sets_of(batch.column(2)), _sets_of(batch.column(3))):
                x, y = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(int((y[at] == x).sum()) >= needed(len(x), len(y), percent))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _met_cells(entries: DataFrame, placed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """node -> cell, and the pairs of cells (i, j) that share an open list and may hold links between components."""
    own = placed.select(F.col("node").alias("_home"), F.col("component").alias("_main"))
    grown = math.log(100 / percent) if percent < 100 else math.log(2)
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / grown).cast("int")
    sided = placed.join(own, F.col("home") == F.col("_home")).select("node", "home", "component", "n_shingles", (F.col("component") != F.col("_main")).alias("apart"), size_class.alias("sized"))
    sided = persist(sided, "sided")
    group = ["home", "apart", "sized"]
    totals = sided.groupBy(*group).agg(F.ceil(F.sum("n_shingles") / CELL).cast("long").alias("_blocks"))
    cell = F.struct(*group, F.pmod(F.xxhash64("node"), F.col("_blocks")).alias("block"))
    keyed = persist(sided.join(totals, group).select("node", "component", "n_shingles", cell.alias("cell")), "keyed")
    per = persist(entries.join(keyed, "node").groupBy("token", "cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most")), "lists")
    several = per.groupBy("token").agg(F.min("lo").alias("x"), F.max("hi").alias("y"), F.count("*").alias("cells")).filter("x < y")
    opened = persist(per.join(several.select("token"), "token"), "open-lists")
    side = lambda s: opened.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("cell", "lo", "hi", "least", "most")))
    in_reach = (100 * F.col("most_i") >= percent * F.col("least_j")) & (100 * F.col("most_j") >= percent * F.col("least_i"))
    differ = F.least("lo_i", "lo_j") < F.greatest("hi_i", "hi_j")
    met = side("i").join(side("j"), "token").filter((F.col("cell_i") <= F.col("cell_j")) & in_reach & differ)
    counted = met.groupBy(F.col("cell_i").alias("i"), F.col("cell_j").alias("j")).agg(F.count("*").alias("lists"), F.min(F.least("least_i", "least_j")).alias("least"))
    asked = F.least(1 + F.floor(F.col("least") / MORE), F.ceil(F.col("least") * percent / 100))
    return keyed, persist(counted.filter(F.col("lists") >= asked).select("i", "j"), "units")


def _cell_links(nodes: DataFrame, keyed: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of components that links between the cells of each unit join."""
    used = units.select(F.col("i").alias("cell")).unionAll(units.select(F.col("j").alias("cell"))).distinct()
    members = nodes.select("node", "items").join(keyed.join(used, "cell").select("node", "component", "cell"), "node")
    packed = persist(members.groupBy("cell").agg(F.collect_list(F.struct("component", "items")).alias("members")), "packed")
    of = lambda c: packed.select(F.col("cell").alias(c), F.col("members").alias(f"m{c}"))
    met = units.join(of("i"), "i").join(of("j"), "j").select("mi", F.when(F.col("i") != F.col("j"), F.col("mj")).alias("mj"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u in range(batch.num_rows):
                sides = [batch.column(c).slice(u, 1).flatten() for c in (0, 1) if batch.column(c)[u].is_valid]
                field = lambda name: pa.concat_arrays([s.field(name) for s in sides])  # noqa: E731, B023
                found = _join_cells(field("component").to_numpy(), _sets_of(field("items")), len(sides[0]) if len(sides) > 1 else 0, percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _labelled_sets(texts: DataFrame, listed: DataFrame, k: int, percent: int) -> DataFrame:
    """one, two, n_shingles, first (doc_id), component: a row for each distinct set."""
    key = ["one", "two", "n_shingles"]
    some = listed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    found = some.groupBy(*key).agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("copies"), F.first("short").alias("short"))
    popular = F.lit(15) - F.least(F.lit(15), F.floor(F.log2("copies")))
    sets = persist(found.withColumn("node", F.monotonically_increasing_id() + F.shiftleft(popular.cast("long"), 56)), "sets")

    # What the smallest set that can link with a set shares at least: required() of its size.
    smallest = F.floor(F.col("n_shingles") * percent / 100)
    asked = F.greatest(F.lit(1), F.least(1 + F.floor(smallest / MORE), F.ceil(smallest * percent / 100)))
    each = sets.select("node", F.explode("short").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token")
    shared = persist(each.join(common, "token"), "shared")
    several = shared.groupBy("node").agg(F.count("*").alias("n")).join(sets.select("node", asked.alias("asked")), "node").filter("n >= asked").select("node")
    entries = persist(shared.join(several, "node").select("node", "token"), "entries")
    hubs = entries.groupBy("token").agg(F.min("node").alias("hub"))
    # The hub that most of a node's lists have: lists that it shares by chance have others.
    often = entries.join(hubs, "token").groupBy("node", "hub").agg(F.count("*").alias("n"))
    crowded = persist(often.groupBy("node").agg(F.min(F.struct(-F.col("n"), "hub")).alias("best")).select("node", F.col("best.hub").alias("home")), "crowded")
    wanted = persist(sets.join(crowded, "node").select("node", "home", "n_shingles", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")), "wanted")
    marks = marked(wanted.select(F.col("_hash").alias("hash")))

    def items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The whole sets of the texts that the bitmap lets through; the others leave no task."""
        for whole in batches:
            place = _top(whole.column(1).to_numpy().view(_U), MARKS)
            batch = whole.filter(pa.array((marks[place >> 6] >> (place & 63).astype(_U)) & _U(1) == 1))
            found = shingle_hashes(*B.string_buffer(batch.column(2)), k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([s.tobytes() for s in found], pa.binary())], ["doc_id", "hash", "items"])

    found = texts.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(items, "doc_id long, hash long, items binary")
    of = (F.col("doc_id") == F.col("_id")) & (F.col("hash") == F.col("_hash"))
    nodes = persist(wanted.join(found, of).select("node", "home", "n_shingles", "items").dropDuplicates(["node"]), "nodes")

    stars = _roots(_home_links(nodes, percent))
    placed = _label(nodes.select("node", "home", "n_shingles", F.col("node").alias("component")), stars, "component")
    keyed, units = _met_cells(entries, placed, percent)
    crossed = connected_components(_cell_links(nodes, keyed, units, percent))
    labelled = _label(_label(sets.select(*key, F.col("first.doc_id").alias("first"), F.col("node").alias("component")), stars, "component"), crossed, "component")
    return persist(labelled, "labelled", outside=True)


def jaccard_components(docs: DataFrame, *, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the size of each document's set and the smallest doc_id that its links reach."""
    if not 0 < percent <= 100:
        raise ValueError("percent is 1 to 100")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    listed = persist(with_short_lists(texts, list_lengths(texts, k), k, percent), "short-lists")
    with scratch(docs.sparkSession):
        labelled = _labelled_sets(texts, listed, k, percent)
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    of = labelled.join(least, "component").select(F.col("one").alias("_one"), F.col("two").alias("_two"), F.col("n_shingles").alias("_n"), "component_id")
    same = (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two")) & (F.col("n_shingles") == F.col("_n")) & F.col("doc_id").isNotNull()
    return listed.join(of, same, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
