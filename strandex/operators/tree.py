"""The balanced fence hierarchy over a suffix array, and the tries of its leaves.

n entries go into the fewest nodes of a given capacity, as evenly as possible, the smaller
nodes first; inner levels group the nodes below with half their capacity, up to one root.
Nodes are arithmetic on sa_pos, so every level is one aggregation with no order to keep.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.functions import encoding as E
from strandex.operators.suffix import KEY, PART, common_prefix, with_common_prefix, with_lower_neighbour
from strandex.sources.tables import materialise


def nodes_needed(n: Column, room: int) -> Column:
    """Nodes for n entries."""
    return F.ceil(n / room).cast("long")


def node_of(i: Column, n: Column, m: Column) -> Column:
    """The node of entry i when n entries are split over m nodes, the smaller first."""
    q = F.floor(n / m)
    small = m - n % m
    return F.when(i < small * q, F.floor(i / q)).otherwise(small + F.floor((i - small * q) / (q + 1))).cast("long")


def leaves(array: DataFrame, d: int = 1) -> DataFrame:
    """doc_id, sa_pos, pos, n, node_id, slot: each suffix with its leaf and its place there."""
    sizes = array.groupBy("doc_id").agg(F.count("*").alias("n"))
    m = nodes_needed(F.col("n"), E.node_capacity(d, True))
    placed = array.join(sizes, "doc_id").withColumn("node_id", node_of(F.col("sa_pos"), F.col("n"), m))
    begin = placed.groupBy("doc_id", "node_id").agg(F.min("sa_pos").alias("sa_begin"))
    return placed.join(begin, ["doc_id", "node_id"]).select("doc_id", "sa_pos", "pos", "n", "node_id", "sa_begin", (F.col("sa_pos") - F.col("sa_begin")).alias("slot"))


def leaf_fences(array: DataFrame, d: int = 1) -> DataFrame:
    """doc_id, level, node_id, l_pos, r_pos, n_str, sa_begin: the leaves' first and last suffix."""
    grouped = leaves(array, d).groupBy("doc_id", "node_id")
    found = grouped.agg(F.min_by("pos", "sa_pos").alias("l_pos"), F.max_by("pos", "sa_pos").alias("r_pos"), F.count("*").alias("n_str"), F.min("sa_pos").alias("sa_begin"))
    return found.select("doc_id", F.lit(0).cast("long").alias("level"), "node_id", "l_pos", "r_pos", "n_str", "sa_begin")


def next_level(below: DataFrame, d: int = 1) -> DataFrame:
    """The level above: nodes of half the inner capacity over the nodes below, for texts with more than one node there."""
    room = E.node_capacity(d, False) // 2
    sizes = below.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    placed = below.join(sizes, "doc_id").withColumn("parent", node_of(F.col("node_id"), F.col("n"), nodes_needed(F.col("n"), room)))
    grouped = placed.groupBy("doc_id", "level", "parent")
    found = grouped.agg(F.min_by("l_pos", "node_id").alias("l_pos"), F.max_by("r_pos", "node_id").alias("r_pos"), F.sum("n_str").alias("n_str"), F.min("sa_begin").alias("sa_begin"))
    return found.select("doc_id", (F.col("level") + 1).alias("level"), F.col("parent").alias("node_id"), "l_pos", "r_pos", "n_str", "sa_begin")


def level_sizes(n: int, d: int = 1) -> list[int]:
    """Nodes of each level for n suffixes, leaves first."""
    if n <= 0:
        return []
    sizes = [-(-n // E.node_capacity(d, True))]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // (E.node_capacity(d, False) // 2)))
    return sizes


def build(array: DataFrame, d: int = 1) -> DataFrame:
    """All levels of the hierarchy in one table."""
    longest = array.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    level = out = leaf_fences(array, d)
    for _ in level_sizes(longest, d)[1:]:
        level = next_level(level, d)
        out = out.unionByName(level)
    return out


def shape(array: DataFrame, d: int = 1) -> DataFrame:
    """doc_id, level, nodes, least, most: node count and suffixes a node, by level."""
    return build(array, d).groupBy("doc_id", "level").agg(F.count("*").alias("nodes"), F.min("n_str").alias("least"), F.max("n_str").alias("most"))


def entries(array: DataFrame, d: int = 1) -> DataFrame:
    """doc_id, level, node_id, child, l_pos, r_pos: the fences that inner nodes hold for the nodes below them."""
    table = build(array, d)
    room = E.node_capacity(d, False) // 2
    sizes = table.groupBy("doc_id", "level").agg(F.count("*").alias("n")).filter("n > 1")
    parent = node_of(F.col("node_id"), F.col("n"), nodes_needed(F.col("n"), room))
    return table.join(sizes, ["doc_id", "level"]).select("doc_id", (F.col("level") + 1).alias("level"), parent.alias("node_id"), F.col("node_id").alias("child"), "l_pos", "r_pos")


def dump(array: DataFrame, d: int = 1) -> DataFrame:
    """doc_id, level, node_id, line: a line for each node, indented by its depth below the root."""
    table = build(array, d)
    top = table.groupBy("doc_id").agg(F.max("level").alias("top"))
    kind = F.when(F.col("level") == 0, F.lit("leaf")).otherwise(F.lit("inner"))
    line = F.concat(F.repeat(F.lit("  "), (F.col("top") - F.col("level")).cast("int")), kind, F.lit(" "), F.col("node_id").cast("string"), F.lit(": "), F.col("l_pos").cast("string"), F.lit(".."), F.col("r_pos").cast("string"))
    return table.join(top, "doc_id").select("doc_id", "level", "node_id", line.alias("line"))


# Tries


def leaf_rows(array: DataFrame, keys: DataFrame, ties: DataFrame) -> DataFrame:
    """doc_id, node_id, pos, lcp, left, right: a row for each leaf, of at most its capacity: its suffixes in order, and for each the common prefix with the
    one before it in the leaf (-1 for the first) and the two symbols in which these part."""
    placed = leaves(array)
    pairs = with_lower_neighbour(placed.select("doc_id", "sa_pos", "pos")).join(placed.select("doc_id", "sa_pos", "node_id", "slot"), ["doc_id", "sa_pos"])
    pairs = pairs.withColumn("prev", F.when(F.col("slot") > 0, F.col("prev")))
    measured = materialise(with_common_prefix(pairs, keys, ties), "parted")
    symbol = keys.select(F.col("doc_id").alias("_doc"), F.col("pos").alias("_pos"), F.substring("key", 1, 1).alias("_s"))
    for place, name in (("prev", "left"), ("pos", "right")):
        at = (F.col("doc_id") == F.col("_doc")) & (F.col(place) + F.col("lcp") == F.col("_pos"))
        measured = measured.join(symbol, at, "left").withColumnRenamed("_s", name).drop("_doc", "_pos")
    item = F.struct("slot", "pos", F.coalesce("lcp", F.lit(-1).cast("long")).alias("lcp"), F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"))
    rows = measured.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    return rows.select("doc_id", "node_id", *(F.col(f"s.{c}").alias(c) for c in ("pos", "lcp", "left", "right")))


def intervals(lcp: list[int]) -> list[tuple[int, int, int, list[int], int]]:
    """(depth, first, last, partings, parent) of the branching nodes over neighbours' common prefixes (lcp[0] unused), by the nearest smaller values.

    first and last are the node's suffixes, partings the places where its children part, parent a number in the list or -1.
    """
    done: list[list] = []
    open_nodes: list[int] = []
    for i in range(1, len(lcp)):
        first, below = i - 1, -1
        while open_nodes and done[open_nodes[-1]][0] > lcp[i]:
            closed = open_nodes.pop()
            done[closed][2], first = i - 1, done[closed][1]
            if below >= 0:
                done[below][4] = closed
            below = closed
        if open_nodes and done[open_nodes[-1]][0] == lcp[i]:
            done[open_nodes[-1]][3].append(i)
        else:
            done.append([lcp[i], first, -1, [i], -1])
            open_nodes.append(len(done) - 1)
        if below >= 0:
            done[below][4] = open_nodes[-1]
    below = -1
    for node in reversed(open_nodes):
        done[node][2] = len(lcp) - 1
        if below >= 0:
            done[below][4] = node
        below = node
    return [tuple(x) for x in done]


def trie_edges(rows: DataFrame) -> DataFrame:
    """leaf_rows -> doc_id, node_id, lcp, prefix_pos, n_children, first_slot, last_slot, parent_lcp, parent_pos, symbol: the branching nodes of each leaf's trie and the edges to them.

    A node is known by its depth lcp and by prefix_pos, the suffix before its first parting; the edge
    to it begins with symbol and is lcp - parent_lcp long. The root of a leaf has no parent.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, leaf, pos, lcp, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                nodes = intervals(lcp)
                for depth, first, last, parts, up in nodes:
                    parent = nodes[up] if up >= 0 else None
                    # Where the parent parts at the node's begin the symbol stands right of the parting, else left of the one at its end.
                    symbol = None if not parent else right[first] if first in parent[3] else left[last + 1]
                    found.append((doc, leaf, depth, pos[parts[0] - 1], len(parts) + 1, first, last, parent and parent[0], parent and pos[parent[3][0] - 1], symbol))
            columns = list(zip(*found)) or [() for _ in range(10)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 9 else pa.int64()) for i, c in enumerate(columns)], _EDGES)

    return rows.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'symbol' else 'long'}" for c in _EDGES))


_EDGES = ["doc_id", "node_id", "lcp", "prefix_pos", "n_children", "first_slot", "last_slot", "parent_lcp", "parent_pos", "symbol"]


def trie_nodes(rows: DataFrame) -> DataFrame:
    """leaf_rows -> doc_id, node_id, lcp, prefix_pos, n_children: the branching nodes of each leaf's trie.

    A branching node is a prefix at which two neighbouring suffixes of the leaf part;
    n_children is one more than the neighbours that part there. prefix_pos is the suffix before the first parting.
    """
    return trie_edges(rows).select("doc_id", "node_id", "lcp", "prefix_pos", "n_children")


def _blind(pattern: str, lcp: list[int], left: list[str], right: list[str]) -> int:
    """The suffix of a leaf at which a descent by branching symbols alone ends."""
    lo, hi = 0, len(lcp)
    while hi - lo > 1:
        depth = min(lcp[lo + 1 : hi])
        if depth >= len(pattern):
            return lo
        parts = [i for i in range(lo + 1, hi) if lcp[i] == depth]
        edges = [left[parts[0]], *(right[i] for i in parts)]
        bounds = [lo, *parts, hi]
        # Where none has the pattern's symbol, the child before its place, or the first.
        child = max((i for i, e in enumerate(edges) if e <= pattern[depth]), default=0)
        lo, hi = bounds[child], bounds[child + 1]
    return lo


def _place(pattern: str, common: int, less: bool, at: int, lcp: list[int]) -> int:
    """Suffixes of the leaf that are smaller than the pattern, which shares `common` symbols with the suffix at `at` and is less than it, or not."""
    lo, hi = at, at + 1
    while lo > 0 and lcp[lo] >= common:
        lo -= 1
    while hi < len(lcp) and lcp[hi] >= common:
        hi += 1
    if common == len(pattern):
        return lo
    # [lo, hi) share the symbols; the pattern goes before or behind those that agree with the suffix one symbol further.
    if less:
        first = at
        while first > lo and lcp[first] > common:
            first -= 1
        return first
    last = at + 1
    while last < hi and lcp[last] > common:
        last += 1
    return last


def insertion_points(rows: DataFrame, keys: DataFrame, parts: DataFrame, patterns: DataFrame) -> DataFrame:
    """leaf_rows, patterns (pattern_id, doc_id, pattern) -> pattern_id, doc_id, node_id, slot: suffixes smaller than the pattern in each leaf of its own text.

    Blind search: a descent on the branching symbols of the leaf's trie ends at one suffix, with which alone the pattern is compared, by its
    first symbols and for longer patterns by the stored parts of the text; the place follows from where they part. Where
    no child has the pattern's symbol, the suffix is one of the child before its place, so that the pattern comes right behind that child,
    or parts from all of them at one symbol above.
    """
    asked = rows.join(patterns.select("pattern_id", "doc_id", "pattern"), "doc_id")

    def descend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [_blind(p, x, y, z) for x, y, z, p in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 7)))]
            chosen = [pos[i] for pos, i in zip(batch.column(2).to_pylist(), at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array(chosen, pa.int64())], [*batch.schema.names, "at", "chosen"])

    fields = "doc_id long, node_id long, pos array<long>, lcp array<long>, left array<string>, right array<string>, pattern_id long, pattern string"
    found = asked.select("doc_id", "node_id", "pos", "lcp", "left", "right", "pattern_id", "pattern").mapInArrow(descend, f"{fields}, at long, chosen long")
    found = materialise(found.drop("pos"), "candidates")
    # How far the pattern and the one suffix agree: pieces of KEY symbols through the parts.
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.length("pattern") - 1, F.lit(0)), F.lit(KEY))).alias("from")
    pieces = found.select("pattern_id", "doc_id", "node_id", "pattern", "chosen", piece).withColumn("spot", F.col("chosen") + F.col("from"))
    met = pieces.withColumn("part", F.floor(F.col("spot") / PART)).join(parts, ["doc_id", "part"], "left")
    mine = F.substring("pattern", F.col("from") + 1, F.lit(KEY))
    theirs = F.coalesce(F.substring("body", (F.col("spot") % PART + 1).cast("int"), F.length(mine)), F.lit(""))
    parted = F.when(mine != theirs, F.struct("from", (F.col("from") + common_prefix(mine, theirs)).alias("common"), (mine < theirs).alias("less")))
    told = met.groupBy("pattern_id", "doc_id", "node_id").agg(F.min(parted).alias("p"))
    both = found.join(told, ["pattern_id", "doc_id", "node_id"]).select("pattern_id", "doc_id", "node_id", "pattern", "at", "lcp", F.coalesce("p.common", F.length("pattern").cast("long")).alias("common"), F.coalesce("p.less", F.lit(False)).alias("less"))

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = [_place(p, c, less, at, lcp) for p, at, lcp, c, less in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6, 7)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(slot, pa.int64())], ["pattern_id", "doc_id", "node_id", "slot"])

    return both.mapInArrow(settle, "pattern_id long, doc_id long, node_id long, slot long")


def trie_dot(edges: DataFrame) -> DataFrame:
    """trie_edges -> doc_id, node_id, dot: each leaf's trie as a Graphviz text: nodes with their number of children, edges with first symbol and length."""
    node = F.format_string('"%d:%d" [label="%d"];', "prefix_pos", "lcp", "n_children")
    sign = F.when(F.col("symbol") == "0", F.lit("$")).otherwise(E.decode(F.col("symbol")))
    edge = F.format_string(' "%d:%d" -> "%d:%d" [label="%s%d"];', "parent_pos", "parent_lcp", "prefix_pos", "lcp", sign, F.col("lcp") - F.col("parent_lcp"))
    line = F.concat(node, F.when(F.col("parent_lcp").isNotNull(), edge).otherwise(F.lit("")))
    grouped = edges.select("doc_id", "node_id", F.struct("lcp", "prefix_pos", line.alias("line")).alias("s")).groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return grouped.select("doc_id", "node_id", F.concat(F.lit("digraph { "), F.array_join(F.transform("s", lambda x: x["line"]), " "), F.lit(" }")).alias("dot"))
