"""One order of all suffixes of all texts, stored in blocks, and searches that read the blocks they need.

Texts are strings of any letters, in the order of their code points; nucleotides are such strings too. Suffixes are compared up to the end of their own text; equal ones stand in the order of (doc_id,
pos). A suffix's sa_pos is its place among all. The order is cut into blocks of `rows` places, each
a partition directory of its own, and a tree of fences stands above them: a node is a row with the
first key and the first place of each of at most FAN children, up to one root.

A batch of patterns descends the tree level by level, by one equi-join a level, with two bounds a pattern: the pattern itself and
the end of all that begins with it. Each bound ends in one block; only the blocks that bounds end in are read for
ranges, and only those that the ranges cover for places. Patterns of more than KEY symbols are decided by their first KEY and,
for the suffixes that agree in these, piece by piece through stored parts of the texts.

Backward search needs no keys at all: the symbols before the suffixes, in order, are stored in strings of
CHECKPOINT with the counts of each symbol before them, and every letter of the patterns is one join for the
whole batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.operators.suffix import KEY, PART, PER_SLICE, positions, running_sums
from strandex.sources.tables import materialise

#: Children of a node of the fence tree.
FAN = 256
#: Symbols between two checkpoints of the symbols before the suffixes.
CHECKPOINT = 1024
#: Equal suffixes are numbered in slices of so many doc_ids.
_IDS = 1 << 16
#: Blocks that are named in a filter; more are found by a join.
NAMED = 4096
SYMBOLS = "01234"
#: Comes behind every letter of any text.
LAST = "\U0010ffff"


# The order


def _refined(ranks: DataFrame, h: int) -> DataFrame:
    """ranks (doc_id, pos, rank, open), true to h symbols, made true to 2 h: open rows tie with others and have more to come."""
    tied, done = ranks.filter("open"), ranks.filter("not open")
    ahead = ranks.select("doc_id", (F.col("pos") - h).alias("pos"), F.col("rank").alias("next"))
    paired = materialise(tied.join(ahead, ["doc_id", "pos"], "left").withColumn("next", F.coalesce("next", F.lit(-1).cast("long"))), "pairs")
    # Equal pairs are one row before ties are ordered, so that copies of a text make no large group.
    kinds = paired.groupBy("rank", "next").agg(F.count("*").alias("n"))
    moved = paired.join(running_sums(kinds, ["rank"], "next"), ["rank", "next"])
    return done.unionByName(moved.select("doc_id", "pos", (F.col("rank") + F.col("start")).alias("rank"), ((F.col("n") > 1) & (F.col("next") >= 0)).alias("open")))


def global_order(keys: DataFrame, per_slice: int = PER_SLICE) -> DataFrame:
    """keys (doc_id, pos, key) -> doc_id, pos, sa_pos: the place of each suffix among all suffixes of all texts."""
    kinds = running_sums(keys.groupBy("key").agg(F.count("*").alias("n")), [], "key", per_slice)
    ranks = materialise(keys.join(kinds, "key").select("doc_id", "pos", F.col("start").alias("rank"), ((F.col("n") > 1) & (F.length("key") == KEY)).alias("open")), "ranks")
    h = KEY
    while not ranks.filter("open").isEmpty():
        ranks, h = materialise(_refined(ranks, h), "ranks"), 2 * h
    # What still shares a rank is equal to its end.
    cut = ranks.withColumn("slice", F.floor(F.col("doc_id") / _IDS))
    sizes = cut.groupBy("rank", "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("rank", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("rank", "slice").orderBy("doc_id", "pos")) - 1
    return cut.withColumn("within", within).join(starts, ["rank", "slice"]).select("doc_id", "pos", (F.col("rank") + F.col("start") + F.col("within")).alias("sa_pos"))


def blocks_of(keys: DataFrame, order: DataFrame, rows: int) -> DataFrame:
    """block, sa_pos, doc_id, pos, key, before: the suffixes in order with their first KEY symbols and the symbol before them (the terminator before a text's begin)."""
    before = F.when(F.col("before") == "", F.lit("0")).otherwise(F.col("before")).alias("before")
    placed = keys.select("doc_id", "pos", "key", before).join(order, ["doc_id", "pos"])
    return placed.select(F.floor(F.col("sa_pos") / rows).alias("block"), "sa_pos", "doc_id", "pos", "key", "before")


def fence_tree(blocks: DataFrame) -> DataFrame:
    """level, node, children (child, first key, begin) of all levels above the blocks; the root is node 0 of the highest."""
    below = blocks.groupBy("block").agg(F.min("key").alias("first"), F.min("sa_pos").alias("begin")).withColumnRenamed("block", "child")
    out, level = None, 1
    while True:
        child = F.struct("child", "first", "begin")
        nodes = below.groupBy(F.floor(F.col("child") / FAN).alias("node")).agg(F.array_sort(F.collect_list(child)).alias("children"))
        nodes = materialise(nodes.select(F.lit(level).alias("level"), "node", "children"), "fences")
        out = nodes if out is None else out.unionByName(nodes)
        if nodes.count() <= 1:
            return out
        below, level = nodes.select(F.col("node").alias("child"), F.col("children")[0]["first"].alias("first"), F.col("children")[0]["begin"].alias("begin")), level + 1


# Search


def _descended(bounds: DataFrame, fences: DataFrame) -> DataFrame:
    """bounds (..., bound) with block and begin: the last block whose first key is below the bound (or the first block), and its first place."""
    top = fences.agg(F.max("level")).first()[0]
    at = bounds.withColumn("node", F.lit(0).cast("long"))
    for level in range(top or 0, 0, -1):
        nodes = fences.filter(F.col("level") == level).select("node", "children")
        below = F.filter("children", lambda c: c["first"] < F.col("bound"))
        child = F.when(F.size(below) > 0, F.element_at(below, -1)).otherwise(F.col("children")[0])
        at = at.join(nodes, "node").withColumn("_c", child).withColumn("node", F.col("_c.child")).withColumn("begin", F.col("_c.begin")).drop("children", "_c")
    return at.withColumnRenamed("node", "block")


def only(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the blocks named in wanted (block): a partition filter, so that no other directory is listed or read."""
    named = [r.block for r in wanted.select("block").distinct().limit(NAMED + 1).collect()]
    if len(named) <= NAMED:
        return blocks.filter(F.col("block").isin(named)) if named else blocks.limit(0)
    return blocks.join(wanted.select("block").distinct(), "block", "left_semi")


def _bounds(patterns: DataFrame) -> DataFrame:
    """pattern_id, side, bound: below which keys are smaller than the pattern (0), or do not come after all that begins with it (1)."""
    head = F.substring("pattern", 1, KEY)
    return patterns.select("pattern_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), head.alias("bound")), F.struct(F.lit(1).alias("side"), F.concat(head, F.lit(LAST)).alias("bound")))).alias("b")).select("pattern_id", "b.side", "b.bound")


def head_ranges(blocks: DataFrame, fences: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_id, sa_lo, sa_hi by the first KEY symbols of the patterns."""
    asked = materialise(_descended(_bounds(patterns), fences), "bounds")
    keys = only(blocks, asked).select("block", "key", F.lit(1).alias("w"), F.lit(None).cast("long").alias("pattern_id"), F.lit(2).alias("side"), F.lit(None).cast("long").alias("begin"))
    mine = asked.select("block", F.col("bound").alias("key"), F.lit(0).alias("w"), "pattern_id", "side", "begin")
    # A bound comes before the keys that equal it.
    before = Window.partitionBy("block").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = keys.unionByName(mine).withColumn("at", F.sum("w").over(before)).filter("side < 2")
    place = F.col("begin") + F.col("at")
    return at.groupBy("pattern_id").agg(F.min(F.when(F.col("side") == 0, place)).alias("sa_lo"), F.min(F.when(F.col("side") == 1, place)).alias("sa_hi"))


def at_places(blocks: DataFrame, rows: int, ranges: DataFrame, *columns: str) -> DataFrame:
    """ranges (pattern_id, sa_lo, sa_hi) -> pattern_id, sa_pos, doc_id, pos and the further columns of blocks: the suffixes of each range."""
    some = ranges.filter("sa_lo < sa_hi")
    each = some.withColumn("block", F.explode(F.sequence(F.floor(F.col("sa_lo") / rows), F.floor((F.col("sa_hi") - 1) / rows))))
    first, last = F.greatest(F.col("sa_lo"), F.col("block") * rows), F.least(F.col("sa_hi"), (F.col("block") + 1) * rows) - 1
    wanted = each.select("pattern_id", "block", F.explode(F.sequence(first, last)).alias("sa_pos"))
    return wanted.join(only(blocks, each).select("block", "sa_pos", "doc_id", "pos", *columns), ["block", "sa_pos"]).select("pattern_id", "sa_pos", "doc_id", "pos", *columns)


def parts_of(texts: DataFrame) -> DataFrame:
    """doc_id, part, body: the texts in parts of PART symbols, each with the KEY symbols that follow."""
    cut = texts.select("doc_id", F.regexp_extract_all("enc", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)).alias("parts"))
    following = F.concat(F.slice("parts", F.lit(2), F.greatest(F.size("parts"), F.lit(1))), F.array(F.lit("")))
    each = cut.select("doc_id", F.posexplode(F.arrays_zip(F.col("parts").alias("here"), following.alias("next"))).alias("part", "p"))
    return each.select("doc_id", F.col("part").cast("long").alias("part"), F.concat("p.here", F.substring("p.next", 1, KEY)).alias("body"))


def part_positions(parts: DataFrame) -> DataFrame:
    """parts_of() -> doc_id, pos, key, before: every position with its first KEY symbols and the symbol before it, from parts alone."""
    lead = parts.select("doc_id", (F.col("part") + 1).alias("part"), F.substring("body", PART, 1).alias("lead"))
    each = parts.join(lead, ["doc_id", "part"], "left").withColumn("i", F.explode(F.sequence(F.lit(0), F.least(F.length("body"), F.lit(PART)) - 1)))
    before = F.when(F.col("i") == 0, F.coalesce("lead", F.lit(""))).otherwise(F.substring("body", F.col("i"), F.lit(1)))
    return each.select("doc_id", (F.col("part") * PART + F.col("i")).alias("pos"), F.substring("body", F.col("i") + 1, F.lit(KEY)).alias("key"), before.alias("before"))


def _decided(found: DataFrame, patterns: DataFrame, parts: DataFrame) -> DataFrame:
    """found (pattern_id, sa_pos, doc_id, pos), places that agree with long patterns in KEY symbols -> these, with equal and below (the suffix is smaller)."""
    piece = F.explode(F.sequence(F.lit(KEY), F.length("pattern") - 1, F.lit(KEY))).alias("at")
    pieces = patterns.select("pattern_id", "pattern", piece).select("pattern_id", "at", F.substring("pattern", F.col("at") + 1, F.lit(KEY)).alias("piece"))
    each = found.join(pieces, "pattern_id").withColumn("from", F.col("pos") + F.col("at"))
    met = each.withColumn("part", F.floor(F.col("from") / PART)).join(parts, ["doc_id", "part"], "left")
    here = F.coalesce(F.substring("body", (F.col("from") % PART + 1).cast("int"), F.length("piece")), F.lit(""))
    differs = F.when(here != F.col("piece"), F.struct("at", (here < F.col("piece")).alias("less")))
    first = met.groupBy("pattern_id", "sa_pos", "doc_id", "pos").agg(F.min(differs).alias("d"))
    return first.select("pattern_id", "sa_pos", "doc_id", "pos", F.col("d").isNull().alias("equal"), F.coalesce("d.less", F.lit(False)).alias("below"))


def ranges(blocks: DataFrame, rows: int, fences: DataFrame, parts: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_id, sa_lo, sa_hi: the half-open range of each pattern, of any length; empty, at its place in the order, where it is absent."""
    heads = head_ranges(blocks, fences, patterns)
    long = patterns.filter(F.length("pattern") > KEY)
    if long.isEmpty():
        return heads
    heads = materialise(heads, "ranges")
    tied = at_places(blocks, rows, heads.join(long.select("pattern_id"), "pattern_id"))
    told = _decided(tied, long, parts).groupBy("pattern_id").agg(F.sum(F.col("below").cast("long")).alias("below"), F.sum(F.col("equal").cast("long")).alias("equal"))
    none = F.lit(0).cast("long")
    exact = long.select("pattern_id").join(heads, "pattern_id").join(told, "pattern_id", "left").select("pattern_id", (F.col("sa_lo") + F.coalesce("below", none)).alias("sa_lo"), F.coalesce("equal", none).alias("n"))
    return heads.join(long, "pattern_id", "left_anti").unionByName(exact.select("pattern_id", "sa_lo", (F.col("sa_lo") + F.col("n")).alias("sa_hi")))


# Backward search


def checkpoints(blocks: DataFrame) -> DataFrame:
    """chunk, symbols, c0 .. c4: the symbols before CHECKPOINT suffixes in order, and how often each symbol stands before earlier ones; the last chunk may be empty."""
    place = F.struct((F.col("sa_pos") % CHECKPOINT).alias("i"), "before")
    strings = blocks.groupBy(F.floor(F.col("sa_pos") / CHECKPOINT).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["before"]), "").alias("symbols"))
    rows = materialise(strings, "symbols")
    end = rows.agg(F.coalesce(F.max("chunk"), F.lit(-1)).alias("last")).select((F.col("last") + 1).alias("chunk"), F.lit("").alias("symbols"))
    each = rows.unionByName(end).withColumn("slice", F.floor(F.col("chunk") / 4096))
    count = lambda c: F.length("symbols") - F.length(F.replace("symbols", F.lit(c)))
    each = each.select("chunk", "slice", "symbols", *(count(c).cast("long").alias(f"n{c}") for c in SYMBOLS))
    inside = Window.partitionBy("slice").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # One row for 4096 * CHECKPOINT suffixes.
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = each.groupBy("slice").agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in SYMBOLS))
    starts = sums.select("slice", *(F.coalesce(F.sum(f"n{c}").over(earlier), F.lit(0)).alias(f"s{c}") for c in SYMBOLS))
    within = each.select("*", *(F.coalesce(F.sum(f"n{c}").over(inside), F.lit(0)).alias(f"w{c}") for c in SYMBOLS))
    return within.join(starts, "slice").select("chunk", "symbols", *((F.col(f"s{c}") + F.col(f"w{c}")).alias(f"c{c}") for c in SYMBOLS))


def _of(symbol: Column, values: dict[str, Column]) -> Column:
    out = F.lit(None).cast("long")
    for c, value in values.items():
        out = F.when(symbol == c, value).otherwise(out)
    return out


def backward_ranges(checked: DataFrame, patterns: DataFrame) -> DataFrame:
    """checked: checkpoints(). pattern_id, sa_lo, sa_hi of patterns of letters: from the last letter to the first, one join a letter."""
    counts = checked.agg(*(F.sum(F.length("symbols") - F.length(F.replace("symbols", F.lit(c)))).cast("long").alias(c) for c in SYMBOLS)).first()
    # Every symbol of the texts stands before one suffix, so these are also the counts of suffixes by first symbol.
    total = {c: counts[c] or 0 for c in SYMBOLS}
    first = {c: sum(total[x] for x in SYMBOLS if x < c) for c in SYMBOLS}
    n = sum(total.values())
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("at")), F.struct(F.lit(1).alias("side"), F.lit(n).cast("long").alias("at")))).alias("b")
    state = patterns.select("pattern_id", "pattern", side).select("pattern_id", "pattern", "b.side", "b.at")
    longest = patterns.agg(F.max(F.length("pattern"))).first()[0] or 0
    for turn in range(longest):
        if turn and turn % 4 == 0:  # plans and their code stay short
            state = materialise(state, "steps")
        letter = F.substring("pattern", F.length("pattern") - turn, F.lit(1))
        going = F.length("pattern") > turn
        met = state.withColumn("chunk", F.floor(F.col("at") / CHECKPOINT)).join(checked, "chunk")
        inside = F.substring("symbols", F.lit(1), (F.col("at") % CHECKPOINT).cast("int"))
        rank = _of(letter, {c: F.lit(first[c]) + F.col(f"c{c}") + F.length(inside) - F.length(F.replace(inside, F.lit(c))) for c in SYMBOLS})
        state = met.select("pattern_id", "pattern", "side", F.when(going, rank).otherwise(F.col("at")).cast("long").alias("at"))
    of = lambda s: F.min(F.when(F.col("side") == s, F.col("at")))
    return state.groupBy("pattern_id").agg(of(0).alias("sa_lo"), of(1).alias("sa_hi"))
