"""A stored wavelet tree, and searches that go through its levels.

A sequence (doc_id, idx, val) of values of `bits` bits has, at each level, a bit vector for each node: a
node holds the values with the same leading bits, in the order of idx, and its vector their next bits. Vectors are
stored in strings of CHECKPOINT bits with the ones before them, so a rank is one equi-join and
a count inside one string. A batch of questions goes down level by level: a place becomes
the place among the ones or the zeros, a half-open range the range of those. At the levels of whole symbols a select
table leads from a node's place back to the sequence's index.

Nothing here compares a question with all positions of its sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.functions import encoding as E
from strandex.operators.rankselect import counted_before, right, wavelet_bits
from strandex.operators.suffix import positions
from strandex.sources.tables import materialise

#: Bits of a stored string.
CHECKPOINT = 1024
#: Levels between two tables that cut the plan of a descent.
_STEPS = 6


def _ones(bits: Column) -> Column:
    return F.length(F.replace(bits, F.lit("0"))).cast("long")


def bit_strings(vectors: DataFrame) -> DataFrame:
    """vectors (doc_id, level, node, idx, bit) -> doc_id, level, node, block, bits, ones_before; a block more where the last one is full."""
    group = ["doc_id", "level", "node"]
    place = F.struct((F.col("idx") % CHECKPOINT).alias("i"), F.col("bit").cast("string").alias("b"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["b"]), "")
    rows = materialise(vectors.groupBy(*group, F.floor(F.col("idx") / CHECKPOINT).alias("block")).agg(joined.alias("bits")), "strings")
    full = rows.filter(F.length("bits") == CHECKPOINT).groupBy(*group).agg((F.max("block") + 1).alias("block"))
    ends = full.join(rows.select(*group, "block"), [*group, "block"], "left_anti").withColumn("bits", F.lit(""))
    return counted_before(rows.unionByName(ends), group, _ones(F.col("bits")), "ones_before", order="block").select(*group, "block", "bits", "ones_before")


def wavelet_levels(seq: DataFrame, bits: int) -> DataFrame:
    """The stored levels of the tree of a sequence."""
    return bit_strings(wavelet_bits(seq, bits, few=False))


def select_places(seq: DataFrame, bits: int, levels: list[int]) -> DataFrame:
    """doc_id, level, node, place, idx: where the values below the nodes of the given levels stand."""
    each = seq.withColumn("level", F.explode(F.array(*(F.lit(i).cast("long") for i in levels))))
    each = each.withColumn("node", right(F.col("val"), F.lit(bits) - F.col("level")))
    return counted_before(each, ["doc_id", "level", "node"], F.lit(1), "place").select("doc_id", "level", "node", "place", "idx")


def _ranked(rows: DataFrame, levels: DataFrame, level: int, place: str) -> DataFrame:
    """rows (doc_id, node, place) with _ones, the ones before the place in the node's vector, and _bit, the bit there (null in an absent node)."""
    here = levels.filter(F.col("level") == level).select(F.col("doc_id").alias("_doc"), F.col("node").alias("_node"), F.col("block").alias("_block"), "bits", "ones_before")
    on = (F.col("doc_id") == F.col("_doc")) & (F.col("node") == F.col("_node")) & (F.floor(F.col(place) / CHECKPOINT) == F.col("_block"))
    off = (F.col(place) % CHECKPOINT).cast("int")
    met = rows.join(here, on, "left").withColumn("_ones", F.col("ones_before") + _ones(F.substring("bits", F.lit(1), off)))
    return met.withColumn("_bit", F.substring("bits", off + 1, F.lit(1))).drop("_doc", "_node", "_block", "bits", "ones_before")


def access(levels: DataFrame, bits: int, asked: DataFrame) -> DataFrame:
    """asked (doc_id, idx) -> doc_id, idx, val: the values, from their places alone."""
    at = asked.select("doc_id", "idx", F.lit(0).cast("long").alias("node"), F.col("idx").alias("place"))
    for level in range(bits):
        met = _ranked(at, levels, level, "place")
        one = F.col("_bit") == "1"
        at = met.select("doc_id", "idx", (F.col("node") * 2 + one.cast("long")).alias("node"), F.when(one, F.col("_ones")).otherwise(F.col("place") - F.col("_ones")).alias("place"))
    return at.select("doc_id", "idx", F.col("node").alias("val"))


def _both(state: DataFrame, levels: DataFrame, level: int) -> DataFrame:
    """state (doc_id, node, l, r, ...) with the ones and zeros before l and r: ones_l, zeros_l, ones_r, zeros_r; all 0 in absent nodes."""
    met = state
    for place in ("l", "r"):
        met = _ranked(met, levels, level, place).withColumn(f"ones_{place}", F.coalesce("_ones", F.lit(0).cast("long"))).withColumn(f"zeros_{place}", F.coalesce(F.col(place) - F.col("_ones"), F.lit(0).cast("long")))
        met = met.drop("_ones", "_bit")
    return met


def prefix_ranges(levels: DataFrame, asked: DataFrame, deepest: int) -> DataFrame:
    """asked (doc_id, prefix, depth, l, r, ...) with node, and l, r as places in it: of the values in [l, r) those with the `depth` leading bits of prefix."""
    state = asked.withColumn("node", F.lit(0).cast("long"))
    for level in range(deepest):
        if level and level % _STEPS == 0:  # plans stay short
            state = materialise(state, "descent")
        met = _both(state, levels, level)
        going = F.col("depth") > level
        bit = right(F.col("prefix"), F.greatest(F.col("depth") - level - 1, F.lit(0))).bitwiseAND(1)
        one = bit == 1
        to = lambda p: F.when(~going, F.col(p)).when(one, F.col(f"ones_{p}")).otherwise(F.col(f"zeros_{p}"))  # noqa: E731, B023
        node = F.when(going, F.col("node") * 2 + bit).otherwise(F.col("node"))
        state = met.select(*(c for c in asked.columns if c not in ("l", "r")), node.alias("node"), to("l").cast("long").alias("l"), to("r").cast("long").alias("r"))
    return state


def first_in_range(levels: DataFrame, places: DataFrame, bits: int, asked: DataFrame) -> DataFrame:
    """asked (doc_id, val, signif, l, r) -> doc_id, val, result: of the values in [l, r) that share val's `signif` leading bits the least, and its first index.

    Below val's prefix the zeros' child is taken wherever the range has values there.
    """
    low = right(F.col("val"), F.lit(bits) - F.col("signif"))
    asked = asked.filter("l < r").select("doc_id", "val", "signif", low.alias("prefix"), F.col("signif").alias("depth"), F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))
    state = asked.withColumn("node", F.lit(0).cast("long"))
    for level in range(bits):
        met = _both(state, levels, level)
        wanted = right(F.col("prefix"), F.greatest(F.col("depth") - level - 1, F.lit(0))).bitwiseAND(1) == 1
        one = F.when(F.col("depth") > level, wanted).otherwise(F.col("zeros_l") == F.col("zeros_r"))
        to = lambda p: F.when(one, F.col(f"ones_{p}")).otherwise(F.col(f"zeros_{p}"))  # noqa: E731, B023
        state = met.select("doc_id", "val", "prefix", "depth", (F.col("node") * 2 + one.cast("long")).alias("node"), to("l").alias("l"), to("r").alias("r"))
    leaf = places.filter(F.col("level") == bits).select("doc_id", "node", F.col("place").alias("l"), F.col("idx").alias("result"))
    return state.filter("l < r").join(leaf, ["doc_id", "node", "l"]).select("doc_id", "val", "result")


# Grouped search


def sampled_flags(blocks: DataFrame, d: int) -> DataFrame:
    """The bit vector over the order of all suffixes that tells those at multiples of d, as bit_strings of one node."""
    zero = F.lit(0).cast("long")
    return bit_strings(blocks.select(zero.alias("doc_id"), zero.alias("level"), zero.alias("node"), F.col("sa_pos").alias("idx"), (F.col("pos") % d == 0).cast("long").alias("bit")))


def grouped_sequence(texts: DataFrame, blocks: DataFrame, d: int) -> DataFrame:
    """idx, doc_id, pos, val: the suffixes at multiples of d in the order of all suffixes, their places in d-letter symbols, and the number of the reversed symbol before each."""
    some = blocks.filter(F.col("pos") % d == 0).select("block", "sa_pos", "doc_id", "pos")
    # One row a block.
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = some.groupBy("block").agg(F.count("*").alias("n")).select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("block").orderBy("sa_pos")) - 1
    numbered = some.withColumn("within", within).join(starts, "block").select((F.col("start") + F.col("within")).alias("idx"), "doc_id", "pos")
    before = positions(texts, 1, d).filter(F.col("pos") % d == 0).select("doc_id", "pos", F.lpad("before", d, "0").alias("before"))
    return numbered.join(before, ["doc_id", "pos"]).select("idx", "doc_id", F.floor(F.col("pos") / d).alias("pos"), E.octal(F.reverse("before")).alias("val"))


def grouped_search(index, patterns: DataFrame, d: int) -> DataFrame:
    """pattern_id, doc_id, k, sa_pos, pos: all occurrences of patterns of more than d letters through the index of d-letter symbols.

    For each k the fences give the range of the pattern without its first k letters; a rank turns it into one of
    suffixes at multiples of d, and the tree's levels into those before which the k letters stand, reversed, of which the
    select table tells the places. A suffix at a text's begin has no symbol before it.
    """
    E.check_d(d)
    each = patterns.filter(F.length("pattern") > d).select("pattern_id", "pattern", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("k"))
    cut = materialise(each.select("pattern_id", F.col("k").cast("long").alias("k"), F.col("pattern").substr(F.lit(1), F.col("k")).alias("left"), F.substring("pattern", F.col("k") + 1, F.length("pattern")).alias("right")), "splits")
    # Equal right parts are searched once.
    rights = materialise(cut.groupBy(F.col("right").alias("pattern")).agg(F.min(F.struct("pattern_id", "k")).alias("first")).select("pattern", (F.col("first.pattern_id") * 8 + F.col("first.k")).alias("pattern_id")), "rights")
    found = index.ranges(rights).join(rights, "pattern_id").select(F.col("pattern").alias("right"), "sa_lo", "sa_hi")
    zero = F.lit(0).cast("long")
    state = cut.join(found.filter("sa_lo < sa_hi"), "right").select(zero.alias("doc_id"), zero.alias("node"), "pattern_id", "k", "left", F.col("sa_lo").alias("l"), F.col("sa_hi").alias("r"))
    ranked = _both(state, index.flags(d), 0).select("doc_id", "pattern_id", "k", F.coalesce(E.octal(F.reverse("left")), zero).alias("prefix"), (F.col("k") * 3).alias("depth"), F.col("ones_l").alias("l"), F.col("ones_r").alias("r"))
    ranked = materialise(ranked.filter("l < r"), "grouped-ranges")
    down = prefix_ranges(index.wavelet(d), ranked, 3 * (d - 1)).filter("l < r")
    places = down.select("pattern_id", "k", "depth", "node", F.explode(F.sequence("l", F.col("r") - 1)).alias("place"))
    whole = places.filter("k = 0").select("pattern_id", "k", F.col("place").alias("idx"))
    of = index.select(d).select(F.col("level").alias("depth"), "node", "place", "idx")
    led = places.filter("k > 0").join(of, ["depth", "node", "place"]).select("pattern_id", "k", "idx")
    hits = whole.unionByName(led).join(index.grouped(d).select("idx", "doc_id", "pos"), "idx").filter("k = 0 or pos > 0")
    return hits.join(index.array(d), ["doc_id", "pos"]).select("pattern_id", "doc_id", "k", "sa_pos", (F.col("pos") * d - F.col("k")).alias("pos"))
