"""Suffix arrays by prefix doubling, their checks, common prefixes and Burrows-Wheeler sequences.

A text is a row (doc_id, enc); a suffix array is a table (doc_id, sa_pos, pos). A suffix's rank is the
number of suffixes of its text that are smaller; while suffixes tie it is that of
the first of them. The first ranks come from 64 symbols; each round looks up the rank `h`
symbols further on, re-ranks inside the ties and doubles h, until nothing ties. The shorter
of two suffixes that agree to its end is the smaller (rank -1 beyond the end).

No window spans a whole text or tie: in every round the different keys are dealt to slices by sampled
splitters, with the slices' sizes summed beforehand, and rounds after the first only sort inside ties. One
long text is therefore as parallel as many short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.functions import encoding as E
from strandex.sources.tables import materialise

#: Symbols that searches compare without the text, and those that the first ranks compare.
FIRST, KEY = 21, 64
#: Length of the parts that texts are cut into; more than KEY.
PART = 1024
#: Different keys that are sorted in one slice.
PER_SLICE = 1 << 20


def positions(texts: DataFrame, width: int = FIRST, back: int = 0) -> DataFrame:
    """One row for every position of each text, with the first `width` symbols of the suffix there, and, if asked for, at most `back` symbols before it."""
    # A substring counts its place from the text's begin, so the text is first cut into short parts, in one pass.
    cut = texts.select("doc_id", F.regexp_extract_all("enc", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)).alias("parts"))
    following = F.concat(F.slice("parts", F.lit(2), F.greatest(F.size("parts"), F.lit(1))), F.array(F.lit("")))
    previous = F.concat(F.array(F.lit("")), F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0))))
    each = cut.select("doc_id", F.posexplode(F.arrays_zip(F.col("parts").alias("here"), following.alias("next"), previous.alias("prev"))).alias("part", "p"))
    tail = F.expr(f"right(p.prev, {back})")
    each = each.select("doc_id", "part", F.length("p.here").alias("size"), F.length(tail).alias("lead"), F.concat(tail, "p.here", F.substring("p.next", 1, width)).alias("body"))
    # Only the key leaves this stage, not the text.
    each = each.select("doc_id", "part", "body", "lead", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))
    at = F.col("lead") + F.col("i")
    out = each.select("doc_id", (F.col("part").cast("long") * PART + F.col("i")).alias("pos"), F.substring("body", at + 1, F.lit(width)).alias("key"), at.alias("at"), "body")
    if not back:
        return out.drop("at", "body")
    first = F.greatest(F.col("at") - back, F.lit(0))
    return out.select("doc_id", "pos", "key", F.substring("body", first + 1, F.col("at") - first).alias("before"))


def joined_positions(texts: DataFrame, width: int = FIRST) -> DataFrame:
    """positions() of one text, doc_id 0: all texts in the order of (doc_id, enc), without their terminators, and one at the end.

    No row holds more than one text: each gets its offset, sums inside ranges of doc_id plus the
    ranges' own sums, and is cut at multiples of PART, where the cuts of neighbours meet in one row.
    """
    body = texts.select("doc_id", F.expr("substring(enc, 1, length(enc) - 1)").alias("body")).filter("body <> ''")
    cut = materialise(body.repartitionByRange("doc_id", "body").withColumn("slice", F.spark_partition_id()), "texts")
    size = F.length("body").cast("long")
    nothing = F.lit(0).cast("long")
    # One row a range.
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("slice").agg(F.sum(size).alias("size")).select("slice", F.coalesce(F.sum("size").over(earlier), nothing).alias("start"))
    inside = Window.partitionBy("slice").orderBy("doc_id", "body").rowsBetween(Window.unboundedPreceding, -1)
    within = cut.withColumn("within", F.coalesce(F.sum(size).over(inside), nothing))
    placed = within.join(F.broadcast(starts), "slice").select((F.col("start") + F.col("within")).alias("at"), "body")
    end = cut.agg(F.coalesce(F.sum(size), nothing).alias("at")).select("at", F.lit("0").alias("body"))
    # Blanks before a text's begin make its cuts fall on multiples of PART.
    filled = F.concat(F.repeat(F.lit(" "), F.pmod("at", F.lit(PART)).cast("int")), F.col("body"))
    pieces = placed.unionByName(end).select("at", F.posexplode(F.regexp_extract_all(filled, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))).alias("i", "piece"))
    pieces = pieces.select((F.floor(F.col("at") / PART) + F.col("i")).alias("part"), F.struct("at", F.ltrim("piece").alias("piece")).alias("p"))
    # A text that began earlier has the smaller offset.
    met = pieces.groupBy("part").agg(F.array_sort(F.collect_list("p")).alias("p"))
    parts = materialise(met.select("part", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("here")), "parts")
    following = parts.select((F.col("part") - 1).alias("part"), F.substring("here", 1, width).alias("next"))
    each = parts.join(following, "part", "left").select("part", F.length("here").alias("size"), F.concat("here", F.coalesce("next", F.lit(""))).alias("body"))
    each = each.select("part", "body", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))
    return each.select(nothing.alias("doc_id"), (F.col("part") * PART + F.col("i")).alias("pos"), F.substring("body", F.col("i") + 1, F.lit(width)).alias("key"))


def running_sums(sizes: DataFrame, group: list[str], key: str, per_slice: int = PER_SLICE) -> DataFrame:
    """sizes (group..., key, n; a row for each) with start: the sum of n over the smaller keys of its group.

    Rows are dealt to slices by splitters that Spark samples from the very rows, group and key together. As no two are
    equal, slices are even whatever the keys begin with and however many rows one group has.
    """
    rows = materialise(sizes, "sizes")
    slices = max(1, rows.count() // per_slice)
    if slices == 1:
        smaller = Window.partitionBy(*group).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("start", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    cut = materialise(rows.repartitionByRange(slices, *group, key).withColumn("slice", F.spark_partition_id()), "slices")
    # One row for each group in a slice.
    earlier = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*group, "slice").agg(F.sum("n").alias("n")).select(*group, "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*group, "slice").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    within = cut.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return within.join(starts, [*group, "slice"]).select(*group, key, "n", (F.col("before") + F.col("within")).alias("start"))


def first_ranks(keys: DataFrame, per_slice: int = PER_SLICE) -> DataFrame:
    """keys (doc_id, pos, key) -> doc_id, pos, rank, ties: ranks by the key.

    Equal keys of a text are one row before they are sorted.
    """
    kinds = running_sums(keys.groupBy("doc_id", "key").agg(F.count("*").alias("n")), ["doc_id"], "key", per_slice)
    return keys.join(kinds, ["doc_id", "key"]).select("doc_id", "pos", F.col("start").alias("rank"), F.col("n").alias("ties"))


def refine(ranks: DataFrame, h: int, per_slice: int = PER_SLICE) -> DataFrame:
    """One doubling round: ranks true to h symbols become true to 2 h.

    Equal pairs of ranks are one row before ties are ordered, and a large tie is ordered in many slices.
    """
    tied, done = ranks.filter("ties > 1"), ranks.filter("ties = 1")
    ahead = ranks.select("doc_id", (F.col("pos") - h).alias("pos"), F.col("rank").alias("next"))
    paired = materialise(tied.join(ahead, ["doc_id", "pos"], "left").withColumn("next", F.coalesce("next", F.lit(-1))), "pairs")
    kinds = running_sums(paired.groupBy("doc_id", "rank", "next").agg(F.count("*").alias("n")), ["doc_id", "rank"], "next", per_slice)
    moved = paired.drop("ties").join(kinds, ["doc_id", "rank", "next"])
    return done.unionByName(moved.select("doc_id", "pos", (F.col("rank") + F.col("start")).alias("rank"), F.col("n").alias("ties")))


def rank_rounds(texts: DataFrame, joined: bool = False, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """ranks (doc_id, pos, rank) of every suffix, and ties (h, doc_id, pos, rank): the suffixes that tie in their first h symbols, for h of each round.

    Two suffixes agree in h symbols exactly if both are among the ties of h with one rank.
    """
    if keys is None:
        keys = joined_positions(texts, KEY) if joined else positions(texts, KEY)
    ranks, h, ties = materialise(first_ranks(keys), "ranks"), KEY, None
    while True:
        tied = ranks.filter("ties > 1").select(F.lit(h).cast("long").alias("h"), "doc_id", "pos", "rank")
        ties = tied if ties is None else ties.unionByName(tied)
        if tied.isEmpty():
            return ranks.select("doc_id", "pos", "rank"), ties
        ranks, h = materialise(refine(ranks, h), "ranks"), 2 * h


def suffix_ranks(texts: DataFrame, joined: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """doc_id, pos, rank of every suffix: the inverse of the suffix array; joined takes all texts as one, keys are positions(texts, KEY)."""
    return rank_rounds(texts, joined, keys)[0]


def suffix_array(texts: DataFrame, d: int = 1, ranks: DataFrame | None = None) -> DataFrame:
    """doc_id, sa_pos, pos: the suffix array in units of d symbols.

    Groups of symbols compare as the symbols do, so the array for d is that of single
    symbols without the positions between, numbered anew inside slices of ranks.
    """
    E.check_d(d)
    ranks = suffix_ranks(texts) if ranks is None else ranks
    if d == 1:
        return ranks.select("doc_id", F.col("rank").alias("sa_pos"), "pos")
    cut = ranks.filter(F.col("pos") % d == 0).withColumn("slice", F.floor(F.col("rank") / 65536))
    sizes = cut.groupBy("doc_id", "slice").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("doc_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("doc_id", "slice", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("doc_id", "slice").orderBy("rank")) - 1
    return cut.withColumn("within", within).join(starts, ["doc_id", "slice"]).select("doc_id", (F.col("start") + F.col("within")).alias("sa_pos"), F.floor(F.col("pos") / d).alias("pos"))


def rank_round(texts: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, pos, rank0, rank1: dense ranks by one key, and those `width` symbols further on (-1 beyond the end).

    The different keys of a text, few for a small width, meet its parts of PART symbols: no row of a position is joined.
    """
    cut = texts.select("doc_id", F.regexp_extract_all("enc", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)).alias("parts"))
    following = F.concat(F.slice("parts", F.lit(2), F.greatest(F.size("parts"), F.lit(1))), F.array(F.lit("")))
    each = cut.select("doc_id", F.posexplode(F.arrays_zip(F.col("parts").alias("here"), following.alias("next"))).alias("part", "p"))
    body = F.concat("p.here", F.substring("p.next", 1, 2 * width - 1))
    each = each.select("doc_id", "part", F.length("p.here").alias("size"), body.alias("body"))
    key = lambda i: F.substring("body", i, F.lit(width))
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("size")), key))
    kinds = each.select("doc_id", F.explode(own).alias("key")).groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("kinds"))
    met = each.join(kinds, "doc_id").select("doc_id", "part", "body", "kinds", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))
    rank = lambda i: F.array_position("kinds", key(i + 1)).cast("long") - 1
    return met.select("doc_id", (F.col("part").cast("long") * PART + F.col("i")).alias("pos"), rank(F.col("i")).alias("rank0"), rank(F.col("i") + width).alias("rank1"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings of at most KEY symbols."""
    room = F.least(F.length(a), F.length(b)).cast("int")

    def step(size: Column, power: Column) -> Column:
        more = size + power
        return F.when((more <= room) & (F.substring(a, F.lit(1), more) == F.substring(b, F.lit(1), more)), more).otherwise(size)

    return F.aggregate(F.array(*(F.lit(1 << i) for i in range(KEY.bit_length() - 1, -1, -1))), F.lit(0), step).cast("long")


def with_common_prefix(pairs: DataFrame, keys: DataFrame, ties: DataFrame) -> DataFrame:
    """pairs (doc_id, prev, pos, ...) with lcp, the common prefix of the suffixes at prev and pos; null if prev is null.

    keys (doc_id, pos, key) are the first KEY symbols of all suffixes, ties those of rank_rounds(). Pairs that agree in KEY symbols go on by
    the ties of each round, the largest first, and are at most one step long in each, as twice its symbols tie in a larger round
    or nowhere; the rest is less than KEY symbols. No text is compared, so equal letters cost no more than others.
    """
    one, two = F.col("prev") + F.col("lcp"), F.col("pos") + F.col("lcp")

    def looked_up(rows: DataFrame, table: DataFrame, column: str) -> DataFrame:
        known = table.select(F.col("doc_id").alias("_doc"), F.col("pos").alias("_pos"), F.col(column).alias("_v"))
        for place, name in ((one, "_a"), (two, "_b")):
            rows = rows.join(known.withColumnRenamed("_v", name), (F.col("doc_id") == F.col("_doc")) & (place == F.col("_pos")), "left").drop("_doc", "_pos")
        return rows

    start = pairs.withColumn("lcp", F.lit(0).cast("long"))
    met = materialise(looked_up(start, keys, "key").withColumn("lcp", common_prefix(F.col("_a"), F.col("_b"))).drop("_a", "_b"), "prefixes")
    met = met.withColumn("lcp", F.when(F.col("prev").isNotNull(), F.col("lcp")))
    whole = F.coalesce(F.col("lcp") == KEY, F.lit(False))
    rounds = [r.h for r in ties.select("h").distinct().orderBy(F.desc("h")).collect()]  # one a doubling
    if not rounds:
        return met
    long = met.filter(whole).withColumn("lcp", F.lit(0).cast("long"))
    for h in rounds:
        step = looked_up(long, ties.filter(F.col("h") == h), "rank")
        grown = F.when(F.col("_a") == F.col("_b"), F.col("lcp") + h).otherwise(F.col("lcp"))
        long = materialise(step.withColumn("lcp", grown).drop("_a", "_b"), "prefixes")
    rest = looked_up(long, keys, "key")
    long = rest.withColumn("lcp", F.col("lcp") + F.coalesce(common_prefix(F.col("_a"), F.col("_b")), F.lit(0))).drop("_a", "_b")
    return met.filter(~whole).unionByName(long)


def with_lower_neighbour(array: DataFrame) -> DataFrame:
    """array with prev, the position of the suffix before each in order (null for the first)."""
    before = array.select("doc_id", (F.col("sa_pos") + 1).alias("sa_pos"), F.col("pos").alias("prev"))
    return array.join(before, ["doc_id", "sa_pos"], "left")


def lcp_array(array: DataFrame, keys: DataFrame, ties: DataFrame) -> DataFrame:
    """doc_id, sa_pos, pos, lcp: common prefix with the suffix before (0 for the first)."""
    found = with_common_prefix(with_lower_neighbour(array), keys, ties)
    return found.select("doc_id", "sa_pos", "pos", F.coalesce("lcp", F.lit(0).cast("long")).alias("lcp"))


def inversions(texts: DataFrame, array: DataFrame) -> DataFrame:
    """doc_id, n, inversions: neighbours of the array in the wrong order.

    Two suffixes are in order if their first symbols are, or if these are equal and the suffixes one symbol further on
    stand in order in the array: no suffix is compared as a whole. There are none exactly if the array is sorted; in an unsorted one a
    wrong pair also shows at the neighbours of which it is the rest.
    """
    place = array.select("doc_id", F.col("sa_pos").alias("after"), (F.col("pos") - 1).alias("at"))
    symbol = positions(texts, 1).select("doc_id", F.col("pos").alias("at"), F.col("key").alias("symbol"))
    known = materialise(symbol.join(place, ["doc_id", "at"], "left").withColumn("after", F.coalesce("after", F.lit(-1).cast("long"))), "symbols")
    of = lambda p: known.select("doc_id", F.col("at").alias(p), F.struct("symbol", "after").alias(f"{p}_key"))
    joined = with_lower_neighbour(array).join(of("pos"), ["doc_id", "pos"]).join(of("prev"), ["doc_id", "prev"], "left")
    wrong = F.coalesce((F.col("prev_key") >= F.col("pos_key")).cast("long"), F.lit(0).cast("long"))
    return joined.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(wrong).alias("inversions"))


def suffix_heads(texts: DataFrame, array: DataFrame, d: int) -> DataFrame:
    """doc_id, sa_pos, pos, head, before: the first 64 symbols of each suffix of the array, and at most d symbols before it."""
    full = texts.select("doc_id", E.meta_padded(F.col("enc"), d).alias("enc"))
    each = positions(full, KEY, d).filter(F.col("pos") % d == 0)
    return array.join(each.select("doc_id", F.floor(F.col("pos") / d).alias("pos"), F.col("key").alias("head"), "before"), ["doc_id", "pos"]).select("doc_id", "sa_pos", "pos", "head", "before")


def bwt(texts: DataFrame, array: DataFrame, d: int = 1) -> DataFrame:
    """doc_id, sa_pos, pos, rev_bwt: the octal number of the reversed symbol before each suffix, cyclic."""
    full = E.meta_padded(F.col("enc"), d)
    each = positions(texts.select("doc_id", full.alias("enc")), 1, d).filter(F.col("pos") % d == 0).select("doc_id", F.floor(F.col("pos") / d).alias("pos"), "before")
    # Before a text's begin comes its end.
    ends = texts.select("doc_id", F.lit(0).cast("long").alias("pos"), F.expr("right(enc, 1)") if d == 1 else F.right(full, F.lit(d)).alias("before"))
    ends = ends.toDF("doc_id", "pos", "before")
    joined = array.join(each.filter("pos > 0").unionByName(ends), ["doc_id", "pos"])
    return joined.select("doc_id", "sa_pos", "pos", E.octal(F.reverse("before")).alias("rev_bwt"))
