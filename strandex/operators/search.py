"""Batch pattern search: ranges, occurrences, offsets of grouped symbols.

Patterns (pattern_id, doc_id, pattern) are a table; an index is all suffixes of all texts, by their first 64 symbols: a
stored table, or cut from the texts. Candidates come from an equi-join on the patterns' first symbols, as many
as their length class has, never from a comparison of all with all, and are checked on the key or the text. Ranges need no join at all: patterns are sorted in among the
suffixes' keys, bucket by bucket, and suffixes are counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.functions import encoding as E
from strandex.operators.fences import parts_of
from strandex.operators.suffix import FIRST, KEY, PART, positions, suffix_heads, suffix_ranks
from strandex.sources.tables import materialise


def sample_patterns(texts: DataFrame, length: int = 16) -> DataFrame:
    """pattern_id, doc_id, start, pattern: one substring of each text that is long enough, at an arithmetic start."""
    start = F.pmod(F.col("doc_id") * 7919 + 13, F.col("n") - length)
    some = texts.filter(F.col("n") > length + 1).withColumn("start", start)
    return some.select(F.col("doc_id").alias("pattern_id"), "doc_id", "start", F.substring("enc", (F.col("start") + 1).cast("int"), F.lit(length)).alias("pattern"))


def mutated(patterns: DataFrame) -> DataFrame:
    """The patterns with their middle symbol replaced by the next letter."""
    at = F.floor(F.length("pattern") / 2).cast("int")
    other = (F.substring("pattern", at + 1, F.lit(1)).cast("int") % 4 + 1).cast("string")
    return patterns.withColumn("pattern", F.concat(F.substring("pattern", F.lit(1), at), other, F.substring("pattern", at + 2, F.length("pattern"))))


#: Values of a hash by which places are told that no pattern can have.
CELLS = 1 << 22
#: Symbols on which patterns of at least that length are joined; shorter ones by their own length.
CLASSES = (8, 12, 16, FIRST)


def _class(length: Column) -> Column:
    """How many symbols a pattern is joined on."""
    return F.greatest(F.when(length < CLASSES[0], length), *(F.when(length >= n, F.lit(n)) for n in CLASSES))


def _lengths(parts: DataFrame, name: str) -> list[int]:
    """The join lengths of the patterns at hand, at most 11."""
    rows = parts.filter(F.col(name).isNotNull()).select(_class(F.length(name)).alias("n")).distinct().collect()
    return sorted(r["n"] for r in rows) or [FIRST]


def _with_grams(rows: DataFrame, name: str, lengths: list[int]) -> DataFrame:
    """rows with gram, the beginning of a column, once for each length that it has."""
    each = [F.when(F.length(name) >= n, F.substring(name, 1, n)) for n in lengths]
    gram = each[0] if len(each) == 1 else F.explode(F.array(*each))
    return rows.withColumn("gram", gram).filter("gram is not null")


def _asked(parts: DataFrame, name: str, *columns: str) -> DataFrame:
    """The distinct patterns with the symbols they are joined on."""
    return parts.select(*columns, name, F.substring(name, F.lit(1), _class(F.length(name))).alias("gram"))


def keyed_occurrences(texts: DataFrame, patterns: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """pattern_id, doc_id, pos, key: every place of every pattern in every text, with the suffix's first 64 symbols."""
    lengths = _lengths(patterns, "pattern")
    if keys is None:
        # Only a hash of the joined symbols is shuffled with a place; the 64 come from the parts of the texts, for those that met.
        hashed = lambda rows: rows.withColumn("gram", F.xxhash64("gram"))
        rows, asked = hashed(_with_grams(positions(texts, max(lengths)), "key", lengths).select("doc_id", "pos", "gram")), hashed(_asked(patterns, "pattern", "pattern_id"))
        # Places whose hash falls into a cell without a pattern go no further; there are CELLS at most to broadcast, however many patterns.
        cell = F.pmod("gram", F.lit(CELLS)).alias("cell")
        some = rows.withColumn("cell", cell).join(F.broadcast(asked.select(cell).distinct()), "cell", "left_semi").drop("cell")
        met = some.join(asked, "gram").withColumn("part", F.floor(F.col("pos") / PART))
        found = met.join(parts_of(texts), ["doc_id", "part"]).withColumn("key", F.substring("body", (F.col("pos") % PART + 1).cast("int"), F.lit(KEY)))
    else:
        found = _with_grams(keys.select("doc_id", "pos", "key"), "key", lengths).join(_asked(patterns, "pattern", "pattern_id"), "gram")
    found = found.filter(F.col("key").startswith(F.substring("pattern", 1, KEY)))
    short = found.filter(F.length("pattern") <= KEY).select("pattern_id", "doc_id", "pos", "key")
    if patterns.filter(F.length("pattern") > KEY).isEmpty():
        return short
    long = found.filter(F.length("pattern") > KEY).join(texts.select("doc_id", "enc"), "doc_id")
    here = F.expr("substring(enc, cast(pos as int) + 1, length(pattern)) = pattern")
    return short.unionByName(long.filter(here).select("pattern_id", "doc_id", "pos", "key"))


def occurrences(texts: DataFrame, patterns: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """pattern_id, doc_id, pos: every place of every pattern in every text."""
    return keyed_occurrences(texts, patterns, keys).select("pattern_id", "doc_id", "pos")


def counts(texts: DataFrame, patterns: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """pattern_id, n: occurrences of each pattern in all texts, 0 where there is none."""
    found = occurrences(texts, patterns, keys).groupBy("pattern_id").agg(F.count("*").alias("n"))
    return patterns.select("pattern_id").join(found, "pattern_id", "left").select("pattern_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def ranges(texts: DataFrame, patterns: DataFrame, bucket: int = 5, keys: DataFrame | None = None) -> DataFrame:
    """pattern_id, sa_lo, sa_hi: the half-open range of each pattern among the sorted suffixes of all texts.

    sa_lo counts the suffixes that are smaller than the pattern, also where it is
    absent. Patterns are sorted by their first 21 symbols, and longer ones are compared with the
    texts where those agree. Patterns enter the sort twice, once before
    and once after all suffixes that begin with them ('~' is above all digits).
    """
    suffixes = positions(texts, KEY) if keys is None else keys
    keys = suffixes.select(F.substring("key", 1, FIRST).alias("key"), F.lit(1).alias("w"), F.lit(None).cast("long").alias("pattern_id"), F.lit(1).alias("side"))
    head = F.substring("pattern", 1, FIRST)
    low = patterns.select(head.alias("key"), F.lit(0).alias("w"), "pattern_id", F.lit(0).alias("side"))
    high = patterns.select(F.concat(head, F.lit("~")).alias("key"), F.lit(0).alias("w"), "pattern_id", F.lit(2).alias("side"))
    # Equal keys are one row with their number before anything is sorted.
    keys = keys.groupBy("key", "pattern_id", "side").agg(F.sum("w").alias("w"))
    rows = keys.unionByName(low.withColumn("w", F.col("w").cast("long"))).unionByName(high.withColumn("w", F.col("w").cast("long"))).withColumn("bucket", F.substring("key", 1, bucket))
    sizes = rows.groupBy("bucket").agg(F.sum("w").alias("size"))
    # One row a bucket, of which there are at most 5 ** bucket.
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("before", F.coalesce(F.sum("w").over(inside), F.lit(0))).filter("side <> 1")
    placed = counted.join(starts, "bucket").select("pattern_id", "side", (F.col("start") + F.col("before")).alias("at"))
    found = placed.groupBy("pattern_id").agg(F.min(F.when(F.col("side") == 0, F.col("at"))).alias("sa_lo"), F.min(F.when(F.col("side") == 2, F.col("at"))).alias("sa_hi"))
    long = patterns.filter(F.length("pattern") > FIRST).select("pattern_id", "pattern", head.alias("key"))
    if long.isEmpty():
        return found
    tied = suffixes.select("doc_id", "pos", F.substring("key", 1, FIRST).alias("key")).join(long, "key").join(texts.select("doc_id", "enc"), "doc_id")
    part = F.expr("substring(enc, cast(pos as int) + 1, length(pattern))")
    tails = tied.select("pattern_id", (part < F.col("pattern")).cast("long").alias("below"), (part == F.col("pattern")).cast("long").alias("equal")).groupBy("pattern_id").agg(F.sum("below").alias("below"), F.sum("equal").alias("equal"))
    extra = long.select("pattern_id").join(tails, "pattern_id", "left").fillna(0, ["below", "equal"])
    low_at = F.col("sa_lo") + F.coalesce("below", F.lit(0).cast("long"))
    return found.join(extra, "pattern_id", "left").select("pattern_id", low_at.alias("sa_lo"), F.when(F.col("equal").isNull(), F.col("sa_hi")).otherwise(low_at + F.col("equal")).alias("sa_hi"))


def _alike(patterns: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The different patterns, under the least of their ids, and what gives the rows found for these to all ids."""
    one = patterns.groupBy("pattern").agg(F.min("pattern_id").alias("pattern_id"))
    ids = patterns.select(F.col("pattern_id").alias("_own"), "pattern").join(one, "pattern").select("pattern_id", "_own")
    return one, lambda found: found.join(ids, "pattern_id").drop("pattern_id").withColumnRenamed("_own", "pattern_id").select("pattern_id", *(c for c in found.columns if c != "pattern_id"))


def first_hits(texts: DataFrame, patterns: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """pattern_id, doc_id, pos: the hit whose suffix is the smallest; of equal suffixes that of the smallest doc_id, then pos.

    The first 64 symbols decide; only hits that tie there, and have more to come, meet their texts.
    """
    patterns, named = _alike(patterns)
    found = keyed_occurrences(texts, patterns, keys)
    least = found.groupBy(F.col("pattern_id").alias("_id")).agg(F.min("key").alias("_key"))
    best = materialise(found.join(least, (F.col("pattern_id") == F.col("_id")) & (F.col("key") == F.col("_key"))).select("pattern_id", "doc_id", "pos", "key"), "best-hits")
    done = F.length("key") < KEY  # equal to their ends
    first = lambda rows, key: rows.groupBy("pattern_id").agg(F.min(F.struct(key.alias("k"), "doc_id", "pos")).alias("r")).select("pattern_id", "r.doc_id", "r.pos")
    ties = best.filter(~done).groupBy("pattern_id").agg(F.count("*").alias("n"))
    single = best.join(ties.filter("n > 1"), "pattern_id", "left_anti")
    several = best.join(ties.filter("n > 1"), "pattern_id").join(texts.select("doc_id", "enc"), "doc_id")
    return named(first(single, F.lit("")).unionByName(first(several, F.expr("substring(enc, cast(pos as int) + 1)"))))


def first_positions(texts: DataFrame, patterns: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """pattern_id, doc_id, pos: the first position of each pattern in each text that has it."""
    patterns, named = _alike(patterns)
    return named(occurrences(texts, patterns, keys).groupBy("pattern_id", "doc_id").agg(F.min("pos").alias("pos")))


def search_first(texts: DataFrame, patterns: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """pattern_id, sa_lo, sa_hi, doc_id, pos: range and first hit (-1 where absent)."""
    found = ranges(texts, patterns, keys=keys).join(first_hits(texts, patterns, keys), "pattern_id", "left")
    return found.fillna(-1, ["doc_id", "pos"])


def lcp_patterns(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_id, doc_id, lcp: the longest beginning of the pattern that occurs in its own text."""
    joined = patterns.select("pattern_id", "doc_id", "pattern").join(texts.select("doc_id", "enc"), "doc_id")
    lcp = F.expr("size(filter(sequence(1, length(pattern)), n -> instr(enc, substring(pattern, 1, n)) > 0))")
    return joined.select("pattern_id", "doc_id", lcp.cast("long").alias("lcp"))


def splits(patterns: DataFrame, d: int) -> DataFrame:
    """pattern_id, d, k, left_num, right, pad: the pattern cut behind its first k symbols, for k in 0..d-1.

    left_num is the reversed left part, filled with A to d symbols, as an octal
    number; right is filled with terminators to whole symbols.
    """
    E.check_d(d)
    each = patterns.filter(F.length("pattern") > d).select("pattern_id", "pattern", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("k"))
    left = F.rpad(F.reverse(F.substring("pattern", F.lit(1), F.col("k"))), d, "1")
    right = F.substring("pattern", F.col("k") + 1, F.length("pattern"))
    full = F.rpad(right, (F.ceil(F.length(right) / d) * d).cast("int"), F.lit("0"))
    return each.select("pattern_id", F.lit(d).cast("long").alias("d"), F.col("k").cast("long").alias("k"), E.octal(left).alias("left_num"), full.alias("right"), (F.length(full) - F.length(right)).cast("long").alias("pad"))


def grouped_search(texts: DataFrame, patterns: DataFrame, array: DataFrame, d: int, suffixes: DataFrame | None = None) -> DataFrame:
    """pattern_id, doc_id, k, sa_pos, pos: all occurrences of patterns of more than d letters through the index of d-letter symbols.

    For each k the right part must begin the suffix and the reversed left part the
    reversed symbol before it: a range of its numbers. A suffix at the text's
    begin has no symbol before it (the cyclic one counts for k = 0 only). suffixes are suffix_heads() of the array.
    """
    heads = suffix_heads(texts, array, d) if suffixes is None else suffixes
    rows = heads.select("doc_id", "sa_pos", "pos", "head", E.octal(F.reverse("before")).alias("rev"))
    each = patterns.filter(F.length("pattern") > d).select("pattern_id", "pattern", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("k"))
    least = E.octal(F.rpad(F.reverse(F.substring("pattern", F.lit(1), F.col("k"))), d, "0"))
    most = E.octal(F.rpad(F.reverse(F.substring("pattern", F.lit(1), F.col("k"))), d, "7"))
    parts = each.select("pattern_id", "k", F.substring("pattern", F.col("k") + 1, F.length("pattern")).alias("right"), least.alias("least"), most.alias("most"))
    asked = _asked(parts, "right", "pattern_id", "k", "least", "most")
    found = _with_grams(rows, "head", _lengths(parts, "right")).join(asked, "gram").filter(F.col("head").startswith(F.substring("right", 1, KEY)))
    found = found.filter((F.col("k") == 0) | ((F.col("pos") > 0) & F.col("rev").between(F.col("least"), F.col("most"))))
    short = found.filter(F.length("right") <= KEY).drop("right")
    if not parts.filter(F.length("right") > KEY).isEmpty():
        here = F.expr(f"substring(enc, cast(pos * {d} as int) + 1, length(right)) = right")
        full = texts.select("doc_id", E.meta_padded(F.col("enc"), d).alias("enc"))
        long = found.filter(F.length("right") > KEY).join(full, "doc_id").filter(here)
        short = short.unionByName(long.drop("right", "enc"))
    return short.select("pattern_id", "doc_id", F.col("k").cast("long").alias("k"), "sa_pos", (F.col("pos") * d - F.col("k")).alias("pos"))


def snippet(begin: Column, rest: Column, width: int = 25) -> Column:
    """The text at a hit, of which begin has the first symbols and rest is the length: at most `width` letters, with dots where more follow."""
    more = F.when(rest > width, F.lit("...")).otherwise(F.lit(""))
    return F.concat(E.decode(F.substring(begin, F.lit(1), F.lit(width))), more)


def text_search(texts: DataFrame, patterns: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """texts (doc_id, text), patterns (pattern_id, doc_id, pattern): in each pattern's own text, the smallest suffix
    that begins with it (match, null if absent) and the smallest suffix that is not smaller (insertion_suffix).

    Suffixes are compared by their first 64 symbols and their ranks; only those of patterns that are longer
    and agree in 64 are cut from the text. The two found are cut once.
    """
    plain = texts.select("doc_id", F.col("text").alias("enc")).filter("enc <> ''")
    ranks = suffix_ranks(plain) if ranks is None else ranks
    known = positions(plain, KEY).join(ranks, ["doc_id", "pos"])
    met = known.join(patterns.select("pattern_id", "doc_id", "pattern"), "doc_id")
    head = F.substring("pattern", 1, KEY)
    open_end = (F.length("pattern") > KEY) & (F.col("key") == head)
    sure = met.filter(~open_end).select("pattern_id", "doc_id", "pos", "rank", F.col("key").startswith(F.col("pattern")).alias("hit"), (F.col("key") >= F.col("pattern")).alias("after"))
    part = F.expr("substring(enc, cast(pos as int) + 1, length(pattern))")
    rest = met.filter(open_end).join(plain, "doc_id").select("pattern_id", "doc_id", "pos", "rank", (part == F.col("pattern")).alias("hit"), (part >= F.col("pattern")).alias("after"))
    first = lambda c: F.min_by(F.when(F.col(c), F.col("pos")), F.when(F.col(c), F.col("rank"))).alias(c)
    found = sure.unionByName(rest).groupBy("pattern_id", "doc_id").agg(first("hit"), first("after"))
    cut = lambda c: F.expr(f"substring(enc, cast({c} as int) + 1)")
    return found.join(plain, "doc_id").select("pattern_id", "doc_id", cut("hit").alias("match"), cut("after").alias("insertion_suffix"))
