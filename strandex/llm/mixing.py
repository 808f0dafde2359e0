"""Mixing sources to target weights by weighted fair queueing.

Sources, in code point order with null last, get the weights in turn and share a budget of
`budget_share` times all words; a target stops at `most_repeats` times its source, and the
excess is shared again by weight until none is above. So target = min(cap, level * weight)
with one level for all, found by sorting sources by cap / weight.

The documents of a source are shuffled by a hash. A document's service begins at the words
that its source has before it and ends at its own last word, both divided by the source's
target: the virtual start and finish time. Later rounds follow a whole source later. All
services of all sources are range-sorted by virtual finish time, which is the order of
the mix, their words are added up in that order, and the mix ends where the sum
reaches the total budget, the sum of the whole words of the targets. At virtual time 1 every source has had
its target; a service that is under way then is cut in two there, so that every source ends within one word of its target.

Everything is DataFrame code. Hot sources, and ids that many rows repeat, are cut into slices for
their running sums; the sum over the sorted services is that of their ranges first.

Defined results: a null or empty text has size 0 and takes nothing; null is a source of its
own; repeated rows are documents of their own; ties in finish time go by source, id and row; a table without words has targets of 0;
an empty table gives no rows; other columns are ignored (`mix_documents` returns them as they are, whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.llm._prefix import running_sum, shuffle_key, sliced, with_row_numbers
from strandex.llm._store import persist

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), budget_share: float = 1.5, most_repeats: int = 2) -> DataFrame:
    """source, source_size and target: one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # These windows run over one row a source, of which a corpus has few; documents never meet in them.
    names = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.lit([int(w) for w in weights])[((F.row_number().over(names) - 1) % len(weights))]
    per = per.withColumn("weight", turn.cast("double")).withColumn("cap", (F.col("source_size") * most_repeats).cast("double"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    left = F.lit(budget_share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    # The level if all sources of less need stop at their caps and none from here on does.
    per = per.withColumn("_level", left / F.sum("weight").over(onward)).withColumn("_turn", F.row_number().over(by_need))
    # The first source that this level leaves under its cap has the true one.
    holds = F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.struct("_turn", "_level"))
    level = F.min(holds).over(everything)["_level"]
    return per.withColumn("target", F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap"))).select("source", "source_size", "target")


def schedule(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), budget_share: float = 1.5, most_repeats: int = 2, seed: str = "mix", also: Column | None = None) -> DataFrame:
    """One row a document: doc_id, row, size, source, source_size, target, rounds and `also`.

    rounds are its services (start, finish, size): virtual times and words. A service that is under
    way at time 1 is two, before and after that time.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), (F.lit(None).cast("long") if also is None else also).alias("also"))
    # Only ids, sources and sizes are written; the texts are read once.
    sized = persist(with_row_numbers(narrow, "row").withColumn("key", shuffle_key(seed, "doc_id")), "mix-sizes")
    placed = running_sum(sliced(sized, "key", "doc_id"), "source", ["key", "doc_id", "size", "row"], "size")
    targets = source_targets(sized, weights=weights, budget_share=budget_share, most_repeats=most_repeats)
    joined = placed.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    whole, target = F.floor("target"), F.col("target")

    def service(turn: Column) -> Column:
        start = turn * F.col("source_size") + F.col("before")
        stop = start + F.col("size")
        cut = F.greatest(start, F.least(stop, whole))
        piece = lambda lo, hi: F.struct(F.try_divide(lo, target).alias("start"), F.try_divide(hi, target).alias("finish"), (hi - lo).cast("long").alias("size"))
        first = F.struct(F.try_divide(start, target).alias("start"), F.least(F.try_divide(cut, target), F.lit(1.0)).alias("finish"), (cut - start).cast("long").alias("size"))
        return F.array(F.when(stop <= whole, piece(start, stop)).otherwise(first), piece(cut, stop))

    each = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most_repeats - 1)), service))
    rounds = F.filter(each, lambda s: s["size"] > 0)  # a source without words has no services
    return joined.withColumn("rounds", rounds).select("doc_id", "row", "size", "source", "source_size", "target", "rounds", "also")


def mix_order(plan: DataFrame) -> DataFrame:
    """The mix itself: one row a service, with its place in the global sort by virtual finish time and the words taken of it.

    Services after the total budget has been spent are not in the mix.
    """
    each = plan.select("doc_id", "row", "source", "also", F.explode("rounds").alias("service")).select("doc_id", "row", "source", "also", "service.*")
    order = ["finish", "source", "doc_id", "row", "start"]
    ranged = persist(each.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-services")
    sums = ranged.groupBy(F.col("range").alias("_range")).agg(F.sum("size").alias("_words"), F.count("*").alias("_rows"))  # one row a range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_words", "_rows")))
    budget = plan.groupBy("source").agg(F.floor(F.max("target")).alias("t")).agg(F.sum("t").alias("_budget"))
    within = Window.partitionBy("range").orderBy(*order)
    before = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("_before", before).withColumn("_nth", F.row_number().over(within))
    joined = placed.join(starts, F.col("range") == F.col("_range")).crossJoin(F.broadcast(budget))  # one row
    taken = F.least(F.col("_budget") - F.col("_words") - F.col("_before"), F.col("size")).cast("long")
    return joined.select("doc_id", "row", "source", "also", "start", "finish", (F.col("_rows") + F.col("_nth")).alias("position"), taken.alias("taken")).filter("taken > 0")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, finish and position: one row a document, the last two of its first service in the mix."""
    plan = persist(schedule(docs, **options), "mix-plan")
    per = mix_order(plan).groupBy(F.col("row").alias("_row")).agg(F.sum("taken").alias("taken"), F.min("finish").alias("finish"), F.min("position").alias("position"))
    joined = plan.join(per, F.col("row") == F.col("_row"), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "finish", "position")


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix in the columns of docs, a row for each time that one is taken, in the order of virtual finish time.

    A document under way at the end keeps the words taken of it, joined by spaces.
    """
    columns = docs.columns
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    same = F.xxhash64(*(F.col(f"`{c}`") for c in plain))
    plan = persist(schedule(docs, id_col=id_col, text_col=text_col, source_col=source_col, also=same, **options), "mix-plan")
    # A row of docs is known by its id and the hash of its columns; only rows that are equal in these need a number too.
    known = plan.select("row", F.col("doc_id").alias("id"), F.col("also").alias("same"), "size")
    counts = known.groupBy("id", "same").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("_id"), F.col("same").alias("_same"))
    copies = persist(counts, "mix-copies")
    equal = F.col("id").eqNullSafe(F.col("_id")) & (F.col("same") == F.col("_same"))
    nth = lambda order: F.row_number().over(Window.partitionBy("id", "same").orderBy(order))
    order = mix_order(plan).select("row", "position", "taken")
    services = order.join(known.withColumnsRenamed({"row": "_row"}), F.col("row") == F.col("_row")).drop("_row")
    nested = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"), F.col(id_col).alias("id"), same.alias("same"))
    theirs = services.withColumnsRenamed({"id": "_id", "same": "_same"})
    single = nested.join(copies, equal, "left_anti").join(theirs, equal).select("doc", "position", "taken", "size")
    numbers = known.join(copies, equal, "left_semi").select(F.col("row").alias("_row"), nth("row").alias("_nth"))
    numbered = theirs.join(numbers, F.col("row") == F.col("_row"))
    several = nested.join(copies, equal, "left_semi").withColumn("nth", nth(F.lit(1)))
    several = several.join(numbered, equal & (F.col("nth") == F.col("_nth"))).select("doc", "position", "taken", "size")
    joined = single.unionAll(several)
    text = F.col("doc").getField(text_col)
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), F.lit(1), F.col("taken").cast("int")), " ")
    new = {text_col: F.when(F.col("taken") < F.col("size"), head).otherwise(text)}
    if "n_chars" in columns:
        new["n_chars"] = F.length(new[text_col]).cast(docs.schema["n_chars"].dataType)
    return joined.orderBy("position").select([new.get(c, F.col("doc").getField(c)).alias(c) for c in columns])
