"""Running sums within groups of any size, without one task for a whole group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(seed: str, *columns: str) -> Column:
    """A hash of the columns that any SQL engine can repeat: the order of a fixed random shuffle."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))


def sliced(rows: DataFrame, key: str, repeated: str, *, heavy: int = 10_000, per_slice: int = 50_000) -> DataFrame:
    """rows with `slice`: ordered pieces of the order by `key`, none of much more than per_slice rows.

    key is a uniformly distributed hexadecimal hash; its first digits, at least three, make the
    slice. The rows of a value of `repeated` (null included) that has more than `heavy` rows share one key: they
    follow the others of their digits and are cut further by `row`. rows are reread: pass a written table.
    """
    digits = max(3, math.ceil(math.log(max(1, rows.count() / per_slice), 16)))
    crowds = rows.groupBy(F.col(repeated).alias("_value")).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > heavy)
    parts = F.ceil(F.col("_rows") / per_slice).cast("long")
    further = F.concat(F.lit("~"), F.lpad(F.pmod(F.xxhash64("row"), parts).cast("string"), 12, "0"))
    joined = rows.join(crowds, F.col(repeated).eqNullSafe(F.col("_value")), "left")
    return joined.withColumn("slice", F.concat(F.substring(F.col(key), 1, digits), F.coalesce(further, F.lit("")))).drop("_value", "_rows")


def running_sum(rows: DataFrame, group: str, order: list[str], value: str, *, name: str = "before") -> DataFrame:
    """rows with `name`: the sum of value over the rows of the same group that come earlier, by slice and then by order.

    The slices' sums are aggregated before the shuffle and added up over one row a slice and group,
    and inside a slice a window does the rest. A slice of a group is the most that meets in
    a task. Groups may be null.
    """
    sums = rows.groupBy(F.col(group).alias("_group"), F.col("slice").alias("_cut")).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("_group").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_group", "_cut", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = inside.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("slice") == F.col("_cut")), "left")
    return joined.withColumn(name, F.col("_start") + F.col("_inside")).drop("_group", "_cut", "_start", "_inside")


def with_row_numbers(rows: DataFrame, name: str) -> DataFrame:
    """rows with a number that tells repeated rows apart; fixed once the result is written."""
    return rows.withColumn(name, F.monotonically_increasing_id())
