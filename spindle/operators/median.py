"""Exact medians that no single task has to hold.

Spark's own exact percentile keeps every distinct value of a group in memory.
Here equal values are counted first, and a quantile sketch of each group says
between which two values its middle lies. Counts below, between and above them
tell exactly which of the three spans holds the middle ranks, and only that
span's distinct values are put in order; that sort spills. The sketch decides
how narrow the span is, never the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's rank error is 1 / ACCURACY of a group's rows; the span reaches two errors to each side.
ACCURACY = 100_000


def matched(left: DataFrame, right: DataFrame, ids: list[str], prefix: str, how: str) -> DataFrame:
    """Join on ``ids``, null with null; the right side has them under ``prefix``."""
    on = [F.col(i).eqNullSafe(F.col(prefix + i)) for i in ids]
    out = left.join(right, reduce(Column.__and__, on), how)
    return out.drop(*(prefix + i for i in ids))


def medians(rows: DataFrame, ids: list[str], value: Column, name: str, accuracy: int = ACCURACY) -> DataFrame:
    """``ids`` under the prefix ``_m`` and the median of ``value`` (double) as ``name``, for each group that has values."""
    some = rows.select(*ids, value.alias("_v")).filter("_v IS NOT NULL")
    counts = some.groupBy(*ids, "_v").agg(F.count(F.lit(1)).alias("_n"))
    reach = min(2 / accuracy, 0.5)
    ends = F.percentile_approx("_v", [0.5 - reach, 0.5 + reach], accuracy)
    spans = some.groupBy(*(F.col(i).alias(f"_s{i}") for i in ids)).agg(ends.alias("_ends"), F.count(F.lit(1)).alias("_all"))
    bin_ = F.when(F.col("_v") < F.col("_ends")[0], 0).when(F.col("_v") <= F.col("_ends")[1], 1).otherwise(2)
    binned = matched(counts, spans, ids, "_s", "inner").withColumn("_bin", bin_).drop("_ends")
    # Ranks from 0: the middle one, or the middle two.
    first, last = F.shiftright(F.col("_all") - 1, 1), F.shiftright("_all", 1)
    sums = binned.groupBy(*ids, "_bin", "_all").agg(F.sum("_n").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*ids).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("_upto", upto).filter((F.col("_upto") > first) & (F.col("_upto") - F.col("_n") <= last))
    picked = sums.select(*(F.col(i).alias(f"_b{i}") for i in ids), F.col("_bin").alias("_b_bin"), (F.col("_upto") - F.col("_n")).alias("_before"))
    few = matched(binned, picked, [*ids, "_bin"], "_b", "inner")
    place_in = F.sum("_n").over(Window.partitionBy(*ids, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    few = few.withColumn("_upto", F.col("_before") + place_in)
    middle = few.filter((F.col("_upto") > first) & (F.col("_upto") - F.col("_n") <= last))
    # One value serves both middle ranks, or two serve one each.
    return middle.groupBy(*(F.col(i).alias(f"_m{i}") for i in ids)).agg((F.min("_v") / 2 + F.max("_v") / 2).alias(name))
