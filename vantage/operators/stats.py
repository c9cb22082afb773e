"""Exact order statistics from counted values."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 1024


def weighted_quantiles(counted: DataFrame, keys: list[str], value: str, n: str, shares: list[float]) -> DataFrame:
    """``keys`` and ``q``: for each share the linearly interpolated quantile of values that occur ``n`` times each.

    A key's values are cut into ``SLICES`` slices between its least and greatest.  Running sums over the slices tell which of them
    hold the ranks asked for; only these slices' values are ranked, each slice apart, so no key's values come together.
    """
    ends = counted.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum(n).alias("_all"))
    width = F.col("_hi") - F.col("_lo")
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / F.when(width > 0, width) * SLICES), F.lit(SLICES - 1))).otherwise(F.lit(0)).cast("int")
    rows = counted.join(ends, keys).withColumn("_slice", at)
    slices = rows.groupBy(*keys, "_slice", "_all").agg(F.sum(n).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    places = [F.lit(s) * (F.col("_all") - 1) for s in shares]
    asked = reduce(or_, [(F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_n")) for p in places for rank in (F.floor(p), F.ceil(p))])
    few = rows.drop("_all").join(starts.where(asked).drop("_n"), [*keys, "_slice"])
    inside = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = few.withColumn("_last", F.col("_start") + F.sum(n).over(inside) - 1)
    first, last = F.col("_last") - F.col(n) + 1, F.col("_last")
    picks = []
    for i, p in enumerate(places):
        picks += [F.max(F.when((first <= rank) & (rank <= last), F.col(value))).alias(f"_v{i}_{j}") for j, rank in enumerate((F.floor(p), F.ceil(p)))]
        picks.append(F.max(p - F.floor(p)).alias(f"_t{i}"))
    found = placed.groupBy(*keys).agg(*picks)
    return found.select(*keys, F.array(*[F.col(f"_v{i}_0") + F.col(f"_t{i}") * (F.col(f"_v{i}_1") - F.col(f"_v{i}_0")) for i in range(len(shares))]).alias("q"))
