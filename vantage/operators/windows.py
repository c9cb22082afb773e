"""Order-dependent operators as window functions over a key: prefix maxima, islands, resampling, gradients, crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_max_visibility(df: DataFrame, key: str, order: str, ground: Column, target: Column, distance: Column) -> DataFrame:
    """Adds visible and clearance: a sample is seen if its angle is not below the largest ground angle before it; the first is."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    highest = F.max(ground).over(before)
    return df.withColumns({"visible": highest.isNull() | (target >= highest), "clearance": (target - highest) * distance})


def islands(df: DataFrame, key: str, order: list, breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows from 1; ``breaks`` says of a row whether a new run starts (a null does not), the first row always does."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.row_number().over(w) == 1, 1).when(breaks, 1).otherwise(0)
    flagged = df.withColumn("_new", new)
    return flagged.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def islands_in_view(df: DataFrame, key: str, order: str, in_view: str, chain: str, max_gap: float) -> DataFrame:
    """In-view rows with their run: it ends where a row is hidden or the gap to the next row is larger than ``max_gap``."""
    w = Window.partitionBy(key).orderBy(order)
    marked = df.withColumns({"_hidden": ~F.lag(in_view).over(w), "_gap": F.col(chain) - F.lag(chain).over(w)})
    return islands(marked, key, [order], F.col("_hidden") | (F.col("_gap") > max_gap)).where(F.col(in_view)).drop("_hidden", "_gap")


def runs_sharing_vertex(df: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Runs of equal label; each but the first also has the row before it, its last row giving the label."""
    w = Window.partitionBy(key).orderBy(order)
    marked = df.withColumn("_other", F.lag(label).over(w) != F.col(label))
    own = islands(marked, key, [order], F.col("_other")).drop("_other")
    last = own.withColumn("_next", F.lead("island").over(Window.partitionBy(key).orderBy(order)))
    return own.unionByName(last.where(F.col("_next") > F.col("island")).withColumn("island", F.col("_next")).drop("_next"))


def neighbours(column: str, key: str | list[str], order: str) -> tuple[Column, Column]:
    """Values of the rows before and after, the own at the ends."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)
    return F.coalesce(F.lag(column).over(w), F.col(column)), F.coalesce(F.lead(column).over(w), F.col(column))


def in_stretches(df: DataFrame, key: str, order: str, length: float, reach: float) -> DataFrame:
    """Rows by stretches of a key (``_stretch``), each with the neighbouring stretches' rows within ``reach`` as a margin (``_own`` false).

    Windows of neighbours may then run over (key, _stretch), so a long line is dealt over many tasks; a row's neighbours must be
    within ``reach`` of it.
    """
    at = F.floor(F.col(order) / length)
    near = F.array_distinct(F.array(at, F.floor((F.col(order) - reach) / length), F.floor((F.col(order) + reach) / length)))
    return df.withColumn("_at", at).withColumn("_stretch", F.explode(near)).withColumn("_own", F.col("_stretch") == F.col("_at")).drop("_at")


def gradient(y: str, x: str, key: str, order: str) -> Column:
    """Second-order differences on uneven spacing; one-sided at the ends; null for a single row or equal x."""
    w = Window.partitionBy(key).orderBy(order)
    hd, hs = F.lead(x).over(w) - F.col(x), F.col(x) - F.lag(x).over(w)
    up, down = F.lead(y).over(w) - F.col(y), F.col(y) - F.lag(y).over(w)
    inner = (hs * hs * up + hd * hd * down) / F.nullif(hs * hd * (hd + hs), F.lit(0.0))
    return F.coalesce(inner, F.when(hs.isNull(), up / F.nullif(hd, F.lit(0.0))), F.when(hd.isNull(), down / F.nullif(hs, F.lit(0.0))))


def segments(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Each row with the next row's columns as ``<name>2``; the last row of a key has none."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({"_more": F.lead(order).over(w), **{f"{c}2": F.lead(c).over(w) for c in columns}}).where("_more IS NOT NULL").drop("_more")


def resample(df: DataFrame, key: str, order: str, length: Column, spacing: float) -> DataFrame:
    """Positions 0, spacing, 2 * spacing, ... strictly below a line's total length: (key, order of the segment, chain, share of the segment).

    ``length`` is each segment's length; a multiple on an inner vertex belongs to the segment that starts there.
    """
    w = Window.partitionBy(key).orderBy(order)
    at = df.withColumn("_len", length)
    at = at.withColumn("_end", F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_start", F.col("_end") - F.col("_len"))
    first, last = F.ceil(F.col("_start") / spacing), F.ceil(F.col("_end") / spacing) - 1
    some = at.where(F.col("_len") > 0).withColumns({"_first": first, "_last": last}).where("_last >= _first")
    out = some.withColumn("_n", F.explode(F.sequence("_first", "_last"))).withColumn("chain", F.col("_n") * spacing)
    return out.withColumn("share", (F.col("chain") - F.col("_start")) / F.col("_len")).drop("_len", "_end", "_start", "_first", "_last", "_n")


def densify(df: DataFrame, parts: Column) -> DataFrame:
    """Rows of segments repeated with ``share`` 0, 1/n, ... (n-1)/n for n = ``parts``."""
    return df.withColumn("_n", F.greatest(parts, F.lit(1)).cast("long")).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).withColumn("share", F.col("_i") / F.col("_n")).drop("_i", "_n")


def sample_distances(total: Column, skip_near: float, skip_far: float, zone: float, fine: float, coarse: float) -> Column:
    """Sorted distances along a ray: fine near both ends, coarse between; the midpoint if nothing is left."""
    end = total - skip_far
    steps = lambda lo, hi, by: F.when(hi > lo, F.transform(F.sequence(F.lit(0), (F.ceil((hi - lo) / by) - 1).cast("int")), lambda i: lo + i * by)).otherwise(F.array().cast("array<double>"))
    near = steps(F.lit(skip_near), F.least(F.lit(zone), end), fine)
    far = F.transform(steps(F.lit(0.0), F.least(F.lit(zone), end - skip_near), fine), lambda x: end - x)
    mid = F.when(total > 2 * zone, steps(F.lit(zone), total - zone, coarse)).otherwise(F.array().cast("array<double>"))
    every = F.filter(F.array_sort(F.array_distinct(F.concat(near, mid, far))), lambda s: (s >= skip_near) & (s <= end))
    return F.when(end <= skip_near, F.array(total / 2)).otherwise(every)


def zero_crossings(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Linear roots between neighbouring rows of opposite sign; a zero counts with the step that leaves it."""
    w = Window.partitionBy(key).orderBy(x)
    pairs = df.withColumns({"_x2": F.lead(x).over(w), "_y2": F.lead(y).over(w)})
    crossed = pairs.where((F.col("_y2").isNotNull()) & (((F.col(y) <= 0) & (F.col("_y2") > 0)) | ((F.col(y) >= 0) & (F.col("_y2") < 0))))
    return crossed.withColumn("root", F.col(x) - F.col(y) * (F.col("_x2") - F.col(x)) / (F.col("_y2") - F.col(y))).drop("_x2", "_y2")


def full_frame(value: Column, key: str, order: str, rows: int) -> Column:
    """``value`` (an aggregate) over this and the next rows - 1 rows; null where the frame is not full."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(0, rows - 1)
    return F.when(F.count(F.lit(1)).over(w) == rows, value.over(w))


def centred(value: Column, key: str, order: str, half: int) -> Column:
    return value.over(Window.partitionBy(key).orderBy(order).rowsBetween(-half, half))


def local_minimum(y: str, key: str, order: str, reach: int) -> Column:
    """Lower than all of the ``reach`` rows before and after, of which there is one each at least."""
    w = Window.partitionBy(key).orderBy(order)
    return (F.col(y) < F.min(y).over(w.rowsBetween(-reach, -1))) & (F.col(y) < F.min(y).over(w.rowsBetween(1, reach)))


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key, in a stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_by(df: DataFrame, keys: list, order: list, n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)
