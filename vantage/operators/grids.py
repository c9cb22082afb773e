"""View grids with integer cells: boxes, rate maps, unions, coverage, column maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: azimuth and elevation origins and steps (degrees)
AZ0, DAZ, EL0, DEL = 150.0, 0.5, -2.0, 0.25
N_AZ, N_EL = 300, 24


def cell_range(centre: Column, half: Column, origin: float, step: float, n: int) -> tuple[Column, Column]:
    """First and last cell whose position is within ``half`` of ``centre``; the small allowance keeps edges in."""
    lo = F.greatest(F.ceil(F.round((centre - half - origin) / step, 6)), F.lit(0))
    hi = F.least(F.floor(F.round((centre + half - origin) / step, 6)), F.lit(n - 1))
    return lo.cast("int"), hi.cast("int")


def stamp_boxes(df: DataFrame, az: Column, el: Column, half_az: Column, half_el: Column) -> DataFrame:
    """Each row repeated for the cells (ia, ie) of its box."""
    a0, a1 = cell_range(az, half_az, AZ0, DAZ, N_AZ)
    e0, e1 = cell_range(el, half_el, EL0, DEL, N_EL)
    boxed = df.withColumns({"_a0": a0, "_a1": a1, "_e0": e0, "_e1": e1}).where("_a0 <= _a1 AND _e0 <= _e1")
    return boxed.withColumn("ia", F.explode(F.sequence("_a0", "_a1"))).withColumn("ie", F.explode(F.sequence("_e0", "_e1"))).drop("_a0", "_a1", "_e0", "_e1")


def rate_map(stamped: DataFrame, line: str, rate: str) -> DataFrame:
    """Largest rate of each line in a cell, summed over lines."""
    return stamped.groupBy(line, "ia", "ie").agg(F.max(rate).alias("r")).groupBy("ia", "ie").agg(F.sum("r").alias("rate"))


def mask_union(stamped: DataFrame) -> DataFrame:
    return stamped.select("ia", "ie").distinct()


def column_window_max(cells: DataFrame, value: str, tolerance: int) -> DataFrame:
    """Per azimuth cell the largest value over the cells within ``tolerance``: a range window over one row for each column."""
    columns = cells.groupBy("ia").agg(F.max(value).alias("top"))
    return columns.withColumn("window_top", F.max("top").over(Window.orderBy("ia").rangeBetween(-tolerance, tolerance)))


def rasterise(points: DataFrame, x: Column, y: Column, height: Column, threshold: float) -> DataFrame:
    """(cell, hmax, n, n_above) of 1-unit cells with a packed key."""
    key = F.floor(x) * 10_000_000 + F.floor(y)
    return points.withColumns({"cell": key, "_h": height}).groupBy("cell").agg(F.max("_h").alias("hmax"), F.count("*").alias("n"), F.sum(F.when(F.col("_h") > threshold, 1).otherwise(0)).alias("n_above"))


def obstruction(cells: DataFrame) -> DataFrame:
    """Dense surface where enough returns are high, and the upper envelope; neither below 0."""
    dense = F.when((F.col("n_above") >= 2) & (F.col("n_above") / F.col("n") >= 0.25), F.greatest("hmax", F.lit(0.0))).otherwise(0.0)
    return cells.withColumns({"dense": dense, "highest": F.when(F.col("n_above") >= 1, F.greatest("hmax", F.lit(0.0))).otherwise(0.0)})
