"""Join patterns: bucketed range joins, nearest neighbours, brackets, polylines, priority coalescing, grid samples.

No pattern is a cross join of two tables that grow: tolerance windows become integer buckets, and the exact predicate is tested
again on the pairs that meet in a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bucketed_range_join(points: DataFrame, at: Column, windows: DataFrame, low: Column, high: Column, width: float) -> DataFrame:
    """Pairs with low <= at <= high: each window is repeated for the buckets it touches, each point has one; pairs come once."""
    left = points.withColumns({"_at": at, "_b": F.floor(at / width)})
    right = windows.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    right = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))))
    return left.join(right, "_b").where("_at >= _low AND _at <= _high").drop("_b", "_at", "_low", "_high")


def angular_join(sources: DataFrame, az: Column, observations: DataFrame, centre: Column, tolerance: Column, width: float = 2.0) -> DataFrame:
    """Pairs whose azimuths differ by the tolerance at most, across north too.  Buckets go round the circle; pairs come once if the tolerance is below 180 - width."""
    n = round(360 / width)
    left = sources.withColumns({"_az": F.pmod(az, F.lit(360.0))}).withColumn("_b", F.pmod(F.floor(F.col("_az") / width), F.lit(n)))
    right = observations.withColumns({"_c": centre, "_t": tolerance})
    right = right.withColumn("_b", F.explode(F.array_distinct(F.transform(F.sequence(F.floor((F.col("_c") - F.col("_t")) / width), F.floor((F.col("_c") + F.col("_t")) / width)), lambda b: F.pmod(b, F.lit(n))))))
    apart = F.abs(F.pmod(F.col("_az") - F.col("_c") + 540.0, F.lit(360.0)) - 180.0)
    return left.join(right, "_b").withColumn("d_az", apart).where("d_az <= _t").drop("_b", "_az", "_c", "_t")


def cells_around(x: Column, y: Column, width: float) -> Column:
    """The 3 x 3 cells around a point, as (cx, cy)."""
    cx, cy = F.floor(x / width), F.floor(y / width)
    return F.explode(F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))


def pairs_within(left: DataFrame, lx: Column, ly: Column, right: DataFrame, rx: Column, ry: Column, width: float) -> DataFrame:
    """Pairs at most one cell of ``width`` apart in both coordinates, for an exact test afterwards; pairs come once."""
    a = left.withColumn("_c", F.struct(F.floor(lx / width).alias("cx"), F.floor(ly / width).alias("cy")))
    b = right.withColumn("_c", cells_around(rx, ry, width))
    return a.join(b, "_c").drop("_c")


def nearest_of_places(left: DataFrame, at: list[str], right: DataFrame, places: list[str], pick: str, distance: Column, limit: float) -> DataFrame:
    """Each place of left rows (columns ``at``) that has a right row within ``limit``, with ``pick`` and ``d`` of the nearest; of equal distances the smallest ``pick``.

    Rows of one place are searched for once.  Cells begin at a sixteenth of the limit and grow only for places that have found nothing
    yet, so where right rows are dense a place meets few of them.  ``distance`` may be shorter than the larger coordinate difference
    by 1 % at most.
    """
    targets = right.groupBy(*places).agg(F.min(pick).alias(pick))
    found = left.select(*at).distinct().withColumn("_f", F.lit(None).cast(T.StructType([T.StructField("d", T.DoubleType()), T.StructField(pick, right.schema[pick].dataType)])))
    for reach in (limit / 16, limit / 4, limit):
        width = reach * 1.02
        aside = -(1 << 40) - F.pmod(F.xxhash64(*at), F.lit(1 << 30))  # a cell of no right row, for places that are done
        cell = F.struct(F.when(F.col("_f").isNull(), F.floor(F.col(at[0]) / width)).otherwise(aside).alias("cx"), F.floor(F.col(at[1]) / width).alias("cy"))
        met = found.withColumn("_c", cell).join(targets.withColumn("_c", cells_around(F.col(places[0]), F.col(places[1]), width)), "_c", "left").withColumn("d", distance)
        found = met.groupBy(*at).agg(F.coalesce(F.first("_f"), F.min(F.when(F.col("d") <= reach, F.struct("d", pick)))).alias("_f"))
    return found.where("_f IS NOT NULL").select(*at, F.col(f"_f.{pick}").alias(pick), F.col("_f.d").alias("d"))


def nearest_by_key(left: DataFrame, right: DataFrame, key: str, at: Column, place: Column, pick: str, out: str, ident: list[str], digits: int) -> DataFrame:
    """``ident`` of each left row with ``pick`` of the right row of its key whose ``place`` is nearest to ``at`` (as <out>_distance, rounded), nulls if there is none.

    Both sides are one list sorted by place within a key, forwards and backwards: a row's nearest neighbours are the last right row
    before it in either order, so no pairs are made and both windows only grow (one that shrinks is gone through anew for each row).  Of equal places the smallest ``pick`` counts; of equal distances too.
    """
    firsts = right.select(key, place.alias("_x"), F.col(pick).alias("_p")).groupBy(key, "_x").agg(F.min("_p").alias("_p"))
    points = left.select(key, at.alias("_x"), *ident).withColumns({"_r": F.lit(None).cast(T.StructType([T.StructField("x", firsts.schema["_x"].dataType), T.StructField("p", firsts.schema["_p"].dataType)])), "_own": F.lit(True)})
    places = firsts.select(key, "_x", *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in ident], F.struct(F.col("_x").alias("x"), F.col("_p").alias("p")).alias("_r"), F.lit(False).alias("_own"))
    w = Window.partitionBy(key).rowsBetween(Window.unboundedPreceding, 0)
    met = points.unionByName(places).withColumns({"_b": F.last("_r", True).over(w.orderBy("_x", "_own")), "_a": F.last("_r", True).over(w.orderBy(F.desc("_x"), "_own"))}).where("_own")
    option = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.round(F.abs(F.col(f"{c}.x") - F.col("_x")), digits).alias("d"), F.col(f"{c}.p").alias("p")))
    best = F.least(option("_b"), option("_a"))
    return met.select(*ident, best["p"].alias(out), best["d"].alias(f"{out}_distance"))


def bracket(points: DataFrame, x: str, segments: DataFrame, x0: str, x1: str, y0: str, y1: str, width: float, out: str) -> DataFrame:
    """Linear interpolation at x between the segment ends that enclose it: points outside all segments are left out."""
    met = bucketed_range_join(points, F.col(x), segments, F.least(x0, x1), F.greatest(x0, x1), width)
    return met.withColumn(out, F.col(y0) + (F.col(x) - F.col(x0)) / F.nullif(F.col(x1) - F.col(x0), F.lit(0.0)) * (F.col(y1) - F.col(y0)))


def point_to_segment(px, py, x0, y0, x1, y1) -> tuple[Column, Column]:
    """(distance, clamped share along the segment)."""
    dx, dy = x1 - x0, y1 - y0
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * dx + (py - y0) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
    ex, ey = px - (x0 + t * dx), py - (y0 + t * dy)
    return F.sqrt(ex * ex + ey * ey), t


def ray_segment(az: Column, x0, y0, x1, y1) -> tuple[Column, Column]:
    """(distance along the ray from the origin, share along the segment); nulls without a crossing."""
    ux, uy = F.sin(F.radians(az)), F.cos(F.radians(az))
    dx, dy = x1 - x0, y1 - y0
    det = F.nullif(ux * dy - uy * dx, F.lit(0.0))
    s, t = (x0 * dy - y0 * dx) / det, (x0 * uy - y0 * ux) / det
    hit = (s > 0) & (t >= 0) & (t < 1)
    return F.when(hit, s), F.when(hit, t)


def priority_coalesce(cells: DataFrame, layers: DataFrame, keys: list[str], value: str, priority: str) -> DataFrame:
    """Each cell with the value and number of the first layer that has one there: (value, priority), nulls where none has."""
    first = layers.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(F.struct(priority, value)).alias("_f"))
    return cells.join(first, keys, "left").select(*cells.columns, F.col(f"_f.{value}").alias(value), F.col(f"_f.{priority}").alias(priority))


def bilinear(points: DataFrame, row: Column, col: Column, raster: DataFrame, ident: list[str], out: str) -> DataFrame:
    """Four-neighbour interpolation on a raster of (r, c, z); null if a neighbour with weight is missing or null."""
    at = points.withColumns({"_r": F.floor(row), "_c": F.floor(col), "_fr": row - F.floor(row), "_fc": col - F.floor(col)})
    corners = F.array(*[F.struct((F.col("_r") + i).alias("r"), (F.col("_c") + j).alias("c"), ((F.col("_fr") if i else 1 - F.col("_fr")) * (F.col("_fc") if j else 1 - F.col("_fc"))).alias("w")) for i in (0, 1) for j in (0, 1)])
    four = at.select(*ident, F.explode(corners).alias("k")).select(*ident, F.col("k.r").cast("long").alias("r"), F.col("k.c").cast("long").alias("c"), "k.w")
    met = four.join(raster.select("r", "c", "z"), ["r", "c"], "left")
    return met.groupBy(*ident).agg(F.when(F.count("z") == 4, F.sum(F.col("w") * F.col("z"))).alias(out))


def semi_flag(left: DataFrame, right: DataFrame, key: str, columns: list[str], flag: str) -> DataFrame:
    """Whether any of several left columns is among the right keys: one equi-join for each column, no OR condition."""
    keys = right.select(F.col(key).alias("_k")).where("_k IS NOT NULL").distinct()
    out = left
    for i, c in enumerate(columns):
        out = out.join(keys.withColumnRenamed("_k", f"_k{i}"), out[c] == F.col(f"_k{i}"), "left")
    found = F.lit(False)
    for i in range(len(columns)):
        found = found | F.col(f"_k{i}").isNotNull()
    return out.withColumn(flag, found).drop(*[f"_k{i}" for i in range(len(columns))])


def ring_parity(points: DataFrame, x: str, y: str, edges: DataFrame, ident: list[str], width: float) -> DataFrame:
    """Even-odd test: ident and inside of the points whose ray to +x crosses an odd number of edges (x0, y0, x1, y1)."""
    spans = edges.where("y0 <> y1")
    met = bucketed_range_join(points, F.col(y), spans, F.least("y0", "y1"), F.greatest("y0", "y1"), width)
    cross = (F.col("y0") > F.col(y)) != (F.col("y1") > F.col(y))
    right = F.col(x) < F.col("x0") + (F.col(y) - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    return met.groupBy(*ident).agg((F.sum(F.when(cross & right, 1).otherwise(0)) % 2 == 1).alias("inside")).where("inside")
