"""Queries of pictures and directions: pose hypotheses, skylines, grids of candidates, projections, star places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import joins, windows
from . import visibility
from .traffic import _u, uniform
from .views import EYE, GROUND, LAT0, LON0, table, view, with_views


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lights in pictures, one picture for each region: (image, det, u, v) with a few that belong to nothing."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("image"), F.col("n_nationkey").alias("det"), (F.floor(F.col("n_nationkey") / 5) * 3.0 + F.col("n_regionkey")).alias("az"), (F.col("n_nationkey") % 3 * 0.5).alias("el"))
    off = F.when(F.col("det") % 7 == 6, 90.0).otherwise(0.0)
    return n.select("image", "det", F.round((F.col("az") - 5) * 40 + off, 4).alias("u"), F.round((F.col("el") - 0.5) * 40 - off, 4).alias("v"))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_regionkey").alias("image"), F.col("n_nationkey").alias("anchor"), (F.floor(F.col("n_nationkey") / 5) * 3.0 + F.col("n_regionkey")).alias("az"), (F.col("n_nationkey") % 3 * 0.5).alias("el"))


def pose_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best pose of each picture from ordered pairs of detections on ordered pairs of anchors (plane scale, no roll).

    A pair tells the scale; scales off the lens by over 4 % are pruned before anything is counted.  A pose counts the anchors that land
    on a detection within 4 pixels; the most wins, then the smallest misfit, then the pair's ids.
    """
    d, a = _detections(spark, sf_dir), _anchors(spark, sf_dir)
    pair = lambda t, k, cols: t.select("image", F.col(k).alias(f"{k}1"), *(F.col(c).alias(f"{c}1") for c in cols)).join(t.select("image", F.col(k).alias(f"{k}2"), *(F.col(c).alias(f"{c}2") for c in cols)), "image").where(f"{k}1 <> {k}2")
    dp = F.sqrt(F.pow(F.col("u1") - F.col("u2"), F.lit(2.0)) + F.pow(F.col("v1") - F.col("v2"), F.lit(2.0)))
    sa = F.sqrt(F.pow(F.col("az1") - F.col("az2"), F.lit(2.0)) + F.pow(F.col("el1") - F.col("el2"), F.lit(2.0)))
    dets = pair(d, "det", ["u", "v"]).withColumn("dp", dp).where("dp >= 15")
    ancs = pair(a, "anchor", ["az", "el"]).withColumn("sa", sa).where("sa >= 0.05")
    h = dets.join(ancs, "image").withColumn("f", F.round(F.col("dp") / F.col("sa"), 6)).where(F.abs(F.col("f") / 40 - 1) <= 0.04)
    h = h.withColumns({"az0": F.round(F.col("az1") - F.col("u1") / F.col("f"), 6), "el0": F.round(F.col("el1") - F.col("v1") / F.col("f"), 6)})
    h = h.select("image", "det1", "det2", "anchor1", "anchor2", "f", "az0", "el0")
    landed = h.join(a, "image").withColumns({"pu": (F.col("az") - F.col("az0")) * F.col("f"), "pv": (F.col("el") - F.col("el0")) * F.col("f")})
    near = landed.join(d, "image").withColumn("miss", F.round(F.sqrt(F.pow(F.col("u") - F.col("pu"), F.lit(2.0)) + F.pow(F.col("v") - F.col("pv"), F.lit(2.0))), 4)).where("miss < 4")
    key = ["image", "det1", "det2", "anchor1", "anchor2", "f", "az0", "el0"]
    per = near.groupBy(*key, "anchor").agg(F.min("miss").alias("miss")).groupBy(*key).agg(F.count("*").alias("inliers"), F.round(F.sum("miss"), 3).alias("misfit"))
    best = windows.first_by(per, ["image"], [F.desc("inliers"), "misfit", "det1", "det2", "anchor1", "anchor2"])
    return best.select("image", "inliers", F.round("f", 4).alias("f"), F.round("az0", 4).alias("az0"), F.round("el0", 4).alias("el0"))


def _picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luminance of pixels (image, x, y, l): sky above an uneven line, darker land below, with a little pattern."""
    n = table(spark, sf_dir, "nation").where("n_nationkey < 6").select(F.col("n_nationkey").alias("image"))
    p = n.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(49))))
    top = 18 + 6 * F.sin(F.col("x") * 0.3 + F.col("image"))
    return p.withColumn("l", F.round(F.when(F.col("y") < top, 120.0).otherwise(60.0) + (F.col("x") * 7 + F.col("y") * 13 + F.col("image") * 5) % 11 * 0.4, 6))


def _edges(p: DataFrame) -> DataFrame:
    """Skyline row of each column: the first whose edge over two rows each side passes the column's threshold and is a step of the means beyond."""
    w = Window.partitionBy("image", "x").orderBy("y")
    mean = lambda a, b: F.avg("l").over(w.rowsBetween(a, b))
    e = p.withColumns({"e": F.round(F.abs(F.lag("l", 2).over(w) - F.lead("l", 2).over(w)), 6), "step": F.round(F.abs(mean(-14, -4) - mean(4, 14)), 6)})
    whole = e.groupBy("image", "x").agg(F.max("e").alias("top"), F.expr("percentile(e, 0.5)").alias("m"))
    e = e.join(whole, ["image", "x"])
    noise = e.groupBy("image", "x").agg((1.4826 * F.expr("percentile(abs(e - m), 0.5)") + 0.25).alias("noise"))
    e = e.join(noise, ["image", "x"])
    limit = F.round(F.greatest(0.35 * F.col("top"), F.col("m") + 7 * F.col("noise"), F.lit(2.5)), 6)
    return e.where((F.col("e") >= limit) & (F.col("step") >= 0.5 * F.col("e"))).groupBy("image", "x").agg(F.min("y").alias("y"))


def skyline_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skyline of each picture by columns, without rows that stray from the median of the 15 columns around by over two."""
    e = _edges(_picture(spark, sf_dir))
    w = Window.partitionBy("image").orderBy("x").rowsBetween(-7, 7)
    return e.withColumn("median", F.expr("percentile(y, 0.5)").over(w)).where(F.abs(F.col("y") - F.col("median")) <= 2).select("image", "x", "y")


def _model(az: Column) -> Column:
    """Elevation of the true skyline (degrees)."""
    return 0.8 * F.sin(F.radians(az * 7)) + 0.4 * F.sin(F.radians(az * 17))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skylines seen by cameras (image, x, el): bearings and tilts to be found."""
    n = table(spark, sf_dir, "nation").where("n_nationkey < 8").select(F.col("n_nationkey").alias("image"), (F.col("n_nationkey") * 4 + 210.0).alias("true_az"))
    p = n.withColumn("x", F.explode(F.sequence(F.lit(-20), F.lit(20))))
    return p.select("image", "x", F.round(_model(F.col("true_az") + F.col("x") * 0.25) + 0.3 + F.col("x") * 0.002, 6).alias("el"))


def _costs(spark: SparkSession, sf_dir: str, step: float, rolls: list[float]) -> DataFrame:
    """(image, az0, roll, cost): root mean square of the residuals about their median, over a grid of bearings and rolls."""
    n = int(round(40 / step))
    grid = spark.range(n).select((F.col("id") * step + 205).alias("az0")).withColumn("roll", F.explode(F.array(*[F.lit(r) for r in rolls])))
    r = _profile(spark, sf_dir).crossJoin(F.broadcast(grid)).withColumn("r", F.round(F.col("el") - F.col("x") * F.col("roll") - _model(F.col("az0") + F.col("x") * 0.25), 6))
    per = r.groupBy("image", "az0", "roll").agg(F.expr("percentile(r, 0.5)").alias("tilt"), F.avg("r").alias("m"), F.avg(F.col("r") * F.col("r")).alias("m2"))
    # the mean of (r - tilt) ^ 2 from the first two moments: one pass
    return per.select("image", F.round("az0", 4).alias("az0"), "roll", F.round(F.col("tilt"), 5).alias("tilt"), F.round(F.sqrt(F.greatest(F.col("m2") - 2 * F.col("tilt") * F.col("m") + F.col("tilt") * F.col("tilt"), F.lit(0.0))), 4).alias("cost"))


def skyline_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearing, roll and tilt of each camera that fit its skyline best."""
    c = _costs(spark, sf_dir, 0.5, [-0.002, 0.0, 0.002])
    return c.groupBy("image").agg(F.min(F.struct("cost", "az0", "roll", "tilt")).alias("b")).select("image", "b.cost", "b.az0", "b.roll", F.round("b.tilt", 4).alias("tilt"))


def score_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost at every bearing on a grid of 0.25 degrees."""
    return _costs(spark, sf_dir, 0.25, [0.0]).select("image", "az0", "cost")


def diverse_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten bearings of each camera of which no two are nearer than three degrees: taken greedily in order of cost.

    The order-dependent choice is a fold over a sorted array of one camera's bearings, whose number the grid bounds.
    """
    per = score_curve(spark, sf_dir).groupBy("image").agg(F.sort_array(F.collect_list(F.struct("cost", "az0"))).alias("cells"))
    none = F.array().cast("array<struct<cost:double,az0:double>>")
    taken = F.aggregate("cells", none, lambda got, x: F.when((F.size(got) >= 10) | F.exists(got, lambda q: F.abs(q["az0"] - x["az0"]) < 3), got).otherwise(F.concat(got, F.array(x))))
    return per.select("image", F.posexplode(taken).alias("rank", "s")).select("image", "rank", "s.az0", "s.cost")


def boundary_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that all sightings fall on visible samples if visibility told nothing: the product of visible shares, each to the power of its burst's sightings."""
    s = view(spark, sf_dir, "series").where("seq % 3 <> 0").groupBy("user_id").agg(F.avg(F.when(F.col("v") < 60, 1.0).otherwise(0.0)).alias("f"), (F.count("*") % 4).alias("n"))
    return s.where("f > 0").groupBy((F.col("user_id") % 7).alias("night")).agg(F.round(F.sum(F.col("n") * F.log("f")), 6).alias("log_p"), F.round(F.exp(F.sum(F.col("n") * F.log("f"))), 8).alias("p"))


def model_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture coordinates of the model skyline at directions every half degree, in cameras of known pose."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 4 + 160.0).alias("az0"))
    d = n.withColumn("az", F.explode(F.transform(F.sequence(F.lit(-10), F.lit(10)), lambda i: i * 0.5))).withColumn("az", F.col("az0") + F.col("az"))
    u, v = geo.pinhole(F.col("az"), _model(F.col("az")), F.col("az0"), F.lit(0.3), F.lit(1.0), F.lit(1500.0))
    return d.select("n_nationkey", "az", F.round(u, 3).alias("u"), F.round(v, 3).alias("v"))


def device_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources on the screen of a held device: rotation of its angles, calibration offsets, null behind it."""
    s = view(spark, sf_dir, "sources").select("source_id", "az", "el", (F.col("source_id") * 11 % 360).cast("double").alias("a"), (80.0 + F.col("source_id") % 20).alias("b"), (F.col("source_id") % 9 - 4.0).alias("g"))
    x, y = geo.device_screen(F.col("az"), F.col("el"), F.col("a"), F.col("b"), F.col("g"), F.lit(1.5), F.lit(-0.5), F.lit(900.0))
    return s.select("source_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def local_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and azimuth of each target in the local plane, the azimuth corrected by half the meridian convergence."""
    t = view(spark, sf_dir, "targets")
    d, az = geo.local_plane(F.lit(LON0), F.lit(LAT0), F.col("lon"), F.col("lat"))
    return t.select("target_id", F.round(d, 3).alias("dist"), F.round(az, 7).alias("az"))


def utm_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitude and latitude of UTM coordinates."""
    s = table(spark, sf_dir, "part").select("p_partkey", (500_000.0 + (F.col("p_partkey") * 137 % 200_000)).alias("e"), (3_300_000.0 + (F.col("p_partkey") * 911 % 200_000)).alias("n"))
    lon, lat = geo.utm_inverse(F.col("e"), F.col("n"))
    return s.select("p_partkey", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


def geoid_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geoid undulation at each target: bilinear between the nodes of a grid of longitudes 0 to 360; a place outside has none."""
    node = spark.range(0, 60 * 40).select(F.floor(F.col("id") / 60).alias("r"), (F.col("id") % 60).alias("c")).withColumn("z", -22 + F.sin(F.col("r") * 0.2) + F.cos(F.col("c") * 0.3))
    t = view(spark, sf_dir, "targets").select("target_id", F.pmod("lon", F.lit(360.0)).alias("lon"), "lat")
    row, col = F.round((30.3 - F.col("lat")) / 0.005, 9), F.round((F.col("lon") - 255.85) / 0.005, 9)
    return joins.bilinear(t, row, col, node, ["target_id"], "n").select("target_id", F.round("n", 6).alias("n"))


def null_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that the median of random draws is at most the observed one: draws take values from each burst's own pool, (hits + 1) / (draws + 1).

    Draws are rows; pools have numbered members, so a draw is an equi-join and no pool is gathered.
    """
    w = Window.partitionBy("user_id").orderBy("v", "seq")
    pool = view(spark, sf_dir, "series").where("user_id < 12").select("user_id", "v", (F.row_number().over(w) - 1).alias("nth"))
    size = pool.groupBy("user_id").agg(F.count("*").alias("n"), (F.max("user_id") % 3 + 1).alias("units"))
    draws = size.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(199)))).withColumn("unit", F.explode(F.sequence(F.lit(1).cast("long"), F.col("units"))))
    nth = F.floor(uniform(F.col("draw") * 1000 + F.col("user_id") * 10 + F.col("unit"), 5) * F.col("n"))
    got = draws.select("user_id", "draw", nth.alias("nth")).join(pool, ["user_id", "nth"]).groupBy("draw").agg(F.expr("percentile(v, 0.5)").alias("m"))
    return got.crossJoin(F.broadcast(spark.range(3).select((F.col("id") * 10 + 20.0).alias("observed")))).groupBy("observed").agg(F.round((F.count_if(F.col("m") <= F.col("observed")) + 1) / (F.count("*") + 1), 6).alias("p"), F.round(F.avg("m"), 6).alias("mean"))


def plane_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older criterion on plane profiles every 500 m: one minus the smallest curvature that clears a sample, over all and beyond 1 km of the target."""
    t = view(spark, sf_dir, "targets").withColumns({"dt": geo.haversine(F.lit(LON0), F.lit(LAT0), F.col("lon"), F.col("lat")), "az": geo.bearing(F.lit(LON0), F.lit(LAT0), F.col("lon"), F.col("lat"))})
    t = t.withColumn("zt", visibility.terrain(F.col("lon"), F.col("lat")) + 0.7)
    s = t.withColumn("d", F.explode(visibility.evenly(500.0)(F.col("dt"))))
    lon, lat = geo.spherical_direct(F.lit(LON0), F.lit(LAT0), F.col("az"), F.col("d"))
    s = s.withColumns({"plon": lon, "plat": lat})
    eye = GROUND + EYE
    c = 2 * geo.R_SPHERE * ((F.col("zt") - eye) / F.col("dt") - (visibility.terrain(F.col("plon"), F.col("plat")) - eye) / F.col("d")) / (F.col("dt") - F.col("d"))
    far = F.min(F.when(F.col("dt") - F.col("d") >= 1000, c))
    return s.groupBy("target_id").agg(F.round(1 - F.min(c), 3).alias("k_crit"), F.round(1 - far, 3).alias("k_far"))


def ground_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights along four rays over the raster, both ends kept; null where a neighbour has no data."""
    rays = spark.createDataFrame([(0, 0.2, 0.3, 55.0), (1, 3.0, 0.0, 50.0), (2, 20.0, 1.0, 30.0), (3, 58.0, 0.5, -40.0)], "ray long, r0 double, c0 double, length double")
    parts = F.ceil(F.abs(F.col("length")) / 4)
    p = rays.withColumn("parts", parts).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts"))))
    p = p.select("ray", "i", (F.col("r0") + F.col("length") * F.col("i") / F.col("parts")).alias("row"), F.col("c0").alias("col"))
    return joins.bilinear(p, F.col("row"), F.col("col"), view(spark, sf_dir, "raster"), ["ray", "i"], "z").select("ray", "i", F.round("z", 6).alias("z"))


def profile_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For bearings in view: the target within 0.3 degrees whose distance is nearest to the highway's there, and its height over the eye's plane at two coefficients."""
    b = spark.createDataFrame([(205.0, 12_000.0), (215.0, 15_000.0), (225.0, 20_000.0)], "b double, reach double")
    t = view(spark, sf_dir, "targets").withColumns({"az": F.round(geo.bearing(F.lit(LON0), F.lit(LAT0), F.col("lon"), F.col("lat")), 6), "d": F.round(geo.haversine(F.lit(LON0), F.lit(LAT0), F.col("lon"), F.col("lat")), 3)})
    met = t.crossJoin(F.broadcast(b)).where(F.abs(F.col("az") - F.col("b")) < 0.3)
    best = met.groupBy("b", "reach").agg(F.min(F.struct(F.abs(F.col("d") - F.col("reach")).alias("off"), "target_id", "lon", "lat")).alias("t"))
    z = visibility.terrain(F.col("t.lon"), F.col("t.lat")) + 0.66 - GROUND - EYE
    over = lambda k: F.round(z - F.col("reach") * F.col("reach") * (1 - k) / (2 * geo.R_SPHERE), 3)
    return best.select("b", "t.target_id", over(0.13).alias("at_013"), over(0.5).alias("at_05"))


def road_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible stretches of each line as curves of three vertices or more: their spans and middles."""
    l = view(spark, sf_dir, "lines").withColumn("seen", F.col("rate").isNotNull() & (F.col("rate") > 0))
    w = Window.partitionBy("line_id").orderBy("seq")
    runs = windows.islands(l.withColumn("_other", F.lag("seen").over(w) != F.col("seen")), "line_id", ["seq"], F.col("_other")).where("seen")
    per = runs.groupBy("line_id", "island").agg(F.count("*").alias("vertices"), F.min("az").alias("az0"), F.max("az").alias("az1"), F.element_at(F.sort_array(F.collect_list(F.struct("seq", "az"))), (F.count("*") / 2).cast("int") + 1)["az"].alias("middle"))
    return per.where("vertices >= 3").select("line_id", "vertices", *(F.round(c, 6).alias(c) for c in ("az0", "az1", "middle")))


def star_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Azimuth and elevation of six stars at the times of events, from the sidereal time of the viewer."""
    # Right ascension (hours) and declination (degrees) of bright stars
    stars = spark.createDataFrame([("Sirius", 6.7525, -16.7161), ("Canopus", 6.3992, -52.6957), ("Vega", 18.6156, 38.7837), ("Arcturus", 14.2610, 19.1825), ("Antares", 16.4901, -26.4320), ("Fomalhaut", 22.9608, -29.6222)], "star string, ra double, dec double")
    e = table(spark, sf_dir, "events").where("event_id % 10 = 0").select("event_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2000-01-01 12:00:00', ts)").alias("s"))
    az, el = geo.star_place(F.col("ra"), F.col("dec"), F.col("s"), LON0, LAT0)
    return e.crossJoin(F.broadcast(stars)).select("event_id", "star", F.round(az, 5).alias("az"), F.round(el, 6).alias("el"))


def lens_focals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focal lengths in pixels from a 35 mm equivalent, or from millimetres and the focal plane's resolution with its unit."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 20.0).alias("f35"), (F.col("p_size") / 2 + 4).alias("mm"), (F.col("p_partkey") % 4 + 2).cast("int").alias("unit"), (F.col("p_retailprice") * 4).alias("resolution"))
    return p.select("p_partkey", F.round(geo.equivalent_focal_px(F.col("f35"), F.lit(6000.0), F.lit(3376.0)), 4).alias("by_35"), F.round(geo.focal_plane_px(F.col("mm"), F.col("resolution"), F.col("unit")), 4).alias("by_plane"))


_DET = "a AS (SELECT n_regionkey AS image, n_nationkey AS anchor, floor(n_nationkey / 5) * 3e0 + n_regionkey AS az, n_nationkey % 3 * 5e-1 AS el FROM nation), d AS (SELECT image, anchor AS det, round((az - 5) * 40 + CASE WHEN anchor % 7 = 6 THEN 90e0 ELSE 0e0 END, 4) AS u, round((el - 5e-1) * 40 - CASE WHEN anchor % 7 = 6 THEN 90e0 ELSE 0e0 END, 4) AS v FROM a)"
_MODEL = "8e-1 * sin(radians(({0}) * 7)) + 4e-1 * sin(radians(({0}) * 17))"
_PICTURE = "p AS (SELECT image, x, y, round(CASE WHEN y < 18 + 6 * sin(x * 3e-1 + image) THEN 120e0 ELSE 60e0 END + (x * 7 + y * 13 + image * 5) % 11 * 4e-1, 6) AS l FROM (SELECT n_nationkey AS image FROM nation WHERE n_nationkey < 6), range(40) r(x), range(50) s(y)), e AS (SELECT *, round(abs(lag(l, 2) OVER w - lead(l, 2) OVER w), 6) AS e, round(abs(avg(l) OVER (w ROWS BETWEEN 14 PRECEDING AND 4 PRECEDING) - avg(l) OVER (w ROWS BETWEEN 4 FOLLOWING AND 14 FOLLOWING)), 6) AS step FROM p WINDOW w AS (PARTITION BY image, x ORDER BY y)), m AS (SELECT image, x, max(e) AS top, quantile_cont(e, 0.5) AS m FROM e GROUP BY 1, 2), q AS (SELECT e.image, e.x, 14826e-4 * quantile_cont(abs(e - m), 0.5) + 25e-2 AS noise FROM e JOIN m ON m.image = e.image AND m.x = e.x GROUP BY 1, 2), k AS (SELECT e.image, e.x, min(y) AS y FROM e JOIN m ON m.image = e.image AND m.x = e.x JOIN q ON q.image = e.image AND q.x = e.x WHERE e >= round(greatest(35e-2 * top, m + 7 * noise, 25e-1), 6) AND step >= 5e-1 * e GROUP BY 1, 2)"


def _costs_sql(step: str, n: int, rolls: str) -> str:
    return f"pr AS (SELECT image, x, round({_MODEL.format('true_az + x * 25e-2')} + 3e-1 + x * 2e-3, 6) AS el FROM (SELECT n_nationkey AS image, n_nationkey * 4 + 210e0 AS true_az FROM nation WHERE n_nationkey < 8), range(-20, 21) r(x)), g AS (SELECT i * {step} + 205 AS az0, roll FROM range({n}) r(i), (VALUES {rolls}) t(roll)), rs AS (SELECT image, az0, roll, round(el - x * roll - ({_MODEL.format('az0 + x * 25e-2')}), 6) AS r FROM pr, g), cs AS (SELECT image, az0, roll, quantile_cont(r, 0.5) AS tilt, avg(r) AS m, avg(r * r) AS m2 FROM rs GROUP BY 1, 2, 3), co AS (SELECT image, round(az0, 4) AS az0, roll, round(tilt, 5) AS tilt, round(sqrt(greatest(m2 - 2 * tilt * m + tilt * tilt, 0)), 4) AS cost FROM cs)"


_E2 = f"{geo.E2!r}::DOUBLE"
QUERIES = {
    f.__name__: f
    for f in (
        pose_hypotheses, skyline_edges, skyline_search, score_curve, diverse_seeds, boundary_test, model_line, device_screen, local_plane, utm_places, geoid_heights, null_medians, plane_critical, ground_profiles, profile_targets,
        road_curves, star_places, lens_focals,
    )
}
_UTM = geo.utm_constants()
ORACLES = {
    "pose_hypotheses": f"WITH {_DET}, dp AS (SELECT x.image, x.det AS det1, y.det AS det2, x.u AS u1, x.v AS v1, sqrt(pow(x.u - y.u, 2) + pow(x.v - y.v, 2)) AS dp FROM d x JOIN d y ON x.image = y.image AND x.det <> y.det), ap AS (SELECT x.image, x.anchor AS anchor1, y.anchor AS anchor2, x.az AS az1, x.el AS el1, sqrt(pow(x.az - y.az, 2) + pow(x.el - y.el, 2)) AS sa FROM a x JOIN a y ON x.image = y.image AND x.anchor <> y.anchor), h AS (SELECT dp.image, det1, det2, anchor1, anchor2, round(dp / sa, 6) AS f, u1, v1, az1, el1 FROM dp JOIN ap ON ap.image = dp.image WHERE dp >= 15 AND sa >= 5e-2 AND abs(round(dp / sa, 6) / 40 - 1) <= 4e-2), p AS (SELECT *, round(az1 - u1 / f, 6) AS az0, round(el1 - v1 / f, 6) AS el0 FROM h), n AS (SELECT p.image, det1, det2, anchor1, anchor2, f, az0, el0, a.anchor, min(round(sqrt(pow(d.u - (a.az - az0) * f, 2) + pow(d.v - (a.el - el0) * f, 2)), 4)) AS miss FROM p JOIN a ON a.image = p.image JOIN d ON d.image = p.image GROUP BY ALL), s AS (SELECT image, det1, det2, anchor1, anchor2, f, az0, el0, count(*) AS inliers, round(sum(miss), 3) AS misfit FROM n WHERE miss < 4 GROUP BY ALL) SELECT image, inliers, round(f, 4) AS f, round(az0, 4) AS az0, round(el0, 4) AS el0 FROM s QUALIFY row_number() OVER (PARTITION BY image ORDER BY inliers DESC, misfit, det1, det2, anchor1, anchor2) = 1",
    "skyline_edges": f"WITH {_PICTURE}, o AS (SELECT *, quantile_cont(y, 0.5) OVER (PARTITION BY image ORDER BY x ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS md FROM k) SELECT image, x::INT AS x, y::INT AS y FROM o WHERE abs(y - md) <= 2",
    "skyline_search": f"WITH {_costs_sql('5e-1', 80, '(-2e-3), (0e0), (2e-3)')} SELECT image, cost, az0, roll, round(tilt, 4) AS tilt FROM co QUALIFY row_number() OVER (PARTITION BY image ORDER BY cost, az0, roll) = 1",
    "score_curve": f"WITH {_costs_sql('25e-2', 160, '(0e0)')} SELECT image, az0, cost FROM co",
    "diverse_seeds": f"WITH RECURSIVE {_costs_sql('25e-2', 160, '(0e0)')}, o AS (SELECT image, az0, cost, row_number() OVER (PARTITION BY image ORDER BY cost, az0) AS n FROM co), r AS (SELECT image, 1::BIGINT AS n, [az0] AS got, [cost] AS costs FROM o WHERE n = 1 UNION ALL SELECT r.image, o.n, CASE WHEN len(got) >= 10 OR len(list_filter(got, lambda q: abs(q - o.az0) < 3)) > 0 THEN got ELSE list_append(got, o.az0) END, CASE WHEN len(got) >= 10 OR len(list_filter(got, lambda q: abs(q - o.az0) < 3)) > 0 THEN costs ELSE list_append(costs, o.cost) END FROM r JOIN o ON o.image = r.image AND o.n = r.n + 1), z AS (SELECT image, got, costs FROM r WHERE n = 160) SELECT image, (unnest(range(len(got))))::INT AS rank, unnest(got) AS az0, unnest(costs) AS cost FROM z",
    "boundary_test": "WITH s AS (SELECT user_id, avg(CASE WHEN v < 60 THEN 1e0 ELSE 0e0 END) AS f, count(*) % 4 AS n FROM v_series WHERE seq % 3 <> 0 GROUP BY user_id) SELECT user_id % 7 AS night, round(sum(n * ln(f)), 6) AS log_p, round(exp(sum(n * ln(f))), 8) AS p FROM s WHERE f > 0 GROUP BY 1",
    "model_line": f"WITH d AS (SELECT n_nationkey, n_nationkey * 4 + 160e0 AS az0, n_nationkey * 4 + 160e0 + i * 5e-1 AS az FROM nation, range(-10, 11) r(i)), a AS (SELECT *, radians(az - az0) AS d, radians({_MODEL.format('az')}) AS e, radians(3e-1) AS f FROM d), p AS (SELECT *, cos(e) * sin(d) AS x, sin(e) * sin(f) + cos(e) * cos(f) * cos(d) AS z, sin(e) * cos(f) - cos(e) * sin(f) * cos(d) AS y FROM a) SELECT n_nationkey, az, round(1500 * x / z * cos(radians(1e0)) + 1500 * y / z * sin(radians(1e0)), 3) AS u, round(1500 * x / z * sin(radians(1e0)) - 1500 * y / z * cos(radians(1e0)), 3) AS v FROM p",
    "device_screen": "WITH s AS (SELECT source_id, radians(az - 15e-1) AS az, radians(el + 5e-1) AS el, radians((source_id * 11 % 360)::DOUBLE) AS a, radians(80e0 + source_id % 20) AS b, radians(source_id % 9 - 4e0) AS g FROM v_sources), w AS (SELECT *, cos(el) * sin(az) AS x, cos(el) * cos(az) AS y, sin(el) AS z FROM s), v AS (SELECT source_id, (cos(a) * cos(g) - sin(a) * sin(b) * sin(g)) * x + (sin(a) * cos(g) + cos(a) * sin(b) * sin(g)) * y - cos(b) * sin(g) * z AS p, -sin(a) * cos(b) * x + cos(a) * cos(b) * y + sin(b) * z AS q, -((cos(a) * sin(g) + sin(a) * sin(b) * cos(g)) * x + (sin(a) * sin(g) - cos(a) * sin(b) * cos(g)) * y + cos(b) * cos(g) * z) AS f FROM w) SELECT source_id, CASE WHEN f > 2e-2 THEN round(9e2 * p / f, 3) END AS x, CASE WHEN f > 2e-2 THEN round(-9e2 * q / f, 3) END AS y FROM v",
    "local_plane": f"WITH t AS (SELECT target_id, lon - ({LON0}::DOUBLE) AS dl, radians(lat - {LAT0}::DOUBLE) AS dp, radians((lat + {LAT0}::DOUBLE) / 2) AS lm FROM v_targets), m AS (SELECT *, {geo.A}::DOUBLE * (1 - {_E2}) / pow(1 - {_E2} * sin(lm) * sin(lm), 15e-1) AS m, {geo.A}::DOUBLE / sqrt(1 - {_E2} * sin(lm) * sin(lm)) AS n FROM t), d AS (SELECT *, dp * m AS dn, radians(dl) * n * cos(lm) AS de FROM m) SELECT target_id, round(sqrt(dn * dn + de * de), 3) AS dist, round(((degrees(atan2(de, dn)) - dl * sin(lm) / 2) % 360 + 360) % 360, 7) AS az FROM d",
    "utm_places": f"WITH s AS (SELECT p_partkey, (p_partkey * 137 % 200000)::DOUBLE AS e, (3300000e0 + p_partkey * 911 % 200000) / 9996e-4 / {_UTM['scale']!r}::DOUBLE AS mu FROM part), f AS (SELECT *, mu + {_UTM['f2']!r}::DOUBLE * sin(2 * mu) + {_UTM['f4']!r}::DOUBLE * sin(4 * mu) + {_UTM['f6']!r}::DOUBLE * sin(6 * mu) + {_UTM['f8']!r}::DOUBLE * sin(8 * mu) AS q FROM s), g AS (SELECT *, {_UTM['ep']!r}::DOUBLE * cos(q) * cos(q) AS c, tan(q) * tan(q) AS t, {geo.A}::DOUBLE / sqrt(1 - {_E2} * sin(q) * sin(q)) AS n, {geo.A}::DOUBLE * (1 - {_E2}) / pow(1 - {_E2} * sin(q) * sin(q), 15e-1) AS r FROM f), h AS (SELECT *, e / (n * 9996e-4) AS d FROM g) SELECT p_partkey, round(degrees((d - (1 + 2 * t + c) * pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * {_UTM['ep']!r}::DOUBLE + 24 * t * t) * pow(d, 5) / 120) / cos(q)) - 105, 8) AS lon, round(degrees(q - n * tan(q) / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * {_UTM['ep']!r}::DOUBLE) * pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * {_UTM['ep']!r}::DOUBLE - 3 * c * c) * pow(d, 6) / 720)), 8) AS lat FROM h",
    "geoid_heights": "WITH g AS (SELECT i // 60 AS r, i % 60 AS c, -22 + sin(i // 60 * 2e-1) + cos(i % 60 * 3e-1) AS z FROM range(2400) x(i)), t AS (SELECT target_id, round((303e-1 - lat) / 5e-3, 9) AS y, round((lon + 360 - 25585e-2) / 5e-3, 9) AS x FROM v_targets), f AS (SELECT *, floor(y) AS r0, floor(x) AS c0 FROM t), q AS (SELECT target_id, a, b, r0 + a AS r, c0 + b AS c, CASE WHEN a = 1 THEN y - r0 ELSE 1 - (y - r0) END * CASE WHEN b = 1 THEN x - c0 ELSE 1 - (x - c0) END AS w FROM f, range(2) p(a), range(2) s(b)) SELECT target_id, round(CASE WHEN count(z) = 4 THEN sum(w * z) END, 6) AS n FROM q LEFT JOIN g ON g.r = q.r AND g.c = q.c GROUP BY target_id",
    "null_medians": "",
    "plane_critical": f"WITH t AS (SELECT target_id, radians(lon) AS l, radians(lat) AS q, radians({LON0}::DOUBLE) AS l0, radians({LAT0}::DOUBLE) AS p, 1400 + 25 * sin(lon * 150) * cos(lat * 120) + 10 * sin(lat * 400) + 7e-1 AS zt FROM v_targets), a AS (SELECT *, 2 * {geo.R_SPHERE}::DOUBLE * asin(sqrt(pow(sin((q - p) / 2), 2) + cos(p) * cos(q) * pow(sin((l - l0) / 2), 2))) AS dt, atan2(sin(l - l0) * cos(q), cos(p) * sin(q) - sin(p) * cos(q) * cos(l - l0)) AS az FROM t), n AS (SELECT *, greatest(ceil(dt / 500), 2)::BIGINT AS n FROM a), s AS (SELECT *, dt * unnest(range(1, n)) / n AS d FROM n), u AS (SELECT *, asin(sin(p) * cos(d / {geo.R_SPHERE}::DOUBLE) + cos(p) * sin(d / {geo.R_SPHERE}::DOUBLE) * cos(az)) AS pq FROM s), v AS (SELECT *, degrees(pq) AS la, degrees(l0 + atan2(sin(az) * sin(d / {geo.R_SPHERE}::DOUBLE) * cos(p), cos(d / {geo.R_SPHERE}::DOUBLE) - sin(p) * sin(pq))) AS lo FROM u), c AS (SELECT target_id, dt, d, 2 * {geo.R_SPHERE}::DOUBLE * ((zt - 15016e-1) / dt - (1400 + 25 * sin(lo * 150) * cos(la * 120) + 10 * sin(la * 400) - 15016e-1) / d) / (dt - d) AS c FROM v) SELECT target_id, round(1 - min(c), 3) AS k_crit, round(1 - min(c) FILTER (dt - d >= 1000), 3) AS k_far FROM c GROUP BY target_id",
    "ground_profiles": "WITH y(ray, r0, c0, len) AS (VALUES (0, 2e-1, 3e-1, 55e0), (1, 3e0, 0e0, 50e0), (2, 20e0, 1e0, 30e0), (3, 58e0, 5e-1, -40e0)), n AS (SELECT *, ceil(abs(len) / 4)::BIGINT AS n FROM y), p AS (SELECT ray, i, r0 + len * i / n AS y, c0 AS x FROM (SELECT *, unnest(range(n + 1)) AS i FROM n)), f AS (SELECT *, floor(y) AS fr, floor(x) AS fc FROM p), q AS (SELECT ray, i, fr + a AS r, fc + b AS c, CASE WHEN a = 1 THEN y - fr ELSE 1 - (y - fr) END * CASE WHEN b = 1 THEN x - fc ELSE 1 - (x - fc) END AS w FROM f, range(2) s(a), range(2) t(b)) SELECT ray, i, round(CASE WHEN count(z) = 4 THEN sum(w * z) END, 6) AS z FROM q LEFT JOIN v_raster v ON v.r = q.r AND v.c = q.c GROUP BY ray, i",
    "profile_targets": f"WITH b(b, reach) AS (VALUES (205e0, 12000e0), (215e0, 15000e0), (225e0, 20000e0)), t AS (SELECT target_id, lon, lat, radians(lon) AS l, radians(lat) AS q, radians({LON0}::DOUBLE) AS l0, radians({LAT0}::DOUBLE) AS p FROM v_targets), a AS (SELECT *, round(2 * {geo.R_SPHERE}::DOUBLE * asin(sqrt(pow(sin((q - p) / 2), 2) + cos(p) * cos(q) * pow(sin((l - l0) / 2), 2))), 3) AS d, round((degrees(atan2(sin(l - l0) * cos(q), cos(p) * sin(q) - sin(p) * cos(q) * cos(l - l0))) % 360 + 360) % 360, 6) AS az FROM t), m AS (SELECT * FROM a, b WHERE abs(az - b) < 3e-1 QUALIFY row_number() OVER (PARTITION BY b ORDER BY abs(d - reach), target_id) = 1), z AS (SELECT *, 1400 + 25 * sin(lon * 150) * cos(lat * 120) + 10 * sin(lat * 400) + 66e-2 - 1500 - 16e-1 AS z FROM m) SELECT b, target_id, round(z - reach * reach * (1 - 13e-2) / (2 * {geo.R_SPHERE}::DOUBLE), 3) AS at_013, round(z - reach * reach * (1 - 5e-1) / (2 * {geo.R_SPHERE}::DOUBLE), 3) AS at_05 FROM z",
    "road_curves": "WITH l AS (SELECT *, rate IS NOT NULL AND rate > 0 AS seen FROM v_lines), a AS (SELECT *, CASE WHEN lag(seen) OVER (PARTITION BY line_id ORDER BY seq) <> seen THEN 1 ELSE 0 END AS new FROM l), b AS (SELECT *, sum(new) OVER (PARTITION BY line_id ORDER BY seq) AS island FROM a), g AS (SELECT line_id, island, count(*) AS vertices, min(az) AS az0, max(az) AS az1, list(az ORDER BY seq) AS azs FROM b WHERE seen GROUP BY line_id, island) SELECT line_id, vertices, round(az0, 6) AS az0, round(az1, 6) AS az1, round(azs[vertices // 2 + 1], 6) AS middle FROM g WHERE vertices >= 3",
    "star_places": f"WITH s(star, ra, dec) AS (VALUES ('Sirius', 67525e-4, -167161e-4), ('Canopus', 63992e-4, -526957e-4), ('Vega', 186156e-4, 387837e-4), ('Arcturus', 142610e-4, 191825e-4), ('Antares', 164901e-4, -264320e-4), ('Fomalhaut', 229608e-4, -296222e-4)), e AS (SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2000-01-01 12:00:00')) // 1000000 AS s FROM events WHERE event_id % 10 = 0), h AS (SELECT event_id, star, radians(((280.46061837::DOUBLE + 360.98564736629::DOUBLE * (s / 86400e0) + ({LON0}::DOUBLE) - ra * 15) % 360 + 360) % 360) AS h, radians(dec) AS d, radians({LAT0}::DOUBLE) AS p FROM e, s) SELECT event_id, star, round((degrees(atan2(-cos(d) * sin(h), sin(d) * cos(p) - cos(d) * sin(p) * cos(h))) % 360 + 360) % 360, 5) AS az, round(degrees(asin(sin(d) * sin(p) + cos(d) * cos(p) * cos(h))), 6) AS el FROM h",
    "lens_focals": "SELECT p_partkey, round((p_size + 20e0) * sqrt(6000e0 * 6000e0 + 3376e0 * 3376e0) / 432666e-4, 4) AS by_35, round((p_size / 2e0 + 4) * p_retailprice * 4 / CASE p_partkey % 4 + 2 WHEN 2 THEN 254e-1 WHEN 3 THEN 10e0 WHEN 4 THEN 1e0 ELSE 1e-3 END, 4) AS by_plane FROM part",
}
ORACLES["null_medians"] = f"WITH p AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v, seq) - 1 AS nth FROM v_series WHERE user_id < 12), n AS (SELECT user_id, count(*) AS n, user_id % 3 + 1 AS units FROM p GROUP BY user_id), d AS (SELECT user_id, n, draw, unnest(range(1, units + 1)) AS unit FROM n, range(200) r(draw)), k AS (SELECT user_id, draw, floor({_u('(draw * 1000 + user_id * 10 + unit)', 5)} * n)::BIGINT AS nth FROM d), m AS (SELECT draw, quantile_cont(v, 0.5) AS m FROM k JOIN p USING (user_id, nth) GROUP BY draw) SELECT i * 10 + 20e0 AS observed, round((count(*) FILTER (m <= i * 10 + 20e0) + 1) / (count(*) + 1e0), 6) AS p, round(avg(m), 6) AS mean FROM m, range(3) r(i) GROUP BY i"
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
