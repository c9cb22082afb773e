"""Queries of numeric kernels and raster operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..kernels import fit, geodesic, raytrace, sightline
from ..sources import readers
from ..streaming import state
from . import visibility
from .views import LAT0, LON0, table, view, with_views


def geodesic_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Azimuth and distance on the ellipsoid of each target, and how far the direct problem then misses it (metres)."""
    t = view(spark, sf_dir, "targets").withColumn("g", geodesic.inverse_column()(F.lit(LON0), F.lit(LAT0), "lon", "lat"))
    t = t.withColumn("b", geodesic.direct_column()(F.lit(LON0), F.lit(LAT0), "g.az", "g.dist"))
    miss = F.round(geo.haversine(F.col("lon"), F.col("lat"), F.col("b.lon"), F.col("b.lat")), 3)
    return t.select("target_id", F.round("g.az", 6).alias("az"), F.round("g.dist", 3).alias("dist"), miss.alias("miss"))


def mc_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that each target is seen under terrain and eye errors, 200 draws for those that six standard deviations leave open.

    Rays are made once and judged where the target is; targets of one place share the ray, but each has draws of its own, and a seed of
    its id makes reruns agree.
    """
    chance = lambda rays, ident, place: sightline.probability(rays, 0.13, 0.56, 70.0, 0.15, 200, ident, place)
    return visibility.reduced(view(spark, sf_dir, "targets"), (0.66,), {"p_vis": chance}, drawn=("p_vis",))


def mc_certain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets whose chance is 0 or 1 because no error of six standard deviations changes what is seen."""
    open_ = lambda rays, *_: sightline.probability(rays, 0.13, 0.56, 70.0, 0.15, 0)
    return visibility.reduced(view(spark, sf_dir, "targets"), (0.66,), {"p_vis": open_}).where("p_vis IS NOT NULL").select("target_id", "p_vis")


def raytrace_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of a target 20 km away over flat ground under six temperature profiles: number, lowest and highest launch angle (mrad).

    Scenarios are rows, the fan of rays is one vector in the kernel.  In the frame of the curved ground, rays bend up by the curvature of the Earth.
    """
    rows = [("standard", "lapse", -0.0065, 0.0), ("neutral", "lapse", -0.0098, 0.0), ("inversion", "lapse", 0.05, 0.0), ("stable", "stable", 3.0, 20.0), ("duct", "stable", 8.0, 30.0), ("layered", "layered", 0.12, 40.0)]
    scenarios = spark.createDataFrame(rows, "scenario string, kind string, a double, b double")

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                total, angles = 20_000.0, np.linspace(-0.004, 0.004, 1601)
                s = np.linspace(0, total, 401)
                end, blocked = raytrace.trace(angles, s, np.zeros_like(s), total, raytrace.profile(r.kind, r.a, r.b), eye=1.6, step=20.0, curvature=1 / 6371000.0)
                found = np.sort(raytrace.images(angles, end, blocked, 1.2)) * 1000
                out.append((r.scenario, len(found), float(found[0]) if len(found) else None, float(found[-1]) if len(found) else None))
            yield pd.DataFrame(out, columns=["scenario", "images", "lowest", "highest"])

    return scenarios.mapInPandas(run, "scenario string, images long, lowest double, highest double")


def pose_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras recovered from the projections of six anchors: one camera for each nation, a group each."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 4.0 + 160).alias("az0"))
    anchors = n.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumns({"az": F.col("az0") - 10 + F.col("j") * 4, "el": (F.col("j") % 3 - 1) * 1.5})
    u, v = geo.pinhole(F.col("az"), F.col("el"), F.col("az0"), F.lit(0.5), F.lit(2.0), F.lit(1500.0))

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        camera, rms = fit.camera_fit(f["u"].to_numpy(), f["v"].to_numpy(), f["az"].to_numpy(), f["el"].to_numpy(), (f["az"].mean(), 0.0, 0.0, 1400.0))
        return pd.DataFrame({"n_nationkey": [f["n_nationkey"].iloc[0]], "az0": [round(camera[0], 3)], "el0": [round(camera[1], 3)], "roll": [round(camera[2], 2)], "focal": [round(camera[3], 0)], "rms": [round(rms, 2)]})

    return anchors.withColumns({"u": u, "v": v}).groupBy("n_nationkey").applyInPandas(solve, "n_nationkey int, az0 double, el0 double, roll double, focal double, rms double")


def track_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that the detections of each user's events form."""
    s = view(spark, sf_dir, "series")
    d = s.select(F.col("user_id").alias("burst"), (F.floor(F.col("seq") / 3) * 20).cast("long").alias("frame"), F.when(F.col("v") > 60, "A").otherwise("B").alias("road"), (F.col("chain") / 50).alias("chain"), F.col("v").alias("az"))
    return state.association_batch(d).groupBy("burst").agg(F.countDistinct("unit").alias("units"), F.count("*").alias("detections"))


def tracked_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearings of panning cameras by a tracker that begins each frame's fit with the pose before it: one camera for each region."""
    n = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("video"))
    d = n.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(5))))
    pan = F.col("video") * 20.0 + 170 + F.col("frame") * 0.3
    d = d.withColumns({"az": pan - 10 + F.col("j") * 4, "el": (F.col("j") % 3 - 1) * 1.5})
    x, y = geo.pinhole(F.col("az"), F.col("el"), pan, F.lit(0.5), F.lit(1.0), F.lit(1500.0))
    out = state.track_batch(d.select("video", "frame", x.alias("x"), y.alias("y"), "az", "el"))
    return out.select("video", "frame", F.round("az0", 2).alias("az0"), F.round("focal", 0).alias("focal"), (F.col("rms") < 1).alias("fits"))


def contour_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of the rate map's cells of at least 0.5: border edges are an anti-join in Spark, a level's rings are closed in one group."""
    from .relations import rate_map_max_then_sum

    m = rate_map_max_then_sum(spark, sf_dir).where("rate >= 0.5").select("ia", "ie", F.lit(0.5).alias("level"))

    def outline(f: pd.DataFrame) -> pd.DataFrame:
        rings = fit.cell_rings(set(zip(f["ia"].tolist(), f["ie"].tolist(), strict=True)))
        return pd.DataFrame([(float(f["level"].iloc[0]), i, len(r), ";".join(f"{x},{y}" for x, y in r)) for i, r in enumerate(rings)], columns=["level", "ring", "vertices", "corners"])

    return m.groupBy("level").applyInPandas(outline, "level double, ring long, vertices long, corners string")


def contour_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners and enclosed area (holes negative) of the outlines of each level of the rate map."""
    from .relations import rate_map_max_then_sum

    m = rate_map_max_then_sum(spark, sf_dir).withColumn("level", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0)))).where("rate >= level").select("ia", "ie", "level")

    def outline(f: pd.DataFrame) -> pd.DataFrame:
        rings = fit.cell_rings(set(zip(f["ia"].tolist(), f["ie"].tolist(), strict=True)))
        area = sum(a[0] * b[1] - b[0] * a[1] for r in rings for a, b in zip(r[:-1], r[1:], strict=True)) / 2
        return pd.DataFrame({"level": [float(f["level"].iloc[0])], "corners": [sum(len(r) - 1 for r in rings)], "area": [float(area)]})

    return m.groupBy("level").applyInPandas(outline, "level double, corners long, area double")


def uniform_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of lamps 30 m above flat ground seen from 50 m, through constant gradients: one image each, whose angle (mrad) has a closed form."""
    rows = spark.range(24).select(F.col("id").alias("ray"), (2000.0 + F.col("id") % 6 * 700).alias("d"), (-0.0098 + F.floor(F.col("id") / 6) * 0.01).alias("gradient"))

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                angles, s = np.linspace(-0.03, 0.01, 801), np.linspace(0, r.d, 21)
                end, blocked = raytrace.trace(angles, s, np.zeros_like(s), r.d, raytrace.profile("lapse", r.gradient, 0.0), eye=50.0, step=20.0, curvature=1 / 6371000.0)
                found = raytrace.images(angles, end, blocked, 30.0) * 1000
                out.append((r.ray, len(found), round(float(found[0]), 5) if len(found) else None))
            yield pd.DataFrame(out, columns=["ray", "images", "angle"])

    return rows.repartition(4, "ray").mapInPandas(run, "ray long, images long, angle double")


def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of two small files against a manifest with one file changed and one missing."""
    found = readers.file_digests(spark, f"{sf_dir}/region.parquet").unionByName(readers.file_digests(spark, f"{sf_dir}/nation.parquet"))
    listed = found.select("file", "bytes", F.when(F.col("file") == "nation.parquet", F.lit("0")).otherwise(F.col("sha256")).alias("sha256")).unionByName(spark.createDataFrame([("gone.tif", 1, "0")], "file string, bytes long, sha256 string"))
    return readers.verify_manifest(found, listed)


def calibrated_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the latest calibration (an event of type click) of the user within 30 minutes: union and one window, no range join."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), "ts", "event_id", "value", (F.col("event_type") == "click").alias("absolute"))
    out = state.latest_calibration(e.where("NOT absolute").select("device", "ts", "event_id"), e.select("device", "ts", "absolute", F.col("value").alias("offset")))
    return out.select("event_id", "offset")


def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "raster")
    return r.groupBy(F.floor(F.col("r") / 6).alias("br"), F.floor(F.col("c") / 6).alias("bc")).agg(F.round(F.avg("z"), 6).alias("z"))


def terrain_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and hillshade by central differences in both directions, borders left out."""
    z = spark.range(3600).select(F.floor(F.col("id") / 60).alias("r"), (F.col("id") % 60).alias("c"))
    z = z.withColumn("z", 20 * F.sin(F.col("r") * 0.3) + 15 * F.cos(F.col("c") * 0.2))
    wr, wc = Window.partitionBy("c").orderBy("r"), Window.partitionBy("r").orderBy("c")
    z = z.withColumns({"dy": (F.lead("z").over(wr) - F.lag("z").over(wr)) / 20, "dx": (F.lead("z").over(wc) - F.lag("z").over(wc)) / 20})
    shade = (1 + F.col("dx") * 0.5 + F.col("dy") * 0.5) / (F.sqrt(1 + F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * 1.224744871391589)
    return z.where("dx IS NOT NULL AND dy IS NOT NULL").select("r", "c", F.round(F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))), 6).alias("slope"), F.round(shade, 6).alias("shade"))


def smoothed_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A separable 5 x 5 mean: rows, then columns."""
    z = spark.range(2500).select(F.floor(F.col("id") / 50).alias("r"), (F.col("id") % 50).alias("c"), (F.col("id") * 37 % 101).cast("double").alias("z"))
    z = z.withColumn("h", F.avg("z").over(Window.partitionBy("r").orderBy("c").rowsBetween(-2, 2)))
    return z.select("r", "c", F.round(F.avg("h").over(Window.partitionBy("c").orderBy("r").rowsBetween(-2, 2)), 6).alias("mean"))


def skyline_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest terrain angle of each azimuth, where it is, and within 10 and 25 km."""
    rays = spark.range(120).select((F.col("id") + 150.0).alias("az"))
    s = rays.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(80)))).withColumn("s", F.col("n") * 500.0)
    lon, lat = geo.spherical_direct(F.lit(LON0), F.lit(LAT0), F.col("az"), F.col("s"))
    s = s.withColumns({"lon": lon, "lat": lat})
    el = F.round(F.degrees(F.atan((visibility.terrain(F.col("lon"), F.col("lat")) - 1501.6 - F.col("s") * F.col("s") * 0.87 / (2 * geo.R_SPHERE)) / F.col("s"))), 7)
    s = s.withColumn("el", el)
    return s.groupBy("az").agg(F.max("el").alias("el"), F.max_by("s", F.struct("el", -F.col("s"))).alias("dist"), F.max(F.when(F.col("s") <= 10000, F.col("el"))).alias("ridge10"), F.max(F.when(F.col("s") <= 25000, F.col("el"))).alias("ridge25"))


QUERIES = {
    f.__name__: f
    for f in (geodesic_inverse, mc_visibility, mc_certain, raytrace_images, pose_fit, track_association, tracked_poses, contour_rings, contour_totals, uniform_rays, manifest_verify, calibrated_bearings, block_mean, terrain_slope, smoothed_raster, skyline_layers)
}


def _geodesic_sql() -> str:
    """Vincenty's inverse with a fixed number of steps: enough for tens of kilometres."""
    f, a = f"{geo.FLAT!r}::DOUBLE", f"{geo.A}::DOUBLE"
    steps = [f"g0 AS (SELECT target_id, radians(lon) - radians({LON0}::DOUBLE) AS dl, atan((1 - {f}) * tan(radians({LAT0}::DOUBLE))) AS u, atan((1 - {f}) * tan(radians(lat))) AS v, radians(lon) - radians({LON0}::DOUBLE) AS l FROM v_targets)"]
    for i in range(6):
        steps.append(f"a{i} AS (SELECT *, sqrt(pow(cos(v) * sin(l), 2) + pow(cos(u) * sin(v) - sin(u) * cos(v) * cos(l), 2)) AS ss, sin(u) * sin(v) + cos(u) * cos(v) * cos(l) AS cs FROM g{i})")
        steps.append(f"b{i} AS (SELECT *, atan2(ss, cs) AS sg, cos(u) * cos(v) * sin(l) / ss AS sa FROM a{i})")
        steps.append(f"c{i} AS (SELECT *, 1 - sa * sa AS ca, cs - 2 * sin(u) * sin(v) / (1 - sa * sa) AS cm, {f} / 16 * (1 - sa * sa) * (4 + {f} * (4 - 3 * (1 - sa * sa))) AS c FROM b{i})")
        steps.append(f"g{i + 1} AS (SELECT target_id, dl, u, v, dl + (1 - c) * {f} * sa * (sg + c * ss * (cm + c * cs * (2 * cm * cm - 1))) AS l, ss AS s0, cs AS c0, sg AS sg0, ca AS ca0, cm AS cm0 FROM c{i})")
    steps.append(f"h AS (SELECT *, ca0 * (1 / ((1 - {f}) * (1 - {f})) - 1) AS k FROM g6)")
    steps.append("q AS (SELECT *, 1 + k / 16384 * (4096 + k * (320 * k - 768 - 175 * k * k)) AS big, k / 1024 * (256 + k * (74 * k - 128 - 47 * k * k)) AS b FROM h)")
    return f"WITH {', '.join(steps)} SELECT target_id, round((degrees(atan2(cos(v) * sin(l), cos(u) * sin(v) - sin(u) * cos(v) * cos(l))) % 360 + 360) % 360, 6) AS az, round({a} * (1 - {f}) * big * (sg0 - b * s0 * (cm0 + b / 4 * (c0 * (2 * cm0 * cm0 - 1) - b / 6 * cm0 * (4 * s0 * s0 - 3) * (4 * cm0 * cm0 - 3)))), 3) AS dist, 0e0 AS miss FROM q"


_RATES = "(SELECT ia, ie, round(sum(r), 6) AS rate FROM (SELECT line_id, ia, ie, max(rate) AS r FROM (SELECT *, greatest(ceil(round((az - 6e-1 - 150) / 5e-1, 6)), 0) AS a0, least(floor(round((az + 6e-1 - 150) / 5e-1, 6)), 299) AS a1, greatest(ceil(round((el - 3e-1 + 2) / 25e-2, 6)), 0) AS e0, least(floor(round((el + 3e-1 + 2) / 25e-2, 6)), 23) AS e1 FROM v_lines WHERE rate IS NOT NULL) b, range(300) x(ia), range(24) y(ie) WHERE ia BETWEEN a0 AND a1 AND ie BETWEEN e0 AND e1 GROUP BY 1, 2, 3) GROUP BY 1, 2)"
ORACLES = {
    "geodesic_inverse": with_views(_geodesic_sql()),
    "manifest_verify": "SELECT * FROM (VALUES ('region.parquet', 'ok'), ('nation.parquet', 'changed'), ('gone.tif', 'missing')) v(file, status)",
    "tracked_poses": "SELECT r_regionkey::BIGINT AS video, f AS frame, round(r_regionkey * 20 + 170 + f * 3e-1, 2) AS az0, 15e2 AS focal, true AS fits FROM region, range(6) t(f)",
    "pose_fit": "SELECT n_nationkey, n_nationkey * 4 + 160e0 AS az0, 5e-1 AS el0, 2e0 AS roll, 15e2 AS focal, 0e0 AS rms FROM nation",
    "contour_totals": with_views(f"WITH m AS (SELECT ia, ie, level FROM {_RATES}, (VALUES (25e-2), (5e-1), (1e0)) l(level) WHERE rate >= level), p AS (SELECT level, ia + dx AS x, ie + dy AS y, count(*) AS n, count(*) FILTER (dx = dy) AS diagonal FROM m, range(2) a(dx), range(2) b(dy) GROUP BY 1, 2, 3), c AS (SELECT level, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND diagonal IN (0, 2) THEN 2 ELSE 0 END)::BIGINT AS corners FROM p GROUP BY level) SELECT level, corners, (SELECT count(*) FROM m WHERE m.level = c.level)::DOUBLE AS area FROM c"),
    "uniform_rays": "WITH r AS (SELECT i AS ray, 2000e0 + i % 6 * 700 AS d, -98e-4 + i // 6 * 1e-2 AS g FROM range(24) t(i)) SELECT ray, 1::BIGINT AS images, round(((30 - 50) / d - (1 / 6371000e0 - 7.87e-7::DOUBLE * 85000 / 84100 * (9.80665::DOUBLE / 287.05::DOUBLE + g)) * d / 2) * 1000, 5) AS angle FROM r",
    "mc_certain": visibility._sql((0.66,), ", b AS (SELECT target_id, y - 0.13::DOUBLE * s * (d - s) / (2 * radius) AS e, 6 * sqrt(0.56::DOUBLE * 0.56::DOUBLE + pow(0.15::DOUBLE * (d - s) / d, 2)) AS six FROM x), m AS (SELECT target_id, max(e + six) AS high, max(e - six) AS low FROM b GROUP BY target_id) SELECT target_id, CASE WHEN low > 0 THEN 0e0 ELSE 1e0 END AS p_vis FROM m WHERE low > 0 OR high <= 0"),
    "calibrated_bearings": "SELECT e.event_id, CASE WHEN date_diff('second', c.ts, e.ts) <= 1800 THEN c.value END AS \"offset\" FROM (SELECT * FROM events WHERE event_type <> 'click') e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'click') c ON c.user_id = e.user_id AND e.ts >= c.ts",
    "block_mean": with_views("SELECT r // 6 AS br, c // 6 AS bc, round(avg(z), 6) AS z FROM v_raster GROUP BY 1, 2"),
    "terrain_slope": "WITH g AS (SELECT i // 60 AS r, i % 60 AS c, 20 * sin((i // 60) * 0.3::DOUBLE) + 15 * cos((i % 60) * 0.2::DOUBLE) AS z FROM range(3600) x(i)), d AS (SELECT r, c, (lead(z) OVER (PARTITION BY c ORDER BY r) - lag(z) OVER (PARTITION BY c ORDER BY r)) / 20 AS dy, (lead(z) OVER (PARTITION BY r ORDER BY c) - lag(z) OVER (PARTITION BY r ORDER BY c)) / 20 AS dx FROM g) SELECT r, c, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope, round((1 + dx * 0.5 + dy * 0.5) / (sqrt(1 + dx * dx + dy * dy) * 1.224744871391589::DOUBLE), 6) AS shade FROM d WHERE dx IS NOT NULL AND dy IS NOT NULL",
    "smoothed_raster": "WITH g AS (SELECT i // 50 AS r, i % 50 AS c, (i * 37 % 101)::DOUBLE AS z FROM range(2500) x(i)), h AS (SELECT *, avg(z) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS h FROM g) SELECT r, c, round(avg(h) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean FROM h",
    "skyline_layers": f"WITH s AS (SELECT i + 15e1 AS az, n * 5e2 AS s, radians({LAT0}::DOUBLE) AS p, radians({LON0}::DOUBLE) AS p0, radians(i + 15e1) AS a, n * 5e2 / {geo.R_SPHERE}::DOUBLE AS d FROM range(120) x(i), range(1, 81) y(n)), q AS (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(a)) AS q FROM s), l AS (SELECT *, p0 + atan2(sin(a) * sin(d) * cos(p), cos(d) - sin(p) * sin(q)) AS l FROM q), e AS (SELECT az, s, round(degrees(atan(({visibility._terrain('degrees(l)', 'degrees(q)')} - 1501.6::DOUBLE - s * s * 0.87::DOUBLE / (2 * {geo.R_SPHERE}::DOUBLE)) / s)), 7) AS el FROM l) SELECT az, max(el) AS el, min(s) FILTER (WHERE el = m) AS dist, max(el) FILTER (WHERE s <= 10000) AS ridge10, max(el) FILTER (WHERE s <= 25000) AS ridge25 FROM (SELECT *, max(el) OVER (PARTITION BY az) AS m FROM e) GROUP BY az",
}
