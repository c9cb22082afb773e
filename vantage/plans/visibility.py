"""Line-of-sight queries: critical refraction, limiting samples, margins, clutter, lengths, comparisons.

The registered queries sample rays every 2 m within 3 km of both ends and every 5 m between.  That is some thousand samples a ray,
so their rays are made and reduced where the target is (``kernels.sightline``, map only); ``chord_samples`` and ``k_critical`` are the
same as column expressions, for surfaces that are columns or come from a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..kernels import sightline
from ..operators import windows
from ..sources import readers, scratch, writers
from .views import EYE, GROUND, LAT0, LON0, view, with_views

# Lamp heights (m), refraction coefficients, clutter (m)
LAMPS = (0.56, 0.66, 0.86, 1.12, 1.37, 2.5, 4.0)
KS = (0.0, 0.13, 0.25, 0.5, 1.0)
CLUTTER = (0.25, 0.5, 1.0)


def terrain(lon: Column, lat: Column) -> Column:
    """The analytic surface of tests and oracles."""
    return 1400 + 25 * F.sin(lon * 150) * F.cos(lat * 120) + 10 * F.sin(lat * 400)


def adaptive(total: Column) -> Column:
    """The reference sampling: every 2 m within 3 km of both ends, every 5 m between."""
    return windows.sample_distances(total, 5.0, 3.0, 3000.0, 2.0, 5.0)


def evenly(step: float):
    """Distances every ``step`` metres at most, ends excluded, two parts at least."""

    def distances(total: Column) -> Column:
        parts = F.greatest(F.ceil(total / step), F.lit(2)).cast("int")
        return F.transform(F.sequence(F.lit(1), parts - 1), lambda n: total * n / parts)

    return distances


def chord_samples(targets: DataFrame, lamps=LAMPS, surface=terrain, distances=adaptive) -> DataFrame:
    """(target_id, n, s_<i>, y_<i>, d_<i>, up_<i>, radius, az, dist): samples along each sight line in the chord frame of each lamp i.

    The frame's origin is the eye, its first axis points to the lamp, its second is the mean vertical made normal to it.  What
    depends on target and lamp alone stands below the explode, so a sample costs one point and two dot products for each lamp;
    lamps are columns, not rows.
    """
    t = targets.withColumns({"dist": geo.haversine(F.lit(LON0), F.lit(LAT0), F.col("lon"), F.col("lat")), "az": geo.bearing(F.lit(LON0), F.lit(LAT0), F.col("lon"), F.col("lat"))})
    up = geo.normal(F.col("lon"), F.col("lat"))
    t = t.withColumns({
        "tz": surface(F.col("lon"), F.col("lat")), "radius": geo.normal_section_radius((F.col("lat") + LAT0) / 2, F.col("az")), "places": distances(F.col("dist")),
        "nx": up[0], "ny": up[1], "nz": up[2],
    })
    origin = _constant_ecef(LON0, LAT0, GROUND + EYE)
    own, top = (F.col("nx"), F.col("ny"), F.col("nz")), [F.col(c) + v for c, v in zip(("nx", "ny", "nz"), _constant_normal(LON0, LAT0), strict=True)]
    axes = "xyz"
    for i, lamp in enumerate(lamps):
        end = geo.ecef(F.col("lon"), F.col("lat"), F.col("tz") + lamp)
        t = t.withColumns({f"e{c}": end[j] - origin[j] for j, c in enumerate(axes)})
        e = [F.col(f"e{c}") for c in axes]
        t = t.withColumn(f"d_{i}", F.sqrt(geo.dot(e, e)))
        t = t.withColumn("h", geo.dot(top, e) / F.col(f"d_{i}"))
        t = t.withColumns({f"w{c}": top[j] - F.col("h") * e[j] / F.col(f"d_{i}") for j, c in enumerate(axes)})
        w = [F.col(f"w{c}") for c in axes]
        t = t.withColumn("size", F.sqrt(geo.dot(w, w)))
        t = t.withColumns({f"u{c}{i}": e[j] / F.col(f"d_{i}") for j, c in enumerate(axes)} | {f"v{c}{i}": w[j] / F.col("size") for j, c in enumerate(axes)})
        t = t.withColumn(f"up_{i}", geo.dot(own, [F.col(f"v{c}{i}") for c in axes]))
    fixed = [f"{c}{i}" for i in range(len(lamps)) for c in ("ux", "uy", "uz", "vx", "vy", "vz", "d_", "up_")]
    t = t.select("target_id", "radius", "az", "dist", "chain", "route", *fixed, F.posexplode("places").alias("n", "at"))
    lon, lat = geo.spherical_direct(F.lit(LON0), F.lit(LAT0), F.col("az"), F.col("at"))
    t = t.withColumns({"plon": lon, "plat": lat})
    point = geo.ecef(F.col("plon"), F.col("plat"), surface(F.col("plon"), F.col("plat")))
    t = t.withColumns({f"p{c}": point[j] - origin[j] for j, c in enumerate(axes)})
    rel = [F.col(f"p{c}") for c in axes]
    along = [x for i in range(len(lamps)) for x in (geo.dot(rel, [F.col(f"u{c}{i}") for c in axes]).alias(f"s_{i}"), geo.dot(rel, [F.col(f"v{c}{i}") for c in axes]).alias(f"y_{i}"))]
    return t.select("target_id", "n", "radius", "az", "dist", "chain", "route", *along, *[f"{c}_{i}" for i in range(len(lamps)) for c in ("d", "up")])


def _constant_ecef(lon: float, lat: float, h: float) -> tuple[float, float, float]:
    la, lo = math.radians(lat), math.radians(lon)
    n = geo.A / math.sqrt(1 - geo.E2 * math.sin(la) ** 2)
    return (n + h) * math.cos(la) * math.cos(lo), (n + h) * math.cos(la) * math.sin(lo), (n * (1 - geo.E2) + h) * math.sin(la)


def _constant_normal(lon: float, lat: float) -> tuple[float, float, float]:
    la, lo = math.radians(lat), math.radians(lon)
    return math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)


def critical(i: int) -> Column:
    """The refraction coefficient at which a sample just touches the line to lamp i."""
    return 2 * F.col("radius") * F.col(f"y_{i}") / (F.col(f"s_{i}") * (F.col(f"d_{i}") - F.col(f"s_{i}")))


def k_critical(samples: DataFrame, lamps=LAMPS, strict: bool = False) -> DataFrame:
    """(target_id, lamp, k_crit): the lamp is visible for k >= k_crit.  One row for each target, lamps unpivoted after the maximum.

    A ray over ground without height is not known to be free: its k_crit is null, with ``strict`` the query fails.
    """
    missing = F.count_if(F.col("y_0").isNull())
    unknown = F.when(missing > 0, F.raise_error("samples have no ground height") if strict else F.lit(None))
    wide = samples.groupBy("target_id").agg(*[F.when(missing > 0, unknown.cast("double")).otherwise(F.round(F.max(critical(i)), 5)).alias(f"k{i}") for i in range(len(lamps))])
    pairs = F.explode(F.array(*[F.struct(F.lit(lamp).alias("lamp"), F.col(f"k{i}").alias("k_crit")) for i, lamp in enumerate(lamps)]))
    return wide.select("target_id", pairs.alias("p")).select("target_id", "p.lamp", "p.k_crit")


def ground(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """``terrain`` for arrays."""
    return 1400 + 25 * np.sin(lon * 150) * np.cos(lat * 120) + 10 * np.sin(lat * 400)


VIEWER = sightline.Viewer(LON0, LAT0, GROUND + EYE)


def reduced(targets: DataFrame, lamps, values: dict, keep: list[str] = ["target_id"], surface=ground, sampling: sightline.Sampling = sightline.Sampling(), strict: bool = False, drawn: tuple = ()) -> DataFrame:  # noqa: B006, B008
    """``keep`` and a double column for each of ``values``: name -> function (rays, ids of the targets, ray of each) of a value for each ray, or for each target if its name is among ``drawn``.

    A value is null where a sample has no ground height; with ``strict`` that fails.  A target is a few numbers and thousands of
    samples, so targets are dealt evenly over all cores first, however few files they come from; those of one place go to the same
    task, next to each other, and share its ray.
    """
    columns = [*dict.fromkeys([*keep, *(["target_id"] if drawn else []), "lon", "lat"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lon, lat = (batch.column(c).to_numpy() for c in ("lon", "lat"))
            ident = batch.column("target_id").to_numpy() if drawn else None
            first = np.flatnonzero(np.concatenate([[True], (np.diff(lon) != 0) | (np.diff(lat) != 0)]))
            ends = np.append(first, batch.num_rows)
            out = {name: np.empty(batch.num_rows) for name in values}
            for places, rays in sightline.rays(lon[first], lat[first], VIEWER, lamps, surface, sampling, strict):
                rows = slice(ends[places.start], ends[places.stop])
                ray = np.repeat(np.arange(places.stop - places.start), np.diff(ends[places.start : places.stop + 1]))
                for name, value in values.items():
                    found = value(rays, ident[rows] if drawn else None, ray)
                    out[name][rows] = found if name in drawn else found[ray]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(v, from_pandas=True) for v in out.values())], [*keep, *values])

    fields = [*(targets.schema[c] for c in keep), *(T.StructField(n, T.DoubleType()) for n in values)]
    parts = 4 * targets.sparkSession.sparkContext.defaultParallelism
    place = F.xxhash64("lon", "lat")  # not the columns: after a grouping by them no exchange would be made, and few partitions be left
    return targets.select(*columns).repartition(parts, place).sortWithinPartitions("lon", "lat").mapInArrow(run, T.StructType(fields))


def critical_of(i: int, raised: float | None = None):
    """k_crit of lamp i; ``raised``: clutter on samples farther than 10 m from both ends."""

    def value(rays: sightline.Ray, *_) -> np.ndarray:
        if raised is None:
            return np.round(rays.highest(rays.critical(i)), 4)
        inner = (rays.s[i] > 10) & (rays.each(rays.d[i]) - rays.s[i] > 10)
        return rays.highest(rays.critical(i, np.where(inner, raised, 0.0)))

    return value


def _limit(rays: sightline.Ray, *_) -> np.ndarray:
    """Ground distance of the limiting sample, the nearest on ties."""
    k = np.round(rays.critical(0), 4)
    best = k == rays.each(rays.highest(k))
    return np.minimum.reduceat(np.where(best, rays.ground, np.inf), rays.first)


def _share_of_chord(far: bool):
    def value(rays: sightline.Ray, *_) -> np.ndarray:
        d, s = rays.each(rays.d[0]), rays.s[0]
        return rays.highest(rays.excess(0, 0.13) * d / (s if far else d - s) / (rays.each(rays.up[0]) if far else 1.0))

    return value


def _times(condition: Column) -> Column:
    """How many targets a condition holds for, of rows that stand for ``n`` targets each."""
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def visible_km_by_lamp_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible length by lamp height and refraction coefficient, 60 m for each target point."""
    places = view(spark, sf_dir, "targets").groupBy("lon", "lat").agg(F.count("*").alias("n"))
    found = reduced(places, LAMPS, {f"k{i}": critical_of(i) for i in range(len(LAMPS))}, ["n"])
    counts = found.agg(*[_times(F.col(f"k{i}") <= k).alias(f"n{i}_{j}") for i in range(len(LAMPS)) for j, k in enumerate(KS)])
    cells = [F.struct(F.lit(lamp).alias("lamp"), F.lit(k).alias("k"), F.round(F.col(f"n{i}_{j}") * 0.06, 6).alias("visible_km")) for i, lamp in enumerate(LAMPS) for j, k in enumerate(KS)]
    return counts.select(F.explode(F.array(*cells)).alias("p")).select("p.*")


def limiting_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far away the sample is that limits each target, for one lamp; the nearer one on ties."""
    return reduced(view(spark, sf_dir, "targets"), (0.66,), {"limit_m": _limit}).select("target_id", F.round("limit_m", 1).alias("limit_m"))


def clearance_and_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clearance and the heights that lamp or eye would need, at k = 0.13."""
    values = {"clearance": lambda rays, *_: -rays.highest(rays.excess(0, 0.13)), "lamp_margin": _share_of_chord(True), "eye_margin": _share_of_chord(False)}
    return reduced(view(spark, sf_dir, "targets"), (0.66,), values).select("target_id", F.round("clearance", 3).alias("clearance"), *((F.round(c, 2) + 0.0).alias(c) for c in ("lamp_margin", "eye_margin")))


def clutter_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k_crit with clutter added to samples farther than 10 m from both ends."""
    values = {f"k_clutter_{int(v * 100)}": critical_of(0, v) for v in CLUTTER}
    return reduced(view(spark, sf_dir, "targets"), (0.66,), values).select("target_id", *(F.round(c, 3).alias(c) for c in values))


def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same points: agreement at k = 0.13, both kinds of disagreement, median difference; rays are made once for both."""
    places = view(spark, sf_dir, "targets").groupBy("lon", "lat").agg(F.count("*").alias("n"))
    both = reduced(places, (0.66, 1.12), {"a": critical_of(0), "b": critical_of(1)}, ["n"])
    va, vb = F.col("a") <= 0.13, F.col("b") <= 0.13
    return both.agg(
        F.round(_times(va == vb) / F.sum("n"), 6).alias("agreement"), _times(va & ~vb).alias("only_a"), _times(~va & vb).alias("only_b"),
        F.round(F.expr("percentile(b - a, 0.5, n)"), 4).alias("median_difference"),
    )


def length_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length with k_crit at most k, for k = 0, 0.05, ... 1, by route and over all."""
    places = view(spark, sf_dir, "targets").groupBy("lon", "lat", "route").agg(F.count("*").alias("n"))
    kc = reduced(places, (0.66,), {"k_crit": critical_of(0)}, ["route", "n"])
    wide = kc.rollup("route").agg(*[_times(F.col("k_crit") <= i / 20).alias(f"n{i}") for i in range(21)])
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.round(F.col(f"n{i}") * 0.06, 6).alias("km")) for i in range(21)]))
    return wide.select(F.coalesce("route", F.lit("all")).alias("route"), pairs.alias("p")).select("route", "p.step", "p.km")


def trace_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points worth tracing: of every second point of a route those that are not hidden for certain, k_crit being at most 2, with the span of launch angles (mrad)."""
    t = view(spark, sf_dir, "targets").where("target_id % 2 = 0")
    found = reduced(t, (4.0,), {"k_crit": critical_of(0), "d": lambda rays, *_: rays.d[0]})
    return found.where("k_crit <= 2").select("target_id", "k_crit", F.round(F.col("d") / (2 * geo.R_SPHERE) * 1000, 4).alias("span"))


#: rasters of the mosaic query: name, western and northern edge in cells, cell size, rows, columns; the fine one comes first and has holes
RASTERS = [("a_fine", -52070, -15145, 0.002, 110, 60), ("b_coarse", -10420, -3040, 0.01, 40, 40)]
COARSE = sightline.Sampling(zone=2000.0, fine=250.0, coarse=500.0)


def sight_over_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k_crit over ground from two GeoTIFF files: where the fine one has a hole the coarse one counts, and a ray that leaves both has none.

    Blocks of the files become one mosaic that all tasks get, which is why its size is checked.
    """
    path = scratch.folder(spark)
    files = None
    for name, c0, r0, size, rows, cols in RASTERS:
        cell = spark.range(rows * cols).select((F.floor(F.col("id") / cols) + r0).alias("r"), (F.col("id") % cols + c0).alias("c"))
        lon, lat = (F.col("c") + 0.5) * size, (F.col("r") + 0.5) * -size
        hole = ((F.col("r") - r0) * 7 + (F.col("c") - c0) * 3) % 97 == 0
        z = F.when(hole & F.lit(name == "a_fine"), F.lit(None)).otherwise(terrain(lon, lat))
        one = writers.geotiff(cell.select(F.lit(name).alias("name"), "r", "c", z.alias("z")), "name", size, -size, ["z"])
        files = one if files is None else files.unionByName(one)
    writers.write_files(files.select(F.concat("name", F.lit(".tif")).alias("name"), "file"), "name", "file", path)
    mosaic = readers.mosaic(readers.read_raster_blocks(spark, path, size=64))
    found = reduced(view(spark, sf_dir, "targets"), (0.66,), {"k_crit": critical_of(0)}, surface=mosaic, sampling=COARSE)
    return found.select("target_id", "k_crit")


def prefix_max_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's series as a ray: which samples are seen past all nearer ground."""
    s = view(spark, sf_dir, "series")
    d = F.col("chain") * 10
    ground, target = (F.col("v") - d * d / 14642000 - 50) / d, (F.col("v") + 2 - d * d / 14642000 - 50) / d
    out = windows.prefix_max_visibility(s, "user_id", "seq", ground, target, d)
    return out.select("user_id", "seq", "visible", F.round("clearance", 5).alias("clearance"))


def sampling_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, first, last and sum of adaptive sample distances of each supplier's distance."""
    s = view(spark, sf_dir, "sources").select("source_id", (F.col("km") * 100).alias("total"))
    s = s.withColumn("s", windows.sample_distances(F.col("total"), 5.0, 3.0, 1500.0, 20.0, 50.0))
    return s.select("source_id", F.size("s").cast("long").alias("n"), F.round(F.get("s", F.lit(0)), 4).alias("first"), F.round(F.element_at("s", -1), 4).alias("last"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


_FLAT2 = f"{geo.E2!r}::DOUBLE"


def _terrain(lon: str, lat: str) -> str:
    return f"(1400 + 25 * sin({lon} * 150) * cos({lat} * 120) + 10 * sin({lat} * 400))"


def samples_sql(lamps, where: str = "true", sampling: sightline.Sampling = sightline.Sampling(), heights: str = "") -> str:  # noqa: B008
    """The same samples in SQL, lamps as rows: frames by target and lamp, points by target and distance, then both joined.

    ``heights``: a table zz (target_id, g, z) from places pp (target_id, g, lon, lat), g being -1 for the targets; else the analytic surface.
    """
    near, far, zone, fine, coarse = (repr(float(x)) + "::DOUBLE" for x in (sampling.skip_near, sampling.skip_far, sampling.zone, sampling.fine, sampling.coarse))
    places = "pp AS (SELECT target_id, -1e0 AS g, lon, lat FROM t3 UNION ALL SELECT DISTINCT target_id, g, degrees(pl), degrees(pq) FROM g2)"
    if heights:
        heights = f"{places}, {heights}, t4 AS (SELECT t3.*, z AS tz FROM t3 JOIN zz ON zz.target_id = t3.target_id AND g = -1), g25 AS (SELECT g2.*, z FROM g2 JOIN zz ON zz.target_id = g2.target_id AND zz.g = g2.g)"
    else:
        heights = f"t4 AS (SELECT *, {_terrain('lon', 'lat')} AS tz FROM t3), g25 AS (SELECT *, {_terrain('degrees(pl)', 'degrees(pq)')} AS z FROM g2)"
    rows = ", ".join(f"({i}, {lamp}::DOUBLE)" for i, lamp in enumerate(lamps))
    o, n = _constant_ecef(LON0, LAT0, GROUND + EYE), _constant_normal(LON0, LAT0)
    d = "::DOUBLE"
    return f"""
lamps(i, lamp) AS (VALUES {rows}),
t0 AS (SELECT *, radians(lat) AS q, radians(lon) AS lo, radians({LAT0}{d}) AS p, radians({LON0}{d}) AS p0 FROM v_targets WHERE {where}),
t1 AS (SELECT *, 2 * {geo.R_SPHERE}{d} * asin(sqrt(pow(sin((q - p) / 2), 2) + cos(p) * cos(q) * pow(sin((lo - p0) / 2), 2))) AS dist,
       atan2(sin(lo - p0) * cos(q), cos(p) * sin(q) - sin(p) * cos(q) * cos(lo - p0)) AS az, radians((lat + {LAT0}{d}) / 2) AS ml FROM t0),
t2 AS (SELECT *, {geo.A}{d} * (1 - {_FLAT2}) / pow(1 - {_FLAT2} * sin(ml) * sin(ml), 1.5{d}) AS m, {geo.A}{d} / sqrt(1 - {_FLAT2} * sin(ml) * sin(ml)) AS pv,
       {geo.A}{d} / sqrt(1 - {_FLAT2} * sin(q) * sin(q)) AS tn, cos(q) * cos(lo) AS nx, cos(q) * sin(lo) AS ny, sin(q) AS nz FROM t1),
t3 AS (SELECT *, 1 / (cos(az) * cos(az) / m + sin(az) * sin(az) / pv) AS radius FROM t2),
g0 AS (SELECT target_id, p, p0, az, unnest(CASE WHEN dist - {far} <= {near} THEN [dist / 2] ELSE list_concat(
  list_transform(range(ceil((least({zone}, dist - {far}) - {near}) / {fine})::BIGINT), lambda j: {near} + j * {fine}),
  list_transform(range(ceil(least({zone}, dist - {far} - {near}) / {fine})::BIGINT), lambda j: dist - {far} - j * {fine}),
  list_transform(range(greatest(ceil((dist - 2 * {zone}) / {coarse}), 0)::BIGINT), lambda j: {zone} + j * {coarse})) END) AS g FROM t3),
g1 AS (SELECT *, asin(sin(p) * cos(g / {geo.R_SPHERE}{d}) + cos(p) * sin(g / {geo.R_SPHERE}{d}) * cos(az)) AS pq FROM g0),
g2 AS (SELECT *, p0 + atan2(sin(az) * sin(g / {geo.R_SPHERE}{d}) * cos(p), cos(g / {geo.R_SPHERE}{d}) - sin(p) * sin(pq)) AS pl FROM g1),
{heights},
f0 AS (SELECT target_id, route, radius, nx, ny, nz, lamp, nx + {n[0]!r}{d} AS ux, ny + {n[1]!r}{d} AS uy, nz + {n[2]!r}{d} AS uz,
       (tn + tz + lamp) * nx - {o[0]!r}{d} AS ex, (tn + tz + lamp) * ny - {o[1]!r}{d} AS ey, (tn * (1 - {_FLAT2}) + tz + lamp) * nz - {o[2]!r}{d} AS ez FROM t4, lamps),
f1 AS (SELECT *, sqrt(ex * ex + ey * ey + ez * ez) AS d FROM f0),
f2 AS (SELECT *, (ux * ex + uy * ey + uz * ez) / d AS h FROM f1),
f3 AS (SELECT *, ux - h * ex / d AS wx, uy - h * ey / d AS wy, uz - h * ez / d AS wz FROM f2),
f4 AS (SELECT *, sqrt(wx * wx + wy * wy + wz * wz) AS size FROM f3),
f AS (SELECT target_id, route, radius, lamp, d, ex / d AS a1, ey / d AS a2, ez / d AS a3, wx / size AS b1, wy / size AS b2, wz / size AS b3, (nx * wx + ny * wy + nz * wz) / size AS up FROM f4),
g3 AS (SELECT *, {geo.A}{d} / sqrt(1 - {_FLAT2} * sin(pq) * sin(pq)) AS pn FROM g25),
g4 AS (SELECT target_id, g, (pn + z) * cos(pq) * cos(pl) - {o[0]!r}{d} AS px, (pn + z) * cos(pq) * sin(pl) - {o[1]!r}{d} AS py, (pn * (1 - {_FLAT2}) + z) * sin(pq) - {o[2]!r}{d} AS pz FROM g3),
x AS (SELECT target_id, route, lamp, g, d, radius, up, px * a1 + py * a2 + pz * a3 AS s, px * b1 + py * b2 + pz * b3 AS y FROM g4 JOIN f USING (target_id)),
kc AS (SELECT target_id, any_value(route) AS route, lamp, any_value(d) AS d, round(max(2 * radius * y / (s * (d - s))), 4) AS k_crit FROM x GROUP BY target_id, lamp)"""


def _sql(lamps, tail: str, where: str = "true", **options) -> str:
    return with_views(f"WITH {samples_sql(lamps, where, **options)} {tail}")


def _mosaic_sql() -> str:
    """zz for places pp: bilinear on each raster where all four neighbours have data, the first raster's value first."""
    parts = []
    for name, c0, r0, size, rows, cols in RASTERS:
        cell = _terrain(f"((c + {c0} + 5e-1) * {size}::DOUBLE)", f"((r + ({r0}) + 5e-1) * -({size}::DOUBLE))")
        hole = "WHERE (r * 7 + c * 3) % 97 <> 0" if name == "a_fine" else ""
        west, north = f"({c0} * {size}::DOUBLE)", f"({r0} * -({size}::DOUBLE))"
        parts.append(f"r_{name} AS (SELECT r, c, ({cell})::FLOAT::DOUBLE AS z FROM range({rows}) a(r), range({cols}) b(c) {hole})")
        parts.append(f"p_{name} AS (SELECT target_id, g, round((lon - {west}) / {size}::DOUBLE - 5e-1, 9) AS x, round((lat - {north}) / -({size}::DOUBLE) - 5e-1, 9) AS y FROM pp)")
        parts.append(f"i_{name} AS (SELECT *, least(greatest(floor(x), 0), {cols - 2})::BIGINT AS c, least(greatest(floor(y), 0), {rows - 2})::BIGINT AS r FROM p_{name} WHERE x >= 0 AND y >= 0 AND x <= {cols - 1} AND y <= {rows - 1})")
        four = ", ".join(f"z{i}{j}.z AS z{i}{j}" for i in (0, 1) for j in (0, 1))
        joins = " ".join(f"JOIN r_{name} z{i}{j} ON z{i}{j}.r = i.r + {i} AND z{i}{j}.c = i.c + {j}" for i in (0, 1) for j in (0, 1))
        parts.append(f"q_{name} AS (SELECT target_id, g, x - i.c AS tx, y - i.r AS ty, {four} FROM i_{name} i {joins})")
        parts.append(f"v_{name} AS (SELECT target_id, g, (z00 * (1 - tx) + z01 * tx) * (1 - ty) + (z10 * (1 - tx) + z11 * tx) * ty AS z FROM q_{name})")
    return ", ".join(parts) + ", zz AS (SELECT pp.target_id, pp.g, coalesce(a.z, b.z) AS z FROM pp LEFT JOIN v_a_fine a ON a.target_id = pp.target_id AND a.g = pp.g LEFT JOIN v_b_coarse b ON b.target_id = pp.target_id AND b.g = pp.g)"


_K = ", ".join(f"({k}::DOUBLE)" for k in KS)
QUERIES = {f.__name__: f for f in (visible_km_by_lamp_k, limiting_sample, clearance_and_margins, clutter_sensitivity, run_compare, length_by_k, trace_candidates, sight_over_mosaic, prefix_max_visibility, sampling_distances)}
ORACLES = {
    "visible_km_by_lamp_k": _sql(LAMPS, f"SELECT lamp, k, round(count(CASE WHEN k_crit <= k THEN 1 END) * 0.06::DOUBLE, 6) AS visible_km FROM kc, (VALUES {_K}) v(k) GROUP BY lamp, k"),
    "limiting_sample": _sql((0.66,), ", r AS (SELECT target_id, g, round(2 * radius * y / (s * (d - s)), 4) AS k FROM x) SELECT target_id, round(arg_max(g, struct_pack(k := k, nearest := -g)), 1) AS limit_m FROM r GROUP BY target_id"),
    "clearance_and_margins": _sql((0.66,), ", e AS (SELECT *, y - 0.13::DOUBLE * s * (d - s) / (2 * radius) AS ex FROM x) SELECT target_id, round(-max(ex), 3) AS clearance, round(max(ex * d / s / up), 2) + 0e0 AS lamp_margin, round(max(ex * d / (d - s)), 2) + 0e0 AS eye_margin FROM e GROUP BY target_id"),
    "clutter_sensitivity": _sql((0.66,), "SELECT target_id, " + ", ".join(f"round(max(2 * radius * (y + CASE WHEN s > 10 AND d - s > 10 THEN {v}::DOUBLE ELSE 0 END) / (s * (d - s))), 3) AS k_clutter_{int(v * 100)}" for v in CLUTTER) + " FROM x GROUP BY target_id"),
    "run_compare": _sql((0.66, 1.12), ", p AS (SELECT a.k_crit AS a, b.k_crit AS b FROM kc a JOIN kc b USING (target_id) WHERE a.lamp < 1 AND b.lamp > 1) SELECT round(avg(CASE WHEN (a <= 0.13) = (b <= 0.13) THEN 1e0 ELSE 0e0 END), 6) AS agreement, count(CASE WHEN a <= 0.13 AND b > 0.13 THEN 1 END) AS only_a, count(CASE WHEN a > 0.13 AND b <= 0.13 THEN 1 END) AS only_b, round(quantile_cont(b - a, 0.5), 4) AS median_difference FROM p"),
    "length_by_k": _sql((0.66,), "SELECT coalesce(route, 'all') AS route, step::INT AS step, round(count(CASE WHEN k_crit <= step / 20e0 THEN 1 END) * 0.06::DOUBLE, 6) AS km FROM kc, range(21) r(step) GROUP BY GROUPING SETS ((route, step), (step))"),
    "trace_candidates": _sql((4.0,), f"SELECT target_id, k_crit, round(d / (2 * {geo.R_SPHERE}::DOUBLE) * 1000, 4) AS span FROM kc WHERE k_crit <= 2", "target_id % 2 = 0"),
    "sight_over_mosaic": _sql((0.66,), ", u AS (SELECT target_id, count(*) FILTER (y IS NULL) AS missing, max(2 * radius * y / (s * (d - s))) AS k FROM x GROUP BY target_id) SELECT target_id, CASE WHEN missing = 0 THEN round(k, 4) END AS k_crit FROM u", sampling=COARSE, heights=_mosaic_sql()),
    "prefix_max_visibility": with_views("WITH a AS (SELECT user_id, seq, chain * 10 AS d, (v - chain * 10 * chain * 10 / 14642000 - 50) / (chain * 10) AS g, (v + 2 - chain * 10 * chain * 10 / 14642000 - 50) / (chain * 10) AS t FROM v_series), b AS (SELECT *, max(g) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM a) SELECT user_id, seq, m IS NULL OR t >= m AS visible, round((t - m) * d, 5) AS clearance FROM b"),
    "sampling_distances": with_views("""WITH a AS (SELECT source_id, km * 100 AS total FROM v_sources), s AS (
SELECT source_id, unnest(CASE WHEN total - 3 <= 5 THEN [total / 2] ELSE list_distinct(list_filter(list_concat(
  list_transform(range(CASE WHEN least(1500, total - 3) > 5 THEN ceil((least(1500, total - 3) - 5) / 20)::BIGINT ELSE 0 END), lambda i: 5 + i * 20e0),
  list_transform(range(CASE WHEN least(1500, total - 8) > 0 THEN ceil(least(1500, total - 8) / 20)::BIGINT ELSE 0 END), lambda i: total - 3 - i * 20e0),
  list_transform(range(CASE WHEN total > 3000 THEN ceil((total - 3000) / 50)::BIGINT ELSE 0 END), lambda i: 1500 + i * 50e0)), lambda s: s >= 5 AND s <= total - 3)) END) AS s FROM a)
SELECT source_id, count(*) AS n, round(min(s), 4) AS first, round(max(s), 4) AS last, round(sum(s), 3) AS total FROM s GROUP BY source_id"""),
}
