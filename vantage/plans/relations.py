"""Queries of joins, reductions, grids, photometry and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, physics
from ..operators import grids, joins, rules, stats, windows
from .views import table, view, with_views


def zip_assert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against their own projection, row by row on the key; counts on both sides must agree."""
    o = table(spark, sf_dir, "orders")
    a, b = o.select("o_orderkey", "o_custkey"), o.select("o_orderkey", F.col("o_totalprice").alias("price"))
    return a.join(b, "o_orderkey").agg(F.count("*").alias("matched"), F.round(F.sum("price"), 2).alias("price")).crossJoin(F.broadcast(a.agg(F.count("*").alias("expected")))).withColumn("complete", F.col("matched") == F.col("expected"))


def left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations looked up for suppliers of large balance; none keeps nulls."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


def semi_flag_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a part's size or its key modulo 50 is among the sizes of brand 7."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 50).cast("int").alias("alt"))
    keys = table(spark, sf_dir, "part").where("p_brand = 'Brand#7'").select((F.col("p_size") + 1).alias("k"))
    return joins.semi_flag(p, keys, "k", ["p_size", "alt"], "listed").select("p_partkey", "listed")


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders and orders without customers, by key as text."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).cast("string").alias("id")).distinct()
    return c.join(o, "id", "left_anti").withColumn("side", F.lit("customer")).unionByName(o.join(c, "id", "left_anti").withColumn("side", F.lit("order")))


def truncated_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts joined on the first five letters of their names, counted."""
    p = table(spark, sf_dir, "part").withColumn("k", F.substring("p_name", 1, 5))
    per = p.groupBy("k").agg(F.count("*").alias("n"))
    return per.join(per.select("k", F.col("n").alias("m")), "k").select("k", (F.col("n") * F.col("m")).alias("pairs"))


def theta_anti_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers farther than 0.002 in L1 distance from every supplier, by cells of that width."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 499 * 1e-3).alias("x"), (F.col("c_custkey") % 211 * 1e-3).alias("y"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7 % 499 * 1e-3).alias("u"), (F.col("s_suppkey") * 3 % 211 * 1e-3).alias("w"))
    near = joins.pairs_within(c, F.col("x"), F.col("y"), s, F.col("u"), F.col("w"), 0.002).where(F.round(F.abs(F.col("x") - F.col("u")) + F.abs(F.col("y") - F.col("w")), 9) <= 0.002)
    return c.join(near.select("c_custkey"), "c_custkey", "left_anti").select("c_custkey")


def group_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line numbers and parts as one text, those without lines kept."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce(text, F.lit("")).alias("lines"))


def nearest_station_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's nearest supplier of its nation by balance, or the default."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    out = joins.nearest_by_key(c, s, "nation", F.col("c_acctbal"), F.col("s_acctbal"), "s_suppkey", "station", ["c_custkey"], 2)
    return out.select("c_custkey", F.coalesce("station", F.lit(-1)).alias("station"), F.col("station_distance").alias("distance"))


def nearest_within_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's nearest source in azimuth and elevation within 1 degree."""
    c = view(spark, sf_dir, "lines").select("line_id", "seq", "az", "el")
    s = view(spark, sf_dir, "sources").select("source_id", F.col("az").alias("saz"), F.col("el").alias("sel"))
    d = F.round(F.sqrt(F.pow((F.col("az") - F.col("saz")) * F.cos(F.radians("el")), F.lit(2.0)) + F.pow(F.col("el") - F.col("sel"), F.lit(2.0))), 6)
    found = joins.nearest_of_places(c, ["az", "el"], s, ["saz", "sel"], "source_id", d, 1.0)
    return c.join(found, ["az", "el"]).select("line_id", "seq", "source_id", "d")


def angular_window_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources within 0.5 degrees of an observation, nearest three by distance."""
    obs = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 14.5).alias("b"))
    met = joins.angular_join(view(spark, sf_dir, "sources"), F.col("az"), obs, F.col("b"), F.lit(0.5))
    top = windows.top_by(met, ["n_nationkey"], ["km", "source_id"], 3)
    return top.select("n_nationkey", "source_id", F.round("d_az", 6).alias("d_az"), "rank")


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 1.0 - 12).alias("x"), (F.sin(F.col("n_nationkey") * 0.7) * 4 + 8).alias("y"), (F.col("n_nationkey") * 2.5).alias("ch"))
    return windows.segments(n.withColumn("one", F.lit(1)), "one", "n_nationkey", ["x", "y", "ch"])


def point_to_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's distance to a track of 25 vertices and the chainage there; the track is a small constant table."""
    p = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 24 - 12.0).alias("px"), (F.col("s_suppkey") % 17 * 0.9).alias("py"))
    d, t = joins.point_to_segment(F.col("px"), F.col("py"), F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    met = p.crossJoin(F.broadcast(_track(spark, sf_dir))).withColumns({"d": F.round(d, 6), "at": F.round(F.col("ch") + t * (F.col("ch2") - F.col("ch")), 5)})
    return met.groupBy("s_suppkey").agg(F.min(F.struct("d", "at")).alias("b")).select("s_suppkey", F.col("b.d").alias("distance"), F.col("b.at").alias("chain"))


def ray_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of rays from the origin with the track, in order along each ray."""
    rays = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 179 - 89.3).alias("az"))
    s, t = joins.ray_segment(F.col("az"), F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    hit = rays.crossJoin(F.broadcast(_track(spark, sf_dir))).withColumns({"s": s, "t": t}).where("s IS NOT NULL")
    order = F.row_number().over(Window.partitionBy("s_suppkey").orderBy("s"))
    return hit.select("s_suppkey", order.alias("crossing"), F.round("s", 6).alias("distance"), F.round(F.col("ch") + F.col("t") * (F.col("ch2") - F.col("ch")), 5).alias("chain"))


def bracket_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of the track at each source's azimuth (mapped on its x range); sources outside get none."""
    p = view(spark, sf_dir, "sources").select("source_id", ((F.col("az") - 200) / 4).alias("q"))
    out = joins.bracket(p, "q", _track(spark, sf_dir), "x", "x2", "y", "y2", 1.0, "value")
    return out.groupBy("source_id").agg(F.round(F.min("value"), 6).alias("value"))


def grid_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolation on a regular grid by index arithmetic and two equi-joins; held at the ends."""
    sky = spark.range(0, 151).select(F.col("id").alias("i"), (F.sin(F.col("id") * 0.3) + F.col("id") / 100).alias("el"))
    p = view(spark, sf_dir, "sources").select("source_id", F.least(F.greatest(F.col("az") - 150, F.lit(0.0)), F.lit(150.0)).alias("x"))
    p = p.withColumns({"i": F.floor("x"), "f": F.col("x") - F.floor("x")})
    both = p.join(sky, "i").join(sky.select((F.col("i") - 1).alias("i"), F.col("el").alias("el2")), "i", "left")
    return both.select("source_id", F.round(F.col("el") + F.col("f") * (F.coalesce("el2", "el") - F.col("el")), 6).alias("el"))


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "raster")
    fine = r.where("r % 5 <> 0").withColumn("src", F.lit(0))
    return fine.unionByName(r.select("r", "c", (F.col("z") + 1000).alias("z")).where("c % 4 <> 1").withColumn("src", F.lit(1)))


def priority_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First layer with data in each cell, and which it was."""
    cells = view(spark, sf_dir, "raster").select("r", "c")
    return joins.priority_coalesce(cells, _layers(spark, sf_dir), ["r", "c"], "z", "src")


def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 57 + 0.25).alias("y"), (F.col("s_suppkey") % 2 + 0.75).alias("x"))
    out = joins.bilinear(p, F.col("y"), F.col("x"), view(spark, sf_dir, "raster"), ["s_suppkey"], "z")
    return out.select("s_suppkey", F.round("z", 6).alias("z"))


def cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of sparse cells at points; a missing cell is 0."""
    cells = view(spark, sf_dir, "raster").where("z IS NOT NULL AND r % 2 = 0").select((F.col("r") * 10_000_000 + F.col("c")).alias("cell"), "z")
    p = table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 60) * 10_000_000 + F.col("s_suppkey") % 3).alias("cell"))
    return p.join(cells, "cell", "left").select("s_suppkey", F.coalesce("z", F.lit(0.0)).alias("h"))


def point_in_ring_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers inside a star-shaped ring of 25 vertices."""
    ring = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(1).alias("one"), ((6 + F.col("n_nationkey") % 3) * F.cos(F.radians(F.col("n_nationkey") * 14.4))).alias("x"), ((6 + F.col("n_nationkey") % 3) * F.sin(F.radians(F.col("n_nationkey") * 14.4))).alias("y"))
    w = Window.partitionBy("one").orderBy("n_nationkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = ring.select(F.col("x").alias("x0"), F.col("y").alias("y0"), F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("x1"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("y1"))
    p = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 19 - 9.05).alias("px"), (F.col("s_suppkey") % 13 * 1.3 - 7.91).alias("py"))
    return joins.ring_parity(p, "px", "py", edges, ["s_suppkey"], 1.0).select("s_suppkey")


def param_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by lamps and coefficients: parameter tables are constants."""
    lamps = spark.range(3).select((F.col("id") * 0.5 + 0.56).alias("lamp"))
    ks = spark.range(4).select((F.col("id") * 0.25).alias("k"))
    s = view(spark, sf_dir, "sources")
    el = physics.apparent_elevation(F.col("el") + F.degrees(F.col("lamp") / (F.col("km") * 1000)), F.col("k"), F.col("km") * 1000, F.lit(6371000.0))
    return s.crossJoin(F.broadcast(lamps)).crossJoin(F.broadcast(ks)).select("source_id", "lamp", "k", F.round(el, 7).alias("app_el"))


def cell_rasterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return grids.rasterise(l, F.col("l_quantity") * 3, F.col("l_discount") * 100, F.col("l_tax") * 10, 0.3)


def obstruction_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.obstruction(cell_rasterise(spark, sf_dir)).select("cell", "dense", "highest")


def robust_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, population deviation, median, 5th and 95th percentile, and 1.4826 times the median absolute deviation, by flag.

    Values are counted first; order statistics come from running counts of distinct values, so no group's values are gathered.
    """
    counted = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_extendedprice").alias("x")).agg(F.count("*").alias("n"))
    n = F.col("n")
    mean, square = F.sum(F.col("x") * n) / F.sum(n), F.sum(F.col("x") * F.col("x") * n) / F.sum(n)
    moments = counted.groupBy("l_returnflag").agg(mean.alias("m"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("s"))
    p = stats.weighted_quantiles(counted, ["l_returnflag"], "x", "n", [0.05, 0.5, 0.95])
    middle = F.broadcast(p.select("l_returnflag", F.col("q")[1].alias("mid")))
    away = counted.join(middle, "l_returnflag").groupBy("l_returnflag", F.abs(F.col("x") - F.col("mid")).alias("y")).agg(F.sum("n").alias("n"))
    mad = stats.weighted_quantiles(away, ["l_returnflag"], "y", "n", [0.5]).select("l_returnflag", F.col("q")[0].alias("mad"))
    out = moments.join(p, "l_returnflag").join(mad, "l_returnflag")
    return out.select("l_returnflag", F.round("m", 4).alias("mean"), F.round("s", 4).alias("sd"), *[F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate(("p5", "median", "p95"))], F.round(1.4826 * F.col("mad"), 4).alias("robust_sd"))


def greatest_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.greatest(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 2), F.lit(None).cast("int")).alias("highest"))


def histogram_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each number of lines occurs in an order, and a twelfth of the largest."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    h = per.groupBy("lines").agg(F.count("*").alias("orders"))
    return h.crossJoin(F.broadcast(per.agg((F.max("lines") / 12).alias("rate")))).select("lines", "orders", F.round("rate", 6).alias("rate"))


def dedupe_rounded_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customer by key of each place, with coordinates rounded."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.bround(F.col("c_acctbal") / 100, 0).cast("long").alias("a"), (F.col("c_custkey") % 7).alias("b"))
    return windows.first_by(c, ["a", "b"], ["c_custkey"])


def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "sources").groupBy("kind", "nation").agg(F.min("az").alias("az_min"), F.max("az").alias("az_max"), F.min("el").alias("low"), F.max("el").alias("high"), F.count("*").alias("n"))
    return s.where("az_max >= 160 AND az_min <= 290").select("kind", "nation", *[F.round(c, 6).alias(c) for c in ("az_min", "az_max", "low", "high")], "n")


def line_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each line its azimuth range, peak rate and distinct distances of positive rate."""
    l = view(spark, sf_dir, "lines")
    return l.groupBy("line_id").agg(F.round(F.min("az"), 6).alias("az_min"), F.round(F.max("az"), 6).alias("az_max"), F.max("rate").alias("peak"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("rate") > 0, F.floor("km")))), ",").alias("km"))


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = view(spark, sf_dir, "lines").where("rate IS NOT NULL")
    return grids.stamp_boxes(l, F.col("az"), F.col("el"), F.lit(0.6), F.lit(0.3))


def rate_map_max_then_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.rate_map(_stamped(spark, sf_dir), "line_id", "rate").select("ia", "ie", F.round("rate", 6).alias("rate"))


def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "sources").where("kind <> 'field'")
    return grids.mask_union(grids.stamp_boxes(s, F.col("az"), F.col("el"), F.lit(0.3), F.lit(0.1)))


def band_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a band of the grid by rate class."""
    grid = spark.range(grids.N_AZ * 9).select((F.col("id") % grids.N_AZ).cast("int").alias("ia"), F.floor(F.col("id") / grids.N_AZ).cast("int").alias("ie"))
    rates = grids.rate_map(_stamped(spark, sf_dir), "line_id", "rate").select("ia", "ie", F.round("rate", 6).alias("rate"))
    level = F.when(F.col("rate").isNull() | (F.col("rate") < 0.01), 0).when(F.col("rate") < 0.1, 1).when(F.col("rate") < 1, 2).when(F.col("rate") < 10, 3).otherwise(4)
    classed = grid.join(rates, ["ia", "ie"], "left").withColumn("level", level)
    return classed.groupBy("level").agg(F.round(F.count("*") / (grids.N_AZ * 9), 6).alias("share"))


def column_window_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grids.rate_map(_stamped(spark, sf_dir), "line_id", "rate")
    out = grids.column_window_max(cells, "rate", 3)
    return out.select("ia", F.round("top", 6).alias("top"), F.round("window_top", 6).alias("window_top"))


def scenario_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest level of several scenarios in each cell."""
    m = grids.rate_map(_stamped(spark, sf_dir), "line_id", "rate").select("ia", "ie", F.floor(F.round("rate", 6)).alias("level"))
    other = m.select("ia", ((F.col("ie") + 3) % grids.N_EL).alias("ie"), (F.col("level") + 1).alias("level"))
    return m.unionByName(other).groupBy("ia", "ie").agg(F.max("level").alias("level"))


def photometry_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rear-lamp magnitudes of each source at three visual ranges, with and without brakes."""
    s = view(spark, sf_dir, "sources").withColumn("h", geo.wrap(F.col("az") * 3.7))
    mor = spark.range(3).select(F.element_at(F.array(F.lit(68.0), F.lit(111.0), F.lit(203.0)), (F.col("id") + 1).cast("int")).alias("mor"))
    d = F.col("km") * 1000
    mag = lambda i: F.round(physics.magnitude(i / (d * d) * physics.transmission(d, F.col("mor"))), 6)
    return s.crossJoin(F.broadcast(mor)).select("source_id", "mor", mag(physics.rear_intensity(F.col("h"))).alias("m_tail"), mag(physics.rear_intensity(F.col("h"), braking=True)).alias("m_brake"))


def beam_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilinear interpolation in the logarithm of an intensity table, held at its edges and not below 0.5."""
    beam = spark.range(25 * 45).select(F.floor(F.col("id") / 45).alias("r"), (F.col("id") % 45).alias("c")).withColumn("z", F.log10(F.lit(20000.0) / (1 + F.pow((F.col("r") - 12) / 3, F.lit(2.0)) + F.pow((F.col("c") - 22) / 6, F.lit(2.0)))))
    s = view(spark, sf_dir, "sources").select("source_id", F.least(F.greatest((F.col("el") + 3) * 4, F.lit(0.0)), F.lit(23.999)).alias("v"), F.least(F.greatest((F.col("az") - 150) / 3, F.lit(0.0)), F.lit(43.999)).alias("h"))
    out = joins.bilinear(s, F.col("v"), F.col("h"), beam, ["source_id"], "z")
    return out.select("source_id", F.round(F.greatest(F.pow(F.lit(10.0), "z"), F.lit(0.5)), 4).alias("candela"))


def detect_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length brighter than the limit at three sky factors, by kind."""
    s = view(spark, sf_dir, "sources")
    m = F.round(physics.magnitude(80.0 / F.pow(F.col("km") * 1000, F.lit(2.0)) * physics.transmission(F.col("km") * 1000, F.lit(111.0))), 6)
    limit = lambda f: physics.magnitude_limit(F.lit(21.4), F.lit(f))
    return s.groupBy("kind").agg(*[F.round(F.count(F.when(m <= F.round(limit(f), 6), 1)) * 0.06, 6).alias(n) for f, n in ((2.0, "reference"), (4.8, "least"), (1.0, "most"))])


def angular_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apparent speed, compass name and refraction from a forecast for each source."""
    s = view(spark, sf_dir, "sources")
    return s.select("source_id", F.round(physics.angular_speed(30.0, F.lit(200.0), F.col("az"), F.col("km") * 1000), 6).alias("deg_per_min"), geo.compass_name(F.col("az")).alias("point"), F.round(physics.k_from_forecast(850.0, F.col("km") / 5, F.col("km") / 5 + F.col("el")), 6).alias("k"))


def classify_spec_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lighting classes of specifications made from part names."""
    p = table(spark, sf_dir, "part")
    spec = F.when(F.col("p_partkey") % 10 == 0, None).when(F.col("p_partkey") % 10 == 1, "None").otherwise(F.concat(F.lit("Chapters 4, "), (F.col("p_size") % 12).cast("string"), F.lit(", 12 (70/7460-1"), F.substring(F.lit("KLMN"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1)), F.lit(")")))
    return p.groupBy(rules.lighting_class(spec).alias("kind")).agg(F.count("*").alias("parts"))


def evidence_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by kind of evidence and whether the source is weak, by all words of their whole texts."""
    t = table(spark, sf_dir, "conversations")
    text = F.concat_ws(" ", "role", "text", F.when(F.col("turn") % 4 == 0, "a Photo").when(F.col("turn") % 4 == 1, "newspaper report, hearsay").when(F.col("turn") % 4 == 2, "campaign"))
    return t.groupBy("role", rules.evidence_kind(text).alias("kind"), rules.weak_source(text).alias("weak")).agg(F.count("*").alias("n"))


def catalogue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-record text filter on parts, in lower case."""
    p = table(spark, sf_dir, "part")
    return p.where(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).contains("red")).select("p_partkey", "p_name")


def refraction_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sources").groupBy(rules.refraction_bin(F.col("kc")).alias("bin")).agg(F.count("*").alias("n"))


def class_vmhx(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "sources").withColumn("p", F.when(F.col("source_id") % 13 == 0, None).otherwise(F.col("source_id") % 41 / 40))
    cls = rules.visibility_class(F.col("p"), F.col("kc"), F.lit(0.13))
    return s.select("source_id", cls.alias("cls"), rules.source_weight(cls).alias("weight"), F.round(rules.locus_lower_bound(F.col("kc"), cls), 6).alias("k_low"))


def verdict_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on each line vertex from the rate map and a skyline."""
    l = view(spark, sf_dir, "lines").withColumns({"ia": F.floor((F.col("az") - grids.AZ0) / grids.DAZ).cast("int"), "ie": F.floor((F.col("el") - grids.EL0) / grids.DEL).cast("int")})
    m = rate_map_max_then_sum(spark, sf_dir).withColumnRenamed("rate", "map_rate")
    v = rules.bearing_verdict(F.col("el"), F.round(1.2 + F.sin(F.radians(F.col("az"))) / 2, 6), F.col("map_rate"), F.col("line_id") % 5 == 0, F.col("az"))
    return l.join(m, ["ia", "ie"], "left").groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sources near each observation, the one that fits in elevation, else one in view, else the nearest."""
    obs = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 6.0 + 150).alias("b"), (F.col("n_nationkey") % 5 * 0.2).alias("e"))
    met = joins.angular_join(view(spark, sf_dir, "sources"), F.col("az"), obs, F.col("b"), F.lit(2.0))
    order = F.struct((F.abs(F.col("el") - F.col("e")) > 0.1).alias("far"), (F.col("kc") > 0.13).alias("hidden"), "km", "source_id")
    return met.groupBy("n_nationkey").agg(F.min(order).alias("b")).select("n_nationkey", F.col("b.source_id").alias("source_id"))


def heterogeneous_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers as one list of entities with missing fields null, near ones only."""
    a = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("km"))
    b = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 90).alias("km"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True).where("km BETWEEN 0 AND 20").select("kind", "id", F.round("km", 6).alias("km"), "segment")


QUERIES = {
    f.__name__: f
    for f in (
        zip_assert, left_lookup, semi_flag_or, set_difference, truncated_key_join, theta_anti_dedupe, group_attach, nearest_station_by_key, nearest_within_tol, angular_window_candidates, point_to_polyline, ray_crossings,
        bracket_interp, grid_interp, priority_coalesce, bilinear_sample, cell_lookup, point_in_ring_parity, param_sweep, cell_rasterise, obstruction_surface, robust_stats, greatest_of_three, histogram_max,
        dedupe_rounded_first, source_summary, line_peaks, rate_map_max_then_sum, mask_union, band_coverage, column_window_max, scenario_max, photometry_magnitudes, beam_lookup, detect_km, angular_rates,
        classify_spec_text, evidence_kind, catalogue_filter, refraction_bins, class_vmhx, verdict_cascade, best_candidate, heterogeneous_union,
    )
}
_TRACK = "tr AS (SELECT n_nationkey, n_nationkey * 1e0 - 12 AS x, sin(n_nationkey * 0.7::DOUBLE) * 4 + 8 AS y, n_nationkey * 2.5e0 AS ch FROM nation), seg AS (SELECT *, lead(x) OVER (ORDER BY n_nationkey) AS x2, lead(y) OVER (ORDER BY n_nationkey) AS y2, lead(ch) OVER (ORDER BY n_nationkey) AS ch2 FROM tr QUALIFY x2 IS NOT NULL)"
_RASTER = "ras AS (SELECT floor(l_quantity * 3)::BIGINT * 10000000 + floor(l_discount * 100)::BIGINT AS cell, max(l_tax * 10) AS hmax, count(*) AS n, sum(CASE WHEN l_tax * 10 > 0.3::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS n_above FROM lineitem GROUP BY 1)"


def _boxes(frm: str, ha: float, he: float, extra: str) -> str:
    g = grids
    a = f"greatest(ceil(round((az - {ha}::DOUBLE - {g.AZ0}) / {g.DAZ}::DOUBLE, 6)), 0)::INT AS a0, least(floor(round((az + {ha}::DOUBLE - {g.AZ0}) / {g.DAZ}::DOUBLE, 6)), {g.N_AZ - 1})::INT AS a1"
    e = f"greatest(ceil(round((el - {he}::DOUBLE - ({g.EL0})) / {g.DEL}::DOUBLE, 6)), 0)::INT AS e0, least(floor(round((el + {he}::DOUBLE - ({g.EL0})) / {g.DEL}::DOUBLE, 6)), {g.N_EL - 1})::INT AS e1"
    return f"bx AS (SELECT {extra}, {a}, {e} FROM {frm}), st AS (SELECT * FROM (SELECT *, unnest(range(a0, a1 + 1))::INT AS ia FROM bx), unnest(range(e0, e1 + 1)) u(ie0))"


_MAP = _boxes("v_lines WHERE rate IS NOT NULL", 0.6, 0.3, "line_id, rate") + ", m0 AS (SELECT line_id, ia, ie0::INT AS ie, max(rate) AS r FROM st GROUP BY ALL), mp AS (SELECT ia, ie, sum(r) AS rate FROM m0 GROUP BY ia, ie)"
_ANGLE = "abs(((({a} - {b} + 540) % 360) + 360) % 360 - 180)"
_LAMP = lambda x, points: " ".join(["CASE WHEN", f"{x} <= {points[0][0]} THEN {points[0][1]}::DOUBLE"] + [f"WHEN {x} <= {b[0]} THEN pow(10, log10({a[1]}::DOUBLE) + ({x} - {a[0]}) * ((log10({b[1]}::DOUBLE) - log10({a[1]}::DOUBLE)) / {b[0] - a[0]}))" for a, b in zip(points[:-1], points[1:], strict=True)] + [f"ELSE {points[-1][1]}::DOUBLE END"])
_REG = lambda lamp: f"(CASE WHEN off <= 45 THEN {_LAMP('off', physics.LAMPS[lamp]['least'])} ELSE 0 END)"
_MAG = "round(-13.99::DOUBLE - 2.5::DOUBLE * log10(greatest({i} / (d * d) * exp(-ln(20) * d / (mor * 1000)), 1e-30)), 6)"
ORACLES = {
    "zip_assert": "WITH j AS (SELECT a.o_orderkey, b.o_totalprice AS price FROM orders a JOIN orders b USING (o_orderkey)) SELECT count(*) AS matched, round(sum(price), 2) AS price, (SELECT count(*) FROM orders) AS expected, count(*) = (SELECT count(*) FROM orders) AS complete FROM j",
    "left_lookup": "SELECT s_suppkey, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON s_nationkey = n_nationkey",
    "semi_flag_or": "WITH k AS (SELECT DISTINCT p_size + 1 AS k FROM part WHERE p_brand = 'Brand#7') SELECT p_partkey, p_size IN (SELECT k FROM k) OR p_partkey % 50 IN (SELECT k FROM k) AS listed FROM part",
    "set_difference": "WITH c AS (SELECT c_custkey::VARCHAR AS id FROM customer), o AS (SELECT DISTINCT (o_custkey * 2)::VARCHAR AS id FROM orders) SELECT id, 'customer' AS side FROM c WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT id, 'order' FROM o WHERE id NOT IN (SELECT id FROM c)",
    "truncated_key_join": "SELECT a.k, count(*) AS pairs FROM (SELECT substr(p_name, 1, 5) AS k FROM part) a JOIN (SELECT substr(p_name, 1, 5) AS k FROM part) b USING (k) GROUP BY a.k",
    "theta_anti_dedupe": "WITH c AS (SELECT c_custkey, c_custkey % 499 * 1e-3 AS x, c_custkey % 211 * 1e-3 AS y FROM customer), s AS (SELECT s_suppkey * 7 % 499 * 1e-3 AS u, s_suppkey * 3 % 211 * 1e-3 AS w FROM supplier) SELECT c_custkey FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE round(abs(x - u) + abs(y - w), 9) <= 0.002::DOUBLE)",
    "group_attach": "SELECT o_orderkey, coalesce(string_agg(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "nearest_station_by_key": "WITH j AS (SELECT c_custkey, s_suppkey, round(abs(c_acctbal - s_acctbal), 2) AS d FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey) SELECT c_custkey, coalesce(s_suppkey, -1) AS station, d AS distance FROM j QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) = 1",
    "nearest_within_tol": "WITH j AS (SELECT line_id, seq, source_id, round(sqrt(pow((l.az - s.az) * cos(radians(l.el)), 2) + pow(l.el - s.el, 2)), 6) AS d FROM v_lines l, v_sources s WHERE abs(l.az - s.az) <= 2 AND abs(l.el - s.el) <= 2) SELECT line_id, seq, source_id, d FROM j WHERE d <= 1 QUALIFY row_number() OVER (PARTITION BY line_id, seq ORDER BY d, source_id) = 1",
    "angular_window_candidates": f"WITH o AS (SELECT n_nationkey, n_nationkey * 14.5e0 AS b FROM nation), j AS (SELECT n_nationkey, source_id, km, {_ANGLE.format(a='az', b='b')} AS d FROM o, v_sources), k AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY km, source_id) AS rank FROM j WHERE d <= 0.5) SELECT n_nationkey, source_id, round(d, 6) AS d_az, rank FROM k WHERE rank <= 3",
    "point_to_polyline": f"WITH {_TRACK}, p AS (SELECT s_suppkey, s_suppkey % 24 - 12e0 AS px, s_suppkey % 17 * 0.9::DOUBLE AS py FROM supplier), j AS (SELECT *, greatest(0, least(1, ((px - x) * (x2 - x) + (py - y) * (y2 - y)) / ((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)))) AS t FROM p, seg), k AS (SELECT s_suppkey, round(sqrt(pow(px - (x + t * (x2 - x)), 2) + pow(py - (y + t * (y2 - y)), 2)), 6) AS distance, round(ch + t * (ch2 - ch), 5) AS chain FROM j) SELECT s_suppkey, distance, chain FROM k QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, chain) = 1",
    "ray_crossings": f"WITH {_TRACK}, r AS (SELECT s_suppkey, radians(s_suppkey % 179 - 89.3::DOUBLE) AS a FROM supplier), j AS (SELECT *, sin(a) * (y2 - y) - cos(a) * (x2 - x) AS det, x * (y2 - y) - y * (x2 - x) AS sn, x * cos(a) - y * sin(a) AS tn FROM r, seg), k AS (SELECT s_suppkey, sn / det AS s, tn / det AS t, ch, ch2 FROM j WHERE det <> 0) SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY s) AS crossing, round(s, 6) AS distance, round(ch + t * (ch2 - ch), 5) AS chain FROM k WHERE s > 0 AND t >= 0 AND t < 1",
    "bracket_interp": f"WITH {_TRACK}, p AS (SELECT source_id, (az - 200) / 4 AS q FROM v_sources) SELECT source_id, round(min(y + (q - x) / (x2 - x) * (y2 - y)), 6) AS value FROM p JOIN seg ON q BETWEEN x AND x2 GROUP BY source_id",
    "grid_interp": "WITH p AS (SELECT source_id, least(greatest(az - 150, 0), 150) AS x FROM v_sources), k AS (SELECT i, sin(i * 0.3::DOUBLE) + i / 100 AS el FROM range(151) r(i)) SELECT source_id, round(a.el + (x - floor(x)) * (coalesce(b.el, a.el) - a.el), 6) AS el FROM p JOIN k a ON a.i = floor(x) LEFT JOIN k b ON b.i = floor(x) + 1",
    "priority_coalesce": "SELECT a.r, a.c, CASE WHEN a.r % 5 <> 0 AND a.z IS NOT NULL THEN a.z WHEN a.c % 4 <> 1 THEN a.z + 1000 END AS z, CASE WHEN a.z IS NULL THEN NULL WHEN a.r % 5 <> 0 THEN 0 WHEN a.c % 4 <> 1 THEN 1 END AS src FROM v_raster a",
    "bilinear_sample": "WITH p AS (SELECT s_suppkey, s_suppkey % 57 AS r, s_suppkey % 2 AS c FROM supplier), j AS (SELECT s_suppkey, i, j, z FROM p, range(2) a(i), range(2) b(j), v_raster g WHERE g.r = p.r + i AND g.c = p.c + j) SELECT p.s_suppkey, CASE WHEN count(z) = 4 THEN round(sum((CASE i WHEN 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END) * (CASE j WHEN 1 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END) * z), 6) END AS z FROM p LEFT JOIN j USING (s_suppkey) GROUP BY p.s_suppkey",
    "cell_lookup": "SELECT s_suppkey, coalesce(z, 0) AS h FROM supplier LEFT JOIN v_raster ON r = s_suppkey % 60 AND c = s_suppkey % 3 AND r % 2 = 0",
    "point_in_ring_parity": "WITH v AS (SELECT n_nationkey AS i, (6 + n_nationkey % 3) * cos(radians(n_nationkey * 14.4::DOUBLE)) AS x, (6 + n_nationkey % 3) * sin(radians(n_nationkey * 14.4::DOUBLE)) AS y FROM nation), e AS (SELECT a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM v a JOIN v b ON b.i = (a.i + 1) % 25), p AS (SELECT s_suppkey, s_suppkey % 19 - 9.05::DOUBLE AS px, s_suppkey % 13 * 1.3::DOUBLE - 7.91::DOUBLE AS py FROM supplier) SELECT s_suppkey FROM p, e WHERE (y0 > py) <> (y1 > py) AND px < x0 + (py - y0) / (y1 - y0) * (x1 - x0) GROUP BY s_suppkey HAVING count(*) % 2 = 1",
    "param_sweep": "SELECT source_id, i * 0.5::DOUBLE + 0.56::DOUBLE AS lamp, j * 0.25::DOUBLE AS k, round(el + degrees((i * 0.5::DOUBLE + 0.56::DOUBLE) / (km * 1000)) + degrees(j * 0.25::DOUBLE * (km * 1000) / (2 * 6371000e0)), 7) AS app_el FROM v_sources, range(3) a(i), range(4) b(j)",
    "cell_rasterise": f"WITH {_RASTER} SELECT * FROM ras",
    "obstruction_surface": f"WITH {_RASTER} SELECT cell, CASE WHEN n_above >= 2 AND n_above / n >= 0.25 THEN greatest(hmax, 0) ELSE 0e0 END AS dense, CASE WHEN n_above >= 1 THEN greatest(hmax, 0) ELSE 0e0 END AS highest FROM ras",
    "robust_stats": "WITH a AS (SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS sd, quantile_cont(l_extendedprice, [0.05, 0.5, 0.95]) AS p FROM lineitem GROUP BY 1), m AS (SELECT l_returnflag, quantile_cont(abs(l_extendedprice - p[2]), 0.5) AS m FROM lineitem JOIN a USING (l_returnflag) GROUP BY 1) SELECT l_returnflag, mean, sd, round(p[1], 4) AS p5, round(p[2], 4) AS median, round(p[3], 4) AS p95, round(1.4826::DOUBLE * m, 4) AS robust_sd FROM a JOIN m USING (l_returnflag)",
    "greatest_of_three": "SELECT p_partkey, greatest(CASE WHEN p_partkey % 2 = 0 THEN p_size END, CASE WHEN p_partkey % 3 = 0 THEN p_size * 2 END) AS highest FROM part",
    "histogram_max": "WITH p AS (SELECT count(*) AS lines FROM lineitem GROUP BY l_orderkey) SELECT lines, count(*) AS orders, round((SELECT max(lines) FROM p) / 12e0, 6) AS rate FROM p GROUP BY lines",
    "dedupe_rounded_first": "SELECT min(c_custkey) AS c_custkey, round_even(c_acctbal / 100, 0)::BIGINT AS a, c_custkey % 7 AS b FROM customer GROUP BY 2, 3",
    "source_summary": "SELECT kind, nation, round(min(az), 6) AS az_min, round(max(az), 6) AS az_max, round(min(el), 6) AS low, round(max(el), 6) AS high, count(*) AS n FROM v_sources GROUP BY kind, nation HAVING max(az) >= 160 AND min(az) <= 290",
    "line_peaks": "SELECT line_id, round(min(az), 6) AS az_min, round(max(az), 6) AS az_max, max(rate) AS peak, coalesce(array_to_string(list_sort(list_distinct(list(floor(km)::BIGINT) FILTER (WHERE rate > 0))), ','), '') AS km FROM v_lines GROUP BY line_id",
    "rate_map_max_then_sum": f"WITH {_MAP} SELECT ia, ie, round(rate, 6) AS rate FROM mp",
    "band_coverage": f"WITH {_MAP}, g AS (SELECT (i % {grids.N_AZ})::INT AS ia, (i // {grids.N_AZ})::INT AS ie FROM range({grids.N_AZ * 9}) r(i)), c AS (SELECT CASE WHEN rate IS NULL OR round(rate, 6) < 0.01 THEN 0 WHEN round(rate, 6) < 0.1 THEN 1 WHEN round(rate, 6) < 1 THEN 2 WHEN round(rate, 6) < 10 THEN 3 ELSE 4 END AS level FROM g LEFT JOIN mp USING (ia, ie)) SELECT level, round(count(*) / {grids.N_AZ * 9}, 6) AS share FROM c GROUP BY level",
    "column_window_max": f"WITH {_MAP}, c AS (SELECT ia, max(rate) AS top FROM mp GROUP BY ia) SELECT a.ia, round(any_value(a.top), 6) AS top, round(max(b.top), 6) AS window_top FROM c a JOIN c b ON b.ia BETWEEN a.ia - 3 AND a.ia + 3 GROUP BY a.ia",
    "scenario_max": f"WITH {_MAP}, l AS (SELECT ia, ie, floor(round(rate, 6))::BIGINT AS level FROM mp), u AS (SELECT * FROM l UNION ALL SELECT ia, (ie + 3) % {grids.N_EL}, level + 1 FROM l) SELECT ia, ie, max(level) AS level FROM u GROUP BY ia, ie",
    "photometry_magnitudes": "WITH s AS (SELECT source_id, km * 1000 AS d, abs((((az * 3.7::DOUBLE + 540) % 360) + 360) % 360 - 180) AS h FROM v_sources), o AS (SELECT *, 180 - h AS off FROM s), i AS (SELECT *, CASE WHEN h <= 90 THEN 0 ELSE 2 * " + _REG("tail") + " END AS tail, CASE WHEN h <= 90 THEN 0 ELSE 2 * " + _REG("tail") + " + 2 * " + _REG("stop") + " + " + _REG("high_stop") + " END AS brake FROM o, (VALUES (68e0), (111e0), (203e0)) v(mor)) SELECT source_id, mor, " + _MAG.format(i="tail") + " AS m_tail, " + _MAG.format(i="brake") + " AS m_brake FROM i",
    "beam_lookup": "WITH b AS (SELECT i // 45 AS r, i % 45 AS c, log10(20000e0 / (1 + pow((i // 45 - 12) / 3e0, 2) + pow((i % 45 - 22) / 6e0, 2))) AS z FROM range(1125) g(i)), s AS (SELECT source_id, least(greatest((el + 3) * 4, 0), 23.999::DOUBLE) AS v, least(greatest((az - 150) / 3, 0), 43.999::DOUBLE) AS h FROM v_sources) SELECT source_id, round(greatest(pow(10, sum((CASE WHEN r = floor(v) THEN 1 - (v - floor(v)) ELSE v - floor(v) END) * (CASE WHEN c = floor(h) THEN 1 - (h - floor(h)) ELSE h - floor(h) END) * z)), 0.5), 4) AS candela FROM s JOIN b ON r BETWEEN floor(v) AND floor(v) + 1 AND c BETWEEN floor(h) AND floor(h) + 1 GROUP BY source_id",
    "detect_km": "WITH s AS (SELECT kind, round(-13.99::DOUBLE - 2.5::DOUBLE * log10(80e0 / pow(km * 1000, 2) * exp(-ln(20) * km * 1000 / 111000e0)), 6) AS m FROM v_sources) SELECT kind, " + ", ".join(f"round(count(CASE WHEN m <= round(0.3834::DOUBLE * 21.4::DOUBLE - 1.44::DOUBLE - 2.5::DOUBLE * log10({f}::DOUBLE), 6) THEN 1 END) * 0.06::DOUBLE, 6) AS {n}" for f, n in ((2.0, "reference"), (4.8, "least"), (1.0, "most"))) + " FROM s GROUP BY kind",
    "angular_rates": "WITH s AS (SELECT *, km / 5 + el / 2 + 273.15::DOUBLE AS t FROM v_sources) SELECT source_id, round(degrees(30 * abs(sin(radians(200 - az))) / (km * 1000)) * 60, 6) AS deg_per_min, ['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW'][floor(az / 22.5::DOUBLE + 0.5::DOUBLE)::INT % 16 + 1] AS point, round(503e0 * 850 / (t * t) * (0.0343::DOUBLE + el / 78), 6) AS k FROM s",
    "classify_spec_text": "WITH s AS (SELECT p_partkey, p_size % 12 AS ch, substr('KLMN', (p_partkey % 4 + 1)::INT, 1) AS ed FROM part) SELECT CASE WHEN p_partkey % 10 <= 1 THEN 'none' WHEN ed = 'K' THEN 'lit' WHEN ch = 10 THEN 'adls' WHEN ch = 9 THEN 'dual_high' WHEN ch = 8 THEN 'dual' WHEN ch = 7 THEN 'white_high' WHEN ch = 6 THEN 'white' WHEN ch = 5 THEN 'red' ELSE 'lit' END AS kind, count(*) AS parts FROM s GROUP BY 1",
    "evidence_kind": "WITH t AS (SELECT role, lower(concat_ws(' ', role, text, CASE turn % 4 WHEN 0 THEN 'a Photo' WHEN 1 THEN 'newspaper report, hearsay' WHEN 2 THEN 'campaign' END)) AS x FROM conversations) SELECT role, CASE WHEN regexp_matches(x, 'photo|video') THEN 'photo' WHEN regexp_matches(x, 'instrument|campaign|measurement|triangul|spectro') THEN 'instrument' WHEN regexp_matches(x, 'newspaper|magazine|tv|press|print') THEN 'press' ELSE 'eyewitness' END AS kind, regexp_matches(x, 'single|uncited|unverified|fan|weak|hearsay|third-hand') AS weak, count(*) AS n FROM t GROUP BY 1, 2, 3",
    "catalogue_filter": "SELECT p_partkey, p_name FROM part WHERE lower(concat_ws(' ', p_name, p_brand, p_type)) LIKE '%red%'",
    "refraction_bins": "SELECT CASE WHEN kc <= 0 THEN 'k1' WHEN kc <= 0.07::DOUBLE THEN 'k2' WHEN kc <= 0.13::DOUBLE THEN 'k3' WHEN kc <= 0.25 THEN 'k4' WHEN kc <= 0.5 THEN 'k5' ELSE 'k6' END AS bin, count(*) AS n FROM v_sources GROUP BY 1",
    "class_vmhx": "WITH s AS (SELECT *, CASE WHEN source_id % 13 <> 0 THEN source_id % 41 / 40e0 END AS p FROM v_sources), c AS (SELECT *, CASE WHEN p IS NULL THEN 'x' WHEN p <= 0.05::DOUBLE THEN 'h' WHEN p >= 0.95::DOUBLE AND kc <= 0.13::DOUBLE THEN 'v' ELSE 'm' END AS cls FROM s) SELECT source_id, cls, CASE cls WHEN 'v' THEN 1e0 WHEN 'm' THEN 0.5::DOUBLE ELSE 0e0 END AS weight, round(greatest(CASE WHEN cls IN ('v', 'm') THEN least(kc, 0.13::DOUBLE) ELSE kc END, 0), 6) AS k_low FROM c",
    "verdict_cascade": f"WITH {_MAP}, l AS (SELECT *, floor((az - {grids.AZ0}) / {grids.DAZ}::DOUBLE)::INT AS ia, floor((el - ({grids.EL0})) / {grids.DEL}::DOUBLE)::INT AS ie FROM v_lines), j AS (SELECT l.*, round(mp.rate, 6) AS mr FROM l LEFT JOIN mp USING (ia, ie)) SELECT CASE WHEN az < 150 OR az > 300 THEN 'outside' WHEN el > round(1.2::DOUBLE + sin(radians(az)) / 2, 6) THEN 'above' WHEN mr IS NULL AND line_id % 5 <> 0 THEN 'quiet' WHEN mr >= 10 THEN 'busy' WHEN mr >= 0.1 THEN 'occasional' WHEN line_id % 5 = 0 THEN 'fixed' ELSE 'quiet' END AS verdict, count(*) AS n FROM j GROUP BY 1",
    "best_candidate": f"WITH o AS (SELECT n_nationkey, n_nationkey * 6e0 + 150 AS b, n_nationkey % 5 * 0.2::DOUBLE AS e FROM nation), j AS (SELECT *, {_ANGLE.format(a='az', b='b')} AS d FROM o, v_sources) SELECT n_nationkey, source_id FROM j WHERE d <= 2 QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY abs(el - e) > 0.1::DOUBLE, kc > 0.13::DOUBLE, km, source_id) = 1",
    "heterogeneous_union": "WITH u AS (SELECT 'supplier' AS kind, s_suppkey AS id, s_acctbal / 100 AS km, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT 'customer', c_custkey, c_acctbal / 90, c_mktsegment FROM customer) SELECT kind, id, round(km, 6) AS km, segment FROM u WHERE km BETWEEN 0 AND 20",
}
ORACLES["mask_union"] = f"WITH f AS (SELECT * FROM v_sources WHERE kind <> 'field'), {_boxes('f', 0.3, 0.1, 'kind')} SELECT DISTINCT ia, ie0::INT AS ie FROM st"
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
