"""Queries of filters, look-ups, rankings and rules on catalogues of a scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, physics
from ..operators import joins, rules, windows
from .views import LAT0, LON0, table, view, with_views

#: azimuths of the viewer's fan (degrees)
FAN = (157.276, 277.276)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places up to two degrees round the viewer."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", ((F.col("c_custkey") % 401 - 200) * 0.01 + LON0).alias("lon"), ((F.col("c_custkey") % 307 - 150) * 0.01 + LAT0).alias("lat"))


def bbox_then_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within 80 km: a box of one degree first, then the exact distance."""
    p = _places(spark, sf_dir).where((F.abs(F.col("lon") - LON0) <= 1) & (F.abs(F.col("lat") - LAT0) <= 1))
    return p.withColumn("m", F.round(geo.haversine(F.lit(LON0), F.lit(LAT0), F.col("lon"), F.col("lat")), 2)).where("m <= 80000").select("c_custkey", "m")


def attribute_in_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by lists of brands and sizes, and by a prefix of the name."""
    p = table(spark, sf_dir, "part")
    return p.where(F.col("p_brand").isin("Brand#1", "Brand#7", "Brand#12") & (F.col("p_name").startswith("red") | F.col("p_size").isin(1, 2, 3, 5, 8, 13))).select("p_partkey", "p_brand", "p_size")


def band_below_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line vertices at most one degree below the skyline of their azimuth cell, by an equi-join on the cell."""
    sky = spark.range(0, 300).select(F.col("id").alias("ia"), (F.sin(F.col("id") * 0.05) + 0.5).alias("sky"))
    l = view(spark, sf_dir, "lines").withColumn("ia", F.floor((F.col("az") - 150) * 2))
    return l.join(sky, "ia").where((F.col("el") <= F.col("sky")) & (F.col("el") >= F.col("sky") - 1)).groupBy("line_id").agg(F.count("*").alias("n"), F.round(F.max("el"), 6).alias("top"))


def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third vertex of each line, the first one included."""
    l = view(spark, sf_dir, "lines")
    return l.withColumn("_n", F.row_number().over(Window.partitionBy("line_id").orderBy("seq"))).where("_n % 3 = 1").select("line_id", "seq", F.round("km", 6).alias("km"))


def _tiles(spark: SparkSession) -> DataFrame:
    """Four overlapping tiles: name and footprint."""
    rows = [("USGS_1M_a", -104.1, -103.9, 30.0, 30.2), ("USGS_1M_b", -104.0, -103.9, 30.1, 30.3), ("USGS_13_n31w104", -104.2, -103.9, 30.0, 30.26), ("USGS_1_n31w104", -105.0, -103.0, 30.0, 31.0)]
    return spark.createDataFrame(rows, "name string, west double, east double, south double, north double")


_TILES_SQL = "tiles(name, west, east, south, north) AS (VALUES ('USGS_1M_a', -1041e-1, -1039e-1, 300e-1, 302e-1), ('USGS_1M_b', -1040e-1, -1039e-1, 301e-1, 303e-1), ('USGS_13_n31w104', -1042e-1, -1039e-1, 300e-1, 3026e-2), ('USGS_1_n31w104', -1050e-1, -1030e-1, 300e-1, 310e-1))"


def footprint_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by tile whose footprint holds them; tiles are a table of constants, so the range test is a broadcast join."""
    t = view(spark, sf_dir, "targets").select("target_id", "lon", "lat")
    met = t.join(F.broadcast(_tiles(spark)), (F.col("lon") >= F.col("west")) & (F.col("lon") < F.col("east")) & (F.col("lat") >= F.col("south")) & (F.col("lat") < F.col("north")))
    return met.groupBy("name").agg(F.count("*").alias("targets"), F.min("target_id").alias("first"))


#: standard deviation (m) and correlation length (m) of terrain by a part of the tile's name, in order of preference
TERRAIN_ERROR = [("1M", 0.056, 20.0), ("USGS_13", 0.56, 70.0), ("USGS_1_", 2.05, 125.0)]


def error_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error model of each tile: the first entry whose key is part of its name."""
    keys = spark.createDataFrame([(i, *e) for i, e in enumerate(TERRAIN_ERROR)], "rank int, part string, sigma double, corr double")
    met = _tiles(spark).join(F.broadcast(keys), F.col("name").contains(F.col("part")))
    best = met.groupBy("name").agg(F.min(F.struct("rank", "sigma", "corr")).alias("b"))
    return best.select("name", "b.sigma", "b.corr")


def returns_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns without noise classes and withheld ones, of enough size and signal and not too elongated, counted by class."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("cls"), (F.col("l_linestatus") == "O").alias("withheld"), F.col("l_quantity").alias("area"), (F.col("l_extendedprice") / 1000).alias("snr"), (F.col("l_tax") * 100 + 1).alias("aspect"))
    kept = l.where(~F.col("cls").isin(7, 18) & ~F.col("withheld") & (F.col("area") >= 4) & (F.col("snr") > 5) & (F.col("aspect") <= 4))
    return kept.groupBy("cls").agg(F.count("*").alias("n"))


def privacy_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airfields that may be shown: historic ones, balloon ports, and open ones that an official list has by either code."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(k) for k in ("closed", "small_airport", "heliport", "balloonport")]), (F.col("c_custkey") % 4 + 1).cast("int")).alias("type"), F.col("c_mktsegment").alias("name"), (F.col("c_custkey") % 90).alias("local"), (F.col("c_custkey") % 77).alias("ident"))
    official = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("k"))
    c = joins.semi_flag(c, official, "k", ["local", "ident"], "listed")
    return c.select("c_custkey", rules.shown_airfield(F.col("type"), F.col("name").contains("MACH"), F.col("listed")).alias("kind")).where("kind IS NOT NULL")


def global_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target nearest to each of two junctions: one aggregation over all targets, no sort."""
    t = view(spark, sf_dir, "targets")
    ends = spark.createDataFrame([("junction", -104.0, 30.15), ("south end", -104.1, 30.08)], "place string, plon double, plat double")
    d = F.round(geo.haversine(F.col("plon"), F.col("plat"), F.col("lon"), F.col("lat")), 2)
    best = t.crossJoin(F.broadcast(ends)).groupBy("place").agg(F.min(F.struct(d.alias("m"), "target_id")).alias("b"))
    return best.select("place", "b.target_id", "b.m")


def nearest_lamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tabulated lamp height nearest to each source's, the lower on ties."""
    lamps = F.array(*[F.lit(x) for x in (0.56, 0.66, 0.86, 1.12, 1.37, 2.5, 4.0)])
    s = view(spark, sf_dir, "sources").select("source_id", (F.col("km") / 20).alias("ref"))
    best = F.array_min(F.transform(lamps, lambda x: F.struct(F.round(F.abs(x - F.col("ref")), 9).alias("d"), x.alias("lamp"))))
    return s.select("source_id", best["lamp"].alias("lamp"))


#: route prefix -> label
ROUTE_LABELS = {"US": "US highway", "FM": "Farm to Market Road"}


def route_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of five points or more with the label of their route's prefix, the prefix itself where there is none."""
    t = view(spark, sf_dir, "targets").withColumn("prefix", F.element_at(F.split("route", "-"), 1))
    names = spark.createDataFrame(list(ROUTE_LABELS.items()), "prefix string, label string")
    pieces = t.groupBy("prefix", "route", F.floor(F.col("target_id") / 40).alias("piece")).agg(F.count("*").alias("points")).where("points >= 5")
    return pieces.join(F.broadcast(names), "prefix", "left").select("route", "piece", "points", F.coalesce("label", "prefix").alias("label"))


def line_fan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each line: nearest distance; within the fan the spans of azimuth and distance, and of its part nearer than 20 km."""
    l = view(spark, sf_dir, "lines").select("line_id", F.round("az", 6).alias("az"), F.round("km", 6).alias("km"))
    fan = F.col("az").between(*FAN)
    front = fan & (F.col("km") < 20)
    spans = [f(F.when(c, F.col(v))).alias(f"{n}_{v}_{m}") for c, n in ((fan, "fan"), (front, "front")) for v in ("az", "km") for f, m in ((F.min, "min"), (F.max, "max"))]
    return l.groupBy("line_id").agg(F.min("km").alias("nearest"), F.bool_or(fan).alias("in_fan"), *spans)


def fan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line about each line's place in the fan, for a popup."""
    s = line_fan_stats(spark, sf_dir)
    n = lambda c: F.format_number(c, 1)
    inside = F.concat(F.lit("In fan: az "), n("fan_az_min"), F.lit("-"), n("fan_az_max"), F.lit(", km "), n("fan_km_min"), F.lit("-"), n("fan_km_max"))
    front = F.when(F.col("front_km_min").isNotNull(), F.concat(F.lit("; in front at km "), n("front_km_min"), F.lit("-"), n("front_km_max"))).otherwise("")
    return s.select("line_id", F.when(~F.col("in_fan"), F.concat(F.lit("Outside (nearest km "), n("nearest"), F.lit(")"))).otherwise(F.concat(inside, front)).alias("text"))


def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one owner, subdivision and kind as one geometry: parts in the order of their ids, their vertices in order."""
    l = view(spark, sf_dir, "lines").select(F.element_at(F.array(F.lit("UP"), F.lit("TXPF"), F.lit("BNSF")), (F.col("line_id") % 3 + 1).cast("int")).alias("owner"), F.when(F.col("line_id") % 4 == 0, F.lit(None)).otherwise(F.col("line_id") % 2).alias("sub"), F.when(F.col("line_id") % 5 == 0, "siding/yard").otherwise("main").alias("kind"), "line_id", "seq", "az")
    part = l.groupBy("owner", "sub", "kind", "line_id").agg(F.sort_array(F.collect_list(F.struct("seq", "az"))).alias("v"))
    whole = part.groupBy("owner", "sub", "kind").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line_id", "v"))), lambda x: x["v"])).alias("v"), F.count("*").alias("parts"))
    label = F.coalesce(rules.rail_label(F.col("owner")), F.col("owner"))
    return whole.select(F.concat(label, F.lit(" - "), F.coalesce(F.col("sub").cast("string"), F.lit("(siding/yard)")), F.lit(", "), "kind").alias("label"), "parts", F.size("v").cast("long").alias("vertices"), F.round(F.element_at("v", -1)["az"], 6).alias("last_az"))


def catalogue_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the conversations: all turns, long ones, users' ones, and those that begin with an article."""
    c = table(spark, sf_dir, "conversations")
    return c.agg(F.count("*").alias("all"), F.count_if(F.length("text") > 200).alias("long"), F.count_if(F.col("role") == "user").alias("by_user"), F.count_if(F.lower("text").rlike("^(the|der|le|el) ")).alias("article"))


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies in a bearing's window, of all layers: sources, line vertices and places in one list, ranked by distance; the five nearest.

    Layers with different fields become one table first, so one bucketed join serves them all.
    """
    near = _places(spark, sf_dir).withColumns({"az": F.round(geo.bearing(F.lit(LON0), F.lit(LAT0), F.col("lon"), F.col("lat")), 6), "km": F.round(geo.haversine(F.lit(LON0), F.lit(LAT0), F.col("lon"), F.col("lat")) / 1000, 6)})
    layers = view(spark, sf_dir, "sources").select(F.col("kind").alias("layer"), F.col("source_id").alias("id"), "az", F.round("km", 6).alias("km"), "kc")
    layers = layers.unionByName(view(spark, sf_dir, "lines").where("rate > 0").select(F.lit("line").alias("layer"), (F.col("line_id") * 1_000_000 + F.col("seq")).cast("long").alias("id"), "az", F.round("km", 6).alias("km"), "rate"), allowMissingColumns=True)
    layers = layers.unionByName(near.where("km < 60").select(F.lit("place").alias("layer"), F.col("c_custkey").alias("id"), "az", "km"), allowMissingColumns=True)
    obs = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 6 + 150.25).alias("b"), F.when(F.col("n_nationkey") % 2 == 0, 1.0).otherwise(3.0).alias("tol"))
    met = joins.angular_join(layers, F.col("az"), obs, F.col("b"), F.col("tol"))
    return windows.top_by(met, ["n_nationkey"], ["km", "layer", "id"], 5).select("n_nationkey", "rank", "layer", "id", "km", F.round("kc", 6).alias("kc"))


def catalogue_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by facets: role, and a text anywhere in the whole record, in lower case."""
    c = table(spark, sf_dir, "conversations")
    return c.where((F.col("role") == "user") & F.lower(F.concat_ws(" ", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text")).contains("the ")).select("conv_id", "turn")


def brightest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation's sources the brightest: the smallest magnitude, then the smaller id."""
    s = view(spark, sf_dir, "sources").withColumn("m", F.round(physics.magnitude(80.0 / F.pow(F.col("km") * 1000, F.lit(2.0))), 6))
    return s.groupBy("nation").agg(F.min(F.struct("m", "source_id")).alias("b")).select("nation", "b.m", "b.source_id")


def top_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 lights of largest significance times the root of their size, which counts up to 400."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * F.sqrt(F.least(F.col("p_size") * 20, F.lit(400))), 4).alias("weight"))
    return p.orderBy(F.desc("weight"), "p_partkey").limit(40)


def calibration_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 sources at the smallest angle from a direction of view."""
    s = view(spark, sf_dir, "sources")
    a, e, a0, e0 = F.radians("az"), F.radians("el"), F.radians(F.lit(215.0)), F.radians(F.lit(0.4))
    cosine = F.sin(e) * F.sin(e0) + F.cos(e) * F.cos(e0) * F.cos(a - a0)
    return s.select("source_id", F.round(F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))), 6).alias("apart")).orderBy("apart", "source_id").limit(12)


def alternative_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's local minima, the lowest three that are farther than 400 along the chain from the lowest."""
    s = view(spark, sf_dir, "series").withColumn("low", windows.local_minimum("v", "user_id", "seq", 2)).where("low").select("user_id", "chain", "v")
    best = s.groupBy("user_id").agg(F.min(F.struct("v", "chain")).alias("b"))
    far = s.join(best, "user_id").where(F.abs(F.col("chain") - F.col("b.chain")) > 400)
    return windows.top_by(far, ["user_id"], ["v", "chain"], 3).select("user_id", "chain", "v", "rank")


def verdict_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as photographs, ranked by verdict: explained, partly so, open, other, without analysis; then by key."""
    o = table(spark, sf_dir, "orders")
    verdict = F.element_at(F.array(F.lit("explained"), F.lit("explained in part"), F.lit("can't tell"), F.lit("no match"), F.lit(None).cast("string")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    ranked = o.select("o_orderkey", "o_custkey", rules.verdict_rank(verdict).alias("place"))
    return windows.top_by(ranked, ["o_custkey"], ["place", "o_orderkey"], 2).select("o_custkey", "o_orderkey", "place", "rank")


def first_night_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event that is not by day, else the first of all."""
    s = view(spark, sf_dir, "series").withColumn("day", F.hour("ts").between(7, 19))
    return s.groupBy("user_id").agg(F.min(F.struct("day", "seq", "event_id")).alias("b")).select("user_id", "b.event_id", "b.day")


def log_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's three newest entries after the second newest was deleted."""
    w = Window.partitionBy("user_id").orderBy(F.desc("seq"))
    kept = view(spark, sf_dir, "series").withColumn("_i", F.row_number().over(w)).where("_i <> 2")
    return kept.where("_i <= 4").select("user_id", F.when(F.col("_i") > 2, F.col("_i") - 1).otherwise(F.col("_i")).alias("place"), "event_id")


def moon_and_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of the moon and words for magnitudes, counted over angles and magnitudes of the sources."""
    s = view(spark, sf_dir, "sources")
    return s.groupBy(rules.moon_phase((F.col("source_id") * 37 % 360).cast("double")).alias("phase"), rules.brightness_words(F.col("km") / 8 - 2).alias("words")).agg(F.count("*").alias("n"))


def forecast_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refraction classes of a forecast: pressure and temperatures from the sources, three classes and their texts counted."""
    s = view(spark, sf_dir, "sources")
    k = F.round(physics.k_from_forecast(850.0, F.col("km") / 5, F.col("km") / 5 + F.col("el") * 4), 9)
    return s.groupBy(rules.forecast_class(k).alias("cls")).agg(F.count("*").alias("n"), F.round(F.max(k), 6).alias("highest"))


def search_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-widths of the search by how a bearing was measured, on events by type."""
    s = view(spark, sf_dir, "series")
    how = F.element_at(F.array(*[F.lit(x) for x in ("photo", "skyfinder", "landmark", "compass", "guess")]), (F.col("event_id") % 5 + 1).cast("int"))
    return s.groupBy(how.alias("how")).agg(F.max(rules.search_width(how)).alias("degrees"), F.count("*").alias("n"))


def sky_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of each state of the sky by day, from heights of sun and moon every ten minutes of an analytic year."""
    e = view(spark, sf_dir, "series").select("event_id")
    t = e.select((F.col("event_id") % 365).alias("day"), (F.col("event_id") % 144).alias("slot"))
    sun, moon = 50 * F.sin(F.radians(F.col("slot") * 2.5 - 90.0)) + 10 * F.sin(F.radians(F.col("day") * 1.0)), 40 * F.sin(F.radians(F.col("slot") * 2.4 + F.col("day") * 12.2))
    lit = 0.5 + 0.5 * F.cos(F.radians(F.col("day") * 12.19))
    return t.groupBy(rules.sky_state(F.round(sun, 9), F.round(moon, 9), F.round(lit, 9)).alias("state")).agg((F.count("*") * 10).alias("minutes"))


def facing_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the two travel directions of each sample the one whose headlamps face the viewer, if any does."""
    t = view(spark, sf_dir, "targets").select("target_id", (F.col("target_id") % 360).cast("double").alias("heading"), (F.col("target_id") * 7 % 360).cast("double").alias("az"))
    both = t.select("target_id", F.explode(F.array(*[F.struct(F.lit(d).alias("dir"), geo.wrap(F.col("az") - F.col("heading") + 180.0 * d).alias("h")) for d in (0, 1)])).alias("x"))
    best = both.groupBy("target_id").agg(F.min(F.when(F.abs(F.col("x.h")) < 90, F.col("x"))).alias("b"))
    return best.select("target_id", "b.dir", F.round("b.h", 6).alias("h"))


def observer_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The viewer's ground height from the raster's cell, on each source as its height over the eye."""
    r = view(spark, sf_dir, "raster").where("r = 12 AND c = 1").agg(F.max("z").alias("ground"))
    return view(spark, sf_dir, "sources").crossJoin(F.broadcast(r)).select("source_id", F.round(F.col("km") * 10 - F.col("ground") - 1.6, 6).alias("over_eye"))


def tile_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names and places of downloads from a list of tiles: a declarative table."""
    kinds = spark.createDataFrame([("1m", "x{x}y{y}", "m"), ("13", "n{y}w{x}", "ft")], "product string, form string, unit string")
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5 + 100).cast("string").alias("x"), (F.col("n_nationkey") / 5 + 30).cast("int").cast("string").alias("y"))
    name = F.concat(F.lit("USGS_"), "product", F.lit("_"), F.replace(F.replace("form", F.lit("{x}"), F.col("x")), F.lit("{y}"), F.col("y")), F.lit(".tif"))
    return n.crossJoin(F.broadcast(kinds)).select(name.alias("file"), F.concat(F.lit("elevation/"), "product", F.lit("/TIFF/"), name).alias("path"), "unit")


def tile_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of the raster with their footprints and numbers of cells with data."""
    r = view(spark, sf_dir, "raster")
    at = r.select(F.floor(F.col("r") / 16).alias("tr"), F.floor(F.col("c") / 16).alias("tc"), "r", "c", "z")
    return at.groupBy("tr", "tc").agg(F.min("r").alias("south"), (F.max("r") + 1).alias("north"), F.min("c").alias("west"), (F.max("c") + 1).alias("east"), F.count("z").alias("cells"))


def road_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road and rail vertices in one list (name, az, el, km, cls, kc): elevations from milliradians, rail classes from k."""
    s = view(spark, sf_dir, "sources")
    el = lambda mrad: F.round(F.degrees(F.atan(mrad / 1000)), 7)
    road = s.where("kind IN ('tower', 'town')").select(F.concat(F.lit("road "), (F.col("nation") % 3).cast("string")).alias("name"), "az", el(F.col("el") * 10).alias("el"), "km", F.when(F.col("kc") <= 0.25, "m").otherwise("h").alias("cls"), "kc")
    rail = s.where("kind IN ('cell', 'field')").select(F.concat((F.col("nation") % 2).cast("string"), F.lit(" rail")).alias("name"), "az", el(F.col("el") * 10).alias("el"), "km", F.when(F.col("kc") <= 0.13, "v").otherwise("h").alias("cls"), "kc")
    return road.unionByName(rail).groupBy("name", "cls").agg(F.count("*").alias("n"), F.round(F.avg("el"), 6).alias("el"), F.round(F.min("km"), 6).alias("km"))


def vetted_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of pixels whose peak stands 1.2 times above their median or more."""
    l = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("spot"), (F.col("l_extendedprice") + 1000).alias("v"))
    per = l.groupBy("spot").agg(F.max("v").alias("peak"), F.expr("percentile(v, 0.5)").alias("median"), F.count("*").alias("pixels"))
    return per.select("spot", "pixels", (F.round(F.col("peak") / F.col("median"), 6) >= 1.2).alias("accepted"))


def named_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of one named route: number, first and last chainage."""
    t = view(spark, sf_dir, "targets").where("route = 'US-67'")
    return t.agg(F.count("*").alias("points"), F.min("chain").alias("first"), F.max("chain").alias("last"))


def fan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of the fan's two edges every 10 km up to 80 km."""
    d = spark.range(0, 9).withColumn("az", F.explode(F.array(*[F.lit(x) for x in FAN])))
    lon, lat = geo.spherical_direct(F.lit(LON0), F.lit(LAT0), F.col("az"), F.col("id") * 10_000.0)
    return d.select("az", (F.col("id") * 10).alias("km"), F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def class_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes in the older map's words, with colours in the byte order of placemark files."""
    s = view(spark, sf_dir, "sources")
    cls = rules.visibility_class(F.col("source_id") % 41 / 40, F.col("kc"), F.lit(0.13))
    return s.groupBy(rules.old_class(cls).alias("cls")).agg(F.count("*").alias("n"), F.max(rules.kml_colour(F.when(cls == "v", "#12ab9f").otherwise("#c0ffee"))).alias("colour"))


def classes_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by class at several refraction coefficients, the stored class at the standard one."""
    s = view(spark, sf_dir, "sources")
    stored = rules.visibility_class(F.col("source_id") % 41 / 40, F.col("kc"), F.lit(0.13))
    both = s.select("kc", stored.alias("stored"), F.explode(F.array(*[F.lit(k) for k in (0.0, 0.13, 0.25, 0.5, 1.0)])).alias("k"))
    return both.groupBy("k", rules.class_at(F.col("k"), F.col("kc"), F.col("stored")).alias("cls")).agg(F.count("*").alias("n"))


def flux_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes without a floor: no flux has none."""
    s = view(spark, sf_dir, "sources")
    flux = F.when(F.col("source_id") % 6 == 0, 0.0).otherwise(F.col("kc") / F.pow(F.col("km") * 1000, F.lit(2.0)))
    return s.select("source_id", F.when(flux > 0, F.round(-13.99 - 2.5 * F.log10(F.when(flux > 0, flux)), 6)).alias("m"))


def scenario_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of scenarios drives a whole run: apparent elevations shift with k, boxes grow with the error, cells are counted."""
    from ..operators import grids

    runs = spark.createDataFrame([("standard", 0.13, 0.3, 0.1), ("strong", 0.5, 0.3, 0.1), ("loose", 0.13, 1.2, 0.3)], "name string, k double, err_az double, err_el double")
    s = view(spark, sf_dir, "sources").crossJoin(F.broadcast(runs))
    el = F.col("el") + F.degrees((F.col("k") - 0.13) * F.col("km") * 1000 / (2 * 6371000.0))
    cells = grids.stamp_boxes(s, F.col("az"), F.round(el, 6), F.col("err_az"), F.col("err_el"))
    return cells.groupBy("name", "ia", "ie").agg(F.max("kc").alias("top")).groupBy("name").agg(F.count("*").alias("cells"), F.round(F.sum("top"), 4).alias("total"))


def _hav(lon1, lat1, lon2, lat2) -> str:
    return f"2 * {geo.R_SPHERE}::DOUBLE * asin(sqrt(sin((radians({lat2}) - radians({lat1})) / 2) * sin((radians({lat2}) - radians({lat1})) / 2) + cos(radians({lat1})) * cos(radians({lat2})) * sin((radians({lon2}) - radians({lon1})) / 2) * sin((radians({lon2}) - radians({lon1})) / 2)))"


_V = (f"{LON0}::DOUBLE", f"{LAT0}::DOUBLE")
_FAN_STATS = "WITH l AS (SELECT line_id, round(az, 6) AS az, round(km, 6) AS km FROM v_lines), f AS (SELECT *, az BETWEEN 157276e-3 AND 277276e-3 AS fan FROM l), s AS (SELECT line_id, min(km) AS nearest, bool_or(fan) AS in_fan, min(az) FILTER (fan) AS fan_az_min, max(az) FILTER (fan) AS fan_az_max, min(km) FILTER (fan) AS fan_km_min, max(km) FILTER (fan) AS fan_km_max, min(az) FILTER (fan AND km < 20) AS front_az_min, max(az) FILTER (fan AND km < 20) AS front_az_max, min(km) FILTER (fan AND km < 20) AS front_km_min, max(km) FILTER (fan AND km < 20) AS front_km_max FROM f GROUP BY line_id)"
QUERIES = {
    f.__name__: f
    for f in (
        bbox_then_radius, attribute_in_lists, band_below_skyline, stride_sample, footprint_reject, error_by_source, returns_filtered, privacy_rule, global_nearest, nearest_lamp, route_labels, line_fan_stats, fan_text, merged_lines,
        catalogue_counters, identified, catalogue_facets, brightest_sample, top_lights, calibration_targets, alternative_minima, verdict_ranking, first_night_period, log_newest_first, moon_and_brightness, forecast_classes, search_widths, sky_states, facing_direction,
        observer_height, tile_catalogue, tile_footprints, road_points, vetted_lights, named_route, fan_edges, class_colours, classes_at_k, flux_magnitudes, scenario_runs,
    )
}
_PLACES = f"p AS (SELECT *, (c_custkey % 401 - 200) * 1e-2 + {LON0}::DOUBLE AS lon, (c_custkey % 307 - 150) * 1e-2 + {LAT0}::DOUBLE AS lat FROM customer)"
ORACLES = {
    "bbox_then_radius": f"WITH {_PLACES}, d AS (SELECT c_custkey, round({_hav(*_V, 'lon', 'lat')}, 2) AS m FROM p WHERE abs(lon - {_V[0]}) <= 1 AND abs(lat - {_V[1]}) <= 1) SELECT * FROM d WHERE m <= 80000",
    "attribute_in_lists": "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand IN ('Brand#1', 'Brand#7', 'Brand#12') AND (p_name LIKE 'red%' OR p_size IN (1, 2, 3, 5, 8, 13))",
    "band_below_skyline": "WITH s AS (SELECT i, sin(i * 5e-2) + 5e-1 AS sky FROM range(300) r(i)) SELECT line_id, count(*) AS n, round(max(el), 6) AS top FROM v_lines JOIN s ON i = floor((az - 150) * 2) WHERE el <= sky AND el >= sky - 1 GROUP BY line_id",
    "stride_sample": "SELECT line_id, seq, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY seq) AS n FROM v_lines) WHERE n % 3 = 1",
    "footprint_reject": f"WITH {_TILES_SQL} SELECT name, count(*) AS targets, min(target_id) AS first FROM v_targets JOIN tiles ON lon >= west AND lon < east AND lat >= south AND lat < north GROUP BY name",
    "error_by_source": f"WITH {_TILES_SQL}, k(rank, part, sigma, corr) AS (VALUES (0, '1M', 56e-3, 20e0), (1, 'USGS_13', 56e-2, 70e0), (2, 'USGS_1_', 205e-2, 125e0)) SELECT name, arg_min(sigma, rank) AS sigma, arg_min(corr, rank) AS corr FROM tiles JOIN k ON contains(name, part) GROUP BY name",
    "returns_filtered": "SELECT l_linenumber AS cls, count(*) AS n FROM lineitem WHERE l_linenumber NOT IN (7, 18) AND l_linestatus <> 'O' AND l_quantity >= 4 AND l_extendedprice / 1000 > 5 AND l_tax * 100 + 1 <= 4 GROUP BY 1",
    "privacy_rule": "WITH k AS (SELECT s_suppkey * 3 AS k FROM supplier), c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'small_airport' WHEN 2 THEN 'heliport' ELSE 'balloonport' END AS type, contains(c_mktsegment, 'MACH') AS old, c_custkey % 90 IN (SELECT k FROM k) OR c_custkey % 77 IN (SELECT k FROM k) AS listed FROM customer) SELECT c_custkey, CASE WHEN type = 'closed' AND old THEN 'historic' WHEN type = 'balloonport' THEN 'balloon' WHEN type = 'heliport' THEN 'heliport' ELSE 'airfield' END AS kind FROM c WHERE (type = 'closed' AND old) OR type = 'balloonport' OR (type <> 'closed' AND listed)",
    "global_nearest": f"WITH e(place, plon, plat) AS (VALUES ('junction', -104e0, 3015e-2), ('south end', -1041e-1, 3008e-2)), d AS (SELECT place, target_id, round({_hav('plon', 'plat', 'lon', 'lat')}, 2) AS m FROM v_targets, e) SELECT place, target_id, m FROM d QUALIFY row_number() OVER (PARTITION BY place ORDER BY m, target_id) = 1",
    "nearest_lamp": "SELECT source_id, lamp FROM v_sources, (VALUES (56e-2), (66e-2), (86e-2), (112e-2), (137e-2), (25e-1), (4e0)) l(lamp) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY round(abs(lamp - km / 20), 9), lamp) = 1",
    "route_labels": "SELECT route, target_id // 40 AS piece, count(*) AS points, CASE split_part(route, '-', 1) WHEN 'US' THEN 'US highway' WHEN 'FM' THEN 'Farm to Market Road' ELSE split_part(route, '-', 1) END AS label FROM v_targets GROUP BY route, piece HAVING count(*) >= 5",
    "line_fan_stats": f"{_FAN_STATS} SELECT * FROM s",
    "fan_text": f"{_FAN_STATS} SELECT line_id, CASE WHEN NOT in_fan THEN printf('Outside (nearest km %.1f)', nearest) ELSE printf('In fan: az %.1f-%.1f, km %.1f-%.1f', fan_az_min, fan_az_max, fan_km_min, fan_km_max) || CASE WHEN front_km_min IS NULL THEN '' ELSE printf('; in front at km %.1f-%.1f', front_km_min, front_km_max) END END AS text FROM s",
    "merged_lines": "WITH l AS (SELECT *, ['UP', 'TXPF', 'BNSF'][line_id % 3 + 1] AS owner, CASE WHEN line_id % 4 = 0 THEN NULL ELSE line_id % 2 END AS sub, CASE WHEN line_id % 5 = 0 THEN 'siding/yard' ELSE 'main' END AS kind FROM v_lines) SELECT CASE owner WHEN 'UP' THEN 'Union Pacific (Sunset Route)' WHEN 'TXPF' THEN 'Texas Pacifico (ex-South Orient)' ELSE owner END || ' - ' || coalesce(sub::VARCHAR, '(siding/yard)') || ', ' || kind AS label, count(DISTINCT line_id) AS parts, count(*) AS vertices, round(arg_max(az, line_id * 1000000 + seq), 6) AS last_az FROM l GROUP BY owner, sub, kind",
    "catalogue_counters": "SELECT count(*) AS \"all\", count(*) FILTER (length(text) > 200) AS long, count(*) FILTER (role = 'user') AS by_user, count(*) FILTER (regexp_matches(lower(text), '^(the|der|le|el) ')) AS article FROM conversations",
    "identified": f"WITH {_PLACES}, n AS (SELECT c_custkey, round(((degrees(atan2(sin(radians(lon) - radians({_V[0]})) * cos(radians(lat)), cos(radians({_V[1]})) * sin(radians(lat)) - sin(radians({_V[1]})) * cos(radians(lat)) * cos(radians(lon) - radians({_V[0]})))) % 360) + 360) % 360, 6) AS az, round({_hav(*_V, 'lon', 'lat')} / 1000, 6) AS km FROM p), l AS (SELECT kind AS layer, source_id AS id, az, round(km, 6) AS km, kc FROM v_sources UNION ALL SELECT 'line', line_id * 1000000 + seq, az, round(km, 6), NULL FROM v_lines WHERE rate > 0 UNION ALL SELECT 'place', c_custkey, az, km, NULL FROM n WHERE km < 60), o AS (SELECT n_nationkey, n_nationkey * 6 + 15025e-2 AS b, CASE WHEN n_nationkey % 2 = 0 THEN 1e0 ELSE 3e0 END AS tol FROM nation), m AS (SELECT * FROM l, o WHERE abs(((az - b + 540) % 360 + 360) % 360 - 180) <= tol) SELECT n_nationkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY km, layer, id)::INT AS rank, layer, id, km, round(kc, 6) AS kc FROM m QUALIFY rank <= 5",
    "catalogue_facets": "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(concat_ws(' ', conv_id, turn, role, text)), 'the ')",
    "brightest_sample": "WITH s AS (SELECT nation, source_id, round(-1399e-2 - 25e-1 * log10(greatest(80e0 / pow(km * 1000, 2e0), 1e-30)), 6) AS m FROM v_sources) SELECT nation, m, source_id FROM s QUALIFY row_number() OVER (PARTITION BY nation ORDER BY m, source_id) = 1",
    "top_lights": "SELECT p_partkey, round(p_retailprice * sqrt(least(p_size * 20, 400)), 4) AS weight FROM part ORDER BY weight DESC, p_partkey LIMIT 40",
    "calibration_targets": "SELECT source_id, round(degrees(acos(least(greatest(sin(radians(el)) * sin(radians(4e-1)) + cos(radians(el)) * cos(radians(4e-1)) * cos(radians(az) - radians(215e0)), -1e0), 1e0))), 6) AS apart FROM v_sources ORDER BY apart, source_id LIMIT 12",
    "alternative_minima": "WITH a AS (SELECT user_id, chain, v, min(v) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b, min(v) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS f FROM v_series), m AS (SELECT user_id, chain, v FROM a WHERE v < b AND v < f), t AS (SELECT *, first_value(chain) OVER (PARTITION BY user_id ORDER BY v, chain) AS c0 FROM m) SELECT user_id, chain, v, row_number() OVER (PARTITION BY user_id ORDER BY v, chain)::INT AS rank FROM t WHERE abs(chain - c0) > 400 QUALIFY rank <= 3",
    "verdict_ranking": "WITH o AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 9 END AS place FROM orders) SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY place, o_orderkey)::INT AS rank FROM o QUALIFY rank <= 2",
    "first_night_period": "SELECT user_id, event_id, hour(ts) BETWEEN 7 AND 19 AS day FROM v_series QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY hour(ts) BETWEEN 7 AND 19, seq) = 1",
    "log_newest_first": "WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS i FROM v_series) SELECT user_id, (CASE WHEN i > 2 THEN i - 1 ELSE i END)::INT AS place, event_id FROM a WHERE i <> 2 AND i <= 4",
    "moon_and_brightness": "WITH s AS (SELECT source_id * 37 % 360 AS a, km / 8 - 2 AS m FROM v_sources) SELECT CASE WHEN a < 225e-1 OR a >= 3375e-1 THEN 'New moon' WHEN a < 675e-1 THEN 'Waxing crescent' WHEN a < 1125e-1 THEN 'First quarter' WHEN a < 1575e-1 THEN 'Waxing gibbous' WHEN a < 2025e-1 THEN 'Full moon' WHEN a < 2475e-1 THEN 'Waning gibbous' WHEN a < 2925e-1 THEN 'Last quarter' ELSE 'Waning crescent' END AS phase, CASE WHEN m <= -1 THEN 'as bright as the brightest stars' WHEN m <= 15e-1 THEN 'like a bright star' WHEN m <= 4 THEN 'like a modest star' WHEN m <= 6 THEN 'faint, near the naked-eye limit' ELSE 'too faint to see' END AS words, count(*) AS n FROM s GROUP BY 1, 2",
    "forecast_classes": "WITH a AS (SELECT km / 5 AS t2, km / 5 + el * 4 AS t80 FROM v_sources), k AS (SELECT round(503e0 * 850 / (((t2 + t80) / 2 + 27315e-2) * ((t2 + t80) / 2 + 27315e-2)) * (343e-4 + (t80 - t2) / 78), 9) AS k FROM a) SELECT CASE WHEN k < 13e-2 THEN 'normal' WHEN k < 5e-1 THEN 'mild' WHEN k < 1 THEN 'strong' ELSE 'duct' END AS cls, count(*) AS n, round(max(k), 6) AS highest FROM k GROUP BY 1",
    "search_widths": "WITH a AS (SELECT ['photo', 'skyfinder', 'landmark', 'compass', 'guess'][event_id % 5 + 1] AS how FROM v_series) SELECT how, CASE WHEN how IN ('photo', 'skyfinder') THEN 1 WHEN how = 'landmark' THEN 2 WHEN how = 'compass' THEN 3 ELSE 6 END AS degrees, count(*) AS n FROM a GROUP BY how",
    "sky_states": "WITH t AS (SELECT event_id % 365 AS day, event_id % 144 AS slot FROM v_series), s AS (SELECT round(50 * sin(radians(slot * 25e-1 - 90)) + 10 * sin(radians(day * 1e0)), 9) AS sun, round(40 * sin(radians(slot * 24e-1 + day * 122e-1)), 9) AS moon, round(5e-1 + 5e-1 * cos(radians(day * 1219e-2)), 9) AS lit FROM t) SELECT CASE WHEN sun > -6 THEN 'civil' WHEN sun > -18 THEN 'twilight' WHEN moon > 0 AND lit > 12e-2 THEN 'moon' ELSE 'dark' END AS state, count(*) * 10 AS minutes FROM s GROUP BY 1",
    "facing_direction": "WITH t AS (SELECT target_id, d AS dir, ((((target_id * 7 % 360) - (target_id % 360) + 180 * d + 540) % 360 + 360) % 360 - 180)::DOUBLE AS h FROM v_targets, range(2) r(d)) SELECT target_id, min(dir) FILTER (abs(h) < 90)::INT AS dir, arg_min(h, dir) FILTER (abs(h) < 90) AS h FROM t GROUP BY target_id",
    "observer_height": "SELECT source_id, round(km * 10 - (SELECT max(z) FROM v_raster WHERE r = 12 AND c = 1) - 16e-1, 6) AS over_eye FROM v_sources",
    "tile_catalogue": "WITH n AS (SELECT (n_nationkey % 5 + 100)::VARCHAR AS x, (n_nationkey // 5 + 30)::VARCHAR AS y FROM nation), f AS (SELECT '1m' AS product, 'USGS_1m_x' || x || 'y' || y || '.tif' AS file, 'm' AS unit FROM n UNION ALL SELECT '13', 'USGS_13_n' || y || 'w' || x || '.tif', 'ft' FROM n) SELECT file, 'elevation/' || product || '/TIFF/' || file AS path, unit FROM f",
    "tile_footprints": "SELECT r // 16 AS tr, c // 16 AS tc, min(r) AS south, max(r) + 1 AS north, min(c) AS west, max(c) + 1 AS east, count(z) AS cells FROM v_raster GROUP BY 1, 2",
    "road_points": "WITH p AS (SELECT CASE WHEN kind IN ('tower', 'town') THEN 'road ' || nation % 3 ELSE nation % 2 || ' rail' END AS name, round(degrees(atan(el * 10 / 1000)), 7) AS el, km, CASE WHEN kind IN ('tower', 'town') THEN CASE WHEN kc <= 25e-2 THEN 'm' ELSE 'h' END WHEN kc <= 13e-2 THEN 'v' ELSE 'h' END AS cls FROM v_sources) SELECT name, cls, count(*) AS n, round(avg(el), 6) AS el, round(min(km), 6) AS km FROM p GROUP BY name, cls",
    "vetted_lights": "SELECT l_orderkey // 4 AS spot, count(*) AS pixels, round(max(l_extendedprice + 1000) / quantile_cont(l_extendedprice + 1000, 0.5), 6) >= 12e-1 AS accepted FROM lineitem GROUP BY 1",
    "named_route": "SELECT count(*) AS points, min(chain) AS first, max(chain) AS last FROM v_targets WHERE route = 'US-67'",
    "fan_edges": f"WITH d AS (SELECT i, az, radians(az) AS a, i * 10000e0 / {geo.R_SPHERE}::DOUBLE AS d, radians({_V[1]}) AS p, radians({_V[0]}) AS l FROM range(9) r(i), (VALUES (157276e-3), (277276e-3)) e(az)), q AS (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(a)) AS q FROM d) SELECT az, i * 10 AS km, round(degrees(l + atan2(sin(a) * sin(d) * cos(p), cos(d) - sin(p) * sin(q))), 7) AS lon, round(degrees(q), 7) AS lat FROM q",
    "class_colours": "WITH c AS (SELECT CASE WHEN source_id % 41 / 40e0 <= 5e-2 THEN 'h' WHEN source_id % 41 / 40e0 >= 95e-2 AND kc <= 13e-2 THEN 'v' ELSE 'm' END AS c FROM v_sources) SELECT CASE c WHEN 'v' THEN 'vis' WHEN 'm' THEN 'marg' ELSE 'hid' END AS cls, count(*) AS n, CASE c WHEN 'v' THEN 'ff9fab12' ELSE 'ffeeffc0' END AS colour FROM c GROUP BY c",
    "classes_at_k": "WITH c AS (SELECT kc, CASE WHEN source_id % 41 / 40e0 <= 5e-2 THEN 'h' WHEN source_id % 41 / 40e0 >= 95e-2 AND kc <= 13e-2 THEN 'v' ELSE 'm' END AS stored FROM v_sources) SELECT k, CASE WHEN k = 13e-2 THEN stored WHEN kc <= k THEN 'v' ELSE 'h' END AS cls, count(*) AS n FROM c, (VALUES (0e0), (13e-2), (25e-2), (5e-1), (1e0)) t(k) GROUP BY 1, 2",
    "flux_magnitudes": "WITH f AS (SELECT source_id, CASE WHEN source_id % 6 = 0 THEN 0e0 ELSE kc / pow(km * 1000, 2e0) END AS f FROM v_sources) SELECT source_id, CASE WHEN f > 0 THEN round(-1399e-2 - 25e-1 * log10(CASE WHEN f > 0 THEN f END), 6) END AS m FROM f",
    "scenario_runs": "WITH r(name, k, ea, ee) AS (VALUES ('standard', 13e-2, 3e-1, 1e-1), ('strong', 5e-1, 3e-1, 1e-1), ('loose', 13e-2, 12e-1, 3e-1)), s AS (SELECT name, az, ea, ee, kc, round(el + degrees((k - 13e-2) * km * 1000 / (2 * 6371000e0)), 6) AS el FROM v_sources, r), b AS (SELECT name, kc, greatest(ceil(round((az - ea - 150) / 5e-1, 6)), 0)::INT AS a0, least(floor(round((az + ea - 150) / 5e-1, 6)), 299)::INT AS a1, greatest(ceil(round((el - ee + 2) / 25e-2, 6)), 0)::INT AS e0, least(floor(round((el + ee + 2) / 25e-2, 6)), 23)::INT AS e1 FROM s), c AS (SELECT name, kc, ia, ie FROM b, range(300) x(ia), range(24) y(ie) WHERE ia BETWEEN a0 AND a1 AND ie BETWEEN e0 AND e1), m AS (SELECT name, ia, ie, max(kc) AS top FROM c GROUP BY 1, 2, 3) SELECT name, count(*) AS cells, round(sum(top), 4) AS total FROM m GROUP BY name",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
