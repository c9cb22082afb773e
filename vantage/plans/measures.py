"""Queries of measures on directions, lamps, pixels and records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, physics
from ..kernels import fit
from ..operators import rules
from .views import LAT0, LON0, table, view, with_views


def plane_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane offsets of targets: equidistant about the viewer, equirectangular in km, and a small height as an angle."""
    t = view(spark, sf_dir, "targets")
    x, y = geo.local_offsets_km(F.col("lon"), F.col("lat"), LON0, LAT0)
    d, az = geo.local_plane(F.lit(LON0), F.lit(LAT0), F.col("lon"), F.col("lat"))
    u, v = geo.azimuthal_equidistant(az, d)
    return t.select("target_id", F.round(x, 6).alias("east_km"), F.round(y, 6).alias("north_km"), F.round(u, 2).alias("u"), F.round(v, 2).alias("v"), F.round(geo.mrad_to_deg(F.col("target_id") % 50 - 25.0), 8).alias("deg"), geo.norm360(F.col("target_id") % 720 - 6.5).alias("magnetic"))


def car_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles of the viewer from a car's lamps in both travel directions, grades held to 8 percent."""
    t = view(spark, sf_dir, "targets").select("target_id", (F.col("target_id") * 3 % 360).cast("double").alias("heading"), (F.col("target_id") * 7 % 360).cast("double").alias("az"), ((F.col("target_id") % 41 - 20) * 0.1).alias("el"), ((F.col("target_id") % 61 - 30) * 0.004).alias("slope"))
    grade = F.greatest(F.least(F.col("slope"), F.lit(0.08)), F.lit(-0.08))
    both = t.withColumn("dir", F.explode(F.array(F.lit(1), F.lit(-1))))
    h, v = physics.view_angles(F.col("az"), F.col("heading") + F.when(F.col("dir") < 0, 180.0).otherwise(0.0), F.col("el"), grade * F.col("dir"), F.lit(-0.57))
    return both.select("target_id", "dir", F.round(h, 6).alias("h"), F.round(v, 6).alias("v"))


def detection_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that a car's lamps are seen: high or low beams ahead, tail lamps behind."""
    s = view(spark, sf_dir, "sources")
    p = physics.detection_probability(geo.wrap(F.col("az") * 3), F.lit(0.3), F.col("km") / 20, F.col("km") / 12, F.col("km") / 9, F.lit(4.0))
    return s.select("source_id", F.round(p, 6).alias("p"))


def beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beacon's brightness through its period, the size of its marker, and the error of an alignment."""
    s = view(spark, sf_dir, "series")
    sigma = physics.alignment_sigma(F.col("v") / 50, F.lit(0.02), F.col("seq") % 5, F.col("seq") % 2 == 0)
    return s.select("event_id", F.round(physics.duty_cycle(F.col("chain") / 7, 12.0, 1.5, 3.0), 6).alias("on"), F.round(physics.marker_size(F.col("v") / 20), 6).alias("size"), F.round(sigma, 6).alias("sigma"))


def light_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted centre of each spot's pixels and whether it is a streak: the larger second moment over nine times the smaller."""
    p = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 10).alias("spot"), F.col("l_quantity").alias("x"), (F.col("l_linenumber") * 3.0).alias("y"), (F.col("l_tax") * 100 + 1).alias("w"))
    m = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    x, y = F.col("x"), F.col("y")
    g = p.groupBy("spot").agg(m(x).alias("cx"), m(y).alias("cy"), m(x * x).alias("xx"), m(y * y).alias("yy"), m(x * y).alias("xy"), F.count("*").alias("pixels"))
    a, b, c = F.col("xx") - F.col("cx") * F.col("cx"), F.col("yy") - F.col("cy") * F.col("cy"), F.col("xy") - F.col("cx") * F.col("cy")
    root = F.sqrt(F.greatest((a - b) * (a - b) / 4 + c * c, F.lit(0.0)))
    return g.select("spot", "pixels", F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"), (F.round((a + b) / 2 + root, 4) > F.round(9 * ((a + b) / 2 - root), 4)).alias("streak"))


def direction_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean direction of each device's last 20 orientations and their scatter, by unit vectors."""
    w = Window.partitionBy("user_id").orderBy("seq").rowsBetween(-19, 0)
    s = view(spark, sf_dir, "series").withColumn("a", F.radians(F.col("v") * 3))
    e, n = F.avg(F.sin("a")).over(w), F.avg(F.cos("a")).over(w)
    s = s.withColumns({"e": e, "n": n})
    length = F.sqrt(F.col("e") * F.col("e") + F.col("n") * F.col("n"))
    return s.select("event_id", F.round(geo.norm360(F.degrees(F.atan2("e", "n"))), 4).alias("mean"), F.round(F.degrees(F.sqrt(F.greatest(-2 * F.log(F.least(length, F.lit(1.0))), F.lit(0.0)))), 3).alias("scatter"))


def light_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on lights in pictures by the first rule that holds."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    k = F.col("k")
    v = rules.light_verdict(k % 11 != 0, k % 13 == 0, k % 17 == 0, F.col("s") / 12, k % 7 * 0.3, F.lit(1.5), k % 5 * 0.4, k % 3 == 0)
    return p.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


def labelled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected regions of four cells or more in each picture (neighbours by edges): number, cells, largest."""
    n = table(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("image"))
    p = n.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("on", (F.col("r") * 7 + F.col("c") * 5 + F.col("r") * F.col("c") + F.col("image")) % 5 < 2)

    def label(f: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((12, 12), bool)
        grid[f["r"], f["c"]] = f["on"]
        sizes = np.bincount(fit.label_components(grid)[grid]) if grid.any() else np.zeros(1, int)
        sizes = sizes[sizes >= 4]
        return pd.DataFrame({"image": [int(f["image"].iloc[0])], "regions": [len(sizes)], "cells": [int(sizes.sum())], "largest": [int(sizes.max()) if len(sizes) else 0]})

    return p.groupBy("image").applyInPandas(label, "image long, regions long, cells long, largest long")


def homography_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of one camera taken to another camera at the same place."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 0.4 - 4).alias("az"), (F.col("n_nationkey") % 7 * 0.3).alias("el"))
    u, v = geo.pinhole(F.col("az"), F.col("el"), F.lit(0.0), F.lit(0.5), F.lit(2.0), F.lit(1500.0))
    h = fit.homography((0.0, 0.5, 2.0, 1500.0), (2.0, 0.2, -1.0, 1200.0))
    row = lambda i: float(h[i][0]) * F.col("u") + float(h[i][1]) * F.col("v") + float(h[i][2])
    return n.withColumns({"u": u, "v": v}).select("n_nationkey", F.round(row(0) / row(2), 4).alias("u2"), F.round(row(1) / row(2), 4).alias("v2"))


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional fields of JSON records by type of event: a missing or wrong one is null, never an error."""
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "k INT, nested STRUCT<y: STRING>")
    return e.groupBy("event_type").agg(F.sum(k["k"]).alias("total"), F.max(k["k"]).alias("most"), F.count(k["nested"]["y"]).alias("with_nested"), F.count("*").alias("n"))


def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each kind's sources whose k is at most that of each source: running totals, equal k together."""
    s = view(spark, sf_dir, "sources").groupBy("kind", F.round("kc", 6).alias("kc")).agg(F.count("*").alias("n"))
    return s.select("kind", "kc", F.round(F.sum("n").over(Window.partitionBy("kind").orderBy("kc")) * 0.06, 6).alias("km"))


QUERIES = {
    f.__name__: f
    for f in (plane_offsets, car_views, detection_chances, beacons, light_moments, direction_scatter, light_verdicts, labelled_regions, homography_points, json_fields, length_distribution)
}
_E2 = f"{geo.E2!r}::DOUBLE"


def _pinhole_sql(az0: str, el0: str, roll: str, focal: str) -> str:
    d, e, f, r = f"radians(az - ({az0}))", "radians(el)", f"radians({el0})", f"radians({roll})"
    z = f"(sin({e}) * sin({f}) + cos({e}) * cos({f}) * cos({d}))"
    x, y = f"({focal} * cos({e}) * sin({d}) / {z})", f"(-{focal} * (sin({e}) * cos({f}) - cos({e}) * sin({f}) * cos({d})) / {z})"
    return f"round({x} * cos({r}) - {y} * sin({r}), 4) AS u2, round({x} * sin({r}) + {y} * cos({r}), 4) AS v2"


ORACLES = {
    "plane_offsets": f"WITH t AS (SELECT target_id, lon, lat, radians((lat + {LAT0}::DOUBLE) / 2) AS lm FROM v_targets), m AS (SELECT *, radians(lat - {LAT0}::DOUBLE) * {geo.A}::DOUBLE * (1 - {_E2}) / pow(1 - {_E2} * sin(lm) * sin(lm), 15e-1) AS dn, radians(lon - ({LON0}::DOUBLE)) * {geo.A}::DOUBLE / sqrt(1 - {_E2} * sin(lm) * sin(lm)) * cos(lm) AS de FROM t), a AS (SELECT *, atan2(de, dn) - radians((lon - ({LON0}::DOUBLE)) * sin(lm) / 2) AS az, sqrt(dn * dn + de * de) AS d FROM m) SELECT target_id, round((lon - ({LON0}::DOUBLE)) * 111.32::DOUBLE * cos(radians({LAT0}::DOUBLE)), 6) AS east_km, round((lat - {LAT0}::DOUBLE) * 110.57::DOUBLE, 6) AS north_km, round(d * sin(az), 2) AS u, round(d * cos(az), 2) AS v, round(degrees(atan((target_id % 50 - 25e0) / 1000)), 8) AS deg, ((target_id % 720 - 65e-1) % 360 + 360) % 360 AS magnetic FROM a",
    "car_views": "WITH t AS (SELECT target_id, target_id * 3 % 360 AS heading, target_id * 7 % 360 AS az, (target_id % 41 - 20) * 1e-1 AS el, greatest(least((target_id % 61 - 30) * 4e-3, 8e-2), -8e-2) AS g FROM v_targets) SELECT target_id, dir::INT AS dir, round(((az - heading - CASE WHEN dir < 0 THEN 180 ELSE 0 END + 540) % 360 + 360) % 360 - 180e0, 6) AS h, round(el - degrees(atan(g * dir)) + 57e-2, 6) AS v FROM t, (VALUES (1), (-1)) d(dir)",
    "detection_chances": "WITH s AS (SELECT source_id, km, abs(((az * 3 + 540) % 360 + 360) % 360 - 180) AS h FROM v_sources) SELECT source_id, round(CASE WHEN h >= 90 THEN CASE WHEN km / 9 <= 4 THEN 1e0 ELSE 0e0 END ELSE 3e-1 * CASE WHEN km / 20 <= 4 THEN 1 ELSE 0 END + (1 - 3e-1) * CASE WHEN km / 12 <= 4 THEN 1 ELSE 0 END END, 6) AS p FROM s",
    "beacons": "WITH s AS (SELECT event_id, seq, v, (chain / 7) % 12 AS x FROM v_series) SELECT event_id, round(greatest(0, least(1, x / 15e-1, (6 - x) / 15e-1)), 6) AS \"on\", round(pow(greatest(65e-1 - v / 20, 0), 18e-1) * 22e-1, 6) AS size, round(greatest(2e-2, v / 50 * 2e-2 * CASE WHEN seq % 5 >= 3 THEN 15e-1 ELSE 2e0 END) * CASE WHEN seq % 2 = 0 THEN 1e0 ELSE 15e-1 END, 6) AS sigma FROM s",
    "light_moments": "WITH p AS (SELECT l_orderkey // 10 AS spot, l_quantity AS x, l_linenumber * 3e0 AS y, l_tax * 100 + 1 AS w FROM lineitem), g AS (SELECT spot, count(*) AS pixels, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, sum(w * x * x) / sum(w) AS xx, sum(w * y * y) / sum(w) AS yy, sum(w * x * y) / sum(w) AS xy FROM p GROUP BY spot), m AS (SELECT *, xx - cx * cx AS a, yy - cy * cy AS b, xy - cx * cy AS c FROM g), r AS (SELECT *, sqrt(greatest((a - b) * (a - b) / 4 + c * c, 0)) AS q FROM m) SELECT spot, pixels, round(cx, 5) AS cx, round(cy, 5) AS cy, round((a + b) / 2 + q, 4) > round(9 * ((a + b) / 2 - q), 4) AS streak FROM r",
    "direction_scatter": "WITH s AS (SELECT event_id, avg(sin(radians(v * 3))) OVER w AS e, avg(cos(radians(v * 3))) OVER w AS n FROM v_series WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT event_id, round((degrees(atan2(e, n)) % 360 + 360) % 360, 4) AS mean, round(degrees(sqrt(greatest(-2 * ln(least(sqrt(e * e + n * n), 1)), 0))), 3) AS scatter FROM s",
    "light_verdicts": "SELECT CASE WHEN p_partkey % 11 = 0 THEN 'unaligned' WHEN p_partkey % 13 = 0 THEN 'star' WHEN p_partkey % 17 = 0 THEN 'far-off-source' WHEN p_size / 12e0 > 3 THEN 'uncertain' WHEN p_partkey % 7 * 3e-1 > 15e-1 THEN 'above-skyline' WHEN p_partkey % 5 * 4e-1 >= 1 THEN 'explained-traffic' WHEN p_partkey % 5 > 0 THEN 'possible-traffic' WHEN p_partkey % 3 = 0 THEN 'hidden-road' ELSE 'unexplained' END AS verdict, count(*) AS n FROM part GROUP BY 1",
    "labelled_regions": "WITH RECURSIVE p AS (SELECT image, r, c, r * 12 + c AS id FROM range(10) i(image), range(12) a(r), range(12) b(c) WHERE (r * 7 + c * 5 + r * c + image) % 5 < 2), e AS (SELECT x.image, x.id AS a, y.id AS b FROM p x JOIN p y ON x.image = y.image AND abs(x.r - y.r) + abs(x.c - y.c) = 1), w AS (SELECT image, id, id AS root FROM p UNION SELECT w.image, e.b, w.root FROM w JOIN e ON e.image = w.image AND e.a = w.id), l AS (SELECT image, id, min(root) AS root FROM w GROUP BY 1, 2), s AS (SELECT image, root, count(*) AS n FROM l GROUP BY 1, 2) SELECT image, count(*) FILTER (n >= 4) AS regions, coalesce(sum(n) FILTER (n >= 4), 0)::BIGINT AS cells, coalesce(max(n) FILTER (n >= 4), 0) AS largest FROM s GROUP BY image",
    "homography_points": f"WITH n AS (SELECT n_nationkey, n_nationkey * 4e-1 - 4 AS az, n_nationkey % 7 * 3e-1 AS el FROM nation) SELECT n_nationkey, {_pinhole_sql('2e0', '2e-1', '-1e0', '1200e0')} FROM n",
    "json_fields": "SELECT event_type, sum(TRY_CAST(props::JSON->>'k' AS INT))::BIGINT AS total, max(TRY_CAST(props::JSON->>'k' AS INT)) AS most, count(props::JSON->'nested'->>'y') AS with_nested, count(*) AS n FROM events GROUP BY 1",
    "length_distribution": "WITH s AS (SELECT kind, round(kc, 6) AS kc, count(*) AS n FROM v_sources GROUP BY 1, 2) SELECT kind, kc, round(sum(n) OVER (PARTITION BY kind ORDER BY kc) * 6e-2, 6) AS km FROM s",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
