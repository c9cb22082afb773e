import math

import pytest
from pyspark.sql import functions as F

from vantage.functions import geo, physics
from vantage.operators import joins, rules, windows
from vantage.sources import readers, writers


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_physics_identities(spark):
    lit = F.lit
    r = one(
        spark,
        k=physics.k_from_gradient(lit(-0.0098), lit(85000.0), lit(290.0)),
        m=physics.magnitude(lit(1e-6)),
        t=physics.transmission(lit(68000.0), lit(68.0)),
        limits=F.array(*[physics.magnitude_limit(lit(21.4), lit(f)) for f in (2.4, 5.77)]),
        tail=physics.rear_intensity(lit(180.0)),
        brake=physics.rear_intensity(lit(180.0), braking=True, bound="most"),
        front=physics.rear_intensity(lit(30.0)),
        half=physics.lamp_candela({"tail": 1}, lit(15.0)),
        euler=geo.normal_section_radius(lit(30.0), lit(45.0)),
        far=physics.magnitude(lit(0.0)),
    )
    assert r.k == pytest.approx(0.14, abs=0.02) and r.m == pytest.approx(1.01) and r.t == pytest.approx(0.05)
    assert r.tail == 4.0 and r.brake == 796.0 and r.front == 0.0 and r.half == pytest.approx(math.sqrt(0.8 * 0.3))
    assert 6.33e6 < r.euler < 6.40e6 and r.far == pytest.approx(61.01)


def test_geodesy_expressions(spark):
    lit = F.lit
    x, y, z = geo.ecef(lit(0.0), lit(0.0), lit(10.0))
    lon, lat = geo.spherical_direct(lit(10.0), lit(20.0), lit(77.0), lit(50000.0))
    ulon, ulat = geo.utm_inverse(lit(500000.0), lit(3320113.397))
    u, v = geo.pinhole(lit(205.0), lit(2.0), lit(200.0), lit(1.0), lit(3.0), lit(1500.0))
    az, el = geo.unproject(u, v, lit(200.0), lit(1.0), lit(3.0), lit(1500.0))
    r = one(spark, x=x, y=y, z=z, back=geo.haversine(lit(10.0), lit(20.0), lon, lat), az=geo.bearing(lit(10.0), lit(20.0), lon, lat), ulon=ulon, ulat=ulat, paz=az, pel=el, w=geo.wrap(lit(359.0) - lit(1.0)), p=geo.compass_name(lit(348.76)))
    assert (r.x, r.y, r.z) == (6378147.0, 0.0, 0.0) and r.back == pytest.approx(50000) and r.az == pytest.approx(77)
    assert r.ulon == pytest.approx(-105) and r.ulat == pytest.approx(30.0103, abs=2e-3) and r.paz == pytest.approx(205) and r.pel == pytest.approx(2)
    assert r.w == -2 and r.p == "N"


def test_islands_and_shared_vertices(spark):
    rows = [(1, i, float(c), v, t) for i, (c, v, t) in enumerate([(0, True, "a"), (60, True, "a"), (300, True, "b"), (360, False, "b"), (420, True, "a")])]
    df = spark.createDataFrame(rows, "k int, seq int, chain double, seen boolean, cls string")
    found = windows.islands_in_view(df, "k", "seq", "seen", "chain", 90.0).groupBy("island").agg(F.min("seq"), F.max("seq")).collect()
    assert sorted((r[1], r[2]) for r in found) == [(0, 1), (2, 2), (4, 4)]
    runs = windows.runs_sharing_vertex(df, "k", "seq", "cls").groupBy("island").agg(F.min("seq"), F.max("seq"), F.max_by("cls", "seq")).collect()
    assert sorted((r[1], r[2], r[3]) for r in runs) == [(0, 1, "a"), (1, 3, "b"), (3, 4, "a")]


def test_resample_bounds(spark):
    df = spark.createDataFrame([(1, 0, 50.0), (1, 1, 50.0), (2, 0, 0.0)], "k int, seq int, len double")
    out = windows.resample(df, "k", "seq", F.col("len"), 25.0).select("k", "seq", "chain", "share").collect()
    assert sorted(map(tuple, out)) == [(1, 0, 0.0, 0.0), (1, 0, 25.0, 0.5), (1, 1, 50.0, 0.0), (1, 1, 75.0, 0.5)]


def test_range_joins_equal_brute_force(spark):
    p = spark.range(400).select((F.col("id") * 0.37 % 50).alias("x"), "id")
    w = spark.range(60).select((F.col("id") * 0.81 % 48).alias("lo"), F.col("id").alias("w")).withColumn("hi", F.col("lo") + F.col("w") % 7 * 0.9)
    fast = joins.bucketed_range_join(p, F.col("x"), w, F.col("lo"), F.col("hi"), 2.0).select("id", "w")
    slow = p.join(w, (p.x >= w.lo) & (p.x <= w.hi)).select("id", "w")
    assert sorted(fast.collect()) == sorted(slow.collect())
    s = spark.range(300).select((F.col("id") * 7.3 % 360).alias("az"), "id")
    o = spark.range(40).select((F.col("id") * 9.1 % 360).alias("c"), F.col("id").alias("o"))
    fast = joins.angular_join(s, F.col("az"), o, F.col("c"), F.lit(3.0)).select("id", "o")
    slow = s.join(o, F.abs(geo.wrap(s.az - o.c)) <= 3.0).select("id", "o")
    assert sorted(fast.collect()) == sorted(slow.collect())


def test_rules(spark):
    specs = ["Chapters 4, 8, 12 (70/7460-1L)", "Chapters 4, 5 (70/7460-1K)", None, "None", "red lights"]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(specs)], "i int, s string").orderBy("i").select(rules.lighting_class(F.col("s"))).collect()]
    assert got == ["dual", "lit", "none", "none", "lit"]
    df = spark.createDataFrame([(0.99, 0.1), (0.99, 0.5), (0.02, 0.0), (None, 0.0)], "p double, kc double")
    assert [r[0] for r in df.select(rules.visibility_class(F.col("p"), F.col("kc"), F.lit(0.13))).collect()] == ["v", "m", "h", "x"]


def test_kml_round_trip_and_log(spark, tmp_path):
    rows = spark.createDataFrame([("A & <B>", [(1.5, 2.5, 3.0)]), ("line", [(0.0, 0.0, 0.0), (1.0, 1.0, 5.0)])], "name string, points array<struct<lon: double, lat: double, z: double>>")
    writers.write_kml(rows, f"{tmp_path}/kml")
    back = {r["name"]: [tuple(p) for p in r.points] for r in readers.read_kml(spark, f"{tmp_path}/kml/*.txt").collect()}
    assert back == {"A & <B>": [(1.5, 2.5, 3.0)], "line": [(0.0, 0.0, 0.0), (1.0, 1.0, 5.0)]}
    log = spark.createDataFrame([('say "hi"', None)], "note string, el double").coalesce(1)
    writers.write_log_csv(log, f"{tmp_path}/log")
    text = next(iter((tmp_path / "log").glob("*.csv"))).read_text()
    assert text == '"note","el"\n"say ""hi""",""\n'


def test_readers(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"route": "A"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}, {"properties": {"route": "B"}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0]], [[2, 2], [3, 3]]]}}]}')
    parts = readers.read_geojson_lines(spark, f"{tmp_path}/g.json").select("properties.route", "part", F.size("points").alias("n")).collect()
    assert sorted(map(tuple, parts)) == [("A", 0, 2), ("B", 0, 1), ("B", 1, 2)]
    (tmp_path / "p.csv").write_text("name,lat,lon\na,1,2\nb,x,2\n")
    assert readers.read_csv_points(spark, f"{tmp_path}/p.csv", "lat", "lon").count() == 1
    import struct

    (tmp_path / "pack.bin").write_bytes(struct.pack("<II", 1, 3) + b"n" + b"abc" + struct.pack("<II", 1, 9) + b"x")
    assert [(r.name, bytes(r.payload)) for r in readers.read_packs(spark, f"{tmp_path}/pack.bin").collect()] == [("n", b"abc")]
    text = spark.createDataFrame([('[["a", 1.5], ["b", "bad"]]',)], "j string")
    assert text.select(F.explode(readers.positional(F.col("j"), ["n", "v"], ["string", "double"]))).select("col.*").collect() == [("a", 1.5), ("b", None)]
    files = spark.createDataFrame([("a-400.jpg",), ("a-1600.jpg",), ("b-2000.jpg",), ("b-3000.jpg",), ("c.png",)], "file string")
    assert sorted(r.file for r in readers.precache(files, 800).collect()) == ["a-400.jpg", "b-2000.jpg", "c.png"]
    assert spark.range(1).select(readers.image_format(F.lit(bytes.fromhex("89504e470d0a1a0a")))).first()[0] == "png"


def test_evidence_kind_reads_whole_texts(spark, tmp_path):
    from vantage.plans import relations

    turns = [("user", 3, "x " * 50 + "seen on video"), ("user", 3, "y " * 50 + "a single witness"), ("user", 3, None)]
    spark.createDataFrame(turns, "role string, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.kind, r.weak): r.n for r in relations.evidence_kind(spark, str(tmp_path)).collect()}
    assert got == {("photo", False): 1, ("eyewitness", True): 1, ("eyewitness", False): 1}


def test_kernel_and_column_sight_lines_agree(spark):
    from vantage.plans import visibility

    t = spark.createDataFrame([(i, -103.93 - i * 0.004, 30.25 - i * 0.003, i * 60.0, "r") for i in range(12)], "target_id long, lon double, lat double, chain double, route string")
    columns = {(r.target_id, r.lamp): r.k_crit for r in visibility.k_critical(visibility.chord_samples(t, lamps=(0.66, 4.0)), lamps=(0.66, 4.0)).collect()}
    kernel = visibility.reduced(t, (0.66, 4.0), {"a": visibility.critical_of(0), "b": visibility.critical_of(1)}).collect()
    for r in kernel:
        assert r.a == pytest.approx(columns[r.target_id, 0.66], abs=1e-4) and r.b == pytest.approx(columns[r.target_id, 4.0], abs=1e-4)


def test_ground_without_height_is_unknown_or_an_error(spark):
    from vantage.plans import visibility

    t = spark.createDataFrame([(1, -103.95, 30.20, 0.0, "r"), (2, -103.885, 30.27, 60.0, "r")], "target_id long, lon double, lat double, chain double, route string")
    hole = lambda lon, lat: F.when((lat > 30.23) & (lat < 30.24), F.lit(None).cast("double")).otherwise(visibility.terrain(lon, lat))
    samples = visibility.chord_samples(t, lamps=(0.66,), surface=hole, distances=visibility.evenly(200.0))
    got = {r.target_id: r.k_crit for r in visibility.k_critical(samples, lamps=(0.66,)).collect()}
    assert got[1] is None and got[2] is not None
    with pytest.raises(Exception, match="ground height"):
        visibility.k_critical(samples, lamps=(0.66,), strict=True).collect()


def test_weighted_quantiles_and_nearest_equal_plain_ones(spark):
    import numpy as np

    from vantage.operators import joins, stats

    rng = np.random.default_rng(4)
    values = {k: rng.integers(0, 40, 300).astype(float) for k in range(3)} | {3: np.array([7.0]), 4: np.array([1.0, 1.0])}
    d = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k int, v double").groupBy("k", "v").count()
    for r in stats.weighted_quantiles(d, ["k"], "v", "count", [0.0, 0.05, 0.5, 0.77, 1.0]).collect():
        assert r.q == pytest.approx(np.quantile(values[r.k], [0.0, 0.05, 0.5, 0.77, 1.0]).tolist())
    left = [(i, int(rng.integers(0, 3)), float(rng.integers(0, 50))) for i in range(60)] + [(60, 9, 1.0), (61, 0, None)]
    right = [(i, int(rng.integers(0, 3)), float(rng.integers(0, 50))) for i in range(20)]
    a, b = spark.createDataFrame(left, "i long, k int, x double"), spark.createDataFrame(right, "p long, k int, y double")
    got = {r.i: (r.near, r.near_distance) for r in joins.nearest_by_key(a, b, "k", F.col("x"), F.col("y"), "p", "near", ["i"], 6).collect()}
    for i, k, x in left[:-1]:
        options = sorted((abs(x - y), p) for p, q, y in right if q == k)
        assert got[i] == ((options[0][1], options[0][0]) if options else (None, None))


def test_nearest_by_key_has_no_shrinking_window(spark):
    from vantage.operators import joins

    a, b = spark.createDataFrame([(1, 0, 2.0)], "i long, k int, x double"), spark.createDataFrame([(7, 0, 3.0), (8, 0, 0.0)], "p long, k int, y double")
    out = joins.nearest_by_key(a, b, "k", F.col("x"), F.col("y"), "p", "near", ["i"], 6)
    assert out.collect() == [(1, 7, 1.0)]
    assert "UnboundedFollowing" not in out._jdf.queryExecution().optimizedPlan().toString().replace("unboundedfollowing$()", "UnboundedFollowing")


def test_nearest_of_places_equals_brute_force(spark):
    import numpy as np

    from vantage.operators import joins

    rng = np.random.default_rng(8)
    left = [(i, float(rng.integers(0, 90)) / 10, float(rng.integers(0, 60)) / 10) for i in range(400)]
    right = [(i, float(rng.integers(0, 30)) / 10, float(rng.integers(0, 60)) / 10) for i in range(150)] + [(150, 6.5, 3.1)]
    a, b = spark.createDataFrame(left, "i long, x double, y double"), spark.createDataFrame(right, "p long, u double, v double")
    d = F.round(F.sqrt(F.pow(F.col("x") - F.col("u"), F.lit(2.0)) + F.pow(F.col("y") - F.col("v"), F.lit(2.0))), 6)
    rows = joins.nearest_of_places(a, ["x", "y"], b, ["u", "v"], "p", d, 1.0).collect()
    best = {(x, y): min((round(math.hypot(x - u, y - v), 6), p) for p, u, v in right) for _, x, y in left}
    assert {(r.x, r.y): (r.d, r.p) for r in rows} == {k: v for k, v in best.items() if v[0] <= 1} and len(rows) == len({(r.x, r.y) for r in rows})


def test_a_value_that_is_the_mean_is_not_above_it(spark, tmp_path):
    from vantage.plans import series

    rows = [(i, 1, "view", v) for i, v in enumerate([0.3, 0.2, 0.1])]  # in doubles their mean is below 0.2
    d = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    d.withColumn("ts", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id)")).write.parquet(f"{tmp_path}/events.parquet")
    assert series.autocorrelation(spark, str(tmp_path)).first().duty == pytest.approx(1 / 3, abs=1e-6)


def test_targets_of_one_place_share_its_ray(spark):
    import numpy as np

    from vantage.plans import visibility

    t = spark.createDataFrame([(i, -103.99, 30.20 - i % 2 * 0.01, i * 60.0, "r") for i in range(300)], "target_id long, lon double, lat double, chain double, route string")

    def few(lon, lat):
        if np.size(lon) > 20_000:  # two rays have some 8,000 samples, 300 have over a million
            raise ValueError("a ray for each target")
        return visibility.ground(lon, lat)

    got = {r.target_id: r.a for r in visibility.reduced(t, (0.66,), {"a": visibility.critical_of(0)}, surface=few).collect()}
    assert len(got) == 300 and len({got[i] for i in range(0, 300, 2)}) == 1 and len({got[i] for i in range(1, 300, 2)}) == 1
    alone = {r.target_id: r.a for r in visibility.reduced(t.where("target_id < 2"), (0.66,), {"a": visibility.critical_of(0)}).collect()}
    assert (got[298], got[299]) == (alone[0], alone[1])
