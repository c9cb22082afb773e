"""Queries of traffic simulation, forecasts and motion along a road."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import physics
from ..operators import windows
from .views import table, view, with_views

# Vehicles an hour and direction, speeds (m/s: mean, deviation, least, most), share of high beams, length of the road (m), window (s)
PER_HOUR, SPEED, HIGH, ROAD, HOUR = 60.0, (30.0, 3.0, 20.0, 40.0), 0.3, 40_000.0, 3600.0
PRIME = 100_003


def uniform(key: Column, salt: int) -> Column:
    """A number above 0 and below 1 from an integer key, the same on every engine: powers modulo a prime."""
    mixed = F.pmod(key * (2 * salt + 7919) + 104_729 * (salt + 1), F.lit(PRIME))
    return (F.pmod(mixed * mixed + 17 * salt, F.lit(PRIME)) + 1) / float(PRIME + 1)


def arrivals(entries: DataFrame, road: list[str], order: str, key: Column) -> DataFrame:
    """``entries`` with t0 (s), speed and high: Poisson arrivals from so long before 0 that the road is in steady state at 0.

    Gaps are exponential, so entry times are running sums; speeds are near normal (twelve uniform numbers), held between limits.
    """
    mean, sd, least, most = SPEED
    gap = -F.log(uniform(key, 0)) * (HOUR / PER_HOUR)
    before = Window.partitionBy(*road).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    normal = sum((uniform(key, i) for i in range(1, 13)), F.lit(0.0)) - 6.0
    cars = entries.withColumn("_gap", gap).withColumn("t0", F.sum("_gap").over(before) - ROAD / least).drop("_gap")
    return cars.withColumns({"speed": F.least(F.greatest(normal * sd + mean, F.lit(least)), F.lit(most)), "high": uniform(key, 13) < HIGH})


def _cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as vehicles on roads, a road for every 600 of them and direction."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 600).alias("road"), F.when(F.col("o_orderkey") % 2 == 0, "N").otherwise("S").alias("dir"))
    return arrivals(o, ["road", "dir"], "o_orderkey", F.col("o_orderkey")).where(F.col("t0") <= HOUR)


def simulated_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles of each road and direction that use it in the hour, with their mean speed and share of high beams."""
    use = _cars(spark, sf_dir).where(F.col("t0") >= -ROAD / SPEED[0])
    return use.groupBy("road", "dir").agg(F.count("*").alias("cars"), F.round(F.avg("speed"), 6).alias("speed"), F.count_if("high").alias("high"), F.round(F.max("t0"), 3).alias("last"))


def simulation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each road the share of seconds with any vehicle in the lit part (10 to 12 km), and the most at once.

    Each vehicle's interval becomes the seconds it covers; per-second counts are one aggregation.
    """
    from_, to = F.col("t0") + 10_000.0 / F.col("speed"), F.col("t0") + 12_000.0 / F.col("speed")
    first, last = F.greatest(F.ceil(F.round(from_, 6)), F.lit(0)), F.least(F.floor(F.round(to, 6)), F.lit(int(HOUR) - 1))
    seconds = _cars(spark, sf_dir).select("road", first.alias("a"), last.alias("b")).where("b >= a").select("road", F.explode(F.sequence("a", "b")).alias("t"))
    per = seconds.groupBy("road", "t").agg(F.count("*").alias("n"))
    return per.groupBy("road").agg(F.round(F.count("*") / HOUR, 6).alias("any_light"), F.max("n").alias("most"), F.round(F.sum("n") / HOUR, 6).alias("mean"))


def typical_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first road, as a seed, whose hour is typical: north, south and high-beam counts within a few of their expectations; null if none is."""
    expect = PER_HOUR * (HOUR + ROAD / SPEED[0]) / HOUR
    use = _cars(spark, sf_dir).where(F.col("t0") >= -ROAD / SPEED[0])
    per = use.groupBy("road").agg(F.count_if(F.col("dir") == "N").alias("n"), F.count_if(F.col("dir") == "S").alias("s"), F.count_if((F.col("dir") == "N") & F.col("high")).alias("h"))
    good = (F.abs(F.col("n") - expect) <= 12) & (F.abs(F.col("s") - expect) <= 12) & (F.abs(F.col("h") - HIGH * expect) <= 9)
    return per.agg(F.min(F.when(good, F.col("road"))).alias("seed"), F.count_if(good).alias("typical"))


def sample_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at every 150 along each user's series: of the nearest sample, and linear between the two around; held at the ends.

    Places and samples are one sorted list; the samples before and after a place are the last and the first non-null of two frames.
    """
    s = view(spark, sf_dir, "series").select("user_id", F.col("chain").alias("x"), "v")
    ends = s.groupBy("user_id").agg(F.max("x").alias("top"))
    asked = ends.select("user_id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / 150)), lambda i: i * 150.0)).alias("x"))
    both = s.withColumn("at", F.struct("x", "v")).select("user_id", "x", "at", F.lit(False).alias("asked")).unionByName(asked.select("user_id", "x", F.lit(None).cast("struct<x:double,v:double>").alias("at"), F.lit(True).alias("asked")))
    w = Window.partitionBy("user_id").orderBy("x", "asked")
    back, ahead = F.last("at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("at", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumns({"p": back, "q": ahead}).where("asked").withColumns({"p": F.coalesce("p", "q"), "q": F.coalesce("q", "p")})
    gap = F.col("q.x") - F.col("p.x")
    held = F.when(F.col("q.x") - F.col("x") < F.col("x") - F.col("p.x"), F.col("q.v")).otherwise(F.col("p.v"))
    linear = F.when(gap > 0, F.col("p.v") + (F.col("x") - F.col("p.x")) / F.when(gap > 0, gap) * (F.col("q.v") - F.col("p.v"))).otherwise(F.col("p.v"))
    return out.select("user_id", "x", held.alias("held"), F.round(linear, 6).alias("linear"))


def chain_of_azimuth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chainage at which a user's series passes 50, within 300 of a hint; where it does not, the chainage of the nearest value there."""
    s = view(spark, sf_dir, "series").select("user_id", "chain", "v")
    hints = s.groupBy("user_id").agg((F.max("chain") / 2).alias("hint"))
    near = s.join(hints, "user_id").where(F.abs(F.col("chain") - F.col("hint")) < 300)
    segs = windows.segments(near, "user_id", "chain", ["chain", "v"])
    crossed = segs.where(((F.col("v") - 50) * (F.col("v2") - 50) <= 0) & (F.col("v2") != F.col("v")))
    root = F.col("chain") + (50 - F.col("v")) / (F.col("v2") - F.col("v")) * (F.col("chain2") - F.col("chain"))
    found = crossed.groupBy("user_id").agg(F.min(F.struct("chain", F.round(root, 6).alias("root"))).alias("b"))
    best = near.groupBy("user_id").agg(F.min(F.struct(F.abs(F.col("v") - 50).alias("d"), "chain")).alias("n"))
    return best.join(found, "user_id", "left").select("user_id", F.coalesce("b.root", F.round("n.chain", 6)).alias("chain"))


def car_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each vehicle of the first road is at 600 s: linear along the road, then between the track's vertices."""
    cars = _cars(spark, sf_dir).where("road = 0").select("o_orderkey", F.round((600 - F.col("t0")) * F.col("speed") / 1000, 6).alias("km")).where("km >= 0 AND km < 40")
    n = table(spark, sf_dir, "nation").where("n_nationkey < 21").select("n_nationkey", (F.col("n_nationkey") * 2.0).alias("ch"), (F.sin(F.col("n_nationkey") * 0.3) * 5).alias("x"), (F.col("n_nationkey") * 1.5).alias("y"), F.lit(1).alias("one"))
    seg = windows.segments(n, "one", "n_nationkey", ["ch", "x", "y"]).withColumn("cell", F.floor(F.col("ch") / 2))
    met = cars.withColumn("cell", F.floor(F.col("km") / 2)).join(F.broadcast(seg), "cell")
    t = (F.col("km") - F.col("ch")) / (F.col("ch2") - F.col("ch"))
    return met.select("o_orderkey", "km", F.round(F.col("x") + t * (F.col("x2") - F.col("x")), 6).alias("x"), F.round(F.col("y") + t * (F.col("y2") - F.col("y")), 6).alias("y"))


def track_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed of each user's track between its first and last detection, with its range from errors of time and place."""
    s = view(spark, sf_dir, "series").select("user_id", "seq", "chain")
    per = s.groupBy("user_id").agg(F.min_by("chain", "seq").alias("c0"), F.max_by("chain", "seq").alias("c1"), (F.max("seq") - F.min("seq")).cast("double").alias("dt")).where("dt > 0")
    d, sigma, dt = F.abs(F.col("c1") - F.col("c0")) * 10, F.lit(12.0), F.col("dt") * 3
    return per.select("user_id", F.round(d / dt, 6).alias("v"), F.round(F.greatest(d - 2 * sigma, F.lit(0.0)) / (dt + 1), 6).alias("v_low"), F.round((d + 2 * sigma) / F.greatest(dt - 1, F.lit(0.5)), 6).alias("v_high"))


def forecast_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly forecasts taken in: hours without temperatures are dropped, a missing pressure is 850, the newest of an hour stays."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"), F.when(F.col("event_id") % 7 != 0, F.col("value") / 4).alias("t2"), F.when(F.col("event_id") % 11 != 0, F.col("value") / 4 + 1).alias("t80"), F.when(F.col("event_id") % 3 != 0, 840.0).alias("p"))
    known = e.where("t2 IS NOT NULL AND t80 IS NOT NULL").withColumn("p", F.coalesce(F.when(F.col("p") != 0, F.col("p")), F.lit(850.0)))
    last = known.groupBy("hour").agg(F.max(F.struct("event_id", "t2", "t80", "p")).alias("f"))
    return last.select("hour", F.round(physics.k_from_forecast(F.col("f.p"), F.col("f.t2"), F.col("f.t80")), 8).alias("k"))


def forecast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By day: dark minutes, the hour of the strongest refraction (the first on ties), and calm hours."""
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour"), "value")
    per = e.groupBy("day", "hour").agg(F.round(F.avg("value"), 6).alias("k"), F.max("value").alias("wind"))
    dark = (F.col("hour") >= 21) | (F.col("hour") < 5)
    return per.groupBy("day").agg((F.count_if(dark) * 60).alias("dark_minutes"), F.max_by("hour", F.struct("k", -F.col("hour"))).alias("peak_hour"), F.max("k").alias("peak"), F.count_if(F.col("wind") < 150).alias("calm"))


def _u(key: str, salt: int) -> str:
    m = f"(({key} * {2 * salt + 7919} + {104_729 * (salt + 1)}) % {PRIME})"
    return f"((({m} * {m} + {17 * salt}) % {PRIME} + 1) / {PRIME + 1}e0)"


_CARS = f"""c0 AS (SELECT o_orderkey, o_orderkey // 600 AS road, CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE 'S' END AS dir, -ln({_u('o_orderkey', 0)}) * 60e0 AS gap,
least(greatest(({' + '.join(_u('o_orderkey', i) for i in range(1, 13))} - 6) * 3e0 + 30, 20e0), 40e0) AS speed, {_u('o_orderkey', 13)} < 3e-1 AS high FROM orders),
c1 AS (SELECT *, sum(gap) OVER (PARTITION BY road, dir ORDER BY o_orderkey) - 40000e0 / 20 AS t0 FROM c0), cars AS (SELECT * FROM c1 WHERE t0 <= 3600)"""
_EXPECT = repr(PER_HOUR * (HOUR + ROAD / SPEED[0]) / HOUR) + "::DOUBLE"
QUERIES = {
    f.__name__: f
    for f in (simulated_arrivals, simulation_statistics, typical_seed, sample_and_hold, chain_of_azimuth, car_positions, track_speeds, forecast_hours, forecast_summary)
}
ORACLES = {
    "simulated_arrivals": f"WITH {_CARS} SELECT road, dir, count(*) AS cars, round(avg(speed), 6) AS speed, count(*) FILTER (high) AS high, round(max(t0), 3) AS last FROM cars WHERE t0 >= -40000e0 / 30 GROUP BY road, dir",
    "simulation_statistics": f"WITH {_CARS}, i AS (SELECT road, greatest(ceil(round(t0 + 10000 / speed, 6)), 0)::BIGINT AS a, least(floor(round(t0 + 12000 / speed, 6)), 3599)::BIGINT AS b FROM cars), t AS (SELECT road, unnest(range(a, b + 1)) AS t FROM i WHERE b >= a), n AS (SELECT road, t, count(*) AS n FROM t GROUP BY road, t) SELECT road, round(count(*) / 3600e0, 6) AS any_light, max(n) AS most, round(sum(n) / 3600e0, 6) AS mean FROM n GROUP BY road",
    "typical_seed": f"WITH {_CARS}, n AS (SELECT road, count(*) FILTER (dir = 'N') AS n, count(*) FILTER (dir = 'S') AS s, count(*) FILTER (dir = 'N' AND high) AS h FROM cars WHERE t0 >= -40000e0 / 30 GROUP BY road), g AS (SELECT road, abs(n - {_EXPECT}) <= 12 AND abs(s - {_EXPECT}) <= 12 AND abs(h - 3e-1 * {_EXPECT}) <= 9 AS g FROM n) SELECT min(road) FILTER (g) AS seed, count(*) FILTER (g) AS typical FROM g",
    "sample_and_hold": "WITH s AS (SELECT user_id, chain AS x, v FROM v_series), a AS (SELECT user_id, unnest(range(floor(max(x) / 150)::BIGINT + 1)) * 15e1 AS x FROM s GROUP BY user_id), p AS (SELECT a.user_id, a.x, s.x AS px, s.v AS pv FROM a ASOF LEFT JOIN s ON a.user_id = s.user_id AND a.x >= s.x), q AS (SELECT p.*, s.x AS qx, s.v AS qv FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.x <= s.x), h AS (SELECT user_id, x, coalesce(px, qx) AS px, coalesce(pv, qv) AS pv, coalesce(qx, px) AS qx, coalesce(qv, pv) AS qv FROM q) SELECT user_id, x, CASE WHEN qx - x < x - px THEN qv ELSE pv END AS held, round(CASE WHEN qx > px THEN pv + (x - px) / (qx - px) * (qv - pv) ELSE pv END, 6) AS linear FROM h",
    "chain_of_azimuth": "WITH h AS (SELECT user_id, max(chain) / 2 AS hint FROM v_series GROUP BY user_id), n AS (SELECT user_id, chain, v FROM v_series JOIN h USING (user_id) WHERE abs(chain - hint) < 300), s AS (SELECT *, lead(chain) OVER w AS c2, lead(v) OVER w AS v2 FROM n WINDOW w AS (PARTITION BY user_id ORDER BY chain)), c AS (SELECT user_id, arg_min(round(chain + (50 - v) / (v2 - v) * (c2 - chain), 6), chain) AS root FROM s WHERE (v - 50) * (v2 - 50) <= 0 AND v2 <> v GROUP BY user_id), b AS (SELECT user_id, chain FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(v - 50), chain) = 1) SELECT user_id, coalesce(root, round(b.chain, 6)) AS chain FROM b LEFT JOIN c USING (user_id)",
    "car_positions": f"WITH {_CARS}, k AS (SELECT o_orderkey, round((600 - t0) * speed / 1000, 6) AS km FROM cars WHERE road = 0), n AS (SELECT n_nationkey, n_nationkey * 2e0 AS ch, sin(n_nationkey * 3e-1) * 5 AS x, n_nationkey * 15e-1 AS y FROM nation WHERE n_nationkey < 21), s AS (SELECT *, lead(ch) OVER w AS ch2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM n WINDOW w AS (ORDER BY n_nationkey)) SELECT o_orderkey, km, round(x + (km - ch) / (ch2 - ch) * (x2 - x), 6) AS x, round(y + (km - ch) / (ch2 - ch) * (y2 - y), 6) AS y FROM k JOIN s ON km >= ch AND km < ch2",
    "track_speeds": "WITH a AS (SELECT user_id, abs(arg_max(chain, seq) - arg_min(chain, seq)) * 10 AS d, (max(seq) - min(seq)) * 3e0 AS dt FROM v_series GROUP BY user_id HAVING max(seq) > min(seq)) SELECT user_id, round(d / dt, 6) AS v, round(greatest(d - 24, 0) / (dt + 1), 6) AS v_low, round((d + 24) / greatest(dt - 1, 5e-1), 6) AS v_high FROM a",
    "forecast_hours": "WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H') AS hour, value / 4 AS t2, value / 4 + 1 AS t80, CASE WHEN event_id % 3 <> 0 THEN 84e1 ELSE 85e1 END AS p FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY hour ORDER BY event_id DESC) = 1) SELECT hour, round(503e0 * p / (((t2 + t80) / 2 + 27315e-2) * ((t2 + t80) / 2 + 27315e-2)) * (343e-4 + (t80 - t2) / 78), 8) AS k FROM l",
    "forecast_summary": "WITH h AS (SELECT strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS hour, round(avg(value), 6) AS k, max(value) AS wind FROM events GROUP BY 1, 2) SELECT day, count(*) FILTER (hour >= 21 OR hour < 5) * 60 AS dark_minutes, arg_max(hour, struct_pack(k := k, h := -hour))::INT AS peak_hour, max(k) AS peak, count(*) FILTER (wind < 150) AS calm FROM h GROUP BY day",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
