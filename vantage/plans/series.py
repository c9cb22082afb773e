"""Queries over ordered series: islands, gradients, resampling, moving statistics, fits, occupancy and local time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, physics
from ..operators import windows
from .views import table, view, with_views

GAP = 90.0
#: added before rounding, so that exact halves go the same way on every engine
TIE = 1.23e-9


def micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def islands_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-view runs of each user, ended by hidden rows and gaps, with their rollup."""
    found = windows.islands_in_view(view(spark, sf_dir, "series"), "user_id", "seq", "in_view", "chain", GAP)
    per = found.groupBy("user_id", "island").agg(F.count("*").alias("rows"), F.min("chain").alias("start"), F.max("chain").alias("stop"), F.round(F.avg("v"), 6).alias("mean_v"), F.round(F.expr("percentile(v, 0.5)"), 6).alias("median_v"))
    return per.select("user_id", "rows", "start", "stop", "mean_v", "median_v", F.round(F.col("rows") * 0.06, 6).alias("km"))


def islands_shared_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event type; a run after another begins with that one's last row, and its label is its last row's."""
    runs = windows.runs_sharing_vertex(view(spark, sf_dir, "series").select("user_id", "seq", "event_type"), "user_id", "seq", "event_type")
    return runs.groupBy("user_id", "island").agg(F.count("*").alias("vertices"), F.min("seq").cast("long").alias("first_seq"), F.max("seq").cast("long").alias("last_seq"), F.max_by("event_type", "seq").alias("label")).drop("island")


def islands_class_or_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs broken by another class or a gap in time of over an hour; midpoint is the element at half the size."""
    s = view(spark, sf_dir, "series")
    w = Window.partitionBy("user_id").orderBy("seq")
    gap = micros("ts") - F.lag(micros("ts")).over(w) > 3_600_000_000
    marked = s.withColumns({"cls": F.floor("v") % 3, "_gap": gap})
    marked = marked.withColumn("_other", F.lag("cls").over(w) != F.col("cls"))
    runs = windows.islands(marked, "user_id", ["seq"], F.col("_other") | F.col("_gap"))
    middle = F.element_at(F.sort_array(F.collect_list(F.struct("seq", "event_id"))), (F.count("*") / 2).cast("int") + 1)["event_id"]
    return runs.groupBy("user_id", "island").agg(F.count("*").alias("rows"), F.max("cls").alias("cls"), middle.alias("middle_event")).drop("island")


def heading_from_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Azimuth from the point before to the point after on each route, the own point at its ends; routes are dealt by stretches."""
    t = windows.in_stretches(view(spark, sf_dir, "targets"), "route", "chain", 120_000.0, 600.0)
    cols = {f"{c}_{i}": e for c in ("lon", "lat") for i, e in enumerate(windows.neighbours(c, ["route", "_stretch"], "chain"))}
    t = t.withColumns(cols).where("_own")
    return t.select("target_id", F.round(geo.bearing(F.col("lon_0"), F.col("lat_0"), F.col("lon_1"), F.col("lat_1")), 6).alias("heading"))


def nonuniform_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "series")
    return s.select("user_id", "seq", F.round(windows.gradient("v", "chain", "user_id", "seq"), 6).alias("slope"))


def resample_fixed_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points every 25 units along each user's series, with the value between its vertices."""
    segs = windows.segments(view(spark, sf_dir, "series").select("user_id", "seq", "chain", "v"), "user_id", "seq", ["chain", "v"])
    out = windows.resample(segs.withColumn("length", F.col("chain2") - F.col("chain")).withColumnRenamed("chain", "chain0"), "user_id", "seq", F.col("length"), 25.0)
    return out.select("user_id", "chain", F.round(F.col("v") + F.col("share") * (F.col("v2") - F.col("v")) + TIE, 6).alias("v"))


def densify_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment in equal parts of 0.5 km at most; the last vertex of a line is kept."""
    lines = view(spark, sf_dir, "lines").select("line_id", "seq", "km")
    segs = windows.segments(lines, "line_id", "seq", ["km"])
    inner = windows.densify(segs, F.ceil(F.abs(F.col("km2") - F.col("km")) / 0.5)).select("line_id", F.round(F.col("km") + F.col("share") * (F.col("km2") - F.col("km")), 6).alias("km"))
    last = lines.groupBy("line_id").agg(F.max_by("km", "seq").alias("km")).select("line_id", F.round("km", 6).alias("km"))
    return inner.unionByName(last)


def fill_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interior points between neighbours of a line that are close on the ground; the rate is the smaller one; nulls break a line."""
    lines = view(spark, sf_dir, "lines").select("line_id", "seq", "az", "el", "km", "rate")
    segs = windows.segments(lines, "line_id", "seq", ["az", "el", "km", "rate"]).where("rate IS NOT NULL AND rate2 IS NOT NULL")
    apart = F.sqrt(F.greatest(F.col("km") * F.col("km") + F.col("km2") * F.col("km2") - 2 * F.col("km") * F.col("km2") * F.cos(F.radians(F.col("az2") - F.col("az"))), F.lit(0.0)))
    n = F.floor(F.round(F.abs(F.col("az2") - F.col("az")) / 0.04, 6)).cast("int")
    near = segs.where(apart < 15).withColumn("n", n).where("n > 0")
    out = near.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("t", F.col("i") / (F.col("n") + 1))
    return out.select("line_id", F.round(F.col("az") + F.col("t") * (F.col("az2") - F.col("az")) + TIE, 6).alias("az"), F.round(F.col("el") + F.col("t") * (F.col("el2") - F.col("el")) + TIE, 6).alias("el"), F.round(F.least("rate", "rate2"), 6).alias("rate"))


def zero_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "series").select("user_id", "seq", "chain", (F.col("v") - 40).alias("y"))
    return windows.zero_crossings(s, "user_id", "chain", "y").select("user_id", F.round("root", 6).alias("root"))


def moving_sum_full_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "series")
    return s.select("user_id", "seq", F.round(windows.full_frame(F.sum("v"), "user_id", "seq", 5), 6).alias("total")).where("total IS NOT NULL")


def rolling_median_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows farther than 60 from the median of the 15 around them."""
    s = view(spark, sf_dir, "series").withColumn("median", windows.centred(F.expr("percentile(v, 0.5)"), "user_id", "seq", 7))
    return s.where(F.abs(F.col("v") - F.col("median")) > 60).select("user_id", "seq", F.round("median", 6).alias("median"))


def local_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "series").withColumn("low", windows.local_minimum("v", "user_id", "seq", 5))
    return s.where("low").select("user_id", "seq", "v")


def variogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the mean squared difference by lag: shifts of one window, not a self-join."""
    w = Window.partitionBy("user_id").orderBy("seq")
    s = view(spark, sf_dir, "series").select("user_id", *[F.pow(F.lead("v", k).over(w) - F.col("v"), F.lit(2.0)).alias(f"d{k}") for k in range(1, 9)])
    wide = s.agg(*[F.avg(f"d{k}").alias(f"d{k}") for k in range(1, 9)], *[F.count(f"d{k}").alias(f"n{k}") for k in range(1, 9)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.round(F.col(f"d{k}") / 2, 4).alias("gamma"), F.col(f"n{k}").alias("pairs")) for k in range(1, 9)])).alias("p")).select("p.*")


def grid_search_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlation length 1, 1.5, ... 60 whose exponential model is nearest to the variogram, by least squares."""
    data = variogram(spark, sf_dir)
    sill = data.agg(F.max("gamma").alias("sill"))
    candidates = spark.range(119).select((F.col("id") * 0.5 + 1).alias("length"))
    model = F.col("sill") * (1 - F.exp(-F.col("lag") / F.col("length")))
    cost = data.crossJoin(F.broadcast(sill)).crossJoin(F.broadcast(candidates)).groupBy("length").agg(F.sum(F.pow(F.col("gamma") - model, F.lit(2.0))).alias("cost"))
    return cost.agg(F.min(F.struct(F.round("cost", 3).alias("cost"), "length")).alias("b")).select("b.length", "b.cost")


def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's lag from 1 to 12 of the largest autocovariance, and the share of time above the mean.

    A value that is the mean is not above it, though its difference from the mean added up in doubles may be some 1e-14.
    """
    w = Window.partitionBy("user_id")
    o = w.orderBy("seq")
    s = view(spark, sf_dir, "series").withColumn("x", F.col("v") - F.avg("v").over(w))
    s = s.select("user_id", "x", *[(F.col("x") * F.lead("x", k).over(o)).alias(f"p{k}") for k in range(1, 13)])
    g = s.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("x") > 1e-9, 1.0).otherwise(0.0)), 6).alias("duty"), *[F.round(F.sum(f"p{k}"), 3).alias(f"p{k}") for k in range(1, 13)])
    best = F.array_max(F.filter(F.array(*[F.struct(F.col(f"p{k}").alias("p"), F.lit(-k).alias("k")) for k in range(1, 13)]), lambda x: x["p"].isNotNull()))
    return g.select("user_id", "duty", (-best["k"]).alias("lag"))


def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "series")
    return s.groupBy("user_id").agg(F.round(F.regr_slope("v", "chain"), 6).alias("slope"), F.round(F.regr_intercept("v", "chain"), 4).alias("intercept"))


def poisson_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of at least two successes in each user's trials of a day, by folding (1 - q, q) over an array."""
    s = view(spark, sf_dir, "series").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "seq", (F.least(F.col("v"), F.lit(200.0)) / 250).alias("q"))
    g = s.groupBy("user_id", "day").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "q"))), lambda x: x["q"]).alias("q"))
    start = F.struct(F.lit(1.0).alias("p0"), F.lit(0.0).alias("p1"))
    fold = F.aggregate("q", start, lambda a, q: F.struct((a["p0"] * (1 - q)).alias("p0"), (a["p1"] * (1 - q) + a["p0"] * q).alias("p1")))
    return g.withColumn("f", fold).select("user_id", "day", (F.round(1 - F.col("f.p0") - F.col("f.p1"), 9) + 0.0).alias("tail"))


def poisson_binomial_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that more than half of a user's trials of a day succeed: the whole distribution by folding (1 - q, q) into an array, one trial after the other."""
    s = view(spark, sf_dir, "series").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "seq", (F.least(F.col("v"), F.lit(200.0)) / 250).alias("q"))
    g = s.groupBy("user_id", "day").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "q"))), lambda x: x["q"]).alias("q"))

    def trial(d: Column, q: Column) -> Column:
        at = lambda i: F.coalesce(F.get(d, i), F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.size(d)), lambda i: at(i) * (1 - q) + F.when(i > 0, at(i - 1)).otherwise(0.0) * q)

    whole = F.aggregate("q", F.array(F.lit(1.0)), trial)
    more = F.floor(F.size("q") / 2).cast("int") + 1
    return g.withColumn("d", whole).select("user_id", "day", (F.round(F.aggregate(F.slice("d", more + 1, F.size("d")), F.lit(0.0), lambda a, x: a + x), 9) + 0.0).alias("tail"))


def occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected number of vehicles, chance of any, and appearances an hour by event type, from its hourly rate."""
    per = view(spark, sf_dir, "series").groupBy("event_type").agg((F.count("*") / 720.0).alias("rate"), F.avg("v").alias("length"))
    n = physics.expected_number(F.col("rate"), F.col("length") * 100, 30.0)
    return per.select("event_type", F.round(n, 9).alias("expected"), F.round(physics.occupied(n), 9).alias("any"), F.round(F.col("rate") * 3, 6).alias("appearances"))


def road_at_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events are under way at each hour: an event lasts value minutes.  Hours are exploded from each interval, so the overlap is an equi-join."""
    e = table(spark, sf_dir, "events")
    start = micros("ts")
    stop = start + F.floor(F.col("value") * 60_000_000)
    first, last = F.ceil(start / 3_600_000_000), F.floor(stop / 3_600_000_000)
    hours = e.select(first.alias("a"), last.alias("b")).where("b >= a").select(F.explode(F.sequence("a", "b")).alias("hour"))
    return hours.groupBy("hour").agg(F.count("*").alias("under_way"))


def simulated_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of hours with any event under way, and the most at once."""
    per = road_at_t(spark, sf_dir)
    return per.agg(F.count("*").alias("hours_with_any"), F.max("under_way").alias("most"), F.round(F.avg("under_way"), 6).alias("mean_if_any"))


def night_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by local night: a night runs from noon to noon."""
    e = table(spark, sf_dir, "events")
    night = F.date_format(F.from_utc_timestamp("ts", "America/Chicago") - F.expr("INTERVAL 12 HOURS"), "yyyy-MM-dd")
    return e.groupBy(night.alias("night")).agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


def local_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates read as local wall clock at 10:00, in UTC; daylight saving counts."""
    o = table(spark, sf_dir, "orders")
    local = F.col("o_orderdate") + F.expr("INTERVAL 10 HOURS")
    return o.select("o_orderkey", F.date_format(F.to_utc_timestamp(local, "America/Chicago"), "yyyy-MM-dd HH:mm").alias("utc"))


def state_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal state (by value class) and the first downward crossing of 20 of each user."""
    w = Window.partitionBy("user_id").orderBy("seq")
    s = view(spark, sf_dir, "series").withColumn("state", F.when(F.col("v") < 20, "dark").when(F.col("v") < 60, "twilight").otherwise("day"))
    s = s.withColumns({"_new": F.when(F.lag("state").over(w) == F.col("state"), 0).otherwise(1), "_down": (F.col("v") < 20) & (F.lag("v").over(w) >= 20)})
    return s.groupBy("user_id").agg(F.sum("_new").alias("segments"), F.min(F.when(F.col("_down"), F.col("seq"))).cast("long").alias("first_down"))


_S = "PARTITION BY user_id ORDER BY seq"
QUERIES = {
    f.__name__: f
    for f in (
        islands_in_view, islands_shared_vertex, islands_class_or_gap, heading_from_neighbours, nonuniform_gradient, resample_fixed_spacing, densify_segments, fill_adjacent, zero_crossings, moving_sum_full_frames,
        rolling_median_reject, local_minima, variogram, grid_search_fit, autocorrelation, linear_fit, poisson_binomial, poisson_binomial_tail, occupancy, road_at_t, simulated_statistics, night_bucket, local_to_utc, state_segments,
    )
}
_VARIOGRAM = "g AS (SELECT k AS lag, round(avg(pow(b.v - a.v, 2)) / 2, 4) AS gamma, count(*) AS pairs FROM v_series a, range(1, 9) r(k), v_series b WHERE b.user_id = a.user_id AND b.seq = a.seq + k GROUP BY k)"
_UNDER_WAY = "h AS (SELECT unnest(range(ceil(epoch_us(ts) / 3600000000)::BIGINT, floor((epoch_us(ts) + floor(value * 60000000)) / 3600000000)::BIGINT + 1)) AS hour FROM events), n AS (SELECT hour, count(*) AS under_way FROM h GROUP BY hour)"
ORACLES = {
    "islands_in_view": f"WITH a AS (SELECT *, coalesce(lag(in_view) OVER w, true) AS pv, chain - lag(chain) OVER w AS gap FROM v_series WINDOW w AS ({_S})), b AS (SELECT *, sum(CASE WHEN NOT pv OR gap > {GAP} THEN 1 ELSE 0 END) OVER ({_S}) AS island FROM a) SELECT user_id, count(*) AS rows, min(chain) AS start, max(chain) AS stop, round(avg(v), 6) AS mean_v, round(quantile_cont(v, 0.5), 6) AS median_v, round(count(*) * 0.06::DOUBLE, 6) AS km FROM b WHERE in_view GROUP BY user_id, island",
    "islands_shared_vertex": f"WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER ({_S}) <> event_type THEN 1 ELSE 0 END AS new FROM v_series), b AS (SELECT *, sum(new) OVER ({_S}) AS island FROM a), c AS (SELECT user_id, island, min(seq) AS f, max(seq) AS l, max(event_type) AS label FROM b GROUP BY user_id, island) SELECT user_id, l - f + 1 + CASE WHEN f > 1 THEN 1 ELSE 0 END AS vertices, f - CASE WHEN f > 1 THEN 1 ELSE 0 END AS first_seq, l AS last_seq, label FROM c",
    "islands_class_or_gap": f"WITH a AS (SELECT *, floor(v)::BIGINT % 3 AS cls, epoch_us(ts) - lag(epoch_us(ts)) OVER ({_S}) AS gap FROM v_series), b AS (SELECT *, CASE WHEN lag(cls) OVER ({_S}) <> cls OR gap > 3600000000 THEN 1 ELSE 0 END AS new FROM a), c AS (SELECT *, sum(new) OVER ({_S}) AS island FROM b) SELECT user_id, count(*) AS rows, max(cls) AS cls, list(event_id ORDER BY seq)[count(*) // 2 + 1] AS middle_event FROM c GROUP BY user_id, island",
    "heading_from_neighbours": "WITH a AS (SELECT target_id, radians(coalesce(lag(lon) OVER w, lon)) AS l0, radians(coalesce(lead(lon) OVER w, lon)) AS l1, radians(coalesce(lag(lat) OVER w, lat)) AS p, radians(coalesce(lead(lat) OVER w, lat)) AS q FROM v_targets WINDOW w AS (PARTITION BY route ORDER BY chain)) SELECT target_id, round(((degrees(atan2(sin(l1 - l0) * cos(q), cos(p) * sin(q) - sin(p) * cos(q) * cos(l1 - l0))) % 360) + 360) % 360, 6) AS heading FROM a",
    "nonuniform_gradient": f"WITH a AS (SELECT user_id, seq, lead(chain) OVER w - chain AS hd, chain - lag(chain) OVER w AS hs, lead(v) OVER w - v AS up, v - lag(v) OVER w AS down FROM v_series WINDOW w AS ({_S})) SELECT user_id, seq, round(CASE WHEN hd IS NULL THEN down / hs WHEN hs IS NULL THEN up / hd ELSE (hs * hs * up + hd * hd * down) / (hs * hd * (hd + hs)) END, 6) AS slope FROM a",
    "resample_fixed_spacing": f"WITH a AS (SELECT user_id, seq, v, lead(v) OVER w AS v2, chain, lead(chain) OVER w AS c2, first_value(chain) OVER w AS c0 FROM v_series WINDOW w AS ({_S})), b AS (SELECT *, unnest(range(ceil((chain - c0) / 25)::BIGINT, ceil((c2 - c0) / 25)::BIGINT)) AS n FROM a WHERE c2 IS NOT NULL) SELECT user_id, n * 25e0 AS chain, round(v + (n * 25 - (chain - c0)) / (c2 - chain) * (v2 - v) + {TIE}, 6) AS v FROM b",
    "densify_segments": "WITH a AS (SELECT line_id, seq, km, lead(km) OVER (PARTITION BY line_id ORDER BY seq) AS k2 FROM v_lines), b AS (SELECT *, greatest(ceil(abs(k2 - km) / 0.5), 1)::BIGINT AS n FROM a WHERE k2 IS NOT NULL), c AS (SELECT *, unnest(range(n)) AS i FROM b) SELECT line_id, round(km + i / n * (k2 - km), 6) AS km FROM c UNION ALL SELECT line_id, round(km, 6) FROM a WHERE k2 IS NULL",
    "fill_adjacent": f"WITH a AS (SELECT *, lead(seq) OVER w AS s2, lead(az) OVER w AS az2, lead(el) OVER w AS el2, lead(km) OVER w AS km2, lead(rate) OVER w AS rate2 FROM v_lines WINDOW w AS (PARTITION BY line_id ORDER BY seq)), b AS (SELECT *, floor(round(abs(az2 - az) / 0.04::DOUBLE, 6))::BIGINT AS n FROM a WHERE rate IS NOT NULL AND rate2 IS NOT NULL AND sqrt(greatest(km * km + km2 * km2 - 2 * km * km2 * cos(radians(az2 - az)), 0)) < 15), c AS (SELECT *, unnest(range(1, n + 1)) AS i FROM b) SELECT line_id, round(az + i / (n + 1) * (az2 - az) + {TIE}, 6) AS az, round(el + i / (n + 1) * (el2 - el) + {TIE}, 6) AS el, round(least(rate, rate2), 6) AS rate FROM c",
    "zero_crossings": "WITH a AS (SELECT user_id, chain, v - 40 AS y, lead(chain) OVER w AS x2, lead(v) OVER w - 40 AS y2 FROM v_series WINDOW w AS (PARTITION BY user_id ORDER BY chain)) SELECT user_id, round(chain - y * (x2 - chain) / (y2 - y), 6) AS root FROM a WHERE (y <= 0 AND y2 > 0) OR (y >= 0 AND y2 < 0)",
    "moving_sum_full_frames": f"WITH a AS (SELECT user_id, seq, sum(v) OVER w AS t, count(*) OVER w AS n FROM v_series WINDOW w AS ({_S} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT user_id, seq, round(t, 6) AS total FROM a WHERE n = 5",
    "rolling_median_reject": f"WITH a AS (SELECT user_id, seq, v, quantile_cont(v, 0.5) OVER ({_S} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m FROM v_series) SELECT user_id, seq, round(m, 6) AS median FROM a WHERE abs(v - m) > 60",
    "local_minima": f"WITH a AS (SELECT user_id, seq, v, min(v) OVER ({_S} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, min(v) OVER ({_S} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS f FROM v_series) SELECT user_id, seq, v FROM a WHERE v < b AND v < f",
    "variogram": f"WITH {_VARIOGRAM} SELECT lag::INT AS lag, gamma, pairs FROM g",
    "grid_search_fit": f"WITH {_VARIOGRAM}, c AS (SELECT i * 0.5::DOUBLE + 1 AS length FROM range(119) r(i)), s AS (SELECT length, round(sum(pow(gamma - (SELECT max(gamma) FROM g) * (1 - exp(-lag / length)), 2)), 3) AS cost FROM g, c GROUP BY length) SELECT length, cost FROM s ORDER BY cost, length LIMIT 1",
    "autocorrelation": "WITH a AS (SELECT user_id, seq, v - avg(v) OVER (PARTITION BY user_id) AS x FROM v_series), p AS (SELECT a.user_id, k, round(sum(a.x * b.x), 3) AS p FROM a, range(1, 13) r(k), a b WHERE b.user_id = a.user_id AND b.seq = a.seq + k GROUP BY a.user_id, k), m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, k) AS o FROM p), d AS (SELECT user_id, round(avg(CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END), 6) AS duty FROM a GROUP BY user_id) SELECT d.user_id, duty, m.k::INT AS lag FROM d LEFT JOIN m ON m.user_id = d.user_id AND o = 1",
    "linear_fit": "SELECT user_id, round(regr_slope(v, chain), 6) AS slope, round(regr_intercept(v, chain), 4) AS intercept FROM v_series GROUP BY user_id",
    "poisson_binomial_tail": "WITH RECURSIVE q AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, least(v, 200) / 250 AS q, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY seq) AS i, count(*) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d')) AS n FROM v_series), r AS (SELECT user_id, day, 0::BIGINT AS i, n, [1e0] AS d FROM q WHERE i = 1 UNION ALL SELECT r.user_id, r.day, q.i, q.n, list_transform(range(len(d) + 1), lambda j: coalesce(d[j + 1], 0) * (1 - q.q) + CASE WHEN j > 0 THEN d[j] ELSE 0 END * q.q) FROM r JOIN q ON q.user_id = r.user_id AND q.day = r.day AND q.i = r.i + 1) SELECT user_id, day, round(list_sum(d[n // 2 + 2:]), 9) + 0e0 AS tail FROM r WHERE i = n",
    "poisson_binomial": "WITH q AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, least(v, 200) / 250 AS q FROM v_series) SELECT user_id, day, round(1 - exp(sum(ln(1 - q))) * (1 + sum(q / (1 - q))), 9) + 0e0 AS tail FROM q GROUP BY user_id, day",
    "occupancy": "WITH a AS (SELECT event_type, count(*) / 72e1 AS rate, avg(v) AS len FROM v_series GROUP BY event_type), b AS (SELECT *, rate / 36e2 * len * 100 / 30 AS n FROM a) SELECT event_type, round(n, 9) AS expected, round(1 - exp(-n), 9) AS \"any\", round(rate * 3, 6) AS appearances FROM b",
    "road_at_t": f"WITH {_UNDER_WAY} SELECT hour, under_way FROM n",
    "simulated_statistics": f"WITH {_UNDER_WAY} SELECT count(*) AS hours_with_any, max(under_way) AS most, round(avg(under_way), 6) AS mean_if_any FROM n",
    "night_bucket": "SELECT strftime((ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago') - INTERVAL 12 HOUR, '%Y-%m-%d') AS night, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "local_to_utc": "SELECT o_orderkey, strftime(((o_orderdate + INTERVAL 10 HOUR) AT TIME ZONE 'America/Chicago') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS utc FROM orders",
    "state_segments": f"WITH a AS (SELECT *, CASE WHEN v < 20 THEN 'dark' WHEN v < 60 THEN 'twilight' ELSE 'day' END AS state FROM v_series), b AS (SELECT *, lag(state) OVER ({_S}) AS ps, lag(v) OVER ({_S}) AS pv FROM a) SELECT user_id, sum(CASE WHEN ps = state THEN 0 ELSE 1 END)::BIGINT AS segments, min(CASE WHEN v < 20 AND pv >= 20 THEN seq END) AS first_down FROM b GROUP BY user_id",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
