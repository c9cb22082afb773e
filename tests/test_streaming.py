from pyspark.sql import functions as F

from vantage.streaming import state


def stream_of(spark, df, path, parts=2):
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drained(query_df, name, mode="append"):
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return query_df.sparkSession.sql(f"SELECT * FROM {name}")


def test_association_stream_equals_batch(spark, tmp_path):
    rows = [(b, f * 20, "A" if (b + f) % 3 else "B", 0.01 * f + b, 100.0 + f) for b in range(3) for f in range(12)]
    d = spark.createDataFrame(rows, "burst long, frame long, road string, chain double, az double")
    batch = state.association_batch(d).collect()
    stream = drained(state.association_stream(stream_of(spark, d, f"{tmp_path}/d", 1)), "assoc")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch))
    assert max(r.unit for r in batch) >= 1


def test_pose_ring_buffer(spark, tmp_path):
    d = spark.createDataFrame([(1, i, 350.0 + i * 2) for i in range(10)], "video long, frame long, az0 double")
    out = drained(state.pose_stream(stream_of(spark, d, f"{tmp_path}/p", 1), keep=3), "poses").orderBy("frame").collect()
    assert abs(out[-1].az_mean - (350 + 16) % 360) < 1e-6 and out[0].az_scatter < 1e-3


def test_night_counts_and_sessions(spark, tmp_path):
    from compare import SF

    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    night = drained(state.night_counts(stream_of(spark, e, f"{tmp_path}/e", 1)), "nights", "complete")
    assert night.agg(F.sum("events")).first()[0] == e.count()
    batch = e.groupBy("user_id", F.session_window("ts", "30 minutes")).count().count()
    runs = drained(state.sessions(stream_of(spark, e, f"{tmp_path}/s", 1), "user_id"), "runs")
    assert 0 < runs.count() <= batch


def test_append_log(spark, tmp_path):
    d = spark.createDataFrame([(1, "a")], "id int, note string")
    state.append_log(stream_of(spark, d, f"{tmp_path}/l", 1), f"{tmp_path}/log", f"{tmp_path}/cp", "field").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/log").collect()] == [(1, "a", "field")]


def test_tracker_stream_equals_batch_and_truth(spark, tmp_path):
    import numpy as np

    from vantage.kernels import fit

    rows = []
    for video in range(2):
        for frame in range(4):
            pose = (200.0 + 10 * video + frame * 0.4 + (15 if frame == 3 else 0), 0.5, 1.0, 1500.0)  # the last frame jumps
            az, el = pose[0] + np.array([-6, -3, 0, 3, 6.0]), np.array([0.2, 1.0, -0.5, 0.8, 0.1])
            x, y = fit.project(az, el, pose)
            rows += [(video, frame, *map(float, r)) for r in zip(x, y, az, el, strict=True)]
    d = spark.createDataFrame(rows, "video long, frame long, x double, y double, az double, el double")
    batch = {(r.video, r.frame): r for r in state.track_batch(d).collect()}
    for (video, frame), r in batch.items():
        assert abs(r.az0 - (200.0 + 10 * video + frame * 0.4 + (15 if frame == 3 else 0))) < 0.02 and r.rms < 0.1
    stream = {(r.video, r.frame): r for r in drained(state.track_stream(stream_of(spark, d, f"{tmp_path}/t", 1)), "tracks").collect()}
    assert stream.keys() == batch.keys() and all(abs(stream[k].az0 - batch[k].az0) < 1e-9 for k in batch)
    assert batch[0, 0].reseeded and not batch[0, 1].reseeded


def test_calibration_age_in_seconds_of_the_clock(spark):
    at = lambda rows, kind: spark.createDataFrame(rows, kind).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    found = at([(1, "2024-01-01 00:30:01.000", 10), (1, "2024-01-01 00:30:00.999", 11), (2, "2024-01-01 00:30:00.900", 12)], "device long, ts string, event_id long")
    known = at([(1, "2024-01-01 00:00:00.900", True, 5.0), (2, "2024-01-01 00:00:00.100", True, 6.0)], "device long, ts string, absolute boolean, offset double")
    assert {r.event_id: r.offset for r in state.latest_calibration(found, known).collect()} == {10: None, 11: 5.0, 12: 6.0}
