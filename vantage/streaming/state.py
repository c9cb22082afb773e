"""Structured Streaming: night counts, association of detections, pose smoothing, calibrations, append logs.

The batch forms of these operators are window functions; event-time windows and watermarks are an extension of this engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

V_MAX, SLACK_KM, SAME_FRAME_DEG = 45.0, 0.06, 0.02


def night_counts(events: DataFrame, ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """Events by night, a tumbling day that starts at noon; late rows are dropped after the watermark."""
    return events.withWatermark(ts, watermark).groupBy(F.window(ts, "1 day", startTime="12 hours").alias("night")).agg(F.count("*").alias("events"))


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Streaming islands: runs of a key's events without a longer gap."""
    return events.withWatermark(ts, watermark).groupBy(key, F.session_window(ts, gap).alias("run")).agg(F.count("*").alias("rows"))


def associate(units: list[dict], frames: pd.DataFrame) -> tuple[list[dict], list[int]]:
    """Assigns detections, in frame order, to units: of the same frame and closer than 0.02 degrees, or of the same road and near
    enough to the unit's first chainage for the time since its latest frame.  The first unit that fits wins, else a new one begins."""
    out = []
    for r in frames.sort_values(["frame", "chain"], kind="stable").itertuples():
        for i, u in enumerate(units):
            same = u["frame"] == r.frame and abs(u["az"] - r.az) < SAME_FRAME_DEG
            moved = u["road"] == r.road and u["frame"] != r.frame and abs(u["chain"] - r.chain) <= V_MAX * (abs(r.frame - u["frame"]) + 1) / 1000 + SLACK_KM
            if same or moved:
                u["frame"] = int(r.frame)
                out.append(i)
                break
        else:
            units.append({"road": r.road, "chain": float(r.chain), "az": float(r.az), "frame": int(r.frame)})
            out.append(len(units) - 1)
    return units, out


def _with_units(frames: pd.DataFrame, units: list[dict]) -> pd.DataFrame:
    frames = frames.sort_values(["frame", "chain"], kind="stable").reset_index(drop=True)
    _, number = associate(units, frames)
    return frames.assign(unit=number)


OUT = "burst long, frame long, road string, chain double, az double, unit long"


def association_batch(detections: DataFrame) -> DataFrame:
    """(burst, frame, road, chain, az, unit): the greedy rule depends on order, so each burst is one group."""
    return detections.groupBy("burst").applyInPandas(lambda f: _with_units(f[["burst", "frame", "road", "chain", "az"]], []), OUT)


def association_stream(detections: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The same over a stream whose frames arrive in order; units are state.

    With ``ttl_ms`` a burst's state goes that long after its last row; such a query never runs out of batches, so it needs a
    processing-time trigger.  Without, state stays and any trigger will do.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        units = [dict(zip(("road", "chain", "az", "frame"), u, strict=True)) for u in (zip(*state.get, strict=True) if state.exists else [])]
        yield _with_units(pd.concat(list(frames))[["burst", "frame", "road", "chain", "az"]], units)
        state.update(tuple([u[c] for u in units] for c in ("road", "chain", "az", "frame")))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    return detections.groupBy("burst").applyInPandasWithState(step, OUT, "road array<string>, chain array<double>, az array<double>, frame array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout)


POSE = "video long, frame long, az0 double, az_mean double, az_scatter double"


def pose_stream(frames: DataFrame, keep: int = 20) -> DataFrame:
    """(video, frame, az0) with the mean and scatter of the last ``keep`` bearings: a ring buffer as state, unit vectors averaged."""
    import numpy as np

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values("frame", kind="stable")
        out = []
        for r in rows.itertuples():
            ring = [*ring, float(r.az0)][-keep:]
            a = np.radians(ring)
            x, y = np.sin(a).mean(), np.cos(a).mean()
            out.append((r.video, r.frame, r.az0, float(np.degrees(np.arctan2(x, y)) % 360), float(np.degrees(np.sqrt(max(0.0, -2 * np.log(min(1.0, np.hypot(x, y)))))))))
        state.update((ring,))
        yield pd.DataFrame(out, columns=["video", "frame", "az0", "az_mean", "az_scatter"])

    return frames.groupBy("video").applyInPandasWithState(step, POSE, "ring array<double>", "append", GroupStateTimeout.NoTimeout)


RESEED_PX = 2.5
TRACK = "video long, frame long, az0 double, el0 double, roll double, focal double, rms double, reseeded boolean"


def follow(pose: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, list[tuple]]:
    """Camera poses of frames in order: each is fitted from the pose before it; where that misses by more than ``RESEED_PX`` pixels, or
    there is none, from the best of a round of bearings."""
    from ..kernels import fit

    out = []
    for frame, f in rows.sort_values("frame", kind="stable").groupby("frame"):
        x, y, az, el = (f[c].to_numpy() for c in ("x", "y", "az", "el"))
        best, rms = fit.camera_fit(x, y, az, el, pose) if pose else (None, float("inf"))
        again = rms > RESEED_PX
        if again:
            focal = pose[3] if pose else 1500.0

            def miss(seed, x=x, y=y, az=az, el=el):
                u, v = fit.project(az, el, seed)
                return float(((u - x) ** 2 + (v - y) ** 2).mean())

            seeds = sorted(((float(az.mean()) + d, 0.0, 0.0, focal) for d in range(-30, 31, 2)), key=miss)[:3]
            best, rms = min((fit.camera_fit(x, y, az, el, seed) for seed in seeds), key=lambda b: b[1])
        pose = tuple(float(v) for v in best)
        out.append((int(f["video"].iloc[0]), int(frame), *pose, rms, again))
    return pose, out


def track_batch(detections: DataFrame) -> DataFrame:
    """TRACK of each video's frames from detections (video, frame, x, y, az, el) with known directions."""
    columns = [c.split()[0] for c in TRACK.split(", ")]
    return detections.groupBy("video").applyInPandas(lambda f: pd.DataFrame(follow(None, f)[1], columns=columns), TRACK)


def track_stream(detections: DataFrame) -> DataFrame:
    """The same over a stream whose frames arrive in order and whole: the last pose is a video's state."""
    columns = [c.split()[0] for c in TRACK.split(", ")]

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pose, out = follow(tuple(state.get) if state.exists else None, pd.concat(list(parts)))
        state.update(pose)
        yield pd.DataFrame(out, columns=columns)

    return detections.groupBy("video").applyInPandasWithState(step, TRACK, "az0 double, el0 double, roll double, focal double", "append", GroupStateTimeout.NoTimeout)


def latest_calibration(observations: DataFrame, calibrations: DataFrame, ttl_minutes: int = 30) -> DataFrame:
    """Each observation (device, ts) with the latest absolute calibration offset of its device not older than the TTL, else null: one union and one window.

    Age is counted in whole seconds of the clock, as SQL's date_diff does: from 0.9 to 2.1 are 2 seconds.
    """
    from pyspark.sql import Window

    both = observations.withColumns({"_o": F.lit(1), "_cts": F.lit(None).cast("timestamp_ntz"), "_off": F.lit(None).cast("double")}).unionByName(
        calibrations.where("absolute").select("device", "ts", F.col("ts").alias("_cts"), F.col("offset").alias("_off"), F.lit(0).alias("_o")), allowMissingColumns=True
    )
    w = Window.partitionBy("device").orderBy("ts", "_o").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.withColumns({"_c": F.last("_cts", ignorenulls=True).over(w), "_v": F.last("_off", ignorenulls=True).over(w)}).where("_o = 1")
    second = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {0})"
    clock = lambda c: F.expr(f"{second.format(c)} - pmod({second.format(c)}, 1000000)")
    fresh = clock("ts") - clock("_c") <= ttl_minutes * 60_000_000
    return joined.withColumn("offset", F.when(fresh, F.col("_v"))).drop("_o", "_cts", "_off", "_c", "_v")


def append_log(rows: DataFrame, path: str, checkpoint: str, source: str):
    """Starts an append of rows with their provenance to a Parquet log; exactly once by the file sink's own log."""
    return rows.withColumn("source", F.lit(source)).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
