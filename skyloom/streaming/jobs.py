"""Structured Streaming jobs over live detections, frame statistics and heartbeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRACK = "video_id long, frame long, x double, y double, late boolean"
_STATE = "frame long, x double, y double, vx double, vy double"


class Follower:
    """One object followed through a video: where it was last, how fast it goes, and what that lets it be next.

    Waiting, it takes the strongest candidate of a frame; following, the candidate nearest to where its speed puts it, if that is
    inside a gate that opens with the silence; silent for more than ``patience`` frames, it waits again but keeps its speed.
    """

    def __init__(self, state: tuple | None = None, patience: int = 40, gate: tuple[float, float] = (25.0, 12.0)):
        self.last, *rest = state if state else (None, 0.0, 0.0, 0.0, 0.0)
        self.at, self.speed = np.array(rest[:2], float), np.array(rest[2:], float)
        self.patience, self.gate = patience, gate

    @property
    def state(self) -> tuple | None:
        return None if self.last is None else (self.last, *map(float, self.at), *map(float, self.speed))

    def passed(self, frame: int) -> bool:
        return self.last is not None and frame <= self.last

    def see(self, frame: int, spots: np.ndarray, strength: np.ndarray) -> np.ndarray | None:
        """The spot taken on a frame, or none.  Half of a new speed counts after a silence of up to three frames, all of it after more."""
        silence = None if self.last is None else frame - self.last
        if silence is None or silence > self.patience:
            self.last, self.at = frame, spots[strength.argmax()]
            return self.at
        miss = np.linalg.norm(spots - (self.at + silence * self.speed), axis=1)
        nearest = int(miss.argmin())
        if miss[nearest] > self.gate[0] + self.gate[1] * silence:
            return None
        fresh = (spots[nearest] - self.at) / silence
        self.speed = (self.speed + fresh) / 2 if silence <= 3 else fresh
        self.last, self.at = frame, spots[nearest]
        return self.at


def link_step(state: tuple | None, cands: pd.DataFrame, max_gap: int = 40, gate: tuple[float, float] = (25.0, 12.0)):
    """One video's candidates, frame by frame, through a ``Follower``: the new state and the points taken."""
    own, taken = Follower(state, max_gap, gate), []
    rows = cands.sort_values("frame", kind="stable")
    spots, strength = rows[["x", "y"]].to_numpy(float), rows["response"].to_numpy(float)
    frames, starts = np.unique(rows["frame"].to_numpy(), return_index=True)
    for frame, a, b in zip(frames.tolist(), starts, [*starts[1:], len(rows)], strict=True):
        if not own.passed(frame):
            spot = own.see(frame, spots[a:b], strength[a:b])
            if spot is not None:
                taken.append((frame, float(spot[0]), float(spot[1])))
    return own.state, taken


def track_linker(cands: DataFrame, max_gap: int = 40, gate: tuple[float, float] = (25.0, 12.0), seeds: Mapping[int, tuple] | None = None) -> DataFrame:
    """R1. A track a video, grown as candidates arrive (columns video_id, frame, x, y, response).

    The state is one point and a velocity; a micro-batch holds what the trigger lets in.  ``seeds`` are the starts a user marked, by
    video: (frame, x, y, vx, vy), for objects too fast to be taken up unaided.  Candidates of frames the track has passed come out
    with ``late`` set, for a side table."""
    starts = dict(seeds or {})

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun = tuple(state.get) if state.exists else starts.get(key[0])
        rows = pd.concat(list(frames))
        after, points = link_step(begun, rows, max_gap, gate)
        if after is not None:
            state.update(after)
        missed = rows[rows["frame"] <= begun[0]] if begun else rows.iloc[:0]
        told = [(key[0], *p, False) for p in points] + [(key[0], int(f), float(x), float(y), True) for f, x, y in missed[["frame", "x", "y"]].itertuples(index=False)]
        yield pd.DataFrame(told, columns=["video_id", "frame", "x", "y", "late"])

    return cands.groupBy("video_id").applyInPandasWithState(run, TRACK, _STATE, "append", GroupStateTimeout.NoTimeout)


def sessions(points: DataFrame, gap: str = "500 milliseconds", late: str = "2 seconds") -> DataFrame:
    """R2. Stretches in view: an object's points with no silence longer than ``gap``."""
    g = points.withWatermark("ts", late).groupBy("object_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n")).select("object_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def per_second_rates(pairs: DataFrame, width: str = "1 second", slide: str | None = None, late: str = "2 seconds") -> DataFrame:
    """R3. Mean rate of an object against the layer behind it in tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = pairs.withWatermark("ts", late).groupBy(w.alias("w"), "object_id")
    return g.agg(F.avg("v").alias("rate"), F.count(F.lit(1)).alias("n")).select("object_id", F.col("w.start").alias("start"), "rate", "n")


def rolling_step_alert(stats: DataFrame, hold: int = 8, least: float = 3.0) -> DataFrame:
    """R4. Steps of the picture's level as they come: the medians of ``hold`` frames before and from a frame, apart by
    ``least``.  The state is the last 2 x hold values."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fr, lv = state.get if state.exists else ([], [])
        fr, lv = list(fr), list(lv)
        out = []
        for n, v in pd.concat(list(frames)).sort_values("frame")[["frame", "level"]].itertuples(index=False):
            if fr and n <= fr[-1]:
                continue
            fr, lv = (fr + [int(n)])[-2 * hold :], (lv + [float(v)])[-2 * hold :]
            if len(lv) == 2 * hold:
                b, a = float(np.median(lv[:hold])), float(np.median(lv[hold:]))
                if abs(a - b) >= least:
                    out.append((key[0], fr[hold], b, a))
        state.update((fr, lv))
        yield pd.DataFrame(out, columns=["video_id", "frame", "before", "after"])

    return stats.groupBy("video_id").applyInPandasWithState(
        run, "video_id string, frame long, before double, after double", "frames array<long>, levels array<double>", "append", GroupStateTimeout.NoTimeout
    )


def levels_of(counts: DataFrame, probs: Sequence[float] = (0.5, 0.9, 0.99), grain: float = 1.0) -> DataFrame:
    """R5. Levels read off ``running_noise_levels``' counts: for each stratum and bin, the upper edge of the slot that each share of
    the values is reached in.  A bin's slots are one row each, however many values they hold."""
    w = Window.partitionBy("stratum", "bin").orderBy("slot")
    run = counts.withColumn("_c", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = counts.groupBy("stratum", "bin").agg(F.sum("n").alias("values"))
    edge = lambda p: F.min(F.when(F.col("_c") >= p * F.col("values"), (F.col("slot") + 1) / grain)).alias(f"p{round(100 * p)}")
    return run.join(total, ["stratum", "bin"]).groupBy("stratum", "bin", "values").agg(*[edge(p) for p in probs])


def running_noise_levels(backgrounds: DataFrame, grain: float = 1.0) -> DataFrame:
    """R5. Histogram counts of the backgrounds' values by stratum and bin as videos arrive (update mode); levels are read
    off the counts (``levels_of``), the exact ones recomputed from the table."""
    return backgrounds.groupBy("stratum", "bin", F.floor(F.col("value") * grain).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def progress_status(beats: DataFrame) -> DataFrame:
    """R6. The last heartbeat and state of every unit: one row of state a unit, whose number the batch of units bounds."""
    return beats.groupBy("unit_id").agg(F.max("ts").alias("last"), F.max_by("state", "ts").alias("state"))


def judged(status: DataFrame, now, stale_s: int = 600) -> DataFrame:
    """R6. done, failed and stopped as said; running with no heartbeat for ``stale_s`` is stalled."""
    old = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("last") > stale_s
    return status.withColumn("state", F.when((F.col("state") == "running") & old, "stalled").otherwise(F.col("state")))


def dedupe_late(points: DataFrame, late: str = "2 seconds") -> DataFrame:
    """R8. A repeated frame within the watermark is dropped."""
    return points.withWatermark("ts", late).dropDuplicatesWithinWatermark(["video_id", "object_id", "frame"])


def split_late(batch: DataFrame, emitted: DataFrame, keys=("video_id", "object_id")) -> tuple[DataFrame, DataFrame]:
    """R8. Points after the last emitted frame of their object, and those that come too late (for a side table)."""
    last = emitted.groupBy(*keys).agg(F.max("frame").alias("_last"))
    j = batch.join(last, list(keys), "left")
    late = F.col("_last").isNotNull() & (F.col("frame") <= F.col("_last"))
    return j.where(~late).drop("_last"), j.where(late).drop("_last")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there to ``path``.  A batch's files go to its own folder and are written again whole
    when it is retried; in complete mode the last batch is the result."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/result" if mode == "complete" else f"{path}/batch={batch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{path}/result" if mode == "complete" else f"{path}/batch=*")


def partial_lists(stream: DataFrame, path: str, checkpoint: str, show: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """R7. The list made again after every block from all that has come so far."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/seen/batch={batch}")
        seen = df.sparkSession.read.schema(stream.schema).parquet(f"{path}/seen/batch=*")
        show(seen).write.mode("overwrite").parquet(f"{path}/list")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/list")
