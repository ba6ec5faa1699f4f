"""Joins in time and place: intervals, nearest events, interpolation, lags between copies, own-video exclusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions.safe import corr, div
from skyloom.functions.chunked import CHUNK, previous, scan
from skyloom.functions.joins import asof, interval_join
from skyloom.functions.lineage import share


def field_at(points: DataFrame, fields: DataFrame, keys: Sequence[str], at: str = "frame", width: int = 1024) -> DataFrame:
    """J11. The value of the interval that holds a frame (or time)."""
    return interval_join(points, fields, keys, at, "first", "last", width)


def match_events(breaks: DataFrame, events: DataFrame, near: int, keys=("video_id",), width: int = 1024) -> DataFrame:
    """J12. Camera events inside a break's date interval, ``near`` frames either side."""
    b = breaks.withColumn("_lo", F.col("first") - near).withColumn("_hi", F.col("last") + near)
    return interval_join(events, b, list(keys), "frame", "_lo", "_hi", width).drop("_lo", "_hi")


def nearest_event(steps: DataFrame, events: DataFrame, near: int, keys=("video_id",), at: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """J13. Each step's nearest event either way (the earlier one at equal distance), and whether it is within ``near``."""
    e = events.select(*keys, at, F.col(at).alias("_e"))
    d = asof(steps, e, list(keys), at, {"_b": ("last", "_e"), "_a": ("next", "_e")}, chunk)
    back, ahead = F.col(at) - F.col("_b"), F.col("_a") - F.col(at)
    take_b = F.col("_a").isNull() | (back <= ahead)
    d = d.withColumn("event", F.when(take_b, F.col("_b")).otherwise(F.col("_a")))
    d = d.withColumn("distance", F.abs(F.col(at) - F.col("event")))
    return d.withColumn("at_event", F.coalesce(F.col("distance") <= near, F.lit(False))).drop("_b", "_a")


def interpolate_at(points: DataFrame, readings: DataFrame, value: str, keys: Sequence[str], at: str, chunk: int = CHUNK) -> DataFrame:
    """J14. A reading drawn straight between its neighbours at other times; none beyond its ends."""
    r = readings.select(*keys, at, F.struct(F.col(at).alias("t"), F.col(value).alias("v")).alias("_r"))
    d = asof(points, r, list(keys), at, {"_b": ("last", "_r"), "_a": ("next", "_r")}, chunk)
    span = F.col("_a.t") - F.col("_b.t")
    v = F.when(span == 0, F.col("_b.v")).otherwise(
        F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col(at) - F.col("_b.t")) / span
    )
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return d.withColumn(value, F.when(ok, v)).drop("_a", "_b")


def cameras_overlap(readings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """J17. Readings of several cameras in one table: time from the case's first reading, the cameras numbered in the
    order of their first reading, shared instants kept."""
    first = readings.groupBy("case_id", "camera").agg(F.min("t_s").alias("_f"))
    w = W.partitionBy("case_id").orderBy("_f", "camera")  # a case's cameras: a handful of rows
    cams = first.withColumn("camera_no", F.row_number().over(w)).withColumn("_t0", F.min("_f").over(W.partitionBy("case_id")))
    return readings.join(cams.drop("_f"), ["case_id", "camera"]).withColumn("t_rel", F.col("t_s") - F.col("_t0")).drop("_t0")


def leave_one_video(rows: DataFrame, cell: Sequence[str], hit: Column) -> DataFrame:
    """J22. Count and hits of each cell without the row's own video: the cell's total less the video's own."""
    own = rows.groupBy(*cell, "video_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(hit.cast("long")).alias("_k"))
    tot = own.groupBy(*cell).agg(F.sum("_n").alias("_tn"), F.sum("_k").alias("_tk"))
    return own.join(tot, list(cell)).select(
        *cell, "video_id", (F.col("_tn") - F.col("_n")).alias("others"), (F.col("_tk") - F.col("_k")).alias("hits")
    )


def best_lag(series: DataFrame, copies: DataFrame, keys=("video_id",), max_lag: int = 90, least: int = 30, chunk: int = CHUNK) -> DataFrame:
    """J23. The shift of each copy that best correlates its frame-to-frame changes with the first copy's.

    ``series`` (first copy) and ``copies`` hold video_id, frame, level (copies also copy).  Each change of the copy meets
    the 2 x max_lag + 1 frames it could line up with, and one pass of sums gives the correlation at every lag."""
    keys = list(keys)
    a = previous(series, keys, "frame", {"_p": F.struct("frame", "level")}, chunk=chunk).where(F.col("_p.frame") == F.col("frame") - 1)
    a = a.select(*keys, "frame", (F.col("level") - F.col("_p.level")).alias("da"))
    b = previous(copies, [*keys, "copy"], "frame", {"_p": F.struct("frame", "level")}, chunk=chunk).where(F.col("_p.frame") == F.col("frame") - 1)
    b = b.select(*keys, "copy", F.col("frame").alias("_f"), (F.col("level") - F.col("_p.level")).alias("db"))
    b = b.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))).withColumn("frame", F.col("_f") - F.col("lag"))
    g = a.join(b, [*keys, "frame"]).groupBy(*keys, "copy", "lag").agg(F.count(F.lit(1)).alias("n"), corr("da", "db").alias("r"))
    g = g.where((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r"))
    return g.groupBy(*keys, "copy").agg(F.max_by(F.struct("lag", "r", "n"), F.struct("r", -F.col("lag"))).alias("b")).select(
        *keys, "copy", F.col("b.lag").alias("lag"), F.col("b.r").alias("r"), F.col("b.n").alias("n")
    )


def windowed_lag(series: DataFrame, copies: DataFrame, window: int = 300, reach: int = 15, keys=("video_id",), least: int = 60) -> DataFrame:
    """J23. The lag found again in half-overlapping windows along the first copy."""
    keys = list(keys)
    half = window // 2
    win = F.explode(F.array(F.floor(F.col("frame") / half), F.floor(F.col("frame") / half) - 1))
    a = previous(series, keys, "frame", {"_p": F.struct("frame", "level")}).where(F.col("_p.frame") == F.col("frame") - 1)
    a = a.select(*keys, "frame", (F.col("level") - F.col("_p.level")).alias("da"), win.alias("win")).where(F.col("win") >= 0)
    b = previous(copies, [*keys, "copy"], "frame", {"_p": F.struct("frame", "level")}).where(F.col("_p.frame") == F.col("frame") - 1)
    b = b.select(*keys, "copy", F.col("frame").alias("_f"), (F.col("level") - F.col("_p.level")).alias("db"))
    b = b.withColumn("lag", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("frame", F.col("_f") - F.col("lag"))
    g = a.join(b, [*keys, "frame"]).groupBy(*keys, "copy", "win", "lag").agg(F.count(F.lit(1)).alias("n"), corr("da", "db").alias("r"))
    g = g.where((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r"))
    return g.groupBy(*keys, "copy", "win").agg(F.max_by(F.struct("lag", "r"), F.struct("r", -F.col("lag"))).alias("b")).select(
        *keys, "copy", "win", F.col("b.lag").alias("lag"), F.col("b.r").alias("r")
    )


def lag_steps(windows: DataFrame, good: float = 0.8, keys=("video_id", "copy")) -> DataFrame:
    """J24. Where the lag steps between windows that line up well (r >= ``good``): frames dropped or repeated."""
    d = previous(windows.where(F.col("r") >= good), list(keys), "win", {"_p": F.struct("win", "lag")})
    d = d.where(F.col("_p").isNotNull() & (F.col("_p.lag") != F.col("lag")))
    by = F.col("lag") - F.col("_p.lag")
    return d.select(
        *keys, F.col("_p.win").alias("win_before"), F.col("win").alias("win_after"), by.alias("by"),
        F.when(by > 0, "repeated or inserted").otherwise("dropped").alias("what"),
    )


def lead_lag(readings: DataFrame, path: DataFrame, lags: Sequence[int], keys=("video_id",), chunk: int = CHUNK, scene: Sequence[str] | None = None) -> DataFrame:
    """J25. Contrast of irregular increments of a reading with the scene's move over the same interval, each lag earlier:
    sum(d dX) / sqrt(sum d^2 sum dX^2); the lag of the largest size.  ``scene`` names the columns of both
    that tell whose path a reading follows, where many share one."""
    keys, scene = list(keys), list(scene or keys)
    own = [c for c in scene if c not in keys]
    r = previous(readings, keys, "frame", {"_p": F.struct("frame", "theta")}, chunk=chunk).where(F.col("_p").isNotNull())
    r = r.select(*keys, *own, F.col("_p.frame").alias("f0"), F.col("frame").alias("f1"), (F.col("theta") - F.col("_p.theta")).alias("d"))
    r = r.withColumn("lag", F.explode(F.array(*[F.lit(int(v)) for v in lags])))
    p = share(path.select(*scene, "frame", "x"))
    j = r.withColumn("frame", F.col("f1") - F.col("lag")).join(p.withColumnRenamed("x", "x1"), [*scene, "frame"])
    j = j.withColumn("frame", F.col("f0") - F.col("lag")).join(p.withColumnRenamed("x", "x0"), [*scene, "frame"])
    dx = F.col("x1") - F.col("x0")
    g = j.groupBy(*keys, "lag").agg(
        F.count(F.lit(1)).alias("n"), div(F.sum(F.col("d") * dx), F.sqrt(F.sum(F.col("d") * F.col("d")) * F.sum(dx * dx))).alias("c")
    )
    return g.where(F.col("c").isNotNull()).groupBy(*keys).agg(
        F.max_by(F.struct("lag", "c", "n"), F.struct(F.abs("c"), -F.col("lag"))).alias("b")
    ).select(*keys, "b.lag", "b.c", "b.n")


def pauses_out(units: DataFrame, pauses: DataFrame) -> DataFrame:
    """J21. Running seconds of a unit with the scheduler's pauses taken out (overlaps of the two intervals summed)."""
    u = units.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / 86400), F.floor(F.col("end") / 86400))))
    p = pauses.select(F.col("start").alias("_s"), F.col("end").alias("_e"))
    # each day's share of a pause is counted in that day's bucket, so no pause is counted twice
    p = p.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / 86400), F.floor(F.col("_e") / 86400))))
    p = p.select("_b", F.greatest("_s", F.col("_b") * 86400).alias("_s"), F.least("_e", (F.col("_b") + 1) * 86400).alias("_e"))
    o = F.greatest(F.lit(0), F.least("end", "_e") - F.greatest("start", "_s"))
    g = u.join(p, "_b").groupBy("unit_id").agg(F.sum(o).alias("_p"))
    return units.join(g, "unit_id", "left").withColumn("paused_s", F.coalesce("_p", F.lit(0))).withColumn(
        "running_s", F.col("end") - F.col("start") - F.col("paused_s")
    ).drop("_p")


def masked_share(track: DataFrame, mask: DataFrame, size: float, keys=("video_id", "object_id")) -> DataFrame:
    """J30. Share of a track's frames on mask cells."""
    m = mask.select("video_id", "cx", "cy").distinct().withColumn("_m", F.lit(1))
    t = track.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    j = t.join(m, ["video_id", "cx", "cy"], "left")
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.avg(F.coalesce("_m", F.lit(0)).cast("double")).alias("share"))


def compare_results(old: DataFrame, new: DataFrame, keys: Sequence[str], rel: float = 1e-6, tol: float = 1e-9) -> DataFrame:
    """J32. Two runs' flattened fields side by side: those one run lacks and those apart beyond the tolerances."""
    j = old.select(*keys, F.col("value").alias("old")).join(new.select(*keys, F.col("value").alias("new")), list(keys), "full_outer")
    a, b = F.expr("try_cast(old AS double)"), F.expr("try_cast(new AS double)")
    close = F.abs(a - b) <= F.greatest(F.lit(tol), rel * F.greatest(F.abs(a), F.abs(b)))
    same = F.when(a.isNotNull() & b.isNotNull(), close).otherwise(F.col("old").eqNullSafe(F.col("new")))
    return j.where(~same).withColumn(
        "what", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").otherwise("differs")
    )


def copies_table(copies: DataFrame) -> DataFrame:
    """J31. Copies side by side: frames, held frames and frames dropped against the longest span of the same video."""
    d = previous(copies, ["video_id", "copy"], "frame", {"_p": F.col("level")})
    g = d.groupBy("video_id", "copy").agg(
        F.count(F.lit(1)).alias("frames"), F.sum((F.abs(F.col("level") - F.col("_p")) < 0.5).cast("long")).alias("held"),
        F.min("frame").alias("n0"), F.max("frame").alias("n1"),
    )
    span = g.groupBy("video_id").agg((F.max("n1") - F.min("n0") + 1).alias("_span"))
    return g.join(span, "video_id").select("video_id", "copy", "frames", F.coalesce("held", F.lit(0)).alias("held"), (F.col("_span") - F.col("frames")).alias("dropped"))


def pick_detector(marks: DataFrame, cands: DataFrame, gate_px: float = 6.0, gain: float = 0.5) -> DataFrame:
    """J35. Of several detector sizes, the one whose candidates sit closest to the marks; a larger size only where it
    is ``gain`` px closer than every smaller one kept so far."""
    m = marks.select("video_id", "frame", F.col("x").alias("mx"), F.col("y").alias("my"))
    j = m.join(cands, ["video_id", "frame"]).withColumn("d", F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")))
    near = j.where(F.col("d") <= F.greatest(F.lit(gate_px), F.col("size") / 5)).groupBy("video_id", "size", "frame").agg(F.min("d").alias("d"))
    s = near.groupBy("video_id", "size").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_px"))
    w = W.partitionBy("video_id").orderBy("size")  # a handful of sizes a video
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("size", "mean_px", "n"))),
        F.struct(F.lit(None).cast("double").alias("size"), F.lit(None).cast("double").alias("mean_px"), F.lit(None).cast("long").alias("n")),
        lambda acc, v: F.when(acc["size"].isNull() | (v["mean_px"] < acc["mean_px"] - gain), F.struct(v["size"].cast("double").alias("size"), v["mean_px"].alias("mean_px"), v["n"].alias("n"))).otherwise(acc),
    )
    return s.groupBy("video_id").agg(fold.alias("b")).select("video_id", "b.size", "b.mean_px", "b.n")
