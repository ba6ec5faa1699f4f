"""Rolling and running measurements along a series (rolling medians, runs, unwrapping, gap filling).

Every function takes long tables keyed by ``keys`` and works on bounded chunks of a series (``functions.chunked``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.safe import div
from skyloom.functions.chunked import CHUNK, following, islands, previous, rolling, row_index, runs, scan
from skyloom.functions.joins import interval_join
from skyloom.functions.quantiles import exact_quantiles, robust_scale

V = ("video_id",)


def median(c: Column | str) -> Column:
    return F.percentile(c, F.lit(0.5))


def pad_ends(df: DataFrame, keys: Sequence[str], idx: str, half: int) -> DataFrame:
    """The series with its end rows repeated ``half`` times beyond each end (``_pad`` marks the copies)."""
    rest = [c for c in df.columns if c not in keys and c != idx]
    ends = df.groupBy(*keys).agg(
        F.min_by(F.struct(idx, *rest), idx).alias("_a"), F.max_by(F.struct(idx, *rest), idx).alias("_b")
    )
    step = F.explode(F.sequence(F.lit(1), F.lit(half))).alias("_s")
    lo = ends.select(*keys, "_a", step).select(
        *keys, (F.col(f"_a.{idx}") - F.col("_s")).alias(idx), *[F.col(f"_a.{c}").alias(c) for c in rest]
    )
    hi = ends.select(*keys, "_b", step).select(
        *keys, (F.col(f"_b.{idx}") + F.col("_s")).alias(idx), *[F.col(f"_b.{c}").alias(c) for c in rest]
    )
    return (
        df.withColumn("_pad", F.lit(False))
        .unionByName(lo.withColumn("_pad", F.lit(True)))
        .unionByName(hi.withColumn("_pad", F.lit(True)))
    )


def centred(df: DataFrame, keys: Sequence[str], idx: str, size: int, exprs, chunk: int = CHUNK) -> DataFrame:
    """Aggregates over the ``size`` rows centred on each, the end values repeated beyond the ends."""
    half = size // 2
    p = pad_ends(df, keys, idx, half)
    r = rolling(p, keys, idx, half, size - 1 - half, exprs, chunk=chunk)
    return r.where(~F.col("_pad")).drop("_pad")


def repeated_frames(stats: DataFrame, share: float = 0.2, most: float = 0.35, keys=V, chunk: int = CHUNK) -> DataFrame:
    """W1. Frames far below the local norm of change: a repeat of the frame before.  The first frame is never one."""
    d = rolling(
        stats.withColumn("_d", F.when(F.col("idx") > 1, F.col("diff"))), keys, "idx", 10, 10, {"_m": median("_d")}, chunk
    )
    return d.where((F.col("diff") < share * F.col("_m")) & (F.col("diff") < most)).select(*keys, "frame", "diff")


def contrast_transients(stats: DataFrame, frac: float = 0.35, longest: int = 40, keys=V, chunk: int = CHUNK) -> DataFrame:
    """W2. Runs of frames whose contrast collapses under ``frac`` of the 61-frame median, at most ``longest`` long."""
    d = centred(stats, keys, "idx", 61, {"_ref": median("sd")}, chunk).where(F.col("sd") < frac * F.col("_ref"))
    r = islands(d, keys, "idx", chunk=chunk).groupBy(*keys, "island").agg(
        F.min("frame").alias("first"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("n")
    )
    return r.where(F.col("n") <= longest).drop("island")


def level_jumps(stats: DataFrame, jump: float = 20.0, times: float = 5.0, keys=V, chunk: int = CHUNK) -> DataFrame:
    """W3. The mean level jumps while the change is ``times`` the 61-frame median (at least 0.5)."""
    d = stats.withColumn("_d", F.coalesce("diff", F.lit(0.0)))
    d = centred(d, keys, "idx", 61, {"_u": median("_d")}, chunk)
    return d.where((F.col("_d") >= jump) & (F.col("_d") >= times * F.greatest("_u", F.lit(0.5)))).select(
        *keys, "frame", F.col("_d").alias("step"), F.col("_u").alias("usual")
    )


def change_spikes(stats: DataFrame, times: float = 1.8, keys=V, chunk: int = CHUNK) -> DataFrame:
    """W3. Frames whose change is ``times`` the 61-frame median (at least 0.5)."""
    d = stats.withColumn("_d", F.coalesce("diff", F.lit(0.0)))
    d = centred(d, keys, "idx", 61, {"_u": median("_d")}, chunk)
    r = F.col("_d") / F.greatest("_u", F.lit(0.5))
    return d.where(r >= times).select(*keys, "frame", r.alias("times"))


def picture_steps(
    stats: DataFrame, hold: int = 8, k: float = 6.0, level: float = 3.0, share: float = 0.15, keys=V, chunk: int = CHUNK
) -> DataFrame:
    """W4. The median of ``hold`` frames from a frame against that of the ``hold`` before it, apart by ``k`` robust
    deviations of the series' own changes and by ``level`` (level) or ``share`` (contrast); in a run of such frames
    (each within ``hold`` of the last kept) the largest."""
    cols = ["level", "sd"]
    long = stats.unpivot([*keys, "frame", "idx"], cols, "what", "v")
    kk = [*keys, "what"]
    d = previous(long, kk, "idx", {"_p": F.col("v")}, chunk=chunk)
    d = d.withColumn("_dv", F.abs(F.col("v") - F.col("_p")))
    sc = robust_scale(d, kk, "_dv").select(*kk, (F.col("scale") + 1e-6).alias("_s"))
    last = long.groupBy(*kk).agg(F.max("idx").alias("_n"))
    w = rolling(long, kk, "idx", hold, -1, {"before": median("v")}, chunk)
    w = rolling(w, kk, "idx", 0, hold - 1, {"after": median("v")}, chunk)
    w = w.join(sc.join(last, kk), kk)
    size = F.abs(F.col("after") - F.col("before"))
    enough = F.when(F.col("what") == "level", F.lit(level)).otherwise(share * F.greatest("before", F.lit(1.0)))
    hit = w.where(
        (F.col("idx") > hold) & (F.col("idx") <= F.col("_n") - hold + 1) & (size >= k * F.col("_s")) & (size >= enough)
    ).withColumn("size", size)
    isl = islands(hit, kk, "idx", hold, chunk=chunk)
    best = isl.groupBy(*kk, "island").agg(
        F.max_by(F.struct("frame", "before", "after"), F.struct(F.col("size"), -F.col("idx"))).alias("b")
    )
    return best.select(*kk, "b.frame", "b.before", "b.after")


def two_window_change(series: DataFrame, w: int = 6, k: float = 8.0, keys=("video_id", "box"), chunk: int = CHUNK) -> DataFrame:
    """W6. Squared difference of the means of ``w`` readings before and from each; the log score in sigmas of the noise
    read from its 5th to 40th percentiles, once more from frames away from the first pass's changes; peaks."""
    keys = list(keys)
    d = rolling(series, keys, "idx", w, -1, {"_b": F.avg("value"), "_nb": F.count("value")}, chunk)
    d = rolling(d, keys, "idx", 0, w - 1, {"_a": F.avg("value"), "_na": F.count("value")}, chunk)
    d = d.where((F.col("_nb") == w) & (F.col("_na") == w)).withColumn("d", F.pow(F.col("_a") - F.col("_b"), 2))
    d = d.select(*keys, "frame", "idx", "d")

    def scored(use: DataFrame, over: DataFrame, name: str) -> DataFrame:
        fl = exact_quantiles(use, keys, "d", {"_f": 0.2})
        lg = use.join(fl, keys).withColumn("_l", F.log(F.col("d") + F.col("_f") + 1e-6))
        q = exact_quantiles(lg, keys, "_l", {"_p5": 0.05, "_p20": 0.2, "_p40": 0.4})
        sig = (F.col("_p40") - F.col("_p5")) / 1.39 + 1e-6
        z = (F.log(F.col("d") + F.col("_f") + 1e-6) - (F.col("_p20") + 0.84 * sig)) / sig
        return over.join(fl.join(q, keys), keys, "left").withColumn(name, z).drop("_f", "_p5", "_p20", "_p40")

    first = scored(d, d, "z1")
    flagged = rolling(first, keys, "idx", w, w, {"_near": F.max("z1")}, chunk)
    quiet = flagged.where(F.col("_near") < k).select(*keys, "idx", "d")
    nq = quiet.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nq"))
    na = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nd"))
    second = scored(quiet, first, "z2").join(nq, keys, "left").join(na, keys)
    use2 = (F.col("_nq") >= 20) & (F.col("_nq") < F.col("_nd"))
    z = second.withColumn("z", F.when(use2, F.col("z2")).otherwise(F.col("z1"))).drop("z1", "z2", "_nq", "_nd")
    pk = rolling(z, keys, "idx", w, w, {"_top": F.max("z")}, chunk)
    return pk.where((F.col("z") >= k) & (F.col("z") == F.col("_top"))).select(*keys, "frame", "d", "z")


def deviation(curve: DataFrame, fps: float, keys=("video_id", "curve"), scale: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """W7. A curve against its running mean over half a second, as a share of that mean (or of ``scale``), about 0."""
    size = max(3, int(0.5 * fps + 0.5))
    keys = list(keys)
    d = centred(curve, keys, "idx", size, {"_t": F.avg("value")}, chunk)
    d = d.withColumn("dev", div(F.col("value") - F.col("_t"), F.col(scale) if scale else F.col("_t")))
    m = d.groupBy(*keys).agg(F.avg("dev").alias("_m"))
    return d.join(m, keys).withColumn("dev", F.col("dev") - F.col("_m")).drop("_t", "_m")


def lost_frames(curve: DataFrame, fps: float, drop: float = 0.25, keys=("video_id", "curve"), chunk: int = CHUNK) -> DataFrame:
    """W8. Brightness at or below nought, or under a quarter of its running upper quartile over two seconds."""
    size = max(3, int(round(2.0 * fps)) | 1)
    d = centred(curve, list(keys), "idx", size, {"_q": F.expr("percentile(value, 0.75)")}, chunk)
    return d.withColumn("lost", (F.col("value") <= 0) | (F.col("value") < drop * F.col("_q"))).drop("_q")


def fill_gaps(points: DataFrame, cols: Sequence[str], keys: Sequence[str], frame: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """W9. A row at every frame from a series' first to its last, the missing ones on the straight line between the
    neighbours that exist.  Each row makes the rows up to the next one, so no list of all frames is ever built."""
    d = points.select(*keys, frame, *cols)
    for c in cols:
        d = d.where(F.col(c).isNotNull())
    d = following(d, keys, frame, {"_n": F.struct(frame, *cols)}, chunk=chunk)
    gap = F.coalesce(F.col(f"_n.{frame}") - F.col(frame) - 1, F.lit(0))
    d = d.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), gap.cast("long"))))
    share = F.col("_s") / (F.col(f"_n.{frame}") - F.col(frame))
    val = lambda c: F.when(F.col("_s") == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"_n.{c}") - F.col(c)) * share)
    return d.select(
        *keys, (F.col(frame) + F.col("_s")).alias(frame), *[val(c).alias(c) for c in cols], (F.col("_s") > 0).alias("filled")
    )


def smooth(points: DataFrame, cols: Sequence[str], keys: Sequence[str], size: int = 5, frame: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """W9. The gap-filled series' running mean over ``size`` frames, the end values repeated beyond the ends."""
    f = fill_gaps(points, cols, keys, frame, chunk)
    d = centred(f, list(keys), frame, size, {f"_{c}": F.avg(c) for c in cols}, chunk)
    return d.select(*keys, frame, *[F.col(f"_{c}").alias(c) for c in cols])


def unwrap_angle(df: DataFrame, keys: Sequence[str], frame: str, theta: str, out: str = "unwrapped", chunk: int = CHUNK) -> DataFrame:
    """W10. Each jump between readings taken to the nearest whole turn and the turns summed."""
    d = previous(df, keys, frame, {"_p": F.col(theta)}, chunk=chunk)
    turn = F.coalesce(-360.0 * F.rint((F.col(theta) - F.col("_p")) / 360.0), F.lit(0.0))
    d = scan(d, keys, frame, {"_t": ("sum", turn)}, chunk=chunk)
    return d.withColumn(out, F.col(theta) + F.col("_t")).drop("_p", "_t")


def windowed_mean_velocity(
    pairs: DataFrame, k: int, half: int = 15, need: int = 24, keys=V, cols=("dx", "dy"), chunk: int = CHUNK
) -> DataFrame:
    """W11. Mean step (shift over ``k`` frames, divided by k) of the pairs centred within ``half`` frames, where
    ``need`` pairs or more were measured."""
    before, after = half + k // 2, half - k // 2
    d = rolling(
        pairs, list(keys), "frame", before, after - 1,
        {**{f"v_{c}": F.avg(F.col(c) / k) for c in cols}, "n": F.count(cols[0])}, chunk,
    )
    return d.where(F.col("n") >= need).select(*keys, "frame", *[f"v_{c}" for c in cols], "n")


def repeated_median_line(
    pts: DataFrame, keys: Sequence[str], frame: str, y: str, reach: int = 45, tol: float = 3.5, chunk: int = CHUNK
) -> DataFrame:
    """W12. Siegel's line over the readings within ``reach`` frames of each: the median over readings of the median
    slope to every other; readings further than ``tol`` from it are dropped.

    The window of a reading is bounded, so the slopes are taken inside it, for the windows of an Arrow batch together; unknown
    readings count in no median."""
    seen = rolling(pts, keys, frame, reach, reach, {"_w": F.collect_list(F.struct(F.col(frame).cast("double").alias("t"), F.col(y).cast("double").alias("y")))}, chunk)
    d = seen.withColumn("_l", F.pandas_udf(_siegel, "slope double, base double")(F.col("_w.t"), F.col("_w.y")))
    miss = F.col(y) - (F.col("_l.slope") * F.col(frame) + F.col("_l.base"))
    return d.withColumn("slope", F.col("_l.slope")).withColumn("miss", miss).withColumn(
        "kept", F.coalesce(F.abs(F.col("miss")) <= tol, F.lit(True))
    ).drop("_w", "_l")


def medians(a: np.ndarray) -> np.ndarray:
    """Medians along the last axis without NaN; NaN where nothing else is."""
    s, n = np.sort(a, -1), (~np.isnan(a)).sum(-1)[..., None]  # NaN is sorted last
    at = lambda i: np.take_along_axis(s, np.clip(i, 0, a.shape[-1] - 1), -1)[..., 0]
    return (at((n - 1) // 2) + at(n // 2)) / 2


def _siegel(ts: pd.Series, ys: pd.Series) -> pd.DataFrame:
    """Slope and base of the repeated median line of each window."""
    out = np.full((len(ts), 2), np.nan)
    size = ts.map(len).to_numpy()
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        for part in np.array_split(rows, math.ceil(len(rows) * n * n / 2_000_000)):
            t, v = (np.array([c.iloc[i] for i in part], float) for c in (ts, ys))
            dt = t[:, None, :] - t[:, :, None]
            dt[dt == 0] = np.nan
            slope = medians(medians((v[:, None, :] - v[:, :, None]) / dt))
            out[part, 0], out[part, 1] = slope, medians(v - slope[:, None] * t)
    return pd.DataFrame(out, columns=["slope", "base"])


def stretches(points: DataFrame, keys: Sequence[str], gap: int, frame: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """W14. Stretches in view, cut where more than ``gap`` frames in a row are missing."""
    return runs(points, keys, frame, gap + 1, chunk=chunk)


def merge_intervals(iv: DataFrame, keys: Sequence[str], first: str = "first", last: str = "last", gap=0, chunk: int = CHUNK, pos_chunk=None) -> DataFrame:
    """W14. Intervals closer than ``gap`` joined: the running largest end tells where a new one starts."""
    d = iv.select(*keys, first, last)
    d = scan(d, keys, first, {"_m": ("max", F.col(last))}, exclusive=True, ties=[last], chunk=chunk, pos_chunk=pos_chunk)
    new = F.when(F.col("_m").isNull() | (F.col(first) - F.col("_m") > gap), 1).otherwise(0)
    d = scan(d, keys, first, {"_g": ("sum", new)}, ties=[last], chunk=chunk, pos_chunk=pos_chunk)
    return d.groupBy(*keys, "_g").agg(
        F.min(first).alias(first), F.max(last).alias(last), F.count(F.lit(1)).alias("n")
    ).drop("_g")


def cut_intervals(iv: DataFrame, gaps: DataFrame, keys: Sequence[str], shortest: int = 1, chunk: int = CHUNK) -> DataFrame:
    """W14. Windows with every gap taken out of them, pieces under ``shortest`` dropped.  The gaps are merged first;
    each window then runs from its start to the first gap, between gaps, and on to its end."""
    g = merge_intervals(gaps, keys, chunk=chunk).select(*keys, F.col("first").alias("g0"), F.col("last").alias("g1"))
    w = iv.select(*keys, "first", "last").distinct().withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("first") / 1024), F.floor(F.col("last") / 1024)))
    )
    gb = g.withColumn("_b", F.explode(F.sequence(F.floor(F.col("g0") / 1024), F.floor(F.col("g1") / 1024))))
    hit = w.join(gb, [*keys, "_b"]).where((F.col("g1") > F.col("first")) & (F.col("g0") < F.col("last")))
    hit = hit.drop("_b").distinct()
    wk = [*keys, "first", "last"]
    nxt = following(hit, wk, "g0", {"_n0": F.col("g0")}, chunk=chunk)
    after = nxt.select(*wk, F.col("g1").alias("a"), F.coalesce("_n0", "last").alias("b"))
    head = hit.groupBy(*wk).agg(F.min("g0").alias("b")).select(*wk, F.col("first").alias("a"), "b")
    whole = iv.select(*wk).distinct().join(hit.select(*wk).distinct(), wk, "left_anti").select(
        *wk, F.col("first").alias("a"), F.col("last").alias("b")
    )
    pieces = after.unionByName(head).unionByName(whole)
    return pieces.where(F.col("b") - F.col("a") >= shortest).select(*keys, F.col("a").alias("first"), F.col("b").alias("last")).distinct()


def zoom_states(bursts: DataFrame, frames: DataFrame, keys=V, chunk: int = CHUNK) -> DataFrame:
    """W15. Stretches between bursts; a burst with no step joins its two sides.  ``bursts``: first, last, is_step."""
    keys = list(keys)
    ends = frames.groupBy(*keys).agg(F.min("frame").alias("n0"), F.max("frame").alias("n1"))
    steps = bursts.where("is_step")
    starts = ends.select(*keys, F.col("n0").alias("first")).unionByName(
        steps.select(*keys, (F.col("last") + 1).alias("first"))
    )
    nxt = following(starts, keys, "first", {"_f": F.col("first")}, chunk=chunk)
    # a state ends where the next burst starts, which is known from the burst that opens the next state
    burst_start = steps.select(*keys, (F.col("last") + 1).alias("_f"), (F.col("first") - 1).alias("_end"))
    out = nxt.join(burst_start, [*keys, "_f"], "left").join(ends, keys)
    out = out.select(*keys, "first", F.coalesce("_end", "n1").alias("last"))
    return row_index(out.where(F.col("last") >= F.col("first")), keys, "first", "state", chunk=chunk)


def scene_path(pairs: DataFrame, k: int, keys=V, need: int | None = None, bridge: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """W16. The scene's path from the shifts over ``k`` frames: a step is the mean of the pairs spanning it (at least
    ``need``); a run of up to ``bridge`` unmeasured steps is drawn straight; a longer one starts a new stretch."""
    keys = list(keys)
    need = need or (k + 1) // 2
    bridge = 2 * k if bridge is None else bridge
    st = pairs.where(F.col("dx").isNotNull()).select(
        *keys, F.explode(F.sequence(F.col("frame"), F.col("frame") + k - 1)).alias("m"), "dx", "dy"
    )
    st = st.groupBy(*keys, "m").agg(
        (F.avg("dx") / k).alias("vx"), (F.avg("dy") / k).alias("vy"), F.count(F.lit(1)).alias("c")
    ).where(F.col("c") >= need)
    st = following(st, keys, "m", {"_n": F.struct("m", "vx", "vy")}, chunk=chunk)
    gap = F.coalesce(F.col("_n.m") - F.col("m") - 1, F.lit(0))
    st = st.withColumn("_g", F.when(gap <= bridge, gap).otherwise(F.lit(0)))
    st = st.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_g").cast("long"))))
    w = F.col("_s") / (F.col("_g") + 1)
    fill = lambda c: F.when(F.col("_s") == 0, F.col(c)).otherwise(F.col(c) + w * (F.col(f"_n.{c}") - F.col(c)))
    st = st.select(*keys, (F.col("m") + F.col("_s")).alias("m"), fill("vx").alias("vx"), fill("vy").alias("vy"), (F.col("_s") > 0).alias("bridged"))
    st = islands(st, keys, "m", out="stretch", chunk=chunk)
    st = scan(st, [*keys, "stretch"], "m", {"x": ("sum", F.col("vx")), "y": ("sum", F.col("vy"))}, chunk=chunk)
    return st.select(*keys, "stretch", (F.col("m") + 1).alias("frame"), "x", "y", "bridged")


def flash_runs(
    curve: DataFrame, fps: float, lo: float = 2.5, hi: float = 5.0, floor: float = 0.0, keys=("video_id", "curve"), chunk: int = CHUNK
) -> DataFrame:
    """W17. Runs over ``lo`` robust sigmas of the curve against its two-second running median that reach ``hi``, clear
    of the ends; runs closer than 0.15 s are one; centroid weighted by brightness."""
    keys = list(keys)
    size = int(round(2.0 * fps)) | 1
    d = centred(curve, keys, "idx", size, {"_m": median("value")}, chunk).withColumn("r", F.col("value") - F.col("_m"))
    sc = robust_scale(d, keys, "r").select(*keys, F.greatest("scale", F.lit(float(floor))).alias("_s"))
    sd = d.groupBy(*keys).agg(F.stddev_pop("r").alias("_sd"), F.max("idx").alias("_n"))
    d = d.join(sc.join(sd, keys), keys).withColumn("_sig", F.when(F.col("_s") > 1e-9, F.col("_s")).otherwise(F.col("_sd")))
    d = d.where(F.col("_sig") > 1e-9).withColumn("z", F.col("r") / F.col("_sig")).where(F.col("z") > lo)
    edge = max(1, int(round(0.4 * fps)))
    d = islands(d, keys, "idx", out="_run", chunk=chunk)
    r = d.groupBy(*keys, "_run", "_n").agg(
        F.min("idx").alias("first"), F.max("idx").alias("last"), F.max("z").alias("height"),
        F.sum("r").alias("_w"), F.sum(F.col("idx") * F.col("r")).alias("_wi"),
    )
    r = r.where((F.col("height") > hi) & (F.col("first") > edge) & (F.col("last") <= F.col("_n") - edge))
    # runs join where the gap between one past the last and the first is under 0.15 s
    r = previous(r, keys, "first", {"_pl": F.col("last")}, chunk=chunk)
    new = F.when(F.col("_pl").isNull() | (F.col("first") - F.col("_pl") - 1 >= 0.15 * fps), 1).otherwise(0)
    r = scan(r, keys, "first", {"_g": ("sum", new)}, chunk=chunk)
    return r.groupBy(*keys, "_g").agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        (F.sum("_wi") / F.sum("_w")).alias("centroid"), F.max("height").alias("height"),
    ).drop("_g")


def cumulative_gap_hold(held: DataFrame, slopes: Sequence[float], keys=V, chunk: int = CHUNK) -> DataFrame:
    """W25. The running count of held pictures against a line a n: the slope of the narrowest strip that holds it."""
    keys = list(keys)
    d = scan(held, keys, "idx", {"_h": ("sum", F.col("held").cast("long"))}, chunk=chunk)
    grid = F.explode(F.array(*[F.lit(float(s)) for s in slopes]))
    d = d.select(*keys, "idx", "_h", grid.alias("slope"))
    dev = F.col("_h") - F.col("slope") * F.col("idx")
    s = d.groupBy(*keys, "slope").agg((F.max(dev) - F.min(dev)).alias("width"))
    return s.groupBy(*keys).agg(F.min_by("slope", F.struct("width", "slope")).alias("slope"), F.min("width").alias("width"))


def quiet_edges(stats: DataFrame, bursts: DataFrame, fps: float, quiet: float = 2.0, search_s: float = 3.0, keys=V, chunk: int = CHUNK) -> DataFrame:
    """W5. The last good frame before each burst and the first settled one after: over three frames the change, and the
    drift of the level, within ``quiet`` times what is usual beside the burst, the contrast at least 0.6 of its median.
    ``bursts``: video_id, burst, first, last; ``stats``: idx dense, frame, diff, sd, level."""
    keys = list(keys)
    d = centred(stats, keys, "idx", 61, {"_ref": median("sd")}, chunk)
    d = rolling(d, keys, "frame", 0, 2, {"_d3": F.max("diff"), "_n3": F.count("diff"), "_l2": F.max_by("level", "frame")}, chunk)
    d = d.withColumn("drift", F.when(F.col("_n3") == 3, F.abs(F.col("_l2") - F.col("level"))))
    reach, w2 = int(round(search_s * fps)), int(round(2 * fps))
    b = bursts.select(*keys, "burst", "first", "last", (F.col("first") - max(reach, w2)).alias("_lo"), (F.col("last") + max(reach, 3 * int(fps))).alias("_hi"))
    # each burst meets the few seconds of frames beside it
    j = interval_join(d.select(*keys, "frame", "diff", "drift", "sd", "_ref", "_d3", "_n3"), b, keys, "frame", "_lo", "_hi", 512)
    pre = F.col("frame").between(F.col("first") - w2, F.col("first") - 3)
    post = F.col("frame").between(F.col("last") + int(fps), F.col("last") + 3 * int(fps) - 1)
    us = lambda c: F.greatest(F.percentile(F.when(pre, F.col(c)), F.lit(0.5)), F.percentile(F.when(post, F.col(c)), F.lit(0.5)))
    kb = [*keys, "burst"]
    q = j.groupBy(*kb).agg(us("diff").alias("_ud"), us("drift").alias("_ul"))
    g = j.join(q, kb).withColumn("q", quiet * F.coalesce("_ud", F.lit(0.0)) + 0.5).withColumn("_ql", F.greatest(F.lit(1.0), quiet * F.coalesce("_ul", F.lit(0.0))))
    good = (F.col("_n3") == 3) & (F.col("_d3") <= F.col("q")) & (F.col("drift") <= F.col("_ql")) & (F.col("sd") >= 0.6 * F.col("_ref"))
    bef = good & F.col("frame").between(F.col("first") - reach, F.col("first") - 3)
    aft = good & F.col("frame").between(F.col("last") + 1, F.col("last") + reach - 3)
    return g.groupBy(*kb, "first", "last", "q").agg(F.max(F.when(bef, F.col("frame"))).alias("before"), F.min(F.when(aft, F.col("frame"))).alias("after"))


def track_jumps(track: DataFrame, fps: float, threshold: float, floor_px: float = 0.05 * 2**0.5, back: int = 5, keys=("video_id", "object_id"), chunk: int = CHUNK) -> DataFrame:
    """W13. A track's jumps: increments from the local median rate over the local robust scale, both axes together, over
    ``threshold``.  A glitch where the next increment takes it back (or at an end), an excursion where the track is back
    within ``back`` points, else a step; of jumps whose spans overlap the first is kept.  Beyond the ends the local medians
    see the end value repeated.  Columns: idx (dense), frame, x, y."""
    keys = list(keys)
    w = 2 * max(10, int(round(fps))) + 1
    p = previous(track, keys, "idx", {"_p": F.struct("frame", "x", "y")}, chunk=chunk).where(F.col("_p").isNotNull())
    gap = F.col("frame") - F.col("_p.frame")
    d = p.select(*keys, "idx", "frame", gap.alias("g"), *[((F.col(c) - F.col(f"_p.{c}")) / gap).alias(f"v{c}") for c in "xy"])
    d = centred(d, keys, "idx", w, {f"m{c}": median(f"v{c}") for c in "xy"}, chunk)
    d = d.select(*keys, "idx", "frame", "g", *[(F.col(f"v{c}") - F.col(f"m{c}")).alias(f"r{c}") for c in "xy"])
    d = centred(d, keys, "idx", w, {f"q{c}": F.collect_list(f"r{c}") for c in "xy"}, chunk)
    mid = lambda a: (F.get(F.array_sort(a), F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int"))) / 2
    off = lambda c: F.transform(f"q{c}", lambda v: F.abs(v - F.col(f"c{c}")))
    for c in "xy":
        d = d.withColumn(f"c{c}", mid(F.col(f"q{c}")))
        d = d.withColumn(f"s{c}", 1.4826 * mid(off(c)))
    z = F.hypot(*[F.col(f"r{c}") / F.greatest(f"s{c}", F.lit(floor_px)) for c in "xy"])
    d = d.select(*keys, "idx", "frame", z.alias("L"), *[(F.col(f"r{c}") * F.col("g")).alias(f"e{c}") for c in "xy"])
    for m in range(1, back + 1):
        d = rolling(d, keys, "idx", 0, m, {f"x{m}": F.sum("ex"), f"y{m}": F.sum("ey"), f"n{m}": F.count("ex")}, chunk)
    big = F.hypot("ex", "ey")
    came = lambda m: (F.col(f"n{m}") == m + 1) & (F.hypot(f"x{m}", f"y{m}") < 0.5 * big)
    first_back = F.coalesce(*[F.when(came(m), F.lit(m)) for m in range(1, back + 1)])
    h = d.where(F.col("L") > threshold).withColumn("m", first_back)
    ends = F.col("n1") == 1
    h = h.withColumn("kind", F.when(ends | (F.col("m") == 1) | ((F.col("idx") == 2) & F.col("m").isNull()), "glitch").when(F.col("m").isNotNull(), "excursion").otherwise("step"))
    h = h.withColumn("_end", F.col("idx") + F.when(ends, 0).otherwise(F.coalesce("m", F.lit(0))))
    h = scan(h, keys, "idx", {"_reach": ("max", F.col("_end"))}, exclusive=True, chunk=chunk)
    return h.where(F.col("_reach").isNull() | (F.col("idx") > F.col("_reach"))).select(*keys, "frame", "kind", F.coalesce("m", F.lit(0)).alias("points"), big.alias("px"), "L")
