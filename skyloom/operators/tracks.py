"""Tracks: rates, pairings of tracks with each other and with truth, places on the screen, members of a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions.safe import corr, div
from skyloom.functions.chunked import CHUNK, rolling, scan
from skyloom.functions.joins import near_pairs
from skyloom.functions.lineage import cut, share
from skyloom.functions.quantiles import SMALL, exact_quantiles, largest_group

KEY = ("video_id", "object_id")


def add_time(points: DataFrame, video: DataFrame, frame: str = "frame") -> DataFrame:
    """P1. Wall-clock time of a frame from the exact rational rate."""
    rate = video.select("video_id", "fps_num", "fps_den")
    return points.join(rate, "video_id").withColumn("t_s", (F.col(frame) - 1) * F.col("fps_den") / F.col("fps_num")).drop(
        "fps_num", "fps_den"
    )


def at_offset(df: DataFrame, keys: Sequence[str], pos: str, k: int, cols: dict[str, str], chunk: int = CHUNK) -> DataFrame:
    """The values at exactly ``pos - k`` (null where that position has no row)."""
    return rolling(df, keys, pos, k, -k, {out: F.max(c) for out, c in cols.items()}, chunk=chunk)


def fit_rate(
    points: DataFrame,
    keys: Sequence[str] = KEY,
    sigma: float = 4.0,
    rounds: int = 4,
    min_points: int = 3,
    held_span: float = 5.0,
    held_floor: float = 0.1,
    chunk: int = CHUNK,
) -> DataFrame:
    """A3. Straight-line velocity of every track against wall-clock time (``t_s``), all tracks at once.

    A round fits both axes from sums, takes the median and the median absolute deviation of the residuals on each axis
    and drops the points beyond max(sigma robust deviations, 2 px) on either; a track with fewer than ``min_points``
    left is left out.  Rounds stop when no point of any track is dropped."""
    keys = list(keys)
    pts = share(points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, "frame", "t_s", "x", "y"))
    n_in = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_in")).where(F.col("n_in") >= min_points)
    largest = largest_group(pts, keys)
    line = lambda d: d.groupBy(*keys).agg(
        F.regr_slope("x", "t_s").alias("vx"), F.regr_intercept("x", "t_s").alias("x0"),
        F.regr_slope("y", "t_s").alias("vy"), F.regr_intercept("y", "t_s").alias("y0"), F.count(F.lit(1)).alias("n"),
    )
    rx, ry = F.col("x") - (F.col("vx") * F.col("t_s") + F.col("x0")), F.col("y") - (F.col("vy") * F.col("t_s") + F.col("y0"))
    if largest <= SMALL:
        kept = share(_clip_by_window(pts, keys, sigma, rounds, min_points))
    else:
        kept = _clip_by_join(pts, keys, line, rx, ry, sigma, rounds, min_points, largest)
    fit = line(kept).where(F.col("n") >= min_points)
    full = kept.join(fit, keys)
    ends = full.groupBy(*keys).agg(
        F.sqrt(F.avg(rx * rx + ry * ry)).alias("resid_rms"), F.min("t_s").alias("t0"), F.max("t_s").alias("t1"),
        F.min_by(F.struct("x", "y"), "frame").alias("_a"), F.max_by(F.struct("x", "y"), "frame").alias("_b"),
    )
    noise = position_noise(kept, keys, chunk, largest)
    out = fit.join(n_in, keys).join(ends, keys).join(noise, keys, "left")
    span = F.hypot(F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y"))
    out = out.withColumn("span_px", span)
    held = (F.col("span_px") < held_span) & F.col("noise_px").isNotNull() & (
        F.col("resid_rms") <= F.greatest(F.lit(2.0 * 2.0**0.5) * F.col("noise_px"), F.lit(held_floor))
    )
    out = out.withColumn("held", F.coalesce(held, F.lit(False)))
    frac = F.when(F.col("span_px") > 0, F.col("resid_rms") / F.col("span_px"))
    return out.select(
        *keys,
        F.hypot("vx", "vy").alias("v_px"), "vx", "vy",
        F.pmod(F.degrees(F.atan2(F.col("vx"), -F.col("vy"))), F.lit(360.0)).alias("direction_deg"),
        "resid_rms", "n", "n_in", (F.col("n_in") - F.col("n")).alias("n_clipped"), "t0", "t1", "span_px",
        frac.alias("resid_frac"), "noise_px", "held",
        (F.coalesce(frac < 0.05, F.lit(False)) | F.col("held")).alias("uniform"),
    )


def _clip_by_window(pts: DataFrame, keys: list[str], sigma: float, rounds: int, min_points: int) -> DataFrame:
    """Tracks that each fit a task (counted before): every round reads whole-track windows over one partitioning, so
    all the rounds share one shuffle and one sort."""
    w = W.partitionBy(*keys)
    d = pts
    for _ in range(rounds):
        d = d.select(*keys, "frame", "t_s", "x", "y", F.count(F.lit(1)).over(w).alias("_n"), *[
            f(c, "t_s").over(w).alias(f"_{n}{c}") for c in ("x", "y") for n, f in (("v", F.regr_slope), ("i", F.regr_intercept))])
        d = d.select("*", *[(F.col(c) - (F.col(f"_v{c}") * F.col("t_s") + F.col(f"_i{c}"))).alias(f"_r{c}") for c in ("x", "y")])
        d = d.select("*", *[F.abs(F.col(f"_r{c}") - F.percentile(f"_r{c}", F.lit(0.5)).over(w)).alias(f"_d{c}") for c in ("x", "y")])
        d = d.select("*", *[F.percentile(f"_d{c}", F.lit(0.5)).over(w).alias(f"_s{c}") for c in ("x", "y")])
        ok = lambda c: F.col(f"_d{c}") < F.greatest(F.lit(sigma * 1.4826) * F.col(f"_s{c}"), F.lit(2.0))
        d = d.where((F.col("_n") >= min_points) & ok("x") & ok("y"))
    return d.select(*keys, "frame", "t_s", "x", "y")


def _clip_by_join(pts, keys, line, rx, ry, sigma, rounds, min_points, largest) -> DataFrame:
    """Tracks of any length: sums and bracketed quantiles per round, joined back; stops when nothing is dropped."""
    kept = pts
    for _ in range(rounds):
        res = share(
            kept.join(line(kept), keys).where(F.col("n") >= min_points)
            .select(*keys, "frame", "t_s", "x", "y", rx.alias("rx"), ry.alias("ry"))
        )
        long = res.unpivot([*keys, "frame"], ["rx", "ry"], "axis", "r")
        med = exact_quantiles(long, [*keys, "axis"], "r", {"m": 0.5}, largest=largest)
        dev = long.join(med, [*keys, "axis"]).withColumn("d", F.abs(F.col("r") - F.col("m")))
        mad = exact_quantiles(dev, [*keys, "axis"], "d", {"s": 0.5}, largest=largest)
        both = med.join(mad, [*keys, "axis"]).groupBy(*keys).agg(
            *[F.max(F.when(F.col("axis") == a, F.col(c))).alias(f"{c}_{a}") for a in ("rx", "ry") for c in ("m", "s")]
        )
        off = lambda a: F.abs(F.col(a) - F.col(f"m_{a}")) < F.greatest(F.lit(sigma * 1.4826) * F.col(f"s_{a}"), F.lit(2.0))
        judged = share(res.join(both, keys).withColumn("ok", off("rx") & off("ry")).select(*keys, "frame", "t_s", "x", "y", "ok"))
        kept = judged.where("ok").drop("ok")
        if judged.where("not ok").isEmpty():
            break
    return kept


def position_noise(points: DataFrame, keys: Sequence[str], chunk: int = CHUNK, largest: int | None = None) -> DataFrame:
    """Jitter of a track's positions from second differences on three consecutive frames, both axes together."""
    keys = list(keys)
    p = points.select(*keys, "frame", F.struct("x", "y").alias("p"))
    p = at_offset(p, keys, "frame", 1, {"p1": "p"}, chunk)
    p = at_offset(p, keys, "frame", 2, {"p2": "p"}, chunk).where(F.col("p1").isNotNull() & F.col("p2").isNotNull())
    d2 = lambda c: F.col(f"p.{c}") - 2 * F.col(f"p1.{c}") + F.col(f"p2.{c}")
    d = share(p.select(*keys, F.explode(F.array(d2("x"), d2("y"))).alias("d2")))
    largest = None if largest is None else 2 * largest
    enough = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 6).drop("_n")
    med = exact_quantiles(d, keys, "d2", {"_m": 0.5}, largest=largest)
    mad = exact_quantiles(d.join(med, keys).withColumn("_d", F.abs(F.col("d2") - F.col("_m"))), keys, "_d", {"_s": 0.5}, largest=largest)
    return enough.join(mad, keys).select(*keys, (1.4826 * F.col("_s") / 6.0**0.5).alias("noise_px"))


# ---- pairings ---------------------------------------------------------------------------------------------------------
def track_pairs(tracks: DataFrame, near_px: float = 2.0, frames: int = 10, share_: float = 0.5) -> DataFrame:
    """J1. Pairs of objects of a video within ``near_px`` on ``frames`` frames or more and on ``share_`` of the frames
    both were followed on.  Only points near each other are paired (grid cells); the frames two objects share are then
    counted for those pairs alone."""
    t = tracks.select("video_id", "object_id", "frame", "x", "y")
    near = near_pairs(t, t, ["video_id", "frame"], "x", "y", near_px).where(F.col("object_id") < F.col("object_id_2"))
    on = near.groupBy("video_id", F.col("object_id").alias("a"), F.col("object_id_2").alias("b")).agg(
        F.count(F.lit(1)).alias("on")
    ).where(F.col("on") >= frames)
    on = share(on)
    fa = on.join(t.select("video_id", F.col("object_id").alias("a"), "frame"), ["video_id", "a"])
    both = fa.join(t.select("video_id", F.col("object_id").alias("b"), "frame"), ["video_id", "b", "frame"])
    n = both.groupBy("video_id", "a", "b").agg(F.first("on").alias("on"), F.count(F.lit(1)).alias("shared"))
    return n.where(F.col("on") >= share_ * F.col("shared"))


def greedy_keep(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Which nodes a first-come fold keeps: in order of ``prio`` (equal ones by id), a node is dropped when
    it matches one already kept.  Each round settles every node whose better matches are all settled; the rounds are as
    many as the longest chain of matches.  Columns: video_id, id, prio; edges video_id, a, b (either order)."""
    # every side grows with the data, and rounds of broadcasts would pile up on the driver: all joins are by sorting
    e = edges.select("video_id", F.col("a"), F.col("b")).hint("merge")
    pr = nodes.select("video_id", "id", "prio")
    e = e.join(pr.select("video_id", F.col("id").alias("a"), F.struct("prio", "id").alias("pa")), ["video_id", "a"]).hint("merge").join(
        pr.select("video_id", F.col("id").alias("b"), F.struct("prio", "id").alias("pb")), ["video_id", "b"]
    )
    e = share(e.select("video_id", F.when(F.col("pa") < F.col("pb"), F.col("a")).otherwise(F.col("b")).alias("hi"),
                       F.when(F.col("pa") < F.col("pb"), F.col("b")).otherwise(F.col("a")).alias("lo")).distinct())
    state = cut(pr.hint("merge").join(e.select("video_id", F.col("lo").alias("id")).distinct(), ["video_id", "id"], "left_anti").select(
        "video_id", "id", F.lit("kept").alias("state")))
    todo = cut(e)
    while not todo.isEmpty():
        j = todo.hint("merge").join(state.select("video_id", F.col("id").alias("hi"), "state"), ["video_id", "hi"], "left")
        per = j.groupBy("video_id", "lo").agg(
            F.bool_or(F.col("state") == "kept").alias("k"), F.bool_and(F.coalesce(F.col("state") == "dropped", F.lit(False))).alias("d")
        )
        new = per.where(F.coalesce("k", F.lit(False)) | F.col("d")).select(
            "video_id", F.col("lo").alias("id"), F.when(F.coalesce("k", F.lit(False)), "dropped").otherwise("kept").alias("state")
        )
        state = cut(state.unionByName(new))
        todo = cut(todo.hint("merge").join(state.select("video_id", F.col("id").alias("lo")), ["video_id", "lo"], "left_anti"))
    return pr.hint("merge").join(state, ["video_id", "id"])


def same_track(tracks: DataFrame, prio: DataFrame, near_px: float = 2.0, frames: int = 10) -> DataFrame:
    """J1. The objects on the same thing as a kept one, and which (the one it is on most)."""
    return same_track_from(track_pairs(tracks, near_px, frames), prio)


def same_track_from(pairs: DataFrame, prio: DataFrame) -> DataFrame:
    """J1. The same, from pairs already counted."""
    pairs = share(pairs)
    kept = share(greedy_keep(prio, pairs))
    k = kept.where(F.col("state") == "kept").select("video_id", F.col("id").alias("k"), F.col("prio").alias("kp"))
    d = kept.where(F.col("state") == "dropped").select("video_id", F.col("id").alias("object_id"), F.col("prio").alias("dp"))
    ab = pairs.select("video_id", F.col("a").alias("object_id"), F.col("b").alias("k"), "on", "shared").unionByName(
        pairs.select("video_id", F.col("b").alias("object_id"), F.col("a").alias("k"), "on", "shared")
    )
    m = d.join(ab, ["video_id", "object_id"]).join(k, ["video_id", "k"]).where(F.col("kp") < F.col("dp"))
    return m.groupBy("video_id", "object_id").agg(
        F.min_by(F.struct("k", "on", "shared"), F.struct(-F.col("on"), F.col("kp"))).alias("m")
    ).select("video_id", "object_id", F.col("m.k").alias("same_as"), "m.on", "m.shared")


def on_path(found: DataFrame, truth: DataFrame, px: float = 12.0, share_: float = 0.7) -> DataFrame:
    """J3. Found rows on planted paths: more than ``share_`` of the frames they share within max(px, size/3), two or
    more.  ``found``: video_id, row_id, size_px, frame, x, y; ``truth``: video_id, truth_id, frame, x, y."""
    t = truth.select("video_id", "truth_id", "frame", F.col("x").alias("tx"), F.col("y").alias("ty"))
    j = found.join(t, ["video_id", "frame"])
    d = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    within = d <= F.greatest(F.lit(px), F.col("size_px") / 3.0)
    # a row's shared frames with one truth are at most the truth's frames on screen: an ordinary group
    g = j.groupBy("video_id", "row_id", "truth_id").agg(
        F.count(F.lit(1)).alias("shared"), F.avg(within.cast("double")).alias("within"), F.percentile(d, F.lit(0.5)).alias("px")
    )
    return g.where((F.col("shared") >= 2) & (F.col("within") > share_))


def recovered(pairs: DataFrame, truth_ids: DataFrame, ranks: DataFrame) -> DataFrame:
    """J3. Each planted object with the best-ranked row on its path, and that rank with the rows above it that are on
    planted paths set aside.  ``ranks``: video_id, row_id, rank."""
    j = share(pairs.join(ranks, ["video_id", "row_id"]))
    best = j.groupBy("video_id", "truth_id").agg(F.min_by(F.struct("row_id", "rank", "shared", "px"), "rank").alias("b"))
    taken = j.select("video_id", "rank").distinct()
    # rows taken above each rank: ranks are a small ordered list per video
    above = taken.withColumn("above", F.row_number().over(W.partitionBy("video_id").orderBy("rank")) - 1)
    r = truth_ids.select("video_id", "truth_id").join(best, ["video_id", "truth_id"], "left")
    r = r.select("video_id", "truth_id", F.col("b").isNotNull().alias("found"), "b.rank", "b.shared", "b.px")
    return r.join(above, ["video_id", "rank"], "left").withColumn("rank_alone", F.col("rank") - F.col("above")).drop("above")


def truth_pairs(tracks: DataFrame, boxes: DataFrame, pad: float = 2.0, frames: int = 10) -> DataFrame:
    """J4. Objects on labelled boxes (within the half-size plus ``pad`` on each axis) on ``frames`` frames and half."""
    j = tracks.join(boxes, ["video_id", "frame"])
    on = (F.abs(F.col("x") - F.col("bx")) <= F.col("hw") + pad) & (F.abs(F.col("y") - F.col("by")) <= F.col("hh") + pad)
    g = j.groupBy("video_id", "object_id", "truth_id").agg(F.sum(on.cast("long")).alias("on"), F.count(F.lit(1)).alias("shared"))
    return g.where((F.col("on") >= frames) & (2 * F.col("on") >= F.col("shared")))


def match_truth(pairs: DataFrame) -> DataFrame:
    """J4. One-to-one matches, longest overlap first (ties by ids): pairs best on both sides are kept, both are taken
    out, and again until none is left.  ``pairs``: video_id, object_id, truth_id, on, shared."""
    todo = cut(pairs)
    parts: list[DataFrame] = []
    order = F.struct("on", -F.col("object_id"), -F.col("truth_id"))
    while not todo.isEmpty():
        bo = todo.groupBy("video_id", "object_id").agg(F.max(order).alias("_o"))
        bt = todo.groupBy("video_id", "truth_id").agg(F.max(order).alias("_t"))
        j = todo.join(bo, ["video_id", "object_id"]).join(bt, ["video_id", "truth_id"])
        got = cut(j.where((order == F.col("_o")) & (order == F.col("_t"))).select(*pairs.columns))
        parts.append(got)
        if len(parts) > 10:
            parts = [cut(reduce(DataFrame.unionByName, parts))]
        todo = cut(
            todo.join(got.select("video_id", "object_id"), ["video_id", "object_id"], "left_anti").join(
                got.select("video_id", "truth_id"), ["video_id", "truth_id"], "left_anti"
            )
        )
    return reduce(DataFrame.unionByName, parts) if parts else todo


# ---- places -----------------------------------------------------------------------------------------------------------
def fixed_on_sensor(spots: DataFrame, tol: float = 1.0, share_: float = 0.5, least: int = 2) -> DataFrame:
    """J8. Spots at one place (within ``tol``) on ``share_`` of the video's frames or more.  The frames of a spot's
    neighbourhood are counted by cell before spots are compared: only cells seen on enough frames are looked into."""
    s = spots.select("video_id", "frame", "x", "y")
    frames = s.groupBy("video_id").agg(F.count_distinct("frame").alias("_nf"))
    cell = s.select("video_id", "frame", F.floor(F.col("x") / tol).alias("cx"), F.floor(F.col("y") / tol).alias("cy")).distinct()
    offs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = cell.withColumn("o", offs).select("video_id", "frame", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy")).distinct()
    busy = around.groupBy("video_id", "cx", "cy").agg(F.count(F.lit(1)).alias("_k")).join(frames, "video_id")
    busy = busy.where((F.col("_k") >= least) & (F.col("_k") >= share_ * F.col("_nf"))).select("video_id", "cx", "cy", "_nf")
    # distinct places (many frames report the same pixel) are compared with distinct places near them
    place = s.withColumn("cx", F.floor(F.col("x") / tol)).withColumn("cy", F.floor(F.col("y") / tol)).select("video_id", "x", "y", "cx", "cy").distinct()
    place = share(place.join(busy, ["video_id", "cx", "cy"], "left_semi").select("video_id", "x", "y"))
    pairs = near_pairs(s.withColumnRenamed("frame", "f"), place, ["video_id"], "x", "y", tol)
    n = pairs.groupBy("video_id", F.col("x_2").alias("x"), F.col("y_2").alias("y")).agg(F.count_distinct("f").alias("frames"))
    return n.join(frames, "video_id").where((F.col("frames") >= least) & (F.col("frames") >= share_ * F.col("_nf"))).drop("_nf")


def stays_put(spots: DataFrame, box: float, least: int, share_: float, most_screen: float = 1.0, cells_on_screen: int | None = None) -> DataFrame:
    """J9. Cells of the screen where, with their eight neighbours, a spot falls on max(least, share x frames with any)."""
    s = spots.select("video_id", "frame", F.floor(F.col("x") / box).alias("cx"), F.floor(F.col("y") / box).alias("cy")).distinct()
    nf = s.groupBy("video_id").agg(F.count_distinct("frame").alias("_nf"))
    offs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    d = s.withColumn("o", offs).select("video_id", "frame", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy")).distinct()
    c = d.groupBy("video_id", "cx", "cy").agg(F.count(F.lit(1)).alias("frames")).join(nf, "video_id")
    c = c.where(F.col("frames") >= F.greatest(F.lit(float(least)), share_ * F.col("_nf"))).drop("_nf")
    if cells_on_screen:
        few = c.groupBy("video_id").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") <= most_screen * cells_on_screen)
        c = c.join(few.select("video_id"), "video_id")
    return c


# ---- members and companions -------------------------------------------------------------------------------------------
def pairwise_members(tracks: DataFrame, least: int = 10) -> DataFrame:
    """J26. Every pair of members of a group seen together on ``least`` frames: mean separation, and how far it wanders
    about its own straight line on both axes.  A group is a handful of members; the pairs are of one frame's members."""
    t = tracks.select("video_id", "object_id", "frame", "t_s", "x", "y")
    o = t.select("video_id", F.col("object_id").alias("object_2"), "frame", F.col("x").alias("x2"), F.col("y").alias("y2"))
    j = t.join(o, ["video_id", "frame"]).where(F.col("object_id") < F.col("object_2"))
    j = j.select("video_id", "object_id", "object_2", "t_s", (F.col("x2") - F.col("x")).alias("dx"), (F.col("y2") - F.col("y")).alias("dy"))
    var = lambda c: F.var_pop(c) * (1 - F.coalesce(F.pow(corr(c, "t_s"), 2), F.lit(0.0)))
    return j.groupBy("video_id", "object_id", "object_2").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.hypot("dx", "dy")).alias("mean_px"),
        F.min(F.hypot("dx", "dy")).alias("min_px"), F.max(F.hypot("dx", "dy")).alias("max_px"),
        F.sqrt(var("dx") + var("dy")).alias("wander_px"),
    ).where(F.col("n") >= least)


def common_frames_velocity(tracks: DataFrame, main: DataFrame, least: int = 10) -> DataFrame:
    """J27. Each track against its video's main one over the frames both have: velocity of the difference."""
    m = main.select("video_id", "frame", F.col("x").alias("mx"), F.col("y").alias("my"), F.col("object_id").alias("_m"))
    j = tracks.join(m, ["video_id", "frame"]).where(F.col("object_id") != F.col("_m"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    g = j.withColumn("dx", dx).withColumn("dy", dy).groupBy("video_id", "object_id").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("dx", "t_s").alias("vx"), F.regr_slope("dy", "t_s").alias("vy")
    )
    return g.where(F.col("n") >= least).withColumn("v", F.hypot("vx", "vy"))


def with_group(point: DataFrame, track: DataFrame, bg: DataFrame) -> DataFrame:
    """J28. Whether a followed point moves with the track rather than with the background: the summed steps of the
    difference.  All three: video_id, frame, x, y (``point`` also object_id)."""
    r = lambda d, n: d.select("video_id", "frame", F.struct("x", "y").alias(n))
    j = point.select("video_id", "object_id", "frame", F.struct("x", "y").alias("p")).join(r(track, "t"), ["video_id", "frame"]).join(
        r(bg, "b"), ["video_id", "frame"]
    )
    step = at_offset(j.withColumn("q", F.struct("p", "t", "b")), ["video_id", "object_id"], "frame", 1, {"q1": "q"}).where(F.col("q1").isNotNull())
    d = lambda o: F.hypot(
        (F.col("p.x") - F.col(f"{o}.x")) - (F.col("q1.p.x") - F.col(f"q1.{o}.x")),
        (F.col("p.y") - F.col(f"{o}.y")) - (F.col("q1.p.y") - F.col(f"q1.{o}.y")),
    )
    g = step.groupBy("video_id", "object_id").agg(F.sum(d("t")).alias("to_track"), F.sum(d("b")).alias("to_background"), F.count(F.lit(1)).alias("steps"))
    return g.withColumn("with_track", F.col("to_track") < F.col("to_background"))


def relative_to_scene(track: DataFrame, scene: DataFrame) -> DataFrame:
    """P11. The track less the scene's path at the same frame."""
    s = scene.select("video_id", "frame", F.col("x").alias("_sx"), F.col("y").alias("_sy"))
    return track.join(s, ["video_id", "frame"]).withColumn("x", F.col("x") - F.col("_sx")).withColumn("y", F.col("y") - F.col("_sy")).drop("_sx", "_sy")


def second_difference_jitter(points: DataFrame, keys: Sequence[str] = KEY, lags: int = 4, chunk: int = CHUNK) -> DataFrame:
    """A5. Jitter of consecutive frames' positions from second differences: variance -gamma1/4, rho1, and the largest
    over lags k of sqrt((g0-gk)/10)."""
    keys = list(keys)
    long = points.unpivot([*keys, "frame"], ["x", "y"], "axis", "v")
    k2 = [*keys, "axis"]
    p = at_offset(at_offset(long, k2, "frame", 1, {"v1": "v"}, chunk), k2, "frame", 2, {"v2": "v"}, chunk)
    d = share(p.where(F.col("v1").isNotNull() & F.col("v2").isNotNull()).select(*k2, "frame", (F.col("v") - 2 * F.col("v1") + F.col("v2")).alias("d2")))
    m = d.groupBy(*k2).agg(F.avg("d2").alias("_m"))
    d = share(d.join(m, k2).withColumn("d", F.col("d2") - F.col("_m")).drop("_m", "d2"))
    w = d
    for k in range(1, lags + 1):
        w = at_offset(w, k2, "frame", k, {f"d_{k}": "d"}, chunk)
    g = w.groupBy(*k2).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("d") * F.col("d")).alias("g0"),
        *[F.avg(F.col("d") * F.col(f"d_{k}")).alias(f"g{k}") for k in range(1, lags + 1)],
    )
    jit = F.greatest(*[F.sqrt(F.greatest((F.col("g0") - F.col(f"g{k}")) / 10.0, F.lit(0.0))) for k in range(1, lags + 1)])
    return g.select(*k2, "n", (-F.col("g1") / 4).alias("jitter_var"), div(F.col("g1"), F.col("g0")).alias("rho1"), jit.alias("jitter"))


# ---- lists ------------------------------------------------------------------------------------------------------------
def video_windows(videos: DataFrame, window: int = 400, overlap: int = 30) -> DataFrame:
    """T1. Windows of ``window`` frames overlapping by ``overlap``; the last one ends on the last frame."""
    step = window - overlap
    n = F.ceil((F.greatest(F.lit(2), F.col("n_frames") - overlap) - 1) / F.lit(step)).cast("long")
    starts = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: i * step + 1)
    last_end = F.element_at(starts, -1) + window - 1
    tail = F.array(F.greatest(F.lit(1), F.col("n_frames") - window + 1).cast("long"))
    starts = F.when(last_end < F.col("n_frames"), F.concat(starts, tail)).otherwise(starts)
    d = videos.select("video_id", "n_frames", F.posexplode(starts).alias("win", "first"))
    return d.select("video_id", "win", "first", F.least(F.col("first") + window - 1, F.col("n_frames")).alias("last"))


def top_n(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column], salt: Column, parts: int = 64) -> DataFrame:
    """T1, T2, T4. The ``n`` best rows per key: first the best of each of ``parts`` slices of a key, then of those, so a
    hot key's rows are never sorted in one task."""
    w1 = W.partitionBy(*keys, "_p").orderBy(*order)
    w2 = W.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_p", F.pmod(F.xxhash64(salt), F.lit(parts)))
    d = d.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n).drop("_p", "_r")
    return d.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= n)


def shortlist(props: DataFrame, score: str, ident: str, most: int = 8, always: int = 3, share_: float = 0.25) -> DataFrame:
    """T3. The best three whatever they score and any within a quarter of the best, at most eight."""
    d = top_n(props, ["video_id"], most, [F.col(score).desc(), F.col(ident)], F.col(ident))
    best = F.max(score).over(W.partitionBy("video_id"))
    return d.withColumn("_b", best).where((F.col("rank") <= always) | (F.col(score) >= share_ * F.col("_b"))).drop("_b")


def union_tracks(points: DataFrame, prefer: Column) -> DataFrame:
    """U1. One point per object and frame from several windows' tracks: the one with the largest ``prefer``."""
    return points.groupBy("video_id", "object_id", "frame").agg(F.max_by(F.struct("x", "y"), prefer).alias("p")).select(
        "video_id", "object_id", "frame", "p.x", "p.y"
    )
