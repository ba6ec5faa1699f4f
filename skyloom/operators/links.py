"""Linking spots into chains and pieces into things: iterative plans over all chains of all videos at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.joins import near_pairs
from skyloom.functions.lineage import cut, share
from skyloom.operators.tracks import greedy_keep


def pair_chain_seeds(peaks: DataFrame, vmax: float, reach: int = 3) -> DataFrame:
    """J5. Same-polarity peaks up to ``reach`` frames apart, within ``vmax`` px a frame: one equi-join on the later frame, to
    which every peak is copied once a gap.  ``peaks``: video_id, frame, peak_id, polarity, x, y, amp, size (a frame and
    polarity hold at most its ten strongest, T4, so cells of place would only make more copies)."""
    keys, rest = ["video_id", "frame", "polarity"], ["peak_id", "x", "y", "amp", "size"]
    p = share(peaks.select(*keys, *rest))
    a = p.withColumn("dt", F.explode(F.array(*[F.lit(dt) for dt in range(1, reach + 1)]))).withColumn("frame", F.col("frame") + F.col("dt"))
    # the planner counts the copies as one and would send all through the driver
    j = a.join(p.select(*keys, *[F.col(c).alias(f"{c}_2") for c in rest]).hint("merge"), keys)
    near = F.hypot(F.col("x") - F.col("x_2"), F.col("y") - F.col("y_2")) <= F.lit(float(vmax)) * F.col("dt")
    return j.where(near).select(*keys, *rest, *[f"{c}_2" for c in rest], "dt")


def extend_chains(peaks: DataFrame, vmax: float, tol: float = 6.0, max_skip: int = 2) -> DataFrame:
    """J6. Every seed carried on by the nearest peak inside an anisotropic gate about its prediction.

    A chain's state changes only when a peak joins it, so one round tries the next 1..max_skip+1 frames for every chain
    of every video together and takes the first frame that has one; the rounds are as many as the longest chain has
    points, and a round's chains are written to the shared folder.  Chains of three points of steady amplitude and size,
    or of six, are kept.  Returns a row a chain and point."""
    peaks = share(peaks.select("video_id", "frame", "polarity", "peak_id", "x", "y", "amp", "size"))
    seeds = share(pair_chain_seeds(peaks, vmax))
    cid = F.concat_ws("-", F.col("peak_id").cast("string"), F.col("peak_id_2").cast("string"))
    n0 = F.col("frame") - F.col("dt")
    base = seeds.withColumn("chain", cid)
    pts = base.select("video_id", "chain", "polarity", n0.alias("frame"), "peak_id", "x", "y", "amp", "size").unionByName(
        base.select("video_id", "chain", "polarity", "frame", F.col("peak_id_2").alias("peak_id"), F.col("x_2").alias("x"), F.col("y_2").alias("y"), F.col("amp_2").alias("amp"), F.col("size_2").alias("size"))
    )
    on = base.select("video_id", "chain", "polarity", n0.alias("n0"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("frame").alias("last"), F.col("x_2").alias("lx"), F.col("y_2").alias("ly"),
                     ((F.col("x_2") - F.col("x")) / F.col("dt")).alias("vx"), ((F.col("y_2") - F.col("y")) / F.col("dt")).alias("vy"))
    on = cut(on)
    parts = [pts]
    while not on.isEmpty():
        step = on.withColumn("gap", F.explode(F.sequence(F.lit(1), F.lit(max_skip + 1)))).withColumn("frame", F.col("last") + F.col("gap"))
        j = step.hint("merge").join(peaks, ["video_id", "polarity", "frame"])
        dx, dy = F.col("x") - (F.col("lx") + F.col("vx") * F.col("gap")), F.col("y") - (F.col("ly") + F.col("vy") * F.col("gap"))
        j = j.withColumn("_off", misfit(dx, dy, F.col("vx"), F.col("vy"), F.col("gap"), tol + 8.0 * F.col("gap") / (F.col("last") - F.col("n0"))))
        j = j.where(F.col("_off") <= 1.0)
        hit = j.groupBy("video_id", "chain").agg(F.min_by(F.struct("polarity", "n0", "x0", "y0", "frame", "peak_id", "x", "y", "amp", "size"), F.struct("gap", "_off", "peak_id")).alias("h"))
        hit = cut(hit.select("video_id", "chain", "h.*"))
        parts.append(hit.select("video_id", "chain", "polarity", "frame", "peak_id", "x", "y", "amp", "size"))
        dt = F.col("frame") - F.col("n0")
        on = hit.select("video_id", "chain", "polarity", "n0", "x0", "y0", F.col("frame").alias("last"), F.col("x").alias("lx"), F.col("y").alias("ly"), ((F.col("x") - F.col("x0")) / dt).alias("vx"), ((F.col("y") - F.col("y0")) / dt).alias("vy"))
        if len(parts) > 10:
            parts = [parts[0], cut(_all(parts[1:]))]
    pts = share(_all(parts))
    g = pts.groupBy("video_id", "chain").agg(F.count(F.lit(1)).alias("n"), F.max("amp").alias("_a1"), F.min("amp").alias("_a0"), F.max("size").alias("_s1"), F.min("size").alias("_s0"))
    ok = (F.col("n") >= 6) | ((F.col("_a1") <= 2.0 * F.col("_a0")) & (F.col("_s1") <= 1.6 * F.col("_s0")))
    return pts.hint("merge").join(g.where((F.col("n") >= 3) & ok).select("video_id", "chain", "n"), ["video_id", "chain"])


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: A thing's pace is this uncertain along its way, and its heading across it, as shares of the way gone.
PACE, HEADING = 0.15, 0.03


def misfit(dx: Column, dy: Column, vx: Column, vy: Column, steps: Column, sigma: Column) -> Column:
    """A prediction error in standard deviations of the prediction: sqrt(e' C^-1 e).

    The place has variance sigma^2 each way; pace and heading add those of the way gone, so C = a I + b v v' with
    a = sigma^2 + (HEADING steps |v|)^2 and b = (PACE^2 - HEADING^2) steps^2, whose inverse has a closed form (a rank-one update).
    The gate is an ellipse along the way, and a circle for a thing at rest, without a case of its own."""
    vv = vx * vx + vy * vy
    a = sigma * sigma + HEADING * HEADING * steps * steps * vv
    b = (PACE * PACE - HEADING * HEADING) * steps * steps
    ev = dx * vx + dy * vy
    return F.sqrt(F.greatest(dx * dx + dy * dy - b * ev * ev / (a + b * vv), F.lit(0.0)) / a)


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest id each node is connected to (columns video_id, id -> video_id, id, root): the least label of a node
    and its neighbours, and of its label's own label, until nothing changes."""
    e = edges.select("video_id", "a", "b").unionByName(edges.select("video_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    e = share(e)
    lab = cut(nodes.select("video_id", "id", F.col("id").alias("root")))
    while True:
        near = e.hint("merge").join(lab.select("video_id", F.col("id").alias("b"), F.col("root").alias("_r")), ["video_id", "b"]).groupBy("video_id", F.col("a").alias("id")).agg(F.min("_r").alias("_r"))
        up = lab.hint("merge").join(near, ["video_id", "id"], "left").select("video_id", "id", "root", F.least("root", F.coalesce("_r", "root")).alias("new"))
        jump = lab.select("video_id", F.col("id").alias("new"), F.col("root").alias("_j"))
        up = cut(up.hint("merge").join(jump, ["video_id", "new"], "left").select("video_id", "id", "root", F.least("new", F.coalesce("_j", "new")).alias("new")))
        done = up.where(F.col("new") != F.col("root")).isEmpty()
        lab = up.select("video_id", "id", F.col("new").alias("root"))
        if done:
            return lab


def join_pieces(points: DataFrame, gap: int = 30, tol: float = 30.0) -> DataFrame:
    """J7. Chains with most of their points in a longer one dropped; a later piece joins where an earlier one was heading
    within ``gap`` frames.  ``points``: video_id, chain, frame, peak_id, x, y.  Returns each kept chain's thing."""
    p = share(points.select("video_id", "chain", "frame", "peak_id", "x", "y"))
    ends = share(p.groupBy("video_id", "chain").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.min_by(F.struct("x", "y"), "frame").alias("a"), F.max_by(F.struct("x", "y"), "frame").alias("b")))
    # chains meet only on a peak they both hold
    o = p.select("video_id", "peak_id", F.col("chain").alias("a")).hint("merge").join(p.select("video_id", "peak_id", F.col("chain").alias("b")), ["video_id", "peak_id"]).where(F.col("a") < F.col("b"))
    o = o.groupBy("video_id", "a", "b").agg(F.count(F.lit(1)).alias("k"))
    size = lambda s: ends.select("video_id", F.col("chain").alias(s), F.col("n").alias(f"n_{s}"))
    o = o.hint("merge").join(size("a"), ["video_id", "a"]).hint("merge").join(size("b"), ["video_id", "b"]).where(F.col("k") > 0.5 * F.least("n_a", "n_b"))
    prio = ends.select("video_id", F.col("chain").alias("id"), F.struct(-F.col("n"), F.col("f0"), F.col("chain")).alias("prio"))
    kept = share(greedy_keep(prio, o).where(F.col("state") == "kept").select("video_id", F.col("id").alias("chain")))
    e = share(ends.hint("merge").join(kept, ["video_id", "chain"]))
    # the gap's frames bucket the later pieces, so that only pieces starting soon after an end meet it
    a = e.select("video_id", F.col("chain").alias("ca"), "f1", F.col("b").alias("pa"), ((F.col("b.x") - F.col("a.x")) / (F.col("f1") - F.col("f0"))).alias("vx"), ((F.col("b.y") - F.col("a.y")) / (F.col("f1") - F.col("f0"))).alias("vy"))
    a = a.withColumn("_k", F.explode(F.sequence(F.floor((F.col("f1") + 1) / gap), F.floor((F.col("f1") + gap) / gap))))
    b = e.select("video_id", F.col("chain").alias("cb"), F.col("f0").alias("start"), F.col("a").alias("pb"), F.floor(F.col("f0") / gap).alias("_k"))
    dt = F.col("start") - F.col("f1")
    near = F.hypot(F.col("pa.x") + F.col("vx") * dt - F.col("pb.x"), F.col("pa.y") + F.col("vy") * dt - F.col("pb.y")) <= tol
    link = a.hint("merge").join(b, ["video_id", "_k"]).where(dt.between(1, gap) & near).select("video_id", F.col("ca").alias("a"), F.col("cb").alias("b"))
    return connected(e.select("video_id", F.col("chain").alias("id")), link).select("video_id", F.col("id").alias("chain"), F.col("root").alias("thing"))


def merge_windows(props: DataFrame, points: DataFrame, shared: int = 5, apart: float = 15.0) -> tuple[DataFrame, DataFrame]:
    """J2, U1. Proposals of overlapping windows that are one object: ``shared`` frames or more, one polarity, median
    distance under ``apart``; the one seen longest leads.  Returns (proposal -> object) and the objects' tracks, the
    later window's point kept.  ``props``: video_id, prop_id, window, dark, seen; ``points``: video_id, prop_id, frame, x, y.

    A median under ``apart`` needs half the shared frames near: only proposals near each other on a frame are compared."""
    p = share(points.hint("merge").join(props.select("video_id", "prop_id", "dark"), ["video_id", "prop_id"]).select("video_id", "prop_id", "dark", "frame", "x", "y"))
    near = near_pairs(p, p, ["video_id", "frame", "dark"], "x", "y", apart).where(F.col("prop_id") < F.col("prop_id_2"))
    cand = share(near.select("video_id", F.col("prop_id").alias("a"), F.col("prop_id_2").alias("b")).distinct())
    q = lambda s: p.select("video_id", F.col("prop_id").alias(s), "frame", F.struct("x", "y").alias(f"p{s}"))
    both = cand.hint("merge").join(q("a"), ["video_id", "a"]).hint("merge").join(q("b"), ["video_id", "b", "frame"])
    d = F.hypot(F.col("pa.x") - F.col("pb.x"), F.col("pa.y") - F.col("pb.y"))
    # a pair's shared frames are at most the overlap of two windows
    e = both.groupBy("video_id", "a", "b").agg(F.count(F.lit(1)).alias("k"), F.percentile(d, F.lit(0.5)).alias("m")).where((F.col("k") >= shared) & (F.col("m") < apart))
    e = share(e.select("video_id", "a", "b"))
    prio = props.select("video_id", F.col("prop_id").alias("id"), F.struct(-F.col("seen"), F.col("prop_id")).alias("prio"))
    st = share(greedy_keep(prio, e))
    lead = st.where(F.col("state") == "kept").select("video_id", F.col("id").alias("k"), F.col("prio").alias("kp"))
    ab = e.unionByName(e.select("video_id", F.col("b").alias("a"), F.col("a").alias("b")))
    follow = ab.hint("merge").join(lead, (ab["video_id"] == lead["video_id"]) & (ab["b"] == lead["k"])).select(ab["video_id"], ab["a"].alias("prop_id"), "k", "kp")
    to = follow.groupBy("video_id", "prop_id").agg(F.min_by("k", "kp").alias("object_id"))
    m = st.select("video_id", F.col("id").alias("prop_id"), "state").hint("merge").join(to, ["video_id", "prop_id"], "left")
    m = share(m.select("video_id", "prop_id", F.when(F.col("state") == "kept", F.col("prop_id")).otherwise(F.col("object_id")).alias("object_id")))
    t = points.hint("merge").join(m, ["video_id", "prop_id"]).hint("merge").join(props.select("video_id", "prop_id", "window"), ["video_id", "prop_id"])
    t = t.groupBy("video_id", "object_id", "frame").agg(F.max_by(F.struct("x", "y"), F.struct("window", "prop_id")).alias("p")).select("video_id", "object_id", "frame", "p.x", "p.y")
    return m, t


def local_flow(field: DataFrame, centre: DataFrame, r_in: float, radii: Sequence[float], least: int = 4, near: float = 3.0) -> DataFrame:
    """J10. Median shift of the patches in an annulus about the object, a pair and outer radius at a time; the
    information-weighted mean of those within ``near`` of it, where there are ``least``.  ``field``: video_id, frame, x, y,
    dx, dy, w (a pair's patches: some hundreds); ``centre``: video_id, frame, cx, cy."""
    r = F.explode(F.array(*[F.lit(float(v)) for v in radii])).alias("r_out")
    j = field.join(centre, ["video_id", "frame"]).withColumn("_d", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    j = j.where(F.col("_d").between(r_in, max(radii))).select("video_id", "frame", "dx", "dy", "w", "_d", r).where(F.col("_d") <= F.col("r_out"))
    j = share(j)
    k = ["video_id", "frame", "r_out"]
    m = j.groupBy(*k).agg(F.count(F.lit(1)).alias("patches"), F.percentile("dx", F.lit(0.5)).alias("mx"), F.percentile("dy", F.lit(0.5)).alias("my")).where(F.col("patches") >= least)
    i = j.join(m, k).where(F.hypot(F.col("dx") - F.col("mx"), F.col("dy") - F.col("my")) <= near)
    return i.groupBy(*k, "patches").agg((F.sum(F.col("dx") * F.col("w")) / F.sum("w")).alias("flow_x"), (F.sum(F.col("dy") * F.col("w")) / F.sum("w")).alias("flow_y"), F.count(F.lit(1)).alias("used"))


def group_shift(spots: DataFrame, guess: DataFrame, reach: float = 15.0, tol: float = 2.0) -> DataFrame:
    """J33. The shift from one frame's spots to the next's that most spot pairs agree on to ``tol``, within ``reach`` of a
    guess.  ``spots``: video_id, frame, x, y; ``guess``: video_id, frame (the earlier), gx, gy."""
    a = spots.join(guess, ["video_id", "frame"]).select("video_id", (F.col("frame") + 1).alias("frame"), (F.col("x") + F.col("gx")).alias("x"), (F.col("y") + F.col("gy")).alias("y"), "gx", "gy")
    p = near_pairs(a, spots.select("video_id", "frame", "x", "y"), ["video_id", "frame"], "x", "y", reach)
    o = share(p.select("video_id", "frame", (F.col("x_2") - F.col("x")).alias("ox"), (F.col("y_2") - F.col("y")).alias("oy"), "gx", "gy"))
    v = near_pairs(o, o.select("video_id", "frame", "ox", "oy"), ["video_id", "frame"], "ox", "oy", tol)
    n = v.groupBy("video_id", "frame", "ox", "oy", "gx", "gy").agg(F.count(F.lit(1)).alias("votes"), F.avg("ox_2").alias("mx"), F.avg("oy_2").alias("my"))
    b = n.groupBy("video_id", "frame").agg(F.max_by(F.struct("gx", "gy", "mx", "my", "votes"), F.struct("votes", -F.col("ox"), -F.col("oy"))).alias("b"))
    return b.select("video_id", (F.col("frame") - 1).alias("frame"), (F.col("b.gx") + F.col("b.mx")).alias("dx"), (F.col("b.gy") + F.col("b.my")).alias("dy"), "b.votes")


def link_agreement(forward: DataFrame, backward: DataFrame, agree: float = 1.0) -> DataFrame:
    """J34. Forward and backward links of one object side by side: agreed, disputed, or of one only."""
    b = backward.select("video_id", "object_id", "frame", F.col("x").alias("bx"), F.col("y").alias("by"))
    j = forward.select("video_id", "object_id", "frame", "x", "y").join(b, ["video_id", "object_id", "frame"], "full_outer")
    st = F.when(F.col("x").isNull(), "backward only").when(F.col("bx").isNull(), "forward only").when(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")) <= agree, "agreed").otherwise("disputed")
    return j.select("video_id", "object_id", "frame", F.coalesce("x", "bx").alias("x"), F.coalesce("y", "by").alias("y"), st.alias("state"))
