"""Small linear models and tests per object, as sums over a table and one solve a group."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from skyloom.functions.safe import corr, div
from skyloom.functions.chunked import CHUNK, islands, previous, rolling, row_index, scan
from skyloom.functions.joins import dealt
from skyloom.functions.lineage import cut, share
from skyloom.functions.probability import chi2_sf, f_sf
from skyloom.functions.quantiles import exact_quantiles
from skyloom.operators.geometry import solve_normal
from skyloom.operators.series import TAU, grid, periodogram, regress_out
from skyloom.operators.tracks import at_offset


def least_squares(df: DataFrame, keys: Sequence[str], terms: Sequence[Column], y: Column) -> DataFrame:
    """Coefficients, residual sum of squares and the inverse's diagonal of y on ``terms`` per key: one pass of sums, one
    small solve a group."""
    p = len(terms)
    d = df.select(*keys, *[t.cast("double").alias(f"_t{i}") for i, t in enumerate(terms)], y.cast("double").alias("_y"))
    a = [F.sum(F.col(f"_t{i}") * F.col(f"_t{j}")) for i in range(p) for j in range(p)]
    b = [F.sum(F.col(f"_t{i}") * F.col("_y")) for i in range(p)]
    g = d.groupBy(*keys).agg(F.array(*a).alias("_a"), F.array(*b).alias("_b"), F.sum(F.col("_y") * F.col("_y")).alias("_yy"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("_s", solve_normal("_a", "_b")).where(F.col("_s").isNotNull())
    fit = sum(F.get("_s", F.lit(i)) * F.get("_b", F.lit(i)) for i in range(p))
    return g.select(*keys, "n", F.slice("_s", 1, p).alias("beta"), F.slice("_s", p + 1, p).alias("inv"), F.greatest(F.col("_yy") - fit, F.lit(0.0)).alias("rss"))


def dense_layers(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A25. Rows of a pair's layer under one affine motion, and its gradient in parts: divergence, curl and both shears.
    Columns: x, y, vx, vy."""
    keys = list(keys)
    t = [F.lit(1.0), F.col("x"), F.col("y")]
    ax = least_squares(rows, keys, t, F.col("vx")).select(*keys, "n", F.col("beta").alias("bx"), F.col("rss").alias("rx"))
    ay = least_squares(rows, keys, t, F.col("vy")).select(*keys, F.col("beta").alias("by"), F.col("rss").alias("ry"))
    j = ax.join(ay, keys)
    xx, xy, yx, yy = F.get("bx", F.lit(1)), F.get("bx", F.lit(2)), F.get("by", F.lit(1)), F.get("by", F.lit(2))
    return j.select(*keys, "n", F.get("bx", F.lit(0)).alias("vx0"), F.get("by", F.lit(0)).alias("vy0"), (xx + yy).alias("divergence"), (yx - xy).alias("curl"), (xx - yy).alias("shear_along"), (xy + yx).alias("shear_across"),
                    F.sqrt((F.col("rx") + F.col("ry")) / F.greatest(2 * F.col("n") - 6, F.lit(1))).alias("rms"))


def heading_regression(obj: DataFrame, keys: Sequence[str], slides: Sequence[int] = ()) -> DataFrame:
    """A38. Brightness on position and time against the same with heading harmonics: F and its chance; the same with the
    brightness slid in time by whole frames as the null.  Columns: frame, z, t_s, x, y, heading (radians)."""
    keys = list(keys)
    s = F.explode(F.array(F.lit(0), *[F.lit(int(v)) for v in slides])).alias("slide")
    z = obj.select(*keys, "frame", "z", s).withColumn("frame", F.col("frame") + F.col("slide"))
    d = share(z.join(obj.drop("z"), [*keys, "frame"]))
    k = [*keys, "slide"]
    base = [F.lit(1.0), F.col("t_s"), F.col("x"), F.col("y")]
    full = base + [F.cos("heading"), F.sin("heading"), F.cos(2 * F.col("heading")), F.sin(2 * F.col("heading"))]
    a = least_squares(d, k, base, F.col("z")).select(*k, F.col("rss").alias("r0"))
    b = least_squares(d, k, full, F.col("z")).select(*k, "n", F.col("rss").alias("r1"))
    j = a.join(b, k).where(F.col("n") > 10)
    j = j.withColumn("f", div(F.greatest(F.col("r0") - F.col("r1"), F.lit(0.0)) / 4, F.col("r1") / (F.col("n") - 8)))
    real = j.where(F.col("slide") == 0).select(*keys, "n", "f", f_sf(F.col("f"), F.lit(4.0), (F.col("n") - 8).cast("double")).alias("p"))
    null = j.where(F.col("slide") != 0).select(*keys, F.col("f").alias("_f"))
    return real.join(null, keys, "left").groupBy(*keys, "n", "f", "p").agg(((F.sum((F.col("_f") >= F.col("f")).cast("int")) + 1) / (F.count("_f") + 1)).alias("slide_p"))


def aircraft_wind(platform: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A42. The wind at an aircraft from its turn: ground velocity = one airspeed along the heading plus the wind, three
    unknowns from all its readings, with errors.  Columns: ve, vn, heading_deg."""
    keys = list(keys)
    h = F.radians("heading_deg")
    eq = F.explode(F.array(F.struct(F.sin(h).alias("s"), F.lit(1.0).alias("e"), F.lit(0.0).alias("n"), F.col("ve").alias("v")), F.struct(F.cos(h).alias("s"), F.lit(0.0).alias("e"), F.lit(1.0).alias("n"), F.col("vn").alias("v"))))
    d = platform.select(*keys, eq.alias("q"))
    f = least_squares(d, keys, [F.col("q.s"), F.col("q.e"), F.col("q.n")], F.col("q.v"))
    s2 = F.col("rss") / F.greatest(F.col("n") - 3, F.lit(1))
    g = lambda c, i: F.get(c, F.lit(i))
    return f.select(*keys, (F.col("n") / 2).cast("long").alias("readings"), g("beta", 0).alias("airspeed"), g("beta", 1).alias("wind_e"), g("beta", 2).alias("wind_n"), F.sqrt(s2 * (g("inv", 1) + g("inv", 2))).alias("err"))


@F.pandas_udf(ArrayType(DoubleType()))
def first_component(names: pd.Series, gram: pd.Series) -> pd.Series:
    """Weights of the strongest common component of a few curves, from their Gram matrix (a row-major array)."""
    out = []
    for nm, g in zip(names, gram):
        m = np.array(g, float).reshape(len(nm), len(nm))
        w, v = np.linalg.eigh(m)
        c = v[:, int(np.argmax(w))]
        out.append(list(c * (1 if c[int(np.argmax(np.abs(c)))] >= 0 else -1)))
    return pd.Series(out)


def common_mode(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A35. An object's curve without what its background apertures share: their Gram matrix (a self-join on the frame,
    summed by pair of apertures), its first component, and the object's regression on that component's series."""
    keys = list(keys)
    b = share(curves.where(F.col("kind") == "background").select(*keys, "curve", "frame", "dev"))
    o = b.select(*keys, "frame", F.col("curve").alias("c2"), F.col("dev").alias("d2"))
    g = b.join(o, [*keys, "frame"]).groupBy(*keys, "curve", "c2").agg(F.sum(F.col("dev") * F.col("d2")).alias("g"))  # a handful of apertures
    m = g.groupBy(*keys).agg(F.array_sort(F.collect_set("curve")).alias("names"), F.array_sort(F.collect_list(F.struct("curve", "c2", "g"))).alias("_g"))
    m = m.where(F.size("_g") == F.size("names") * F.size("names")).select(*keys, "names", first_component("names", F.transform("_g", lambda v: v["g"])).alias("_w"))
    w = m.select(*keys, F.explode(F.arrays_zip(F.col("names").alias("curve"), F.col("_w").alias("weight"))).alias("z")).select(*keys, "z.curve", "z.weight")
    comp = b.join(w, [*keys, "curve"]).groupBy(*keys, "frame").agg(F.sum(F.col("dev") * F.col("weight")).alias("comp"))
    obj = curves.where(F.col("kind") == "object").join(comp, [*keys, "frame"])
    return regress_out(obj, [*keys, "curve"], F.col("comp"), F.lit(0.0)).select(*keys, "curve", "frame", "clean", "share")


class StartsAlive:
    """Starts that the last piece of a track may still have: each with the least cost up to it and sums from it on.

    A start that costs more than the whole of an ended partition can't win behind it, for pieces cost no less joined than apart; it
    goes once a piece of ``least`` points fits behind that end.
    """

    def __init__(self, least: int, penalty: float):
        self.least, self.penalty, self.n = least, penalty, 0
        self.at = np.zeros(0, np.int64)  # points before the start
        self.cost = np.zeros(0)
        self.goes = np.zeros(0, np.int64)  # the point at which a beaten start goes
        self.sums = np.zeros((9, 0))  # n, t, x, y, tt, tx, ty, xx, yy about the start's own first point
        self.origin = np.zeros((3, 0))
        self.best = 0.0

    def point(self, t: float, x: float, y: float) -> int:
        """Takes the next point; points before the best last piece that ends here, -1 where none can end."""
        if np.isfinite(self.best):
            self.at = np.append(self.at, self.n)
            self.cost = np.append(self.cost, self.best)
            self.goes = np.append(self.goes, np.iinfo(np.int64).max)
            self.sums = np.concatenate([self.sums, np.zeros((9, 1))], axis=1)
            self.origin = np.concatenate([self.origin, [[t], [x], [y]]], axis=1)
        self.n += 1
        u, v, w = t - self.origin[0], x - self.origin[1], y - self.origin[2]
        self.sums += np.stack([np.ones_like(u), u, v, w, u * u, u * v, u * w, v * v, w * w])
        n, st, sx, sy, tt, tx, ty, xx, yy = self.sums
        tt = tt - st * st / n
        with np.errstate(divide="ignore", invalid="ignore"):
            left = sum(np.maximum(zz - z * z / n - np.where(tt > 0, (tz - st * z / n) ** 2 / tt, 0.0), 0.0) for z, tz, zz in ((sx, tx, xx), (sy, ty, yy)))
        total = np.where(n >= self.least, self.cost + left, np.inf)
        if not len(total) or not np.isfinite(total.min()):
            self.best = np.inf
            return -1
        won = int(np.argmin(total))
        self.best = float(total[won]) + self.penalty
        from_ = int(self.at[won])
        beaten = (total > self.best) & np.isfinite(total)
        self.goes = np.where(beaten, np.minimum(self.goes, self.n + self.least), self.goes)
        stay = self.goes > self.n
        self.at, self.cost, self.goes = self.at[stay], self.cost[stay], self.goes[stay]
        self.sums, self.origin = self.sums[:, stay], self.origin[:, stay]
        return from_


def _last_pieces(keys: list[str], sigma: float, least: int):
    def run(batches):
        state, before = None, None
        for batch in batches:
            froms = []
            columns = [batch[k] for k in keys]
            for key, n, t, x, y in zip(zip(*columns, strict=True), batch["_N"], batch["t_s"], batch["x"], batch["y"], strict=True):
                if state is None or key != before:
                    state, before = StartsAlive(least, 4 * math.log(2 * n) * sigma * sigma), key
                froms.append(state.point(t, x, y))
            yield batch.assign(_from=np.array(froms, np.int64))

    return run


def _traced(keys: list[str]):
    def run(batches):
        before, start = None, 0
        for batch in batches:
            pieces = []
            columns = [batch[k] for k in keys]
            for key, i, from_ in zip(zip(*columns, strict=True), batch["_i"], batch["_from"], strict=True):
                if key != before or i <= start:  # the track's last point, or the one before the piece just traced
                    before, start = key, from_
                pieces.append(start)
            yield batch.assign(_from=np.array(pieces, np.int64))

    return run


def rate_steps(track: DataFrame, keys: Sequence[str], sigma: float, least: int = 4) -> DataFrame:
    """A47. A track as few straight pieces as its noise allows, each of ``least`` points or more: of all partitions that of the
    least sum of squared residuals over both axes and 4 log(2N) sigma^2 a piece.

    The points of a track stream in order through one task, which holds only the starts that can still win, whatever the track's length;
    a second stream, from the end, follows the winners back.  Lines, errors and the jump between two lines (carried to the time
    between them, with its error) are sums over the pieces.  Tracks of under 2 ``least`` points have none.
    """
    keys = list(keys)
    n = track.groupBy(*keys).agg(F.count(F.lit(1)).alias("_N")).where(F.col("_N") >= 2 * least)
    d = track.select(*keys, "frame", *[F.col(c).cast("double").alias(c) for c in ("t_s", "x", "y")]).join(n, keys)
    schema = d.schema.add("_from", "long")
    d = d.repartition(*keys).sortWithinPartitions(*keys, "frame").mapInPandas(_last_pieces(keys, sigma, least), schema)
    d = row_index(share(d), keys, "frame", out="_i")
    back = d.repartition(*keys).sortWithinPartitions(*keys, F.desc("_i"))
    d = back.mapInPandas(_traced(keys), back.schema)
    r = lambda name, z: getattr(F, f"regr_{name}")(z, "t_s")
    rss = sum((F.greatest(r("syy", z) - F.when(r("sxx", z) > 0, r("sxy", z) * r("sxy", z) / r("sxx", z)).otherwise(0.0), F.lit(0.0)) for z in ("x", "y")), F.lit(0.0))
    g = d.groupBy(*keys, "_from").agg(
        F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.min("t_s").alias("_t0"), F.max("t_s").alias("_t1"), F.avg("t_s").alias("_mt"), r("sxx", "x").alias("_tt"),
        F.count(F.lit(1)).alias("n"), r("slope", "x").alias("vx"), r("intercept", "x").alias("_x0"), r("slope", "y").alias("vy"), r("intercept", "y").alias("_y0"), rss.alias("_rss"),
    )
    own = F.when(F.col("n") > 2, F.sqrt(F.col("_rss") / (2 * (F.col("n") - 2)))).otherwise(F.lit(0.0))
    g = g.withColumn("_noise", F.greatest(F.lit(float(sigma)), own)).withColumn("err", F.col("_noise") / F.sqrt("_tt"))
    line = F.struct("_t1", "_mt", "_tt", "n", "_noise", "vx", "_x0", "vy", "_y0")
    g = previous(g, keys, "f0", {"_p": line})
    tb = (F.col("_p._t1") + F.col("_t0")) / 2
    gap = F.hypot(F.col("_x0") + F.col("vx") * tb - F.col("_p._x0") - F.col("_p.vx") * tb, F.col("_y0") + F.col("vy") * tb - F.col("_p._y0") - F.col("_p.vy") * tb)
    var = lambda p: F.pow(F.col(f"{p}_noise"), 2) * (1 / F.col(f"{p}n") + F.pow(tb - F.col(f"{p}_mt"), 2) / F.col(f"{p}_tt"))
    return g.select(*keys, "f0", "f1", "n", "vx", "vy", "err", gap.alias("jump"), (gap / F.sqrt(2 * (var("") + var("_p.")))).alias("jump_sigma"))


def size_steps(sizes: DataFrame, keys: Sequence[str], hold: int = 8, ratio: float = 1.2, chunk: int = CHUNK) -> DataFrame:
    """W20. Steps of an object's length: log medians of ``hold`` frames after and before, the largest of a run, and the
    centre of zoom (r p_b - p_a)/(r - 1).  Columns: idx, frame, length, x, y."""
    keys = list(keys)
    d = sizes.where(F.col("length") > 0).withColumn("ln", F.log("length"))
    med = lambda c: F.percentile(c, F.lit(0.5))
    b = rolling(d, keys, "idx", hold, -1, {"b_ln": med("ln"), "b_x": med("x"), "b_y": med("y"), "b_n": F.count("ln")}, chunk)
    a = rolling(b, keys, "idx", 0, hold - 1, {"a_ln": med("ln"), "a_x": med("x"), "a_y": med("y"), "a_n": F.count("ln")}, chunk)
    s = a.where((F.col("b_n") == hold) & (F.col("a_n") == hold)).withColumn("step", F.col("a_ln") - F.col("b_ln")).where(F.abs("step") >= math.log(ratio))
    i = islands(s, keys, "idx", hold, chunk=chunk)
    g = i.groupBy(*keys, "island").agg(F.max_by(F.struct("frame", "step", "b_x", "b_y", "a_x", "a_y"), F.struct(F.abs("step"), -F.col("idx"))).alias("b"))
    r = F.exp("b.step")
    return g.select(*keys, "b.frame", r.alias("ratio"), ((r * F.col("b.b_x") - F.col("b.a_x")) / (r - 1)).alias("centre_x"), ((r * F.col("b.b_y") - F.col("b.a_y")) / (r - 1)).alias("centre_y"))


def shake_test(track: DataFrame, bg: DataFrame, keys: Sequence[str], least: int = 40) -> DataFrame:
    """A71. Does a track's acceleration follow the background's at unit slope: second differences on consecutive frames
    of both, correlation and slopes both ways; no power under ``least`` frames.  ``bg``: video_id, frame, x, y."""
    keys = list(keys)
    b = bg.select("video_id", "frame", F.struct("x", "y").alias("g"))
    p = track.select(*keys, "frame", F.struct("x", "y").alias("p")).join(b, ["video_id", "frame"]).withColumn("q", F.struct("p", "g"))
    p = at_offset(at_offset(p, keys, "frame", 1, {"q1": "q"}), keys, "frame", 2, {"q2": "q"}).where(F.col("q1").isNotNull() & F.col("q2").isNotNull())
    acc = lambda s, c: F.col(f"q.{s}.{c}") - 2 * F.col(f"q1.{s}.{c}") + F.col(f"q2.{s}.{c}")
    d = p.select(*keys, F.explode(F.array(*[F.struct(acc("p", c).alias("o"), acc("g", c).alias("b")) for c in "xy"])).alias("a")).select(*keys, "a.o", "a.b")
    g = d.groupBy(*keys).agg((F.count(F.lit(1)) / 2).cast("long").alias("frames"), corr("o", "b").alias("r"), F.regr_slope("o", "b").alias("slope"), F.regr_slope("b", "o").alias("back"))
    out = F.when(F.col("frames") < least, "NO POWER").when((F.col("r") > 0.3) & F.col("slope").between(0.5, 1.5), "PASS").when(F.abs("r") < 0.1, "FLAG").otherwise("inconclusive")
    return g.withColumn("outcome", out)


def catch_up_steps(steps: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """A71. Frames whose background step is 1.7 to 2.3 times its neighbours' median (six or more within six frames)."""
    keys = list(keys)
    md = F.percentile("step", F.lit(0.5))
    lo = rolling(steps, keys, "frame", 6, 6, {"_a": F.collect_list(F.struct("frame", "step"))}, chunk)
    others = F.array_sort(F.transform(F.filter("_a", lambda v: v["frame"] != F.col("frame")), lambda v: v["step"]))
    d = lo.withColumn("_o", others).withColumn("_n", F.size("_o"))
    med = (F.get("_o", F.floor((F.col("_n") - 1) / 2).cast("int")) + F.get("_o", F.floor(F.col("_n") / 2).cast("int"))) / 2
    d = d.withColumn("times", div(F.col("step"), med))
    return d.where((F.col("_n") >= 6) & (F.col("step") > 8) & (F.col("times") > 1.7) & (F.col("times") < 2.3)).select(*keys, "frame", "step", "times")


def band_standing(spec: DataFrame, keys: Sequence[str], lobe: int = 1, reach: int = 4) -> DataFrame:
    """A72. Each line's power over the mean of its neighbours on the grid, its own lobe left out.  A spectrum is a fixed
    grid of some hundred lines."""
    w = W.partitionBy(*keys).orderBy("hz")
    wide, own = F.sum("power").over(w.rowsBetween(-reach, reach)), F.sum("power").over(w.rowsBetween(-lobe, lobe))
    nw, no = F.count("power").over(w.rowsBetween(-reach, reach)), F.count("power").over(w.rowsBetween(-lobe, lobe))
    d = spec.withColumn("_m", F.when(nw > no, (wide - own) / (nw - no)))
    return d.select(*keys, "hz", "power", F.when(F.col("_m") > 0, F.col("power") / F.col("_m")).alias("standing"))


def depth_along(curve: DataFrame, beats: DataFrame, keys: Sequence[str], piece: int, least: int = 2) -> DataFrame:
    """A73. Does a beat keep one depth: its amplitude in pieces of ``piece`` samples against the pieces' own noise
    (chi-square about the weighted mean); no reading with under ``least`` pieces.  Columns: idx, t_s, dev; beats: hz."""
    keys = list(keys)
    d = curve.join(beats.select(*keys, "hz"), keys).withColumn("piece", F.floor((F.col("idx") - 1) / piece))
    ph = TAU * F.col("hz") * F.col("t_s")
    d = d.withColumn("_c", F.cos(ph)).withColumn("_s", F.sin(ph))
    g = d.groupBy(*keys, "piece").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("dev", "_c").alias("yc"), F.covar_pop("dev", "_s").alias("ys"), F.var_pop("dev").alias("yy")).where(F.col("n") >= 0.9 * piece)
    amp = 2 * F.hypot("yc", "ys")
    g = g.withColumn("amp", amp).withColumn("e2", F.greatest(F.col("yy") - F.col("amp") * F.col("amp") / 2, F.lit(1e-12)) * 2 / F.col("n"))
    w = 1 / F.col("e2")
    t = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("pieces"), (F.sum(w * F.col("amp")) / F.sum(w)).alias("depth"), F.sum(w * F.col("amp") * F.col("amp")).alias("_q"), F.sum(w * F.col("amp")).alias("_l")).where(F.col("pieces") >= least)
    x2 = F.greatest(F.col("_q") - F.col("_l") * F.col("depth"), F.lit(0.0))
    return t.select(*keys, "pieces", "depth", x2.alias("chi2"), chi2_sf(x2, (F.col("pieces") - 1).cast("double")).alias("p"))


def position_rhythm(track: DataFrame, held: DataFrame, keys: Sequence[str], freqs: Sequence[float]) -> DataFrame:
    """A74. The periodogram of a track's places on each axis, held frames left out.

    Tracks are dealt by their keys and stretches of 4,096 frames, so a task's sums are those of its own tracks, not of all."""
    p = track.join(held.select("video_id", "frame"), ["video_id", "frame"], "left_anti")
    p = dealt(p.withColumn("_c", F.floor(F.col("frame") / 4096)), *keys, "_c").drop("_c")
    return periodogram(p.unpivot([*keys, "frame", "t_s"], ["x", "y"], "axis", "dev"), [*keys, "axis"], freqs)


def light_train(flashes: DataFrame, keys: Sequence[str], freqs: Sequence[float], least: int = 4) -> DataFrame:
    """A79. Are an object's flashes a train: the rate at which their times fold tightest (mean resultant length)."""
    keys = list(keys)
    d = flashes.select(*keys, "t_s", grid(freqs).alias("hz"))
    ph = TAU * F.col("hz") * F.col("t_s")
    g = d.groupBy(*keys, "hz").agg(F.count(F.lit(1)).alias("n"), F.hypot(F.avg(F.cos(ph)), F.avg(F.sin(ph))).alias("z")).where(F.col("n") >= least)
    b = g.groupBy(*keys).agg(F.max_by(F.struct("hz", "z", "n"), F.struct("z", -F.col("hz"))).alias("b"))
    return b.select(*keys, "b.hz", F.col("b.z").alias("coherence"), F.col("b.n").alias("flashes"), F.exp(-F.col("b.n") * F.col("b.z") * F.col("b.z")).alias("p_one_rate"))


def engine_clock_refine(lines: DataFrame, gap: float = 0.02, least: int = 3) -> DataFrame:
    """A50. Estimates hz/k of one clock from harmonics over pieces, grouped where neighbours are within ``gap``; groups of
    ``least`` different harmonics.  Columns: video_id, hz, k."""
    e = lines.where(F.col("k") >= 1).select("video_id", "k", (F.col("hz") / F.col("k")).alias("f"))
    ck = F.floor(F.col("f") * 16).cast("long")
    d = scan(e, ["video_id"], "f", {"_p": ("last", F.col("f"))}, exclusive=True, ties=["k"], pos_chunk=ck)
    d = scan(d, ["video_id"], "f", {"clock": ("sum", F.when(F.col("_p").isNull() | (F.col("f") - F.col("_p") > gap), 1).otherwise(0))}, ties=["k"], pos_chunk=ck)
    g = d.groupBy("video_id", "clock").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("harmonics"), F.avg("f").alias("f0"), F.stddev_pop("f").alias("sd"))
    return g.where(F.col("harmonics") >= least).drop("clock")


def sweep_summary(windows: DataFrame, whole: DataFrame, apart: int = 2, share_: float = 0.05) -> DataFrame:
    """A70. Candidates of a pass: beats that come back in ``apart`` windows, or a whole track over its drift by 5 %."""
    j = windows.join(whole, ["video_id", "curve"], "full_outer")
    back, over = F.coalesce(F.col("apart") >= apart, F.lit(False)), F.coalesce(F.col("over_drift") >= 1 + share_, F.lit(False))
    return j.where(back | over).select("video_id", "curve", back.alias("comes_back"), over.alias("whole_track"))
