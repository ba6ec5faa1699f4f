"""Rhythms in curves: periodograms and what they are held against, as one grid of sums a curve.

A frequency grid is a short literal array.  Every sample meets every frequency of it inside its own task and the sums are
combined there before the shuffle, so what moves is one row a curve and frequency, however long the curve.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions.safe import div
from skyloom.functions import draws as dr
from skyloom.functions.chunked import CHUNK, previous, rolling, row_index, scan
from skyloom.functions.lineage import share
from skyloom.functions.probability import binomial_sf, chi2_sf

TAU = 2 * math.pi

# fixed values: frequencies the world makes (Hz) and what makes them
LOOKALIKE_LINES = [
    (50.0, "50-Hz mains"),
    (100.0, "lamp on 50-Hz mains"),
    (60.0, "60-Hz mains"),
    (120.0, "lamp on 60-Hz mains"),
    (400.0, "400-Hz aircraft power"),
    (800.0, "lamp on 400-Hz aircraft power"),
]
# fixed values: rhythms that are bands (low Hz, high Hz, name)
LOOKALIKE_BANDS = [
    (398.41, 401.27, "aircraft bus heard near 400 Hz"),
    (796.82, 802.54, "lamps on that bus"),
    (9.5, 10.5, "flickering candles"),
    (4.7, 8.7, "flame of a floating lantern"),
    (10.0, 30.0, "helicopter blades passing"),
    (20.0, 60.0, "helicopter blades, uneven"),
    (50.0, 150.0, "airscrew blades passing"),
    (150.0, 300.0, "small multicopter blades"),
    (40.0, 80.0, "cooler of the sensor itself"),
]
# fixed values: a rhythm locked to every k-th frame
LOCKED_EVERY = (3, 4, 5, 6)


def grid(freqs: Sequence[float]) -> Column:
    return F.explode(F.array(*[F.lit(float(f)) for f in freqs]))


def lgamma(x: Column) -> Column:
    """log gamma for x >= 1 by Stirling's series six places up."""
    z = x + 6
    s = (z - 0.5) * F.log(z) - z + 0.5 * math.log(TAU) + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5))
    return s - F.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def periodogram(curve: DataFrame, keys: Sequence[str], freqs: Sequence[float], t: str = "t_s", y: str = "dev") -> DataFrame:
    """A28. Floating-mean Lomb-Scargle power (0 to 1) of uneven samples at given frequencies, the amplitude of the best
    sinusoid, the demeaned complex sums and the spectral window of the sampling."""
    d = curve.where(F.col(y).isNotNull()).select(*keys, F.col(t).alias("_t"), F.col(y).alias("_y"), grid(freqs).alias("hz"))
    ph = TAU * F.col("hz") * F.col("_t")
    d = d.withColumn("_c", F.cos(ph)).withColumn("_s", F.sin(ph))
    a = lambda e, n: F.avg(e).alias(n)
    c, s, v = F.col("_c"), F.col("_s"), F.col("_y")
    g = d.groupBy(*keys, "hz").agg(
        F.count(F.lit(1)).alias("n"), a(v, "my"), a(v * v, "myy"), a(c, "C"), a(s, "S"), a(v * c, "yc"), a(v * s, "ys"),
        a(c * c, "cc"), a(s * s, "ss"), a(c * s, "cs"), F.var_pop("_t").alias("tvar"), (F.max("_t") - F.min("_t")).alias("span"),
    )
    g = g.withColumn("YY", F.col("myy") - F.col("my") * F.col("my")).withColumn("YC", F.col("yc") - F.col("my") * F.col("C")).withColumn(
        "YS", F.col("ys") - F.col("my") * F.col("S")
    )
    cc, ss, cs = F.col("cc") - F.col("C") * F.col("C"), F.col("ss") - F.col("S") * F.col("S"), F.col("cs") - F.col("C") * F.col("S")
    det = cc * ss - cs * cs
    num = ss * F.col("YC") * F.col("YC") + cc * F.col("YS") * F.col("YS") - 2 * cs * F.col("YC") * F.col("YS")
    ok = (det > 1e-9 * F.greatest(cc * ss, F.lit(1e-300))) & (F.col("YY") > 0) & (F.col("n") >= 4)
    power = F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), num / (F.col("YY") * det)))).otherwise(F.lit(0.0))
    ca, sa = (F.col("YC") * ss - F.col("YS") * cs) / det, (F.col("YS") * cc - F.col("YC") * cs) / det
    return g.select(
        *keys, "hz", "n", power.alias("power"), F.when(ok, F.hypot(ca, sa)).otherwise(F.lit(0.0)).alias("amplitude"),
        F.col("YC").alias("re"), F.col("YS").alias("im"), (F.col("C") * F.col("C") + F.col("S") * F.col("S")).alias("window"), "tvar", "span",
    )


def strongest(spec: DataFrame, keys: Sequence[str], fmin: float, fmax: float) -> DataFrame:
    """A28. The strongest beat of each curve, its half-power width, whether it sits on the grid's edge, and the
    false-alarm probability of noise making one as strong anywhere in the band (Baluev 2008, alias-free bound)."""
    keys = list(keys)
    spec = share(spec)
    b = spec.groupBy(*keys).agg(
        F.max_by(F.struct("hz", "power", "amplitude", "n", "tvar", "span"), F.struct(F.col("power"), -F.col("hz"))).alias("b"),
        F.min("hz").alias("_lo"), F.max("hz").alias("_hi"),
    )
    half = spec.join(b.select(*keys, F.col("b.power").alias("_p")), keys).where(F.col("power") >= F.col("_p") / 2).groupBy(*keys).agg(
        F.min("hz").alias("half_lo"), F.max("hz").alias("half_hi")
    )
    n = F.col("b.n").cast("double")
    z = F.least(F.col("b.power"), F.lit(1 - 1e-12))
    w = (fmax - fmin) * F.sqrt(4 * math.pi * F.col("b.tvar"))
    gam = F.sqrt(2 / (n - 1)) * F.exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2))
    tau = gam * w * F.pow(1 - z, 0.5 * (n - 4)) * F.sqrt(0.5 * (n - 1) * z)
    fap = F.when((n < 5) | (z <= 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (1 - F.pow(1 - z, 0.5 * (n - 3))) * F.exp(-tau))))
    d = b.join(half, keys)
    return d.select(
        *keys, F.col("b.hz").alias("hz"), F.col("b.power").alias("power"), F.col("b.amplitude").alias("amplitude"), F.col("b.n").alias("n"),
        F.when(F.col("b.span") > 0, 1 / F.col("b.span")).alias("resolution_hz"), "half_lo", "half_hi",
        ((F.col("b.hz") == F.col("_lo")) | (F.col("b.hz") == F.col("_hi"))).alias("edge"), fap.alias("fap"),
    )


def beat_windows(curve: DataFrame, keys: Sequence[str], window: int, idx: str = "idx") -> DataFrame:
    """A29. Each sample in the windows of ``window`` samples, an eighth apart, that hold it."""
    step = max(1, window // 8)
    hi = F.floor((F.col(idx) - 1) / step)
    lo = F.greatest(F.lit(0), F.ceil((F.col(idx) - window) / step))
    return curve.withColumn("win", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))


def windowed_beat(
    curve: DataFrame, keys: Sequence[str], freqs: Sequence[float], window: int, least_power: float, near: float = 0.5, rate: float = 0.02
) -> DataFrame:
    """A29. The strongest beat of every window; of those passing, the most that do not overlap and lie within ``near`` Hz
    of one another, and the chance of that many at ``rate`` (floor 0.02)."""
    keys = list(keys)
    step = max(1, window // 8)
    n = curve.groupBy(*keys).agg(F.max("idx").alias("_n"))
    w = beat_windows(curve, keys, window).join(n, keys).where(F.col("win") * step + window <= F.col("_n")).drop("_n")
    sp = periodogram(w, [*keys, "win"], freqs)
    best = sp.groupBy(*keys, "win").agg(F.max_by(F.struct("hz", "power", "n"), F.struct(F.col("power"), -F.col("hz"))).alias("b"))
    best = share(best.select(*keys, "win", "b.hz", "b.power").withColumn("passes", F.col("power") >= least_power))
    total = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), F.sum(F.col("passes").cast("int")).alias("passing"))
    # windows near each grid frequency, in order; equal-length windows: the first that starts past the last one's end
    span = F.ceil(F.lit(window / step)).cast("long")
    p = best.where("passes")
    centre = p.select(*keys, F.col("hz").alias("hz0")).distinct()
    near_ = centre.join(p, keys).where(F.abs(F.col("hz") - F.col("hz0")) <= near)
    greedy = lambda arr: F.aggregate(
        arr, F.struct(F.lit(0).alias("k"), F.lit(-(10**9)).cast("long").alias("last")),
        lambda acc, v: F.when(v >= acc["last"] + span, F.struct((acc["k"] + 1).alias("k"), v.cast("long").alias("last"))).otherwise(acc),
    )["k"]
    g = near_.groupBy(*keys, "hz0").agg(F.array_sort(F.collect_set("win")).alias("w")).withColumn("apart", greedy(F.col("w")))
    top = g.groupBy(*keys).agg(F.max_by(F.struct("hz0", "apart"), F.struct(F.col("apart"), -F.col("hz0"))).alias("t"))
    j = total.join(top, keys, "left").select(*keys, "windows", "passing", F.col("t.hz0").alias("hz"), F.coalesce(F.col("t.apart"), F.lit(0)).alias("apart"))
    indep = F.floor((F.col("windows") - 1) / span) + 1
    return j.withColumn("independent", indep).withColumn("chance", binomial_sf(F.col("apart").cast("double"), F.col("independent").cast("double"), F.lit(max(rate, 0.02))))


def object_vs_background(spec: DataFrame, keys: Sequence[str], curve: str = "curve", kind: str = "kind", above: float = 3.0, shared: float = 0.5) -> DataFrame:
    """A30. An object's strongest beat against its background apertures' amplitude at the same frequency: own where it
    is ``above`` times their median, shared where one reaches ``shared`` of it."""
    keys = list(keys)
    o = spec.where(F.col(kind) == "object").groupBy(*keys, curve).agg(F.max_by(F.struct("hz", "amplitude", "power"), F.struct("power", -F.col("hz"))).alias("b"))
    o = o.select(*keys, curve, "b.hz", "b.amplitude", "b.power")
    # a handful of apertures an object
    bg = spec.where(F.col(kind) == "background").groupBy(*keys, "hz").agg(F.percentile("amplitude", F.lit(0.5)).alias("bg"), F.max("amplitude").alias("bg_max"), F.count(F.lit(1)).alias("apertures"))
    j = o.join(bg, [*keys, "hz"], "left")
    return j.withColumn("own", F.col("amplitude") >= above * F.col("bg")).withColumn("shared", F.col("bg_max") >= shared * F.col("amplitude"))


def harmonics(spec: DataFrame, keys: Sequence[str], half: float = 0.5, tol: float = 1e-6) -> DataFrame:
    """A31. The fundamental and its double: a peak at half the strongest's frequency, ``half`` of its power or more,
    makes the strongest a double."""
    keys = list(keys)
    spec = share(spec.select(*keys, "hz", "power"))
    top = spec.groupBy(*keys).agg(F.max_by(F.struct("hz", "power"), F.struct("power", -F.col("hz"))).alias("b")).select(*keys, F.col("b.hz").alias("hz"), F.col("b.power").alias("power"))
    low = spec.select(*keys, F.col("hz").alias("_h"), F.col("power").alias("half_power"))
    j = top.join(low.withColumn("hz2", F.round(F.col("_h") * 2, 9)), top["hz"].eqNullSafe(F.col("hz2")) & (F.lit(True) if not keys else _same(top, low, keys)), "left")
    fund = F.when(F.col("half_power") >= half * F.col("power"), F.col("_h")).otherwise(F.col("hz"))
    return j.select(*[top[k] for k in keys], "hz", "power", fund.alias("fundamental_hz"), (2 * fund).alias("double_hz"))


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    c = F.lit(True)
    for k in keys:
        c = c & (a[k] == b[k])
    return c


def cross_spectrum(spec: DataFrame, keys: Sequence[str], member: str = "curve", hz_apart: float = 0.5, out_of_step: float = 45.0) -> DataFrame:
    """A32. Members of a group against the first: phase at the cross-spectrum's peak; independent where their strongest
    frequencies lie apart or they are over 45 degrees out of step."""
    keys = list(keys)
    s = share(spec.select(*keys, member, "hz", "power", "re", "im"))
    lead = s.groupBy(*keys).agg(F.min(member).alias("_m"))
    a = s.join(lead, keys).where(F.col(member) == F.col("_m")).select(*keys, "hz", F.col("re").alias("ra"), F.col("im").alias("ia"))
    b = s.join(lead, keys).where(F.col(member) != F.col("_m"))
    j = b.join(a, [*keys, "hz"])
    re, im = F.col("ra") * F.col("re") + F.col("ia") * F.col("im"), F.col("ia") * F.col("re") - F.col("ra") * F.col("im")
    j = j.withColumn("xre", re).withColumn("xim", im).withColumn("mag", F.hypot(re, im))
    pk = j.groupBy(*keys, member).agg(F.max_by(F.struct("hz", "xre", "xim"), F.struct("mag", -F.col("hz"))).alias("x"))
    top = s.groupBy(*keys, member).agg(F.max_by(F.col("hz"), F.struct("power", -F.col("hz"))).alias("top_hz"))
    first = top.join(lead, keys).where(F.col(member) == F.col("_m")).select(*keys, F.col("top_hz").alias("lead_hz"))
    d = pk.join(top, [*keys, member]).join(first, keys)
    phase = F.degrees(F.atan2("x.xim", "x.xre"))
    apart = F.abs(F.col("top_hz") - F.col("lead_hz"))
    return d.select(*keys, member, F.col("x.hz").alias("hz"), phase.alias("phase_deg"), apart.alias("apart_hz"), ((apart > hz_apart) | (F.abs(phase) > out_of_step)).alias("independent"))


def epoch_fold(curve: DataFrame, beats: DataFrame, keys: Sequence[str], bins: int = 8, t: str = "t_s", y: str = "dev") -> DataFrame:
    """A33. Mean deviation in phase bins of each curve's beat, and the bright half less the dim half."""
    keys = list(keys)
    d = curve.join(beats.select(*keys, "hz"), keys)
    d = d.withColumn("bin", F.floor(F.pmod(F.col(t) * F.col("hz"), F.lit(1.0)) * bins).cast("int"))
    g = d.groupBy(*keys, "bin").agg(F.avg(y).alias("mean"), F.count(F.lit(1)).alias("n"))
    r = g.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "mean", "n"))).alias("f"), F.max_by("bin", F.struct("mean", -F.col("bin"))).alias("brightest"))  # ``bins`` rows a key
    half = lambda up: F.aggregate(
        F.filter("f", lambda v: (F.pmod(v["bin"] - F.col("brightest") + bins // 4, F.lit(bins)) < bins // 2) == F.lit(up)),
        F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n")), lambda a, v: F.struct((a["s"] + v["mean"] * v["n"]).alias("s"), (a["n"] + v["n"]).alias("n")), lambda a: div(a["s"], a["n"]),
    )
    return r.select(*keys, "brightest", (half(True) - half(False)).alias("depth"))


def regress_out(curve: DataFrame, keys: Sequence[str], x1: Column, x2: Column, y: str = "dev") -> DataFrame:
    """A34. The share of a curve that two regressors explain (pixel phase, or the track's jitter), and the curve without
    them: normal-equation sums, the 2x2 solved in closed form."""
    keys = list(keys)
    d = share(curve.withColumn("_a", x1).withColumn("_b", x2))
    cv = lambda p, q: F.covar_pop(p, q)
    g = d.groupBy(*keys).agg(cv("_a", "_a").alias("aa"), cv("_b", "_b").alias("bb"), cv("_a", "_b").alias("ab"), cv("_a", y).alias("ay"), cv("_b", y).alias("by"), F.var_pop(y).alias("yy"),
                             F.avg("_a").alias("ma"), F.avg("_b").alias("mb"), F.avg(y).alias("my"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    g = g.withColumn("p", F.when(det > 1e-12, (F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / det).otherwise(F.when(F.col("aa") > 0, F.col("ay") / F.col("aa")).otherwise(0.0)))
    g = g.withColumn("q", F.when(det > 1e-12, (F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / det).otherwise(F.lit(0.0)))
    g = g.withColumn("share", F.when(F.col("yy") > 0, (F.col("p") * F.col("ay") + F.col("q") * F.col("by")) / F.col("yy")))
    j = d.join(g.select(*keys, "p", "q", "ma", "mb", "share"), keys)
    return j.withColumn("clean", F.col(y) - F.col("p") * (F.col("_a") - F.col("ma")) - F.col("q") * (F.col("_b") - F.col("mb"))).drop("_a", "_b", "ma", "mb")


def scrambled(curve: DataFrame, keys: Sequence[str], chunk: int, draws: int, seed: int = 0, idx: str = "idx") -> DataFrame:
    """A36. Each curve ``draws`` times with its chunks of ``chunk`` samples in a hashed order: column ``draw`` and the new
    position ``pos``.  Only the list of chunks is ordered; the samples follow by an equi-join."""
    keys = list(keys)
    d = curve.withColumn("_ch", F.floor((F.col(idx) - 1) / chunk))
    ch = d.groupBy(*keys, "_ch").agg(F.count(F.lit(1)).alias("_k")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("_ch").cast("string"), F.col("draw").cast("string")))
    ch = ch.withColumn("_h", key)
    ck = F.conv(F.substring("_h", 1, 3), 16, 10).cast("long")
    off = scan(ch, [*keys, "draw"], "_h", {"_off": ("sum", F.col("_k"))}, exclusive=True, pos_chunk=ck)
    j = d.join(off.select(*keys, "_ch", "draw", F.coalesce("_off", F.lit(0)).alias("_off")), [*keys, "_ch"])
    return j.withColumn("pos", F.col("_off") + F.pmod(F.col(idx) - 1, F.lit(chunk)) + 1).drop("_ch", "_off")


def scrambled_null(curve: DataFrame, keys: Sequence[str], freqs: Sequence[float], fps: float, chunk: int, draws: int, seed: int = 0) -> DataFrame:
    """A36. A curve's strongest beat against the strongest of its scrambled copies: p = (copies as strong + 1)/(draws + 1)."""
    keys = list(keys)
    own = periodogram(curve, keys, freqs).groupBy(*keys).agg(F.max("power").alias("power"))
    s = scrambled(curve, keys, chunk, draws, seed).withColumn("t_s", F.col("pos") / fps)
    null = periodogram(s, [*keys, "draw"], freqs).groupBy(*keys, "draw").agg(F.max("power").alias("_p"))
    j = null.join(own, keys).groupBy(*keys, "power").agg(F.sum((F.col("_p") >= F.col("power")).cast("long")).alias("as_strong"), F.count(F.lit(1)).alias("draws"))
    return j.withColumn("p", (F.col("as_strong") + 1) / (F.col("draws") + 1))


def kpss(series: DataFrame, keys: Sequence[str], lag: int, v: str = "v", chunk: int = CHUNK) -> DataFrame:
    """A37. KPSS about a level: squared running sums of the residuals over n^2 and the long-run variance (Bartlett)."""
    keys = list(keys)
    m = series.groupBy(*keys).agg(F.avg(v).alias("_m"), F.count(F.lit(1)).alias("_n"))
    d = share(series.join(m, keys).select(*keys, "idx", (F.col(v) - F.col("_m")).alias("r"), "_n"))
    d = scan(d, keys, "idx", {"_s": ("sum", F.col("r"))}, chunk=chunk)
    for k in range(1, lag + 1):
        d = rolling(d, keys, "idx", k, -k, {f"_r{k}": F.max("r")}, chunk=chunk)
    n = F.first("_n")
    s2 = F.sum(F.col("r") * F.col("r"))
    for k in range(1, lag + 1):
        s2 = s2 + 2.0 * (1.0 - k / (lag + 1.0)) * F.coalesce(F.sum(F.col("r") * F.col(f"_r{k}")), F.lit(0.0))
    return d.groupBy(*keys).agg(n.alias("n"), (F.sum(F.col("_s") * F.col("_s")) / (n * n)).alias("sums"), F.greatest(s2 / n, F.lit(1e-300)).alias("variance")).withColumn(
        "kpss", F.col("sums") / F.col("variance")
    )


def coverage_backtest(innov: DataFrame, keys: Sequence[str], v: str = "v", z: float = 1.96, lags: int = 5, chunk: int = CHUNK) -> DataFrame:
    """A39. Misses of a stated 95 % band (counts, share, traffic light), whether they come together (Christoffersen), what
    autocorrelation is left (Ljung-Box), and skewness and excess kurtosis (Jarque-Bera)."""
    keys = list(keys)
    d = innov.withColumn("miss", (F.abs(v) > z).cast("int"))
    d = previous(d, keys, "idx", {"_p": F.col("miss")}, chunk=chunk)
    mom = d.groupBy(*keys).agg(F.avg(v).alias("_m"))
    d = share(d.join(mom, keys).withColumn("_w", F.col(v) - F.col("_m")))
    for k in range(1, lags + 1):
        d = rolling(d, keys, "idx", k, -k, {f"_w{k}": F.max("_w")}, chunk=chunk)
    tr = lambda a, b: F.sum(((F.col("_p") == a) & (F.col("miss") == b)).cast("long"))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("miss").alias("misses"), tr(0, 0).alias("n00"), tr(0, 1).alias("n01"), tr(1, 0).alias("n10"), tr(1, 1).alias("n11"),
        F.stddev_pop(v).alias("sd"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"), F.sum(F.col("_w") * F.col("_w")).alias("_g0"),
        *[F.coalesce(F.sum(F.col("_w") * F.col(f"_w{k}")), F.lit(0.0)).alias(f"_g{k}") for k in range(1, lags + 1)],
    )
    n = F.col("n").cast("double")
    q = sum(div(F.pow(div(F.col(f"_g{k}"), F.col("_g0")), 2), n - k) for k in range(1, lags + 1)) * n * (n + 2)
    xl = lambda k, p: F.when(k > 0, k * F.log(p)).otherwise(F.lit(0.0))
    p01, p11 = div(F.col("n01"), F.col("n00") + F.col("n01")), div(F.col("n11"), F.col("n10") + F.col("n11"))
    pi = div(F.col("n01") + F.col("n11"), F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11"))
    l0 = xl(F.col("n00") + F.col("n10"), 1 - pi) + xl(F.col("n01") + F.col("n11"), pi)
    l1 = xl(F.col("n00"), 1 - p01) + xl(F.col("n01"), p01) + xl(F.col("n10"), 1 - p11) + xl(F.col("n11"), p11)
    out = g.withColumn("christoffersen", F.greatest(2 * (l1 - l0), F.lit(0.0))).withColumn("ljung_box", q).withColumn(
        "jarque_bera", n / 6 * (F.pow("skew", 2) + F.pow("kurtosis", 2) / 4)
    )
    # the Basel zones: the chance of fewer misses than were seen, at a stated 5 %
    out = out.withColumn("zone_p", F.when(F.col("misses") > 0, 1 - binomial_sf(F.col("misses").cast("double"), n, F.lit(0.05))).otherwise(F.lit(0.0)))
    light = F.when(F.col("zone_p") >= 0.9999, "red").when(F.col("zone_p") >= 0.95, "yellow").otherwise("green")
    return out.select(*keys, "n", "misses", (F.col("misses") / n).alias("share"), "sd", "skew", "kurtosis", "christoffersen", "ljung_box", "jarque_bera",
                      chi2_sf(F.col("ljung_box"), F.lit(float(lags))).alias("ljung_box_p"), "zone_p", light.alias("light"))


def tau_rates(curve: DataFrame, keys: Sequence[str], size: str, flux: str, background: str, t: str = "t_s") -> DataFrame:
    """A40. d ln size/dt and d ln flux/dt with standard errors, the background's own gain taken out of the flux; tau."""
    keys = list(keys)
    d = curve.where((F.col(size) > 0) & (F.col(flux) > 0) & (F.col(background) > 0))
    d = d.withColumn("_s", F.log(size)).withColumn("_f", F.log(flux) - F.log(background))
    err = lambda c: F.sqrt(div(F.greatest(F.regr_syy(c, t) - F.regr_slope(c, t) * F.regr_sxy(c, t), F.lit(0.0)), (F.count(F.lit(1)) - 2) * F.regr_sxx(c, t)))
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_s", t).alias("size_rate"), err("_s").alias("size_err"), F.regr_slope("_f", t).alias("flux_rate"), err("_f").alias("flux_err")).where(F.col("n") > 2)
    return g.withColumn("tau_s", F.when(F.col("size_rate") != 0, 1 / F.col("size_rate")))


def frame_modulo_lock(curve: DataFrame, keys: Sequence[str], qs: Sequence[int] = range(2, 9), y: str = "dev", frame: str = "frame") -> DataFrame:
    """A68. Brightness deviation by frame modulo 2..8: the spread of the means over the curve's deviation."""
    keys = list(keys)
    d = curve.select(*keys, frame, y, F.explode(F.array(*[F.lit(q) for q in qs])).alias("q"))
    m = d.groupBy(*keys, "q", F.pmod(F.col(frame), F.col("q")).alias("k")).agg(F.avg(y).alias("m")).groupBy(*keys, "q").agg((F.max("m") - F.min("m")).alias("spread"))
    sd = curve.groupBy(*keys).agg(F.stddev_pop(y).alias("sd"))
    return m.join(sd, keys).select(*keys, "q", F.when(F.col("sd") > 0, F.col("spread") / F.col("sd")).alias("lock"))


def held_balance(frames: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """A56. The word of held pictures: share of frames repeated, runs and their mean and longest length.  ``held``: bool."""
    from skyloom.functions.chunked import islands

    keys = list(keys)
    h = islands(frames.where("held"), keys, "idx", chunk=chunk).groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("len"))
    r = h.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.max("len").alias("longest"), F.avg("len").alias("mean_run"))
    s = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.avg(F.col("held").cast("double")).alias("share"))
    return s.join(r, keys, "left")


def inject_recover(curve: DataFrame, keys: Sequence[str], amplitudes: Sequence[float], freqs: Sequence[float], least_power: float, complete: float = 0.75) -> DataFrame:
    """A75. Sinusoids of known amplitude and frequency added to background curves and read by the same periodogram: the
    share of curves they are found in, and the least amplitude found in ``complete`` of them."""
    keys = list(keys)
    pl = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(f)).alias("f")) for a in amplitudes for f in freqs])
    d = curve.select(*keys, "t_s", "dev", F.explode(pl).alias("_p"))
    d = d.select(*keys, "t_s", F.col("_p.a").alias("amplitude"), F.col("_p.f").alias("planted_hz"), (F.col("dev") + F.col("_p.a") * F.sin(TAU * F.col("_p.f") * F.col("t_s"))).alias("dev"))
    sp = _planted(d, keys, freqs)
    found = (F.col("b.hz") == F.col("planted_hz")) & (F.col("b.power") >= least_power)
    cells = share(sp.groupBy("planted_amp", "planted_hz").agg(F.count(F.lit(1)).alias("n"), F.avg(found.cast("double")).alias("found")))
    least = cells.where(F.col("found") >= complete).groupBy("planted_hz").agg(F.min("planted_amp").alias("complete_from"))
    return cells.join(least, "planted_hz", "left")


def _planted(d: DataFrame, keys: list[str], freqs: Sequence[float]) -> DataFrame:
    d = d.withColumnRenamed("amplitude", "planted_amp")
    k = [*keys, "planted_amp", "planted_hz"]
    return periodogram(d, k, freqs).groupBy(*k).agg(F.max_by(F.struct("hz", "power"), F.struct("power", -F.col("hz"))).alias("b"))


def noise_distribution(curve: DataFrame, keys: Sequence[str], freqs: Sequence[float], window: int, probs: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """A76. The windows' amplitude at each frequency as a distribution over all background curves."""
    from skyloom.functions.quantiles import exact_quantiles

    w = beat_windows(curve, keys, window)
    sp = periodogram(w, [*keys, "win"], freqs).where(F.col("n") >= window // 2)
    return exact_quantiles(sp, ["hz"], "amplitude", {f"p{int(round(p * 100))}": p for p in probs})


# ---- look-alikes ------------------------------------------------------------------------------------------------------
def alias_of(hz: Column, fps: Column) -> Column:
    """P12. A true frequency as sampled: folded into 0..fps/2."""
    f = F.abs(hz - F.rint(hz / fps) * fps)
    return F.least(f, fps - f)


def fold_band(bands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P12. A band lo..hi of true frequencies as it appears at ``fps``: cut where the fold turns, the pieces merged."""
    half = F.col("fps") / 2
    k0, k1 = F.floor(F.col("lo") / half) + 1, F.floor(F.col("hi") / half)
    inner = F.when(k1 >= k0, F.transform(F.sequence(k0, k1), lambda k: k * half)).otherwise(F.array().cast("array<double>"))
    edges = F.concat(F.array("lo"), inner, F.array("hi"))
    d = bands.withColumn("_e", edges)
    d = d.withColumn("_p", F.transform(F.sequence(F.lit(0), F.size("_e") - 2), lambda i: F.struct(F.get("_e", i).alias("a"), F.get("_e", i + 1).alias("b"))))
    lo = lambda v: F.least(alias_of(v["a"], F.col("fps")), alias_of(v["b"], F.col("fps")))
    hi = lambda v: F.greatest(alias_of(v["a"], F.col("fps")), alias_of(v["b"], F.col("fps")))
    sorted_ = F.array_sort(F.transform("_p", lambda v: F.struct(lo(v).alias("a"), hi(v).alias("b"))))
    typ = "array<struct<a:double,b:double>>"
    merged = F.aggregate(
        sorted_, F.array().cast(typ),
        lambda acc, v: F.when((F.size(acc) > 0) & (v["a"] <= F.element_at(acc, -1)["b"] + 1e-9),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], v["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(v))),
    )
    return d.select(*keys, F.explode(merged).alias("_m")).select(*keys, F.col("_m.a").alias("first"), F.col("_m.b").alias("last"))


def lookalike_table(videos: DataFrame, low: float = 1.5, top: float = 0.8) -> DataFrame:
    """P13. The rhythms a supply or the sampling can put into a curve at each video's rate: folded lines and fps/k, those
    between ``low`` and ``top`` of the Nyquist frequency."""
    lines = F.array(*[F.struct(F.lit(h).alias("hz"), F.lit(f"{h:g} Hz").alias("source")) for h, _ in LOOKALIKE_LINES])
    a = videos.select("video_id", "fps", F.explode(lines).alias("l")).select("video_id", "fps", alias_of(F.col("l.hz"), F.col("fps")).alias("hz"), "l.source")
    ks = F.array(*[F.lit(k) for k in LOCKED_EVERY])
    b = videos.select("video_id", "fps", F.explode(ks).alias("k")).select("video_id", "fps", (F.col("fps") / F.col("k")).alias("hz"), F.concat(F.lit("fps/"), F.col("k").cast("string")).alias("source"))
    return a.unionByName(b).where((F.col("hz") >= low) & (F.col("hz") <= top * F.col("fps") / 2)).drop("fps")


def hear_lookalikes(beats: DataFrame, table: DataFrame, z: float = 3.0) -> DataFrame:
    """J18. The look-alikes at each beat: within ``z`` of its own error for the frame-locked ones (where it has one),
    within its resolution otherwise.  The table is a dozen rows a video."""
    j = beats.join(table.select("video_id", F.col("hz").alias("line_hz"), "source"), "video_id")
    reach = F.when(F.col("err").isNotNull() & F.col("source").startswith("fps/"), z * F.col("err")).otherwise(F.col("resolution"))
    return j.where(F.abs(F.col("hz") - F.col("line_hz")) <= reach)


def beat_right(rows: DataFrame, planted: str, lines: str) -> DataFrame:
    """A7. Whether a planted beat is among the called lines (``lines``: array of hz, double_hz, resolution): one within
    two resolutions of it or of its double, or whose own double is.  No lines: not right."""
    near = lambda v: F.least(
        F.abs(v["hz"] - F.col(planted)), F.abs(v["hz"] - 2 * F.col(planted)), F.coalesce(F.abs(v["double_hz"] - F.col(planted)), F.lit(1e9))
    ) <= 2 * F.coalesce(v["resolution"], F.lit(0.5))
    return rows.withColumn("right", F.coalesce(F.exists(lines, near), F.lit(False)))


def interval_cover(pieces: DataFrame, keys: Sequence[str], lo: float | Column, hi: float | Column, **kw) -> DataFrame:
    """U5. The share of a band (or clip) that a set of intervals covers."""
    from skyloom.operators.windows import merge_intervals

    lo = F.lit(lo) if not isinstance(lo, Column) else lo
    hi = F.lit(hi) if not isinstance(hi, Column) else hi
    c = pieces.withColumn("first", F.greatest("first", lo)).withColumn("last", F.least("last", hi)).where(F.col("last") > F.col("first"))
    m = merge_intervals(c, keys, **kw)
    return m.groupBy(*keys).agg((F.sum(F.col("last") - F.col("first")) / (F.max(hi) - F.min(lo))).alias("share"))
