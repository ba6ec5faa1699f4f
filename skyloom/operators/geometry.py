"""Angles, ranges, heights, speeds and units as column expressions over whole tables; lines of sight to paths as sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from skyloom.functions.safe import div
from skyloom.functions.chunked import CHUNK, previous, scan
from skyloom.functions.lineage import share

# fixed values: physical constants and unit factors
G0 = 9.80665
R_EARTH = 6371000.0
KAPPA_BAND = (0.0, 0.13, 0.25)  # refraction: low, nominal, high
KN, FT, MPH, KMH, MI, NM, INCH = 0.514444, 0.3048, 0.44704, 1 / 3.6, 1609.344, 1852.0, 0.0254
UNITS = {
    "m/s": 1.0, "mps": 1.0, "kt": KN, "kts": KN, "knot": KN, "knots": KN, "mph": MPH, "km/h": KMH, "kph": KMH, "kmh": KMH,
    "m": 1.0, "km": 1000.0, "ft": FT, "mi": MI, "nm": NM, "in": INCH, "mm": 0.001, "cm": 0.01, "fpm": FT / 60, "ft/min": FT / 60,
}


def wrap180(a: Column) -> Column:
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


_WHOLE = {f: [f(math.radians(d)) for d in range(360)] for f in (math.sin, math.cos)}


def sin_cos(deg: Column) -> tuple[Column, Column]:
    """Sine and cosine of degrees.  Whole ones are looked up as the C library has them: the JVM's own are off by a last bit at
    some (183, 297), and whether a double root counts may hang on that bit."""
    whole = (deg >= 0) & (deg < 360) & (deg == F.floor(deg))
    pick = lambda f, own: F.when(whole, F.get(F.lit(_WHOLE[f]), deg.cast("int"))).otherwise(own(F.radians(deg)))
    return pick(math.sin, F.sin), pick(math.cos, F.cos)


# ---- rates and speeds -------------------------------------------------------------------------------------------------
def angular_rate(df: DataFrame, v: str = "v_px", k: str = "k", alpha: str = "alpha_deg", width: str = "width_px") -> DataFrame:
    """P2. Angular rate from pixels: k at the object's angle off the axis is k sec^2(alpha); the field of view that k
    means, by the tangent and by the small-angle model; none where k has no provenance."""
    kk = F.col(k) / F.pow(F.cos(F.radians(alpha)), 2)
    known = F.col("provenance").isin("graticule", "fov", "reference")
    return df.withColumns({
        "omega_rad_s": F.when(known, div(F.col(v), kk)),
        "fov_deg": F.when(known, F.degrees(2 * F.atan(div(F.col(width) / 2, F.col(k))))),
        "fov_small_deg": F.when(known, F.degrees(div(F.col(width), F.col(k)))),
    })


def fan(df: DataFrame, ranges_m: Sequence[float], thetas_deg: Sequence[float], omega: str = "omega_rad_s") -> DataFrame:
    """P3. Relative speed omega R / sin(theta) on a grid of ranges and aspects; 90 degrees is the lower bound."""
    g = F.array(*[F.struct(F.lit(float(r)).alias("range_m"), F.lit(float(a)).alias("theta_deg")) for r in ranges_m for a in thetas_deg])
    d = df.withColumn("_g", F.explode(g)).select(*df.columns, "_g.*")
    return d.withColumn("speed_m_s", F.col(omega) * F.col("range_m") / F.sin(F.radians("theta_deg")))


def fov_ladder(df: DataFrame, fovs_deg: Sequence[float] = (0.7, 3, 10, 30, 54), ranges_m: Sequence[float] = (3000, 5000, 10000)) -> DataFrame:
    """P3. What each field of view would imply where none is known: k, the angular rate, and the speed at each range."""
    g = F.array(*[F.struct(F.lit(float(f)).alias("fov_deg"), F.lit(float(r)).alias("range_m")) for f in fovs_deg for r in ranges_m])
    d = df.withColumn("_g", F.explode(g)).select(*df.columns, "_g.*")
    d = d.withColumn("k", F.col("width_px") / 2 / F.tan(F.radians("fov_deg") / 2)).withColumn("omega", F.col("v_px") / F.col("k"))
    return d.withColumn("speed_m_s", F.col("omega") * F.col("range_m"))


def scale_free_speed(df: DataFrame) -> DataFrame:
    """P4. Body lengths a second as a lower bound, and the scale-bar speed v / ref_px * ref_len * range ratio."""
    return df.withColumn("lengths_per_s", F.col("v_px") / F.nullif(F.col("size_px"), F.lit(0.0))).withColumn(
        "bar_m_s", F.col("v_px") / F.nullif(F.col("ref_px"), F.lit(0.0)) * F.col("ref_len_m") * F.coalesce("range_ratio", F.lit(1.0))
    )


def load_factor_curve(turns: DataFrame, classes: DataFrame) -> DataFrame:
    """P5. The fastest level-turn speed g sqrt(n^2-1)/omega at each class's load limit.  Classes are a short dimension,
    sent whole after the caller's aggregate (one row a class)."""
    j = turns.join(F.broadcast(classes.select("class", "load_limit_g")), F.col("load_limit_g") > 1)
    return j.withColumn("speed_m_s", F.when(F.col("omega_rad_s") > 0, G0 * F.sqrt(F.pow("load_limit_g", 2) - 1) / F.col("omega_rad_s")))


def parallax_ladder(df: DataFrame, speeds: Sequence[float]) -> DataFrame:
    """P6. For each assumed own speed: the range of k = (range to ground)/(range to object) from speeds alone, and with
    both bearings the roots k >= 1 of k vO = |vG + (k-1) vA|, a quadratic solved in closed form; height ratio 1 - 1/k.
    Columns: v_ground, v_own, own_heading, ground_bearing (degrees, null where unknown)."""
    d = df.withColumn("v_obj", F.explode(F.array(*[F.lit(float(s)) for s in speeds])))
    vg, va, vo = F.col("v_ground"), F.col("v_own"), F.col("v_obj")
    lo = F.when(va + vo > 0, F.greatest(F.lit(1.0), (vg + va) / (va + vo)))
    hi = F.when(va > vo, (vg + va) / (va - vo))
    gap = lo.isNotNull() & hi.isNotNull() & (hi < lo)
    (gs, gc), (hs, hc) = sin_cos(F.col("ground_bearing")), sin_cos(F.col("own_heading"))
    gx, gy, ax, ay = vg * gs, vg * gc, va * hs, va * hc
    d = d.withColumns({"_dx": gx - ax, "_dy": gy - ay, "_ax": ax, "_ay": ay})
    # |D + kA|^2 = k^2 vO^2 with D = G - A
    qa = va * va - vo * vo
    qb = 2 * (F.col("_ax") * F.col("_dx") + F.col("_ay") * F.col("_dy"))
    qc = F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")
    d = d.withColumns({"_a": qa, "_b": qb, "_c": qc})
    disc = F.col("_b") * F.col("_b") - 4 * F.col("_a") * F.col("_c")
    d = d.withColumn("_disc", disc)
    lin = F.when(F.col("_b") != 0, -F.col("_c") / F.col("_b"))
    s = F.sqrt(F.when(F.col("_disc") >= 0, F.col("_disc")))
    r1 = F.when(F.abs("_a") < 1e-12, lin).otherwise((-F.col("_b") - s) / (2 * F.col("_a")))
    r2 = F.when(F.abs("_a") < 1e-12, F.lit(None).cast("double")).otherwise((-F.col("_b") + s) / (2 * F.col("_a")))
    roots = F.array_sort(F.filter(F.array(r1, r2), lambda k: k.isNotNull() & (k >= 1 - 1e-12)))
    roots = F.when(F.col("own_heading").isNotNull() & F.col("ground_bearing").isNotNull(), roots)
    # standing still: the own speed left at the foot of the perpendicular from nought onto A + u D, u = 1/k
    u = F.when(F.col("_c") < 1e-18, F.lit(1.0)).otherwise(F.least(F.lit(1.0), -(F.col("_b") / 2) / F.col("_c")))
    u = F.greatest(u, F.lit(0.0))
    need = F.hypot(F.col("_ax") + u * F.col("_dx"), F.col("_ay") + u * F.col("_dy"))
    d = d.withColumns({
        "k_min": F.when(~F.coalesce(gap, F.lit(False)), lo), "k_max": F.when(~F.coalesce(gap, F.lit(False)), hi), "k": roots,
        "still_needs_m_s": F.when((vo == 0) & F.col("own_heading").isNotNull() & F.col("ground_bearing").isNotNull(), need),
    })
    d = d.withColumn("h_ratio", F.transform("k", lambda k: 1 - 1 / k))
    return d.drop("_dx", "_dy", "_ax", "_ay", "_a", "_b", "_c", "_disc")


# ---- horizon, haze, focus ---------------------------------------------------------------------------------------------
def _rp(kappa: Column) -> Column:
    return R_EARTH / (1.0 - kappa)


TANGENT = 1e-12  # radians from the horizon that count as on it: such a ray neither meets the surface nor clears it


def _dip(h: Column, kappa: float) -> Column:
    """The horizon's depression seen from height ``h`` over a sphere that refraction ``kappa`` flattens."""
    r = _rp(F.lit(kappa))
    return F.acos(r / (r + h))


def _surface_range(below: Column, h: Column, kappa: float) -> Column:
    """Length of the ray that meets the surface ``below`` (radians) the horizon; endless where none does."""
    r = _rp(F.lit(kappa))
    down, far = _dip(h, kappa) + below, r + h
    left = F.pow(far * F.sin(down), 2) - (2 * r * h + h * h)
    return F.when((below > TANGENT) & (left >= 0), far * F.sin(down) - F.sqrt(left)).otherwise(F.lit(float("inf")))


def _least_height(below: Column, h: Column, kappa: float) -> Column:
    """How near the surface the ray comes that leaves ``-below`` (radians) over the horizon."""
    r, up = _rp(F.lit(kappa)), -_dip(h, kappa) - below
    return F.when(below >= -TANGENT, F.lit(float("-inf"))).when(up >= 0, h).otherwise((r + h) * F.cos(up) - r)


def horizon_bounds(df: DataFrame, band: Sequence[float] = KAPPA_BAND) -> DataFrame:
    """P7. From the angle below (+) or above the horizon line and its error, the height h and its error and k's share of
    error: the largest range of a point on the surface, or the least height of one above; outcome where refused (a band that
    reaches 1).

    A ray reaches farther the flatter it leaves, the higher its start and the stronger the refraction; it passes lower the
    steeper it leaves, the lower its start and the weaker the refraction.  So each bound is the value at one extreme of all inputs."""
    weak, nominal, strong = (float(k) for k in band)
    if strong >= 1:
        return df.withColumns({"range_max_m": F.lit(None).cast("double"), "height_min_m": F.lit(None).cast("double"), "outcome": F.lit("cannot say")})
    least, most = F.col("delta_deg") - F.col("delta_err_deg"), F.col("delta_deg") + F.col("delta_err_deg")
    flattest, steepest = F.radians(least - F.abs(least) * F.col("k_share")), F.radians(most + F.abs(most) * F.col("k_share"))
    height = lambda side: F.greatest(F.col("h_m") + side * F.col("h_err_m"), F.lit(0.0))
    told, below = F.radians("delta_deg"), F.col("delta_deg") > 0
    return df.withColumns({
        "below": below,
        "range_max_m": F.when(below, _surface_range(flattest, height(1), strong)), "range_nominal_m": F.when(below, _surface_range(told, height(0), nominal)),
        "height_min_m": F.when(~below, _least_height(steepest, height(-1), weak)), "height_nominal_m": F.when(~below, _least_height(told, height(0), nominal)),
        "outcome": F.lit("pass"),
    })


def haze_range(df: DataFrame) -> DataFrame:
    """P7. Range bound from what is left of an object's contrast at a visibility (Koschmieder: 3.912 / visibility)."""
    c = F.col("contrast")
    return df.withColumn("haze_max_m", F.when((c > 0) & (c < 1) & (F.col("visibility_m") > 0), -F.log(c) * F.col("visibility_m") / 3.912))


def focus_floor(df: DataFrame) -> DataFrame:
    """P7. The least range a sharp object can have: pupil over the angle of the blur disc."""
    return df.withColumn("focus_min_m", F.when(F.col("disc_rad") > 0, F.col("pupil_m") / F.col("disc_rad")))


# ---- frames of reference ----------------------------------------------------------------------------------------------
WGS_A, WGS_F = 6378137.0, 1 / 298.257223563  # fixed values: the reference ellipsoid
WGS_E2 = WGS_F * (2 - WGS_F)


def ecef(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    """P8. Geodetic to earth-centred coordinates."""
    la, lo = F.radians(lat), F.radians(lon)
    n = WGS_A / F.sqrt(1 - WGS_E2 * F.pow(F.sin(la), 2))
    return (n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * (1 - WGS_E2) + h) * F.sin(la)


def enu(df: DataFrame, lat: str, lon: str, h: str, lat0: str, lon0: str, h0: str) -> DataFrame:
    """P8. East, north and up of a place from another."""
    x, y, z = ecef(F.col(lat), F.col(lon), F.col(h))
    x0, y0, z0 = ecef(F.col(lat0), F.col(lon0), F.col(h0))
    d = df.withColumns({"_x": x - x0, "_y": y - y0, "_z": z - z0})
    la, lo = F.radians(lat0), F.radians(lon0)
    e = -F.sin(lo) * F.col("_x") + F.cos(lo) * F.col("_y")
    n = -F.sin(la) * F.cos(lo) * F.col("_x") - F.sin(la) * F.sin(lo) * F.col("_y") + F.cos(la) * F.col("_z")
    u = F.cos(la) * F.cos(lo) * F.col("_x") + F.cos(la) * F.sin(lo) * F.col("_y") + F.sin(la) * F.col("_z")
    return d.withColumns({"east_m": e, "north_m": n, "up_m": u}).drop("_x", "_y", "_z")


def rays(df: DataFrame) -> DataFrame:
    """P8. Azimuth and depression of a line of sight to a ground point, turned by its offset on the picture."""
    az = F.pmod(F.degrees(F.atan2("east_m", "north_m")) + F.coalesce("off_right_deg", F.lit(0.0)), F.lit(360.0))
    dep = F.degrees(F.atan2(-F.col("up_m"), F.hypot("east_m", "north_m"))) + F.coalesce("off_down_deg", F.lit(0.0))
    return df.withColumns({"az_deg": az, "dep_deg": dep, "range_m": F.sqrt(F.pow("east_m", 2) + F.pow("north_m", 2) + F.pow("up_m", 2))})


def undistort(df: DataFrame, k1: float, k2: float, f: float, cx: float, cy: float, steps: int = 8) -> DataFrame:
    """P9. Where a pinhole would have put points drawn by a radial lens: r (1 + k1 r^2 + k2 r^4) = r_d by ``steps``
    Newton steps, unrolled over a short array."""
    rd = F.hypot(F.col("x") - cx, F.col("y") - cy) / f
    radial = lambda r: 1 + k1 * r * r + k2 * r * r * r * r
    slope = lambda r: 1 + 3 * k1 * r * r + 5 * k2 * r * r * r * r
    d = df.withColumn("_rd", rd)
    r = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("_rd"), lambda r, _: F.greatest(r - (r * radial(r) - F.col("_rd")) / slope(r), F.lit(0.0)))
    d = d.withColumn("_gain", F.when(F.col("_rd") > 0, r / F.col("_rd")).otherwise(F.lit(1.0)))
    return d.withColumn("x_true", cx + (F.col("x") - cx) * F.col("_gain")).withColumn("y_true", cy + (F.col("y") - cy) * F.col("_gain")).drop("_rd", "_gain")


def path_growth(df: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """P9. How much longer an undistorted track is than as drawn."""
    d = previous(df, keys, "frame", {"_p": F.struct("x", "y", "x_true", "y_true")}, chunk=chunk).where(F.col("_p").isNotNull())
    seg = lambda a, b: F.sum(F.hypot(F.col(a) - F.col(f"_p.{a}"), F.col(b) - F.col(f"_p.{b}")))
    g = d.groupBy(*keys).agg(seg("x", "y").alias("drawn_px"), seg("x_true", "y_true").alias("true_px"))
    return g.withColumn("growth", F.when(F.col("drawn_px") > 0, F.col("true_px") / F.col("drawn_px")))


def to_one_scale(track: DataFrame, steps: DataFrame, cx: float, cy: float, chunk: int = CHUNK) -> DataFrame:
    """P10. Positions after applied zoom steps taken back about the centre: the product of the steps so far (a running
    sum of logs, looked up as of the frame)."""
    from skyloom.functions.joins import asof

    c = scan(steps, ["video_id"], "frame", {"_ln": ("sum", F.log("ratio"))}, chunk=chunk)
    d = asof(track, c.select("video_id", "frame", "_ln"), ["video_id"], "frame", {"_z": ("last", "_ln")}, chunk)
    s = F.exp(F.coalesce("_z", F.lit(0.0)))
    return d.withColumn("x", cx + (F.col("x") - cx) / s).withColumn("y", cy + (F.col("y") - cy) / s).drop("_z")


def screen_bearing(df: DataFrame) -> DataFrame:
    """P17. Compass bearing of a screen direction under a north pointer, and the sense the pointer turns."""
    return df.withColumn("bearing_deg", F.pmod(F.col("screen_dir_deg") - F.col("theta_north_deg"), F.lit(360.0))).withColumn(
        "sense", F.when(F.abs("dtheta_dt") <= F.col("resolvable"), "none").when(F.col("dtheta_dt") > 0, "left").otherwise("right")
    )


def _quantity(token: Column) -> tuple[Column, Column]:
    """Number and unit of a token such as ``12.5kt``; null where it has not that form."""
    digits = F.regexp_extract(token, "^[-+.0-9]*", 0)
    unit = F.substring(token, F.length(digits) + 1, F.length(token))
    return F.when(unit.rlike("^[a-z/]*$"), digits.try_cast("double")), unit


def normalise_units(df: DataFrame, text: str) -> DataFrame:
    """P16. A reading with its unit to SI: value, unit and whether it could be read; an indicated airspeed with the height it was
    read at becomes true airspeed in the standard atmosphere."""
    tokens = F.split(F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("")), "@")
    value, unit = _quantity(F.get(tokens, 0))
    height, of_height = _quantity(F.get(tokens, 1))
    metres = height * F.when(of_height.isin("", "ft"), FT).when(of_height == "m", 1.0)
    indicated = unit.isin("kias", "kcas") & (F.size(tokens) == 2) & (value >= 0) & (height >= 0)
    table = F.create_map(*[F.lit(v) for kv in UNITS.items() for v in kv])
    plain = F.when(F.size(tokens) == 1, value * F.when(unit == "", F.lit(1.0)).otherwise(F.try_element_at(table, unit)))
    v = F.when(indicated, value * KN / F.sqrt(isa_density_ratio(metres, F.lit(0.0)))).otherwise(plain)
    said = F.when(indicated, F.lit("kias")).when((F.size(tokens) == 1) & value.isNotNull(), unit).otherwise(F.lit(""))
    return df.withColumn("si", v).withColumn("unit", said).withColumn("readable", v.isNotNull())


def isa_density_ratio(alt_m: Column, dt: Column) -> Column:
    t = 288.15 - 0.0065 * alt_m + dt
    return F.pow(1 - 0.0065 * alt_m / 288.15, F.lit(G0 / (287.053 * 0.0065))) * (288.15 / t)


# ---- lines of sight ---------------------------------------------------------------------------------------------------
@F.pandas_udf(ArrayType(DoubleType()))
def solve_normal(a: pd.Series, b: pd.Series) -> pd.Series:
    """The solution and its covariance diagonal of one small set of normal equations a row (row-major matrix)."""
    out = []
    for m, v in zip(a, b):
        n = len(v)
        mat, vec = np.array(m, float).reshape(n, n), np.array(v, float)
        if not np.isfinite(mat).all() or np.linalg.cond(mat) > 1e14:
            out.append(None)
            continue
        inv = np.linalg.inv(mat)
        out.append([*(inv @ vec), *np.diag(inv)])
    return pd.Series(out)


def ray_intersection(los: DataFrame, rounds: int = 5) -> DataFrame:
    """A41. A straight steady path (position at the mean time and velocity) through many rays of one or several cameras.

    Each ray gives two linear equations in the six unknowns; a case's 6 x 6 sums are one small row, solved there; the
    equations are weighed again by the range of the path just found.  Columns: case_id, t_s, e, n, u (camera), az_deg,
    dep_deg."""
    az, dep = F.radians("az_deg"), F.radians("dep_deg")
    mt = los.groupBy("case_id").agg(F.avg("t_s").alias("_t0"))
    d = los.join(mt, "case_id").withColumn("_t", F.col("t_s") - F.col("_t0"))
    # two directions across the ray: to its right, and up from it
    right = (F.cos(az), -F.sin(az), F.lit(0.0))
    up = (F.sin(az) * F.sin(dep), F.cos(az) * F.sin(dep), F.cos(dep))
    fwd = (F.sin(az) * F.cos(dep), F.cos(az) * F.cos(dep), -F.sin(dep))
    row = lambda v: F.array(v[0], v[1], v[2], v[0] * F.col("_t"), v[1] * F.col("_t"), v[2] * F.col("_t"))
    rhs = lambda v: v[0] * F.col("e") + v[1] * F.col("n") + v[2] * F.col("u")
    d = d.select("case_id", "_t", "e", "n", "u", F.struct(*[c.alias(f"f{i}") for i, c in enumerate(fwd)]).alias("fwd"),
                 F.array(F.struct(row(right).alias("r"), rhs(right).alias("b")), F.struct(row(up).alias("r"), rhs(up).alias("b"))).alias("eq"), F.lit(1.0).alias("w"))
    d = share(d)
    sol = None
    for _ in range(rounds):
        eq = d.select("case_id", "w", F.explode("eq").alias("q"))
        a = [F.sum(F.col("w") * F.get("q.r", F.lit(i)) * F.get("q.r", F.lit(j))) for i in range(6) for j in range(6)]
        b = [F.sum(F.col("w") * F.get("q.r", F.lit(i)) * F.col("q.b")) for i in range(6)]
        s = eq.groupBy("case_id").agg(F.array(*a).alias("_a"), F.array(*b).alias("_b"), F.count(F.lit(1)).alias("equations"))
        sol = share(s.select("case_id", "equations", solve_normal("_a", "_b").alias("s")).where(F.col("s").isNotNull()))
        p = lambda i: F.get("s", F.lit(i)) + F.get("s", F.lit(i + 3)) * F.col("_t")
        rng = (p(0) - F.col("e")) * F.col("fwd.f0") + (p(1) - F.col("n")) * F.col("fwd.f1") + (p(2) - F.col("u")) * F.col("fwd.f2")
        d = d.drop("w").join(sol.select("case_id", "s"), "case_id").withColumn("w", 1 / F.greatest(rng * rng, F.lit(1.0))).drop("s")
    # misses across the rays as angles, and the errors they give
    m = d.select("case_id", "w", F.explode("eq").alias("q")).join(sol, "case_id")
    fit = sum(F.get("q.r", F.lit(i)) * F.get("s", F.lit(i)) for i in range(6))
    r = m.groupBy("case_id").agg(F.sum(F.col("w") * F.pow(F.col("q.b") - fit, 2)).alias("_ss"), F.count(F.lit(1)).alias("_k"))
    var = F.col("_ss") / F.greatest(F.col("_k") - 6, F.lit(1))
    g = sol.join(r, "case_id")
    c = lambda i: F.get("s", F.lit(i))
    return g.select(
        "case_id", (F.col("equations") / 2).cast("long").alias("rays"), c(0).alias("east_m"), c(1).alias("north_m"), c(2).alias("up_m"),
        c(3).alias("ve"), c(4).alias("vn"), c(5).alias("vu"), F.sqrt(var * (c(9) + c(10))).alias("velocity_err"),
        F.degrees(F.sqrt(F.col("_ss") / F.col("_k"))).alias("rms_deg"),
    )


def class_envelope(rows: DataFrame) -> DataFrame:
    """A59. Each class's bounds over its members: speed in body lengths a second, top speed, length, load."""
    d = rows.withColumn("lo", F.col("speed_min_m_s") / F.nullif(F.col("length_m"), F.lit(0.0))).withColumn("hi", F.col("speed_max_m_s") / F.nullif(F.col("length_m"), F.lit(0.0)))
    return d.groupBy("class").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("speed_max_m_s").alias("top_m_s"), F.max("load_limit_g").alias("load_limit_g"),
                                  F.min("length_m").alias("length_min_m"), F.max("length_m").alias("length_max_m"))


def against_classes(bounds: DataFrame, members: DataFrame, strongest_wind: float = 113.0) -> DataFrame:
    """J20. A lower bound in body lengths a second against each class: within its range or under it (allowed: nothing is
    excluded for being slow), over it but reachable with a tail wind (the least over its members of per_s x length less
    top speed), or outside even the strongest wind.  The class table is a short dimension.

    Of members of one length only the fastest can give the least, and of those left only one that is faster than every shorter
    one (for bounds of nought or more) or than every longer one (for bounds below)."""
    cls = class_envelope(members)
    fastest = members.where(F.col("speed_max_m_s").isNotNull() & F.col("length_m").isNotNull()).groupBy("class", "length_m").agg(F.max("speed_max_m_s").alias("speed_max_m_s"))
    m = fastest.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("length_m", "speed_max_m_s"))).alias("_m"))
    # members from the shorter (longer) end that beat all before them
    beat = lambda ms: F.aggregate(
        ms, F.array().cast("array<struct<length_m:double,speed_max_m_s:double>>"),
        lambda acc, v: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["speed_max_m_s"] >= v["speed_max_m_s"]), acc).otherwise(F.concat(acc, F.array(v))))
    m = m.select("class", beat(F.col("_m")).alias("_up"), beat(F.reverse("_m")).alias("_down"))
    j = bounds.crossJoin(F.broadcast(cls.join(m, "class", "left")))
    least = lambda ms: F.array_min(F.transform(ms, lambda v: F.col("per_s") * v["length_m"] - v["speed_max_m_s"]))
    wind = F.when(F.col("per_s") >= 0, least("_up")).otherwise(least("_down"))
    j = j.withColumn("wind_m_s", F.when(F.col("per_s") > F.col("hi"), F.greatest(wind, F.lit(0.0))))
    return j.withColumn("answer", F.when(F.col("per_s") <= F.col("hi"), F.when(F.col("per_s") >= F.col("lo"), "within").otherwise("slower, allowed")).when(F.col("wind_m_s") <= strongest_wind, "with a wind").otherwise("outside")).select(
        *bounds.columns, "class", "answer", "wind_m_s")
