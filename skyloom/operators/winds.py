"""Winds: at a height and hour, against a path, against soundings, and how they change with height."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions.safe import div
from skyloom.functions import draws as dr
from skyloom.functions.lineage import share
from skyloom.functions.quantiles import exact_quantiles

# fixed values: the test's allowances
FLIER_MIN, VELOCITY_FIX, NEAR_LEVEL, MODEL_ERR = 10.0, 5.0, 4.0, 2.0
SHEAR_AT_KM, SHEAR_POWER = 10.3, 0.57


def wind_uv(speed: Column, from_deg: Column) -> tuple[Column, Column]:
    return -speed * F.sin(F.radians(from_deg)), -speed * F.cos(F.radians(from_deg))


def wind_change(dz: Column) -> Column:
    """J16. How far the wind may differ over ``dz`` metres of height (nine soundings in ten)."""
    return F.when(F.coalesce(dz, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(SHEAR_AT_KM * F.pow(F.abs(dz) / 1000.0, F.lit(SHEAR_POWER)))


#: What a wind at a height is asked by; paths equal in these have the same winds.
PLACE = ("t_s", "height_m", "ground_m")


def wind_at_height(paths: DataFrame, winds: DataFrame, within_s: int = 3600) -> DataFrame:
    """J15. The wind of every source and hour near a path's time at the path's height: drawn between the bracketing
    levels (in the log of the height above ground for an observed source), held at the nearest level beyond them, which
    counts only within NEAR_LEVEL in height ratio.

    ``paths``: case_id, t_s, height_m, ground_m; ``winds``: source, kind (model, observed), t_s, z_m, u, v, ground_m.
    Levels are looked up once for paths of one PLACE (``winds_at``); a path then only fetches its place's winds."""
    return at_place(paths.select("case_id", *PLACE), winds_at(paths, winds, within_s), PLACE, "inner").select("case_id", "source", "kind", "t_wind", "u", "v", "gap_m", "counts")


def at_place(left: DataFrame, right: DataFrame, place: Sequence[str], how: str) -> DataFrame:
    """``left`` with the columns of ``right`` of its place; an unknown height is a place too."""
    right = right.withColumnsRenamed({k: f"_of_{k}" for k in place})
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in place], how).drop(*[f"_of_{k}" for k in place])


def winds_at(paths: DataFrame, winds: DataFrame, within_s: int = 3600) -> DataFrame:
    """J15. ``wind_at_height`` by PLACE: its rows for each of the paths' places.

    The hour is the equi-join key (each place meets its own hour and the two beside it); a source and hour's levels are
    one profile, combined before they meet a place."""
    prof = winds.groupBy("source", "kind", "t_s").agg(
        F.array_sort(F.collect_list(F.struct("z_m", "u", "v"))).alias("lv"), F.first("ground_m").alias("wg")
    ).withColumn("_h", F.floor(F.col("t_s") / within_s)).withColumnRenamed("t_s", "wt")
    p = paths.select(*PLACE).distinct()
    p = p.withColumn("_h", F.explode(F.sequence(F.floor(F.col("t_s") / within_s) - 1, F.floor(F.col("t_s") / within_s) + 1)))
    j = p.join(prof, "_h").where(F.abs(F.col("wt") - F.col("t_s")) <= within_s).drop("_h")
    h = F.col("height_m")
    below = F.filter("lv", lambda l: l["z_m"] <= h)
    above = F.filter("lv", lambda l: l["z_m"] >= h)
    j = j.withColumn("_b", F.when(F.size(below) > 0, F.element_at(below, -1))).withColumn("_a", F.when(F.size(above) > 0, F.element_at(above, 1)))
    ground = F.when(F.col("kind") == "observed", F.coalesce("ground_m", F.lit(0.0))).otherwise(F.coalesce("wg", F.lit(0.0)))
    over = lambda z: F.greatest(z - ground, F.lit(1.0))
    logs = (F.col("kind") == "observed") & F.col("ground_m").isNotNull()
    pos = lambda z: F.when(logs, F.log(over(z))).otherwise(z)
    inside = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    s = F.when(F.col("_a.z_m") == F.col("_b.z_m"), F.lit(0.0)).otherwise((pos(h) - pos(F.col("_b.z_m"))) / (pos(F.col("_a.z_m")) - pos(F.col("_b.z_m"))))
    mix = lambda c: F.when(inside, F.col(f"_b.{c}") + s * (F.col(f"_a.{c}") - F.col(f"_b.{c}"))).otherwise(F.coalesce(F.col(f"_b.{c}"), F.col(f"_a.{c}")))
    zl = F.coalesce(F.col("_b.z_m"), F.col("_a.z_m"))
    ratio = F.greatest(over(zl), over(h)) / F.least(over(zl), over(h))
    return j.select(
        *PLACE, "source", "kind", F.col("wt").alias("t_wind"), mix("u").alias("u"), mix("v").alias("v"),
        F.when(inside, F.lit(0.0)).otherwise(F.abs(zl - h)).alias("gap_m"), (inside | (ratio <= NEAR_LEVEL)).alias("counts"),
    )


def drift_wind_test(paths: DataFrame, winds: DataFrame, place: Sequence[str] = ("case_id",)) -> DataFrame:
    """J16. Whether a path's motion over the ground fits the winds that count at its height: pass, fail or cannot say, in
    the order the reasons are asked.  ``paths``: case_id, ve, vn, velocity_err (null where the rays fix no path);
    ``winds``: as ``wind_at_height`` gives them, with err_m_s where a source states its own.

    Winds may be keyed by ``place`` instead of the case, columns that the paths carry (PLACE for ``winds_at``).  A place's
    counting winds are its sources and hours: a short list, whose spread is found once for all cases there."""
    place = list(place)
    d = at_place(paths.select(*dict.fromkeys(["case_id", *place]), "ve", "vn", "velocity_err"), _winds_of(winds, place), place, "left")
    return _judged(_needs(d)).select("case_id", "winds", "need_min", "need_max", "spread", "shear", "tolerance", "outcome", "why")


def _winds_of(winds: DataFrame, place: list[str]) -> DataFrame:
    """A place's counting winds in one row: their number, spread and list."""
    g = winds.where("counts").groupBy(*place).agg(
        F.count(F.lit(1)).alias("winds"), F.min("gap_m").alias("gap_m"),
        F.min(F.hypot("u", "v")).alias("still_min"), F.max((F.col("kind") == "model").cast("int")).alias("_model"),
        F.max(2 * F.coalesce("err_m_s", F.lit(0.0))).alias("_own"), F.collect_list(F.struct("u", "v")).alias("_w"),
    )
    far = F.aggregate("_w", F.lit(0.0), lambda a, p: F.greatest(a, F.aggregate("_w", F.lit(0.0), lambda b, q: F.greatest(b, F.hypot(p["u"] - q["u"], p["v"] - q["v"])))))
    return g.withColumn("spread", F.greatest(F.lit(0.25), far))


def _needs(d: DataFrame) -> DataFrame:
    """The least and the most airspeed that a motion needs among its place's winds."""
    d = d.withColumn("_need", F.transform("_w", lambda p: F.hypot(F.col("ve") - p["u"], F.col("vn") - p["v"]))).drop("_w")
    return d.withColumns({"need_min": F.array_min("_need"), "need_max": F.array_max("_need")}).drop("_need")


def _judged(d: DataFrame) -> DataFrame:
    """The outcome and its reason, from a motion's needs and its place's winds."""
    werr = F.greatest(F.when(F.col("_model") == 1, F.lit(MODEL_ERR)).otherwise(F.lit(0.0)), F.col("_own"))
    d = d.withColumn("shear", F.when(F.col("winds").isNotNull(), wind_change(F.col("gap_m")))).withColumn("tolerance", F.col("spread") + 2 * F.col("velocity_err") + werr + F.col("shear"))
    beyond = F.col("need_min") - F.col("tolerance") >= FLIER_MIN
    open_v = F.col("velocity_err").isNull() | F.isnan("velocity_err") | (2 * F.col("velocity_err") > VELOCITY_FIX)
    why = (
        F.when(F.col("ve").isNull(), "no path").when(open_v & (F.col("winds").isNull() | ~F.coalesce(beyond, F.lit(False))), "velocity not fixed")
        .when(F.col("winds").isNull(), "no wind at its height").when((F.col("shear") > VELOCITY_FIX) & ~beyond, "no wind near its height")
        .when((F.col("need_max") <= F.col("tolerance")) & (F.col("need_max") >= F.col("still_min")), "holding still fits as well")
        .when(F.col("need_max") <= F.col("tolerance"), F.lit(None)).when(beyond, F.lit(None)).otherwise("between")
    )
    d = d.withColumn("why", why)
    out = F.when(F.col("why").isNotNull(), "cannot say").when(F.col("need_max") <= F.col("tolerance"), "pass").otherwise("fail")
    return d.withColumn("outcome", out)


WHYS = ("no path", "velocity not fixed", "no wind at its height", "no wind near its height", "holding still fits as well", "between")  # fixed value: the reasons of ``drift_wind_test``


def wind_test_sensitivity(paths: DataFrame, winds: DataFrame, speeds: Sequence[float], directions: Sequence[float], place: Sequence[str] = ("case_id",)) -> DataFrame:
    """A45. How slow a body the wind test would have caught: bodies planted in each counting wind of a case, flying through it at a grid
    of speeds and directions, and the test asked again.  By airspeed: ``n`` bodies (cases and directions), ``plants`` (bodies in each
    of their winds), the plants' shares by outcome, and by reason where it cannot say (``WHYS``).  Cases without a counting
    wind have no air to plant a body in.  ``place`` as in ``drift_wind_test``.

    A plant's own motion is the air's and the grid's, so the case gives only its error: cases of one place and error are one question with
    a weight, and a place's plants are made once, inside a task, for up to 256 errors at a time."""
    place = list(place)
    grid = F.array(*[F.struct(F.lit(float(s)).alias("s"), F.lit(float(a)).alias("a")) for s in speeds for a in directions])
    e = paths.groupBy(*dict.fromkeys(place), "velocity_err").agg(F.count(F.lit(1)).alias("cases"))
    e = e.withColumn("_part", F.floor((F.row_number().over(W.partitionBy(*place).orderBy("velocity_err")) - 1) / 256))
    e = e.groupBy(*place, "_part").agg(F.collect_list(F.struct("velocity_err", "cases")).alias("_e"))
    d = at_place(e, _winds_of(winds, place), place, "inner").drop(*place, "_part")
    d = d.withColumn("_air", F.explode("_w")).withColumn("_g", F.explode(grid))
    d = d.withColumns({"ve": F.col("_air.u") + F.col("_g.s") * F.sin(F.radians("_g.a")), "vn": F.col("_air.v") + F.col("_g.s") * F.cos(F.radians("_g.a"))})
    d = _needs(d).withColumn("_e", F.explode("_e")).select("*", "_e.velocity_err", "_e.cases")
    t = _judged(d).groupBy(F.col("_g.s").alias("airspeed"), "winds", "outcome", "why").agg(F.sum("cases").alias("plants"))
    part = lambda c: F.sum(F.when(c, F.col("plants")).otherwise(0)) / F.sum("plants")
    said = {"passes": "pass", "fails": "fail", "cannot_say": "cannot say"}
    return t.groupBy("airspeed").agg(
        F.round(F.sum(F.col("plants") / F.col("winds"))).cast("long").alias("n"), F.sum("plants").alias("plants"),
        *[part(F.col("outcome") == o).alias(k) for k, o in said.items()], *[part(F.col("why") == y).alias(y.replace(" ", "_")) for y in WHYS],
    )


def vertical_test(fits: DataFrame, sigma: float = 2.0, rise: float = 1.0) -> DataFrame:
    """A43. Does height hold or climb: pass where the slope is within ``rise`` even at its error, fail where it is beyond
    it by more, else cannot say.  ``fits``: case_id, slope, err."""
    hi = F.abs("slope") + sigma * F.col("err")
    lo = F.abs("slope") - sigma * F.col("err")
    return fits.withColumn("outcome", F.when(F.col("err").isNull(), "cannot say").when(hi <= rise, "pass").when(lo > rise, "fail").otherwise("cannot say"))


def tracer_wreck_tests(pieces: DataFrame, least_flier: float, min_m: float = 10.0, fail_m: float = 20.0) -> DataFrame:
    """A44. Pieces' speed in object lengths over sin(depression): pass if the bound is under the least flier, fail if the
    slowest reading is over it.  Remains' fall: fail first if a - 3 sigma is half the free fall of a ``fail_m`` body or
    more; pass if g cos(d)/(a + 3 sigma) >= ``min_m``; an unknown depression cannot pass.  ``pieces``: case_id, v_l,
    v_err_l (lengths a second), a_l, a_err_l (lengths a second squared), depression_deg."""
    s = F.sin(F.radians("depression_deg"))
    hi, lo = div(F.col("v_l") + 2 * F.col("v_err_l"), s), F.greatest(F.col("v_l") - 2 * F.col("v_err_l"), F.lit(0.0))
    tracer = F.when(lo > least_flier, "fail").when(F.col("depression_deg").isNull(), "cannot say").when(hi < least_flier, "pass").otherwise("cannot say")
    a, e, d = F.col("a_l"), F.col("a_err_l"), F.radians("depression_deg")
    g = 9.80665
    wreck = F.when(a - 3 * e >= 0.5 * g * F.coalesce(F.cos(d), F.lit(1.0)) / fail_m, "fail").when(F.col("depression_deg").isNull(), "cannot say").when(
        div(g * F.cos(d), a + 3 * e) >= min_m, "pass").otherwise("cannot say")
    return pieces.withColumn("tracer", tracer).withColumn("wreck", wreck)


def model_wind_error(soundings: DataFrame, model: DataFrame, bands_m: Sequence[float]) -> DataFrame:
    """A66. Weather-model wind against soundings: the vector error's percentiles by height band and lag.  Both: station,
    t_s (hour), z_m, u, v.  A sounding level meets the model profile of its own hour and the one before; equal heights of one
    station and hour ask once."""
    soundings = share(soundings)
    prof = model.groupBy("station", "t_s").agg(F.array_sort(F.collect_list(F.struct("z_m", "u", "v"))).alias("lv"))
    s = soundings.select("station", "t_s", "z_m").distinct().withColumn("_t", F.col("t_s")).withColumn("lag_h", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("t_s", F.col("t_s") - 3600 * F.col("lag_h"))
    j = s.join(prof, ["station", "t_s"])
    below, above = F.filter("lv", lambda l: l["z_m"] <= F.col("z_m")), F.filter("lv", lambda l: l["z_m"] >= F.col("z_m"))
    j = j.withColumn("_b", F.when(F.size(below) > 0, F.element_at(below, -1))).withColumn("_a", F.when(F.size(above) > 0, F.element_at(above, 1)))
    j = j.where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    told = j.groupBy("station", F.col("_t").alias("t_s"), "z_m").agg(F.collect_list(F.struct("lag_h", "_a", "_b")).alias("_l"))  # two at most
    j = soundings.join(told, ["station", "t_s", "z_m"]).withColumn("_l", F.explode("_l")).select("station", "z_m", "u", "v", "_l.*")
    sh = F.when(F.col("_a.z_m") == F.col("_b.z_m"), 0.0).otherwise((F.col("z_m") - F.col("_b.z_m")) / (F.col("_a.z_m") - F.col("_b.z_m")))
    mix = lambda c: F.col(f"_b.{c}") + sh * (F.col(f"_a.{c}") - F.col(f"_b.{c}"))
    err = j.select("station", "lag_h", band_of(F.col("z_m"), bands_m).alias("band"), F.hypot(F.col("u") - mix("u"), F.col("v") - mix("v")).alias("err"))
    err = share(err)
    q = exact_quantiles(err, ["lag_h", "band"], "err", {"p50": 0.5, "p68": 0.68, "p90": 0.9, "p95": 0.95})
    return err.groupBy("lag_h", "band").agg(F.count(F.lit(1)).alias("levels")).join(q, ["lag_h", "band"])


def band_of(z: Column, edges: Sequence[float]) -> Column:
    """The index of the band of ``edges`` that ``z`` lies in (0 under the first)."""
    return sum((z >= e).cast("int") for e in edges)


def wind_shear_table(levels: DataFrame, keep: int, dz_edges: Sequence[float], seed: int = 0) -> DataFrame:
    """A67. The vector difference of pairs of levels of one sounding, one pair in ``keep`` by hashed draw (the sampling
    is the study's own), percentiles by height difference.  A sounding has at most some hundred levels: pairs are made
    within a sounding only, and thinned before they are compared."""
    a = levels.select("sounding", F.col("level").alias("l1"), F.col("z_m").alias("z1"), F.col("u").alias("u1"), F.col("v").alias("v1"))
    b = levels.select("sounding", F.col("level").alias("l2"), F.col("z_m").alias("z2"), F.col("u").alias("u2"), F.col("v").alias("v2"))
    pick = dr.uniform(seed, F.col("sounding"), F.col("l1"), F.col("l2")) < 1.0 / keep
    j = a.join(b, "sounding").where((F.col("z1") < F.col("z2")) & pick)
    d = share(j.select(band_of(F.col("z2") - F.col("z1"), dz_edges).alias("band"), (F.col("z2") - F.col("z1")).alias("dz"), F.hypot(F.col("u1") - F.col("u2"), F.col("v1") - F.col("v2")).alias("diff")))
    q = exact_quantiles(d, ["band"], "diff", {"p50": 0.5, "p90": 0.9})
    m = exact_quantiles(d, ["band"], "dz", {"dz_median": 0.5})
    return d.groupBy("band").agg(F.count(F.lit(1)).alias("pairs")).join(q, "band").join(m, "band")


def shear_power(table: DataFrame, p: str = "p90") -> DataFrame:
    """A67. The power law through a percentile by height difference: ln p on ln dz (the table's own few rows)."""
    d = table.where((F.col(p) > 0) & (F.col("dz_median") > 0))
    return d.agg(F.regr_slope(F.log(p), F.log("dz_median")).alias("power"), F.exp(F.regr_intercept(F.log(p), F.log(F.col("dz_median") / 1000))).alias("at_km"), F.count(F.lit(1)).alias("bins"))
