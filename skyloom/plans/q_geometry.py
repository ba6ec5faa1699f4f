"""Queries over geometry, units and winds."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions.draws import uniform_sql
from skyloom.functions.lineage import share
from skyloom.operators import geometry as ge
from skyloom.operators import winds as wi
from skyloom.plans.corpus import TRACK_SQL
from skyloom.plans.q_windows import rnd
from skyloom.plans.registry import query


@query(
    "angular_rate",
    """WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS v, 500+l_suppkey%400 AS k, l_discount*100 AS al, l_returnflag IN ('A','R') AS known FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN known THEN round(v/(k/pow(cos(radians(al)),2)),9) END AS omega_rad_s, CASE WHEN known THEN round(degrees(2*atan(1920/2.0/k)),6) END AS fov_deg, CASE WHEN known THEN round(degrees(1920.0/k),6) END AS fov_small_deg FROM d""",
)
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("v_px"), (500 + F.col("l_suppkey") % 400).alias("k"), (F.col("l_discount") * 100).alias("alpha_deg"),
                          F.lit(1920).alias("width_px"), F.when(F.col("l_returnflag") == "A", "graticule").when(F.col("l_returnflag") == "R", "fov").otherwise("unknown").alias("provenance"))
    d = ge.angular_rate(d)
    return rnd(rnd(d, "omega_rad_s", n=9), "fov_deg", "fov_small_deg").select("l_orderkey", "l_linenumber", "l_partkey", "omega_rad_s", "fov_deg", "fov_small_deg")


@query("fan_ladder", "SELECT event_id, r AS range_m, a AS theta_deg, round(value/1000*r/sin(radians(a)),6) AS speed_m_s FROM events, (SELECT unnest([3000.0,5000.0,10000.0]::DOUBLE[]) AS r), (SELECT unnest([30.0,60.0,90.0]::DOUBLE[]) AS a)")
def _(t):
    d = t.events.select("event_id", (F.col("value") / 1000).alias("omega_rad_s"))
    return rnd(ge.fan(d, [3000, 5000, 10000], [30, 60, 90]).drop("omega_rad_s"), "speed_m_s")


@query("fov_ladder", "SELECT event_id, f AS fov_deg, r AS range_m, round(value/(960/tan(radians(f)/2))*r,6) AS speed_m_s FROM events, (SELECT unnest([0.7,3,10,30,54]::DOUBLE[]) AS f), (SELECT unnest([3000.0,5000.0,10000.0]::DOUBLE[]) AS r)")
def _(t):
    d = t.events.select("event_id", F.col("value").alias("v_px"), F.lit(1920.0).alias("width_px"))
    return rnd(ge.fov_ladder(d).select("event_id", "fov_deg", "range_m", "speed_m_s"), "speed_m_s")


@query("scale_free_speed", "SELECT event_id, round(value/nullif(user_id%9,0),9) AS lengths_per_s, round(value/nullif(user_id%7,0)*12,9) AS bar_m_s FROM events")
def _(t):
    d = t.events.select("event_id", F.col("value").alias("v_px"), (F.col("user_id") % 9).cast("double").alias("size_px"), (F.col("user_id") % 7).cast("double").alias("ref_px"), F.lit(12.0).alias("ref_len_m"), F.lit(1.0).alias("range_ratio"))
    return rnd(ge.scale_free_speed(d).select("event_id", "lengths_per_s", "bar_m_s"), "lengths_per_s", "bar_m_s", n=9)


ENV = "env AS (SELECT p_type AS class, 0.1+p_size/10.0 AS length_m, p_size/2.0 AS lo_m_s, p_retailprice/20 AS hi_m_s, 1+p_size/10.0 AS load FROM part)"


def env(t):
    return t.part.select(F.col("p_type").alias("class"), (0.1 + F.col("p_size") / 10.0).alias("length_m"), (F.col("p_size") / 2.0).alias("speed_min_m_s"), (F.col("p_retailprice") / 20).alias("speed_max_m_s"), (1 + F.col("p_size") / 10.0).alias("load_limit_g"))


@query("class_envelope_agg", f"WITH {ENV} SELECT class, round(min(lo_m_s/length_m),9) AS lo, round(max(hi_m_s/length_m),9) AS hi, round(max(hi_m_s),9) AS top_m_s, max(load) AS load_limit_g, min(length_m) AS length_min_m, max(length_m) AS length_max_m FROM env GROUP BY ALL")
def _(t):
    return rnd(ge.class_envelope(env(t)), "lo", "hi", "top_m_s", n=9)


@query("load_factor_curve", f"WITH {ENV}, c AS (SELECT class, max(load) AS n FROM env GROUP BY ALL) SELECT event_id, class, round(9.80665*sqrt(n*n-1)/(value/100),6) AS speed_m_s FROM events, c WHERE value > 0")
def _(t):
    d = t.events.where("value > 0").select("event_id", (F.col("value") / 100).alias("omega_rad_s"))
    return rnd(ge.load_factor_curve(d, ge.class_envelope(env(t))).select("event_id", "class", "speed_m_s"), "speed_m_s")


@query(
    "against_classes",
    f"""WITH {ENV}, c AS (SELECT class, min(lo_m_s/length_m) AS lo, max(hi_m_s/length_m) AS hi FROM env GROUP BY ALL), b AS (SELECT event_id, value*10 AS per_s FROM events),
w AS (SELECT event_id, class, per_s, lo, hi, (SELECT min(per_s*length_m-hi_m_s) FROM env e WHERE e.class=c.class) AS w FROM b, c)
SELECT event_id, class, CASE WHEN per_s <= hi THEN CASE WHEN per_s >= lo THEN 'within' ELSE 'slower, allowed' END WHEN greatest(w,0) <= 113 THEN 'with a wind' ELSE 'outside' END AS answer, CASE WHEN per_s > hi THEN round(greatest(w,0),6) END AS wind_m_s FROM w""",
)
def _(t):
    b = t.events.select("event_id", (F.col("value") * 10).alias("per_s"))
    return rnd(ge.against_classes(b, env(t)).drop("per_s"), "wind_m_s")


@query(
    "parallax_ladder",
    """WITH d AS (SELECT o_orderkey, o_totalprice/2000 AS vg, 60+o_custkey%90 AS va, o_orderkey%360 AS hd, (o_custkey*7)%360 AS gb, vo FROM orders, (SELECT unnest([0.0,10.0,50.0]::DOUBLE[]) AS vo)),
q AS (SELECT *, vg*sin(radians(gb))-va*sin(radians(hd)) AS dx, vg*cos(radians(gb))-va*cos(radians(hd)) AS dy, va*sin(radians(hd)) AS ax, va*cos(radians(hd)) AS ay FROM d),
r AS (SELECT *, va*va-vo*vo AS a, 2*(ax*dx+ay*dy) AS b, dx*dx+dy*dy AS c FROM q),
s AS (SELECT *, CASE WHEN b*b-4*a*c >= 0 THEN sqrt(b*b-4*a*c) END AS s FROM r),
k AS (SELECT *, CASE WHEN (-b-s)/(2*a) >= 1-1e-12 THEN 1 ELSE 0 END + CASE WHEN (-b+s)/(2*a) >= 1-1e-12 THEN 1 ELSE 0 END AS roots FROM s)
SELECT o_orderkey, vo AS v_obj, roots, round(CASE WHEN NOT (va > vo AND (vg+va)/(va-vo) < greatest(1,(vg+va)/(va+vo))) THEN greatest(1,(vg+va)/(va+vo)) END,6) AS k_min, round(CASE WHEN (vg+va)/(va-vo) >= greatest(1,(vg+va)/(va+vo)) THEN (vg+va)/(va-vo) END,6) AS k_max FROM k""",
)
def _(t):
    d = t.orders.select("o_orderkey", (F.col("o_totalprice") / 2000).alias("v_ground"), (60 + F.col("o_custkey") % 90).cast("double").alias("v_own"), (F.col("o_orderkey") % 360).cast("double").alias("own_heading"), (F.col("o_custkey") * 7 % 360).cast("double").alias("ground_bearing"))
    d = ge.parallax_ladder(d, [0, 10, 50]).select("o_orderkey", "v_obj", F.size("k").alias("roots"), "k_min", "k_max")
    return rnd(d, "k_min", "k_max")


def _reach(a: str, h: str, k: float) -> str:
    rp = f"(6371000.0/(1-{k}))"
    down = f"({rp}+{h})*sin(acos({rp}/({rp}+{h}))+{a})"
    left = f"(pow({down},2)-(2*{rp}*{h}+{h}*{h}))"
    return f"CASE WHEN {a} > 1e-12 AND {left} >= 0 THEN round({down}-sqrt({left}),2) ELSE 'inf'::DOUBLE END"


def _clears(a: str, h: str, k: float) -> str:
    rp = f"(6371000.0/(1-{k}))"
    up = f"(-acos({rp}/({rp}+{h}))-{a})"
    return f"CASE WHEN {a} >= -1e-12 THEN '-inf'::DOUBLE WHEN {up} >= 0 THEN round({h},2) ELSE round(({rp}+{h})*cos({up})-{rp},2) END"


@query(
    "horizon_bounds",
    f"""WITH d AS (SELECT o_orderkey, o_custkey%200/100.0-0.5 AS delta_deg, o_totalprice/100 AS h FROM orders),
e AS (SELECT *, radians(delta_deg) AS told, radians(delta_deg-0.02-abs(delta_deg-0.02)*0.05) AS flat, radians(delta_deg+0.02+abs(delta_deg+0.02)*0.05) AS steep, greatest(h-10,0) AS lo, greatest(h,0) AS mid, h+10 AS hi FROM d)
SELECT o_orderkey, round(delta_deg,9) AS delta_deg, 0.02 AS delta_err_deg, h AS h_m, 10.0 AS h_err_m, 0.05 AS k_share, delta_deg > 0 AS below, CASE WHEN delta_deg > 0 THEN {_reach("flat", "hi", 0.25)} END AS range_max_m, CASE WHEN delta_deg > 0 THEN {_reach("told", "mid", 0.13)} END AS range_nominal_m,
  CASE WHEN delta_deg <= 0 THEN {_clears("steep", "lo", 0.0)} END AS height_min_m, CASE WHEN delta_deg <= 0 THEN {_clears("told", "mid", 0.13)} END AS height_nominal_m, 'pass' AS outcome FROM e""",
)
def _(t):
    d = t.orders.select("o_orderkey", (F.col("o_custkey") % 200 / 100.0 - 0.5).alias("delta_deg"), F.lit(0.02).alias("delta_err_deg"), (F.col("o_totalprice") / 100).alias("h_m"), F.lit(10.0).alias("h_err_m"), F.lit(0.05).alias("k_share"))
    return rnd(rnd(ge.horizon_bounds(d), "range_max_m", "range_nominal_m", "height_min_m", "height_nominal_m", n=2), "delta_deg", n=9)


@query(
    "horizon_nominal",
    """WITH d AS (SELECT o_orderkey, radians(0.1+o_custkey%200/100.0) AS a, o_totalprice/100 AS h, 6371000.0/(1-0.13) AS rp FROM orders), e AS (SELECT *, acos(rp/(rp+h))+a AS dep, rp+h AS big FROM d)
SELECT o_orderkey, round(CASE WHEN pow(big*sin(dep),2)-(2*rp*h+h*h) >= 0 THEN big*sin(dep)-sqrt(pow(big*sin(dep),2)-(2*rp*h+h*h)) END,1) AS range_nominal_m FROM e""",
)
def _(t):
    d = t.orders.select("o_orderkey", (0.1 + F.col("o_custkey") % 200 / 100.0).alias("delta_deg"), F.lit(0.0).alias("delta_err_deg"), (F.col("o_totalprice") / 100).alias("h_m"), F.lit(0.0).alias("h_err_m"), F.lit(0.0).alias("k_share"))
    return rnd(ge.horizon_bounds(d).select("o_orderkey", "range_nominal_m"), "range_nominal_m", n=1)


@query("haze_and_focus", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0 THEN round(-ln(l_discount)*l_quantity*1000/3.912,4) END AS haze_max_m, CASE WHEN l_tax > 0 THEN round(0.1/(l_tax/1000),6) END AS focus_min_m FROM lineitem")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("contrast"), (F.col("l_quantity") * 1000).alias("visibility_m"), F.lit(0.1).alias("pupil_m"), (F.col("l_tax") / 1000).alias("disc_rad"))
    return rnd(rnd(ge.focus_floor(ge.haze_range(d)).select("l_orderkey", "l_linenumber", "l_partkey", "haze_max_m", "focus_min_m"), "haze_max_m", n=4), "focus_min_m")


def places(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (30 + F.col("l_quantity") / 100).alias("lat"), (-80 + F.col("l_discount")).alias("lon"), F.lit(0.0).alias("alt"), F.lit(30.2).alias("lat0"), F.lit(-79.9).alias("lon0"), (F.col("l_extendedprice") / 10).alias("alt0"))


ECEF = "({n}+{h})*cos(radians({la}))*cos(radians({lo}))", "({n}+{h})*cos(radians({la}))*sin(radians({lo}))", "({n}*(1-e2)+{h})*sin(radians({la}))"


def _ecef(i, la, lo, h):
    n = f"(6378137.0/sqrt(1-e2*pow(sin(radians({la})),2)))"
    return ECEF[i].format(n=n, la=la, lo=lo, h=h)


@query(
    "enu_rays",
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, 30+l_quantity/100 AS lat, -80+l_discount AS lon, 0.0::DOUBLE AS alt, 30.2::DOUBLE AS lat0, -79.9::DOUBLE AS lon0, l_extendedprice/10 AS alt0, (1/298.257223563::DOUBLE)*(2-1/298.257223563::DOUBLE) AS e2 FROM lineitem),
x AS (SELECT *, {_ecef(0,'lat','lon','alt')}-{_ecef(0,'lat0','lon0','alt0')} AS x, {_ecef(1,'lat','lon','alt')}-{_ecef(1,'lat0','lon0','alt0')} AS y, {_ecef(2,'lat','lon','alt')}-{_ecef(2,'lat0','lon0','alt0')} AS z FROM p),
e AS (SELECT *, -sin(radians(lon0))*x+cos(radians(lon0))*y AS e, -sin(radians(lat0))*cos(radians(lon0))*x-sin(radians(lat0))*sin(radians(lon0))*y+cos(radians(lat0))*z AS n, cos(radians(lat0))*cos(radians(lon0))*x+cos(radians(lat0))*sin(radians(lon0))*y+sin(radians(lat0))*z AS u FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, round(e,3) AS east_m, round(n,3) AS north_m, round(u,3) AS up_m, round((degrees(atan2(e,n))+360)%360,5) AS az_deg, round(degrees(atan2(-u,sqrt(e*e+n*n))),5) AS dep_deg FROM e""",
)
def _(t):
    d = ge.enu(places(t), "lat", "lon", "alt", "lat0", "lon0", "alt0").withColumn("off_right_deg", F.lit(0.0)).withColumn("off_down_deg", F.lit(0.0))
    d = ge.rays(d).select("l_orderkey", "l_linenumber", "l_partkey", "east_m", "north_m", "up_m", "az_deg", "dep_deg")
    return rnd(rnd(d, "east_m", "north_m", "up_m", n=3), "az_deg", "dep_deg", n=5)


def _newton(n):
    r = "rd"
    out = []
    for i in range(n):
        out.append(f"n{i + 1} AS (SELECT *, greatest({r} - ({r}*(1-0.1*{r}*{r})-rd)/(1-0.3*{r}*{r}),0) AS r{i + 1} FROM n{i})")
        r = f"r{i + 1}"
    return ", ".join(out)


@query(
    "undistort_track",
    f"""WITH {TRACK_SQL}, n0 AS (SELECT *, sqrt(pow(x-50,2)+pow(y-50,2))/400 AS rd FROM track), {_newton(8)},
u AS (SELECT *, 50+(x-50)*CASE WHEN rd>0 THEN r8/rd ELSE 1 END AS xt, 50+(y-50)*CASE WHEN rd>0 THEN r8/rd ELSE 1 END AS yt FROM n8),
p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(xt) OVER w AS pxt, lag(yt) OVER w AS pyt FROM u WINDOW w AS (PARTITION BY object_id ORDER BY frame))
SELECT video_id, object_id, round(sum(sqrt(pow(x-px,2)+pow(y-py,2))),4) AS drawn_px, round(sum(sqrt(pow(xt-pxt,2)+pow(yt-pyt,2))),4) AS true_px, round(sum(sqrt(pow(xt-pxt,2)+pow(yt-pyt,2)))/sum(sqrt(pow(x-px,2)+pow(y-py,2))),6) AS growth FROM p WHERE px IS NOT NULL GROUP BY ALL""",
)
def _(t):
    d = ge.path_growth(ge.undistort(t.track, -0.1, 0.0, 400.0, 50.0, 50.0), ["video_id", "object_id"])
    return rnd(rnd(d, "drawn_px", "true_px", n=4), "growth")


@query(
    "to_one_scale",
    f"""WITH {TRACK_SQL}, s AS (SELECT video_id, frame, 1.5::DOUBLE AS ratio FROM track WHERE object_id%10=0 AND frame%97=0),
c AS (SELECT t.video_id, t.object_id, t.frame, t.x, t.y, coalesce((SELECT sum(ln(ratio)) FROM s WHERE s.video_id=t.video_id AND s.frame <= t.frame),0) AS z FROM track t)
SELECT video_id, object_id, frame, round(50+(x-50)/exp(z),6) AS x, round(50+(y-50)/exp(z),6) AS y FROM c""",
)
def _(t):
    s = t.track.where("object_id % 10 = 0 AND frame % 97 = 0").select("video_id", "frame", F.lit(1.5).alias("ratio"))
    return rnd(ge.to_one_scale(t.track, s, 50.0, 50.0), "x", "y")


@query("screen_bearing", "SELECT event_id, round(((value-user_id%360)%360+360)%360,6) AS bearing_deg, CASE WHEN abs(user_id%5-2) <= 1 THEN 'none' WHEN user_id%5-2 > 0 THEN 'left' ELSE 'right' END AS sense FROM events")
def _(t):
    d = t.events.select("event_id", F.col("value").alias("screen_dir_deg"), (F.col("user_id") % 360).cast("double").alias("theta_north_deg"), (F.col("user_id") % 5 - 2).alias("dtheta_dt"), F.lit(1).alias("resolvable"))
    return rnd(ge.screen_bearing(d).select("event_id", "bearing_deg", "sense"), "bearing_deg")


@query(
    "normalise_units",
    """SELECT o_orderkey, round(CASE o_orderkey%5 WHEN 0 THEN o_custkey*0.514444 WHEN 1 THEN o_custkey*0.44704 WHEN 2 THEN o_custkey*0.3048 WHEN 3 THEN NULL ELSE o_custkey*0.514444/sqrt(pow(1-0.0065*2133.6/288.15, 9.80665/(287.053*0.0065))*288.15/(288.15-0.0065*2133.6)) END,5) AS si, o_orderkey%5 <> 3 AS readable FROM orders""",
)
def _(t):
    unit = F.element_at(F.array(F.lit(" kt"), F.lit("mph"), F.lit(" ft"), F.lit(" furlongs"), F.lit("kias@7000ft")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    d = t.orders.select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), unit).alias("text"))
    return rnd(ge.normalise_units(d, "text").select("o_orderkey", "si", "readable"), "si", n=5)


# ---- winds: a source a supplier, an hour a day, levels by part; paths are orders ------------------------------------
WIND = """w AS (SELECT 's'||(l_suppkey%10) AS source, CASE WHEN l_suppkey%10 < 7 THEN 'model' ELSE 'observed' END AS kind, CAST(CAST(l_shipdate AS DATE)-DATE '1995-01-01' AS BIGINT)*3600 AS t_s, CAST(l_partkey%40*100 AS DOUBLE) AS z_m,
   round(avg(-l_quantity/5*sin(radians(l_linenumber*20))),9) AS u, round(avg(-l_quantity/5*cos(radians(l_linenumber*20))),9) AS v FROM lineitem GROUP BY ALL),
p AS (SELECT o_orderkey AS case_id, CAST(CAST(o_orderdate AS DATE)-DATE '1995-01-01' AS BIGINT)*3600 AS t_s, CAST(o_custkey%50*100+50 AS DOUBLE) AS height_m, o_totalprice/40000*sin(radians(o_orderkey%360)) AS ve, o_totalprice/40000*cos(radians(o_orderkey%360)) AS vn, o_custkey%30/10.0 AS velocity_err FROM orders),
j AS (SELECT p.case_id, source, kind, w.t_s AS t_wind, height_m, max(z_m) FILTER (z_m <= height_m) AS zb, min(z_m) FILTER (z_m >= height_m) AS za, arg_max(u,z_m) FILTER (z_m <= height_m) AS ub, arg_min(u,z_m) FILTER (z_m >= height_m) AS ua, arg_max(v,z_m) FILTER (z_m <= height_m) AS vb, arg_min(v,z_m) FILTER (z_m >= height_m) AS va FROM p JOIN w ON abs(w.t_s-p.t_s) <= 3600 GROUP BY ALL),
q AS (SELECT *, CASE WHEN kind='observed' THEN ln(greatest(height_m-10,1)) ELSE height_m END AS ph, CASE WHEN kind='observed' THEN ln(greatest(zb-10,1)) ELSE zb END AS pb, CASE WHEN kind='observed' THEN ln(greatest(za-10,1)) ELSE za END AS pa, CASE WHEN kind='observed' THEN 10 ELSE 0 END AS g FROM j),
wh AS (SELECT case_id, source, kind, t_wind, CASE WHEN za IS NOT NULL AND zb IS NOT NULL THEN ub+CASE WHEN za=zb THEN 0 ELSE (ph-pb)/(pa-pb) END*(ua-ub) ELSE coalesce(ub,ua) END AS u, CASE WHEN za IS NOT NULL AND zb IS NOT NULL THEN vb+CASE WHEN za=zb THEN 0 ELSE (ph-pb)/(pa-pb) END*(va-vb) ELSE coalesce(vb,va) END AS v,
  CASE WHEN za IS NOT NULL AND zb IS NOT NULL THEN 0.0 ELSE abs(coalesce(zb,za)-height_m) END AS gap_m, (za IS NOT NULL AND zb IS NOT NULL) OR greatest(greatest(coalesce(zb,za)-g,1),greatest(height_m-g,1))/least(greatest(coalesce(zb,za)-g,1),greatest(height_m-g,1)) <= 4 AS counts FROM q)"""


def wind_levels(t):
    d = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("long") * 3600
    s = F.col("l_suppkey") % 10
    a = F.radians(F.col("l_linenumber") * 20)
    w = t.lineitem.select(F.concat(F.lit("s"), s.cast("string")).alias("source"), F.when(s < 7, "model").otherwise("observed").alias("kind"), d.alias("t_s"), (F.col("l_partkey") % 40 * 100).cast("double").alias("z_m"),
                          (-F.col("l_quantity") / 5 * F.sin(a)).alias("u"), (-F.col("l_quantity") / 5 * F.cos(a)).alias("v"))
    w = w.groupBy("source", "kind", "t_s", "z_m").agg(F.round(F.avg("u"), 9).alias("u"), F.round(F.avg("v"), 9).alias("v"))
    return w.withColumn("ground_m", F.lit(0.0))


def wind_paths(t):
    d = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long") * 3600
    a = F.radians(F.col("o_orderkey") % 360)
    return t.orders.select(F.col("o_orderkey").alias("case_id"), d.alias("t_s"), (F.col("o_custkey") % 50 * 100 + 50).cast("double").alias("height_m"), F.lit(10.0).alias("ground_m"),
                           (F.col("o_totalprice") / 40000 * F.sin(a)).alias("ve"), (F.col("o_totalprice") / 40000 * F.cos(a)).alias("vn"), (F.col("o_custkey") % 30 / 10.0).alias("velocity_err"))


def wind_rows(t):
    return wi.wind_at_height(wind_paths(t).select("case_id", "t_s", "height_m", "ground_m"), wind_levels(t))


def place_winds(t):
    return share(wi.winds_at(wind_paths(t), wind_levels(t)).withColumn("err_m_s", F.lit(None).cast("double")))


@query("wind_at_height", f"WITH {WIND} SELECT case_id, source, kind, t_wind, round(u,6) AS u, round(v,6) AS v, gap_m, counts FROM wh")
def _(t):
    return rnd(wind_rows(t), "u", "v")


@query(
    "drift_wind_test",
    f"""WITH {WIND}, c AS (SELECT wh.*, sqrt(pow(ve-u,2)+pow(vn-v,2)) AS need, velocity_err FROM wh JOIN p USING (case_id) WHERE counts),
sp AS (SELECT a.case_id, max(sqrt(pow(a.u-b.u,2)+pow(a.v-b.v,2))) AS s FROM c a JOIN c b USING (case_id) GROUP BY ALL),
g AS (SELECT case_id, count(*) AS winds, min(need) AS nmin, max(need) AS nmax, min(gap_m) AS gap, min(sqrt(u*u+v*v)) AS still, max(CASE WHEN kind='model' THEN 2.0 ELSE 0 END) AS merr FROM c GROUP BY ALL),
f AS (SELECT p.case_id, velocity_err AS ev, winds, nmin, nmax, still, greatest(0.25,s) AS spread, CASE WHEN gap=0 THEN 0.0 ELSE 10.3*pow(gap/1000,0.57) END AS shear, greatest(0.25,s)+2*velocity_err+merr+CASE WHEN gap=0 THEN 0.0 ELSE 10.3*pow(gap/1000,0.57) END AS tol FROM p LEFT JOIN g USING (case_id) LEFT JOIN sp USING (case_id)),
y AS (SELECT *, CASE WHEN 2*ev > 5 AND (winds IS NULL OR nmin-tol < 10) THEN 'velocity not fixed' WHEN winds IS NULL THEN 'no wind at its height' WHEN shear > 5 AND nmin-tol < 10 THEN 'no wind near its height' WHEN nmax <= tol AND nmax >= still THEN 'holding still fits as well' WHEN nmax <= tol OR nmin-tol >= 10 THEN NULL ELSE 'between' END AS why FROM f)
SELECT case_id, winds, round(nmin,5) AS need_min, round(nmax,5) AS need_max, round(CASE WHEN winds IS NOT NULL THEN spread END,5) AS spread, CASE WHEN winds IS NOT NULL THEN round(shear,5) END AS shear, round(tol,5) AS tolerance, CASE WHEN why IS NOT NULL THEN 'cannot say' WHEN nmax <= tol THEN 'pass' ELSE 'fail' END AS outcome, why FROM y""",
)
def _(t):
    d = wi.drift_wind_test(wind_paths(t), place_winds(t), wi.PLACE)
    return rnd(d, "need_min", "need_max", "spread", "shear", "tolerance", n=5)


@query("wind_test_sensitivity")
def _(t):
    return rnd(wi.wind_test_sensitivity(wind_paths(t), place_winds(t), [0, 5, 20], [0, 120, 240], wi.PLACE), "passes", "fails", "cannot_say", *[y.replace(" ", "_") for y in wi.WHYS])


@query(
    "vertical_test",
    """WITH f AS (SELECT l_suppkey AS case_id, regr_slope(l_quantity, epoch(l_shipdate)/86400) AS slope, sqrt((regr_syy(l_quantity, epoch(l_shipdate)/86400)-regr_slope(l_quantity, epoch(l_shipdate)/86400)*regr_sxy(l_quantity, epoch(l_shipdate)/86400))/(count(*)-2)/regr_sxx(l_quantity, epoch(l_shipdate)/86400)) AS err FROM lineitem GROUP BY ALL)
SELECT case_id, round(slope,9) AS slope, round(err,9) AS err, CASE WHEN abs(slope)+2*err <= 0.0015 THEN 'pass' WHEN abs(slope)-2*err > 0.0015 THEN 'fail' ELSE 'cannot say' END AS outcome FROM f""",
)
def _(t):
    d = t.lineitem.select(F.col("l_suppkey").alias("case_id"), "l_quantity", (F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 86400).alias("t"))
    err = F.sqrt((F.regr_syy("l_quantity", "t") - F.regr_slope("l_quantity", "t") * F.regr_sxy("l_quantity", "t")) / (F.count(F.lit(1)) - 2) / F.regr_sxx("l_quantity", "t"))
    f = d.groupBy("case_id").agg(F.regr_slope("l_quantity", "t").alias("slope"), err.alias("err"))
    return rnd(wi.vertical_test(f, rise=0.0015), "slope", "err", n=9)


@query(
    "tracer_wreck_tests",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity/50 AS v, l_discount AS ve, l_quantity/20 AS a, l_tax AS ae, CASE WHEN l_returnflag='N' THEN NULL ELSE 10+l_suppkey%60 END AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN greatest(v-2*ve,0) > 0.7 THEN 'fail' WHEN d IS NULL THEN 'cannot say' WHEN (v+2*ve)/sin(radians(d)) < 0.7 THEN 'pass' ELSE 'cannot say' END AS tracer,
  CASE WHEN a-3*ae >= 0.5*9.80665*coalesce(cos(radians(d)),1)/20 THEN 'fail' WHEN d IS NULL THEN 'cannot say' WHEN 9.80665*cos(radians(d))/(a+3*ae) >= 10 THEN 'pass' ELSE 'cannot say' END AS wreck FROM p""",
)
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 50).alias("v_l"), F.col("l_discount").alias("v_err_l"), (F.col("l_quantity") / 20).alias("a_l"), F.col("l_tax").alias("a_err_l"), F.when(F.col("l_returnflag") != "N", 10 + F.col("l_suppkey") % 60).alias("depression_deg"))
    return wi.tracer_wreck_tests(d, 0.7).select("l_orderkey", "l_linenumber", "l_partkey", "tracer", "wreck")


LV = "lv AS (SELECT l_orderkey AS sounding, l_linenumber*1000+l_partkey%1000 AS level, l_quantity*200 + l_partkey%97 AS z_m, l_extendedprice/10000 AS u, l_discount*100 AS v FROM lineitem), ld AS (SELECT sounding, level, min(z_m) AS z_m, min(u) AS u, min(v) AS v FROM lv GROUP BY ALL)"


def levels(t):
    d = t.lineitem.select(F.col("l_orderkey").alias("sounding"), (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000).alias("level"), (F.col("l_quantity") * 200 + F.col("l_partkey") % 97).alias("z_m"), (F.col("l_extendedprice") / 10000).alias("u"), (F.col("l_discount") * 100).alias("v"))
    return d.groupBy("sounding", "level").agg(F.min("z_m").alias("z_m"), F.min("u").alias("u"), F.min("v").alias("v"))


SHEAR = f"""{LV}, pr AS (SELECT CASE WHEN b.z_m-a.z_m >= 4000 THEN 3 WHEN b.z_m-a.z_m >= 2000 THEN 2 WHEN b.z_m-a.z_m >= 1000 THEN 1 ELSE 0 END AS band, b.z_m-a.z_m AS dz, sqrt(pow(a.u-b.u,2)+pow(a.v-b.v,2)) AS diff
  FROM ld a JOIN ld b USING (sounding) WHERE a.z_m < b.z_m AND {uniform_sql(0, "a.sounding", "a.level", "b.level")} < 1.0/2), sh AS (SELECT band, count(*) AS pairs, quantile_cont(diff,0.5) AS p50, quantile_cont(diff,0.9) AS p90, median(dz) AS dz_median FROM pr GROUP BY ALL)"""


@query("wind_shear_table", f"WITH {SHEAR} SELECT band, pairs, round(p50,6) AS p50, round(p90,6) AS p90, dz_median FROM sh")
def _(t):
    return rnd(wi.wind_shear_table(levels(t), 2, [1000, 2000, 4000]), "p50", "p90")


@query("shear_power", f"WITH {SHEAR} SELECT round(regr_slope(ln(p90),ln(dz_median)),7) AS power, round(exp(regr_intercept(ln(p90),ln(dz_median/1000))),6) AS at_km, count(*) AS bins FROM sh")
def _(t):
    return rnd(rnd(wi.shear_power(wi.wind_shear_table(levels(t), 2, [1000, 2000, 4000])), "power", n=7), "at_km")


@query(
    "model_wind_error",
    """WITH s AS (SELECT l_suppkey%20 AS station, CAST(CAST(l_shipdate AS DATE)-DATE '1995-01-01' AS BIGINT)*3600 AS t, l_quantity*100 AS z, l_discount*50 AS u, l_tax*50 AS v, l_linenumber FROM lineitem),
m AS (SELECT station, t, z, min(u) AS u, min(v) AS v FROM s WHERE l_linenumber%2=0 GROUP BY ALL), o AS (SELECT station, t, z, u, v, row_number() OVER () AS id FROM s WHERE l_linenumber%2=1),
j AS (SELECT o.id, lag, o.z, o.u, o.v, max(m.z) FILTER (m.z <= o.z) AS zb, min(m.z) FILTER (m.z >= o.z) AS za, arg_max(m.u,m.z) FILTER (m.z <= o.z) AS ub, arg_min(m.u,m.z) FILTER (m.z >= o.z) AS ua, arg_max(m.v,m.z) FILTER (m.z <= o.z) AS vb, arg_min(m.v,m.z) FILTER (m.z >= o.z) AS va FROM o, range(0,2) r(lag), m WHERE m.station=o.station AND m.t=o.t-3600*lag GROUP BY ALL),
e AS (SELECT lag AS lag_h, CASE WHEN z >= 3000 THEN 2 WHEN z >= 1000 THEN 1 ELSE 0 END AS band, sqrt(pow(u-(ub+CASE WHEN za=zb THEN 0 ELSE (z-zb)/(za-zb) END*(ua-ub)),2)+pow(v-(vb+CASE WHEN za=zb THEN 0 ELSE (z-zb)/(za-zb) END*(va-vb)),2)) AS err FROM j WHERE za IS NOT NULL AND zb IS NOT NULL)
SELECT lag_h, band, count(*) AS levels, round(quantile_cont(err,0.5),6) AS p50, round(quantile_cont(err,0.68),6) AS p68, round(quantile_cont(err,0.9),6) AS p90, round(quantile_cont(err,0.95),6) AS p95 FROM e GROUP BY ALL""",
)
def _(t):
    d = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("long") * 3600
    s = t.lineitem.select((F.col("l_suppkey") % 20).alias("station"), d.alias("t_s"), (F.col("l_quantity") * 100).alias("z_m"), (F.col("l_discount") * 50).alias("u"), (F.col("l_tax") * 50).alias("v"), "l_linenumber")
    m = s.where("l_linenumber % 2 = 0").groupBy("station", "t_s", "z_m").agg(F.min("u").alias("u"), F.min("v").alias("v"))
    return rnd(wi.model_wind_error(s.where("l_linenumber % 2 = 1").drop("l_linenumber"), m, [1000, 3000]), "p50", "p68", "p90", "p95")


@query("ray_intersection")
def _(t):
    e = t.events.select(F.col("user_id").alias("case_id"), (F.unix_timestamp(F.col("ts").cast("timestamp")) % 10000 / 100.0).alias("t_s"), (F.col("value") * 20).alias("e"), (F.col("event_id") % 997).cast("double").alias("n"))
    e = e.withColumn("u", F.lit(3000.0))
    # each user's object flies a straight path; the rays point at it with a hashed error
    px, py, pz = 5000 + 30 * F.col("t_s"), 8000 - 10 * F.col("t_s"), F.lit(1000.0)
    e = e.withColumns({"east_m": px - F.col("e"), "north_m": py - F.col("n"), "up_m": pz - F.col("u"), "off_right_deg": (F.col("e") % 7 - 3) / 300, "off_down_deg": (F.col("n") % 5 - 2) / 300})
    return rnd(ge.ray_intersection(ge.rays(e)), "east_m", "north_m", "up_m", "ve", "vn", "vu", "velocity_err", "rms_deg", n=3)
