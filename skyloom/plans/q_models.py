"""Queries over small models and tests per object."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.functions.chunked import row_index
from skyloom.operators import models as mo
from skyloom.operators import series as se
from skyloom.plans.corpus import FRAMES_SQL, STATS_SQL, TRACK_SQL, frame_stats
from skyloom.plans.q_series import FREQS, FR_SQL, K, SP, curve, curve_idx, spec, spec_sql
from skyloom.plans.q_tracks import TIMED_SQL, timed
from skyloom.plans.q_windows import rnd
from skyloom.plans.registry import query

KEY = ["video_id", "object_id"]


@query(
    "dense_layers",
    """WITH r AS (SELECT l_suppkey AS video_id, CAST(l_linenumber AS DOUBLE) AS x, l_quantity AS y, l_discount AS vx, l_tax AS vy FROM lineitem),
g AS (SELECT video_id, count(*) AS n, covar_pop(x,x) AS xx, covar_pop(y,y) AS yy, covar_pop(x,y) AS xy, covar_pop(x,vx) AS xa, covar_pop(y,vx) AS ya, covar_pop(x,vy) AS xb, covar_pop(y,vy) AS yb FROM r GROUP BY ALL)
SELECT video_id, n, round((xa*yy-ya*xy+yb*xx-xb*xy)/(xx*yy-xy*xy),8) AS divergence, round(((xb*yy-yb*xy)-(ya*xx-xa*xy))/(xx*yy-xy*xy),8) AS curl FROM g""",
)
def _(t):
    r = t.lineitem.select(F.col("l_suppkey").alias("video_id"), F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("y"), F.col("l_discount").alias("vx"), F.col("l_tax").alias("vy"))
    return rnd(mo.dense_layers(r, ["video_id"]).select("video_id", "n", "divergence", "curl"), "divergence", "curl", n=8)


@query("heading_regression")
def _(t):
    d = timed(t).select(*KEY, "frame", F.col("x").alias("z"), "t_s", F.col("y").alias("x"), F.pmod(F.col("y") * F.col("frame"), F.lit(97)).alias("y"), F.radians(F.col("frame") * 7.3).alias("heading"))
    return rnd(mo.heading_regression(d, KEY, [3, 7]), "f", "p", "slide_p", n=5)


@query("aircraft_wind")
def _(t):
    h = (F.col("o_orderkey") * 37 % 360).cast("double")
    d = t.orders.select(F.col("o_custkey").alias("case_id"), h.alias("heading_deg"), (80 * F.sin(F.radians(h)) + 5 + F.col("o_totalprice") / 1e6).alias("ve"), (80 * F.cos(F.radians(h)) - 3 + F.col("o_totalprice") / 2e6).alias("vn"))
    return rnd(mo.aircraft_wind(d, ["case_id"]), "airspeed", "wind_e", "wind_n", "err", n=5)


@query("common_mode")
def _(t):
    d = mo.common_mode(curve(t), ["video_id"])
    return rnd(d.groupBy("video_id", "curve").agg(F.count(F.lit(1)).alias("frames"), F.first("share").alias("share")), "share")


_LINE = "regr_slope(x,t) AS vx, regr_intercept(x,t) AS x0, regr_slope(y,t) AS vy, regr_intercept(y,t) AS y0, regr_sxx(x,t) AS tt"


@query(
    "rate_steps",
    f"""WITH RECURSIVE {TIMED_SQL}, p AS (SELECT video_id, object_id, frame, t_s AS t, x, y, row_number() OVER k AS i, count(*) OVER (PARTITION BY video_id, object_id) AS nn FROM timed WINDOW k AS (PARTITION BY video_id, object_id ORDER BY frame)),
q AS MATERIALIZED (SELECT * FROM p WHERE nn >= 8),
c AS (SELECT a.object_id, a.i - 1 AS i, b.i AS j, count(*) AS n, {{0}} AS cost FROM q a JOIN q b ON a.object_id=b.object_id AND b.i >= a.i + 3 JOIN q m ON m.object_id=a.object_id AND m.i BETWEEN a.i AND b.i GROUP BY ALL),
l AS MATERIALIZED (SELECT object_id, j, list(struct_pack(i := i, c := cost) ORDER BY i) AS ways FROM c GROUP BY ALL),
f AS (SELECT object_id, nn, 0 AS j, [0.0::DOUBLE] AS best, [(-1)::BIGINT] AS prev FROM (SELECT DISTINCT object_id, nn FROM q) UNION ALL
  SELECT object_id, nn, j, list_append(best, coalesce(w.c + 4*ln(2*nn)*144.0, 1e300::DOUBLE)), list_append(prev, coalesce(w.i, -1)) FROM (
    SELECT f.object_id, nn, f.j + 1 AS j, best, prev, list_min(list_transform(ways, lambda s: struct_pack(c := best[s.i + 1] + s.c, i := s.i))) AS w FROM f LEFT JOIN l ON l.object_id=f.object_id AND l.j=f.j + 1 WHERE f.j < nn)),
e AS MATERIALIZED (SELECT object_id, prev, nn FROM f WHERE j = nn),
b AS (SELECT object_id, prev, prev[nn + 1] AS a, nn AS z FROM e UNION ALL SELECT object_id, prev, prev[a + 1], a FROM b WHERE a > 0),
g AS (SELECT q.video_id, object_id, min(frame) AS f0, max(frame) AS f1, min(t) AS t0, max(t) AS t1, avg(t) AS mt, count(*) AS n, {_LINE},
  sqrt((greatest(regr_syy(x,t)-pow(regr_sxy(x,t),2)/regr_sxx(x,t),0) + greatest(regr_syy(y,t)-pow(regr_sxy(y,t),2)/regr_sxx(y,t),0))/(2*(count(*)-2))) AS own FROM q JOIN b USING (object_id) WHERE q.i > b.a AND q.i <= b.z GROUP BY q.video_id, object_id, b.a),
h AS (SELECT *, greatest(12.0, own) AS noise, (lag(t1) OVER w + t0)/2 AS tb, lag(struct_pack(vx, x0, vy, y0, mt, tt, n, noise := greatest(12.0, own))) OVER w AS o FROM g WINDOW w AS (PARTITION BY object_id ORDER BY f0)),
k AS (SELECT *, sqrt(pow(x0+vx*tb-o.x0-o.vx*tb,2)+pow(y0+vy*tb-o.y0-o.vy*tb,2)) AS jump FROM h)
SELECT video_id, object_id, f0, f1, n, round(vx,5) AS vx, round(vy,5) AS vy, round(noise/sqrt(tt),5) AS err, round(jump,5) AS jump,
  round(jump/sqrt(2*(noise*noise*(1.0/n+pow(tb-mt,2)/tt)+o.noise*o.noise*(1.0/o.n+pow(tb-o.mt,2)/o.tt))),5) AS jump_sigma FROM k""".replace(
        "{0}",
        "+".join(f"greatest(regr_syy(m.{z},m.t)-pow(regr_sxy(m.{z},m.t),2)/regr_sxx(m.{z},m.t),0)" for z in "xy"),
    ),
)
def _(t):
    return rnd(mo.rate_steps(timed(t), KEY, 12.0), "vx", "vy", "err", "jump", "jump_sigma", n=5)


@query(
    "size_steps",
    f"""WITH {STATS_SQL}, d AS (SELECT video_id, idx, frame, ln(level) AS l, sd AS x, level AS y FROM stats WHERE level > 0),
w AS (SELECT *, median(l) OVER b AS bl, median(x) OVER b AS bx, median(y) OVER b AS "by", count(*) OVER b AS bn, median(l) OVER a AS al, median(x) OVER a AS ax, median(y) OVER a AS ay, count(*) OVER a AS an FROM d
  WINDOW b AS (PARTITION BY video_id ORDER BY idx RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY video_id ORDER BY idx RANGE BETWEEN CURRENT ROW AND 7 FOLLOWING)),
s AS (SELECT *, al-bl AS step FROM w WHERE bn=8 AND an=8 AND abs(al-bl) >= ln(1.2)),
i AS (SELECT *, sum(CASE WHEN idx - p <= 8 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY idx) AS island FROM (SELECT *, lag(idx) OVER (PARTITION BY video_id ORDER BY idx) AS p FROM s))
SELECT video_id, frame, round(exp(step),5) AS ratio, round((exp(step)*bx-ax)/(exp(step)-1),5) AS centre_x, round((exp(step)*"by"-ay)/(exp(step)-1),5) AS centre_y FROM i QUALIFY row_number() OVER (PARTITION BY video_id, island ORDER BY abs(step) DESC, idx) = 1""",
)
def _(t):
    d = frame_stats(t.frames).select("video_id", "idx", "frame", F.col("level").alias("length"), F.col("sd").alias("x"), F.col("level").alias("y"))
    return rnd(mo.size_steps(d, ["video_id"]), "ratio", "centre_x", "centre_y", n=5)


@query(
    "shake_test",
    f"""WITH {FRAMES_SQL}, tk AS (SELECT video_id, frame, level AS x, sd AS y FROM frames), nx AS (SELECT video_id, coalesce(lead(video_id) OVER (ORDER BY video_id), first(video_id) OVER (ORDER BY video_id)) AS other FROM (SELECT DISTINCT video_id FROM frames)),
bg AS (SELECT nx.video_id, frame, level AS x, sd AS y FROM nx JOIN frames f ON f.video_id=nx.other),
j AS (SELECT t.video_id, t.frame, t.x, t.y, b.x AS bx, b.y AS "by" FROM tk t JOIN bg b USING (video_id, frame)), a AS (SELECT p.video_id, unnest([p.x-2*q.x+r.x, p.y-2*q.y+r.y]) AS o, unnest([p.bx-2*q.bx+r.bx, p."by"-2*q."by"+r."by"]) AS b FROM j p JOIN j q ON p.video_id=q.video_id AND q.frame=p.frame-1 JOIN j r ON p.video_id=r.video_id AND r.frame=p.frame-2)
SELECT video_id, count(*)//2 AS frames, round(corr(o,b),6) AS r, round(regr_slope(o,b),6) AS slope, round(regr_slope(b,o),6) AS back,
CASE WHEN count(*)//2 < 40 THEN 'NO POWER' WHEN corr(o,b) > 0.3 AND regr_slope(o,b) BETWEEN 0.5 AND 1.5 THEN 'PASS' WHEN abs(corr(o,b)) < 0.1 THEN 'FLAG' ELSE 'inconclusive' END AS outcome FROM a GROUP BY ALL""",
)
def _(t):
    f = t.frames.select("video_id", "frame", F.col("level").alias("x"), F.col("sd").alias("y"))
    order = Window.orderBy("video_id")  # one row a video: the next one's frames are its background
    names = f.select("video_id").distinct()
    names = names.select("video_id", F.coalesce(F.lead("video_id").over(order), F.first("video_id").over(order)).alias("other"))
    bg = names.join(f.withColumnRenamed("video_id", "other"), "other").drop("other")
    return rnd(mo.shake_test(f, bg, ["video_id"]), "r", "slope", "back")


@query(
    "catch_up_steps",
    f"""WITH {STATS_SQL}, s AS (SELECT video_id, frame, diff*5 AS step FROM stats WHERE diff IS NOT NULL), m AS (SELECT a.video_id, a.frame, a.step, median(b.step) AS m, count(*) AS n FROM s a JOIN s b ON a.video_id=b.video_id AND b.frame BETWEEN a.frame-6 AND a.frame+6 AND b.frame<>a.frame GROUP BY ALL)
SELECT video_id, frame, round(step,6) AS step, round(step/m,6) AS times FROM m WHERE n >= 6 AND step > 8 AND step/m > 1.7 AND step/m < 2.3""",
)
def _(t):
    s = frame_stats(t.frames).where("diff IS NOT NULL").select("video_id", "frame", (F.col("diff") * 5).alias("step"))
    return rnd(mo.catch_up_steps(s, ["video_id"]), "step", "times")


@query(
    "band_standing",
    f"""WITH {SP}, w AS (SELECT video_id, curve, hz, power, sum(power) OVER a - sum(power) OVER b AS s, count(*) OVER a - count(*) OVER b AS n FROM sp WINDOW a AS (PARTITION BY video_id, curve ORDER BY hz ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), b AS (PARTITION BY video_id, curve ORDER BY hz ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT video_id, curve, hz, round(power,6) AS power, round(power/(s/n),4) AS standing FROM w""",
)
def _(t):
    return rnd(rnd(mo.band_standing(spec(t), K), "power"), "standing", n=4)


@query("depth_along")
def _(t):
    c = curve_idx(t)
    b = se.strongest(se.periodogram(c, K, FREQS), K, 0.02, 0.32)
    return rnd(mo.depth_along(c, b, K, 128), "depth", "chi2", "p", n=5)


@query(
    "position_rhythm",
    f"""WITH {TIMED_SQL}, c AS (SELECT video_id, object_id, t_s, 'x' AS axis, x AS dev FROM timed WHERE frame%9<>0 UNION ALL SELECT video_id, object_id, t_s, 'y', y FROM timed WHERE frame%9<>0)
SELECT video_id, object_id, axis, hz, n, round(power,6) AS power FROM {spec_sql('c','video_id, object_id, axis')}""",
)
def _(t):
    d = timed(t)
    held = d.where("frame % 9 = 0").select("video_id", "frame").distinct()
    return rnd(mo.position_rhythm(d, held, KEY, FREQS).select(*KEY, "axis", "hz", "n", "power"), "power")


@query(
    "light_train",
    f"""WITH {TIMED_SQL}, g AS (SELECT video_id, object_id, hz, count(*) AS n, sqrt(pow(avg(cos(2*pi()*hz*t_s)),2)+pow(avg(sin(2*pi()*hz*t_s)),2)) AS z FROM timed, {FR_SQL} WHERE x > 60 GROUP BY ALL HAVING count(*) >= 4)
SELECT video_id, object_id, hz, round(z,6) AS coherence, n AS flashes, round(exp(-n*z*z),6) AS p_one_rate FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY z DESC, hz) AS r FROM g) WHERE r=1""",
)
def _(t):
    return rnd(mo.light_train(timed(t).where("x > 60"), KEY, FREQS), "coherence", "p_one_rate")


@query(
    "engine_clock_refine",
    """WITH e AS (SELECT user_id AS video_id, event_id%6+1 AS k, value/(event_id%6+1) AS f FROM events), g AS (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY f, k) AS c FROM (SELECT *, CASE WHEN f - lag(f) OVER (PARTITION BY video_id ORDER BY f, k) <= 0.3 THEN 0 ELSE 1 END AS nw FROM e))
SELECT video_id, count(*) AS n, count(DISTINCT k) AS harmonics, round(avg(f),6) AS f0, round(stddev_pop(f),6) AS sd FROM g GROUP BY video_id, c HAVING count(DISTINCT k) >= 3""",
)
def _(t):
    d = t.events.select(F.col("user_id").alias("video_id"), F.col("value").alias("hz"), (F.col("event_id") % 6 + 1).alias("k"))
    return rnd(mo.engine_clock_refine(d, gap=0.3), "f0", "sd")


@query("sweep_summary")
def _(t):
    w = se.windowed_beat(curve_idx(t), K, FREQS, 64, 0.12, near=0.05)
    whole = mo.band_standing(spec(t), K).groupBy(*K).agg(F.max("standing").alias("over_drift"))
    return mo.sweep_summary(w, whole)
