"""Queries over readings of one thing at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions.chunked import row_index
from skyloom.functions.draws import uniform_sql
from skyloom.operators import readings as re_
from skyloom.plans.corpus import CURVES_SQL, FRAMES_SQL, TRACK_SQL
from skyloom.plans.q_tracks import TIMED_SQL, timed
from skyloom.plans.q_windows import rnd
from skyloom.plans.registry import query

KEY = ["video_id", "object_id"]


@query("class_bins", "SELECT event_id, CASE WHEN value < 0 THEN NULL WHEN value < 15 THEN '0-15' WHEN value < 30 THEN '15-30' WHEN value < 60 THEN '30-60' WHEN value < 120 THEN '60-120' ELSE 'over 120' END AS cell FROM events")
def _(t):
    return t.events.select("event_id", re_.bin_label(F.col("value"), [0, 15, 30, 60, 120]).alias("cell"))


@query(
    "shaft_candidates",
    """WITH t AS (SELECT event_id AS tone_id, value AS hz, b AS blades FROM events, range(2,9) r(b) WHERE value > 1), a AS (SELECT p_partkey AS airframe, p_size%7+2 AS blades, p_retailprice/10 AS bp FROM part)
SELECT tone_id, t.blades, round(60*hz/t.blades,6) AS rpm, count(CASE WHEN abs(hz/bp-1) <= 0.015 THEN 1 END) AS airframes, min(CASE WHEN abs(hz/bp-1) <= 0.015 THEN airframe END) AS first FROM t LEFT JOIN a USING (blades) GROUP BY ALL""",
)
def _(t):
    tones = t.events.where("value > 1").select(F.col("event_id").alias("tone_id"), F.col("value").alias("hz"))
    a = t.part.select(F.col("p_partkey").alias("airframe"), (F.col("p_size") % 7 + 2).alias("blades"), (F.col("p_retailprice") / 10).alias("blade_pass_hz"))
    return rnd(re_.shaft_candidates(tones, a), "rpm")


@query(
    "engine_speeds",
    f"SELECT event_id AS tone_id, n AS cylinders, t AS turns, round(60*value*t/n,6) AS rpm FROM events, (VALUES {','.join(map(str, re_.ENGINES))}) e(n,t)",
)
def _(t):
    return rnd(re_.engine_speeds(t.events.select(F.col("event_id").alias("tone_id"), F.col("value").alias("hz"))), "rpm")


@query(
    "shaft_orders",
    """WITH p AS (SELECT user_id AS video_id, event_id%16 AS w, value AS hz, 5.0+event_id%11 AS db FROM events), s AS (SELECT DISTINCT user_id AS video_id, 200.0+user_id%9*50 AS rpm FROM events),
o AS (SELECT *, k*rpm/60 AS f FROM s, range(1,25) r(k)), b AS (SELECT o.video_id, rpm, k, w, max(db) AS x FROM o JOIN p ON p.video_id=o.video_id AND abs(hz-f) <= 0.75 GROUP BY ALL),
n AS (SELECT video_id, count(DISTINCT w) AS windows FROM p GROUP BY ALL)
SELECT o.video_id, o.rpm, CAST(o.k AS INT) AS "order", windows, round(coalesce(sum(x),0)/windows,6) AS excess_db FROM o JOIN n ON n.video_id=o.video_id LEFT JOIN b ON b.video_id=o.video_id AND b.k=o.k GROUP BY o.video_id, o.rpm, o.k, windows""",
)
def _(t):
    p = t.events.select(F.col("user_id").alias("video_id"), (F.col("event_id") % 16).alias("window"), F.col("value").alias("hz"), (5.0 + F.col("event_id") % 11).alias("excess_db"))
    s = t.events.select(F.col("user_id").alias("video_id"), (200.0 + F.col("user_id") % 9 * 50).alias("rpm")).distinct()
    return rnd(re_.shaft_orders(p, s), "excess_db")


@query(
    "explain_lines",
    """WITH f AS (SELECT * FROM (VALUES (0,'bus',40.0,0.3,1),(1,'mains',50.0,0.3,2),(2,'rotor',7.0,0.2,3)) v(prio,family,f0,tol,least)), j AS (SELECT user_id AS video_id, event_id AS line_id, prio, family, least, round_even(value/f0,0) AS k FROM events, f WHERE round_even(value/f0,0) BETWEEN 1 AND 40 AND abs(value-round_even(value/f0,0)*f0) <= tol),
o AS (SELECT video_id, prio FROM j GROUP BY video_id, prio, least HAVING count(DISTINCT k) >= least) SELECT video_id, line_id, arg_min(family, prio) AS family, CAST(arg_min(k, prio) AS INT) AS k FROM j JOIN o USING (video_id, prio) GROUP BY ALL""",
)
def _(t):
    d = t.events.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("line_id"), F.col("value").alias("hz"))
    return re_.explain_lines(d, [("bus", 40.0, 0.3, 1), ("mains", 50.0, 0.3, 2), ("rotor", 7.0, 0.2, 3)])


_KINDS = ",".join(str((i, *row)) for i, row in enumerate(re_.FAMILY_KINDS))


def _families_sql(rounds: int) -> str:
    """Votes once, then one round of choosing and taking after another."""
    r = lambda i: f"""
g{i} AS MATERIALIZED (SELECT video_id, id, cell, prio, family, count(DISTINCT h) AS n, round(sum(strength),6) AS s, round(sum(h*hz)/sum(h*h),6) AS f0 FROM v{i} GROUP BY video_id, id, cell, prio, family, least, low_n, "first"
  HAVING count(DISTINCT h) >= least AND count(DISTINCT h) FILTER (h <= any_low) >= low_n AND min(h) <= "first"),
b{i} AS MATERIALIZED (SELECT video_id, max(struct_pack(p := -prio, n := n, s := s, f0 := f0, id := id, cell := cell, family := family)) AS b FROM g{i} GROUP BY ALL),
t{i} AS MATERIALIZED (SELECT video_id, line_id, b.family AS family, b.f0 AS f0, min(h) AS k FROM v{i} v JOIN b{i} USING (video_id) WHERE v.id=b.id AND v.cell=b.cell GROUP BY ALL),
v{i + 1} AS MATERIALIZED (SELECT * FROM v{i} WHERE NOT EXISTS (FROM t{i} t WHERE t.video_id=v{i}.video_id AND t.line_id=v{i}.line_id))""".replace("any_low", "low")
    return f"""WITH kinds AS (SELECT * FROM (VALUES {_KINDS}) f(id,prio,family,lo,hi,kmax,rel,tol,least,low,low_n,"first")),
h AS (SELECT user_id AS video_id, event_id AS line_id, value AS hz, 1.0+event_id%7 AS strength, kinds.*, unnest(CASE WHEN rel=0 THEN [CAST(round_even(value/lo,0) AS BIGINT)] ELSE range(greatest(CAST(ceil(value/hi) AS BIGINT),1), least(CAST(floor(value/lo) AS BIGINT),kmax)+1) END) AS h FROM events, kinds WHERE value > 0),
u AS (SELECT *, ln(hz/h)/nullif(rel,0) AS half FROM h WHERE h BETWEEN 1 AND kmax AND (rel > 0 OR abs(hz-h*lo) <= tol)),
v0 AS MATERIALIZED (SELECT video_id, line_id, hz, strength, prio, family, id, least, low, low_n, "first", h, unnest(CASE WHEN rel=0 THEN [0] ELSE [2*CAST(floor(half/2) AS BIGINT), 2*CAST(floor((half+1)/2) AS BIGINT)-1] END) AS cell FROM u),
{",".join(r(i) for i in range(rounds))} {" UNION ALL ".join(f"SELECT video_id, line_id, family, round(f0,3) AS f0, CAST(k AS INT) AS k FROM t{i}" for i in range(rounds))}"""


@query("line_families", _families_sql(24))
def _(t):
    d = t.events.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("line_id"), F.col("value").alias("hz"), (1.0 + F.col("event_id") % 7).alias("strength"))
    return rnd(re_.line_families(d), "f0", n=3)


@query(
    "clock_ticks",
    """WITH d AS (SELECT DISTINCT user_id AS video_id, CAST(floor(epoch(ts)/86400) AS BIGINT) AS frame FROM events), g AS (SELECT *, frame - lag(frame) OVER (PARTITION BY video_id ORDER BY frame) AS gap FROM d),
m AS (SELECT video_id, median(gap) AS med, count(*) AS ticks, min(frame) AS f0 FROM g GROUP BY ALL),
s AS (SELECT video_id, avg(CASE WHEN abs(gap-med) <= 0.25 THEN 1.0 ELSE 0.0 END) FILTER (gap IS NOT NULL) AS s FROM g JOIN m USING (video_id) GROUP BY ALL),
k AS (SELECT video_id, frame, ticks, round_even((frame-f0)/med,0) AS k FROM d JOIN m USING (video_id) JOIN s USING (video_id) WHERE ticks >= 4 AND abs(med-1) <= 0.12 AND s >= 0.7),
f AS (SELECT video_id, regr_slope(frame,k) AS period, regr_intercept(frame,k) AS i FROM k GROUP BY ALL)
SELECT video_id, frame, ticks, round(period,4) AS period, round(frame-(period*k+i),4) AS off, abs(frame-(period*k+i)) > 1.5 AS early_late FROM k JOIN f USING (video_id)""",
)
def _(t):
    d = t.events.select(F.col("user_id").alias("video_id"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).alias("frame")).distinct()
    return rnd(re_.clock_ticks(d, 1.0, ["video_id"]), "period", "off", n=4)


@query(
    "leverage_audit",
    f"""WITH {TRACK_SQL}, w AS (SELECT video_id, object_id, frame, count(*) OVER k AS n, coalesce((1/count(*) OVER k + pow(frame - avg(frame) OVER k, 2)/nullif(var_pop(frame) OVER k * count(*) OVER k, 0))/2, 1/count(*) OVER k) AS weight FROM track WINDOW k AS (PARTITION BY video_id, object_id)),
c AS (SELECT *, sum(weight) OVER (PARTITION BY video_id, object_id ORDER BY frame) AS hi FROM w), e AS (SELECT *, hi - weight AS lo, CASE WHEN hi > 1-1e-9 THEN 1.0 ELSE hi END AS top FROM c),
u AS (SELECT video_id, object_id, {uniform_sql(0, "video_id", "object_id", "d")} AS u FROM (SELECT DISTINCT video_id, object_id FROM w WHERE n > 59), range(1,60) x(d))
SELECT video_id, object_id, frame, round(weight,6) AS weight, 1 AS times FROM e WHERE n <= 59 UNION ALL
SELECT e.video_id, e.object_id, frame, round(weight,6), count(*) FROM e JOIN u ON e.video_id=u.video_id AND e.object_id=u.object_id AND u.u >= e.lo AND u.u < e.top WHERE n > 59 GROUP BY ALL""",
)
def _(t):
    return rnd(re_.leverage_audit(t.track, KEY), "weight")


@query(
    "company",
    f"""WITH {TRACK_SQL}, p AS (SELECT object_id%7 AS video_id, object_id AS prop_id, min(frame) AS first, max(frame) AS last, avg(x) AS x, avg(y) AS y, regr_slope(x,frame) AS vx, regr_slope(y,frame) AS vy FROM track GROUP BY ALL)
SELECT a.video_id, a.prop_id, count(b.prop_id) AS company FROM p a LEFT JOIN p b ON a.video_id=b.video_id AND a.prop_id<>b.prop_id AND a.first <= b.last AND a.last >= b.first AND a.vx*b.vx+a.vy*b.vy > cos(radians(25))*sqrt(a.vx*a.vx+a.vy*a.vy)*sqrt(b.vx*b.vx+b.vy*b.vy)
  AND sqrt(b.vx*b.vx+b.vy*b.vy)/sqrt(a.vx*a.vx+a.vy*a.vy) BETWEEN 0.5 AND 2 AND sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) > 5 GROUP BY ALL""",
)
def _(t):
    p = t.track.groupBy((F.col("object_id") % 7).alias("video_id"), F.col("object_id").alias("prop_id")).agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.regr_slope("x", "frame").alias("vx"), F.regr_slope("y", "frame").alias("vy"))
    return re_.company(p, 5.0).select("video_id", "prop_id", "company")


@query(
    "consensus_shift",
    """WITH t AS (SELECT DISTINCT l_suppkey AS video_id, CAST(floor((CAST(l_shipdate AS DATE) - DATE '1995-01-01')/90.0) AS BIGINT) AS frame, l_orderkey*10+l_linenumber AS k, l_quantity AS dx, l_discount*100 AS dy FROM lineitem),
n AS (SELECT a.video_id, a.frame, a.k, count(*) AS n, median(b.dx) AS mx, median(b.dy) AS my FROM t a JOIN t b ON a.video_id=b.video_id AND a.frame=b.frame AND abs(a.dx/6.0-b.dx/6.0) <= 1 AND abs(a.dy/2.5-b.dy/2.5) <= 1 GROUP BY ALL),
s AS (SELECT video_id, frame, mx, my FROM n QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY n DESC, k) = 1)
SELECT video_id, frame, count(*) AS members, round(avg(dx),4) AS dx, round(avg(dy),4) AS dy FROM t JOIN s USING (video_id, frame) WHERE abs(dx-mx) <= 6 AND abs(dy-my) <= 2.5 GROUP BY ALL HAVING count(*) >= 8""",
)
def _(t):
    d = t.lineitem.select(F.col("l_suppkey").alias("video_id"), F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_quantity").alias("dx"), (F.col("l_discount") * 100).alias("dy"))
    d = d.withColumn("frame", F.floor(F.col("frame") / 90)).dropDuplicates(["video_id", "frame", "k"])
    return rnd(re_.consensus_shift(d), "dx", "dy", n=4)


@query(
    "scene_state",
    f"""WITH {FRAMES_SQL}, s AS (SELECT video_id, CASE WHEN frame%7<>0 THEN sqrt(pow(level-25.5,2)+pow(sd-14,2))/5*30 END AS s FROM frames)
SELECT video_id, count(*) AS pairs, round(avg(CASE WHEN s IS NULL THEN 1.0 ELSE 0.0 END),6) AS lost, round(avg(CASE WHEN s <= 20 THEN 1.0 ELSE 0.0 END),6) AS held, round(avg(CASE WHEN s > 20 THEN 1.0 ELSE 0.0 END),6) AS moving,
  round(quantile_cont(CASE WHEN s > 20 THEN s END,0.16),5) AS p16, round(quantile_cont(CASE WHEN s > 20 THEN s END,0.5),5) AS median, round(quantile_cont(CASE WHEN s > 20 THEN s END,0.84),5) AS p84 FROM s GROUP BY ALL""",
)
def _(t):
    d = t.frames.select("video_id", "frame", F.lit(5).alias("k"), F.when(F.col("frame") % 7 != 0, F.col("level") - 25.5).alias("dx"), (F.col("sd") - 14).alias("dy"))
    return rnd(rnd(re_.scene_state(d, 20.0, 30.0), "lost", "held", "moving"), "p16", "median", "p84", n=5)


@query(
    "integrate_comotion",
    f"""WITH {TIMED_SQL}, m AS (SELECT video_id, object_id, (x-35)/9 AS rx, (y-50)/9 AS ry, t_s FROM timed WHERE frame%4<>0), g AS (SELECT video_id, object_id, count(*) AS pairs, sum(rx) AS x, sum(ry) AS y, max(t_s)-min(t_s) AS t FROM m GROUP BY ALL)
SELECT video_id, object_id, pairs, round(sqrt(x*x+y*y),5) AS rel_d, round(sqrt(x*x+y*y)/t,5) AS rel_d_per_s, round((degrees(atan2(x,-y))+360)%360,3) AS direction_deg FROM g""",
)
def _(t):
    d = timed(t).select(*KEY, F.when(F.col("frame") % 4 != 0, F.col("x") - 35).alias("rel_x"), (F.col("y") - 50).alias("rel_y"), F.lit(9.0).alias("diameter"), "t_s")
    return rnd(rnd(re_.integrate_comotion(d, KEY), "rel_d", "rel_d_per_s", n=5), "direction_deg", n=3)


@query(
    "slew_scale",
    """WITH s AS (SELECT l_suppkey AS video_id, l_linenumber, count(*) AS n, covar_pop(l_discount, l_quantity) AS c, var_pop(l_quantity) AS v, var_pop(l_discount) AS w FROM lineitem GROUP BY ALL), g AS (SELECT video_id, sum(n*c) AS xy, sum(n*v) AS xx, sum(n*w) AS yy, sum(n) AS n, count(*) AS k FROM s GROUP BY ALL)
SELECT video_id, n, k AS stretches, round(xy/xx,9) AS c, round(sqrt(greatest(yy-xy*xy/xx,0)/greatest(n-k-1,1)/xx),9) AS err, abs(xy/xx) > 3*sqrt(greatest(yy-xy*xy/xx,0)/greatest(n-k-1,1)/xx) AS registers FROM g""",
)
def _(t):
    d = t.lineitem.select(F.col("l_suppkey").alias("video_id"), F.col("l_linenumber").alias("stretch"), F.col("l_discount").alias("theta"), F.col("l_quantity").alias("x"))
    return rnd(re_.slew_scale(d, ["video_id"]), "c", "err", n=9)


@query("north_rate", f"WITH {TIMED_SQL} SELECT video_id, object_id, count(*) AS n, round(regr_slope(y,t_s),6) AS rate_deg_s, round(stddev_samp(x),6) AS radius_sd FROM timed GROUP BY ALL")
def _(t):
    return rnd(re_.north_rate(timed(t).withColumnRenamed("y", "theta").withColumnRenamed("x", "r"), KEY), "rate_deg_s", "radius_sd")


def _side(a, b, v):
    n = f"count(*) FILTER (frame {a} f0)"
    return f"regr_slope({v},t_s) FILTER (frame {a} f0) AS b{b}{v}, regr_sxx({v},t_s) FILTER (frame {a} f0) AS s{b}{v}, regr_syy({v},t_s) FILTER (frame {a} f0) AS y{b}{v}"


@query(
    "sup_wald_scan",
    f"""WITH {TIMED_SQL}, c AS (SELECT object_id, frame AS f0, count(*) OVER (PARTITION BY object_id) AS n FROM timed),
g AS (SELECT t.video_id, t.object_id, f0, n, count(*) FILTER (frame <= f0) AS nl, {_side('<=','l','x')}, {_side('>','r','x')}, {_side('<=','l','y')}, {_side('>','r','y')} FROM timed t JOIN c USING (object_id) GROUP BY t.video_id, t.object_id, f0, n),
w AS (SELECT *, pow(brx-blx,2)/(((ylx-blx*blx*slx)+(yrx-brx*brx*srx))/(n-4)*(1/slx+1/srx)) + pow(bry-bly,2)/(((yly-bly*bly*sly)+(yry-bry*bry*sry))/(n-4)*(1/sly+1/sry)) AS w FROM g WHERE nl >= greatest(0.15*n,3) AND n-nl >= greatest(0.15*n,3) AND n > 6)
SELECT video_id, object_id, arg_max(f0, w) AS frame, round(max(w),4) AS wald FROM w GROUP BY ALL""",
)
def _(t):
    return rnd(re_.sup_wald_scan(timed(t), KEY), "wald", n=4)


@query(
    "rate_band",
    f"""WITH {TIMED_SQL}, w AS (SELECT video_id, object_id, frame, count(x) OVER w AS n, regr_slope(x,t_s) OVER w AS vx, regr_slope(y,t_s) OVER w AS vy, regr_sxx(x,t_s) OVER w AS sxx, regr_syy(x,t_s) OVER w AS syx, regr_syy(y,t_s) OVER w AS syy FROM timed
  WINDOW w AS (PARTITION BY object_id ORDER BY frame RANGE BETWEEN 60 PRECEDING AND 60 FOLLOWING))
SELECT video_id, object_id, frame, n, round(sqrt(vx*vx+vy*vy),5) AS rate, round(sqrt(greatest(syx-vx*vx*sxx,0)/(n-2)/sxx+greatest(syy-vy*vy*sxx,0)/(n-2)/sxx),5) AS err FROM w WHERE n >= 6""",
)
def _(t):
    return rnd(re_.rate_band(timed(t), KEY, 121, 6), "rate", "err", n=5)


@query(
    "discontinuity",
    """WITH d AS (SELECT l_suppkey AS video_id, CAST(CAST(l_shipdate AS DATE)-DATE '1998-06-01' AS DOUBLE) AS x, l_quantity AS y FROM lineitem), c AS (SELECT video_id, x-cut AS u, y, cut FROM d, (SELECT unnest([0.0,-600.0,-300.0,300.0,600.0]::DOUBLE[]) AS cut) WHERE abs(x-cut) <= 250),
g AS (SELECT video_id, cut, regr_intercept(y,u) FILTER (u >= 0) - regr_intercept(y,u) FILTER (u < 0) AS jump, count(*) FILTER (u < 0) AS b, count(*) FILTER (u >= 0) AS a FROM c GROUP BY ALL HAVING count(*) FILTER (u < 0) >= 3 AND count(*) FILTER (u >= 0) >= 3)
SELECT r.video_id, round(r.jump,6) AS jump, r.b AS before, r.a AS "after", count(p.jump) AS placebos, round((count(CASE WHEN abs(p.jump) >= abs(r.jump) THEN 1 END)+1)/(count(p.jump)+1),6) AS p FROM g r LEFT JOIN g p ON r.video_id=p.video_id AND p.cut<>0 WHERE r.cut=0 GROUP BY r.video_id, r.jump, r.b, r.a""",
)
def _(t):
    d = t.lineitem.select(F.col("l_suppkey").alias("video_id"), F.datediff(F.to_date("l_shipdate"), F.lit("1998-06-01").cast("date")).cast("double").alias("x"), F.col("l_quantity").alias("y"))
    return rnd(re_.discontinuity(d, ["video_id"], 250.0, [-600, -300, 300, 600]), "jump", "p")


@query(
    "block_bootstrap",
    f"""WITH {TIMED_SQL}, r AS (SELECT video_id, object_id, t_s, x AS r, row_number() OVER (PARTITION BY object_id ORDER BY frame) AS idx, count(*) OVER (PARTITION BY object_id) AS n FROM timed),
b AS (SELECT DISTINCT video_id, object_id, n, draw, j FROM r, range(1,21) d(draw), range(0,200) q(j) WHERE n > 8 AND j <= (n-1)//8),
s AS (SELECT *, CAST(floor({uniform_sql(0, "video_id", "object_id", "draw", "j")}*(n-8+1)) AS BIGINT) AS s FROM b),
p AS (SELECT video_id, object_id, draw, j*8+i AS to_, s+i AS idx, n FROM s, range(1,9) k(i) WHERE j*8+i <= n),
f AS (SELECT p.video_id, p.object_id, draw, regr_slope(a.r, c.t_s) AS b FROM p JOIN r a ON a.object_id=p.object_id AND a.idx=p.idx JOIN r c ON c.object_id=p.object_id AND c.idx=p.to_ GROUP BY ALL)
SELECT video_id, object_id, count(*) AS draws, round(stddev_samp(b),6) AS slope_err FROM f GROUP BY ALL""",
)
def _(t):
    d = row_index(timed(t), KEY, "frame").select(*KEY, "idx", "t_s", F.col("x").alias("r"))
    return rnd(re_.block_bootstrap(d, KEY, 8, 20), "slope_err")


@query(
    "sound_lines",
    """WITH pk AS (SELECT user_id AS video_id, event_id%6 AS "window", value AS hz, CAST(event_id%17 AS DOUBLE) AS db FROM events), g AS (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY hz, "window") AS line FROM (SELECT *, CASE WHEN hz - lag(hz) OVER (PARTITION BY video_id ORDER BY hz, "window") <= 0.6 THEN 0 ELSE 1 END AS nw FROM pk)),
o AS (SELECT video_id, line, "window", arg_max(hz, (db, -hz)) AS hz, max(db) AS db FROM g GROUP BY ALL), w AS (SELECT video_id, count(DISTINCT "window") AS w FROM pk GROUP BY ALL)
SELECT o.video_id, round(median(hz),6) AS hz, round(stddev_pop(hz),6) AS sd, round(avg(db),6) AS db, count(*) AS windows, stddev_pop(hz) <= 0.2 AS steady FROM o JOIN w USING (video_id) GROUP BY o.video_id, line, w HAVING count(*) >= 0.5*w""",
)
def _(t):
    d = t.events.select(F.col("user_id").alias("video_id"), (F.col("event_id") % 6).alias("window"), F.col("value").alias("hz"), (F.col("event_id") % 17).cast("double").alias("excess_db"))
    return rnd(re_.sound_lines(d), "hz", "sd", "db")


@query(
    "companion_behaviour",
    """WITH s AS (SELECT l_suppkey AS video_id, l_linenumber AS st, count(*) AS n, covar_pop(l_discount,l_quantity)+covar_pop(l_tax,l_quantity) AS c, 2*var_pop(l_quantity) AS v, sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS h FROM lineitem GROUP BY ALL)
SELECT video_id, sum(n) AS frames, count(*) AS stretches, round(sum(h)/sum(n),9) AS held_share, round(sum(n*c)/sum(n*v),9) AS share FROM s GROUP BY ALL""",
)
def _(t):
    d = t.lineitem.select(F.col("l_suppkey").alias("video_id"), F.col("l_linenumber").alias("stretch"), F.col("l_discount").alias("own_x"), F.col("l_tax").alias("own_y"), F.col("l_quantity").alias("v_x"), F.col("l_quantity").alias("v_y"), (F.col("l_returnflag") == "R").alias("held"))
    return rnd(re_.companion_behaviour(d, ["video_id"]), "held_share", "share", n=9)


@query("swing_period")
def _(t):
    d = timed(t).select(*KEY, "t_s", F.col("y").alias("angle"))
    return rnd(re_.swing_period(d, KEY, [0.1 * i for i in range(1, 17)]), "period_s", "power", "fap", "cycles", "length_m", n=5)


PX = "px AS (SELECT l_returnflag AS video_id, l_orderkey AS frame, l_linenumber AS y, l_suppkey%8 AS x, max(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def px(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("video_id"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("y"), (F.col("l_suppkey") % 8).alias("x")).agg(F.max("l_quantity").alias("v"))


@query("pixel_stats", f"WITH {PX} SELECT video_id, y, x, count(*) AS frames, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS sd, CASE WHEN avg(CASE WHEN v <= 25 THEN 1.0 ELSE 0 END) >= 0.5 THEN 'dark' WHEN avg(CASE WHEN v >= 26 THEN 1.0 ELSE 0 END) >= 0.51 THEN 'bright' END AS mask FROM px GROUP BY ALL".replace("0.51", "0.5"))
def _(t):
    return rnd(re_.pixel_stats(px(t), 25, 26, 0.5), "mean", "sd")


PT = "pt AS (SELECT r AS video_id, 1 AS object_id, o_orderkey AS frame, CAST(o_custkey%8 AS DOUBLE) AS x, CAST(1+o_custkey%7 AS DOUBLE) AS y FROM orders, (SELECT unnest(['A','N','R']) AS r))"


def pt(t):
    return t.orders.select(F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("video_id"), F.lit(1).alias("object_id"), F.col("o_orderkey").alias("frame"), (F.col("o_custkey") % 8).cast("double").alias("x"), (1 + F.col("o_custkey") % 7).cast("double").alias("y"))


@query(
    "aperture_photometry",
    f"""WITH {PX}, {PT}, j AS (SELECT pt.video_id, object_id, pt.frame, v, sqrt(pow(px.x-pt.x,2)+pow(px.y-pt.y,2)) AS d FROM pt JOIN px ON pt.video_id=px.video_id AND pt.frame=px.frame)
SELECT video_id, object_id, frame, count(CASE WHEN d <= 2 THEN 1 END) AS pixels, median(CASE WHEN d BETWEEN 2.5 AND 4 THEN v END) AS background, sum(CASE WHEN d <= 2 THEN v END) - count(CASE WHEN d <= 2 THEN 1 END)*median(CASE WHEN d BETWEEN 2.5 AND 4 THEN v END) AS brightness FROM j GROUP BY ALL HAVING count(CASE WHEN d <= 2 THEN 1 END) > 0 AND median(CASE WHEN d BETWEEN 2.5 AND 4 THEN v END) IS NOT NULL""",
)
def _(t):
    return re_.aperture_photometry(pt(t), px(t), 2.0, (2.5, 4.0))


@query("object_stack", f"WITH {PX}, {PT} SELECT pt.video_id, object_id, CAST(px.y-pt.y AS INT) AS dy, CAST(px.x-pt.x AS INT) AS dx, round(avg(v),6) AS mean, count(*) AS frames FROM pt JOIN px ON pt.video_id=px.video_id AND pt.frame=px.frame WHERE abs(px.x-pt.x) <= 2 AND abs(px.y-pt.y) <= 2 GROUP BY ALL")
def _(t):
    return rnd(re_.object_stack(pt(t), px(t), 2), "mean")


@query(
    "curve_stats",
    f"""WITH {CURVES_SQL}, s AS (SELECT *, CASE WHEN frame - lag(frame) OVER w = 1 THEN value - lag(value) OVER w END AS step FROM curves WINDOW w AS (PARTITION BY video_id, curve ORDER BY frame)),
a AS (SELECT video_id, curve, kind, median(value) AS med, 1.4826*mad(value) AS var, 1.4826*mad(step)/sqrt(2.0) AS fast FROM s GROUP BY ALL), b AS (SELECT video_id, median(fast) AS bg FROM a WHERE kind='background' GROUP BY ALL)
SELECT a.video_id, curve, round(var/abs(med),7) AS light_var, round(fast/abs(med),7) AS light_fast, round(fast/bg,7) AS light_over_bg FROM a JOIN b USING (video_id) WHERE kind='object'""",
)
def _(t):
    return rnd(re_.curve_stats(t.curves, ["video_id"]), "light_var", "light_fast", "light_over_bg", n=7)


@query("blind_scorecard", "WITH o AS (SELECT user_id AS case_id, CASE WHEN user_id%3=0 THEN 'view' ELSE 'other' END AS known, CASE WHEN event_id%5>0 THEN event_type END AS label FROM events) SELECT case_id, known, count(*) AS objects, CASE WHEN count(label)=0 THEN 'no power' WHEN bool_or(label='view') THEN 'named' ELSE 'not named' END AS verdict, CASE WHEN count(label)>0 THEN bool_or(label='view') = (known='view') END AS agrees FROM o GROUP BY case_id, known")
def _(t):
    d = t.events.select(F.col("user_id").alias("case_id"), F.when(F.col("user_id") % 3 == 0, "view").otherwise("other").alias("known"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("label"))
    return re_.blind_scorecard(d, ["view"])


@query(
    "value_of_information",
    f"""WITH d AS (SELECT event_id AS object_id, value, {uniform_sql("0-k", "event_id", "d")} AS uk, {uniform_sql("0-r", "event_id", "d")} AS ur FROM events, range(1,65) x(d)),
h AS (SELECT *, CASE WHEN value/(500+uk*1500)*(1000+ur*9000) < 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM d), c AS (SELECT object_id, 'k' AS u, floor(uk*4) AS b, count(*) AS n, sum(hit) AS k FROM h GROUP BY ALL UNION ALL SELECT object_id, 'r', floor(ur*4), count(*), sum(hit) FROM h GROUP BY ALL),
e AS (SELECT object_id, u, n, k, CASE WHEN k > 0 AND k < n THEN n*(-(k/n)*log2(k/n)-(1-k/n)*log2(1-k/n)) ELSE 0 END AS hb FROM c), g AS (SELECT object_id, u, sum(n) AS n, sum(k) AS k, sum(hb) AS hb FROM e GROUP BY ALL)
SELECT object_id, u AS unknown, round(k/n,9) AS p, round(CASE WHEN k > 0 AND k < n THEN -(k/n)*log2(k/n)-(1-k/n)*log2(1-k/n) ELSE 0 END - hb/n,6) AS bits FROM g""",
)
def _(t):
    d = re_.value_of_information(t.events.select(F.col("event_id").alias("object_id"), "value"), {"k": (500.0, 2000.0), "r": (1000.0, 10000.0)}, F.col("value") / F.col("k") * F.col("r"), 100.0)
    return rnd(rnd(d, "p", n=9), "bits")


@query("dash_spectrum", "SELECT user_id AS video_id, CAST(floor(value*(1+event_id%5)/20.0) AS BIGINT) AS bin, sum(event_id%13) AS power, count(*) AS dashes FROM events GROUP BY ALL")
def _(t):
    d = t.events.select(F.col("user_id").alias("video_id"), F.col("value").alias("cycles"), (1 + F.col("event_id") % 5).alias("speed"), (F.col("event_id") % 13).alias("power"))
    return re_.dash_spectrum(d, ["video_id"], 20.0)
