"""Queries over running and rolling measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions.chunked import row_index, scan
from skyloom.operators import windows as w
from skyloom.plans.corpus import CURVES_SQL, FRAMES_SQL, STATS_SQL, TRACK_SQL, frame_stats
from skyloom.plans.registry import query

FPS = 30.0


def half_away(c, n):
    """A double to ``n`` decimals as SQL engines round it: scaled, halves away from nought, scaled back."""
    y = F.abs(c) * F.lit(10.0**n)
    whole = F.floor(y)
    q = F.when(y < 2.0**52, whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)).otherwise(y) / F.lit(10.0**n)
    return F.when(F.isnan(y) | (y == float("inf")), c).otherwise(F.when(c < 0, -q).otherwise(q) + F.lit(0.0))


def rnd(df, *cols, n=6):
    """Doubles to ``n`` decimals, so that a sum's order does not show."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: half_away(F.col(c), n) if kinds[c] == "double" else F.round(c, n) for c in cols})


# a 61-row median with the end rows repeated: each row weighs as often as the repeated ends put it in the window
def med61(value: str, src: str = "stats", size: int = 61) -> str:
    half = size // 2
    return f"""
padded AS (
  SELECT video_id, idx, {value} AS v, frame, false AS pad FROM {src}
  UNION ALL SELECT video_id, 1 - s, arg_min({value}, idx), NULL, true FROM {src}, range(1,{half + 1}) r(s) GROUP BY video_id, s
  UNION ALL SELECT video_id, max(idx) + s, arg_max({value}, idx), NULL, true FROM {src}, range(1,{half + 1}) r(s) GROUP BY video_id, s),
med AS (SELECT *, median(v) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS m FROM padded)"""


@query(
    "repeated_frames",
    f"""WITH {STATS_SQL}
SELECT video_id, frame, round(diff,6) AS diff FROM (
  SELECT *, median(CASE WHEN idx > 1 THEN diff END) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS m
  FROM stats) WHERE diff < 0.2*m AND diff < 0.35""",
)
def _(t):
    return rnd(w.repeated_frames(frame_stats(t.frames)), "diff")


@query(
    "contrast_transients",
    f"""WITH {STATS_SQL}, {med61("sd")},
low AS (SELECT video_id, idx, frame, idx - row_number() OVER (PARTITION BY video_id ORDER BY idx) AS g
        FROM med WHERE NOT pad AND v < 0.8*m)
SELECT video_id, min(frame) AS first, max(frame) AS last, count(*) AS n FROM low GROUP BY video_id, g HAVING count(*) <= 40""",
)
def _(t):
    return w.contrast_transients(frame_stats(t.frames), frac=0.8)


@query(
    "level_jumps",
    f"""WITH {STATS_SQL}, d AS (SELECT * REPLACE (coalesce(diff, 0.0) AS diff) FROM stats), {med61("diff", "d")}
SELECT video_id, frame, round(v,6) AS step, round(m,6) AS usual FROM med WHERE NOT pad AND v >= 4 AND v >= 2*greatest(m, 0.5)""",
)
def _(t):
    return rnd(w.level_jumps(frame_stats(t.frames), jump=4.0, times=2.0), "step", "usual")


@query(
    "change_spikes",
    f"""WITH {STATS_SQL}, d AS (SELECT * REPLACE (coalesce(diff, 0.0) AS diff) FROM stats), {med61("diff", "d")}
SELECT video_id, frame, round(v/greatest(m,0.5),6) AS times FROM med WHERE NOT pad AND v/greatest(m,0.5) >= 1.8""",
)
def _(t):
    return rnd(w.change_spikes(frame_stats(t.frames)), "times")


@query(
    "picture_steps",
    f"""WITH {STATS_SQL}, long AS (
  SELECT video_id, frame, idx, 'level' AS what, level AS v FROM stats UNION ALL SELECT video_id, frame, idx, 'sd', sd FROM stats),
dv AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY video_id, what ORDER BY idx)) AS dv FROM long),
sc AS (SELECT video_id, what, 1.4826*mad(dv) + 1e-6 AS s, max(idx) AS n FROM dv GROUP BY ALL),
win AS (SELECT *, median(v) OVER (PARTITION BY video_id, what ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS before,
               median(v) OVER (PARTITION BY video_id, what ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS after FROM long),
hit AS (SELECT win.*, abs(after-before) AS size FROM win JOIN sc USING (video_id, what)
        WHERE idx > 8 AND idx <= n - 7 AND abs(after-before) >= 0.5*s AND abs(after-before) >= (CASE WHEN what='level' THEN 1.0 ELSE 0.15*greatest(before,1.0) END)),
brk AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY video_id, what ORDER BY idx) <= 8 THEN 0 ELSE 1 END AS nw FROM hit),
isl AS (SELECT *, sum(nw) OVER (PARTITION BY video_id, what ORDER BY idx) AS g FROM brk),
top AS (SELECT *, row_number() OVER (PARTITION BY video_id, what, g ORDER BY size DESC, idx) AS r FROM isl)
SELECT video_id, what, frame, round(before,6) AS before, round(after,6) AS after FROM top WHERE r = 1""",
)
def _(t):
    return rnd(w.picture_steps(frame_stats(t.frames), k=0.5, level=1.0), "before", "after")


BOX_SQL = f"""{CURVES_SQL},
box AS (SELECT video_id, curve AS box, frame, value, row_number() OVER (PARTITION BY video_id, curve ORDER BY frame) AS idx FROM curves)"""


def boxes(t):
    return row_index(t.curves.withColumnRenamed("curve", "box"), ["video_id", "box"], "frame")


@query(
    "two_window_change",
    f"""WITH {BOX_SQL},
w AS (SELECT *, avg(value) OVER (PARTITION BY video_id, box ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS b,
             count(value) OVER (PARTITION BY video_id, box ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS nb,
             avg(value) OVER (PARTITION BY video_id, box ORDER BY idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS a,
             count(value) OVER (PARTITION BY video_id, box ORDER BY idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS na FROM box),
d AS (SELECT video_id, box, frame, idx, (a-b)*(a-b) AS d FROM w WHERE nb=6 AND na=6),
f1 AS (SELECT video_id, box, quantile_cont(d, 0.2) AS f, count(*) AS nd FROM d GROUP BY ALL),
q1 AS (SELECT video_id, box, f, nd, quantile_cont(ln(d+f+1e-6), 0.05) AS p5, quantile_cont(ln(d+f+1e-6), 0.2) AS p20, quantile_cont(ln(d+f+1e-6), 0.4) AS p40
       FROM d JOIN f1 USING (video_id, box) GROUP BY ALL),
z1 AS (SELECT d.*, nd, (ln(d+f+1e-6) - (p20 + 0.84*((p40-p5)/1.39+1e-6)))/((p40-p5)/1.39+1e-6) AS z1 FROM d JOIN q1 USING (video_id, box)),
nr AS (SELECT *, max(z1) OVER (PARTITION BY video_id, box ORDER BY idx RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS near FROM z1),
qt AS (SELECT * FROM nr WHERE near < 2.5),
f2 AS (SELECT video_id, box, quantile_cont(d, 0.2) AS f, count(*) AS nq FROM qt GROUP BY ALL),
q2 AS (SELECT video_id, box, f, nq, quantile_cont(ln(d+f+1e-6), 0.05) AS p5, quantile_cont(ln(d+f+1e-6), 0.2) AS p20, quantile_cont(ln(d+f+1e-6), 0.4) AS p40
       FROM qt JOIN f2 USING (video_id, box) GROUP BY ALL),
z2 AS (SELECT z1.video_id, z1.box, frame, idx, d, CASE WHEN nq >= 20 AND nq < nd THEN (ln(d+f+1e-6) - (p20 + 0.84*((p40-p5)/1.39+1e-6)))/((p40-p5)/1.39+1e-6) ELSE z1 END AS z
       FROM z1 LEFT JOIN q2 USING (video_id, box)),
pk AS (SELECT *, max(z) OVER (PARTITION BY video_id, box ORDER BY idx RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS top FROM z2)
SELECT video_id, box, frame, round(d,6) AS d, round(z,6) AS z FROM pk WHERE z >= 2.5 AND z = top""",
)
def _(t):
    return rnd(w.two_window_change(boxes(t), k=2.5), "d", "z")


CURVE_IDX = f"""{CURVES_SQL},
ci AS (SELECT *, row_number() OVER (PARTITION BY video_id, curve ORDER BY frame) AS idx, count(*) OVER (PARTITION BY video_id, curve) AS n FROM curves)"""


def curve_idx(t):
    return row_index(t.curves, ["video_id", "curve"], "frame")


def padded_curve(half: int) -> str:
    return f"""
ends AS (SELECT video_id, curve, arg_min(value, idx) AS a, arg_max(value, idx) AS b, max(idx) AS n FROM ci GROUP BY ALL),
pad AS (SELECT video_id, curve, idx, frame, value, false AS p FROM ci
  UNION ALL SELECT video_id, curve, 1 - s, NULL, a, true FROM ends, range(1,{half + 1}) r(s)
  UNION ALL SELECT video_id, curve, n + s, NULL, b, true FROM ends, range(1,{half + 1}) r(s))"""


@query(
    "deviation",
    f"""WITH {CURVE_IDX}, {padded_curve(7)},
tr AS (SELECT *, avg(value) OVER (PARTITION BY video_id, curve ORDER BY idx ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m FROM pad),
d AS (SELECT video_id, curve, frame, value/m - 1 AS d FROM tr WHERE NOT p)
SELECT video_id, curve, frame, round(d - avg(d) OVER (PARTITION BY video_id, curve), 6) AS dev FROM d""",
)
def _(t):
    return rnd(w.deviation(curve_idx(t), FPS), "dev").select("video_id", "curve", "frame", "dev")


@query(
    "lost_frames",
    f"""WITH {CURVE_IDX}, {padded_curve(30)},
q AS (SELECT *, quantile_cont(value, 0.75) OVER (PARTITION BY video_id, curve ORDER BY idx ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS q FROM pad)
SELECT video_id, curve, frame, value <= 0 OR value < 0.25*q AS lost FROM q WHERE NOT p""",
)
def _(t):
    return w.lost_frames(curve_idx(t), FPS).select("video_id", "curve", "frame", "lost")


@query(
    "fill_gaps",
    f"""WITH {TRACK_SQL}, nx AS (
  SELECT *, lead(frame) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM track WINDOW w AS (PARTITION BY video_id, object_id ORDER BY frame))
SELECT video_id, object_id, frame + s AS frame, round(CASE WHEN s=0 THEN x ELSE x + (nx-x)*s/(nf-frame) END, 6) AS x,
       round(CASE WHEN s=0 THEN y ELSE y + (ny-y)*s/(nf-frame) END, 6) AS y, s > 0 AS filled
FROM (SELECT *, unnest(range(0, coalesce(nf, frame+1) - frame)) AS s FROM nx)""",
)
def _(t):
    return rnd(w.fill_gaps(t.track, ["x", "y"], ["video_id", "object_id"]), "x", "y")


@query(
    "smooth_track",
    f"""WITH {TRACK_SQL}, nx AS (
  SELECT *, lead(frame) OVER w AS nf, lead(x) OVER w AS nx FROM track WINDOW w AS (PARTITION BY video_id, object_id ORDER BY frame)),
f AS (SELECT video_id, object_id, frame + s AS frame, CASE WHEN s=0 THEN x ELSE x + (nx-x)*s/(nf-frame) END AS x
      FROM (SELECT *, unnest(range(0, coalesce(nf, frame+1) - frame)) AS s FROM nx)),
e AS (SELECT video_id, object_id, min(frame) AS a, max(frame) AS b, arg_min(x, frame) AS xa, arg_max(x, frame) AS xb FROM f GROUP BY ALL),
p AS (SELECT *, false AS pad FROM f UNION ALL SELECT video_id, object_id, a - s, xa, true FROM e, range(1,3) r(s)
      UNION ALL SELECT video_id, object_id, b + s, xb, true FROM e, range(1,3) r(s))
SELECT video_id, object_id, frame, round(m,6) AS x FROM (
  SELECT *, avg(x) OVER (PARTITION BY video_id, object_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM p) WHERE NOT pad""",
)
def _(t):
    return rnd(w.smooth(t.track, ["x"], ["video_id", "object_id"]), "x")


@query(
    "unwrap_angle",
    f"""WITH {TRACK_SQL}, p AS (SELECT *, lag(y*3.6) OVER (PARTITION BY video_id, object_id ORDER BY frame) AS pv, y*3.6 AS theta FROM track)
SELECT video_id, object_id, frame, round(theta + sum(coalesce(-360*round_even((theta-pv)/360, 0), 0)) OVER (PARTITION BY video_id, object_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 6) AS unwrapped FROM p""",
)
def _(t):
    d = t.track.withColumn("theta", F.col("y") * 3.6)
    d = w.unwrap_angle(d, ["video_id", "object_id"], "frame", "theta")
    return rnd(d.select("video_id", "object_id", "frame", "unwrapped"), "unwrapped")


@query(
    "windowed_mean_velocity",
    f"""WITH {FRAMES_SQL}, v AS (
  SELECT video_id, frame, avg(level/5) OVER w AS v_level, avg(sd/5) OVER w AS v_sd, count(level) OVER w AS n FROM frames
  WINDOW w AS (PARTITION BY video_id ORDER BY frame RANGE BETWEEN 17 PRECEDING AND 12 FOLLOWING))
SELECT video_id, frame, round(v_level,6) AS v_level, round(v_sd,6) AS v_sd, n FROM v WHERE n >= 24""",
)
def _(t):
    return rnd(w.windowed_mean_velocity(t.frames, 5, cols=("level", "sd")), "v_level", "v_sd")


@query(
    "repeated_median_line",
    f"""WITH {TRACK_SQL}, pr AS (
  SELECT a.video_id, a.object_id, a.frame AS f0, p.frame AS pf, p.y AS py, q.frame AS qf, q.y AS qy
  FROM track a JOIN track p ON a.object_id=p.object_id AND p.frame BETWEEN a.frame-45 AND a.frame+45
               JOIN track q ON a.object_id=q.object_id AND q.frame BETWEEN a.frame-45 AND a.frame+45 AND q.frame<>p.frame),
s1 AS (SELECT video_id, object_id, f0, pf, median((qy-py)/(qf-pf)) AS s FROM pr GROUP BY ALL),
s2 AS (SELECT video_id, object_id, f0, median(s) AS slope FROM s1 GROUP BY ALL),
ic AS (SELECT s2.video_id, s2.object_id, f0, slope, median(p.y - slope*p.frame) AS i FROM s2 JOIN track p ON s2.object_id=p.object_id AND p.frame BETWEEN f0-45 AND f0+45 GROUP BY ALL)
SELECT t.video_id, t.object_id, t.frame, round(slope,6) AS slope, round(t.y - (slope*t.frame + i), 6) AS miss,
       coalesce(abs(t.y - (slope*t.frame + i)) <= 3.5, true) AS kept
FROM track t LEFT JOIN ic ON t.object_id=ic.object_id AND t.frame=ic.f0""",
)
def _(t):
    d = w.repeated_median_line(t.track, ["video_id", "object_id"], "frame", "y")
    return rnd(d.select("video_id", "object_id", "frame", "slope", "miss", "kept"), "slope", "miss")


@query(
    "islands",
    f"""WITH {TRACK_SQL}, b AS (SELECT *, CASE WHEN frame - lag(frame) OVER w <= 16 THEN 0 ELSE 1 END AS nw FROM track WINDOW w AS (PARTITION BY video_id, object_id ORDER BY frame)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY video_id, object_id ORDER BY frame) AS g FROM b)
SELECT video_id, object_id, min(frame) AS first, max(frame) AS last, count(*) AS n FROM g GROUP BY video_id, object_id, g""",
)
def _(t):
    return w.stretches(t.track, ["video_id", "object_id"], 15)


# orders of a customer as intervals: from the order's day for as many days as its price in ten-thousands
IV_SQL = """
iv AS (SELECT o_custkey AS video_id, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT) AS first,
              CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT) + CAST(floor(o_totalprice/10000) AS BIGINT) AS last FROM orders)"""


def order_intervals(t):
    d = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
    return t.orders.select(
        F.col("o_custkey").alias("video_id"), d.alias("first"), (d + F.floor(F.col("o_totalprice") / 10000)).alias("last")
    )


MERGE_SQL = """
mg AS (SELECT *, CASE WHEN first - max(last) OVER (PARTITION BY video_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS nw FROM iv),
m2 AS (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS g FROM mg),
merged AS (SELECT video_id, min(first) AS first, max(last) AS last, count(*) AS n FROM m2 GROUP BY video_id, g)"""


@query("merge_intervals", f"WITH {IV_SQL}, {MERGE_SQL} SELECT * FROM merged")
def _(t):
    return w.merge_intervals(order_intervals(t), ["video_id"])


@query(
    "cut_intervals",
    f"""WITH {IV_SQL}, {MERGE_SQL},
win AS (SELECT DISTINCT o_custkey AS video_id, 365*y AS first, 365*y + 364 AS last FROM orders, range(0,7) r(y)),
gap AS (SELECT win.video_id, win.first AS w0, win.last AS w1, m.first AS g0, m.last AS g1 FROM win LEFT JOIN merged m
        ON win.video_id=m.video_id AND m.last > win.first AND m.first < win.last),
pc AS (
  SELECT video_id, w0 AS a, coalesce(min(g0), w1) AS b FROM gap GROUP BY video_id, w0, w1
  UNION SELECT video_id, g1, coalesce(lead(g0) OVER (PARTITION BY video_id, w0, w1 ORDER BY g0), w1) FROM gap WHERE g0 IS NOT NULL)
SELECT DISTINCT video_id, a AS first, b AS last FROM pc WHERE b - a >= 10""",
)
def _(t):
    years = t.orders.select(F.col("o_custkey").alias("video_id")).distinct().select(
        "video_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("y")
    )
    win = years.select("video_id", (F.col("y") * 365).cast("long").alias("first"), (F.col("y") * 365 + 364).cast("long").alias("last"))
    return w.cut_intervals(win, order_intervals(t), ["video_id"], shortest=10)


@query(
    "zoom_states",
    f"""WITH {STATS_SQL}, b AS (SELECT video_id, frame FROM stats WHERE diff >= 6),
e AS (SELECT video_id, min(frame) AS n0, max(frame) AS n1 FROM stats GROUP BY ALL),
s AS (SELECT video_id, n0 AS first FROM e UNION ALL SELECT video_id, frame + 1 FROM b),
x AS (SELECT *, lead(first) OVER (PARTITION BY video_id ORDER BY first) - 2 AS nx FROM s)
SELECT video_id, first, last, row_number() OVER (PARTITION BY video_id ORDER BY first) AS state FROM (
  SELECT video_id, first, coalesce(nx, n1) AS last FROM x JOIN e USING (video_id)) WHERE last >= first""",
)
def _(t):
    st = frame_stats(t.frames)
    b = st.where("diff >= 6").select("video_id", F.col("frame").alias("first"), F.col("frame").alias("last"), F.lit(True).alias("is_step"))
    return w.zoom_states(b, st)


@query(
    "scene_path",
    f"""WITH {FRAMES_SQL}, st AS (SELECT video_id, frame + s AS m, level/3 AS vx, sd/3 AS vy FROM frames, range(0,3) r(s)),
a AS (SELECT video_id, m, avg(vx) AS vx, avg(vy) AS vy FROM st GROUP BY ALL HAVING count(*) >= 2),
nx AS (SELECT *, lead(m) OVER w AS nm, lead(vx) OVER w AS nvx, lead(vy) OVER w AS nvy FROM a WINDOW w AS (PARTITION BY video_id ORDER BY m)),
f AS (SELECT video_id, m + s AS m, CASE WHEN s=0 THEN vx ELSE vx + s*(nvx-vx)/g END AS vx, CASE WHEN s=0 THEN vy ELSE vy + s*(nvy-vy)/g END AS vy, s > 0 AS bridged
      FROM (SELECT *, nm - m AS g, unnest(range(0, CASE WHEN coalesce(nm - m - 1, 0) <= 6 THEN coalesce(nm - m, 1) ELSE 1 END)) AS s FROM nx)),
b AS (SELECT *, CASE WHEN m - lag(m) OVER (PARTITION BY video_id ORDER BY m) <= 1 THEN 0 ELSE 1 END AS nw FROM f),
g AS (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY m) AS stretch FROM b)
SELECT video_id, stretch, m + 1 AS frame, round(sum(vx) OVER w, 5) AS x, round(sum(vy) OVER w, 5) AS y, bridged FROM g
WINDOW w AS (PARTITION BY video_id, stretch ORDER BY m ROWS UNBOUNDED PRECEDING)""",
)
def _(t):
    p = t.frames.select("video_id", "frame", F.col("level").alias("dx"), F.col("sd").alias("dy"))
    return rnd(w.scene_path(p, 3), "x", "y", n=5)


@query(
    "flash_runs",
    f"""WITH {CURVE_IDX}, {padded_curve(30)},
m AS (SELECT *, value - median(value) OVER (PARTITION BY video_id, curve ORDER BY idx ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS r FROM pad),
s AS (SELECT video_id, curve, 1.4826*mad(r) AS s, stddev_pop(r) AS sd, max(idx) AS n FROM m WHERE NOT p GROUP BY ALL),
z AS (SELECT m.*, n, r/(CASE WHEN s > 1e-9 THEN s ELSE sd END) AS z FROM m JOIN s USING (video_id, curve) WHERE NOT p AND (s > 1e-9 OR sd > 1e-9)),
h AS (SELECT *, idx - row_number() OVER (PARTITION BY video_id, curve ORDER BY idx) AS g FROM z WHERE z > 1.2),
r AS (SELECT video_id, curve, min(idx) AS first, max(idx) AS last, max(z) AS height, sum(r) AS w, sum(idx*r) AS wi FROM h GROUP BY video_id, curve, g, n
      HAVING max(z) > 1.8 AND min(idx) > 12 AND max(idx) <= n - 12),
b AS (SELECT *, CASE WHEN first - lag(last) OVER (PARTITION BY video_id, curve ORDER BY first) - 1 < 4.5 THEN 0 ELSE 1 END AS nw FROM r),
g AS (SELECT *, sum(nw) OVER (PARTITION BY video_id, curve ORDER BY first) AS k FROM b)
SELECT video_id, curve, min(first) AS first, max(last) AS last, round(sum(wi)/sum(w), 6) AS centroid, round(max(height), 6) AS height FROM g GROUP BY video_id, curve, k""",
)
def _(t):
    return rnd(w.flash_runs(curve_idx(t), FPS, lo=1.2, hi=1.8), "centroid", "height")


@query(
    "cumulative_gap_hold",
    f"""WITH {STATS_SQL}, h AS (SELECT video_id, idx, sum(CASE WHEN diff < 1 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY idx) AS h FROM stats),
s AS (SELECT video_id, a/100.0 AS slope, max(h - a/100.0*idx) - min(h - a/100.0*idx) AS width FROM h, range(0,101,5) r(a) GROUP BY ALL)
SELECT video_id, arg_min(slope, width*1000 + slope) AS slope, round(min(width), 6) AS width FROM s GROUP BY video_id""",
)
def _(t):
    st = frame_stats(t.frames).withColumn("held", F.coalesce(F.col("diff") < 1, F.lit(False)))
    return rnd(w.cumulative_gap_hold(st, [i / 100 for i in range(0, 101, 5)]), "width")
