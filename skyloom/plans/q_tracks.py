"""Queries over tracks and joins in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import series_joins as sj
from skyloom.operators import tracks as tr
from skyloom.operators import windows as w
from skyloom.plans.corpus import frame_stats, FRAMES_SQL, own_scene, own_scene_sql, scene_of, STATS_SQL, TRACK_SQL
from skyloom.plans.q_windows import IV_SQL, order_intervals, rnd
from skyloom.plans.registry import query

VIDEO_SQL = """
video AS (SELECT DISTINCT CAST(floor(user_id/10) AS BIGINT) AS video_id,
          CASE CAST(floor(user_id/10) AS BIGINT) % 3 WHEN 0 THEN 30000 WHEN 1 THEN 30 ELSE 25 END AS fps_num,
          CASE CAST(floor(user_id/10) AS BIGINT) % 3 WHEN 0 THEN 1001 ELSE 1 END AS fps_den FROM events)"""
TIMED_SQL = TRACK_SQL + "," + VIDEO_SQL + """,
timed AS (SELECT video_id, object_id, frame, x, y, (frame-1)*fps_den/fps_num AS t_s FROM track JOIN video USING (video_id))"""


def video(t):
    v = F.floor(F.col("user_id") / 10)
    return t.events.select(v.alias("video_id")).distinct().select(
        "video_id",
        F.when(F.col("video_id") % 3 == 0, 30000).when(F.col("video_id") % 3 == 1, 30).otherwise(25).alias("fps_num"),
        F.when(F.col("video_id") % 3 == 0, 1001).otherwise(1).alias("fps_den"),
    )


def timed(t):
    return tr.add_time(t.track, video(t))


@query("add_time", f"WITH {TIMED_SQL} SELECT video_id, object_id, frame, round(t_s, 9) AS t_s FROM timed")
def _(t):
    return rnd(timed(t).select("video_id", "object_id", "frame", "t_s"), "t_s", n=9)


def _round_sql(i: int) -> str:
    return f"""
l{i} AS MATERIALIZED (SELECT object_id, regr_slope(x,t_s) AS vx, regr_intercept(x,t_s) AS x0, regr_slope(y,t_s) AS vy, regr_intercept(y,t_s) AS y0 FROM k{i} GROUP BY ALL HAVING count(*) >= 3),
r{i} AS MATERIALIZED (SELECT k.*, x-(vx*t_s+x0) AS rx, y-(vy*t_s+y0) AS ry FROM k{i} k JOIN l{i} USING (object_id)),
m{i} AS MATERIALIZED (SELECT object_id, median(rx) AS mx, median(ry) AS my, mad(rx) AS sx, mad(ry) AS sy FROM r{i} GROUP BY ALL),
k{i + 1} AS MATERIALIZED (SELECT video_id, object_id, frame, x, y, t_s FROM r{i} JOIN m{i} USING (object_id)
  WHERE abs(rx-mx) < greatest(4.0*1.4826*sx, 2.0) AND abs(ry-my) < greatest(4.0*1.4826*sy, 2.0))"""


@query(
    "fit_rate",
    f"""WITH {TIMED_SQL}, k0 AS MATERIALIZED (SELECT * FROM timed WHERE x IS NOT NULL AND y IS NOT NULL),
{",".join(_round_sql(i) for i in range(4))},
f AS (SELECT video_id, object_id, regr_slope(x,t_s) AS vx, regr_intercept(x,t_s) AS x0, regr_slope(y,t_s) AS vy, regr_intercept(y,t_s) AS y0, count(*) AS n,
      min(t_s) AS t0, max(t_s) AS t1, sqrt(pow(arg_max(x,frame)-arg_min(x,frame),2)+pow(arg_max(y,frame)-arg_min(y,frame),2)) AS span FROM k4 GROUP BY ALL HAVING count(*) >= 3),
e AS (SELECT object_id, sqrt(avg(pow(x-(vx*t_s+x0),2)+pow(y-(vy*t_s+y0),2))) AS resid FROM k4 JOIN f USING (object_id) GROUP BY ALL),
c AS (SELECT object_id, count(*) AS n_in FROM k0 GROUP BY ALL),
d AS (SELECT a.object_id, unnest([a.x-2*b.x+c.x, a.y-2*b.y+c.y]) AS d2 FROM k4 a JOIN k4 b ON a.object_id=b.object_id AND b.frame=a.frame-1 JOIN k4 c ON a.object_id=c.object_id AND c.frame=a.frame-2),
z AS (SELECT object_id, 1.4826*mad(d2)/sqrt(6.0) AS noise FROM d GROUP BY ALL HAVING count(*) >= 6),
j AS (SELECT f.*, n_in, resid, noise, coalesce(span < 5.0 AND resid <= greatest(2*sqrt(2.0)*noise, 0.1), false) AS held FROM f JOIN e USING (object_id) JOIN c USING (object_id) LEFT JOIN z USING (object_id))
SELECT video_id, object_id, round(sqrt(vx*vx+vy*vy),5) AS v_px, round(vx,5) AS vx, round(vy,5) AS vy, round(((degrees(atan2(vx,-vy))%360)+360)%360,3) AS direction_deg,
  round(resid,5) AS resid_rms, n, n_in, n_in-n AS n_clipped, round(t0,6) AS t0, round(t1,6) AS t1, round(span,5) AS span_px, round(CASE WHEN span>0 THEN resid/span END,4) AS resid_frac,
  round(noise,5) AS noise_px, held, coalesce(CASE WHEN span>0 THEN resid/span END < 0.05, false) OR held AS uniform FROM j""",
)
def _(t):
    d = rnd(tr.fit_rate(timed(t)), "v_px", "vx", "vy", "resid_rms", "span_px", "noise_px", n=5)
    return rnd(rnd(rnd(d, "t0", "t1"), "direction_deg", n=3), "resid_frac", n=4)


PAIR_SQL = """
pr AS (SELECT a.video_id, a.object_id AS a, b.object_id AS b, sum(CASE WHEN pow(a.x-b.x,2)+pow(a.y-b.y,2) <= 900 THEN 1 ELSE 0 END) AS "on", count(*) AS shared
       FROM track a JOIN track b ON a.video_id=b.video_id AND a.frame=b.frame AND a.object_id<b.object_id GROUP BY ALL)"""


@query("track_pairs", f"""WITH {TRACK_SQL}, {PAIR_SQL} SELECT * FROM pr WHERE "on" >= 3 AND "on" >= 0.5*shared""")
def _(t):
    return tr.track_pairs(t.track, 30.0, 3)


@query(
    "same_track",
    f"""WITH RECURSIVE {TRACK_SQL}, {PAIR_SQL},
e AS (SELECT * FROM pr WHERE "on" >= 3 AND "on" >= 0.4*shared),
v AS (SELECT video_id, object_id, row_number() OVER (PARTITION BY video_id ORDER BY object_id) AS i FROM (SELECT DISTINCT video_id, object_id FROM track)),
fold AS (
  SELECT video_id, CAST(1 AS BIGINT) AS i, [object_id] AS kept FROM v WHERE i = 1
  UNION ALL
  SELECT f.video_id, v.i, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.video_id=v.video_id AND e.b=v.object_id AND list_contains(f.kept, e.a)) THEN f.kept ELSE list_append(f.kept, v.object_id) END
  FROM fold f JOIN v ON v.video_id=f.video_id AND v.i=f.i+1),
k AS (SELECT video_id, arg_max(kept, i) AS kept FROM fold GROUP BY ALL)
SELECT video_id, object_id, same_as, "on", shared FROM (
  SELECT e.video_id, e.b AS object_id, e.a AS same_as, "on", shared, row_number() OVER (PARTITION BY e.video_id, e.b ORDER BY "on" DESC, e.a) AS r
  FROM e JOIN k USING (video_id) WHERE list_contains(kept, e.a) AND NOT list_contains(kept, e.b)) WHERE r = 1""",
)
def _(t):
    pairs = tr.track_pairs(t.track, 30.0, 3, 0.4)
    prio = t.track.select("video_id", F.col("object_id").alias("id"), F.col("object_id").alias("prio")).distinct()
    return tr.same_track_from(pairs, prio)


# planted paths: the odd objects of a video are truth, the even ones rows found, ranked by id
@query(
    "on_path",
    f"""WITH {TRACK_SQL}, j AS (
  SELECT f.video_id, f.object_id AS row_id, p.object_id AS truth_id, sqrt(pow(f.x-p.x,2)+pow(f.y-p.y,2)) AS d
  FROM track f JOIN track p ON f.video_id=p.video_id AND f.frame=p.frame WHERE f.object_id%2=0 AND p.object_id%2=1)
SELECT video_id, row_id, truth_id, count(*) AS shared, round(avg(CASE WHEN d <= 40 THEN 1.0 ELSE 0.0 END),6) AS within, round(median(d),6) AS px
FROM j GROUP BY ALL HAVING count(*) >= 2 AND avg(CASE WHEN d <= 40 THEN 1.0 ELSE 0.0 END) > 0.4""",
)
def _(t):
    f = t.track.where("object_id % 2 = 0").withColumnRenamed("object_id", "row_id").withColumn("size_px", F.lit(3.0))
    p = t.track.where("object_id % 2 = 1").withColumnRenamed("object_id", "truth_id")
    return rnd(tr.on_path(f, p, 40.0, 0.4), "within", "px")


@query(
    "recovered",
    f"""WITH {TRACK_SQL}, j AS (
  SELECT f.video_id, f.object_id AS row_id, p.object_id AS truth_id, sqrt(pow(f.x-p.x,2)+pow(f.y-p.y,2)) AS d
  FROM track f JOIN track p ON f.video_id=p.video_id AND f.frame=p.frame WHERE f.object_id%2=0 AND p.object_id%2=1),
o AS (SELECT video_id, row_id, truth_id, count(*) AS shared, median(d) AS px, row_id%10/2+1 AS rank FROM j GROUP BY ALL HAVING count(*) >= 2 AND avg(CASE WHEN d <= 40 THEN 1.0 ELSE 0.0 END) > 0.4),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id, truth_id ORDER BY rank) AS r FROM o),
tk AS (SELECT DISTINCT video_id, rank FROM o),
pl AS (SELECT DISTINCT video_id, object_id AS truth_id FROM track WHERE object_id%2=1)
SELECT pl.video_id, pl.truth_id, b.row_id IS NOT NULL AS found, CAST(b.rank AS BIGINT) AS rank, shared, round(px,6) AS px,
  CAST(b.rank - (SELECT count(*) FROM tk WHERE tk.video_id=b.video_id AND tk.rank < b.rank) AS BIGINT) AS rank_alone
FROM pl LEFT JOIN b ON pl.video_id=b.video_id AND pl.truth_id=b.truth_id AND r=1""",
)
def _(t):
    f = t.track.where("object_id % 2 = 0").withColumnRenamed("object_id", "row_id").withColumn("size_px", F.lit(3.0))
    p = t.track.where("object_id % 2 = 1").withColumnRenamed("object_id", "truth_id")
    pairs = tr.on_path(f, p, 40.0, 0.4)
    ranks = f.select("video_id", "row_id").distinct().withColumn("rank", (F.col("row_id") % 10 / 2 + 1).cast("long"))
    return rnd(tr.recovered(pairs, p.select("video_id", "truth_id").distinct(), ranks), "px")


def _boxes(t):
    return t.track.where("object_id % 2 = 1").select(
        "video_id", F.col("object_id").alias("truth_id"), "frame", F.col("x").alias("bx"), F.col("y").alias("by"),
        F.lit(25.0).alias("hw"), F.lit(25.0).alias("hh"))


TRUTH_SQL = f"""WITH {TRACK_SQL}, p AS (
  SELECT f.video_id, f.object_id, p.object_id AS truth_id, sum(CASE WHEN abs(f.x-p.x) <= 27 AND abs(f.y-p.y) <= 27 THEN 1 ELSE 0 END) AS "on", count(*) AS shared
  FROM track f JOIN track p ON f.video_id=p.video_id AND f.frame=p.frame WHERE f.object_id%2=0 AND p.object_id%2=1 GROUP BY ALL
  HAVING "on" >= 2 AND 4*"on" >= shared)"""


@query("truth_pairs", TRUTH_SQL.replace('4*"on"', '2*"on"') + " SELECT * FROM p")
def _(t):
    return tr.truth_pairs(t.track.where("object_id % 2 = 0"), _boxes(t), frames=2)


@query(
    "match_truth",
    TRUTH_SQL.replace('4*"on"', '2*"on"')
    + """, g AS (SELECT video_id, list([{'o': object_id, 't': truth_id, 'n': "on", 's': shared}] ORDER BY "on" DESC, object_id, truth_id) AS l FROM p GROUP BY ALL),
r AS (SELECT video_id, unnest(list_reduce(l, lambda a, b: CASE WHEN list_contains(list_transform(a, lambda m: m.o), b[1].o) OR list_contains(list_transform(a, lambda m: m.t), b[1].t) THEN a ELSE list_concat(a, b) END)) AS m FROM g)
SELECT video_id, m.o AS object_id, m.t AS truth_id, m.n AS "on", m.s AS shared FROM r""",
)
def _(t):
    return tr.match_truth(tr.truth_pairs(t.track.where("object_id % 2 = 0"), _boxes(t), frames=2))


@query(
    "fixed_on_sensor",
    f"""WITH {TRACK_SQL}, s AS (SELECT object_id % 5 AS video_id, frame, floor(x/10) AS x, floor(y/10) AS y FROM track),
nf AS (SELECT video_id, count(DISTINCT frame) AS nf FROM s GROUP BY ALL),
p AS (SELECT DISTINCT video_id, x, y FROM s),
n AS (SELECT p.video_id, p.x, p.y, count(DISTINCT s.frame) AS frames FROM p JOIN s ON p.video_id=s.video_id AND abs(p.x-s.x) <= 1 AND abs(p.y-s.y) <= 1 AND sqrt(pow(p.x-s.x,2)+pow(p.y-s.y,2)) <= 1 GROUP BY ALL)
SELECT n.video_id, x, y, frames FROM n JOIN nf USING (video_id) WHERE frames >= 2 AND frames >= 0.1*nf""",
)
def _(t):
    s = t.track.select((F.col("object_id") % 5).alias("video_id"), "frame", F.floor(F.col("x") / 10).cast("double").alias("x"), F.floor(F.col("y") / 10).cast("double").alias("y"))
    return tr.fixed_on_sensor(s, 1.0, 0.1)


@query(
    "stays_put",
    f"""WITH {TRACK_SQL}, s AS (SELECT DISTINCT video_id, frame, CAST(floor(x/20) AS BIGINT) AS cx, CAST(floor(y/20) AS BIGINT) AS cy FROM track),
nf AS (SELECT video_id, count(DISTINCT frame) AS nf FROM s GROUP BY ALL),
c AS (SELECT video_id, cx+i AS cx, cy+j AS cy, count(DISTINCT frame) AS frames FROM s, range(-1,2) a(i), range(-1,2) b(j) GROUP BY ALL)
SELECT video_id, cx, cy, frames FROM c JOIN nf USING (video_id) WHERE frames >= greatest(5.0, 0.3*nf)""",
)
def _(t):
    return tr.stays_put(t.track, 20.0, 5, 0.3)


@query(
    "pairwise_members",
    f"""WITH {TIMED_SQL}, j AS (SELECT a.video_id, a.object_id, b.object_id AS object_2, a.t_s, b.x-a.x AS dx, b.y-a.y AS dy
  FROM timed a JOIN timed b ON a.video_id=b.video_id AND a.frame=b.frame AND a.object_id<b.object_id)
SELECT video_id, object_id, object_2, count(*) AS n, round(avg(sqrt(dx*dx+dy*dy)),6) AS mean_px, round(min(sqrt(dx*dx+dy*dy)),6) AS min_px, round(max(sqrt(dx*dx+dy*dy)),6) AS max_px,
  round(sqrt(var_pop(dx)*(1-pow(corr(dx,t_s),2)) + var_pop(dy)*(1-pow(corr(dy,t_s),2))),5) AS wander_px FROM j GROUP BY ALL HAVING count(*) >= 5""",
)
def _(t):
    return rnd(rnd(tr.pairwise_members(timed(t), 5), "mean_px", "min_px", "max_px"), "wander_px", n=5)


@query(
    "common_frames_velocity",
    f"""WITH {TIMED_SQL}, j AS (SELECT a.video_id, a.object_id, a.t_s, a.x-m.x AS dx, a.y-m.y AS dy FROM timed a JOIN timed m ON a.video_id=m.video_id AND a.frame=m.frame WHERE m.object_id%10=0 AND a.object_id%10<>0),
g AS (SELECT video_id, object_id, count(*) AS n, regr_slope(dx,t_s) AS vx, regr_slope(dy,t_s) AS vy FROM j GROUP BY ALL HAVING count(*) >= 5)
SELECT video_id, object_id, n, round(vx,5) AS vx, round(vy,5) AS vy, round(sqrt(vx*vx+vy*vy),5) AS v FROM g""",
)
def _(t):
    d = timed(t)
    return rnd(tr.common_frames_velocity(d, d.where("object_id % 10 = 0"), 5), "vx", "vy", "v", n=5)


@query(
    "with_group",
    f"""WITH {TRACK_SQL}, {FRAMES_SQL}, {own_scene_sql("sc0", "SELECT DISTINCT video_id FROM track")}, {own_scene_sql("sc1", "SELECT DISTINCT video_id FROM track", 1)}, tk AS (SELECT video_id, frame, level AS x, sd AS y FROM sc0), bg AS (SELECT video_id, frame, level AS x, sd AS y FROM sc1),
j AS (SELECT p.object_id, p.video_id, p.frame, p.x, p.y, t.x AS tx, t.y AS ty, b.x AS bx, b.y AS "by" FROM track p JOIN tk t USING (video_id, frame) JOIN bg b USING (video_id, frame)),
s AS (SELECT a.video_id, a.object_id, sqrt(pow((a.x-a.tx)-(b.x-b.tx),2)+pow((a.y-a.ty)-(b.y-b.ty),2)) AS dt, sqrt(pow((a.x-a.bx)-(b.x-b.bx),2)+pow((a.y-a."by")-(b.y-b."by"),2)) AS db
      FROM j a JOIN j b ON a.object_id=b.object_id AND b.frame=a.frame-1)
SELECT video_id, object_id, round(sum(dt),5) AS to_track, round(sum(db),5) AS to_background, count(*) AS steps, sum(dt)<sum(db) AS with_track FROM s GROUP BY ALL""",
)
def _(t):
    one = lambda shift: own_scene(t.frames, t.track, shift).select("video_id", "frame", F.col("level").alias("x"), F.col("sd").alias("y"))
    return rnd(tr.with_group(t.track, one(0), one(1)), "to_track", "to_background", n=5)


@query(
    "relative_to_scene",
    f"""WITH {TRACK_SQL}, {FRAMES_SQL}, {own_scene_sql("sc", "SELECT DISTINCT video_id FROM track")} SELECT t.video_id, object_id, t.frame, round(t.x-f.level,6) AS x, round(t.y-f.sd,6) AS y FROM track t JOIN sc f ON f.video_id=t.video_id AND f.frame=t.frame""",
)
def _(t):
    s = own_scene(t.frames, t.track).select("video_id", "frame", F.col("level").alias("x"), F.col("sd").alias("y"))
    return rnd(tr.relative_to_scene(t.track, s), "x", "y")


@query(
    "second_difference_jitter",
    f"""WITH {STATS_SQL}, l AS (SELECT video_id, frame, 'x' AS axis, level AS v FROM stats UNION ALL SELECT video_id, frame, 'y', sd FROM stats),
d AS (SELECT a.video_id, a.axis, a.frame, a.v-2*b.v+c.v AS d2 FROM l a JOIN l b ON a.video_id=b.video_id AND a.axis=b.axis AND b.frame=a.frame-1 JOIN l c ON a.video_id=c.video_id AND a.axis=c.axis AND c.frame=a.frame-2),
m AS (SELECT video_id, axis, frame, d2 - avg(d2) OVER (PARTITION BY video_id, axis) AS d FROM d),
g AS (SELECT m.video_id, m.axis, count(*) AS n, avg(m.d*m.d) AS g0, avg(m.d*m1.d) AS g1, avg(m.d*m2.d) AS g2, avg(m.d*m3.d) AS g3, avg(m.d*m4.d) AS g4 FROM m
  LEFT JOIN m m1 ON m.video_id=m1.video_id AND m.axis=m1.axis AND m1.frame=m.frame-1 LEFT JOIN m m2 ON m.video_id=m2.video_id AND m.axis=m2.axis AND m2.frame=m.frame-2
  LEFT JOIN m m3 ON m.video_id=m3.video_id AND m.axis=m3.axis AND m3.frame=m.frame-3 LEFT JOIN m m4 ON m.video_id=m4.video_id AND m.axis=m4.axis AND m4.frame=m.frame-4 GROUP BY ALL)
SELECT video_id, axis, n, round(-g1/4,5) AS jitter_var, round(g1/g0,5) AS rho1, round(sqrt(greatest(g0-g1,g0-g2,g0-g3,g0-g4,0)/10),5) AS jitter FROM g""",
)
def _(t):
    p = t.frames.select("video_id", "frame", F.col("level").alias("x"), F.col("sd").alias("y"))
    return rnd(tr.second_difference_jitter(p, ["video_id"]), "jitter_var", "rho1", "jitter", n=5)


@query(
    "video_windows",
    f"""WITH {TRACK_SQL}, v AS (SELECT video_id, max(frame)*3 AS n FROM track GROUP BY ALL),
s AS (SELECT video_id, n, unnest(range(1, greatest(2, n-30), 370)) AS first FROM v),
x AS (SELECT video_id, n, first FROM s UNION ALL SELECT video_id, n, greatest(1, n-399) FROM s GROUP BY ALL HAVING max(first)+399 < n)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY first) - 1 AS win, first, least(first+399, n) AS last FROM x""",
)
def _(t):
    v = t.track.groupBy("video_id").agg((F.max("frame") * 3).alias("n_frames"))
    return tr.video_windows(v)


@query(
    "top_per_window",
    """SELECT video_id, win, event_id, score, rank FROM (SELECT user_id AS video_id, CAST(floor(epoch(ts)/86400) AS BIGINT) AS win, event_id, value AS score,
  row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts)/86400) AS BIGINT) ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3""",
)
def _(t):
    d = t.events.select(F.col("user_id").alias("video_id"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).alias("win"), "event_id", F.col("value").alias("score"))
    return tr.top_n(d, ["video_id", "win"], 3, [F.col("score").desc(), F.col("event_id")], F.col("event_id"))


@query(
    "top_per_video",
    """SELECT video_id, event_id, score, rank FROM (SELECT user_id % 7 AS video_id, event_id, value AS score,
  row_number() OVER (PARTITION BY user_id % 7 ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 12""",
)
def _(t):
    d = t.events.select((F.col("user_id") % 7).alias("video_id"), "event_id", F.col("value").alias("score"))
    return tr.top_n(d, ["video_id"], 12, [F.col("score").desc(), F.col("event_id")], F.col("event_id"))


@query(
    "shortlist",
    """SELECT video_id, event_id, score, rank FROM (SELECT user_id AS video_id, event_id, value AS score, max(value) OVER (PARTITION BY user_id) AS b,
  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 8 AND (rank <= 3 OR score >= 0.8*b)""",
)
def _(t):
    d = t.events.select(F.col("user_id").alias("video_id"), "event_id", F.col("value").alias("score"))
    return tr.shortlist(d, "score", "event_id", share_=0.8)


@query(
    "peaks_per_frame",
    """SELECT frame, polarity, event_id, response, rank FROM (SELECT CAST(floor(epoch(ts)/3600) AS BIGINT) AS frame, event_type='error' AS polarity, event_id, value AS response,
  row_number() OVER (PARTITION BY CAST(floor(epoch(ts)/3600) AS BIGINT), event_type='error' ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 10""",
)
def _(t):
    d = t.events.select(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("frame"), (F.col("event_type") == "error").alias("polarity"), "event_id", F.col("value").alias("response"))
    return tr.top_n(d, ["frame", "polarity"], 10, [F.col("response").desc(), F.col("event_id")], F.col("event_id"))


@query(
    "union_tracks",
    """WITH w AS (SELECT user_id%10 AS video_id, user_id AS object_id, CAST(floor(epoch(ts)/3600) AS BIGINT) AS frame, value, event_id FROM events)
SELECT video_id, object_id, frame, arg_max(value, event_id) AS x, arg_max(event_id, event_id) AS y FROM w GROUP BY ALL""",
)
def _(t):
    d = t.events.select((F.col("user_id") % 10).alias("video_id"), F.col("user_id").alias("object_id"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("frame"), F.col("value").alias("x"), F.col("event_id").alias("y"))
    return tr.union_tracks(d, F.col("y"))


# ---- joins in time ----------------------------------------------------------------------------------------------------
SHIP_SQL = "ship AS (SELECT o_custkey AS video_id, l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS BIGINT) AS frame FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"


def ship(t):
    d = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("long")
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("video_id"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", d.alias("frame")).join(o, "l_orderkey")


@query(
    "field_at",
    f"WITH {IV_SQL}, {SHIP_SQL} SELECT s.video_id, l_orderkey, l_partkey, frame, first, last FROM ship s JOIN iv ON s.video_id=iv.video_id AND frame BETWEEN first AND last",
)
def _(t):
    return sj.field_at(ship(t).drop("l_linenumber"), order_intervals(t), ["video_id"], width=64).select("video_id", "l_orderkey", "l_partkey", "frame", "first", "last")


@query(
    "match_events",
    f"WITH {IV_SQL}, {SHIP_SQL} SELECT s.video_id, frame, first, last, count(*) AS n FROM ship s JOIN iv ON s.video_id=iv.video_id AND frame BETWEEN first-2 AND last+2 GROUP BY ALL",
)
def _(t):
    d = sj.match_events(order_intervals(t), ship(t), 2, width=64)
    return d.groupBy("video_id", "frame", "first", "last").agg(F.count(F.lit(1)).alias("n"))


@query(
    "nearest_event",
    f"""WITH {SHIP_SQL}, e AS (SELECT DISTINCT o_custkey AS video_id, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT) AS ev FROM orders),
s AS (SELECT DISTINCT video_id, frame FROM ship),
b AS (SELECT s.*, e.ev AS b FROM s ASOF LEFT JOIN e ON s.video_id=e.video_id AND s.frame >= e.ev),
a AS (SELECT b.*, e.ev AS a FROM b ASOF LEFT JOIN e ON b.video_id=e.video_id AND b.frame <= e.ev),
c AS (SELECT video_id, frame, CASE WHEN a IS NULL OR frame-b <= a-frame THEN b ELSE a END AS event FROM a)
SELECT video_id, frame, event, abs(frame-event) AS distance, coalesce(abs(frame-event) <= 10, false) AS at_event FROM c""",
)
def _(t):
    e = t.orders.select(F.col("o_custkey").alias("video_id"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long").alias("frame")).distinct()
    return sj.nearest_event(ship(t).select("video_id", "frame").distinct(), e, 10)


@query(
    "interpolate_at",
    f"""WITH {TRACK_SQL}, q AS (SELECT video_id, object_id, frame FROM track WHERE frame%2=0), r AS (SELECT video_id, object_id, frame AS f, x FROM track WHERE frame%2=1),
b AS (SELECT q.*, r.f AS fb, r.x AS xb FROM q ASOF LEFT JOIN r ON q.object_id=r.object_id AND q.frame >= r.f),
a AS (SELECT b.*, r.f AS fa, r.x AS xa FROM b ASOF LEFT JOIN r ON b.object_id=r.object_id AND b.frame <= r.f)
SELECT video_id, object_id, frame, round(xb+(xa-xb)*(frame-fb)/(fa-fb),6) AS x FROM a""",
)
def _(t):
    q = t.track.where("frame % 2 = 0").select("video_id", "object_id", "frame")
    return rnd(sj.interpolate_at(q, t.track.where("frame % 2 = 1"), "x", ["video_id", "object_id"], "frame"), "x")


@query(
    "cameras_overlap",
    """WITH f AS (SELECT user_id AS case_id, event_type AS camera, min(epoch_us(ts)) AS f FROM events GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY f, camera) AS camera_no, min(f) OVER (PARTITION BY case_id) AS t0 FROM f)
SELECT user_id AS case_id, event_type AS camera, event_id, camera_no, epoch_us(ts)-t0 AS t_rel FROM events JOIN c ON user_id=case_id AND event_type=camera""",
)
def _(t):
    d = t.events.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("camera"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_s"))
    return sj.cameras_overlap(d).drop("t_s")


@query(
    "leave_one_video",
    """WITH o AS (SELECT lang, source AS video_id, count(*) AS n, sum(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) AS k FROM documents GROUP BY ALL)
SELECT lang, video_id, sum(n) OVER (PARTITION BY lang) - n AS others, sum(k) OVER (PARTITION BY lang) - k AS hits FROM o""",
)
def _(t):
    d = t.documents.select("lang", F.col("source").alias("video_id"), "n_chars")
    return sj.leave_one_video(d, ["lang"], F.col("n_chars") > 2000)


LAG_SQL = f"""{FRAMES_SQL}, d AS (SELECT *, level - lag(level) OVER w AS dv, frame - lag(frame) OVER w AS df FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
a AS (SELECT frame, dv FROM d WHERE video_id='AF' AND df=1), b AS (SELECT video_id AS copy, frame AS f, dv FROM d WHERE video_id<>'AF' AND df=1)"""


def _copies(t):
    one = t.frames.where("video_id = 'AF'").select(F.lit("v").alias("video_id"), "frame", "level")
    rest = t.frames.where("video_id <> 'AF'").select(F.lit("v").alias("video_id"), F.col("video_id").alias("copy"), "frame", "level")
    return one, rest


@query(
    "best_lag",
    f"""WITH {LAG_SQL}, g AS (SELECT copy, lag, count(*) AS n, corr(a.dv, b.dv) AS r FROM b, range(-90,91) l(lag), a WHERE a.frame=b.f-lag GROUP BY ALL HAVING count(*) >= 30)
SELECT 'v' AS video_id, copy, lag, round(r,6) AS r, n FROM (SELECT *, row_number() OVER (PARTITION BY copy ORDER BY r DESC, lag) AS k FROM g) WHERE k=1""",
)
def _(t):
    return rnd(sj.best_lag(*_copies(t)), "r")


WIN_SQL = f"""{LAG_SQL}, aw AS (SELECT a.*, CAST(floor(frame/150) AS BIGINT) - o AS win FROM a, range(0,2) r(o)),
g AS (SELECT copy, win, lag, count(*) AS n, corr(aw.dv, b.dv) AS r FROM b, range(-15,16) l(lag), aw WHERE aw.frame=b.f-lag AND win >= 0 GROUP BY ALL HAVING count(*) >= 60),
wl AS (SELECT copy, win, lag, r FROM (SELECT *, row_number() OVER (PARTITION BY copy, win ORDER BY r DESC, lag) AS k FROM g) WHERE k=1)"""


@query("windowed_lag", f"WITH {WIN_SQL} SELECT 'v' AS video_id, copy, win, lag, round(r,6) AS r FROM wl")
def _(t):
    return rnd(sj.windowed_lag(*_copies(t)), "r")


@query(
    "lag_steps",
    f"""WITH {WIN_SQL}, p AS (SELECT *, lag(win) OVER w AS pw, lag(lag) OVER w AS pl FROM wl WHERE r >= 0.15 WINDOW w AS (PARTITION BY copy ORDER BY win))
SELECT 'v' AS video_id, copy, pw AS win_before, win AS win_after, lag-pl AS "by", CASE WHEN lag>pl THEN 'repeated or inserted' ELSE 'dropped' END AS what FROM p WHERE pl <> lag""",
)
def _(t):
    return sj.lag_steps(sj.windowed_lag(*_copies(t)), 0.15)


@query(
    "lead_lag",
    f"""WITH {TRACK_SQL}, {FRAMES_SQL}, {own_scene_sql("sc", "SELECT DISTINCT object_id AS video_id FROM track")}, p AS (SELECT video_id, frame, level AS x FROM sc),
i AS (SELECT object_id, lag(frame) OVER w AS f0, frame AS f1, y - lag(y) OVER w AS d FROM track WINDOW w AS (PARTITION BY object_id ORDER BY frame)),
pm AS MATERIALIZED (SELECT * FROM p), j AS MATERIALIZED (SELECT object_id, lag, d, f1-lag AS a, f0-lag AS b FROM i, range(-6,7) l(lag) WHERE f0 IS NOT NULL),
j1 AS MATERIALIZED (SELECT j.*, pm.x AS x1 FROM j JOIN pm ON pm.video_id=object_id AND pm.frame=a), j2 AS MATERIALIZED (SELECT j1.*, pm.x AS x0 FROM j1 JOIN pm ON pm.video_id=object_id AND pm.frame=b),
g AS (SELECT object_id, lag, count(*) AS n, sum(d*(x1-x0))/sqrt(sum(d*d)*sum(pow(x1-x0,2))) AS c FROM j2 GROUP BY ALL)
SELECT object_id AS video_id, lag, round(c,6) AS c, n FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY abs(c) DESC, lag) AS k FROM g WHERE c IS NOT NULL AND NOT isnan(c)) WHERE k=1""",
)
def _(t):
    r = t.track.select(F.col("object_id").alias("video_id"), "frame", F.col("y").alias("theta"))
    p = t.frames.select(F.col("video_id").alias("scene"), "frame", F.col("level").alias("x"))
    return rnd(sj.lead_lag(r.join(scene_of(t.frames, r), "video_id"), p, range(-6, 7), scene=["scene"]), "c")


@query(
    "pauses_out",
    """WITH u AS (SELECT o_orderkey AS unit_id, CAST(epoch(o_orderdate) AS BIGINT) AS s, CAST(epoch(o_orderdate) AS BIGINT) + CAST(floor(o_totalprice) AS BIGINT) AS e FROM orders),
p AS (SELECT CAST(epoch(ts) AS BIGINT) - 220924800 + 50000*(event_id%100) AS s, CAST(epoch(ts) AS BIGINT) - 220924800 + 50000*(event_id%100) + 600 AS e FROM events WHERE event_type='error'),
g AS (SELECT unit_id, sum(least(u.e,p.e)-greatest(u.s,p.s)) AS p FROM u JOIN p ON p.s < u.e AND p.e > u.s GROUP BY ALL)
SELECT u.unit_id, s AS start, e AS "end", coalesce(p,0) AS paused_s, e-s-coalesce(p,0) AS running_s FROM u LEFT JOIN g USING (unit_id)""",
)
def _(t):
    s = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    u = t.orders.select(F.col("o_orderkey").alias("unit_id"), s.alias("start"), (s + F.floor("o_totalprice")).alias("end"))
    # floor, as the SQL cast of whole-second epochs would round half a second up
    ps = F.expr("CAST(round(unix_micros(CAST(ts AS TIMESTAMP))/1e6) AS BIGINT)") - 220924800 + 50000 * (F.col("event_id") % 100)
    p = t.events.where("event_type = 'error'").select(ps.alias("start"), (ps + 600).alias("end"))
    return sj.pauses_out(u, p)


@query(
    "masked_share",
    f"""WITH {TRACK_SQL}, m AS (SELECT DISTINCT video_id, floor(x/10) AS cx, floor(y/10) AS cy FROM track WHERE object_id%10=0)
SELECT t.video_id, object_id, count(*) AS frames, round(avg(CASE WHEN m.cx IS NULL THEN 0.0 ELSE 1.0 END),6) AS share FROM track t LEFT JOIN m ON t.video_id=m.video_id AND floor(t.x/10)=m.cx AND floor(t.y/10)=m.cy GROUP BY ALL""",
)
def _(t):
    m = t.track.where("object_id % 10 = 0").select("video_id", F.floor(F.col("x") / 10).alias("cx"), F.floor(F.col("y") / 10).alias("cy"))
    return rnd(sj.masked_share(t.track, m, 10.0), "share")


@query(
    "compare_results",
    """WITH f AS (SELECT l_orderkey AS video_id, l_linenumber AS object_id, round(sum(l_extendedprice),2) AS a, round(sum(l_extendedprice) + CASE WHEN l_orderkey%11=0 THEN 1 ELSE 0 END,2) AS b FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT video_id, object_id, 'differs' AS what FROM f WHERE abs(a-b) > greatest(1e-9, 1e-6*greatest(abs(a),abs(b)))""",
)
def _(t):
    f = t.lineitem.groupBy(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("object_id")).agg(F.sum("l_extendedprice").alias("s"))
    old = f.select("video_id", "object_id", F.round("s", 2).cast("string").alias("value"))
    new = f.select("video_id", "object_id", F.round(F.col("s") + F.when(F.col("video_id") % 11 == 0, 1).otherwise(0), 2).cast("string").alias("value"))
    return sj.compare_results(old, new, ["video_id", "object_id"]).select("video_id", "object_id", "what")


@query(
    "copies_table",
    f"""WITH {FRAMES_SQL}, c AS (SELECT substr(video_id,2,1) AS video_id, video_id AS copy, frame, level FROM frames), d AS (SELECT *, abs(level - lag(level) OVER (PARTITION BY copy ORDER BY frame)) AS dv FROM c),
g AS (SELECT video_id, copy, count(*) AS frames, coalesce(sum(CASE WHEN dv < 0.5 THEN 1 ELSE 0 END),0) AS held, min(frame) AS n0, max(frame) AS n1 FROM d GROUP BY ALL)
SELECT video_id, copy, frames, held, max(n1) OVER (PARTITION BY video_id) - min(n0) OVER (PARTITION BY video_id) + 1 - frames AS dropped FROM g""",
)
def _(t):
    return sj.copies_table(t.frames.select(F.substring("video_id", 2, 1).alias("video_id"), F.col("video_id").alias("copy"), "frame", "level"))


@query(
    "pick_detector",
    f"""WITH {TRACK_SQL}, j AS (SELECT m.video_id, m.frame, c.size, min(sqrt(pow(c.x-m.x,2)+pow(c.y-m.y,2))) AS d FROM track m JOIN (SELECT *, object_id%3*2+3 AS size FROM track WHERE object_id%10<>0) c ON c.video_id=m.video_id AND c.frame=m.frame
  WHERE m.object_id%10=0 AND sqrt(pow(c.x-m.x,2)+pow(c.y-m.y,2)) <= greatest(60, c.size/5) GROUP BY ALL),
s AS (SELECT video_id, size, count(*) AS n, avg(d) AS mean_px FROM j GROUP BY ALL),
r AS (SELECT video_id, list_reduce(list({{'size': CAST(size AS DOUBLE), 'mean_px': mean_px, 'n': n}} ORDER BY size), lambda a, b: CASE WHEN b.mean_px < a.mean_px - 0.5 THEN b ELSE a END) AS b FROM s GROUP BY ALL)
SELECT video_id, b.size AS size, round(b.mean_px,6) AS mean_px, b.n AS n FROM r""",
)
def _(t):
    m = t.track.where("object_id % 10 = 0").select("video_id", "frame", "x", "y")
    c = t.track.where("object_id % 10 <> 0").select("video_id", "frame", "x", "y", (F.col("object_id") % 3 * 2 + 3).alias("size"))
    return rnd(sj.pick_detector(m, c, 60.0, 0.5), "mean_px")
