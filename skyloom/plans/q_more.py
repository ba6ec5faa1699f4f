"""Queries over edges of bursts, jumps, places and rungs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions.chunked import rolling, row_index
from skyloom.functions.draws import uniform_sql
from skyloom.operators import pointers as pt
from skyloom.operators import rank as rk
from skyloom.operators import stats as st
from skyloom.operators import windows as w
from skyloom.plans.corpus import STATS_SQL, TRACK_SQL, frame_stats
from skyloom.plans.q_stats import TESTS, tests
from skyloom.plans.q_windows import med61, rnd
from skyloom.plans.registry import query


@query(
    "quiet_edges",
    f"""WITH {STATS_SQL}, {med61("sd")},
s AS (SELECT s.video_id, s.frame, s.diff, s.sd, s.level, m.m AS ref FROM stats s JOIN med m ON s.video_id=m.video_id AND s.idx=m.idx AND NOT m.pad),
t AS (SELECT *, max(diff) OVER r AS d3, count(diff) OVER r AS n3, abs(last_value(level) OVER r - level) AS dl FROM s WINDOW r AS (PARTITION BY video_id ORDER BY frame RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING)),
u AS (SELECT * REPLACE (CASE WHEN n3=3 THEN dl END AS dl) FROM t),
b AS (SELECT video_id, frame AS f FROM stats WHERE diff >= 12),
q AS (SELECT b.video_id, f, greatest(median(diff) FILTER (frame BETWEEN f-20 AND f-3), median(diff) FILTER (frame BETWEEN f+10 AND f+29)) AS ud, greatest(median(dl) FILTER (frame BETWEEN f-20 AND f-3), median(dl) FILTER (frame BETWEEN f+10 AND f+29)) AS ul FROM b JOIN u ON b.video_id=u.video_id AND frame BETWEEN f-30 AND f+30 GROUP BY ALL),
g AS (SELECT q.video_id, f, 2*coalesce(ud,0)+0.5 AS q, frame, n3=3 AND d3 <= 2*coalesce(ud,0)+0.5 AND dl <= greatest(1,2*coalesce(ul,0)) AND sd >= 0.6*ref AS good FROM q JOIN u ON q.video_id=u.video_id AND frame BETWEEN f-30 AND f+30)
SELECT video_id, f AS burst, round(q,6) AS q, max(CASE WHEN good AND frame BETWEEN f-30 AND f-3 THEN frame END) AS before, min(CASE WHEN good AND frame BETWEEN f+1 AND f+27 THEN frame END) AS "after" FROM g GROUP BY video_id, f, q""",
)
def _(t):
    s = frame_stats(t.frames)
    b = s.where("diff >= 12").select("video_id", F.col("frame").alias("burst"), F.col("frame").alias("first"), F.col("frame").alias("last"))
    return rnd(w.quiet_edges(s, b, 10.0).select("video_id", "burst", "q", "before", "after"), "q")


@query("track_jumps")
def _(t):
    d = row_index(t.frames.select("video_id", "frame", F.col("level").alias("x"), F.col("sd").alias("y")), ["video_id"], "frame")
    return rnd(w.track_jumps(d, 10.0, 3.5, keys=["video_id"]), "px", "L", n=5)


@query("rank_within", f"WITH {TESTS} SELECT event_id, video_id, row_number() OVER (PARTITION BY video_id ORDER BY coalesce(p,2.0), -(event_id%100), event_id) AS place FROM tests")
def _(t):
    d = tests(t).withColumn("score", F.col("event_id") % 100)
    return rk.rank_within(d, ["video_id"], "p", "score", "event_id").select("event_id", "video_id", "place")


@query("shrink_to_rung", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_tax > 0 THEN 0.0016/(0.0016+l_tax*l_tax) ELSE 0 END,9) AS z, round(CASE WHEN l_tax > 0 THEN 0.0016/(0.0016+l_tax*l_tax) ELSE 0 END*ln(l_quantity)+(1-CASE WHEN l_tax > 0 THEN 0.0016/(0.0016+l_tax*l_tax) ELSE 0 END)*2.0,9) AS ln_ratio FROM lineitem")
def _(t):
    z, m = st.shrink_to_rung(F.log("l_quantity"), F.col("l_tax"), F.lit(2.0), F.lit(0.01), F.lit(0.04))
    return rnd(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", z.alias("z"), m.alias("ln_ratio")), "z", "ln_ratio", n=9)


# ---- which forecasts survive, a pointer's own clock -------------------------------------------------------------------
KEY = ["video_id", "object_id"]
BLOCK, DRAWS = 5, 100


def _round(i: int) -> str:
    """One step of the elimination, of the models left (``a``), with the largest share so far (``top``)."""
    return f"""
d{i} AS (SELECT video_id, object_id, model, mean - avg(mean) OVER (PARTITION BY object_id) AS own FROM a{i}),
w{i} AS (SELECT video_id, object_id, draw, model, r.mean - avg(r.mean) OVER (PARTITION BY object_id, draw) - own AS "off", own FROM drawn r JOIN d{i} USING (video_id, object_id, model)),
s{i} AS (SELECT video_id, object_id, model, own, sqrt(greatest(avg("off"*"off"),1e-300)) AS sd FROM w{i} GROUP BY ALL),
x{i} AS (SELECT video_id, object_id, min(model) AS model, t FROM (SELECT *, own/sd AS t, max(own/sd) OVER (PARTITION BY object_id) AS m FROM s{i}) WHERE t = m GROUP BY ALL),
z{i} AS (SELECT video_id, object_id, draw, max("off"/sd) AS stat FROM w{i} JOIN s{i} USING (video_id, object_id, model) GROUP BY ALL),
p{i} AS MATERIALIZED (SELECT video_id, object_id, x.model, avg(CASE WHEN stat >= t THEN 1.0 ELSE 0.0 END) AS share FROM z{i} JOIN x{i} x USING (video_id, object_id) GROUP BY ALL),
a{i + 1} AS MATERIALIZED (SELECT a.* FROM a{i} a ANTI JOIN p{i} USING (video_id, object_id, model))"""


@query(
    "model_confidence",
    f"""WITH {TRACK_SQL}, r AS (SELECT *, row_number() OVER w AS i, lag(x) OVER w AS x1, lag(x,2) OVER w AS x2, lag(x,3) OVER w AS x3 FROM track WINDOW w AS (PARTITION BY object_id ORDER BY frame)),
l AS MATERIALIZED (SELECT video_id, object_id, i - 3 AS idx, unnest(['last','line','mean']) AS model, unnest([pow(x-x1,2), pow(x-2*x1+x2,2), pow(x-(x1+x2+x3)/3,2)]) AS loss FROM r WHERE i > 3),
n AS (SELECT video_id, object_id, max(idx) AS n FROM l GROUP BY ALL HAVING max(idx) >= {BLOCK}),
b AS (SELECT video_id, object_id, n, draw, CAST(floor({uniform_sql(0, "video_id", "object_id", "draw", "j")}*(n-{BLOCK}+1)) AS BIGINT) AS s FROM n, range(1,{DRAWS + 1}) x(draw), range(0,1000) y(j) WHERE j < n//{BLOCK}),
drawn AS MATERIALIZED (SELECT l.video_id, l.object_id, model, draw, sum(loss)/(n//{BLOCK}*{BLOCK}) AS mean FROM b JOIN l ON b.object_id=l.object_id AND l.idx BETWEEN s+1 AND s+{BLOCK} GROUP BY l.video_id, l.object_id, model, draw, n),
a0 AS MATERIALIZED (SELECT video_id, object_id, model, avg(loss) AS mean FROM l SEMI JOIN n USING (object_id) GROUP BY ALL),
{",".join(_round(i) for i in range(2))},
q AS (SELECT video_id, object_id, model, share AS p FROM p0 UNION ALL SELECT b.video_id, b.object_id, b.model, greatest(a.share, b.share) FROM p1 b JOIN p0 a USING (video_id, object_id) UNION ALL SELECT video_id, object_id, model, 1.0 FROM a2)
SELECT video_id, object_id, model, round(a0.mean,6) AS loss, round(p,6) AS p, p >= 0.1 AS kept FROM q JOIN a0 USING (video_id, object_id, model)""",
)
def _(t):
    d = row_index(t.track, KEY, "frame", out="i")
    d = rolling(d, KEY, "i", 3, 0, {"_w": F.collect_list(F.struct("x"))}).where("i > 3")  # the point and the three before it
    d = d.withColumns({f"x{k}": F.get("_w", 3 - k)["x"] for k in (1, 2, 3)})
    off = {"last": F.col("x") - F.col("x1"), "line": F.col("x") - 2 * F.col("x1") + F.col("x2"), "mean": F.col("x") - (F.col("x1") + F.col("x2") + F.col("x3")) / 3}
    d = d.select(*KEY, (F.col("i") - 3).alias("idx"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.pow(v, 2).alias("loss")) for m, v in off.items()])).alias("m"))
    return rnd(st.model_confidence(d.select(*KEY, "idx", "m.*"), KEY, BLOCK, DRAWS), "loss", "p", n=6)


_UPDATES = f"""RECURSIVE {TRACK_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY frame) AS i FROM track WHERE x IS NOT NULL),
u AS (SELECT video_id, object_id, frame, i, x, x AS last, true AS moved FROM r WHERE i=1 UNION ALL
  SELECT r.video_id, r.object_id, r.frame, r.i, r.x, CASE WHEN abs(r.x-u.last) >= 20 THEN r.x ELSE u.last END, abs(r.x-u.last) >= 20 FROM u JOIN r ON r.object_id=u.object_id AND r.i=u.i+1)"""


@query("pointer_updates", f"WITH {_UPDATES} SELECT video_id, object_id, frame, x FROM u WHERE moved")
def _(t):
    return pt.pointer_updates(t.track, KEY, "frame", "x", 40.0, chunk=64)


@query(
    "stall",
    f"""WITH {_UPDATES}, e AS (SELECT object_id, min(frame) AS f0, max(frame) AS f1 FROM track WHERE frame%3=0 GROUP BY ALL),
m AS (SELECT u.video_id, object_id, frame AS a, lead(frame) OVER (PARTITION BY object_id ORDER BY frame)-1 AS b, count(*) OVER (PARTITION BY object_id) AS n FROM u JOIN e USING (object_id) WHERE moved AND frame BETWEEN f0 AND f1),
k AS (SELECT * FROM m WHERE n >= 3 AND b IS NOT NULL), q AS (SELECT DISTINCT object_id, f FROM (SELECT object_id, a AS f FROM k UNION ALL SELECT object_id, b FROM k)),
p AS (SELECT object_id, frame AS f, y FROM track WHERE frame%3=0), lo AS (SELECT q.*, p.f AS f0, p.y AS y0 FROM q ASOF LEFT JOIN p ON q.object_id=p.object_id AND q.f >= p.f),
hi AS (SELECT lo.*, p.f AS f1, p.y AS y1 FROM lo ASOF LEFT JOIN p ON lo.object_id=p.object_id AND lo.f <= p.f), x AS (SELECT object_id, f, CASE WHEN f0=f1 THEN y0 ELSE y0+(y1-y0)*(f-f0)/(f1-f0) END AS y FROM hi),
o AS (SELECT k.*, abs((xb.y-xa.y)/4.0+0.01*(b-a))/40 AS steps FROM k JOIN x xa ON xa.object_id=k.object_id AND xa.f=a JOIN x xb ON xb.object_id=k.object_id AND xb.f=b)
SELECT video_id, object_id, round(max(steps),6) AS steps, arg_max(b-a+1, struct_pack(s := steps, f := -a)) AS frames, arg_max(a, struct_pack(s := steps, f := -a)) AS at_frame FROM o GROUP BY ALL""",
)
def _(t):
    u = pt.pointer_updates(t.track, KEY, "frame", "x", 40.0, chunk=64)
    path = t.track.where("frame % 3 = 0").select(*KEY, "frame", "y")
    return rnd(pt.stall(u, path, KEY, "frame", "y", F.lit(4.0), F.lit(0.01), 40.0), "steps")
