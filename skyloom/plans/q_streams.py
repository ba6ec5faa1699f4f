"""Queries over streams that arrive out of order, late and repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.plans.corpus import EPOCH, FRAMES_SQL, TRACK_SQL
from skyloom.plans.q_sources import place
from skyloom.plans.q_windows import rnd
from skyloom.plans.registry import query
from skyloom.streaming import jobs
from skyloom.streaming import ordered as od

KEY = ["video_id", "object_id"]


def deliveries(rows: DataFrame, frame: str, own: list[str], seconds: int, change: dict) -> DataFrame:
    """Rows with the slice they arrive in, thirds of the frames: every seventh once more a slice later, changed, every fifth of the rest a slice late."""
    f0, f1 = rows.agg(F.min(frame), F.max(frame)).first()
    a, b = f0 + (f1 - f0) // 3, f0 + 2 * ((f1 - f0) // 3)
    third = F.when(F.col(frame) <= a, 1).when(F.col(frame) <= b, 2).otherwise(3)
    d = rows.withColumn("slice", third).withColumn("_h", sum((F.col(c) * (i + 1) for i, c in enumerate(own)), F.lit(0)))
    d = d.withColumn("slice", F.when((F.col("_h") % 7 != 0) & (F.col("_h") % 5 == 0), F.least(F.col("slice") + 1, F.lit(3))).otherwise(F.col("slice")))
    again = d.where("_h % 7 = 0 AND slice < 3").withColumn("slice", F.col("slice") + 1).withColumns(change)
    return d.unionByName(again).withColumn("ts", F.timestamp_seconds(F.lit(EPOCH) + F.col(frame) * seconds)).drop("_h")


def arrive(t, rows: DataFrame, name: str, job) -> DataFrame:
    """The slices one after the other, each run to its end by the same checkpoint."""
    src, path, check = place(t, name + "-in"), place(t, name), place(t, name + "-checkpoint")
    for s in (1, 2, 3):
        rows.where(F.col("slice") == s).drop("slice").write.mode("append").parquet(src)
        out = jobs.run_available(job(t.spark.readStream.schema(rows.drop("slice").schema).parquet(src)), path, check)
    return out


def delivered_sql(rows: str, frame: str, own: list[str], change: str, delay: int) -> str:
    """``dl``: deliveries with ``late``; ``ok``: the version of each row that the last watermark has passed."""
    h = "+".join(f"{c}*{i + 1}" for i, c in enumerate(own))
    third = f"CASE WHEN {frame} <= a THEN 1 WHEN {frame} <= b THEN 2 ELSE 3 END"
    return f"""lim AS (SELECT min({frame}) + (max({frame})-min({frame}))//3 AS a, min({frame}) + 2*((max({frame})-min({frame}))//3) AS b FROM {rows}),
d0 AS (SELECT r.*, {h} AS h, {third} AS third FROM {rows} r, lim),
d1 AS (SELECT * EXCLUDE (third), CASE WHEN h%7<>0 AND h%5=0 THEN least(third+1,3) ELSE third END AS slice FROM d0),
d2 AS (SELECT * FROM d1 UNION ALL BY NAME SELECT * REPLACE (slice+1 AS slice, {change}) FROM d1 WHERE h%7=0 AND slice<3),
wm AS (SELECT s, max({frame}) FILTER (slice < s) - {delay} AS w FROM d2, range(1,5) x(s) GROUP BY ALL),
dl AS (SELECT d2.*, coalesce({frame} <= w, false) AS late FROM d2 JOIN wm ON s=slice),
ok AS (SELECT * FROM dl WHERE NOT late AND {frame} <= (SELECT w FROM wm WHERE s=4) QUALIFY row_number() OVER (PARTITION BY {",".join(own)} ORDER BY slice DESC)=1)"""


@query(
    "settled_points",
    f"""WITH {TRACK_SQL}, {delivered_sql("track", "frame", ["video_id", "object_id", "frame"], "x+1000 AS x", 40)}
SELECT video_id, object_id, frame, round(x,6) AS x, round(y,6) AS y, false AS late FROM ok UNION ALL SELECT video_id, object_id, frame, round(x,6), round(y,6), true FROM dl WHERE late""",
)
def _(t):
    d = deliveries(t.track.select(*KEY, "frame", "x", "y"), "frame", [*KEY, "frame"], 3600, {"x": F.col("x") + 1000})
    return rnd(arrive(t, d, "settled", lambda s: od.settled_points(s, "40 hours")), "x", "y")


_NUMBERED = "fr AS (SELECT video_id, ascii(video_id) AS v, frame, level FROM frames)"


@query(
    "step_alerts",
    f"""WITH {FRAMES_SQL}, {_NUMBERED}, {delivered_sql("fr", "frame", ["v", "frame"], "level+20 AS level", 30).replace("PARTITION BY v,frame", "PARTITION BY video_id,frame")},
w AS (SELECT *, row_number() OVER p AS i, count(*) OVER (PARTITION BY video_id) AS n, median(level) OVER (p ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS b, median(level) OVER (p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS a FROM ok WINDOW p AS (PARTITION BY video_id ORDER BY frame))
SELECT video_id, frame, round(b,6) AS before, round(a,6) AS after, false AS late FROM w WHERE i > 8 AND i <= n-7 AND abs(a-b) >= 3 UNION ALL SELECT video_id, frame, round(level,6), NULL, true FROM dl WHERE late""",
)
def _(t):
    f = t.frames.select("video_id", F.ascii("video_id").alias("v"), "frame", "level")
    d = deliveries(f, "frame", ["v", "frame"], 86400, {"level": F.col("level") + 20}).drop("v")
    return rnd(arrive(t, d, "alerts", lambda s: od.step_alerts(s, delay="30 days")), "before", "after")


@query(
    "unit_states",
    """WITH e AS (SELECT user_id AS unit_id, epoch_us(ts)//1000 AS at_ms, min(event_type) AS state FROM events GROUP BY ALL), s AS (SELECT *, CASE WHEN state='view' THEN 'running' ELSE state END AS st FROM e),
p AS (SELECT *, lag(st) OVER w AS was, lag(at_ms) OVER w AS was_ms, lead(at_ms) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY unit_id ORDER BY at_ms)), m AS (SELECT max(at_ms) - 3600000 AS w FROM e)
SELECT unit_id, at_ms, st AS state, false AS late FROM p WHERE was IS NULL OR st <> was OR at_ms-was_ms > 43200000
UNION ALL SELECT unit_id, at_ms + 43200000, 'stalled', false FROM p, m WHERE st='running' AND (nxt - at_ms > 43200000 OR (nxt IS NULL AND at_ms + 43200000 <= w))""",
)
def _(t):
    state = F.when(F.col("state") == "view", "running").otherwise(F.col("state"))
    e = t.events.groupBy(F.col("user_id").alias("unit_id"), F.col("ts").cast("timestamp").alias("ts")).agg(F.min("event_type").alias("state")).withColumn("state", state)
    a, b = e.agg(F.percentile_approx(F.unix_micros("ts"), F.array(F.lit(0.33), F.lit(0.67)))).first()[0]
    e = e.withColumn("slice", F.when(F.unix_micros("ts") <= a, 1).when(F.unix_micros("ts") <= b, 2).otherwise(3))
    return arrive(t, e, "units", lambda s: od.unit_states(s, 43200, delay="1 hour"))


@query(
    "linked_tracks",
    f"""WITH RECURSIVE {TRACK_SQL}, {delivered_sql("track", "frame", ["video_id", "object_id", "frame"], "x+1000 AS x", 40)},
fl AS MATERIALIZED (SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS i, list(struct_pack(s := object_id, x := x, y := y) ORDER BY object_id) AS spots FROM ok GROUP BY video_id, frame),
w AS (SELECT video_id, 0::BIGINT AS i, NULL::BIGINT AS last, NULL::BIGINT AS frame, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy FROM (SELECT DISTINCT video_id FROM fl) UNION ALL
  SELECT video_id, i, CASE WHEN wait OR hit THEN f ELSE last END, CASE WHEN wait OR hit THEN f END, CASE WHEN wait THEN first.x WHEN hit THEN near.x ELSE x END, CASE WHEN wait THEN first.y WHEN hit THEN near.y ELSE y END,
    CASE WHEN wait OR NOT hit THEN vx WHEN gap <= 3 THEN (vx+(near.x-x)/gap)/2 ELSE (near.x-x)/gap END, CASE WHEN wait OR NOT hit THEN vy WHEN gap <= 3 THEN (vy+(near.y-y)/gap)/2 ELSE (near.y-y)/gap END
  FROM (SELECT *, coalesce(near.m <= 25+12*gap, false) AS hit FROM (SELECT w.video_id, fl.i, fl.frame AS f, w.last, w.x, w.y, w.vx, w.vy, fl.frame-w.last AS gap, w.last IS NULL OR fl.frame-w.last > 40 AS wait, spots[-1] AS first,
      list_min(list_transform(spots, lambda c: struct_pack(m := sqrt(pow(c.x-w.x-(fl.frame-w.last)*w.vx,2)+pow(c.y-w.y-(fl.frame-w.last)*w.vy,2)), s := c.s, x := c.x, y := c.y))) AS near FROM w JOIN fl ON fl.video_id=w.video_id AND fl.i=w.i+1)))
SELECT video_id, frame, round(x,6) AS x, round(y,6) AS y, false AS late FROM w WHERE frame IS NOT NULL UNION ALL SELECT video_id, frame, round(x,6), round(y,6), true FROM dl WHERE late""",
)
def _(t):
    d = deliveries(t.track.select(*KEY, "frame", "x", "y"), "frame", [*KEY, "frame"], 3600, {"x": F.col("x") + 1000})
    d = d.withColumns({"slot": F.col("object_id"), "response": F.col("object_id").cast("double")})
    return rnd(arrive(t, d, "linked", lambda s: od.linked_tracks(s, delay="40 hours")), "x", "y")
