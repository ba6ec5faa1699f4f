"""Queries over linking, merging and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import links as li
from skyloom.operators.tracks import top_n
from skyloom.plans.corpus import EPOCH, STATS_SQL, TRACK_SQL, frame_stats
from skyloom.plans.q_sources import place
from skyloom.plans.q_windows import rnd
from skyloom.plans.registry import query
from skyloom.streaming import jobs

PEAKS = f"""{TRACK_SQL}, pk AS (SELECT video_id, frame, CAST(object_id%2 AS INT) AS polarity, frame*100000+object_id AS peak_id, x, y, 10+object_id%9 AS amp, 3+object_id%3 AS size FROM track)"""


def peaks(t):
    return t.track.select("video_id", "frame", (F.col("object_id") % 2).cast("int").alias("polarity"), (F.col("frame") * 100000 + F.col("object_id")).alias("peak_id"), "x", "y", (10 + F.col("object_id") % 9).cast("double").alias("amp"), (3 + F.col("object_id") % 3).cast("double").alias("size"))


@query("pair_chain_seeds", f"WITH {PEAKS} SELECT a.video_id, a.peak_id, b.peak_id AS peak_id_2, CAST(b.frame-a.frame AS INT) AS dt FROM pk a JOIN pk b ON a.video_id=b.video_id AND a.polarity=b.polarity AND b.frame BETWEEN a.frame+1 AND a.frame+3 AND sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) <= 20*(b.frame-a.frame)")
def _(t):
    return li.pair_chain_seeds(peaks(t), 20.0).select("video_id", "peak_id", "peak_id_2", "dt")


@query("extend_chains")
def _(t):
    return rnd(li.extend_chains(peaks(t), 8.0), "x", "y").select("video_id", "chain", "frame", "peak_id", "x", "y", "n")


@query("join_pieces")
def _(t):
    return li.join_pieces(li.extend_chains(peaks(t), 8.0))


@query("merge_windows")
def _(t):
    # windows of 240 frames, 60 overlapping: a user's points in each are a proposal
    w = F.explode(F.array(F.floor(F.col("frame") / 180), F.floor((F.col("frame") - 60) / 180)))
    p = t.track.select("video_id", "object_id", "frame", "x", "y", w.alias("window")).distinct()
    p = p.withColumn("prop_id", F.col("object_id") * 10 + F.col("window"))
    props = p.groupBy("video_id", "prop_id", "window").agg(F.count(F.lit(1)).alias("seen"), F.max(F.col("object_id") % 2 == 0).alias("dark"))
    m, _tr = li.merge_windows(props, p.select("video_id", "prop_id", "frame", "x", "y"), shared=2)
    return m


@query(
    "local_flow",
    f"""WITH {TRACK_SQL}, f AS (SELECT a.video_id, a.frame, a.x, a.y, a.x-50 AS dx, a.y-50 AS dy, 1+a.object_id%3 AS w, c.x AS cx, c.y AS cy FROM track a JOIN track c ON a.video_id=c.video_id AND a.frame=c.frame WHERE c.object_id%10=0 AND a.object_id%10<>0),
j AS (SELECT *, r AS r_out FROM f, (SELECT unnest([40.0,80.0]::DOUBLE[]) AS r) WHERE sqrt(pow(x-cx,2)+pow(y-cy,2)) BETWEEN 5 AND r),
m AS (SELECT video_id, frame, r_out, count(*) AS patches, median(dx) AS mx, median(dy) AS my FROM j GROUP BY ALL HAVING count(*) >= 2)
SELECT video_id, frame, r_out, patches, round(sum(dx*w)/sum(w),6) AS flow_x, round(sum(dy*w)/sum(w),6) AS flow_y, count(*) AS used FROM j JOIN m USING (video_id, frame, r_out) WHERE sqrt(pow(dx-mx,2)+pow(dy-my,2)) <= 20 GROUP BY video_id, frame, r_out, patches""",
)
def _(t):
    f = t.track.where("object_id % 10 <> 0").select("video_id", "frame", "x", "y", (F.col("x") - 50).alias("dx"), (F.col("y") - 50).alias("dy"), (1 + F.col("object_id") % 3).alias("w"))
    c = t.track.where("object_id % 10 = 0").select("video_id", "frame", F.col("x").alias("cx"), F.col("y").alias("cy"))
    return rnd(li.local_flow(f, c, 5.0, [40.0, 80.0], 2, 20.0), "flow_x", "flow_y")


@query("group_shift")
def _(t):
    g = t.track.select("video_id", "frame").distinct().select("video_id", "frame", F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"))
    return rnd(li.group_shift(t.track.select("video_id", "frame", "x", "y"), g, 15.0, 4.0), "dx", "dy")


@query(
    "link_agreement",
    f"""WITH {TRACK_SQL}, a AS (SELECT * FROM track WHERE frame%3<>0), b AS (SELECT video_id, object_id, frame, x+CASE WHEN frame%5=0 THEN 3 ELSE 0 END AS x, y FROM track WHERE frame%3<>1)
SELECT coalesce(a.video_id,b.video_id) AS video_id, coalesce(a.object_id,b.object_id) AS object_id, coalesce(a.frame,b.frame) AS frame, round(coalesce(a.x,b.x),6) AS x, round(coalesce(a.y,b.y),6) AS y,
 CASE WHEN a.frame IS NULL THEN 'backward only' WHEN b.frame IS NULL THEN 'forward only' WHEN sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) <= 1 THEN 'agreed' ELSE 'disputed' END AS state FROM a FULL JOIN b ON a.object_id=b.object_id AND a.frame=b.frame""",
)
def _(t):
    b = t.track.where("frame % 3 <> 1").withColumn("x", F.col("x") + F.when(F.col("frame") % 5 == 0, 3).otherwise(0))
    return rnd(li.link_agreement(t.track.where("frame % 3 <> 0"), b), "x", "y")


# ---- streams: the given tables land in three time slices, the job run on what has come after each -------------------
def feed(t, df, order, name, job):
    """Write ``df`` slice by slice along ``order``; after each slice run ``job(stream)`` over what is new (the same
    checkpoint, so state and position carry on)."""
    src = place(t, name)
    key = F.unix_micros(order) if dict(df.dtypes)[order] == "timestamp" else F.col(order).cast("long")
    cuts = df.agg(F.percentile_approx(key, F.array(F.lit(0.33), F.lit(0.67)))).first()[0]
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:]):
        part = df if lo is None else df.where(key > lo)
        part = part if hi is None else part.where(key <= hi)
        part.write.mode("append").parquet(src)
        out = job(t.spark.readStream.schema(df.schema).parquet(src))
    return out


def run(t, df, order, name, job, mode="append"):
    path, check = place(t, name), place(t, name + "-checkpoint")
    return feed(t, df, order, name + "-in", lambda s: jobs.run_available(job(s), path, check, mode))


@query("track_linker")
def _(t):
    c = t.track.select("video_id", "frame", "x", "y", F.col("object_id").cast("double").alias("response"))
    return rnd(run(t, c, "frame", "linked", jobs.track_linker).where("NOT late").drop("late"), "x", "y")


@query(
    "sessions",
    """WITH e AS (SELECT user_id AS object_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 14400000000 THEN 0 ELSE 1 END AS nw FROM events),
g AS (SELECT *, sum(nw) OVER (PARTITION BY object_id ORDER BY ts) AS g FROM e) SELECT object_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 14400000000 AS "end", count(*) AS n FROM g GROUP BY object_id, g""",
)
def _(t):
    e = t.events.select(F.col("user_id").alias("object_id"), F.col("ts").cast("timestamp").alias("ts"))
    d = run(t, e, "ts", "sessions", lambda s: jobs.sessions(s, "4 hours", "1 hour"), "complete")
    return d.select("object_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("per_second_rates", "SELECT user_id AS object_id, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, round(avg(value),6) AS rate, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    e = t.events.select(F.col("user_id").alias("object_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))
    d = run(t, e, "ts", "rates", lambda s: jobs.per_second_rates(s, "1 day", late="1 hour"), "complete")
    return rnd(d.select("object_id", F.unix_micros("start").alias("start"), "rate", "n"), "rate")


@query(
    "rolling_step_alert",
    f"""WITH {STATS_SQL}, w AS (SELECT *, median(level) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS b, median(level) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS a, count(*) OVER (PARTITION BY video_id) AS n FROM stats)
SELECT video_id, frame, round(b,6) AS before, round(a,6) AS after FROM w WHERE idx > 8 AND idx <= n-7 AND abs(a-b) >= 3""",
)
def _(t):
    f = t.frames.select("video_id", "frame", "level")
    return rnd(run(t, f, "frame", "steps", jobs.rolling_step_alert), "before", "after")


@query("running_noise_levels", "SELECT event_type AS stratum, user_id%24 AS bin, CAST(floor(value) AS BIGINT) AS slot, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    e = t.events.select(F.col("event_type").alias("stratum"), (F.col("user_id") % 24).alias("bin"), "value", "event_id")
    return run(t, e, "event_id", "levels", jobs.running_noise_levels, "complete")


@query("progress_status", "SELECT user_id AS unit_id, CASE WHEN arg_max(event_type, ts)='view' AND epoch(TIMESTAMP '2024-01-31')-floor(epoch(max(ts))) > 43200 THEN 'stalled' WHEN arg_max(event_type, ts)='view' THEN 'running' ELSE arg_max(event_type, ts) END AS state FROM events GROUP BY ALL")
def _(t):
    e = t.events.select(F.col("user_id").alias("unit_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")).alias("state"))
    d = run(t, e, "ts", "status", jobs.progress_status, "complete")
    import datetime as dt

    return jobs.judged(d, dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc), 43200).select("unit_id", "state")


@query("partial_lists", "SELECT video_id, event_id, score, rank FROM (SELECT user_id%7 AS video_id, event_id, value AS score, row_number() OVER (PARTITION BY user_id%7 ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 12")
def _(t):
    d = t.events.select((F.col("user_id") % 7).alias("video_id"), "event_id", F.col("value").alias("score"))
    show = lambda seen: top_n(seen, ["video_id"], 12, [F.col("score").desc(), F.col("event_id")], F.col("event_id"))
    path, check = place(t, "lists"), place(t, "lists-checkpoint")
    return feed(t, d, "event_id", "proposals", lambda s: jobs.partial_lists(s, path, check, show))


@query("late_data", f"SELECT DISTINCT CAST(floor(user_id/10) AS BIGINT) AS video_id, user_id AS object_id, CAST(floor((floor(epoch(ts))-{EPOCH})/3600) AS BIGINT)+1 AS frame FROM events")
def _(t):
    e = t.events.select(F.floor(F.col("user_id") / 10).alias("video_id"), F.col("user_id").alias("object_id"), (F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - EPOCH) / 3600) + 1).alias("frame"), F.col("ts").cast("timestamp").alias("ts"))
    return run(t, e, "ts", "deduped", lambda s: jobs.dedupe_late(s, "3 hours")).select("video_id", "object_id", "frame")
