"""Queries that write tables derived from the given ones and read them back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyloom.functions.joins import dealt
from skyloom.functions.lineage import scratch
from skyloom.operators import stats as st
from skyloom.plans.corpus import CURVES_SQL, FRAMES_SQL, TRACK_SQL
from skyloom.plans.q_windows import rnd
from skyloom.plans.registry import query
from skyloom.sources import readers as rd
from skyloom.sources import writers as wr


def place(t, name):
    return f"{scratch(t.spark)}/{name}-{uuid.uuid4().hex}"


def files_with_header(df, path, header):
    df.toDF(*header).write.option("header", True).csv(path)
    return path


@query("read_tracks", f"WITH {TRACK_SQL} SELECT frame, round(x,6) AS x, round(y,6) AS y, count(*) AS n FROM track GROUP BY ALL")
def _(t):
    a = files_with_header(t.track.where("object_id % 2 = 0").select("frame", "x", "y"), place(t, "tracks-a"), ["frame", "x_px", "y_px"])
    b = files_with_header(t.track.where("object_id % 2 = 1").select("y", "x", "frame"), place(t, "tracks-b"), ["grp_y", "grp_x", "n"])
    d = rd.read_tracks(t.spark, [a, b])
    return rnd(d, "x", "y").groupBy("frame", "x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("read_series", f"WITH {TRACK_SQL} SELECT frame, round(x,6) AS value, CASE WHEN y >= 50 THEN round(y,6) ELSE 7.5 END AS err, count(*) AS n FROM track GROUP BY ALL")
def _(t):
    d = t.track.select("frame", "x", F.when(F.col("y") >= 50, F.col("y")).alias("e"))
    d = rd.read_series(t.spark, files_with_header(d, place(t, "series"), ["frame", "value_m", "err_m"]), default_err=7.5)
    return rnd(d, "value", "err").groupBy("frame", "value", "err").agg(F.count(F.lit(1)).alias("n"))


@query("read_platform", "SELECT o_orderkey AS frame, round(o_custkey/100.0,6) AS lat, round(-(o_orderkey%90)*1.0,6) AS lon, round(o_totalprice*0.3048,4) AS alt_m FROM orders")
def _(t):
    d = t.orders.select("o_orderkey", F.col("o_custkey") / 100.0, -(F.col("o_orderkey") % 90).cast("double"), "o_totalprice", F.lit(90.0))
    d = rd.read_platform(t.spark, files_with_header(d, place(t, "platform"), ["frame", "lat", "lon", "alt_ft", "heading_deg"]))
    return rnd(rnd(d.select("frame", "lat", "lon", "alt_m"), "lat", "lon"), "alt_m", n=4)


@query("read_los", "SELECT o_orderkey AS frame, round(o_custkey/100.0,6) AS tgt_lat, round(o_totalprice*0.3048,4) AS tgt_elev_m, 0.0 AS off_right_deg FROM orders")
def _(t):
    d = t.orders.select("o_orderkey", F.col("o_custkey") / 100.0, F.lit(1.0), "o_totalprice")
    d = rd.read_los(t.spark, files_with_header(d, place(t, "los"), ["frame", "tgt_lat", "tgt_lon", "tgt_elev_ft"]))
    return rnd(rnd(d.select("frame", "tgt_lat", "tgt_elev_m", "off_right_deg"), "tgt_lat"), "tgt_elev_m", n=4)


@query("read_sightlines", "SELECT event_type AS camera, round(epoch_us(ts)/1e6,3) AS t_s, round(value,6) AS az_deg, round(-(user_id%60)*1.0,6) AS dep_deg, CASE WHEN event_type='view' THEN 'no place for the camera' END AS error, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    d = t.events.select("event_type", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "value", (F.col("user_id") % 60).cast("double"))
    p = files_with_header(d, place(t, "sight"), ["camera", "t_unix_s", "az_deg", "el_deg"])
    cams = t.events.where("event_type <> 'view'").select(F.col("event_type").alias("camera")).distinct().select("camera", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(3.0).alias("alt_m"))
    s = rd.read_sightlines(t.spark, p, cams)
    s = rnd(rnd(s.select("camera", "t_s", "az_deg", "dep_deg", "error"), "t_s", n=3), "az_deg", "dep_deg")
    return s.groupBy("camera", "t_s", "az_deg", "dep_deg", "error").agg(F.count(F.lit(1)).alias("n"))


@query(
    "read_winds",
    """WITH d AS (SELECT o_orderkey, o_totalprice/10000 AS s, o_custkey%360 AS a, 1000+o_orderkey%50 AS z, o_custkey%100 AS g FROM orders)
SELECT o_orderkey, time, round(z_m,4) AS z_m, round(-s*0.514444*sin(radians(a)),6) AS u, round(-s*0.514444*cos(radians(a)),6) AS v FROM (
  SELECT o_orderkey, '2020-01-01T00:00' AS time, z AS z_m, s, a FROM d UNION ALL SELECT o_orderkey, '2020-01-01T00:00', z-287.05*280/9.80665*ln(850/900.0), s+1, a FROM d
  UNION ALL SELECT o_orderkey, '2020-01-01T01:00', z+5, s+2, a FROM d UNION ALL SELECT o_orderkey, '2020-01-01T01:00', g+100, s+3, a FROM d)""",
)
def _(t):
    d = t.orders.select("o_orderkey", (F.col("o_totalprice") / 10000).alias("s"), (F.col("o_custkey") % 360).alias("a"), (1000 + F.col("o_orderkey") % 50).alias("z"), (F.col("o_custkey") % 100).alias("g"))
    arr = lambda *v: F.array(*[x if not isinstance(x, (int, float)) else F.lit(x) for x in v])
    nul = F.lit(None).cast("double")
    hourly = F.struct(
        F.array(F.lit("2020-01-01T00:00"), F.lit("2020-01-01T01:00")).alias("time"), F.array(F.col("s"), F.col("s") + 2).alias("wind_speed_900hPa"), F.array("a", "a").alias("wind_direction_900hPa"), F.array(F.col("z"), F.col("z") + 5).alias("geopotential_height_900hPa"),
        F.array(F.col("s") + 1, nul).alias("wind_speed_850hPa"), F.array("a", "a").alias("wind_direction_850hPa"), F.array(nul, F.col("s") + 3).alias("wind_speed_100m"), F.array("a", "a").alias("wind_direction_100m"),
    )
    docs = d.select("o_orderkey", F.to_json(F.struct(F.col("g").cast("double").alias("elevation"), hourly.alias("hourly")), {"ignoreNullFields": "false"}).alias("value"))
    w = rd.read_winds(docs).select("o_orderkey", "time", "z_m", "u", "v")
    return rnd(rnd(w, "z_m", n=4), "u", "v")


@query("read_layers", f"WITH {FRAMES_SQL} SELECT video_id AS layer, frame, round(level,6) AS dx, round(sd,6) AS dy FROM frames WHERE video_id='AF'")
def _(t):
    d = t.frames.select("video_id", "frame", F.lit(5), "level", "sd")
    r = rd.read_layers(t.spark, files_with_header(d, place(t, "layers"), ["class", "frame", "k", "dx", "dy"]), "AF")
    return rnd(r.select("layer", "frame", "dx", "dy"), "dx", "dy")


@query("blocks_as_pairs", "SELECT o_orderkey, unnest(range(o_custkey, o_custkey+o_orderkey%10+1)) AS frame, 5*o_totalprice AS dx, -5*o_totalprice AS dy FROM orders")
def _(t):
    b = t.orders.select("o_orderkey", F.col("o_custkey").alias("first"), (F.col("o_custkey") + 5 + F.col("o_orderkey") % 10).alias("last"), F.col("o_totalprice").alias("vx"), (-F.col("o_totalprice")).alias("vy"))
    return rd.blocks_as_pairs(b, 5)


@query("read_pointer", f"WITH {TRACK_SQL} SELECT frame, round(sqrt(pow(x*sin(radians(y*3.6))*1.2,2)+pow(x*cos(radians(y*3.6)),2)),5) AS r, round(degrees(atan2(x*sin(radians(y*3.6))*1.2, x*cos(radians(y*3.6)))),4) AS theta, count(*) AS n FROM track WHERE y > 10 GROUP BY ALL")
def _(t):
    d = t.track.select("frame", "x", F.when(F.col("y") > 10, F.col("y") * 3.6))
    r = rd.read_pointer(t.spark, files_with_header(d, place(t, "pointer"), ["frame", "r_px", "theta_deg"]), 1.2)
    return rnd(rnd(r.select("frame", "r", "theta"), "r", n=5), "theta", n=4).groupBy("frame", "r", "theta").agg(F.count(F.lit(1)).alias("n"))


@query("read_curves", f"WITH {CURVES_SQL} SELECT video_id, frame, CASE WHEN curve='L1' THEN 'object' ELSE 'background '||substr(curve,2) END AS curve, round(value,6) AS value, kind FROM curves")
def _(t):
    names = [f"L{i}" for i in range(1, 8)]
    w = t.curves.groupBy("video_id", "frame").pivot("curve", names).agg(F.first("value"))
    w = w.select("video_id", "frame", F.col("L1").alias("object"), *[F.col(n).alias(f"background {n[1:]}") for n in names[1:]])
    return rnd(rd.read_curves(w, ["video_id", "frame"]).where("value IS NOT NULL"), "value")


@query("read_cases", "SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, NULL AS missing, CASE WHEN event_id%50=0 THEN 'unreadable' END AS read_error FROM (SELECT event_id, CASE WHEN event_id%50=0 THEN NULL ELSE props END AS props FROM events)")
def _(t):
    d = t.events.select("event_id", F.when(F.col("event_id") % 50 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("value"))
    return rd.read_cases(d, {"k": ("$.k", "bigint"), "missing": ("$.results.fit.v", "double")})


@query("read_batch", "SELECT event_type AS object, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL")
def _(t):
    b = t.events.select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("object"))
    return rd.objects_of(b).groupBy("object").agg(F.count(F.lit(1)).alias("n"))


@query("read_catalog", "SELECT source AS release, count(*) AS clips, round(avg(CASE WHEN lang='en' THEN 1.0 ELSE 0.0 END),9) AS share FROM documents GROUP BY ALL")
def _(t):
    return rnd(rd.disclosure_rate(t.documents.select(F.col("source").alias("release"), (F.col("lang") == "en").alias("disclosed"))), "share", n=9)


@query("catalog_lookup", "SELECT o_orderkey AS key, o_totalprice AS price FROM orders")
def _(t):
    names = t.orders.select(F.col("o_orderkey").alias("key"), F.concat(F.lit("/videos/CLIP-00"), F.col("o_orderkey").cast("string"), F.lit(".mp4")).alias("name"))
    cat = t.orders.select(F.concat(F.lit("clip_"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_totalprice").alias("price"))
    return rd.catalog_lookup(names, cat).select("key", "price")


@query("read_envelopes", "SELECT p_type AS class, p_name AS member, number, value FROM (SELECT p_type, p_name, 'size' AS number, CAST(p_size AS DOUBLE) AS value, p_brand AS src, p_partkey FROM part UNION ALL SELECT p_type, p_name, 'price', p_retailprice, CASE WHEN p_partkey%3=0 THEN 'x' END, p_partkey FROM part) WHERE coalesce(src,'')=''")
def _(t):
    p = t.part.select(F.col("p_type").alias("class"), F.col("p_name").alias("member"), F.col("p_size").alias("size"), F.col("p_brand").alias("size_source"), F.col("p_retailprice").alias("price"), F.when(F.col("p_partkey") % 3 == 0, "x").alias("price_source"))
    return rd.unsourced(p, {"size": "size_source", "price": "price_source"})


@query("read_controls", "SELECT CAST(label AS VARCHAR) AS class, vec_id AS object_id, round(CAST(embedding[1] AS DOUBLE),9) AS a1, NULL AS unmeasured FROM embeddings")
def _(t):
    p = place(t, "controls")
    wr.write_controls(t.axes, p, ["class", "object_id", "a1", "unmeasured"])
    return rnd(wr.read_controls(t.spark, p), "a1", n=9)


@query("read_truth", f"WITH {TRACK_SQL} SELECT video_id, object_id AS truth_id, frame, round(x,6) AS x, round(y,6) AS y FROM track")
def _(t):
    pts = t.track.groupBy("video_id", "object_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("string"), F.array("x", "y")))).alias("track"))
    docs = pts.groupBy("video_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("object_id").alias("id"), F.lit("point").alias("kind"), F.lit(40.0).alias("contrast"), "track")).alias("plants"))).alias("value"))
    return rnd(rd.read_truth(docs).select("video_id", "truth_id", "frame", "x", "y"), "x", "y")


@query("expand_video_list", "SELECT DISTINCT 'v'||o_custkey||':'||CASE WHEN o_orderkey%2=0 THEN o_custkey||'-'||(o_custkey+100) ELSE '' END AS unit_id FROM orders WHERE o_orderkey%2=0 AND o_custkey%5<>0 UNION SELECT DISTINCT 'v'||o_custkey FROM orders WHERE o_orderkey%2=1 AND o_custkey%5<>0")
def _(t):
    name = F.concat(F.lit("v"), F.col("o_custkey").cast("string"))
    win = F.concat(F.lit(":"), F.col("o_custkey").cast("string"), F.lit("-"), (F.col("o_custkey") + 100).cast("string"))
    lines = t.orders.select(F.when(F.col("o_orderkey") % 2 == 0, F.concat(name, win, F.lit(" # a note"))).otherwise(name).alias("line"))
    cat = t.customer.select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("path"))
    units = rd.expand_video_list(lines, cat)
    done = t.orders.where("o_custkey % 5 = 0").select(F.when(F.col("o_orderkey") % 2 == 0, F.concat(name, win)).otherwise(name).alias("unit_id"))
    return rd.expand_video_list(lines, cat, done).select("unit_id")


@query("expand_interval_specs", "SELECT o_orderkey, unnest([0,1]) AS pos, unnest([o_custkey, o_custkey+500]) AS first, unnest([o_custkey+99, o_custkey+500]) AS last, unnest(['3','gate gone']) AS value, unnest(['interval','event']) AS kind, unnest([3.0,NULL]::DOUBLE[]) AS number FROM orders")
def _(t):
    c = F.col("o_custkey")
    spec = F.concat(c.cast("string"), F.lit("-"), (c + 99).cast("string"), F.lit(":3, "), (c + 500).cast("string"), F.lit(":gate gone"))
    return rd.expand_interval_specs(t.orders.select("o_orderkey", spec.alias("spec")))


@query(
    "expand_row_specs",
    "SELECT o_orderkey, unnest([0,1,2]) AS pos, unnest([o_custkey,0,NULL]) AS first, unnest([o_custkey+95,40,NULL]) AS last, unnest([o_orderkey%7+1,1,NULL]) AS frame0, unnest([o_orderkey%7+165,NULL,NULL]) AS frame1 FROM orders",
)
def _(t):
    c, k = F.col("o_custkey"), F.col("o_orderkey") % 7
    spec = F.concat_ws(":", c, c + 95, k + 1, k + 165)
    return rd.expand_row_specs(t.orders.select("o_orderkey", F.concat(spec, F.lit(", 0:40,7:x")).alias("spec")))


@query("write_corpus", "SELECT o_orderstatus AS release, count(*) AS n, count(CASE WHEN object IS NOT NULL THEN 1 END) AS objects FROM (SELECT o_orderstatus, l_linenumber AS object FROM orders LEFT JOIN lineitem ON o_orderkey=l_orderkey) GROUP BY ALL")
def _(t):
    v = dealt(t.orders.select(F.col("o_orderkey").alias("video_id"), F.col("o_orderstatus").alias("release")), "video_id")
    o = dealt(t.lineitem.select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("object")), "video_id").join(v, "video_id")
    p = place(t, "corpus")
    wr.write_corpus(wr.corpus_rows(o, v), p)
    return t.spark.read.parquet(p).groupBy("release").agg(F.count(F.lit(1)).alias("n"), F.count("object").alias("objects"))


@query("rows_with_empty", "SELECT o_orderkey AS video_id, l_linenumber AS object, count(*) AS n FROM orders LEFT JOIN lineitem ON o_orderkey=l_orderkey GROUP BY ALL")
def _(t):
    v = t.orders.select(F.col("o_orderkey").alias("video_id"))
    o = t.lineitem.select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("object")).join(v, "video_id", "left_semi")
    return wr.corpus_rows(o, v).groupBy("video_id", "object").agg(F.count(F.lit(1)).alias("n"))


@query("save_model", "SELECT event_type AS rate, count(*) AS n, round(avg(value),6) AS mean FROM events GROUP BY ALL")
def _(t):
    p = place(t, "model")
    b = t.events.select(F.col("event_type").alias("rate"), "value", F.col("user_id").alias("video_id"), F.lit(0).alias("bin"))
    wr.save_model(b, st.noise_levels(b, [["rate"]], "bin"), st.tail_fit(t.events, [], "value", 0.9), p)
    back, _, _ = wr.open_model(t.spark, p)
    return rnd(back.groupBy("rate").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")), "mean")


@query("camera_events", "SELECT user_id AS video_id, event_id AS frame, event_type AS kind FROM events WHERE event_type IN ('click','error')")
def _(t):
    e = t.events.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame"), F.col("event_type").alias("kind"), F.col("props").alias("what"), F.col("value").alias("before"), F.col("value").alias("after"))
    p = place(t, "camera")
    wr.write_events(e, p)
    return wr.as_camera_events(t.spark.read.parquet(p), ["click", "error"]).select("video_id", "frame", "kind")


@query("write_frame_series", f"WITH {FRAMES_SQL} SELECT video_id, frame, round(level,6) AS level FROM frames")
def _(t):
    p = place(t, "frames")
    wr.write_frame_series(t.frames, p)
    return rnd(t.spark.read.parquet(p).select("video_id", "frame", "level"), "level")


@query("units_chosen", "SELECT DISTINCT o_custkey AS unit_id FROM orders WHERE o_orderstatus='F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P')")
def _(t):
    u = t.orders.select(F.col("o_custkey").alias("unit_id")).distinct()
    pick = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("unit_id"))
    return wr.units_chosen(u, pick("F"), pick("P"))


@query("shared_frames", f"WITH {TRACK_SQL} SELECT object_id, count(CASE WHEN EXISTS (SELECT 1 FROM track b WHERE b.video_id=track.video_id AND b.frame=track.frame AND b.object_id%2=0) THEN 1 END) AS both_, count(*) AS all_ FROM track WHERE object_id%2=1 GROUP BY ALL")
def _(t):
    a, b = t.track.where("object_id % 2 = 1"), t.track.where("object_id % 2 = 0")
    yes, no = wr.shared_frames(a, b)
    d = yes.select("object_id", F.lit(1).alias("k")).unionByName(no.select("object_id", F.lit(0).alias("k")))
    return d.groupBy("object_id").agg(F.sum("k").alias("both_"), F.count(F.lit(1)).alias("all_"))


@query("kept_points", f"WITH {TRACK_SQL} SELECT t.* FROM track t WHERE frame BETWEEN 100 AND 600 AND NOT (x > 100)")
def _(t):
    from skyloom.operators.rank import kept_points

    return kept_points(t.track, t.track.where("x > 100"), 100, 600)
