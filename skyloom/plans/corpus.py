"""Measurement tables derived from the given tables.

The operators work on tracks, frame series, curves and axes.  The given tables hold orders, shipments, events and
texts; each function here reads one of them as the measurement table it can stand for, pre-aggregated before any
shuffle.  The ``*_SQL`` strings are the same derivations for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC, the events' first hour


def seconds(ts: str) -> F.Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def track(events: DataFrame) -> DataFrame:
    """One point per user and hour (the hour's last event): ten users share a video, x is the value, y the key."""
    e = events.select(
        F.floor(F.col("user_id") / 10).alias("video_id"),
        F.col("user_id").alias("object_id"),
        (F.floor((seconds("ts") - EPOCH) / 3600) + 1).alias("frame"),
        "event_id",
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
    )
    return (
        e.groupBy("video_id", "object_id", "frame")
        .agg(F.max_by(F.struct("x", "y"), "event_id").alias("p"))
        .select("video_id", "object_id", "frame", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    )


TRACK_SQL = f"""
track AS (
  SELECT CAST(floor(user_id/10) AS BIGINT) AS video_id, user_id AS object_id, frame,
         arg_max(value, event_id) AS x, arg_max(k, event_id) AS y
  FROM (SELECT *, CAST(floor((floor(epoch(ts)) - {EPOCH})/3600) AS BIGINT) + 1 AS frame,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
  GROUP BY ALL)"""

DAY0 = "1995-01-01"


def frames(lineitem: DataFrame) -> DataFrame:
    """A frame a day, a video per flag and status: picture level and contrast from the day's quantities."""
    d = lineitem.select(
        F.concat("l_returnflag", "l_linestatus").alias("video_id"),
        F.datediff(F.to_date("l_shipdate"), F.lit(DAY0).cast("date")).cast("long").alias("frame"),
        F.col("l_quantity").cast("long").alias("q"),
    )
    return (
        d.groupBy("video_id", "frame")
        .agg(F.count("q").alias("n"), F.sum("q").alias("s"), F.sum(F.col("q") * F.col("q")).alias("ss"))
        .select(
            "video_id",
            "frame",
            (F.col("s") / F.col("n")).alias("level"),
            F.sqrt((F.col("ss") * F.col("n") - F.col("s") * F.col("s")).cast("double")).alias("_sd"),
            "n",
        )
        .select("video_id", "frame", "level", (F.col("_sd") / F.col("n")).alias("sd"))
    )


FRAMES_SQL = f"""
frames AS (
  SELECT video_id, frame, s/n AS level, sqrt(CAST(ss*n - s*s AS DOUBLE))/n AS sd FROM (
    SELECT l_returnflag||l_linestatus AS video_id, CAST(CAST(l_shipdate AS DATE) - DATE '{DAY0}' AS BIGINT) AS frame,
           count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS s, CAST(sum(l_quantity*l_quantity) AS BIGINT) AS ss
    FROM lineitem GROUP BY ALL))"""


def frame_stats(frames_: DataFrame) -> DataFrame:
    """``frames`` with a dense index and the change from the frame before."""
    from skyloom.functions.chunked import scan

    d = scan(
        frames_, ["video_id"], "frame", {"idx": ("count", F.lit(1)), "_p": ("last", F.col("level"))}, exclusive=True
    )
    return d.withColumn("idx", F.col("idx") + 1).withColumn("diff", F.abs(F.col("level") - F.col("_p"))).drop("_p")


STATS_SQL = (
    FRAMES_SQL
    + """,
stats AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS idx,
                 abs(level - lag(level) OVER (PARTITION BY video_id ORDER BY frame)) AS diff FROM frames)"""
)


def curves(lineitem: DataFrame) -> DataFrame:
    """A curve a line number: line 1 is the object's brightness, the others its background apertures."""
    d = lineitem.select(
        F.concat("l_returnflag", "l_linestatus").alias("video_id"),
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("curve"),
        F.datediff(F.to_date("l_shipdate"), F.lit(DAY0).cast("date")).cast("long").alias("frame"),
        F.col("l_quantity").cast("long").alias("q"),
    )
    return (
        d.groupBy("video_id", "curve", "frame")
        .agg((F.sum("q") / F.count("q")).alias("value"))
        .withColumn("kind", F.when(F.col("curve") == "L1", "object").otherwise("background"))
    )


CURVES_SQL = f"""
curves AS (
  SELECT video_id, curve, frame, s/n AS value, CASE WHEN curve='L1' THEN 'object' ELSE 'background' END AS kind FROM (
    SELECT l_returnflag||l_linestatus AS video_id, 'L'||l_linenumber AS curve,
           CAST(CAST(l_shipdate AS DATE) - DATE '{DAY0}' AS BIGINT) AS frame,
           count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS s
    FROM lineitem GROUP BY ALL))"""


def scene_of(frames_: DataFrame, videos: DataFrame, shift: int = 0) -> DataFrame:
    """Which ``scene`` is each video's own: the frame series whose place in order is the video's number plus ``shift``, counted round."""
    w = Window.orderBy("scene")  # one row a frame series
    names = frames_.select(F.col("video_id").alias("scene")).distinct()
    names = names.withColumn("_i", F.row_number().over(w) - 1)
    count = names.agg(F.count(F.lit(1)).alias("_n"))
    v = videos.select("video_id").distinct().crossJoin(count).withColumn("_i", F.pmod(F.col("video_id") + shift, F.col("_n")))
    return v.join(names, "_i").select("video_id", "scene")


def own_scene(frames_: DataFrame, videos: DataFrame, shift: int = 0) -> DataFrame:
    """The frames of each video's own scene."""
    return scene_of(frames_, videos, shift).join(frames_.withColumnRenamed("video_id", "scene"), "scene").drop("scene")


def own_scene_sql(name: str, videos: str, shift: int = 0) -> str:
    """The same in SQL: a table ``name`` of ``video_id, frame, level, sd`` for the videos that ``videos`` selects."""
    return f"""
{name} AS (SELECT v.video_id, f.frame, f.level, f.sd FROM ({videos}) v
  JOIN (SELECT video_id AS scene, row_number() OVER (ORDER BY video_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT video_id FROM frames)) s ON (v.video_id + {shift}) % s.n = s.i
  JOIN frames f ON f.video_id = s.scene)"""


def axes(embeddings: DataFrame) -> DataFrame:
    """Objects with a class (label), a video (ten neighbours) and axes a1..a4; a4 is missing on every seventh."""
    return embeddings.select(
        F.col("vec_id").alias("object_id"),
        F.floor(F.col("vec_id") / 10).alias("video_id"),
        F.col("label").cast("string").alias("class"),
        *[F.col("embedding")[i].cast("double").alias(f"a{i + 1}") for i in range(3)],
        F.when(F.col("vec_id") % 7 != 0, F.col("embedding")[3].cast("double")).alias("a4"),
        F.abs(F.col("embedding")[4].cast("double")).alias("contrast"),
    )


AXES_SQL = """
axes AS (
  SELECT vec_id AS object_id, CAST(floor(vec_id/10) AS BIGINT) AS video_id, CAST(label AS VARCHAR) AS class,
         CAST(embedding[1] AS DOUBLE) AS a1, CAST(embedding[2] AS DOUBLE) AS a2, CAST(embedding[3] AS DOUBLE) AS a3,
         CASE WHEN vec_id % 7 <> 0 THEN CAST(embedding[4] AS DOUBLE) END AS a4,
         abs(CAST(embedding[5] AS DOUBLE)) AS contrast FROM embeddings)"""
