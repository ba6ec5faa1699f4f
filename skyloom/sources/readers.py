"""Readers of measurement files: tables whose columns go by several names, nested case documents, interval lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME = ("frame", "n", "frame_n")
X = ("x_px", "x", "x1", "grp_x")
Y = ("y_px", "y", "y1", "grp_y")
KN = 0.514444
T_LAYER = 280.0  # K: mean temperature of a layer between pressure levels


def read_aliased(spark: SparkSession, path: str | Sequence[str], key: Sequence[str], wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Many CSV files, each with its own header: blank lines and ``#`` lines skipped, each wanted column taken from the
    first alias its file's header has (text; null where none).  ``key``: names one of which every header holds.

    The lines are read as text so that files of different headers go through one scan; each file's header is one row,
    joined back by file."""
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.text(paths).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    cells = F.transform(F.split("line", ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    lines = lines.select("file", cells.alias("c"))
    head = F.exists("c", lambda c: F.lower(c).isin(*key))
    heads = lines.where(head).select("file", F.transform("c", lambda c: F.lower(c)).alias("h")).dropDuplicates(["file"])
    d = lines.where(~head).join(heads, "file")
    pick = lambda names: F.coalesce(*[F.nullif(F.get("c", F.array_position("h", n).cast("int") - 1), F.lit("")) for n in names])
    return d.select("file", *[pick(v).alias(k) for k, v in wanted.items()])


def number(c: str) -> Column:
    """A finite double or null."""
    v = F.col(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def read_tracks(spark: SparkSession, path) -> DataFrame:
    """S1. Track files: frame, x, y under any alias; rows without a place dropped."""
    d = read_aliased(spark, path, FRAME, {"frame": FRAME, "x": X, "y": Y, "source": ("source",)})
    d = d.select("file", F.round(number("frame")).cast("long").alias("frame"), number("x").alias("x"), number("y").alias("y"), "source")
    return d.where(F.col("frame").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())


def read_series(spark: SparkSession, path, value: Sequence[str] = ("value_m", "value", "m"), default_err: float | None = None) -> DataFrame:
    """S2. Readings: frame, value, error (the default where the file has none)."""
    d = read_aliased(spark, path, FRAME, {"frame": FRAME, "value": value, "err": ("err_m", "err_deg", "err", "frame_err")})
    e = number("err")
    return d.select("file", number("frame").cast("long").alias("frame"), number("value").alias("value"), (e if default_err is None else F.coalesce(e, F.lit(default_err))).alias("err")).where(F.col("value").isNotNull())


def read_platform(spark: SparkSession, path) -> DataFrame:
    """S3. Aircraft positions; heights in feet to metres."""
    d = read_aliased(spark, path, FRAME, {"frame": FRAME, "lat": ("lat",), "lon": ("lon",), "alt_m": ("alt_m",), "alt_ft": ("alt_ft",), "heading_deg": ("heading_deg",)})
    return d.select("file", number("frame").cast("long").alias("frame"), number("lat").alias("lat"), number("lon").alias("lon"), F.coalesce(number("alt_m"), number("alt_ft") * 0.3048).alias("alt_m"), number("heading_deg").alias("heading_deg"))


def read_los(spark: SparkSession, path) -> DataFrame:
    """S3. Lines of sight: a ground point, or azimuth and depression, with offsets on the picture."""
    w = {"frame": FRAME, "tgt_lat": ("tgt_lat",), "tgt_lon": ("tgt_lon",), "elev_m": ("tgt_elev_m",), "elev_ft": ("tgt_elev_ft",), "az_deg": ("az_deg",), "dep_deg": ("dep_deg",), "off_right_deg": ("off_right_deg",), "off_down_deg": ("off_down_deg",)}
    d = read_aliased(spark, path, FRAME, w)
    n = lambda c: number(c).alias(c)
    return d.select("file", number("frame").cast("long").alias("frame"), n("tgt_lat"), n("tgt_lon"), F.coalesce(number("elev_m"), number("elev_ft") * 0.3048).alias("tgt_elev_m"), n("az_deg"), n("dep_deg"),
                    F.coalesce(number("off_right_deg"), F.lit(0.0)).alias("off_right_deg"), F.coalesce(number("off_down_deg"), F.lit(0.0)).alias("off_down_deg"))


def read_sightlines(spark: SparkSession, path, cameras: DataFrame | None = None) -> DataFrame:
    """S4. Several cameras' rays: one of three time columns; depression is minus elevation; the camera's place inline or
    from the cameras table; ``error`` says what a ray lacks."""
    w = {"camera": ("camera",), "t_s": ("t_s",), "t_unix_s": ("t_unix_s",), "time_utc": ("time_utc",), "az_deg": ("az_deg",), "el_deg": ("el_deg",), "dep_deg": ("dep_deg",), "lat": ("lat",), "lon": ("lon",), "alt_m": ("alt_m",), "alt_ft": ("alt_ft",)}
    d = read_aliased(spark, path, ("t_s", "t_unix_s", "time_utc"), w)
    iso = F.unix_micros(F.to_timestamp("time_utc")) / 1e6
    d = d.select("file", "camera", F.coalesce(iso, number("t_unix_s"), number("t_s")).alias("t_s"), (F.col("time_utc").isNotNull() | F.col("t_unix_s").isNotNull()).alias("absolute"), number("az_deg").alias("az_deg"),
                 F.coalesce(number("dep_deg"), -number("el_deg")).alias("dep_deg"), number("lat").alias("lat"), number("lon").alias("lon"), F.coalesce(number("alt_m"), number("alt_ft") * 0.3048).alias("alt_m"))
    if cameras is not None:
        c = cameras.select("camera", *[F.col(k).alias(f"_{k}") for k in ("lat", "lon", "alt_m")])
        d = d.join(c, "camera", "left")
        d = d.select(*[F.coalesce(k, f"_{k}").alias(k) if k in ("lat", "lon", "alt_m") else F.col(k) for k in d.columns if not k.startswith("_")])
    return d.withColumn("error", F.when(F.col("t_s").isNull(), "no time").when(F.col("lat").isNull() | F.col("lon").isNull(), "no place for the camera").when(F.col("az_deg").isNull() | F.col("dep_deg").isNull(), "no direction"))


def read_winds(docs: DataFrame, text: str = "value") -> DataFrame:
    """S5. Hourly wind documents whose keys hold the level (wind_speed_700hPa, wind_speed_100m): one row an hour and
    level.  Pressure levels stand at their geopotential height, or by the hypsometric equation from the nearest level
    that has one; height levels stand over the document's ground; a level without a wind is left out that hour."""
    schema = "latitude double, longitude double, elevation double, hourly map<string, array<string>>"
    ids = [c for c in docs.columns if c != text]
    # rows of equal text and other columns are one document; of equal text alone, two
    d = docs.withColumn("_j", F.from_json(text, schema)).withColumn("_id", F.xxhash64(text, *[F.to_json(F.struct(*ids))] if ids else []))
    k = d.select(*ids, "_id", "_j.elevation", F.col("_j.hourly")["time"].alias("_time"), F.explode("_j.hourly").alias("key", "vals")).where(F.col("key") != "time")
    k = k.select(*ids, "_id", "elevation", "_time", F.regexp_extract("key", r"^(.*)_(\d+)(hPa|m)$", 1).alias("what"), F.regexp_extract("key", r"^(.*)_(\d+)(hPa|m)$", 2).try_cast("int").alias("lev"),
                 F.regexp_extract("key", r"^(.*)_(\d+)(hPa|m)$", 3).alias("unit"), F.posexplode("vals").alias("hour", "val")).where(F.col("lev").isNotNull())
    one = lambda w: F.max(F.when(F.col("what") == w, F.col("val").try_cast("double")))
    h = k.groupBy(*ids, "_id", "unit", "lev", "hour").agg(F.first("elevation").alias("elevation"), F.max(F.get("_time", F.col("hour"))).alias("time"), one("wind_speed").alias("s"), one("wind_direction").alias("a"), one("geopotential_height").alias("z"))
    # a level's height column counts only where every hour of it has one
    placed = h.where((F.col("unit") == "hPa")).groupBy("_id", "lev").agg(F.bool_and(F.col("z").isNotNull()).alias("ok"))
    levs = placed.where("ok").groupBy("_id").agg(F.collect_list("lev").alias("_have"))
    h = h.join(levs, "_id", "left")
    near = F.array_min(F.transform("_have", lambda q: F.struct(F.abs(q - F.col("lev")).alias("d"), q.alias("q"))))["q"]
    own = F.array_contains("_have", F.col("lev"))
    h = h.withColumn("_ref", F.when(F.col("unit") == "hPa", near))
    ref = h.where(F.col("unit") == "hPa").select("_id", "hour", F.col("lev").alias("_ref"), F.col("z").alias("_zr"))
    h = h.join(ref, ["_id", "hour", "_ref"], "left")
    z = F.when(F.col("unit") == "m", F.coalesce("elevation", F.lit(0.0)) + F.col("lev")).when(own, F.col("z")).otherwise(F.col("_zr") - 287.05 * T_LAYER / 9.80665 * F.log(F.col("lev") / F.col("_ref")))
    h = h.withColumn("z_m", z).where(F.col("z_m").isNotNull() & F.col("s").isNotNull() & F.col("a").isNotNull())
    return h.select(*ids, "time", "z_m", (-F.col("s") * KN * F.sin(F.radians("a"))).alias("u"), (-F.col("s") * KN * F.cos(F.radians("a"))).alias("v"), F.lit("model").alias("kind"), F.coalesce("elevation", F.lit(0.0)).alias("ground_m"))


def read_layers(spark: SparkSession, path, layer: str | None = None) -> DataFrame:
    """S6. Pair shifts of a texture layer, with their errors where the file has them."""
    d = read_aliased(spark, path, FRAME, {"frame": FRAME, "k": ("k",), "layer": ("layer", "class"), "dx": ("dx",), "dy": ("dy",), "err_x": ("err_x", "ex"), "err_y": ("err_y", "ey"), "groups": ("groups",)})
    n = lambda c: number(c).alias(c)
    d = d.select("file", number("frame").cast("long").alias("frame"), number("k").cast("int").alias("k"), "layer", n("dx"), n("dy"), n("err_x"), n("err_y"), n("groups"))
    return d if layer is None else d.where(F.col("layer") == layer)


def blocks_as_pairs(blocks: DataFrame, k: int) -> DataFrame:
    """S6. Block velocities (first, last, vx, vy) as the pair shifts that would have given them."""
    return blocks.select(*[c for c in blocks.columns if c not in ("first", "last", "vx", "vy")], F.explode(F.sequence("first", F.col("last") - k)).alias("frame"), (F.col("vx") * k).alias("dx"), (F.col("vy") * k).alias("dy"))


def read_pointer(spark: SparkSession, path, pixel_aspect: float = 1.0) -> DataFrame:
    """S7. North-pointer readings; unsolved frames dropped, the angle and radius rescaled by the pixels' shape.  A pointer of no
    length has the angle of its signed zeros (0, or 180 either way), as C's ``atan2`` has it."""
    d = read_aliased(spark, path, FRAME, {"frame": FRAME, "t_s": ("t_s",), "r_px": ("r_px", "r"), "theta_deg": ("theta_deg", "theta")})
    r, a = number("r_px"), F.radians(number("theta_deg"))
    d = d.where(r.isNotNull() & a.isNotNull())
    x, y = r * F.sin(a) * pixel_aspect, r * F.cos(a)
    # Spark's atan2 takes -0.0 for 0.0
    back = F.when(F.cos(a) < 0, F.when(F.sin(a) < 0, -180.0).otherwise(180.0)).otherwise(0.0)
    theta = F.when(r == 0, back).otherwise(F.degrees(F.atan2(x, y)))
    return d.select("file", number("frame").cast("long").alias("frame"), number("t_s").alias("t_s"), F.hypot(x, y).alias("r"), theta.alias("theta"))


def read_curves(wide: DataFrame, ids: Sequence[str] = ("frame",)) -> DataFrame:
    """S8. A column a curve to long rows; the kind from the name."""
    cols = [c for c in wide.columns if c not in ids]
    d = wide.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(list(ids), cols, "curve", "value")
    return d.withColumn("kind", F.when(F.col("curve").startswith("background"), "background").otherwise("object"))


def read_cases(docs: DataFrame, fields: Mapping[str, tuple[str, str]], text: str = "value") -> DataFrame:
    """S9. Nested case documents: fields by path with a type; a document that cannot be read is a row with ``read_error``."""
    d = docs.withColumn("_v", F.try_parse_json(text))
    got = [F.try_variant_get("_v", path, typ).alias(name) for name, (path, typ) in fields.items()]
    return d.select(*[c for c in docs.columns if c != text], *got, F.when(F.col("_v").isNull(), "unreadable").alias("read_error"))


def objects_of(batch: DataFrame) -> DataFrame:
    """S10. A batch table's rows that are objects."""
    return batch.where(F.col("object").isNotNull() & (F.col("object").cast("string") != ""))


def disclosure_rate(catalog: DataFrame) -> DataFrame:
    """S11. The share of each release's clips with a disclosure."""
    return catalog.groupBy("release").agg(F.count(F.lit(1)).alias("clips"), F.avg(F.col("disclosed").cast("double")).alias("share"))


def catalog_lookup(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """S11. Records by path or id in several spellings: case, leading zeros, separators and the file ending aside."""
    norm = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(c, r"^.*/|\.[A-Za-z0-9]+$", "")), r"[-_ ]", ""), r"(?<=[a-z])0+(?=\d)", "")
    return names.withColumn("_k", norm(F.col("name"))).join(catalog.withColumn("_k", norm(F.col("id"))), "_k", "left").drop("_k")


def unsourced(envelopes: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """S12. Every number of the class table with no source beside it."""
    a = F.array(*[F.struct(F.lit(n).alias("number"), F.col(n).cast("double").alias("value"), F.col(s).alias("src")) for n, s in pairs.items()])
    d = envelopes.select("class", "member", F.explode(a).alias("q"))
    return d.where(F.col("q.value").isNotNull() & (F.coalesce(F.trim("q.src"), F.lit("")) == "")).select("class", "member", "q.number", "q.value")


def read_truth(docs: DataFrame, text: str = "value") -> DataFrame:
    """S14. Planted objects with their place on every frame, from truth documents."""
    schema = "plants array<struct<id:long, kind:string, contrast:double, track:map<string, array<double>>>>"
    d = docs.withColumn("_j", F.from_json(text, schema))
    p = d.select(*[c for c in docs.columns if c != text], F.explode("_j.plants").alias("p"))
    e = p.select(*[c for c in docs.columns if c != text], F.col("p.id").alias("truth_id"), "p.kind", "p.contrast", F.explode("p.track").alias("f", "xy"))
    return e.withColumn("frame", F.col("f").cast("long")).withColumn("x", F.get("xy", F.lit(0))).withColumn("y", F.get("xy", F.lit(1))).drop("f", "xy")


def expand_video_list(lines: DataFrame, catalog: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """S15. ``name[:first-last]`` lines to units: catalog names expanded, duplicates dropped, units already planned left
    out (so that planning again adds only what is new)."""
    t = F.trim(F.regexp_replace("line", r"#.*$", ""))
    d = lines.select(t.alias("_t")).where(F.col("_t") != "")
    d = d.select(F.regexp_extract("_t", r"^([^:]+)(?::(\d+)-(\d+))?$", 1).alias("name"), F.regexp_extract("_t", r":(\d+)-(\d+)$", 1).try_cast("long").alias("n0"), F.regexp_extract("_t", r":(\d+)-(\d+)$", 2).try_cast("long").alias("n1"))
    u = d.join(catalog.select(F.col("id").alias("name"), "path"), "name", "left")
    u = u.withColumn("unit_id", F.concat_ws(":", "name", F.when(F.col("n0").isNotNull(), F.concat_ws("-", F.col("n0").cast("string"), F.col("n1").cast("string")))))
    u = u.dropDuplicates(["unit_id"])
    return u if plan is None else u.join(plan.select("unit_id"), "unit_id", "left_anti")


def expand_interval_specs(specs: DataFrame, text: str = "spec") -> DataFrame:
    """S16. ``1-256:4,271-706:3`` and ``2208:what happened`` to interval and event rows in frame order."""
    d = specs.select(*[c for c in specs.columns if c != text], F.posexplode(F.split(text, ",")).alias("pos", "_p"))
    rx = r"^\s*(\d+)(?:-(\d+))?:(.*)$"
    d = d.select(*[c for c in d.columns if c != "_p"], F.regexp_extract("_p", rx, 1).try_cast("long").alias("first"), F.regexp_extract("_p", rx, 2).try_cast("long").alias("last"), F.trim(F.regexp_extract("_p", rx, 3)).alias("value"))
    return d.withColumn("kind", F.when(F.col("last").isNotNull(), "interval").otherwise("event")).withColumn("last", F.coalesce("last", "first")).withColumn("number", F.col("value").try_cast("double"))


def expand_row_specs(specs: DataFrame, text: str = "spec") -> DataFrame:
    """S16. ``985:1080:1:165,0:40`` to rows of picture lines ``first``, ``last`` and frames ``frame0``, ``frame1``; a part without frames
    holds from the first on, without end.  Parts that aren't two to four numbers have ``first`` null."""
    d = specs.select(*[c for c in specs.columns if c != text], F.posexplode(F.split(text, ",")).alias("pos", "_p"))
    d = d.withColumn("_n", F.split(F.trim("_p"), ":"))
    ok = F.size("_n").between(2, 4) & F.forall("_n", lambda v: v.try_cast("long").isNotNull())
    at = lambda i: F.when(ok, F.get("_n", F.lit(i)).try_cast("long"))
    return d.select(*[c for c in d.columns if c not in ("_p", "_n")], at(0).alias("first"), at(1).alias("last"), F.when(ok, F.coalesce(at(2), F.lit(1))).alias("frame0"), at(3).alias("frame1"))
