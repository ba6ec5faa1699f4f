"""Steps whose shuffles, time or memory grew faster than their tables: results beside brute force, and the form of their plans."""

import math
import random

from pyspark.sql import functions as F

from skyloom.functions.joins import dealt
from skyloom.operators import links, models, readings, series_joins, stats, winds


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_seeds_of_all_gaps_meet_in_one_join(spark):
    rng = random.Random(1)
    rows = [(v, f, 100 * f + i, i % 2, rng.uniform(0, 90), rng.uniform(0, 90), 1.0, 1.0) for v in range(2) for f in range(12) for i in range(6)]
    df = spark.createDataFrame(rows, "video_id long, frame long, peak_id long, polarity int, x double, y double, amp double, size double")
    seeds = links.pair_chain_seeds(df, 20.0)
    want = [(a[0], a[2], b[2], b[1] - a[1]) for a in rows for b in rows if a[0] == b[0] and a[3] == b[3] and 1 <= b[1] - a[1] <= 3 and ((a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2) ** 0.5 <= 20 * (b[1] - a[1])]
    assert sorted((r.video_id, r.peak_id, r.peak_id_2, r.dt) for r in seeds.collect()) == sorted(want)
    assert plan(seeds).count("Join ") == 1


def test_dealt_rows_stay_apart(spark):
    df = dealt(spark.range(5000).withColumnRenamed("id", "k"), "k").join(dealt(spark.range(5000).withColumnRenamed("id", "k"), "k"), "k")
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 150 and df.count() == 5000


def test_consensus_of_places(spark):
    rng = random.Random(2)
    rows = [(0, f, k, float(rng.randrange(50)), float(rng.randrange(11))) for f in range(4) for k in range(60)]
    df = spark.createDataFrame(rows, "video_id long, frame long, k long, dx double, dy double")
    want = []
    mid = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    for f in range(4):
        own = [r for r in rows if r[1] == f]
        near = {r[2]: [b for b in own if abs(r[3] / 6 - b[3] / 6) <= 1 and abs(r[4] / 2.5 - b[4] / 2.5) <= 1] for r in own}
        seed = near[max(near, key=lambda k: (len(near[k]), -k))]
        mx, my = mid([b[3] for b in seed]), mid([b[4] for b in seed])
        m = [b for b in own if abs(b[3] - mx) <= 6 and abs(b[4] - my) <= 2.5]
        if len(m) >= 8:
            want.append((f, len(m), round(sum(b[3] for b in m) / len(m), 6), round(sum(b[4] for b in m) / len(m), 6)))
    got = readings.consensus_shift(df)
    assert sorted((r.frame, r.members, round(r.dx, 6), round(r.dy, 6)) for r in got.collect()) == want
    assert not hasattr(readings, "near_pairs")  # nine copies of every template


def test_equal_heights_ask_the_model_once(spark):
    rng = random.Random(3)
    own = [(0, 3600 * (i % 3), float(rng.randrange(9)), rng.random(), rng.random()) for i in range(200)]
    air = [(0, 3600 * (i % 3), float(i), rng.random(), rng.random()) for i in range(9) if i % 3 != 1]
    air += [(0, 3600 * h, z, 1.0, 2.0) for h in range(3) for z in (0.5, 7.5)]
    cols = "station long, t_s long, z_m double, u double, v double"
    out = winds.model_wind_error(spark.createDataFrame(own, cols), spark.createDataFrame(air, cols), [4])
    want = {}
    for _, t, z, _, _ in own:
        for lag in (0, 1):
            zs = [a[2] for a in air if a[1] == t - 3600 * lag]
            if any(a <= z for a in zs) and any(a >= z for a in zs):
                want[lag, int(z >= 4)] = want.get((lag, int(z >= 4)), 0) + 1
    assert {(r.lag_h, r.band): r.levels for r in out.collect()} == want


def test_readings_name_the_path_they_follow(spark):
    rng = random.Random(4)
    path = [(s, f, rng.random()) for s in "ab" for f in range(60)]
    read = [(v, "ab"[v % 2], f, rng.random()) for v in range(5) for f in range(8, 50, 1 + v)]
    p = spark.createDataFrame(path, "scene string, frame long, x double")
    r = spark.createDataFrame(read, "video_id long, scene string, frame long, theta double")
    each = r.select("video_id", "scene").distinct().join(p, "scene").drop("scene")
    want = series_joins.lead_lag(r.drop("scene"), each, range(-3, 4))
    got = series_joins.lead_lag(r, p, range(-3, 4), scene=["scene"])
    rows = lambda d: sorted((x.video_id, x.lag, round(x.c, 9), x.n) for x in d.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 5


def test_rhythms_are_summed_track_by_track(spark):
    rows = [(v, v, f, f / 30, float(f % 5), float(f % 3)) for v in range(3) for f in range(40)]
    df = spark.createDataFrame(rows, "video_id long, object_id long, frame long, t_s double, x double, y double")
    out = models.position_rhythm(df, df.where("frame % 9 = 0").select("video_id", "frame"), ["video_id", "object_id"], [6.0, 10.0])
    assert "RepartitionByExpression" in plan(out)
    assert {(r.video_id, r.axis, r.hz, r.n) for r in out.collect()} == {(v, a, h, 35) for v in range(3) for a in "xy" for h in (6.0, 10.0)}


def test_families_of_short_and_long_videos(spark):
    rng = random.Random(5)
    rows = []
    for v in range(12):
        tones = [f * k * rng.uniform(0.999, 1.001) for f in rng.sample((20.8, 46.875, 50.0, 60.0, 97.0, 210.0, 400.0), 4) for k in range(1, 9)]
        rows += [(v, i, hz, float(rng.randrange(1, 9))) for i, hz in enumerate(tones + [rng.uniform(5, 900) for _ in range(10 * v)])]
    df = spark.createDataFrame(rows, "video_id long, line_id long, hz double, strength double").repartition(7)
    told = lambda d: sorted((r.video_id, r.line_id, r.family, round(r.f0, 6), r.k) for r in d.collect())
    short = told(readings.line_families(df))
    assert len(short) > 100 and short == told(readings.line_families(df, few=80)) == told(readings.line_families(df, few=0))
    # votes, dozens a line, meet no shuffle: lines alone are dealt
    assert "Generate" not in plan(readings.line_families(df)) and "MapInPandas" in plan(readings.line_families(df))


def test_bodies_are_planted_in_every_wind(spark):
    rng = random.Random(6)
    paths = [(c, 0, [100.0, 900.0, 5000.0][c % 3], 0.0, 0.0, 0.0, [0.2, 1.0, 4.0, None][c % 4]) for c in range(24)]
    air = [(f"s{i}", "model", 0, z, rng.uniform(-9, 9), rng.uniform(-9, 9), 0.0) for i in range(4) for z in (50.0, 1000.0)]
    p = spark.createDataFrame(paths, "case_id long, t_s long, height_m double, ground_m double, ve double, vn double, velocity_err double")
    w = spark.createDataFrame(air, "source string, kind string, t_s long, z_m double, u double, v double, ground_m double")
    by_case = winds.wind_at_height(p, w).withColumn("err_m_s", F.lit(None).cast("double")).cache()
    want = {}
    for r in by_case.where("counts").collect():  # each wind in turn is the air of all cases
        for s in (0.0, 8.0, 30.0):
            for a in (0.0, 90.0):
                want.setdefault((s, a), []).append((r.case_id, r.u + s * math.sin(math.radians(a)), r.v + s * math.cos(math.radians(a))))
    err = {c[0]: c[6] for c in paths}
    count = {}
    for (s, a), planted in want.items():
        q = [(i, c, ve, vn, err[c]) for i, (c, ve, vn) in enumerate(planted)]
        each = spark.createDataFrame(q, "case_id long, c long, ve double, vn double, velocity_err double")
        for r in winds.drift_wind_test(each, by_case.withColumnRenamed("case_id", "c"), ["c"]).collect():
            for k in ("all", r.outcome, r.why):
                count[s, k] = count.get((s, k), 0) + 1
    for place, ws in ((("case_id",), by_case), (winds.PLACE, winds.winds_at(p, w).withColumn("err_m_s", F.lit(None).cast("double")))):
        got = winds.wind_test_sensitivity(p, ws, [0, 8, 30], [0, 90], place).collect()
        assert sorted(r.airspeed for r in got) == [0, 8, 30]
        for r in got:
            assert r.plants == count[r.airspeed, "all"] == 4 * r.n
            assert [round(r.plants * x) for x in (r.passes, r.fails, r.cannot_say)] == [count.get((r.airspeed, k), 0) for k in ("pass", "fail", "cannot say")]
            assert [round(r.plants * r[y.replace(" ", "_")]) for y in winds.WHYS] == [count.get((r.airspeed, y), 0) for y in winds.WHYS]


def test_models_of_short_and_long_groups(spark):
    rng = random.Random(7)
    rows = [(k, f"o{k % 3}", m, i + 1, rng.expovariate(1) + 0.3 * (m == "b") + (2.0 if m == "c" else 0.0)) for k in range(9) for m in "abc" for i in range(3 + 9 * k)]
    rows += [(20, "o", m, i, rng.expovariate(1)) for m in "ab" for i in range(1, 30) if (m, i) != ("b", 7)]  # not the same origins
    df = spark.createDataFrame(rows, "k long, o string, model string, idx long, loss double").repartition(5)
    told = lambda d: sorted((r.k, r.o, r.model, round(r.loss, 9), round(r.p, 9), r.kept) for r in d.collect())
    short = told(stats.model_confidence(df, ["k", "o"], 4, 60))
    assert {r[0] for r in short} == {*range(1, 9), 20}
    assert short == told(stats.model_confidence(df, ["k", "o"], 4, 60, few=40)) == told(stats.model_confidence(df, ["k", "o"], 4, 60, few=0))
    whole = plan(stats.model_confidence(df.where("k < 20"), ["k", "o"], 4, 60))
    assert "MapInPandas" in whole and "Join" not in whole  # no block is written
