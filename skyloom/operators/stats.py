"""Corpus statistics: tallies, intervals, resampling by video, discovery control, tails, pooled scales, splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions.safe import div
from skyloom.functions import draws as dr
from skyloom.functions.chunked import scan
from skyloom.functions.joins import dealt
from skyloom.functions.lineage import share
from skyloom.functions.probability import chi2_sf, clopper_pearson_upper, gpd_sf, kolmogorov_sf, wilson
from skyloom.functions.quantiles import exact_quantiles


def corpus_tally(rows: DataFrame, facets: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """A1. Counts by each facet on its own, in one pass: grouping sets ((f1), (f2), ...)."""
    g = rows.groupingSets([[F.col(f)] for f in facets], *[F.col(f) for f in facets]).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in measures.items()], F.grouping_id().alias("_g")
    )
    # the grouping id has a 0 bit for the facet grouped by, the first facet highest
    bit = {f: 2 ** (len(facets) - 1 - i) for i, f in enumerate(facets)}
    full = 2 ** len(facets) - 1
    name = F.coalesce(*[F.when(F.col("_g") == full - b, F.lit(f)) for f, b in bit.items()])
    val = F.coalesce(*[F.when(F.col("_g") == full - b, F.col(f).cast("string")) for f, b in bit.items()])
    return g.select(name.alias("facet"), val.alias("value"), "n", *measures.keys())


def completeness_by_cell(rows: DataFrame, sets: Sequence[Sequence[str]], found: str) -> DataFrame:
    """A6. n, found, share and Wilson interval by every set of cells, one pass (grouping sets)."""
    cols = sorted({c for s in sets for c in s})
    g = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(found).cast("long")).alias("found"), F.grouping_id().alias("cells")
    )
    lo, hi = wilson(F.col("found").cast("double"), F.col("n").cast("double"))
    return g.select(*cols, "cells", "n", "found", (F.col("found") / F.col("n")).alias("share"), lo.alias("low"), hi.alias("high"))


def exact_upper_bound(counts: DataFrame, wrong: str, drawn: str, level: float = 0.95) -> DataFrame:
    """A8. Exact one-sided bound of each (aggregated) row's share."""
    return counts.withColumn("upper", clopper_pearson_upper(F.col(wrong), F.col(drawn), F.lit(level)))


def cluster_bootstrap(totals: DataFrame, keys: Sequence[str], unit: str, sums: Sequence[str], draws: int, seed: int = 0) -> DataFrame:
    """A20. Sums of every draw over whole videos: each video counts a Poisson(1) number of times, hashed from
    (seed, video, draw).  ``totals`` holds one row a video and key, so the raw rows are never multiplied; the draws are
    summed before the shuffle, so what moves is ``draws`` rows a task."""
    d = totals.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    w = dr.poisson1(dr.uniform(seed, F.col(unit), F.col("draw")))
    return d.withColumn("_w", w).groupBy(*keys, "draw").agg(*[F.sum(F.col(s) * F.col("_w")).alias(s) for s in sums])


def share_interval(totals: DataFrame, keys: Sequence[str], unit: str, hit: str, n: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """A20. A share and its 95 % interval by resampling videos whole."""
    totals = share(totals)
    b = cluster_bootstrap(totals, keys, unit, [hit, n], draws, seed).withColumn("_s", F.col(hit) / F.greatest(F.col(n), F.lit(1)))
    q = b.groupBy(*keys).agg(F.percentile("_s", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))  # ``draws`` values a key
    t = totals.groupBy(*keys).agg(F.sum(hit).alias("k"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("videos"))
    j = t.join(q, list(keys)) if keys else t.crossJoin(F.broadcast(q))
    return j.select(*keys, "k", "n", "videos", (F.col("k") / F.col("n")).alias("share"), F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


def likelihood_ratio(tracks: DataFrame, least: int = 10, draws: int = 2000, seed: int = 0) -> DataFrame:
    """A9. How many times as common each answer is on birds as on the rest, 95 % by resampling clips, and its weight.
    ``tracks``: clip, bird (boolean), answer."""
    tot = share(tracks.groupBy("clip", "bird", "answer").agg(F.count(F.lit(1)).alias("k")))
    answers = tot.select("answer").distinct()
    clips = tot.groupBy("clip", "bird").agg(F.sum("k").alias("n"))
    t = clips.crossJoin(F.broadcast(answers)).join(tot, ["clip", "bird", "answer"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    t = share(t.select("answer", "clip", "bird", F.when(F.col("bird"), F.col("k")).otherwise(0).alias("kb"), F.when(F.col("bird"), F.col("n")).otherwise(0).alias("nb"),
                       F.when(~F.col("bird"), F.col("k")).otherwise(0).alias("ko"), F.when(~F.col("bird"), F.col("n")).otherwise(0).alias("no")))
    t = t.withColumn("unit", F.concat_ws("/", "clip", F.col("bird").cast("string")))
    ratio = lambda: F.when((F.col("ko") > 0) & (F.col("nb") > 0), (F.col("kb") / F.col("nb")) / (F.col("ko") / F.col("no"))).when(F.col("kb") > 0, F.lit(float("inf")))
    cols = ["kb", "nb", "ko", "no"]
    pt = t.groupBy("answer").agg(*[F.sum(c).alias(c) for c in cols]).withColumn("lr", ratio())
    b = cluster_bootstrap(t, ["answer"], "unit", cols, draws, seed).withColumn("_l", ratio()).where(F.col("_l").isNotNull())
    q = b.groupBy("answer").agg(F.percentile("_l", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    j = pt.join(q, "answer", "left")
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    weight = F.when(F.col("kb") + F.col("ko") < least, "no power").when(lo > 1, "for").when(hi < 1, "against").otherwise("none")
    return j.select("answer", *cols, "lr", lo.alias("lo"), hi.alias("hi"), weight.alias("weight"))


def screen_counts(objects: DataFrame, members: DataFrame, lo_hz: float = 2.0, hi_hz: float = 25.0) -> DataFrame:
    """A10. Of the labelled members with a rhythm of their own in the band, how many beat at least as strongly as each
    object, birds and the rest; the exact bound where none of the rest does.

    The members are ranked by amplitude once: an object's counts are those of the next member at or above it."""
    m = members.where(F.col("hz").between(lo_hz, hi_hz)).groupBy("amplitude").agg(
        F.sum(F.col("bird").cast("long")).alias("b"), F.sum((~F.col("bird")).cast("long")).alias("o")
    )
    tot = m.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("nb"), F.coalesce(F.sum("o"), F.lit(0)).alias("no"))
    judged = members.agg(F.sum((~F.col("bird")).cast("long")).alias("n_all"))
    obj = objects.where(F.col("hz").between(lo_hz, hi_hz) & F.col("amplitude").isNotNull())
    bucket = lambda: F.floor(F.log2(F.greatest("amplitude", F.lit(1e-300))) * 64).cast("long")
    both = obj.select("object_id", "amplitude", F.lit(0).alias("b"), F.lit(0).alias("o"), F.lit(1).alias("_s")).unionByName(
        m.select(F.lit(None).cast("long").alias("object_id"), "amplitude", "b", "o", F.lit(0).alias("_s"))
    )
    # members strictly under the object's amplitude come before it; equal ones after it count as at least as strong
    both = both.withColumn("_k", F.when(F.col("_s") == 1, 0).otherwise(1))
    s = scan(both, [], "amplitude", {"_cb": ("sum", F.col("b")), "_co": ("sum", F.col("o"))}, ties=["_k"], pos_chunk=bucket())
    s = s.where(F.col("_s") == 1).crossJoin(F.broadcast(tot)).crossJoin(F.broadcast(judged))
    ko = F.col("no") - F.col("_co")
    return s.select(
        "object_id", (F.col("nb") - F.col("_cb")).alias("birds"), "nb", ko.alias("others"), "no",
        F.when(ko == 0, 1 - F.pow(F.lit(0.05), 1.0 / F.col("n_all"))).alias("bound"),
    )


# ---- discoveries ------------------------------------------------------------------------------------------------------
def _plog(p: Column) -> Column:
    """A bucket of p that falls as p grows: finer towards 0, so that no bucket holds much of any p-value table."""
    return F.floor(-F.log2(F.greatest(p, F.lit(1e-300))) * 256).cast("long")


def false_discovery(tests: DataFrame, p: str) -> DataFrame:
    """A16. Benjamini-Hochberg and Benjamini-Yekutieli q-values over a whole table (a null p counts as 1).

    Equal p-values are counted together first; ranks and the running minimum then run over buckets of p in both
    directions, so the global order is never put into one task."""
    t = tests.withColumn("_p", F.coalesce(F.when(~F.isnan(p), F.col(p)), F.lit(1.0)))
    cnt = t.groupBy("_p").agg(F.count(F.lit(1)).alias("_k"))
    r = scan(cnt, [], "_p", {"_rank": ("sum", F.col("_k"))}, pos_chunk=-_plog(F.col("_p")))
    m = share(cnt).agg(F.sum("_k").alias("_m"))
    r = r.crossJoin(F.broadcast(m)).withColumn("_neg", -F.col("_p")).withColumn("_raw", F.col("_p") * F.col("_m") / F.col("_rank"))
    r = scan(r, [], "_neg", {"_adj": ("min", F.col("_raw"))}, pos_chunk=_plog(F.col("_p")))
    # 1 + 1/2 + ... + 1/m: summed below ten thousand, by its expansion beyond (good to 1e-15 there)
    mm = F.col("_m").cast("double")
    small = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.col("_m"), F.lit(10000))), F.lit(0.0), lambda a, i: a + 1.0 / i)
    c = F.when(F.col("_m") <= 10000, small).otherwise(F.log(mm) + 0.5772156649015329 + 1 / (2 * mm) - 1 / (12 * mm * mm))
    q = r.withColumn("_c", c).select("_p", F.least("_adj", F.lit(1.0)).alias("q_bh"), F.least(F.col("_adj") * F.col("_c"), F.lit(1.0)).alias("q_by"))
    return t.join(q, "_p").drop("_p")


def per_video(tests: DataFrame, p: str, ident: str) -> DataFrame:
    """A16. One test a video: its smallest p times how many it had (at most 1)."""
    t = tests.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0)))
    g = t.groupBy("video_id").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("_p", ident)).alias("b"))
    return g.select("video_id", "m", F.least(F.lit(1.0), F.col("b._p") * F.col("m")).alias("p"), F.col(f"b.{ident}").alias(ident))


def by_row(tests: DataFrame, keys: Sequence[str], p: str, name: str) -> DataFrame:
    """A16. A row's p: the smallest of its members' times how many have one."""
    g = tests.where(F.col(p).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(p, name)).alias("b"))
    return g.select(*keys, "members", F.least(F.lit(1.0), F.col(f"b.{p}") * F.col("members")).alias("p"), F.col(f"b.{name}").alias("best"))


# ---- noise model ------------------------------------------------------------------------------------------------------
def _levels(rows: DataFrame, factors: Sequence[Sequence[str]], binc: str) -> DataFrame:
    """Every row in each of its strata (one a fallback level): level number, stratum name."""
    strata = F.array(*[
        F.struct(F.lit(i).alias("level"), F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("-")) for f in fs]).alias("stratum"))
        for i, fs in enumerate(factors)
    ])
    return rows.select("video_id", binc, "value", F.explode(strata).alias("_s")).select("video_id", binc, "value", "_s.level", "_s.stratum")


def noise_levels(rows: DataFrame, factors: Sequence[Sequence[str]], binc: str, probs=(0.5, 0.9, 0.99), least: int = 10, grain: float = 8.0) -> DataFrame:
    """A18. Weighted quantiles of the backgrounds' values at each bin in every stratum of every level, each *video*
    weighing the same: the smallest value at which the summed weight reaches the share.  Equal values of a video are
    counted together; the running weight goes over slices of value (``grain`` a unit)."""
    d = share(_levels(rows, factors, binc).groupBy("level", "stratum", binc, "video_id", "value").agg(F.count(F.lit(1)).alias("_k")))
    k = ["level", "stratum", binc]
    per = d.groupBy(*k, "video_id").agg(F.sum("_k").alias("_n"))
    vids = per.groupBy(*k).agg(F.count(F.lit(1)).alias("videos"), F.sum("_n").alias("apertures")).where(F.col("videos") >= least)
    wt = d.join(per, [*k, "video_id"]).join(vids.select(*k), k, "left_semi").withColumn("_w", F.col("_k") / F.col("_n"))
    v = wt.groupBy(*k, "value").agg(F.sum("_w").alias("_w"))
    c = scan(v, k, "value", {"_cw": ("sum", F.col("_w"))}, pos_chunk=F.floor(F.col("value") * grain).cast("long"))
    c = c.join(vids, k).withColumn("_s", F.col("_cw") / F.col("videos"))
    # the weights are sums of 1/n: a share is reached within rounding
    q = lambda p: F.min(F.when(F.col("_s") >= p - 1e-9, F.col("value"))).alias(f"p{int(round(p * 100))}")
    return c.groupBy(*k, "videos", "apertures").agg(*[q(p) for p in probs])


def noise_centile(objects: DataFrame, rows: DataFrame, factors: Sequence[Sequence[str]], binc: str, least: int = 10) -> DataFrame:
    """A17. An object's value as a centile of the backgrounds' at its bin in its stratum, the mean over the reference
    videos of the share of each one's values under it, its own video left out; the first level with ``least`` videos.

    The reference is counted by (stratum, bin, video, value) first; objects meet values through those counts, in slices
    of value: whole slices under the object by running sums, its own slice value by value."""
    ref = share(_levels(rows, factors, binc).groupBy("level", "stratum", binc, "video_id", "value").agg(F.count(F.lit(1)).alias("_k")))
    k = ["level", "stratum", binc]
    obj = _levels_obj(objects, factors, binc)
    vids = ref.groupBy(*k, "video_id").agg(F.sum("_k").alias("_n"))
    n_v = vids.groupBy(*k).agg(F.count(F.lit(1)).alias("_nv"))
    own = vids.select(*k, F.col("video_id").alias("_ov"), F.lit(1).alias("_own"))
    o = obj.join(n_v, k, "left").join(own.withColumnRenamed("_ov", "video_id"), [*k, "video_id"], "left")
    o = o.withColumn("videos", F.coalesce("_nv", F.lit(0)) - F.coalesce("_own", F.lit(0)))
    first = o.where(F.col("videos") >= least).groupBy("object_id").agg(F.min("level").alias("level"))
    o = share(o.join(first, ["object_id", "level"]).select("object_id", "video_id", *k, F.col("value").alias("g"), "videos"))
    # sum over reference videos of (values under g) / n: weights summed by value, running sums looked up as of g
    wv = ref.join(vids, [*k, "video_id"]).withColumn("_w", F.col("_k") / F.col("_n"))
    allw = wv.groupBy(*k, "value").agg(F.sum("_w").alias("_w")).select(*k, "value", "_w", F.lit(None).cast("long").alias("object_id"), F.lit(1).alias("_o"))
    pts = o.select(*k, F.col("g").alias("value"), F.lit(0.0).alias("_w"), F.col("object_id"), F.lit(0).alias("_o"))
    s = scan(allw.unionByName(pts), k, "value", {"_under": ("sum", F.col("_w"))}, ties=["_o"], pos_chunk=F.floor(F.col("value") * 8).cast("long"))
    s = s.where(F.col("object_id").isNotNull()).select("object_id", "_under")
    mine = o.join(wv.select(*k, "video_id", F.col("value").alias("_v"), F.col("_w").alias("_mw")), [*k, "video_id"]).where(F.col("_v") < F.col("g"))
    mine = mine.groupBy("object_id").agg(F.sum("_mw").alias("_mine"))
    j = o.join(s, "object_id").join(mine, "object_id", "left")
    return j.select("object_id", *k, "videos", (100 * (F.col("_under") - F.coalesce("_mine", F.lit(0.0))) / F.col("videos")).alias("centile"))


def _levels_obj(objects: DataFrame, factors: Sequence[Sequence[str]], binc: str) -> DataFrame:
    strata = F.array(*[
        F.struct(F.lit(i).alias("level"), F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("-")) for f in fs]).alias("stratum"))
        for i, fs in enumerate(factors)
    ])
    return objects.select("object_id", "video_id", binc, "value", F.explode(strata).alias("_s")).select(
        "object_id", "video_id", binc, "value", "_s.level", "_s.stratum"
    )


def _on(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-key results back; with no keys ``b`` is one short row set (aggregates over the whole table)."""
    return a.join(b, list(keys)) if keys else a.crossJoin(F.broadcast(b))


def tail_fit(sample: DataFrame, keys: Sequence[str], value: str, quantile: float, grid: int = 128) -> DataFrame:
    """A19. Peaks over the ``quantile``: generalised Pareto by maximum likelihood, the shape held to -0.5..1.

    In Grimshaw's one-parameter form (theta = xi/sigma) the likelihood at any theta needs only the mean of
    log(1 + theta x), so a grid of theta is one pass of sums, refined by a second pass between the best one's
    neighbours."""
    keys = list(keys)
    s = share(sample.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")))
    u = exact_quantiles(s, keys, "_v", {"u": quantile})
    n = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("_v").alias("largest"))
    ex = share(_on(s, u, keys).where(F.col("_v") > F.col("u")).select(*keys, (F.col("_v") - F.col("u")).alias("x")))
    st = ex.groupBy(*keys).agg(F.count(F.lit(1)).alias("above"), F.avg("x").alias("_mean"), F.max("x").alias("_max")).where(F.col("above") >= 10)
    st = share(st)
    low = -F.col("_mean") / F.col("_max")
    neg = F.transform(F.sequence(F.lit(1), F.lit(grid)), lambda i: low * (1 - F.pow(F.lit(0.9), i)))
    pos = F.transform(F.sequence(F.lit(1), F.lit(grid)), lambda i: F.pow(F.lit(1.08), i - grid) * 20.0)
    first = st.withColumn("_taus", F.array_sort(F.concat(neg, pos)))

    def best(tab: DataFrame) -> DataFrame:
        e = _on(ex, tab.select(*keys, "_mean", F.posexplode("_taus").alias("_i", "_tau")), keys)
        g = e.groupBy(*keys, "_i", "_tau", "_mean").agg(F.avg(F.log1p(F.col("_tau") / F.col("_mean") * F.col("x"))).alias("xi"))
        g = g.where(F.col("xi").isNotNull() & ~F.isnan("xi"))
        ll = -F.log(F.col("xi") * F.col("_mean") / F.col("_tau")) - 1 - F.col("xi")
        return g.withColumn("_ll", ll).where(F.col("_ll").isNotNull() & ~F.isnan("_ll")).groupBy(*keys).agg(
            F.max_by(F.struct("_i", "_tau", "xi"), F.struct("_ll", "_i")).alias("_b")
        )

    b1 = share(_on(best(first), first, keys))
    i = F.col("_b._i")
    lo, hi = F.get("_taus", F.greatest(i - 1, F.lit(0))), F.get("_taus", F.least(i + 1, F.size("_taus") - 1))
    fine = b1.withColumn("_taus", F.transform(F.sequence(F.lit(0), F.lit(grid)), lambda k: lo + (hi - lo) * k / grid)).drop("_b")
    fine = fine.withColumn("_taus", F.filter("_taus", lambda v: v != 0))
    b2 = _on(_on(_on(best(fine), st, keys), u, keys), n, keys)
    sigma = F.col("_b.xi") * F.col("_mean") / F.col("_b._tau")
    return b2.select(*keys, "u", "n", "above", "largest", F.greatest(F.lit(-0.5), F.least(F.lit(1.0), F.col("_b.xi"))).alias("xi"), sigma.alias("sigma"))


def tail_p(values: DataFrame, value: str, sample: DataFrame, fit: DataFrame) -> DataFrame:
    """A19. The chance a sample's member stands at ``value`` or over: (k+1)/(n+1) up to the threshold, past it the
    threshold's share times the fitted survival."""
    cnt = sample.groupBy(F.col("_v")).agg(F.count(F.lit(1)).alias("_k")) if "_v" in sample.columns else None
    assert cnt is not None
    bucket = F.floor(F.col("_v") * 8).cast("long")
    pts = values.groupBy(F.col(value).alias("_v")).agg(F.lit(0).cast("long").alias("_k")).withColumn("_o", F.lit(0))
    s = scan(cnt.withColumn("_o", F.lit(1)).unionByName(pts), [], "_v", {"_less": ("sum", F.col("_k"))}, ties=["_o"], pos_chunk=bucket)
    s = s.where(F.col("_o") == 0).select("_v", "_less")
    j = values.join(s, values[value] == s["_v"]).crossJoin(F.broadcast(fit))
    emp = (F.col("n") - F.col("_less") + 1) / (F.col("n") + 1)
    far = F.col("above") / F.col("n") * gpd_sf(F.col(value) - F.col("u"), F.col("xi"), F.col("sigma"))
    return j.withColumn("p", F.when(F.col(value) <= F.col("u"), emp).otherwise(far)).select(*values.columns, "p")


# ---- scales -----------------------------------------------------------------------------------------------------------
def pooled_scale(routes: DataFrame, case: str, alpha: float = 0.05) -> DataFrame:
    """A22. Routes to k pooled in ln k: inverse-variance mean, chi-square on n-1, agree or disagree.  Of routes that
    share an input only the most precise counts (greedy from the most precise).  Columns: case, name, k, err, shares.
    A case has a handful of routes: they are folded as one sorted array."""
    r = routes.where(F.col("err").isNotNull() & (F.col("err") > 0)).withColumn("s", F.col("err") / F.col("k"))
    arr = r.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("s", "name", F.log("k").alias("lk"), "shares"))).alias("a"))
    elem = "array<struct<s:double,name:string,lk:double,shares:array<string>>>"
    used = F.aggregate(
        "a", F.array().cast(elem),
        lambda acc, v: F.when(F.exists(acc, lambda u: F.arrays_overlap(u["shares"], v["shares"])), acc).otherwise(F.concat(acc, F.array(v))),
    )
    d = arr.withColumn("u", used)
    sw = F.aggregate("u", F.lit(0.0), lambda a, v: a + 1 / (v["s"] * v["s"]))
    sx = F.aggregate("u", F.lit(0.0), lambda a, v: a + v["lk"] / (v["s"] * v["s"]))
    d = d.withColumn("sw", sw).withColumn("m", sx / F.col("sw")).withColumn("dof", F.size("u") - 1)
    d = d.withColumn("chi2", F.aggregate("u", F.lit(0.0), lambda a, v: a + F.pow((v["lk"] - F.col("m")) / v["s"], 2)))
    d = d.withColumn("p", F.when(F.col("dof") > 0, chi2_sf(F.col("chi2"), F.col("dof"))))
    verdict = F.when(F.col("dof") == 0, "one route").when(F.col("p") >= alpha, "agree").otherwise("disagree")
    ok = verdict != "disagree"
    return d.select(case, verdict.alias("verdict"), F.when(ok, F.exp("m")).alias("k"), F.when(ok, F.exp("m") / F.sqrt("sw")).alias("err"),
                    (F.col("dof") + 1).alias("used"), "chi2", "p")


def zoom_ladder(steps: DataFrame, keys: Sequence[str], gap: float = 0.03) -> DataFrame:
    """A23. Measured zoom steps pooled into rungs by abs(ln s): a new rung where sorted neighbours are more than ``gap``
    apart; inverse-variance mean where every step has an error, between-clip tau."""
    keys = list(keys)
    d = steps.where(F.col("s") > 0).withColumn("v", F.abs(F.log("s")))
    ck = F.floor(F.col("v") * 4096).cast("long")
    d = scan(d, keys, "v", {"_p": ("last", F.col("v"))}, exclusive=True, ties=["clip"], pos_chunk=ck)
    new = F.when(F.col("_p").isNull() | (F.col("v") - F.col("_p") > gap), 1).otherwise(0)
    d = scan(d, keys, "v", {"rung": ("sum", new)}, ties=["clip"], pos_chunk=ck)
    w = div(F.lit(1.0), F.col("err") * F.col("err"))
    g = d.groupBy(*keys, "rung").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("clip").alias("clips"), F.avg("v").alias("_m"), F.stddev_samp("v").alias("sd"),
        F.sum(w).alias("_w"), F.sum(w * F.col("v")).alias("_wv"), F.bool_and(F.col("err").isNotNull() & (F.col("err") > 0)).alias("_all"),
        F.avg(F.col("err") * F.col("err")).alias("_e2"),
    )
    m = F.when(F.col("_all"), F.col("_wv") / F.col("_w")).otherwise(F.col("_m"))
    se = F.when(F.col("_all"), 1 / F.sqrt("_w")).otherwise(F.col("sd") / F.sqrt("n"))
    tau = F.when(F.col("_all") & F.col("sd").isNotNull(), F.sqrt(F.greatest(F.col("sd") * F.col("sd") - F.col("_e2"), F.lit(0.0))))
    return g.select(*keys, "rung", F.exp(m).alias("ratio"), m.alias("ln_ratio"), se.alias("ln_err"), F.col("sd").alias("ln_sd"), tau.alias("tau"), "n", "clips")


def shrink_to_rung(step_ln: Column, err: Column, rung_ln: Column, rung_err: Column, tau: Column) -> tuple[Column, Column]:
    """P19. Credibility Z = tau^2/(tau^2+err^2) of a step and the step shrunk to its rung (in ln)."""
    z = F.when(F.coalesce(tau, F.lit(0.0)) * F.coalesce(err, F.lit(0.0)) > 0, tau * tau / (tau * tau + err * err)).otherwise(F.lit(0.0))
    return z, z * step_ln + (1 - z) * rung_ln


# ---- thresholds, splits, rates ---------------------------------------------------------------------------------------
def set_floor(negatives: DataFrame, floors: Sequence[float], alpha: float = 0.01, draws: int = 200, seed: int = 0, step: float = 0.005) -> DataFrame:
    """A61. The smallest amplitude floor at which at most ``alpha`` of the negatives are named, its median over clip
    resamples rounded up to ``step``; null where none does.  ``negatives``: clip, score (null where never named)."""
    grid = F.explode(F.array(*[F.lit(float(f)) for f in floors])).alias("floor")
    t = negatives.select("clip", "score", grid).groupBy("clip", "floor").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("score") >= F.col("floor"), F.lit(False)).cast("long")).alias("k")
    )
    t = share(t)
    b = cluster_bootstrap(t, ["floor"], "clip", ["k", "n"], draws, seed)
    # a draw that no floor satisfies has none: it counts as endless, not as absent
    ok = b.groupBy("draw").agg(F.coalesce(F.min(F.when(F.col("k") <= alpha * F.col("n"), F.col("floor"))), F.lit(float("inf"))).alias("f"))
    med = ok.agg(F.percentile("f", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("draws"))
    exact = t.groupBy("floor").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).where(F.col("k") <= alpha * F.col("n")).agg(F.min("floor").alias("whole"))
    finite = F.when(F.col("median") < float("inf"), F.col("median"))  # where half of the draws have none, neither has this
    return med.crossJoin(exact).select("whole", finite.alias("median"), (F.ceil(finite / step - 1e-9) * step).alias("floor"), "draws")


def overfit_probability(cells: DataFrame, blocks: int = 16, weight: float = 11.0) -> DataFrame:
    """A62. Combinatorially symmetric cross-validation: over every half of the blocks, the setting with the best
    TPR - weight x FPR on it, ranked by the same on the other half; the share of halves whose pick ranks at or under the
    median.  ``cells``: block (0..blocks-1), config, tp, p, fp, n.  The halves are a table of bit masks made by Spark."""
    spark = cells.sparkSession
    halves = spark.range(1 << blocks).where(F.bit_count("id") == blocks // 2).withColumnRenamed("id", "mask")
    c = share(cells)
    j = halves.crossJoin(F.broadcast(c))  # blocks x settings rows: a fixed small table
    ins = (F.shiftrightunsigned(F.col("mask"), 0).bitwiseAND(F.expr("shiftleft(1L, CAST(block AS INT))")) != 0)
    agg = [F.sum(F.when(ins == side, F.col(v)).otherwise(0)).alias(f"{v}{i}") for i, side in enumerate((True, False)) for v in ("tp", "p", "fp", "n")]
    g = j.groupBy("mask", "config").agg(*agg)
    perf = lambda i: F.coalesce(div(F.col(f"tp{i}"), F.col(f"p{i}")), F.lit(0.0)) - weight * F.coalesce(div(F.col(f"fp{i}"), F.col(f"n{i}")), F.lit(0.0))
    g = g.withColumn("ins", perf(0)).withColumn("oos", perf(1))
    w = W.partitionBy("mask")
    g = g.withColumn("_best", F.row_number().over(w.orderBy(F.col("ins").desc(), "config"))).withColumn("_rank", F.rank().over(w.orderBy("oos"))).withColumn("_m", F.count(F.lit(1)).over(w))
    pick = g.where(F.col("_best") == 1).withColumn("omega", F.col("_rank") / (F.col("_m") + 1))
    return pick.agg(F.count(F.lit(1)).alias("halves"), F.avg((F.col("omega") <= 0.5).cast("double")).alias("pbo"), F.avg("oos").alias("mean_oos"))


def agreement_rates(rows: DataFrame, draws: int = 500, seed: int = 0) -> DataFrame:
    """A63. Share of agreements, held-out less tuning, with its interval by video; the video that moves the held-out
    share most when left out.  ``rows``: video_id, held (boolean), agrees (boolean)."""
    t = share(rows.groupBy("video_id", "held").agg(F.sum(F.col("agrees").cast("long")).alias("k"), F.count(F.lit(1)).alias("n")))
    w = t.select("video_id", *[F.when(F.col("held") == h, F.col(c)).otherwise(0).alias(f"{c}{i}") for i, h in enumerate((True, False)) for c in ("k", "n")])
    cols = ["k0", "n0", "k1", "n1"]
    diff = div(F.col("k0"), F.col("n0")) - div(F.col("k1"), F.col("n1"))
    b = cluster_bootstrap(w, [], "video_id", cols, draws, seed).where((F.col("n0") > 0) & (F.col("n1") > 0)).agg(
        F.percentile(diff, F.array(F.lit(0.025), F.lit(0.975))).alias("_q")
    )
    tot = w.agg(*[F.sum(c).alias(c) for c in cols], F.sum(F.col("n0") * F.col("n0")).alias("_n2"))
    out = t.where("held").crossJoin(F.broadcast(tot.select(F.col("k0").alias("_k"), F.col("n0").alias("_n")))).where(F.col("_n") > F.col("n"))
    moved = F.abs((F.col("_k") - F.col("k")) / (F.col("_n") - F.col("n")) - F.col("_k") / F.col("_n"))
    most = out.agg(F.max_by(F.col("video_id"), F.struct(moved, -F.col("video_id"))).alias("moves_most"), F.max(moved).alias("moves_by"))
    return tot.crossJoin(b).crossJoin(most).select(
        div(F.col("k0"), F.col("n0")).alias("held_out"), div(F.col("k1"), F.col("n1")).alias("tuning"), diff.alias("difference"),
        F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"), div(F.col("n0") * F.col("n0"), F.col("_n2")).alias("effective"), "moves_most", "moves_by",
    )


def held_out_split(videos: DataFrame, seed: str = "held-out", share_: float = 1 / 3) -> DataFrame:
    """A64. A deterministic third by hash within each release, quotas by largest remainder.

    Places in the hash order come from slices of the hash, so a release of any size is ordered in parts."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col("video_id").cast("string")), 256)
    d = videos.select("release", "video_id").withColumn("h", h)
    ck = F.conv(F.substring("h", 1, 3), 16, 10).cast("long")
    d = share(scan(d, ["release"], "h", {"place": ("count", F.lit(1))}, pos_chunk=ck))
    n = d.groupBy("release").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.floor(F.col("n") * share_)).withColumn("frac", F.col("n") * share_ - F.col("base"))
    tot = n.agg((F.round(F.sum("n") * share_) - F.sum("base")).alias("_left"))
    # releases are a short list
    q = n.crossJoin(tot).withColumn("_r", F.row_number().over(W.orderBy(F.col("frac").desc(), "release")))
    q = q.select("release", (F.col("base") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).alias("quota"))
    return d.join(q, "release").select("release", "video_id", (F.col("place") <= F.col("quota")).alias("held"))


def class_rates(rows: DataFrame, facets: Sequence[str]) -> DataFrame:
    """A65. Answered share, hits, false-alarm bound by every facet and over all.  Columns answered, hit (booleans)."""
    g = rows.groupingSets([[F.col(f)] for f in facets] + [[]], *[F.col(f) for f in facets]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("answered").cast("long")).alias("answered"), F.sum(F.col("hit").cast("long")).alias("hits"), F.grouping_id().alias("cells")
    )
    return exact_upper_bound(g, "hits", "n")


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """A65. Cohen's kappa of two yes/no rules from the four counts."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    g = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("pa"), F.avg(y).alias("pb"), F.avg((x == y).cast("double")).alias("po"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return g.select("n", "po", pe.alias("pe"), F.when(pe < 1, (F.col("po") - pe) / (1 - pe)).alias("kappa"))


def auc(rows: DataFrame, score: str, label: str, grain: float = 64.0) -> DataFrame:
    """A65. Area under the curve by rank sums, ties at their mean rank; ranks over slices of the score."""
    d = rows.groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))
    s = scan(d, [], "_s", {"_c": ("sum", F.col("_n"))}, pos_chunk=F.floor(F.col("_s") * grain).cast("long"))
    mean_rank = F.col("_c") - (F.col("_n") - 1) / 2
    g = s.agg(F.sum(F.col("_p") * mean_rank).alias("_r"), F.sum("_p").alias("pos"), F.sum(F.col("_n") - F.col("_p")).alias("neg"))
    return g.select("pos", "neg", div(F.col("_r") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * F.col("neg")).alias("auc"))


def uniformity(ps: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """A15. Shares at or under .05/.10/.20/.50 and the largest gap from uniform at the p-values that occur."""
    keys = list(keys)
    d = ps.where(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
    s = share(scan(d, keys, "_p", {"_c": ("sum", F.col("_k"))}, pos_chunk=-_plog(F.col("_p"))))
    n = s.groupBy(*keys).agg(F.sum("_k").alias("_n"))
    j = s.join(n, keys) if keys else s.crossJoin(F.broadcast(n))
    le = lambda x: (F.sum(F.when(F.col("_p") <= x, F.col("_k")).otherwise(0)) / F.first("_n")).alias(f"le_{int(round(x * 100)):02d}")
    g = j.groupBy(*keys).agg(F.first("_n").alias("n"), *[le(x) for x in (0.05, 0.10, 0.20, 0.50)], F.max(F.abs(F.col("_c") / F.col("_n") - F.col("_p"))).alias("ks"))
    return g.withColumn("ks_p", kolmogorov_sf(F.col("ks"), F.col("n")))


FEW_ORIGINS = 20_000  # fixed value: a group of no more origins is taken whole by one task


def model_confidence(losses: DataFrame, keys: Sequence[str], block: int, draws: int = 500, alpha: float = 0.1, seed: int = 0, few: int = FEW_ORIGINS) -> DataFrame:
    """A48. The models whose losses can't be told from the best: keys, model, mean ``loss``, its ``p`` and whether it is ``kept``.

    ``losses``: model, idx (1..T, the same origins for every model) and loss.  Each draw takes floor(T / block) moving blocks of the
    origins, hashed; a block's sum is the difference of two running sums, so a draw costs its blocks, not its origins.  Then the model
    furthest above the mean of those left goes while more than one is, with the largest share of draws so far that reach its distance as
    p; the last has 1.

    Blocks are ``draws`` / ``block`` a loss, so those of groups of up to ``few`` origins, counted first, are never written: their losses go to
    tasks that draw and eliminate group by group.  Longer groups, and those without the same origins for every model, are drawn by joins.
    """
    keys = list(keys)
    losses = share(losses.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(*keys, "model", "idx", "loss") if keys else losses)
    n, last = F.count("loss"), F.max("idx")
    whole = (n == last) & (F.count(F.lit(1)) == n) & (F.min("idx") == 1) & (F.count_distinct("idx") == n)
    each = losses.groupBy(*keys, "model").agg(last.alias("_n"), whole.alias("_ok"))
    odd = share(each.groupBy(*keys).agg(F.min("_n").alias("_l"), F.max("_n").alias("_n"), F.min("_ok").alias("_ok")).where(~F.col("_ok") | (F.col("_l") != F.col("_n")) | (F.col("_n") > few)).select(*keys))
    fields = ", ".join(f"`{k}` {losses.schema[k].dataType.simpleString()}" for k in [*keys, "model"]) + ", loss double, p double, kept boolean"
    some = not odd.isEmpty()
    if not keys or some:
        long = _drawn_means(losses.join(odd, keys, "left_semi") if keys else losses, keys, block, draws, seed).groupBy(*keys).applyInPandas(_eliminated(keys, alpha), fields)
        if not keys:
            return long
    short = dealt(losses.join(odd, keys, "left_anti") if some else losses, *keys).sortWithinPartitions(*keys, "model", "idx")
    short = short.withColumn("_text", F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    found = short.mapInPandas(_confidence_of_groups(keys, block, draws, alpha), fields)
    return found.unionByName(long) if some else found


def _confidence_of_groups(keys: list[str], block: int, draws: int, alpha: float):
    """``model_confidence`` of batches of losses that are sorted by keys, model and idx."""
    shares = _shares()

    def drawn(text: str, loss: np.ndarray) -> np.ndarray:
        """The means of each draw (rows) of each model (columns)."""
        n = loss.shape[1]
        told = b"".join(md5(f"{text}|{d}|{j}".encode()).digest()[:8] for d in range(1, draws + 1) for j in range(n // block))
        u = (np.frombuffer(told, ">u8") >> np.uint64(12)).astype(float) / 2.0**52
        s = np.floor(u * (n - block + 1)).astype(int).reshape(draws, -1)
        run = np.concatenate([np.zeros((len(loss), 1)), np.cumsum(loss, axis=1)], axis=1)
        return np.stack([(r[s + block] - r[s]).sum(axis=1) for r in run], axis=1) / (n // block * block)

    def groups(d: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        idx, value, out = d["idx"].to_numpy(), d["loss"].to_numpy(float), []
        for a, z in zip(starts, [*starts[1:], len(d)]):
            n = int(idx[z - 1])
            if n < block:
                continue
            loss = value[a:z].reshape(-1, n)
            mean = np.cumsum(loss, axis=1)[:, -1] / n  # summed in order of the origins, as a running sum is
            out.append((a + n * np.arange(len(loss)), mean, shares(mean, drawn(d["_text"].iat[a], loss))))
        at, mean, p = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0), np.zeros(0))
        return d[[*keys, "model"]].iloc[at].reset_index(drop=True).assign(loss=mean, p=p, kept=p >= alpha)

    def run(batches):
        held = []  # the last group may go on in the next batch
        for d in batches:
            if not len(d):
                continue
            text = d["_text"].to_numpy()
            new = np.flatnonzero(np.r_[not held or held[-1]["_text"].iat[-1] != text[0], text[1:] != text[:-1]])
            if held and not len(new):
                held.append(d)
                continue
            whole = pd.concat([*held, d.iloc[: new[-1]]], ignore_index=True)
            held = [d.iloc[new[-1] :]]
            if len(whole):
                text = whole["_text"].to_numpy()
                yield groups(whole, np.flatnonzero(np.r_[True, text[1:] != text[:-1]]))
        if held:
            yield groups(pd.concat(held, ignore_index=True), np.zeros(1, int))

    return run


def _drawn_means(losses: DataFrame, keys: list[str], block: int, draws: int, seed: int) -> DataFrame:
    """The mean of each draw and model (draw 0: of all), a draw summed before it leaves its task."""
    run = scan(losses, [*keys, "model"], "idx", {"_sum": ("sum", F.col("loss"))}, chunk=65536).select(*keys, "model", "idx", "_sum")
    run = share(run.unionByName(losses.select(*keys, "model").distinct().select(*keys, "model", F.lit(0).cast(run.schema["idx"].dataType).alias("idx"), F.lit(0.0).alias("_sum"))))
    n = run.groupBy(*keys, "model").agg(F.max("idx").alias("_n"), F.max_by("_sum", "idx").alias("_all"))
    n = share(n.where(F.col("_n") >= block))
    b = n.groupBy(*keys).agg(F.max("_n").alias("_n")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    b = b.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_n") / block) - 1)))
    b = b.withColumn("_s", F.floor(dr.uniform(seed, *[F.col(k) for k in keys], F.col("draw"), F.col("_j")) * (F.col("_n") - block + 1)))
    b = b.groupBy(*keys, "_n", "_s").agg(F.collect_list("draw").alias("_draws"))  # a start's draws: ``draws`` blocks spread over the starts
    ends = run.select(*keys, "model", F.col("idx").alias("_to"), F.col("_sum").alias("_hi"))
    # the planner takes a key's blocks for one row: neither join may send a side through the driver
    b = b.withColumn("_to", F.col("_s") + block).hint("merge").join(ends, [*keys, "_to"])
    b = b.hint("merge").join(run.select(*keys, "model", F.col("idx").alias("_s"), F.col("_sum").alias("_lo")), [*keys, "model", "_s"])
    drawn = b.select(*keys, "model", "_n", (F.col("_hi") - F.col("_lo")).alias("_v"), F.explode("_draws").alias("draw")).groupBy(*keys, "model", "draw", "_n").agg(F.sum("_v").alias("_v"))
    drawn = drawn.select(*keys, "model", "draw", (F.col("_v") / (F.floor(F.col("_n") / block) * block)).alias("mean"))
    means = n.select(*keys, "model", F.lit(0).alias("draw"), (F.col("_all") / F.col("_n")).alias("mean"))
    return drawn.unionByName(means)


def _eliminated(keys: list[str], alpha: float):
    shares = _shares()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        wide = group.pivot(index="draw", columns="model", values="mean").sort_index().sort_index(axis=1)
        mean = wide.loc[0].to_numpy()
        p = shares(mean, wide.drop(index=0).to_numpy())
        first = {k: group[k].iloc[0] for k in keys}
        return pd.DataFrame({**first, "model": list(wide.columns), "loss": mean, "p": p, "kept": p >= alpha})

    return run


def _shares():
    """The share each model goes with, from the models' means and those of the draws: a function that needs nothing of this package."""

    def run(mean: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        left, p, top = list(range(len(mean))), np.ones(len(mean)), 0.0
        while len(left) > 1:
            own = mean[left] - mean[left].mean()
            off = drawn[:, left] - drawn[:, left].mean(axis=1, keepdims=True) - own
            sd = np.sqrt(np.maximum((off * off).mean(axis=0), 1e-300))
            worst = int(np.argmax(own / sd))
            top = max(top, float(((off / sd).max(axis=1) >= (own / sd)[worst]).mean()))
            p[left.pop(worst)] = top
        return p

    return run
