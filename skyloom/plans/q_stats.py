"""Queries over the corpus: tallies, intervals, discoveries, noise levels, ranking, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions.draws import poisson1_sql, uniform_sql
from skyloom.functions.quantiles import robust_scale
from skyloom.operators import rank as rk
from skyloom.operators import stats as st
from skyloom.plans.corpus import AXES_SQL, EPOCH
from skyloom.plans.q_windows import rnd
from skyloom.plans.registry import query


@query(
    "corpus_tally",
    """WITH f AS (SELECT 'outcome' AS facet, o_orderstatus AS value, o_totalprice FROM orders UNION ALL SELECT 'grade', o_orderpriority, o_totalprice FROM orders
  UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), o_totalprice FROM orders)
SELECT facet, value, count(*) AS n, round(sum(o_totalprice),2) AS seconds, count(CASE WHEN o_totalprice > 250000 THEN 1 END) AS large FROM f GROUP BY ALL""",
)
def _(t):
    o = t.orders.select(F.col("o_orderstatus").alias("outcome"), F.col("o_orderpriority").alias("grade"), F.year("o_orderdate").alias("year"), "o_totalprice")
    return st.corpus_tally(o, ["outcome", "grade", "year"], {
        "seconds": F.round(F.sum("o_totalprice"), 2), "large": F.count(F.when(F.col("o_totalprice") > 250000, 1))})


@query("robust_scale", "SELECT l_suppkey AS video_id, round(median(l_extendedprice),4) AS med, round(mad(l_extendedprice),4) AS mad, round(1.4826*mad(l_extendedprice),4) AS scale FROM lineitem GROUP BY ALL")
def _(t):
    return rnd(robust_scale(t.lineitem.select(F.col("l_suppkey").alias("video_id"), "l_extendedprice"), ["video_id"], "l_extendedprice"), "med", "mad", "scale", n=4)


LAB = "lab AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic, CAST(floor(n_chars/1000) AS BIGINT) AS size FROM documents d JOIN labels l USING (doc_id))"


def lab(t):
    d = t.documents.select("doc_id", "lang", "source", "n_chars", F.floor(F.col("n_chars") / 1000).alias("size"))
    return d.join(t.labels, "doc_id")


@query(
    "completeness_by_cell",
    f"""WITH {LAB}, g AS (SELECT lang, source, CAST(grouping(lang)*2+grouping(source) AS BIGINT) AS cells, count(*) AS n, sum(quality) AS found FROM lab GROUP BY GROUPING SETS ((lang),(source),(lang,source)))
SELECT lang, source, cells, n, found, round(found/n,9) AS share,
  round(greatest(0, ((found/n) + 3.8416/(2*n))/(1+3.8416/n) - 1.96*sqrt((found/n)*(1-found/n)/n + 3.8416/(4.0*n*n))/(1+3.8416/n)),9) AS low,
  round(least(1, ((found/n) + 3.8416/(2*n))/(1+3.8416/n) + 1.96*sqrt((found/n)*(1-found/n)/n + 3.8416/(4.0*n*n))/(1+3.8416/n)),9) AS high FROM g""",
)
def _(t):
    d = lab(t).withColumn("hit", F.col("quality") == 1)
    return rnd(st.completeness_by_cell(d, [["lang"], ["source"], ["lang", "source"]], "hit"), "share", "low", "high", n=9)


@query(
    "exact_upper_bound",
    f"""WITH RECURSIVE {LAB}, g AS (SELECT source, sum(toxic) AS wrong, count(*) AS n FROM lab GROUP BY ALL),
b AS (SELECT source, wrong, n, 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM g
  UNION ALL SELECT source, wrong, n, i+1, CASE WHEN tail > 0.05 THEN mid ELSE lo END, CASE WHEN tail > 0.05 THEN hi ELSE mid END FROM (
    SELECT *, (lo+hi)/2 AS mid, list_sum(list_transform(range(0, CAST(wrong AS BIGINT)+1), lambda j: exp(lgamma(n+1)-lgamma(j+1)-lgamma(n-j+1)+j*ln((lo+hi)/2)+(n-j)*ln(1-(lo+hi)/2)))) AS tail FROM b WHERE i < 50))
SELECT source, wrong, n, round(CASE WHEN wrong >= n THEN 1.0 ELSE (lo+hi)/2 END, 7) AS upper FROM b WHERE i = 50""",
)
def _(t):
    g = lab(t).groupBy("source").agg(F.sum("toxic").alias("wrong"), F.count(F.lit(1)).alias("n"))
    return rnd(st.exact_upper_bound(g, "wrong", "n"), "upper", n=7)


B = 200


@query(
    "cluster_bootstrap",
    f"""WITH {LAB}, v AS (SELECT lang, source, sum(quality) AS k, count(*) AS n FROM lab GROUP BY ALL),
d AS (SELECT lang, draw, sum(k*w) AS k, sum(n*w) AS n FROM (SELECT v.*, draw, {poisson1_sql(uniform_sql(0, "source", "draw"))} AS w FROM v, range(1,{B + 1}) r(draw)) GROUP BY ALL),
q AS (SELECT lang, quantile_cont(k/greatest(n,1), 0.025) AS lo, quantile_cont(k/greatest(n,1), 0.975) AS hi FROM d GROUP BY ALL)
SELECT v.lang, sum(k) AS k, sum(n) AS n, count(*) AS videos, round(sum(k)/sum(n),9) AS share, round(any_value(lo),9) AS lo, round(any_value(hi),9) AS hi FROM v JOIN q USING (lang) GROUP BY v.lang""",
)
def _(t):
    tot = lab(t).groupBy("lang", "source").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    return rnd(st.share_interval(tot, ["lang"], "source", "k", "n", draws=B), "share", "lo", "hi", n=9)


@query(
    "likelihood_ratio",
    f"""WITH {LAB}, tr AS (SELECT source||'-'||lang AS clip, quality=1 AS bird, CASE WHEN size >= 6 THEN 'named' WHEN size >= 2 THEN 'faint' ELSE 'none' END AS answer FROM lab),
c AS (SELECT clip, bird, count(*) AS n FROM tr GROUP BY ALL), a AS (SELECT DISTINCT answer FROM tr), kk AS (SELECT clip, bird, answer, count(*) AS k FROM tr GROUP BY ALL),
x AS (SELECT a.answer, c.clip, c.bird, n, coalesce(k,0) AS k FROM c CROSS JOIN a LEFT JOIN kk ON c.clip=kk.clip AND c.bird=kk.bird AND a.answer=kk.answer),
y AS (SELECT answer, clip||'/'||bird AS unit, CASE WHEN bird THEN k ELSE 0 END AS kb, CASE WHEN bird THEN n ELSE 0 END AS nb, CASE WHEN NOT bird THEN k ELSE 0 END AS ko, CASE WHEN NOT bird THEN n ELSE 0 END AS no FROM x),
d AS (SELECT answer, draw, sum(kb*w) AS kb, sum(nb*w) AS nb, sum(ko*w) AS ko, sum(no*w) AS no FROM (SELECT y.*, draw, {poisson1_sql(uniform_sql(0, "unit", "draw"))} AS w FROM y, range(1,{B + 1}) r(draw)) GROUP BY ALL),
l AS (SELECT answer, CASE WHEN ko > 0 AND nb > 0 THEN (kb/nb)/(ko/no) WHEN kb > 0 THEN 'inf'::DOUBLE END AS l FROM d),
q AS (SELECT answer, quantile_cont(l,0.025) AS lo, quantile_cont(l,0.975) AS hi FROM l WHERE l IS NOT NULL GROUP BY ALL),
p AS (SELECT answer, sum(kb) AS kb, sum(nb) AS nb, sum(ko) AS ko, sum(no) AS no FROM y GROUP BY ALL)
SELECT answer, kb, nb, ko, no, round((kb/nb)/(ko/no),8) AS lr, round(lo,8) AS lo, round(hi,8) AS hi,
  CASE WHEN kb+ko < 10 THEN 'no power' WHEN lo > 1 THEN 'for' WHEN hi < 1 THEN 'against' ELSE 'none' END AS weight FROM p LEFT JOIN q USING (answer)""",
)
def _(t):
    d = lab(t).select(F.concat_ws("-", "source", "lang").alias("clip"), (F.col("quality") == 1).alias("bird"),
                      F.when(F.col("size") >= 6, "named").when(F.col("size") >= 2, "faint").otherwise("none").alias("answer"))
    return rnd(st.likelihood_ratio(d, draws=B), "lr", "lo", "hi", n=8)


@query(
    "screen_counts",
    f"""WITH {LAB}, m AS (SELECT quality=1 AS bird, CAST(size+1 AS DOUBLE) AS hz, n_chars/1000.0 AS amplitude FROM lab),
o AS (SELECT event_id AS object_id, value/20.0 AS amplitude, CAST(user_id%30 AS DOUBLE) AS hz FROM events),
mb AS (SELECT * FROM m WHERE hz BETWEEN 2 AND 25)
SELECT object_id, (SELECT count(*) FROM mb WHERE bird AND mb.amplitude >= o.amplitude) AS birds, (SELECT count(*) FROM mb WHERE bird) AS nb,
  (SELECT count(*) FROM mb WHERE NOT bird AND mb.amplitude >= o.amplitude) AS others, (SELECT count(*) FROM mb WHERE NOT bird) AS no,
  CASE WHEN (SELECT count(*) FROM mb WHERE NOT bird AND mb.amplitude >= o.amplitude) = 0 THEN round(1-pow(0.05, 1.0/(SELECT count(*) FROM m WHERE NOT bird)),9) END AS bound
FROM o WHERE hz BETWEEN 2 AND 25 AND amplitude IS NOT NULL""",
)
def _(t):
    m = lab(t).select((F.col("quality") == 1).alias("bird"), (F.col("size") + 1).cast("double").alias("hz"), (F.col("n_chars") / 1000.0).alias("amplitude"))
    o = t.events.select(F.col("event_id").alias("object_id"), (F.col("value") / 20.0).alias("amplitude"), (F.col("user_id") % 30).cast("double").alias("hz"))
    return rnd(st.screen_counts(o, m), "bound", n=9)


TESTS = "tests AS (SELECT event_id, user_id AS video_id, event_type, CASE WHEN event_type<>'signup' THEN greatest(1.0 - value/600.0, 1e-6)*(1 + event_id%3)/3 END AS p FROM events)"


def tests(t):
    p = F.greatest(1.0 - F.col("value") / 600.0, F.lit(1e-6)) * (1 + F.col("event_id") % 3) / 3
    return t.events.select("event_id", F.col("user_id").alias("video_id"), "event_type", F.when(F.col("event_type") != "signup", p).alias("p"))


@query(
    "false_discovery",
    f"""WITH {TESTS}, r AS (SELECT event_id, coalesce(p,1.0) AS p, row_number() OVER (ORDER BY coalesce(p,1.0)) AS i, count(*) OVER () AS m FROM tests),
a AS (SELECT event_id, least(1.0, min(p*m/i) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q, m FROM r),
c AS (SELECT sum(1.0/i) AS c FROM range(1, (SELECT count(*) FROM tests)+1) x(i))
SELECT t.event_id, t.video_id, t.event_type, round(p,9) AS p, round(q,9) AS q_bh, round(least(1.0,q*c),9) AS q_by FROM tests t JOIN a USING (event_id), c""",
)
def _(t):
    return rnd(st.false_discovery(tests(t), "p"), "p", "q_bh", "q_by", n=9)


@query(
    "per_video_tests",
    f"WITH {TESTS} SELECT video_id, count(*) AS m, round(least(1.0, min(coalesce(p,1.0))*count(*)),9) AS p, arg_min(event_id, (coalesce(p,1.0), event_id)) AS event_id FROM tests GROUP BY ALL",
)
def _(t):
    return rnd(st.per_video(tests(t), "p", "event_id"), "p", n=9)


@query(
    "by_row",
    f"WITH {TESTS} SELECT video_id, event_type, count(*) AS members, round(least(1.0, min(p)*count(*)),9) AS p, arg_min(event_id, (p, event_id)) AS best FROM tests WHERE p IS NOT NULL GROUP BY ALL",
)
def _(t):
    return rnd(st.by_row(tests(t), ["video_id", "event_type"], "p", "event_id"), "p", n=9)


BG = f"bg AS (SELECT event_id AS object_id, user_id AS video_id, event_type, CAST(dayofweek(ts) AS VARCHAR) AS dow, CAST(floor((epoch(ts)-{EPOCH})/21600) AS BIGINT)%4 AS bin, value FROM events)"


def bg(t):
    return t.events.select(
        F.col("event_id").alias("object_id"), F.col("user_id").alias("video_id"), "event_type", (F.dayofweek("ts") - 1).cast("string").alias("dow"),
        (F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - EPOCH) / 21600) % 4).alias("bin"), "value")


@query(
    "noise_levels",
    f"""WITH {BG}, l AS (SELECT video_id, bin, value, 0 AS level, event_type||'|'||dow AS stratum FROM bg UNION ALL SELECT video_id, bin, value, 1, event_type FROM bg),
w AS (SELECT *, 1.0/count(*) OVER (PARTITION BY level, stratum, bin, video_id) AS w FROM l),
v AS (SELECT level, stratum, bin, count(DISTINCT video_id) AS videos, count(*) AS apertures FROM l GROUP BY ALL HAVING count(DISTINCT video_id) >= 10),
c AS (SELECT w.*, videos, apertures, sum(w) OVER (PARTITION BY w.level, w.stratum, w.bin ORDER BY value)/videos AS s FROM w JOIN v USING (level, stratum, bin))
SELECT level, stratum, bin, videos, apertures, min(CASE WHEN s >= 0.5-1e-9 THEN value END) AS p50, min(CASE WHEN s >= 0.9-1e-9 THEN value END) AS p90, min(CASE WHEN s >= 0.99-1e-9 THEN value END) AS p99 FROM c GROUP BY ALL""",
)
def _(t):
    return st.noise_levels(bg(t), [["event_type", "dow"], ["event_type"]], "bin")


@query(
    "noise_centile",
    f"""WITH {BG}, l AS (SELECT object_id, video_id, bin, value, 0 AS level, event_type||'|'||dow AS stratum FROM bg UNION ALL SELECT object_id, video_id, bin, value, 1, event_type FROM bg),
vn AS (SELECT level, stratum, bin, video_id, count(*) AS n FROM l GROUP BY ALL),
nv AS (SELECT level, stratum, bin, count(*) AS nv FROM vn GROUP BY ALL),
o2 AS (SELECT l.*, nv.nv - 1 AS videos FROM l JOIN nv USING (level, stratum, bin)),
o3 AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY level) AS r FROM o2 WHERE videos >= 10),
w AS (SELECT l.level, l.stratum, l.bin, l.video_id, l.value, 1.0/n AS w FROM l JOIN vn USING (level, stratum, bin, video_id))
SELECT o3.object_id, o3.level, o3.stratum, o3.bin, videos, round(100*coalesce(sum(CASE WHEN w.value < o3.value THEN w END),0)/videos,6) AS centile
FROM o3 JOIN w ON w.level=o3.level AND w.stratum=o3.stratum AND w.bin=o3.bin AND w.video_id<>o3.video_id WHERE r=1 GROUP BY o3.object_id, o3.level, o3.stratum, o3.bin, videos, o3.value""",
)
def _(t):
    return rnd(st.noise_centile(bg(t), bg(t), [["event_type", "dow"], ["event_type"]], "bin"), "centile")


@query("tail_fit")
def _(t):
    return rnd(st.tail_fit(t.events, ["event_type"], "value", 0.9), "u", "largest", "xi", "sigma", n=4)


@query("tail_p")
def _(t):
    s = t.events.select(F.col("value").alias("_v"))
    fit = st.tail_fit(t.events, [], "value", 0.9)
    return rnd(st.tail_p(t.events.select("event_id", "value"), "value", s, fit), "p", n=6)


@query("pooled_scale")
def _(t):
    r = t.orders.select(
        (F.col("o_custkey")).alias("case_id"), F.col("o_orderkey").cast("string").alias("name"), (F.col("o_totalprice") / 1000).alias("k"),
        (F.col("o_totalprice") / 10000 * (1 + F.col("o_orderkey") % 4)).alias("err"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("shares"))
    return rnd(st.pooled_scale(r, "case_id"), "k", "err", "chi2", "p")


@query(
    "zoom_ladder",
    """WITH s AS (SELECT l_suppkey AS sensor, l_orderkey AS clip, abs(ln(l_extendedprice/50000)) AS v, 0.01+l_tax AS err FROM lineitem),
g AS (SELECT *, sum(nw) OVER (PARTITION BY sensor ORDER BY v, clip ROWS UNBOUNDED PRECEDING) AS rung FROM (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY sensor ORDER BY v, clip) > 0.03 THEN 1 WHEN lag(v) OVER (PARTITION BY sensor ORDER BY v, clip) IS NULL THEN 1 ELSE 0 END AS nw FROM s))
SELECT sensor, rung, round(exp(sum(v/(err*err))/sum(1/(err*err))),6) AS ratio, round(sum(v/(err*err))/sum(1/(err*err)),6) AS ln_ratio, round(1/sqrt(sum(1/(err*err))),6) AS ln_err, round(stddev_samp(v),6) AS ln_sd,
  round(CASE WHEN count(*) > 1 THEN sqrt(greatest(var_samp(v)-avg(err*err),0)) END,4) AS tau, count(*) AS n, count(DISTINCT clip) AS clips FROM g GROUP BY ALL""",
)
def _(t):
    s = t.lineitem.select(F.col("l_suppkey").alias("sensor"), F.col("l_orderkey").alias("clip"), (F.col("l_extendedprice") / 50000).alias("s"), (0.01 + F.col("l_tax")).alias("err"))
    return rnd(rnd(st.zoom_ladder(s, ["sensor"]), "ratio", "ln_ratio", "ln_err", "ln_sd"), "tau", n=4)


@query(
    "set_floor",
    f"""WITH f AS (SELECT source AS clip, n_chars/10000.0 AS score, fl/100.0 AS floor FROM documents, range(0,301,5) r(fl)),
g AS (SELECT clip, floor, count(*) AS n, sum(CASE WHEN score >= floor THEN 1 ELSE 0 END) AS k FROM f GROUP BY ALL),
d AS (SELECT floor, draw, sum(k*w) AS k, sum(n*w) AS n FROM (SELECT g.*, draw, {poisson1_sql(uniform_sql(0, "clip", "draw"))} AS w FROM g, range(1,{B + 1}) r(draw)) GROUP BY ALL),
o AS (SELECT draw, coalesce(min(CASE WHEN k <= 0.2*n THEN floor END), 'Infinity'::DOUBLE) AS f FROM d GROUP BY ALL),
e AS (SELECT min(floor) AS whole FROM (SELECT floor, sum(k) AS k, sum(n) AS n FROM g GROUP BY ALL) WHERE k <= 0.2*n)
SELECT whole, median(f) AS median, round(ceil(median(f)/0.005 - 1e-9)*0.005,6) AS floor, count(*) AS draws FROM o, e GROUP BY whole""",
)
def _(t):
    d = t.documents.select(F.col("source").alias("clip"), (F.col("n_chars") / 10000.0).alias("score"))
    return rnd(st.set_floor(d, [i / 100.0 for i in range(0, 301, 5)], alpha=0.2, draws=B), "floor")


@query(
    "overfit_probability",
    f"""WITH {LAB}, x AS (SELECT CAST('0x'||substr(md5(source||'-'||lang),1,7) AS BIGINT)%16 AS block, c.config, quality, CASE WHEN n_chars >= c.config*500 THEN 1 ELSE 0 END AS hit FROM lab, range(1,9) c(config)),
g AS (SELECT block, config, sum(quality*hit) AS tp, sum(quality) AS p, sum((1-quality)*hit) AS fp, sum(1-quality) AS n FROM x GROUP BY ALL),
h AS (SELECT m AS mask FROM range(0,65536) r(m) WHERE bit_count(m)=8),
s AS (SELECT mask, config, sum(CASE WHEN (mask>>block)&1=1 THEN tp ELSE 0 END) AS tp0, sum(CASE WHEN (mask>>block)&1=1 THEN p ELSE 0 END) AS p0, sum(CASE WHEN (mask>>block)&1=1 THEN fp ELSE 0 END) AS fp0, sum(CASE WHEN (mask>>block)&1=1 THEN n ELSE 0 END) AS n0,
  sum(CASE WHEN (mask>>block)&1=0 THEN tp ELSE 0 END) AS tp1, sum(CASE WHEN (mask>>block)&1=0 THEN p ELSE 0 END) AS p1, sum(CASE WHEN (mask>>block)&1=0 THEN fp ELSE 0 END) AS fp1, sum(CASE WHEN (mask>>block)&1=0 THEN n ELSE 0 END) AS n1 FROM h, g GROUP BY ALL),
f AS (SELECT mask, config, coalesce(tp0/nullif(p0,0),0)-11.0*coalesce(fp0/nullif(n0,0),0) AS ins, coalesce(tp1/nullif(p1,0),0)-11.0*coalesce(fp1/nullif(n1,0),0) AS oos FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY ins DESC, config) AS b, rank() OVER (PARTITION BY mask ORDER BY oos) AS k, count(*) OVER (PARTITION BY mask) AS m FROM f)
SELECT count(*) AS halves, round(avg(CASE WHEN k/(m+1) <= 0.5 THEN 1.0 ELSE 0.0 END),6) AS pbo, round(avg(oos),6) AS mean_oos FROM r WHERE b=1""",
)
def _(t):
    blk = F.conv(F.substring(F.md5(F.concat_ws("-", "source", "lang")), 1, 7), 16, 10).cast("long") % 16
    x = lab(t).select(blk.alias("block"), "quality", "n_chars", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("config"))
    hit = (F.col("n_chars") >= F.col("config") * 500).cast("int")
    g = x.groupBy("block", "config").agg(F.sum(F.col("quality") * hit).alias("tp"), F.sum("quality").alias("p"), F.sum((1 - F.col("quality")) * hit).alias("fp"), F.sum(1 - F.col("quality")).alias("n"))
    return rnd(st.overfit_probability(g), "pbo", "mean_oos")


@query(
    "agreement_rates",
    f"""WITH {LAB}, v AS (SELECT CAST(substr(source,4) AS BIGINT) AS video_id, doc_id%3=0 AS held, sum(quality) AS k, count(*) AS n FROM lab GROUP BY ALL),
d AS (SELECT draw, sum(CASE WHEN held THEN k*w ELSE 0 END) AS k0, sum(CASE WHEN held THEN n*w ELSE 0 END) AS n0, sum(CASE WHEN NOT held THEN k*w ELSE 0 END) AS k1, sum(CASE WHEN NOT held THEN n*w ELSE 0 END) AS n1
  FROM (SELECT v.*, draw, {poisson1_sql(uniform_sql(0, "video_id", "draw"))} AS w FROM v, range(1,{B + 1}) r(draw)) GROUP BY ALL),
q AS (SELECT quantile_cont(k0/n0-k1/n1,0.025) AS lo, quantile_cont(k0/n0-k1/n1,0.975) AS hi FROM d WHERE n0 > 0 AND n1 > 0),
s AS (SELECT sum(CASE WHEN held THEN k END) AS k0, sum(CASE WHEN held THEN n END) AS n0, sum(CASE WHEN NOT held THEN k END) AS k1, sum(CASE WHEN NOT held THEN n END) AS n1, sum(CASE WHEN held THEN n*n END) AS n2 FROM v),
mv AS (SELECT video_id, abs((k0-k)/(n0-n)-k0/n0) AS m FROM v, s WHERE held AND n0 > n)
SELECT round(k0/n0,9) AS held_out, round(k1/n1,9) AS tuning, round(k0/n0-k1/n1,9) AS difference, round(lo,9) AS lo, round(hi,9) AS hi, round(n0*n0/n2,9) AS effective,
  (SELECT video_id FROM mv ORDER BY m DESC, video_id LIMIT 1) AS moves_most, round((SELECT max(m) FROM mv),9) AS moves_by FROM s, q""",
)
def _(t):
    d = lab(t).select(F.substring("source", 4, 9).cast("long").alias("video_id"), (F.col("doc_id") % 3 == 0).alias("held"), (F.col("quality") == 1).alias("agrees"))
    return rnd(st.agreement_rates(d, draws=B), "held_out", "tuning", "difference", "lo", "hi", "effective", "moves_by", n=9)


@query(
    "held_out_split",
    """WITH h AS (SELECT source AS release, doc_id AS video_id, row_number() OVER (PARTITION BY source ORDER BY sha256('held-out|'||doc_id)) AS place FROM documents),
n AS (SELECT release, count(*) AS n, floor(count(*)/3.0::DOUBLE) AS base, count(*)*(1.0::DOUBLE/3)-floor(count(*)*(1.0::DOUBLE/3)) AS frac FROM h GROUP BY ALL),
q AS (SELECT release, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, release) <= (SELECT round(sum(n)*(1.0::DOUBLE/3))-sum(base) FROM n) THEN 1 ELSE 0 END AS quota FROM n)
SELECT release, video_id, place <= quota AS held FROM h JOIN q USING (release)""",
)
def _(t):
    return st.held_out_split(t.documents.select(F.col("source").alias("release"), F.col("doc_id").alias("video_id")))


@query(
    "class_rates",
    f"""WITH RECURSIVE {LAB}, g AS (SELECT lang, source, CAST(grouping(lang)*2+grouping(source) AS BIGINT) AS cells, count(*) AS n, sum(quality) AS answered, sum(toxic) AS hits FROM lab GROUP BY GROUPING SETS ((lang),(source),())),
b AS (SELECT g.*, 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM g UNION ALL
  SELECT lang, source, cells, n, answered, hits, step + 1, CASE WHEN cdf > 0.05 THEN mid ELSE lo END, CASE WHEN cdf > 0.05 THEN hi ELSE mid END FROM (SELECT *, (lo + hi)/2 AS mid,
    list_sum(list_transform(range(0, CAST(hits AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i*ln((lo + hi)/2) + (n - i)*ln(1 - (lo + hi)/2)))) AS cdf FROM b WHERE step < 60))
SELECT lang, source, cells, n, answered, hits, round(CASE WHEN hits >= n THEN 1 ELSE (lo + hi)/2 END, 7) AS upper FROM b WHERE step = 60""",
)
def _(t):
    d = lab(t).select("lang", "source", (F.col("quality") == 1).alias("answered"), (F.col("toxic") == 1).alias("hit"))
    return rnd(st.class_rates(d, ["lang", "source"]), "upper", n=7)


@query(
    "kappa",
    f"""WITH {LAB}, g AS (SELECT count(*) AS n, avg(quality) AS pa, avg(CASE WHEN n_chars > 1500 THEN 1.0 ELSE 0.0 END) AS pb, avg(CASE WHEN (quality=1) = (n_chars > 1500) THEN 1.0 ELSE 0.0 END) AS po FROM lab)
SELECT n, round(po,9) AS po, round(pa*pb+(1-pa)*(1-pb),9) AS pe, round((po-(pa*pb+(1-pa)*(1-pb)))/(1-(pa*pb+(1-pa)*(1-pb))),9) AS kappa FROM g""",
)
def _(t):
    d = lab(t).select((F.col("quality") == 1).alias("a"), (F.col("n_chars") > 1500).alias("b"))
    return rnd(st.kappa(d, "a", "b"), "po", "pe", "kappa", n=9)


@query(
    "auc",
    f"""WITH {LAB}, p AS (SELECT n_chars AS s FROM lab WHERE quality=1), n AS (SELECT n_chars AS s FROM lab WHERE quality=0)
SELECT (SELECT count(*) FROM p) AS pos, (SELECT count(*) FROM n) AS neg, round((SELECT sum(CASE WHEN p.s>n.s THEN 1.0 WHEN p.s=n.s THEN 0.5 ELSE 0.0 END) FROM p, n)/((SELECT count(*) FROM p)*(SELECT count(*) FROM n)),9) AS auc""",
)
def _(t):
    return rnd(st.auc(lab(t).select(F.col("n_chars").cast("double").alias("s"), (F.col("quality") == 1).alias("l")), "s", "l", 1 / 64), "auc", n=9)


# ---- ranking ----------------------------------------------------------------------------------------------------------
AX = ["a1", "a2", "a3", "a4"]


def strata(t):
    e = rk.strata_edges(t.axes, "contrast")
    return rk.with_stratum(t.axes, e, "contrast")


ST_SQL = AXES_SQL + ", st AS (SELECT *, CASE WHEN contrast > (SELECT median(contrast) FROM axes WHERE contrast <> 0) THEN 1 ELSE 0 END AS stratum FROM axes)"


def conformal_sql(leave: bool) -> str:
    cond = "AND m.video_id <> o.video_id" if leave else ""
    return ST_SQL + f""",
pairs AS (SELECT o.object_id, c.class AS cls, o.a4 IS NOT NULL AS has4, o.stratum, o.video_id FROM st o, (SELECT DISTINCT class FROM st) c),
cnt AS (SELECT o.object_id, o.cls, count(m.object_id) AS n3, count(m.a4) AS n4, any_value(o.has4) AS has4 FROM pairs o LEFT JOIN st m ON m.class=o.cls AND m.stratum=o.stratum {cond} GROUP BY ALL),
use AS (SELECT object_id, cls, has4 AND n4 >= 19 AS four FROM cnt WHERE (has4 AND n4 >= 19) OR n3 >= 19),
bag AS (
  SELECT u.object_id, u.cls, m.object_id AS mid, false AS me, m.a1, m.a2, m.a3, CASE WHEN four THEN m.a4 END AS a4, four FROM use u JOIN st o ON o.object_id=u.object_id JOIN st m ON m.class=u.cls AND m.stratum=o.stratum {cond} WHERE NOT four OR m.a4 IS NOT NULL
  UNION ALL SELECT u.object_id, u.cls, -1, true, o.a1, o.a2, o.a3, CASE WHEN four THEN o.a4 END, four FROM use u JOIN st o ON o.object_id=u.object_id),
sc AS (SELECT object_id, cls, median(a1) AS m1, 1.4826*mad(a1) AS s1, median(a2) AS m2, 1.4826*mad(a2) AS s2, median(a3) AS m3, 1.4826*mad(a3) AS s3, median(a4) AS m4, 1.4826*mad(a4) AS s4 FROM bag GROUP BY ALL),
z AS (SELECT b.object_id, b.cls, me, greatest(abs((a1-m1)/s1), abs((a2-m2)/s2), abs((a3-m3)/s3), coalesce(abs((a4-m4)/s4),0)) AS s, (a1-m1)/s1 AS z1, (a2-m2)/s2 AS z2, (a3-m3)/s3 AS z3, (a4-m4)/s4 AS z4 FROM bag b JOIN sc USING (object_id, cls)),
x AS (SELECT object_id, cls, s, CASE WHEN abs(z1)=s THEN 'a1' WHEN abs(z2)=s THEN 'a2' WHEN abs(z3)=s THEN 'a3' ELSE 'a4' END AS axis, CASE WHEN abs(z1)=s THEN z1 WHEN abs(z2)=s THEN z2 WHEN abs(z3)=s THEN z3 ELSE z4 END AS zx FROM z WHERE me),
p AS (SELECT x.object_id, x.cls, (sum(CASE WHEN z.s >= x.s-1e-12 THEN 1 ELSE 0 END)+1)/(count(*)+1) AS p, count(*) AS n, x.s AS score, x.axis, x.zx AS z,
  (sum(CASE WHEN abs(CASE x.axis WHEN 'a1' THEN z1 WHEN 'a2' THEN z2 WHEN 'a3' THEN z3 ELSE z4 END) >= x.s-1e-12 THEN 1 ELSE 0 END)+1)/(count(*)+1) AS axis_p
  FROM x JOIN z ON z.object_id=x.object_id AND z.cls=x.cls AND NOT me GROUP BY ALL),
conf AS (SELECT pairs.object_id, pairs.cls AS class, p, n, score, axis, z, axis_p FROM pairs LEFT JOIN p ON p.object_id=pairs.object_id AND p.cls=pairs.cls)"""


@query("conformal_pvalue", f"WITH {conformal_sql(False)} SELECT object_id, class, round(p,9) AS p, n, round(score,6) AS score, axis, round(z,6) AS z, round(axis_p,9) AS axis_p FROM conf")
def _(t):
    s = strata(t)
    return rnd(rnd(rk.conformal_pvalue(s, s, AX), "score", "z"), "p", "axis_p", n=9)


@query("axis_fallback", f"WITH {conformal_sql(True)} SELECT object_id, class, round(p,9) AS p, n, round(score,6) AS score, axis, round(z,6) AS z, round(axis_p,9) AS axis_p FROM conf")
def _(t):
    s = strata(t)
    return rnd(rnd(rk.conformal_pvalue(s, s, AX, leave_own_video=True), "score", "z"), "p", "axis_p", n=9)


@query("conformal_joined", f"WITH {conformal_sql(False)} SELECT object_id, class, round(p,9) AS p, n, round(score,6) AS score, axis, round(z,6) AS z, round(axis_p,9) AS axis_p FROM conf")
def _(t):
    s = strata(t)
    return rnd(rnd(rk.conformal_joined(s, s, AX), "score", "z"), "p", "axis_p", n=9)


@query("strata_edges", f"WITH {AXES_SQL} SELECT round(median(contrast),9) AS edge FROM axes WHERE contrast <> 0")
def _(t):
    return rk.strata_edges(t.axes, "contrast").select(F.round(F.col("edges")[0], 9).alias("edge"))


LU = "lu AS (SELECT object_id, p, class, score, k AS with_power FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY p DESC NULLS LAST, score) AS r, count(p) OVER (PARTITION BY object_id) AS k FROM conf) WHERE r=1)"


def lu(t):
    s = strata(t)
    return rk.least_unlike(rk.conformal_pvalue(s, s, AX))


@query("least_unlike", f"WITH {conformal_sql(False)}, {LU} SELECT object_id, round(p,9) AS p, CASE WHEN p IS NOT NULL THEN class END AS class, round(score,6) AS score, with_power FROM lu")
def _(t):
    return rnd(rnd(lu(t), "p", n=9), "score")


@query("global_order", f"WITH {conformal_sql(False)}, {LU} SELECT object_id, round(p,9) AS p, round(score,6) AS score, row_number() OVER (ORDER BY p NULLS LAST, score DESC, object_id) AS place FROM lu")
def _(t):
    d = rk.rank_rows(lu(t), [F.col("p").asc_nulls_last(), F.col("score").desc(), F.col("object_id")])
    return rnd(rnd(d.select("object_id", "p", "score", "place"), "p", n=9), "score")


@query("calibrate", f"WITH {conformal_sql(True)} SELECT st.class AS own, conf.class AS against, count(p) AS n, round(avg(CASE WHEN p <= 0.05 THEN 1.0 WHEN p IS NOT NULL THEN 0.0 END),9) AS le_05, round(avg(CASE WHEN p <= 0.5 THEN 1.0 WHEN p IS NOT NULL THEN 0.0 END),9) AS le_50 FROM conf JOIN st USING (object_id) GROUP BY ALL")
def _(t):
    s = strata(t)
    p = rk.conformal_pvalue(s, s, AX, leave_own_video=True).join(s.select("object_id", F.col("class").alias("own")), "object_id")
    le = lambda x: F.avg(F.when(F.col("p") <= x, 1.0).when(F.col("p").isNotNull(), 0.0))
    return rnd(p.groupBy("own", F.col("class").alias("against")).agg(F.count("p").alias("n"), le(0.05).alias("le_05"), le(0.5).alias("le_50")), "le_05", "le_50", n=9)


@query(
    "uniformity",
    f"""WITH {TESTS}, a AS (SELECT event_type, p, cume_dist() OVER (PARTITION BY event_type ORDER BY p) AS f FROM tests WHERE p IS NOT NULL)
SELECT event_type, count(*) AS n, round(avg(CASE WHEN p<=0.05 THEN 1.0 ELSE 0 END),9) AS le_05, round(avg(CASE WHEN p<=0.1 THEN 1.0 ELSE 0 END),9) AS le_10, round(avg(CASE WHEN p<=0.2 THEN 1.0 ELSE 0 END),9) AS le_20, round(avg(CASE WHEN p<=0.5 THEN 1.0 ELSE 0 END),9) AS le_50, round(max(abs(f-p)),9) AS ks, round(CASE WHEN t <= 0 THEN 1 WHEN t < 1 THEN 1 - sqrt(2*pi())/t*list_sum(list_transform(range(1,9), lambda k: exp(-pow(2*k-1,2)*pi()*pi()/(8*t*t)))) ELSE list_sum(list_transform(range(1,9), lambda k: 2*pow(-1,k-1)*exp(-2*k*k*t*t))) END,9) AS ks_p FROM (SELECT *, max(abs(f-p)) OVER g * sqrt(count(*) OVER g) AS t FROM a WINDOW g AS (PARTITION BY event_type)) GROUP BY event_type, t""",
)
def _(t):
    return rnd(st.uniformity(tests(t), ["event_type"], "p"), "le_05", "le_10", "le_20", "le_50", "ks", "ks_p", n=9)


@query(
    "class_range",
    f"""WITH {ST_SQL}, r AS (SELECT class, stratum, min(a1) AS l1, max(a1) AS h1, min(contrast) AS lc, max(contrast) AS hc FROM st GROUP BY ALL)
SELECT o.object_id, r.class, concat_ws(',', CASE WHEN NOT (a1 BETWEEN l1*0.9 AND h1*1.1) THEN 'a1' END, CASE WHEN NOT (contrast BETWEEN lc*0.9 AND hc*1.1) THEN 'contrast' END) AS outside FROM st o JOIN r ON o.stratum=r.stratum""",
)
def _(t):
    s = strata(t)
    return rk.class_range(s, s, ["a1", "contrast"]).withColumn("outside", F.array_join("outside", ","))


@query("transform_axes", f"WITH {AXES_SQL} SELECT object_id, round(log10(greatest(contrast,0.001)),9) AS contrast, a4 FROM axes")
def _(t):
    return rnd(rk.transform_axes(t.axes, {"contrast": 0.001}, ["a4"]).select("object_id", "contrast", "a4"), "contrast", n=9)


# ---- rules ------------------------------------------------------------------------------------------------------------
@query(
    "refusals",
    """SELECT doc_id, concat_ws(',', CASE WHEN n_chars < 400 THEN 'brief' END, CASE WHEN n_chars%100/100.0 < 0.3 THEN 'edge' END, CASE WHEN lang='de' THEN 'tape' END, CASE WHEN source NOT IN ('strong') THEN 'unrated' END) AS why FROM documents""",
)
def _(t):
    d = t.documents.select("doc_id", (F.col("n_chars") / 10).alias("seen_in"), (F.col("n_chars") % 100 / 100.0).alias("background_all_round"), (F.col("lang") == "de").alias("scrolling_tape"), F.col("source").alias("strength"))
    return rk.refusals(d).select("doc_id", F.array_join("why", ",").alias("why"))


@query(
    "defects",
    f"""WITH {LAB} SELECT doc_id, CASE WHEN lang='fr' THEN 'not followed' WHEN lang='es' THEN 'failed' ELSE concat_ws(',', CASE WHEN toxic=1 THEN 'overlay' END, CASE WHEN n_chars%10/20.0 >= 0.25 THEN 'masked' END, CASE WHEN quality=0 THEN 'added' END,
  CASE WHEN source='src3' THEN 'blend' END, CASE WHEN source='src4' THEN 'sensor' END, CASE WHEN source='src5' THEN 'scene' END, CASE WHEN n_chars%7 > 0.5*(n_chars%9) AND n_chars%9 > 0 THEN 'lost' END, CASE WHEN source='src6' THEN 'held' END) END AS defects FROM lab""",
)
def _(t):
    d = lab(t).select("doc_id", F.when(F.col("lang") == "fr", "not followed").otherwise("measured").alias("object_state"), F.when(F.col("lang") == "es", "unreadable").alias("read_error"),
                      F.when(F.col("quality") == 0, F.array(F.lit("halo"))).otherwise(F.array().cast("array<string>")).alias("flags"), (F.col("toxic") == 1).alias("overlay_flag"), (F.col("n_chars") % 10 / 20.0).alias("masked_share"),
                      (F.col("source") == "src3").alias("blend"), (F.col("source") == "src4").alias("fixed"), F.when(F.col("source") == "src5", "No").otherwise("Yes").alias("moves"),
                      (F.col("n_chars") % 9).alias("detected"), (F.col("n_chars") % 7).alias("weak"), F.when(F.col("source") == "src6", "Held pictures").alias("refused"), F.lit(False).alias("looked"))
    return rk.defects(d).select("doc_id", F.array_join("defects", ",").alias("defects"))


@query(
    "usable_background",
    """WITH s AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE o_orderstatus='P'),
r AS (SELECT CASE WHEN l_linenumber=7 THEN 'shared with its group' WHEN l_discount > 0.08 THEN 'as bright as the object' WHEN s.o_orderkey IS NOT NULL THEN 'another row''s track' ELSE 'used' END AS dropped FROM lineitem JOIN orders o ON l_orderkey=o.o_orderkey LEFT JOIN s ON s.o_orderkey=l_orderkey)
SELECT dropped, count(*) AS n FROM r GROUP BY ALL""",
)
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("object_id"), "o_orderstatus")
    r = t.lineitem.select(F.col("l_orderkey").alias("object_id"), (F.col("l_linenumber") == 7).alias("shared"), (F.col("l_discount") + 0.02).alias("bright_share")).join(o, "object_id")
    d = rk.usable_background(r.withColumn("bright_share", F.round("bright_share", 4)), o.where("o_orderstatus = 'P'"))
    return d.groupBy(F.coalesce("dropped", F.lit("used")).alias("dropped")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "answer_kind",
    """SELECT event_id, CASE WHEN event_type='signup' THEN 'refused' WHEN event_type IN ('view','click') AND user_id%11=0 THEN 'shaken' WHEN event_type='view' AND value >= 30 THEN 'named' WHEN event_type='view' THEN 'faint'
  WHEN event_type='click' THEN 'once' WHEN event_type='error' THEN 'band' WHEN value*2 > 30 THEN 'deaf' ELSE 'none' END AS answer FROM events""",
)
def _(t):
    call = F.when(F.col("event_type") == "signup", "refused").when(F.col("event_type") == "view", "bird").when(F.col("event_type") == "click", "once").when(F.col("event_type") == "error", "other").otherwise("quiet")
    d = t.events.select("event_id", call.alias("call"), (F.col("user_id") % 11 == 0).alias("shaken"), F.col("value").alias("amplitude"), (F.col("value") * 2).alias("needs"))
    return rk.answer_kind(d, 30.0).select("event_id", "answer")


@query("outside_population", "SELECT doc_id, concat_ws(',', CASE WHEN abs(25+n_chars%8-30.0) > 1 THEN 'rate' END, CASE WHEN n_chars < 150 THEN 'short' END, CASE WHEN lang='de' THEN 'flock' END) AS outside FROM documents")
def _(t):
    d = t.documents.select("doc_id", (25 + F.col("n_chars") % 8).alias("fps"), F.col("n_chars").alias("frames"), (F.col("lang") == "de").alias("flock"))
    return rk.outside_population(d).select("doc_id", F.array_join("outside", ",").alias("outside"))


TPL = "tpl AS (SELECT l_orderkey, l_linenumber, l_quantity/50 AS pk, l_quantity/50 - l_discount AS pk2, l_returnflag='R' AS ridge FROM lineitem)"


def tpl(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("pk"), (F.col("l_quantity") / 50 - F.col("l_discount")).alias("pk2"), (F.col("l_returnflag") == "R").alias("ridge"))


@query("good_templates", f"WITH {TPL} SELECT l_orderkey, l_linenumber, pk FROM tpl WHERE pk >= 0.5 AND pk-pk2 >= 0.05")
def _(t):
    return rk.good_templates(tpl(t)).select("l_orderkey", "l_linenumber", "pk")


@query("ridged_templates", f"WITH {TPL} SELECT l_orderkey, l_linenumber, pk FROM tpl WHERE pk >= 0.5 AND pk-pk2 < 0.05 AND ridge")
def _(t):
    return rk.ridged_templates(tpl(t)).select("l_orderkey", "l_linenumber", "pk")


@query("lasting", "SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 70 OR max(event_id)-min(event_id) >= 9500")
def _(t):
    c = t.events.groupBy("user_id").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count(F.lit(1)).alias("n"))
    return rk.lasting(c.withColumn("vx", F.col("n").cast("double")).withColumn("vy", F.lit(0.0)), 9500, 70.0).select("user_id", "first", "last", "n")


@query("drift_verdict", "SELECT o_custkey AS case_id, count(*) AS tests, CASE WHEN bool_or(o_orderstatus='P') THEN 'not drifting' WHEN bool_or(o_orderstatus='O' AND o_totalprice > 300000) THEN 'tentative drift' ELSE 'cannot say' END AS verdict FROM orders GROUP BY ALL")
def _(t):
    d = t.orders.select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") == "P", "fail").when(F.col("o_orderstatus") == "O", "pass").otherwise("cannot say").alias("outcome"), (F.col("o_totalprice") > 300000).alias("strong"))
    return rk.drift_verdict(d)


@query("own_beats", "SELECT event_id, value/10 AS hz, value/10 BETWEEN 2 AND 25 AND value >= 40 AND user_id%2=0 AS bird FROM events WHERE event_type='view'")
def _(t):
    d = t.events.select("event_id", (F.col("value") / 10).alias("hz"), F.col("value").alias("amplitude"), (F.col("event_type") == "view").alias("own"), (F.col("user_id") % 2 == 0).alias("comes_back"))
    return rk.own_beats(d, 40.0).select("event_id", "hz", "bird")


@query("agreement_tests", f"WITH {LAB} SELECT doc_id, concat_ws(',', CASE WHEN (toxic=0) <> (quality=1) THEN 'toxic' END, CASE WHEN n_chars >= 500 AND (n_chars > 1500) <> (quality=1) THEN 'length' END) AS disagree FROM lab")
def _(t):
    d = lab(t).select("doc_id", (F.col("quality") == 1).alias("call"), (F.col("toxic") == 0).alias("toxic"), F.when(F.col("n_chars") >= 500, F.col("n_chars") > 1500).alias("length"))
    return rk.agreement_tests(d, "call", ["toxic", "length"]).select("doc_id", F.array_join("disagree", ",").alias("disagree"))
