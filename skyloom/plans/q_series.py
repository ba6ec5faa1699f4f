"""Queries over brightness curves and their rhythms."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions.chunked import row_index
from skyloom.operators import series as se
from skyloom.operators import windows as w
from skyloom.plans.corpus import CURVES_SQL, STATS_SQL, frame_stats
from skyloom.plans.q_windows import rnd
from skyloom.plans.registry import query

FREQS = [0.02 * i for i in range(1, 17)]  # cycles a day, the curves' own frame being a day
FR_SQL = "(SELECT unnest([" + ",".join(repr(f) for f in FREQS) + "]::DOUBLE[]) AS hz)"
K = ["video_id", "curve"]

CU = f"""{CURVES_SQL},
cu AS (SELECT video_id, curve, kind, frame, CAST(frame AS DOUBLE) AS t_s, value/25.5 - 1 AS dev, row_number() OVER (PARTITION BY video_id, curve ORDER BY frame) AS idx FROM curves)"""


def curve(t):
    return t.curves.select("video_id", "curve", "kind", "frame", F.col("frame").cast("double").alias("t_s"), (F.col("value") / 25.5 - 1).alias("dev"))


def curve_idx(t):
    return row_index(curve(t), K, "frame")


def spec_sql(src: str, keys: str, freqs: str = FR_SQL) -> str:
    return f"""(SELECT {keys}, hz, n, CASE WHEN n >= 4 AND yy > 0 AND det > 1e-9*greatest(cc*ss,1e-300) THEN greatest(0,least(1,(ss*yc*yc+cc*ys*ys-2*cs*yc*ys)/(yy*det))) ELSE 0.0 END AS power,
  CASE WHEN n >= 4 AND yy > 0 AND det > 1e-9*greatest(cc*ss,1e-300) THEN sqrt(pow((yc*ss-ys*cs)/det,2)+pow((ys*cc-yc*cs)/det,2)) ELSE 0.0 END AS amplitude, yc AS re, ys AS im, win AS "window", tvar, span
 FROM (SELECT *, cc*ss-cs*cs AS det FROM (SELECT {keys}, hz, count(*) AS n, avg(dev*dev)-avg(dev)*avg(dev) AS yy, avg(dev*c)-avg(dev)*avg(c) AS yc, avg(dev*s)-avg(dev)*avg(s) AS ys, avg(c*c)-avg(c)*avg(c) AS cc, avg(s*s)-avg(s)*avg(s) AS ss,
  avg(c*s)-avg(c)*avg(s) AS cs, avg(c)*avg(c)+avg(s)*avg(s) AS win, var_pop(t_s) AS tvar, max(t_s)-min(t_s) AS span FROM (SELECT *, cos(2*pi()*hz*t_s) AS c, sin(2*pi()*hz*t_s) AS s FROM {src}, {freqs}) GROUP BY {keys}, hz)))"""


SP = f"{CU}, sp AS {spec_sql('cu', 'video_id, curve, kind')}"


def spec(t):
    return se.periodogram(curve(t), [*K, "kind"], FREQS)


@query("periodogram", f'WITH {SP} SELECT video_id, curve, kind, hz, n, round(power,6) AS power, round(amplitude,6) AS amplitude, round("window",6) AS "window" FROM sp')
def _(t):
    return rnd(spec(t).select(*K, "kind", "hz", "n", "power", "amplitude", "window"), "power", "amplitude", "window")


@query(
    "strongest_beat",
    f"""WITH {SP}, b AS (SELECT *, row_number() OVER (PARTITION BY video_id, curve ORDER BY power DESC, hz) AS r, min(hz) OVER (PARTITION BY video_id, curve) AS lo, max(hz) OVER (PARTITION BY video_id, curve) AS hi FROM sp),
t AS (SELECT * FROM b WHERE r=1), h AS (SELECT t.video_id, t.curve, min(sp.hz) AS half_lo, max(sp.hz) AS half_hi FROM t JOIN sp ON t.video_id=sp.video_id AND t.curve=sp.curve AND sp.power >= t.power/2 GROUP BY ALL)
SELECT t.video_id, t.curve, hz, round(power,6) AS power, round(amplitude,6) AS amplitude, n, round(1/span,9) AS resolution_hz, half_lo, half_hi, hz=lo OR hz=hi AS edge,
  round(greatest(0,least(1,1-(1-pow(1-power,0.5*(n-3)))*exp(-sqrt(2.0/(n-1))*exp(lgamma((n-1)/2)-lgamma((n-2)/2))*0.3*sqrt(4*pi()*tvar)*pow(1-power,0.5*(n-4))*sqrt(0.5*(n-1)*power)))),5) AS fap
FROM t JOIN h USING (video_id, curve)""",
)
def _(t):
    d = se.strongest(se.periodogram(curve(t), K, FREQS), K, 0.02, 0.32)
    return rnd(rnd(rnd(d, "power", "amplitude"), "resolution_hz", n=9), "fap", n=5)


@query("windowed_beat")
def _(t):
    d = se.windowed_beat(curve_idx(t).where("kind = 'object'"), K, FREQS, 64, 0.12, near=0.05)
    return rnd(d, "chance")


@query(
    "object_vs_background",
    f"""WITH {SP}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY power DESC, hz) AS r FROM sp WHERE kind='object') WHERE r=1),
b AS (SELECT video_id, hz, median(amplitude) AS bg, max(amplitude) AS bg_max, count(*) AS apertures FROM sp WHERE kind='background' GROUP BY ALL)
SELECT video_id, curve, hz, round(amplitude,6) AS amplitude, round(power,6) AS power, round(bg,6) AS bg, round(bg_max,6) AS bg_max, apertures, amplitude >= 3*bg AS own, bg_max >= 0.5*amplitude AS shared FROM o LEFT JOIN b USING (video_id, hz)""",
)
def _(t):
    return rnd(se.object_vs_background(spec(t), ["video_id"]), "amplitude", "power", "bg", "bg_max")


@query(
    "harmonics",
    f"""WITH {SP}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, curve ORDER BY power DESC, hz) AS r FROM sp) WHERE r=1)
SELECT t.video_id, t.curve, t.hz, round(t.power,6) AS power, CASE WHEN l.power >= 0.5*t.power THEN l.hz ELSE t.hz END AS fundamental_hz, 2*CASE WHEN l.power >= 0.5*t.power THEN l.hz ELSE t.hz END AS double_hz
FROM t LEFT JOIN sp l ON t.video_id=l.video_id AND t.curve=l.curve AND abs(l.hz*2-t.hz) < 1e-9""",
)
def _(t):
    return rnd(se.harmonics(spec(t), K), "power")


@query(
    "cross_spectrum",
    f"""WITH {SP}, j AS (SELECT b.video_id, b.curve, b.hz, a.re*b.re+a.im*b.im AS xre, a.im*b.re-a.re*b.im AS xim FROM sp a JOIN sp b ON a.video_id=b.video_id AND a.hz=b.hz WHERE a.curve='L1' AND b.curve<>'L1'),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, curve ORDER BY sqrt(xre*xre+xim*xim) DESC, hz) AS r FROM j) WHERE r=1),
tp AS (SELECT video_id, curve, hz AS top FROM (SELECT *, row_number() OVER (PARTITION BY video_id, curve ORDER BY power DESC, hz) AS r FROM sp) WHERE r=1)
SELECT pk.video_id, pk.curve, pk.hz, round(degrees(atan2(xim,xre)),4) AS phase_deg, round(abs(tp.top-l.top),6) AS apart_hz, abs(tp.top-l.top) > 0.05 OR abs(degrees(atan2(xim,xre))) > 45 AS independent
FROM pk JOIN tp USING (video_id, curve) JOIN tp l ON l.video_id=pk.video_id AND l.curve='L1'""",
)
def _(t):
    d = se.cross_spectrum(spec(t), ["video_id"], hz_apart=0.05)
    return rnd(rnd(d, "phase_deg", n=4), "apart_hz")


@query(
    "epoch_fold",
    f"""WITH {SP}, tp AS (SELECT video_id, curve, hz FROM (SELECT *, row_number() OVER (PARTITION BY video_id, curve ORDER BY power DESC, hz) AS r FROM sp) WHERE r=1),
b AS (SELECT video_id, curve, CAST(floor(((t_s*hz)%1)*8) AS INT) AS bin, avg(dev) AS m, count(*) AS n FROM cu JOIN tp USING (video_id, curve) GROUP BY ALL),
k AS (SELECT video_id, curve, arg_max(bin, (m, -bin)) AS brightest FROM b GROUP BY ALL)
SELECT video_id, curve, brightest, round(sum(CASE WHEN ((bin-brightest+2)%8+8)%8 < 4 THEN m*n END)/sum(CASE WHEN ((bin-brightest+2)%8+8)%8 < 4 THEN n END) - sum(CASE WHEN ((bin-brightest+2)%8+8)%8 >= 4 THEN m*n END)/sum(CASE WHEN ((bin-brightest+2)%8+8)%8 >= 4 THEN n END),6) AS depth
FROM b JOIN k USING (video_id, curve) GROUP BY ALL""",
)
def _(t):
    c = curve(t)
    b = se.strongest(se.periodogram(c, K, FREQS), K, 0.02, 0.32)
    return rnd(se.epoch_fold(c, b, K), "depth")


@query(
    "regress_out",
    f"""WITH {CU}, r AS (SELECT *, sin(t_s/7) AS a, cos(t_s/5) AS b FROM cu),
g AS (SELECT video_id, curve, covar_pop(a,a) AS aa, covar_pop(b,b) AS bb, covar_pop(a,b) AS ab, covar_pop(a,dev) AS ay, covar_pop(b,dev) AS "by", var_pop(dev) AS yy FROM r GROUP BY ALL)
SELECT video_id, curve, round(((ay*bb-"by"*ab)*ay+("by"*aa-ay*ab)*"by")/(aa*bb-ab*ab)/yy,7) AS share FROM g""",
)
def _(t):
    d = se.regress_out(curve(t), K, F.sin(F.col("t_s") / 7), F.cos(F.col("t_s") / 5))
    return rnd(d.groupBy(*K).agg(F.first("share").alias("share")), "share", n=7)


@query(
    "scrambled_null",
    f"""WITH {CU}, ob AS (SELECT * FROM cu WHERE kind='object'), own AS (SELECT video_id, curve, max(power) AS power FROM {spec_sql('ob','video_id, curve')} GROUP BY ALL),
ch AS (SELECT video_id, curve, CAST(floor((idx-1)/30) AS BIGINT) AS ch, count(*) AS k, draw FROM ob, range(1,6) r(draw) GROUP BY ALL),
o AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY video_id, curve, draw ORDER BY md5('0|'||video_id||'|'||curve||'|'||ch||'|'||draw) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS off FROM ch),
sc AS (SELECT ob.video_id, ob.curve, draw, dev, CAST(off + (idx-1)%30 + 1 AS DOUBLE) AS t_s FROM ob JOIN o ON ob.video_id=o.video_id AND ob.curve=o.curve AND o.ch=CAST(floor((idx-1)/30) AS BIGINT)),
nl AS (SELECT video_id, curve, draw, max(power) AS p FROM {spec_sql('sc','video_id, curve, draw')} GROUP BY ALL)
SELECT video_id, curve, round(power,6) AS power, sum(CASE WHEN p >= power THEN 1 ELSE 0 END) AS as_strong, count(*) AS draws, round((sum(CASE WHEN p >= power THEN 1 ELSE 0 END)+1)/(count(*)+1),6) AS p FROM nl JOIN own USING (video_id, curve) GROUP BY video_id, curve, power""",
)
def _(t):
    d = se.scrambled_null(curve_idx(t).where("kind = 'object'"), K, FREQS, 1.0, 30, 5)
    return rnd(d, "power", "p")


@query(
    "kpss",
    f"""WITH {STATS_SQL}, r AS (SELECT video_id, idx, level - avg(level) OVER (PARTITION BY video_id) AS r FROM stats),
s AS (SELECT *, sum(r) OVER (PARTITION BY video_id ORDER BY idx) AS s, lag(r,1) OVER (PARTITION BY video_id ORDER BY idx) AS r1, lag(r,2) OVER (PARTITION BY video_id ORDER BY idx) AS r2, lag(r,3) OVER (PARTITION BY video_id ORDER BY idx) AS r3 FROM r)
SELECT video_id, count(*) AS n, round(sum(s*s)/(count(*)*count(*)),5) AS sums, round((sum(r*r)+2*(0.75*sum(r*r1)+0.5*sum(r*r2)+0.25*sum(r*r3)))/count(*),5) AS variance,
  round(sum(s*s)/(count(*)*count(*))/((sum(r*r)+2*(0.75*sum(r*r1)+0.5*sum(r*r2)+0.25*sum(r*r3)))/count(*)),5) AS kpss FROM s GROUP BY ALL""",
)
def _(t):
    return rnd(se.kpss(frame_stats(t.frames).withColumnRenamed("level", "v"), ["video_id"], 3), "sums", "variance", "kpss", n=5)


@query(
    "coverage_backtest",
    f"""WITH {STATS_SQL}, z AS (SELECT video_id, idx, (level-25.5)/3.0 AS v FROM stats), d AS (SELECT *, CASE WHEN abs(v) > 1.96 THEN 1 ELSE 0 END AS miss, v - avg(v) OVER (PARTITION BY video_id) AS w FROM z),
l AS (SELECT *, lag(miss) OVER o AS p, lag(w,1) OVER o AS w1, lag(w,2) OVER o AS w2 FROM d WINDOW o AS (PARTITION BY video_id ORDER BY idx)),
g AS (SELECT video_id, count(*) AS n, sum(miss) AS misses, stddev_pop(v) AS sd, sum(w*w) AS g0, sum(w*w1) AS g1, sum(w*w2) AS g2, sum(pow(w,3))/count(*)/pow(var_pop(v),1.5) AS skew, sum(pow(w,4))/count(*)/pow(var_pop(v),2)-3 AS kurtosis FROM l GROUP BY ALL)
SELECT video_id, n, misses, round(misses/n,6) AS share, round(sd,6) AS sd, round(skew,5) AS skew, round(kurtosis,5) AS kurtosis, round(n*(n+2)*(pow(g1/g0,2)/(n-1)+pow(g2/g0,2)/(n-2)),4) AS ljung_box, round(n/6*(skew*skew+kurtosis*kurtosis/4),3) AS jarque_bera FROM g""",
)
def _(t):
    d = se.coverage_backtest(frame_stats(t.frames).withColumn("v", (F.col("level") - 25.5) / 3.0), ["video_id"], lags=2)
    d = rnd(rnd(rnd(rnd(d, "share", "sd"), "skew", "kurtosis", n=5), "ljung_box", n=4), "jarque_bera", n=3)
    return d.select("video_id", "n", "misses", "share", "sd", "skew", "kurtosis", "ljung_box", "jarque_bera")


@query(
    "tau_rates",
    """WITH d AS (SELECT l_suppkey AS video_id, CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS t, ln(l_quantity) AS s, ln(l_extendedprice)-ln(1+l_tax) AS f FROM lineitem),
g AS (SELECT video_id, count(*) AS n, regr_slope(s,t) AS a, sqrt(greatest(regr_syy(s,t)-regr_slope(s,t)*regr_sxy(s,t),0)/(count(*)-2)/regr_sxx(s,t)) AS ae, regr_slope(f,t) AS b, sqrt(greatest(regr_syy(f,t)-regr_slope(f,t)*regr_sxy(f,t),0)/(count(*)-2)/regr_sxx(f,t)) AS be FROM d GROUP BY ALL HAVING count(*) > 2)
SELECT video_id, n, round(a,10) AS size_rate, round(ae,10) AS size_err, round(b,10) AS flux_rate, round(be,10) AS flux_err, round(CASE WHEN a <> 0 THEN 1/a END,4) AS tau_s FROM g""",
)
def _(t):
    d = t.lineitem.select(F.col("l_suppkey").alias("video_id"), F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("t_s"), F.col("l_quantity").alias("size"), F.col("l_extendedprice").alias("flux"), (1 + F.col("l_tax")).alias("bg"))
    return rnd(rnd(se.tau_rates(d, ["video_id"], "size", "flux", "bg"), "size_rate", "size_err", "flux_rate", "flux_err", n=10), "tau_s", n=4)


@query(
    "frame_modulo_lock",
    f"""WITH {CU}, m AS (SELECT video_id, curve, q, frame%q AS k, avg(dev) AS m FROM cu, range(2,9) r(q) GROUP BY ALL), s AS (SELECT video_id, curve, q, max(m)-min(m) AS spread FROM m GROUP BY ALL), d AS (SELECT video_id, curve, stddev_pop(dev) AS sd FROM cu GROUP BY ALL)
SELECT video_id, curve, q, round(spread/sd,6) AS lock FROM s JOIN d USING (video_id, curve)""",
)
def _(t):
    return rnd(se.frame_modulo_lock(curve(t), K), "lock")


@query(
    "held_balance",
    f"""WITH {STATS_SQL}, h AS (SELECT video_id, idx, coalesce(diff < 1, false) AS held FROM stats), i AS (SELECT video_id, idx - row_number() OVER (PARTITION BY video_id ORDER BY idx) AS g FROM h WHERE held),
r AS (SELECT video_id, g, count(*) AS len FROM i GROUP BY ALL), a AS (SELECT video_id, count(*) AS runs, max(len) AS longest, avg(len) AS mean_run FROM r GROUP BY ALL)
SELECT h.video_id, count(*) AS frames, round(avg(CASE WHEN held THEN 1.0 ELSE 0.0 END),6) AS share, any_value(runs) AS runs, any_value(longest) AS longest, round(any_value(mean_run),6) AS mean_run FROM h LEFT JOIN a USING (video_id) GROUP BY h.video_id""",
)
def _(t):
    st = frame_stats(t.frames).withColumn("held", F.coalesce(F.col("diff") < 1, F.lit(False)))
    return rnd(se.held_balance(st, ["video_id"]), "share", "mean_run")


@query(
    "inject_recover",
    f"""WITH {CU}, bg AS (SELECT * FROM cu WHERE kind='background'), pl AS (SELECT video_id, curve, t_s, a AS planted_amp, f AS planted_hz, dev + a*sin(2*pi()*f*t_s) AS dev FROM bg, (SELECT unnest([0.02,0.05,0.1,0.2]::DOUBLE[]) AS a), (SELECT unnest([0.06,0.14,0.22]::DOUBLE[]) AS f)),
s AS {spec_sql('pl', 'video_id, curve, planted_amp, planted_hz', "(SELECT unnest([0.06,0.14,0.22]::DOUBLE[]) AS hz)")},
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, curve, planted_amp, planted_hz ORDER BY power DESC, hz) AS r FROM s) WHERE r=1),
c AS (SELECT planted_amp, planted_hz, count(*) AS n, avg(CASE WHEN hz=planted_hz AND power >= 0.02 THEN 1.0 ELSE 0.0 END) AS found FROM b GROUP BY ALL)
SELECT planted_amp, planted_hz, n, round(found,9) AS found, min(CASE WHEN found >= 0.75 THEN planted_amp END) OVER (PARTITION BY planted_hz) AS complete_from FROM c""",
)
def _(t):
    return rnd(se.inject_recover(curve(t).where("kind = 'background'"), K, [0.02, 0.05, 0.1, 0.2], [0.06, 0.14, 0.22], 0.02), "found", n=9)


@query(
    "noise_distribution",
    f"""WITH {CU}, w AS (SELECT video_id, curve, t_s, dev, unnest(range(greatest(0, CAST(ceil((idx-64)/8.0) AS BIGINT)), CAST(floor((idx-1)/8.0) AS BIGINT)+1)) AS win FROM cu WHERE kind='background'),
s AS {spec_sql('w', 'video_id, curve, win', "(SELECT unnest([0.06,0.14,0.22]::DOUBLE[]) AS hz)")}
SELECT hz, round(quantile_cont(amplitude,0.5),6) AS p50, round(quantile_cont(amplitude,0.9),6) AS p90, round(quantile_cont(amplitude,0.99),6) AS p99 FROM s WHERE n >= 32 GROUP BY ALL""",
)
def _(t):
    d = row_index(curve(t).where("kind = 'background'"), K, "frame")
    return rnd(se.noise_distribution(d, K, [0.06, 0.14, 0.22], 64), "p50", "p90", "p99")


VID = "v AS (SELECT DISTINCT user_id AS video_id, CASE user_id%3 WHEN 0 THEN 30000/1001.0::DOUBLE WHEN 1 THEN 30.0::DOUBLE ELSE 25.0::DOUBLE END AS fps FROM events)"
ALIAS = "least(abs({h}-round_even({h}/fps,0)*fps), fps-abs({h}-round_even({h}/fps,0)*fps))"


def vids(t):
    return t.events.select(F.col("user_id").alias("video_id")).distinct().withColumn("fps", F.when(F.col("video_id") % 3 == 0, F.lit(30000 / 1001)).when(F.col("video_id") % 3 == 1, F.lit(30.0)).otherwise(F.lit(25.0)))


@query("alias", f"WITH {VID}, e AS (SELECT event_id, value*10 AS h, fps FROM events JOIN v ON user_id=video_id) SELECT event_id, round({ALIAS.format(h='h')},6) AS folded FROM e")
def _(t):
    e = t.events.select("event_id", F.col("user_id").alias("video_id"), (F.col("value") * 10).alias("h")).join(vids(t), "video_id")
    return rnd(e.select("event_id", se.alias_of(F.col("h"), F.col("fps")).alias("folded")), "folded")


LOOK = VID + f""",
look AS (SELECT video_id, {ALIAS.format(h='h')} AS hz, s AS source, fps FROM v, (VALUES (50.0::DOUBLE,'50 Hz'),(100.0,'100 Hz'),(60.0,'60 Hz'),(120.0,'120 Hz'),(400.0,'400 Hz'),(800.0,'800 Hz')) l(h,s)
  UNION ALL SELECT video_id, fps/k, 'fps/'||k, fps FROM v, range(3,7) r(k)),
tab AS (SELECT video_id, hz, source FROM look WHERE hz >= 1.5 AND hz <= 0.8*fps/2)"""


@query("lookalike_table", f"WITH {LOOK} SELECT video_id, round(hz,6) AS hz, source FROM tab")
def _(t):
    return rnd(se.lookalike_table(vids(t)), "hz")


@query(
    "hear_lookalikes",
    f"WITH {LOOK}, b AS (SELECT event_id, user_id AS video_id, value/5 AS hz, 0.05 AS resolution, CASE WHEN event_id%2=0 THEN 0.03 END AS err FROM events) SELECT event_id, tab.source, round(tab.hz,6) AS line_hz FROM b JOIN tab USING (video_id) WHERE abs(b.hz-tab.hz) <= CASE WHEN err IS NOT NULL AND tab.source LIKE 'fps/%' THEN 3*err ELSE resolution END",
)
def _(t):
    b = t.events.select("event_id", F.col("user_id").alias("video_id"), (F.col("value") / 5).alias("hz"), F.lit(0.05).alias("resolution"), F.when(F.col("event_id") % 2 == 0, 0.03).alias("err"))
    return rnd(se.hear_lookalikes(b, se.lookalike_table(vids(t))).select("event_id", "source", "line_hz"), "line_hz")


BANDS_SQL = ",".join(f"({lo}::DOUBLE,{hi}::DOUBLE,'{name}')" for lo, hi, name in se.LOOKALIKE_BANDS)


@query(
    "fold_band",
    f"""WITH {VID}, b AS (SELECT video_id, fps, lo, hi, name FROM v, (VALUES {BANDS_SQL}) b(lo, hi, name)),
e AS (SELECT *, unnest(list_concat([lo], list_transform(generate_series(CAST(floor(lo/(fps/2)) AS BIGINT)+1, CAST(floor(hi/(fps/2)) AS BIGINT)), lambda k: k*fps/2), [hi])) AS e FROM b),
p AS (SELECT *, lead(e) OVER (PARTITION BY video_id, name ORDER BY e) AS f FROM e),
a AS (SELECT video_id, name, least({ALIAS.format(h='e')}, {ALIAS.format(h='f')}) AS a, greatest({ALIAS.format(h='e')}, {ALIAS.format(h='f')}) AS b FROM p WHERE f IS NOT NULL),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY video_id, name ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-9 THEN 0 ELSE 1 END AS new FROM a),
g AS (SELECT *, sum(new) OVER (PARTITION BY video_id, name ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT video_id, name, round(min(a),4) AS first, round(max(b),4) AS last FROM g GROUP BY video_id, name, g""",
)
def _(t):
    bands = vids(t).select("video_id", "fps", F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.lit(n).alias("name")) for a, b, n in se.LOOKALIKE_BANDS])).alias("b")).select("video_id", "fps", "b.*")
    return rnd(se.fold_band(bands, ["video_id", "name"]), "first", "last", n=4)


@query(
    "beat_right",
    "SELECT event_id, abs(value/10-user_id%20) <= 0.4 OR abs(value/10-2*(user_id%20)) <= 0.4 OR (event_id%2=0 AND abs(value/5-user_id%20) <= 0.4) AS \"right\" FROM events",
)
def _(t):
    line = F.struct((F.col("value") / 10).alias("hz"), F.when(F.col("event_id") % 2 == 0, F.col("value") / 5).alias("double_hz"), F.lit(0.2).alias("resolution"))
    d = t.events.select("event_id", (F.col("user_id") % 20).cast("double").alias("hz"), F.array(line).alias("lines"))
    return se.beat_right(d, "hz", "lines").select("event_id", "right")


@query(
    "interval_cover",
    """WITH iv AS (SELECT o_custkey AS video_id, greatest(0, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT)) AS first, least(2500, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT) + CAST(floor(o_totalprice/10000) AS BIGINT)) AS last FROM orders),
c AS (SELECT * FROM iv WHERE last > first), d AS (SELECT DISTINCT video_id, unnest(range(first, last)) AS x FROM c) SELECT video_id, round(count(*)/2500.0,9) AS share FROM d GROUP BY ALL""",
)
def _(t):
    from skyloom.plans.q_windows import order_intervals

    return rnd(se.interval_cover(order_intervals(t), ["video_id"], 0, 2500), "share", n=9)
