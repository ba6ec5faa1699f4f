"""Readings of one thing at a time, as grouped plans: scene shifts, breaks, tones, pixels, companions, cutoffs, what-ifs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions.safe import div
from skyloom.functions import draws as dr
from skyloom.functions.chunked import CHUNK, previous, rolling, scan
from skyloom.functions.joins import dealt
from skyloom.functions.lineage import cut, share
from skyloom.functions.quantiles import exact_quantiles, robust_scale

G0 = 9.80665


def bin_label(v: Column, edges: Sequence[float]) -> Column:
    """P15. The half-open cell of fixed edges a value lies in, as text; null under the first."""
    out = F.lit(None).cast("string")
    for i in range(len(edges) - 1, -1, -1):
        name = f"{edges[i]:g}-{edges[i + 1]:g}" if i + 1 < len(edges) else f"over {edges[i]:g}"
        cond = v >= edges[i] if i + 1 == len(edges) else (v >= edges[i]) & (v < edges[i + 1])
        out = F.when(cond, name).otherwise(out)
    return out


def shaft_candidates(tones: DataFrame, airframes: DataFrame, blades: Sequence[int] = range(2, 9), match: float = 0.015) -> DataFrame:
    """P18. For each heard fundamental every (blades, rpm) it allows, and the airframes within 1.5 % of its blade-pass.
    A log-frequency bucket as wide as the match makes the theta join an equi-join.  Airframes of one blade-pass are one row of it,
    and so are tones of one frequency, however many there are of either."""
    w = -math.log1p(-match) * 1.01  # the wider side: a frequency below by the match
    b = F.explode(F.array(*[F.lit(int(k)) for k in blades])).alias("blades")
    a = airframes.groupBy("blades", "blade_pass_hz").agg(F.count(F.lit(1)).alias("_n"), F.min("airframe").alias("_first")).withColumn("_o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    a = a.withColumn("_k", F.floor(F.log("blade_pass_hz") / w) + F.col("_o")).drop("_o")
    heard = tones.select("hz").distinct().select("hz", b).withColumn("_k", F.floor(F.log("hz") / w))
    j = heard.join(a.hint("merge"), ["blades", "_k"], "left")
    hit = F.abs(div(F.col("hz"), F.col("blade_pass_hz")) - 1) <= match
    j = j.groupBy("hz", "blades").agg(F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0)).alias("airframes"), F.min(F.when(hit, F.col("_first"))).alias("first"))
    found = j.groupBy(F.col("hz").alias("_hz")).agg(F.collect_list(F.struct("blades", "airframes", "first")).alias("_b"))
    t = tones.groupBy("tone_id", "hz").agg(F.count(F.lit(1)).alias("_rows")).join(found, F.col("hz").eqNullSafe(F.col("_hz")))
    t = t.select("tone_id", "hz", "_rows", F.explode("_b").alias("b"))
    return t.select("tone_id", "b.blades", (60 * F.col("hz") / F.col("b.blades")).alias("rpm"), (F.col("b.airframes") * F.col("_rows")).alias("airframes"), "b.first")


#: Cylinders, and turns of the shaft in which each fires once.
ENGINES = [(n, turns) for turns in (2, 1) for n in (3, 4, 6, 8)]
#: Hz from a shaft's order within which a peak is that order's.
ORDER_TOL = 0.75


def engine_speeds(tones: DataFrame, engines: Sequence[tuple[int, int]] = ENGINES) -> DataFrame:
    """P18. The engines whose firing a fundamental may be: cylinders, turns a cycle and the speed (rpm) at which they fire so often."""
    e = F.explode(F.array(*[F.struct(F.lit(n).alias("cylinders"), F.lit(t).alias("turns")) for n, t in engines])).alias("e")
    return tones.select("tone_id", "hz", e).select("tone_id", "e.*", (60 * F.col("hz") * F.col("e.turns") / F.col("e.cylinders")).alias("rpm"))


def shaft_orders(peaks: DataFrame, shafts: DataFrame, orders: int = 24) -> DataFrame:
    """P18. How loud each order of a shaft is: the strongest peak near it in each window (nought where none is), averaged over the windows.

    ``peaks``: video_id, window, hz, excess_db; ``shafts``: video_id, rpm.  An order meets only peaks in the cells of its tolerance; each
    window's strongest is a partial maximum."""
    o = shafts.select("video_id", "rpm", F.explode(F.sequence(F.lit(1), F.lit(orders))).alias("order")).withColumn("_hz", F.col("order") * F.col("rpm") / 60)
    o = o.withColumn("_c", F.explode(F.sequence(F.floor((F.col("_hz") - ORDER_TOL) / (2 * ORDER_TOL)), F.floor((F.col("_hz") + ORDER_TOL) / (2 * ORDER_TOL)))))
    p = peaks.select("video_id", "window", "hz", "excess_db", F.floor(F.col("hz") / (2 * ORDER_TOL)).alias("_c"))
    near = p.join(o, ["video_id", "_c"]).where(F.abs(F.col("hz") - F.col("_hz")) <= ORDER_TOL)
    best = near.groupBy("video_id", "rpm", "order", "window").agg(F.max("excess_db").alias("_x")).groupBy("video_id", "rpm", "order").agg(F.sum("_x").alias("_x"))
    n = peaks.groupBy("video_id").agg(F.count_distinct("window").alias("windows"))
    every = o.select("video_id", "rpm", "order").distinct().join(n, "video_id")
    return every.join(best, ["video_id", "rpm", "order"], "left").select("video_id", "rpm", "order", "windows", (F.coalesce("_x", F.lit(0.0)) / F.col("windows")).alias("excess_db"))


def explain_lines(lines: DataFrame, families: Sequence[tuple[str, float, float, int]], harmonics: int = 40) -> DataFrame:
    """J19. Steady tones given to the first family that holds them: (name, fundamental Hz, tolerance Hz, least members).
    A family counts only with its least members, multiples up to the ``harmonics``-th; the families are a short list in order."""
    fam = F.array(*[F.struct(F.lit(i).alias("prio"), F.lit(n).alias("family"), F.lit(float(f)).alias("f0"), F.lit(float(t)).alias("tol"), F.lit(m).alias("least")) for i, (n, f, t, m) in enumerate(families)])
    j = lines.select("video_id", "line_id", "hz", F.explode(fam).alias("f")).select("video_id", "line_id", "hz", "f.*")
    k = F.rint(F.col("hz") / F.col("f0"))
    j = j.withColumn("k", k).where((F.col("k") >= 1) & (F.col("k") <= harmonics) & (F.abs(F.col("hz") - F.col("k") * F.col("f0")) <= F.col("tol")))
    j = share(j)
    ok = j.groupBy("video_id", "prio", "least").agg(F.count_distinct("k").alias("_m")).where(F.col("_m") >= F.col("least")).select("video_id", "prio")
    return j.join(ok, ["video_id", "prio"]).groupBy("video_id", "line_id").agg(F.min_by(F.struct("family", "k"), "prio").alias("b")).select("video_id", "line_id", "b.family", F.col("b.k").cast("int").alias("k"))


# What makes each kind of family.  ``lo`` and ``hi`` bound the fundamental, ``k`` the harmonic, ``rel`` and ``tol`` (Hz) how far a
# member may lie off; a family has ``least`` harmonics, ``low_n`` of them up to the ``low``-th, and its first is no higher than ``first``.
_KIND = ("prio", "family", "lo", "hi", "k", "rel", "tol", "least", "low", "low_n", "first")
FAMILY_KINDS = [
    *[(0, f"{codec} {rate}", rate / size, rate / size, 64, 0.0, 0.3, 3, 8, 2, 64) for codec, size in (("AAC", 1024), ("MP3", 1152)) for rate in (48000, 44100, 32000, 24000, 22050, 16000)],
    (1, "bus", 393.0, 407.0, 10, 0.0005, 0.0, 2, 10, 2, 10),
    (2, "mains 50", 49.5, 50.5, 40, 0.0005, 0.0, 2, 12, 2, 6),
    (2, "mains 60", 59.4, 60.6, 40, 0.0005, 0.0, 2, 12, 2, 6),
    (3, "series", 15.0, 500.0, 16, 0.003, 0.0, 3, 6, 3, 2),
]


def _multiples(lo: float, k: int) -> list[float]:
    """The harmonics of a known fundamental, multiplied as decimals: what SQL makes of the digits that a kind is written with."""
    return [float(Decimal(repr(float(lo))) * h) for h in range(1, k + 1)]


FEW_LINES = 20_000  # fixed value: a video of no more lines is taken whole by one task


def line_families(lines: DataFrame, kinds: Sequence[tuple] = FAMILY_KINDS, few: int = FEW_LINES) -> DataFrame:
    """J19. The families of steady tones, found from the tones (``video_id, line_id, hz, strength``): one row a line that one explains,
    with ``family``, its fundamental ``f0`` and the harmonic ``k``.  A line needs a video and an id; an unknown strength counts as nought.

    Every line votes for each fundamental it may be a harmonic of, in two grids of the logarithm of frequency, half a cell apart and as
    wide as a kind's members may scatter; a known fundamental is a cell of its own.  Then in rounds: of the cells that make a
    family, the first kind's with most harmonics (then strength, then the higher fundamental) takes its lines, until none makes one.

    Votes are dozens a line, so those of videos of up to ``few`` lines, counted first, are never written: the lines go to tasks that take
    some videos at a time through all their rounds.  Longer videos go through rounds of one table of votes.
    """
    kinds = [tuple(row) for row in kinds]
    lines = lines.where((F.col("hz") > 0) & F.col("video_id").isNotNull() & F.col("line_id").isNotNull())
    lines = lines.select("video_id", "line_id", F.col("hz").cast("double").alias("hz"), F.coalesce(F.col("strength").cast("double"), F.lit(0.0)).alias("strength"))
    many = cut(lines.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > few).select("video_id"))
    some = not many.isEmpty()
    short = dealt(lines.join(many, "video_id", "left_anti") if some else lines, "video_id").sortWithinPartitions("video_id")
    typed = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in ("video_id", "line_id"))
    found = short.mapInPandas(_families_of_videos(kinds), f"{typed}, family string, f0 double, k int")
    return found.unionByName(_families_by_rounds(lines.join(many, "video_id", "left_semi"), kinds)) if some else found


def _families_of_videos(kinds: list[tuple]):
    """``line_families`` of batches of lines that are sorted by video; needs nothing of this package where it runs."""
    col = {n: np.array([row[i] for row in kinds]) for i, n in enumerate(_KIND)}
    multiples = {i: np.array(_multiples(row[2], row[4])) for i, row in enumerate(kinds) if row[5] == 0}

    def sixth(x: np.ndarray) -> np.ndarray:
        y = x * 1e6
        return (np.floor(y) + (y - np.floor(y) >= 0.5)) / 1e6

    def votes(hz: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, kind, harmonic and cell of each vote."""
        out = []
        for i, (_, _, lo, hi, most, rel, tol, *_) in enumerate(kinds):
            if rel == 0:
                h = np.rint(hz / lo)
                row = np.flatnonzero((h >= 1) & (h <= most))
                row = row[np.abs(hz[row] - multiples[i][h[row].astype(int) - 1]) <= tol]
                out.append((row, i, h[row].astype(int), np.zeros(len(row), int)))
                continue
            least, last = np.ceil(hz / hi), np.floor(hz / lo)
            for h in range(1, most + 1):
                row = np.flatnonzero((least <= h) & (h <= last))
                half = np.log(hz[row] / h) / rel
                out += [(row, i, h, c.astype(int)) for c in (2 * np.floor(half / 2), 2 * np.floor((half + 1) / 2) - 1)]
        size = [len(o[0]) for o in out]
        return np.concatenate([o[0] for o in out]), np.repeat([o[1] for o in out], size), np.concatenate([np.broadcast_to(o[2], len(o[0])) for o in out]), np.concatenate([o[3] for o in out])

    def rounds(d: pd.DataFrame) -> pd.DataFrame:
        video, hz, strength = pd.factorize(d["video_id"])[0], d["hz"].to_numpy(), d["strength"].to_numpy()
        line = d.groupby(["video_id", "line_id"], sort=False).ngroup().to_numpy()  # rows of one id are one line
        first = np.unique(line, return_index=True)[1]
        row, kind, h, cell = votes(hz)
        o = np.lexsort((h, cell, kind, video[row]))
        row, kind, h, cell = row[o], kind[o], h[o], cell[o]
        taken, took = np.zeros(len(first), bool), []
        while len(row):
            v, at = video[row], lambda x: np.r_[True, x[1:] != x[:-1]]
            new = at(v) | at(kind) | at(cell)
            start = np.flatnonzero(new)
            own, total = np.cumsum(new) - 1, lambda x: np.add.reduceat(x, start)
            one, k = (new | at(h)).astype(int), kind[start]
            n = total(one)
            ok = (n >= col["least"][k]) & (total(one * (h <= col["low"][kind])) >= col["low_n"][k]) & (h[start] <= col["first"][k])
            f0 = sixth(total(h * hz[row]) / total((h * h).astype(float)))
            best = np.lexsort((cell[start], k, f0, sixth(total(strength[row])), n, -col["prio"][k], v[start]))
            best = best[ok[best]]
            best = best[np.r_[v[start][best][1:] != v[start][best][:-1], True]] if len(best) else best
            wins = np.zeros(len(start), bool)
            wins[best] = True
            mine = np.flatnonzero(wins[own])
            mine = mine[np.lexsort((h[mine], line[row[mine]]))]
            mine = mine[at(line[row[mine]])] if len(mine) else mine  # a line that is two harmonics of one cell counts as the lower
            took.append((first[line[row[mine]]], col["family"][kind[mine]], f0[own[mine]], h[mine]))
            taken[line[row[mine]]] = True
            left = ok[own] & ~taken[line[row]]  # a cell that makes no family never will: votes only go
            row, kind, h, cell = row[left], kind[left], h[left], cell[left]
        parts = [np.concatenate(x) for x in zip(*took)] if took else [np.zeros(0, int)] * 4
        out = d[["video_id", "line_id"]].iloc[parts[0]].reset_index(drop=True)
        return out.assign(family=parts[1].astype(object), f0=parts[2].astype(float), k=parts[3].astype("int32"))

    def run(batches):
        held = None  # the last video may go on in the next batch
        for d in batches:
            if not len(d):
                continue
            d = d if held is None else pd.concat([held, d], ignore_index=True)
            last = (d["video_id"] == d["video_id"].iloc[-1]).to_numpy()
            held = d[last].reset_index(drop=True)
            if not last.all():
                yield rounds(d[~last].reset_index(drop=True))
        if held is not None:
            yield rounds(held)

    return run


def _sixth(x: Column) -> Column:
    """To six decimals, halves up."""
    y = x * 1e6
    return (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)) / F.lit(1e6)


def _families_by_rounds(lines: DataFrame, kinds: list[tuple]) -> DataFrame:
    """``line_families`` in rounds of all videos at once.  Votes are summed before the shuffle; a cell that makes no family never will, so its
    votes go with the first round."""
    at = lambda row: F.lit(_multiples(row[2], row[4]) if row[5] == 0 else [0.0]).alias("at")
    kind = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(_KIND, row, strict=True)], F.lit(i).alias("id"), at(row)) for i, row in enumerate(kinds)])
    v = lines.select("video_id", "line_id", "hz", "strength", F.explode(kind).alias("f")).select("video_id", "line_id", "hz", "strength", "f.*")
    ks = lambda a, b: F.when(b >= a, F.sequence(a, b))
    given = F.array(F.rint(F.col("hz") / F.col("lo")).cast("long"))
    ranged = ks(F.greatest(F.ceil(F.col("hz") / F.col("hi")), F.lit(1).cast("long")), F.least(F.floor(F.col("hz") / F.col("lo")), F.col("k").cast("long")))
    v = v.withColumn("h", F.explode(F.when(F.col("rel") == 0, given).otherwise(ranged)))
    v = v.where((F.col("h") >= 1) & (F.col("h") <= F.col("k")) & ((F.col("rel") > 0) | (F.abs(F.col("hz") - F.get("at", (F.col("h") - 1).cast("int"))) <= F.col("tol"))))
    half = F.log(F.col("hz") / F.col("h")) / F.col("rel")  # cells are two of these wide
    cells = F.when(F.col("rel") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array(2 * F.floor(half / 2), 2 * F.floor((half + 1) / 2) - 1))
    v = v.select("video_id", "line_id", "hz", "strength", "id", F.col("h").cast("int").alias("h"), F.explode(cells).alias("cell"))
    own = lambda n: F.get(F.lit([row[_KIND.index(n)] for row in kinds]), F.col("id"))
    found = None
    cell = ["video_id", "id", "cell"]
    while True:
        low = F.when(F.col("h") <= own("low"), F.col("h"))
        g = v.groupBy(*cell).agg(
            F.count_distinct("h").alias("n"), F.count_distinct(low).alias("lows"), F.min("h").alias("h0"), F.sum("strength").alias("s"),
            (F.sum(F.col("h") * F.col("hz")) / F.sum((F.col("h") * F.col("h")).cast("double"))).alias("f0"),
        )
        g = share(g.where((F.col("n") >= own("least")) & (F.col("lows") >= own("low_n")) & (F.col("h0") <= own("first"))))
        best = g.groupBy("video_id").agg(F.max(F.struct((-own("prio")).alias("p"), "n", _sixth(F.col("s")).alias("s"), _sixth(F.col("f0")).alias("f0"), "id", "cell")).alias("b"))
        best = best.select("video_id", "b.id", "b.cell", "b.f0", F.get(F.lit([row[1] for row in kinds]), F.col("b.id")).alias("family"))
        # a line that is two harmonics of one cell counts as the lower
        took = share(v.join(best, cell).groupBy("video_id", "line_id", "family", "f0").agg(F.min("h").cast("int").alias("k")))
        if took.isEmpty():
            break
        found = took if found is None else found.unionByName(took)
        v = share(v.join(g.select(*cell), cell, "left_semi").join(took.select("video_id", "line_id"), ["video_id", "line_id"], "left_anti"))
    return took if found is None else found


# ---- windows ----------------------------------------------------------------------------------------------------------
def clock_ticks(ticks: DataFrame, fps: float, keys: Sequence[str], tol: float = 0.12) -> DataFrame:
    """W18. Is a box's run of ticks a clock: gaps steady at the frame rate; the ticks early or late by over 1.5 frames."""
    keys = list(keys)
    g = previous(ticks, keys, "frame", {"_p": F.col("frame")}).withColumn("gap", F.col("frame") - F.col("_p"))
    g = share(g)
    med = exact_quantiles(g, keys, "gap", {"med": 0.5})
    j = share(g.join(med, keys))
    steady = j.groupBy(*keys).agg(F.avg(F.when(F.col("gap").isNotNull(), (F.abs(F.col("gap") - F.col("med")) <= 0.25 * fps).cast("double"))).alias("_s"), F.first("med").alias("med"), F.count(F.lit(1)).alias("ticks"), F.min("frame").alias("_f0"))
    ok = steady.where((F.col("ticks") >= 4) & (F.abs(F.col("med") - fps) <= tol * fps) & (F.col("_s") >= 0.7))
    d = ticks.join(ok, keys).withColumn("k", F.rint((F.col("frame") - F.col("_f0")) / F.col("med")))
    fit = d.groupBy(*keys).agg(F.regr_slope("frame", "k").alias("period"), F.regr_intercept("frame", "k").alias("_i"))
    off = F.col("frame") - (F.col("period") * F.col("k") + F.col("_i"))
    return d.join(fit, keys).select(*keys, "frame", "ticks", "period", off.alias("off"), (F.abs(off) > 1.5).alias("early_late"))


def leverage_audit(track: DataFrame, keys: Sequence[str], draws: int = 59, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """W21. A track's frames to check: each frame's chance its leverage (1/N + (t-mean)^2/sum)/2, ``draws`` hashed draws
    with replacement, every frame where there are no more than that.  The cumulative weights are running sums; a draw
    meets the frames of its own slice of the unit interval only."""
    keys = list(keys)
    t = track.select(*keys, F.col("frame").cast("double").alias("_t"), "frame")
    s = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_t").alias("_m"), (F.var_pop("_t") * F.count(F.lit(1))).alias("_ss"))
    w = t.join(s, keys).withColumn("weight", F.coalesce((1 / F.col("n") + div(F.pow(F.col("_t") - F.col("_m"), 2), F.col("_ss"))) / 2, 1 / F.col("n")))
    c = share(scan(w, keys, "frame", {"_hi": ("sum", F.col("weight"))}, chunk=chunk))
    c = c.withColumn("_lo", F.col("_hi") - F.col("weight"))
    c = c.withColumn("_hi", F.when(F.col("_hi") > 1 - 1e-9, F.lit(1.0)).otherwise(F.col("_hi")))
    whole = c.where(F.col("n") <= draws).select(*keys, "frame", "weight", F.lit(1).cast("long").alias("times"))
    d = s.where(F.col("n") > draws).select(*keys, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_d"))
    d = d.withColumn("_u", dr.uniform(seed, *[F.col(k) for k in keys], F.col("_d"))).withColumn("_k", F.floor(F.col("_u") * 256))
    cb = c.where(F.col("n") > draws).withColumn("_k", F.explode(F.sequence(F.floor(F.col("_lo") * 256), F.floor(F.col("_hi") * 256))))
    hit = d.join(cb, [*keys, "_k"]).where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    return whole.unionByName(hit.groupBy(*keys, "frame", "weight").agg(F.count(F.lit(1)).alias("times")))


def company(props: DataFrame, apart: float = 60.0, degrees: float = 25.0, bucket: int = 400) -> DataFrame:
    """W23. How many others go the same way at the same time, over ``apart`` px away: direction within 25 degrees, speed
    within a factor of two.  Proposals meet in the slices of frames they share, each pair once."""
    sl = lambda d, a, b: d.withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))))
    a = sl(props.select("video_id", "prop_id", "first", "last", "x", "y", "vx", "vy"), "first", "last")
    b = sl(props.select("video_id", F.col("prop_id").alias("o"), F.col("first").alias("of"), F.col("last").alias("ol"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("vx").alias("ovx"), F.col("vy").alias("ovy")), "of", "ol")
    j = a.join(b, ["video_id", "_b"]).where((F.col("prop_id") != F.col("o")) & (F.col("first") <= F.col("ol")) & (F.col("last") >= F.col("of")))
    j = j.where(F.col("_b") == F.greatest(F.floor(F.col("first") / bucket), F.floor(F.col("of") / bucket)))
    s, so = F.hypot("vx", "vy"), F.hypot("ovx", "ovy")
    same = (F.col("vx") * F.col("ovx") + F.col("vy") * F.col("ovy") > math.cos(math.radians(degrees)) * s * so) & div(so, s).between(0.5, 2.0)
    far = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) > apart
    n = j.where(same & far).groupBy("video_id", "prop_id").agg(F.count(F.lit(1)).alias("company"))
    return props.join(n, ["video_id", "prop_id"], "left").withColumn("company", F.coalesce("company", F.lit(0)))


# ---- scene ------------------------------------------------------------------------------------------------------------
def consensus_shift(templates: DataFrame, tolx: float = 6.0, toly: float = 2.5, least: int = 8, keys=("video_id", "frame")) -> DataFrame:
    """A24. The largest group of a pair's template shifts that agree within (tolx, toly): the template with most
    neighbours seeds it, the median of those places it, and its members are those within the tolerance of that.  A pair
    has some hundreds of templates, ``k`` tells them apart.  ``templates``: keys, k, dx, dy.

    Equal shifts are one place with a count.  Places meet in cells of four tolerances, where only those near a border are
    copied; they are counted in the cell they met in, and medians are taken of the seed's neighbours alone."""
    keys = list(keys)
    t = share(templates.select(*keys, "k", "dx", "dy", (F.col("dx") / tolx).alias("_x"), (F.col("dy") / toly).alias("_y")))
    at = share(t.groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_w"), F.min("k").alias("k")))
    cell = lambda c, by=0: F.floor((F.col(c) + by) / 4)
    # a hair beyond the tolerance: a border never parts what the condition below lets meet
    cells = lambda c: F.explode(F.sequence(cell(c, -1.001), cell(c, 1.001)))
    b = at.withColumn("_cx", cells("_x")).withColumn("_cy", cells("_y")).select(*keys, "_cx", "_cy", F.col("_x").alias("_x_2"), F.col("_y").alias("_y_2"), F.col("_w").alias("_w_2"))
    a = at.withColumn("_cx", cell("_x")).withColumn("_cy", cell("_y")).drop("_w")
    near = (F.abs(F.col("_x") - F.col("_x_2")) <= 1) & (F.abs(F.col("_y") - F.col("_y_2")) <= 1)
    n = a.join(b.hint("merge"), [*keys, "_cx", "_cy"]).where(near).groupBy(*keys, "_cx", "_cy", "_x", "_y", "k").agg(F.sum("_w_2").alias("_n"))
    first = n.groupBy(*keys).agg(F.max_by(F.struct(F.col("_x").alias("_x_2"), F.col("_y").alias("_y_2")), F.struct("_n", -F.col("k"))).alias("f")).select(*keys, "f.*")
    seed = t.join(first, keys).where(near).groupBy(*keys).agg(F.struct(F.percentile("dx", F.lit(0.5)).alias("mx"), F.percentile("dy", F.lit(0.5)).alias("my")).alias("s"))
    m = t.join(seed, keys).where((F.abs(F.col("dx") - F.col("s.mx")) <= tolx) & (F.abs(F.col("dy") - F.col("s.my")) <= toly))
    g = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))
    return g.where(F.col("members") >= least)


def scene_state(pairs: DataFrame, still: float, fps: float) -> DataFrame:
    """A26. Shares of a video's pairs held still, moving and lost (no shift), and the moving pairs' speed a second."""
    s = F.hypot("dx", "dy") / F.col("k") * fps
    d = share(pairs.withColumn("_s", s))
    g = d.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg((F.col("_s") <= still).cast("double")).alias("_held"), F.avg(F.col("_s").isNull().cast("double")).alias("lost"),
        F.avg(F.coalesce(F.col("_s") <= still, F.lit(False)).cast("double")).alias("held"), F.avg(F.coalesce(F.col("_s") > still, F.lit(False)).cast("double")).alias("moving"),
    ).drop("_held")
    q = exact_quantiles(d.where(F.col("_s") > still), ["video_id"], "_s", {"p16": 0.16, "median": 0.5, "p84": 0.84})
    return g.join(q, "video_id", "left")


def integrate_comotion(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A27. Summed displacement of an object against the flow about it, in object diameters, over measured pairs only;
    its rate and direction.  Columns: rel_x, rel_y (null where not measured), diameter, t_s."""
    m = pairs.where(F.col("rel_x").isNotNull() & F.col("rel_y").isNotNull())
    sx, sy = F.sum(div(F.col("rel_x"), F.col("diameter"))), F.sum(div(F.col("rel_y"), F.col("diameter")))
    g = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), sx.alias("_x"), sy.alias("_y"), (F.max("t_s") - F.min("t_s")).alias("_t"))
    return g.select(*keys, "pairs", F.hypot("_x", "_y").alias("rel_d"), F.when(F.col("_t") > 0, F.hypot("_x", "_y") / F.col("_t")).alias("rel_d_per_s"), F.pmod(F.degrees(F.atan2(F.col("_x"), -F.col("_y"))), F.lit(360.0)).alias("direction_deg"))


def slew_scale(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A58. The pointer's turn per pixel of scene shift with an offset a stretch: demeaned within the stretch, one slope
    over all, its error, and whether it registers (over three errors).  Columns: stretch, theta, x."""
    keys = list(keys)
    m = readings.groupBy(*keys, "stretch").agg(F.count(F.lit(1)).alias("_n"), F.covar_pop("theta", "x").alias("_c"), F.var_pop("x").alias("_v"), F.var_pop("theta").alias("_w"))
    n = F.col("_n")
    g = m.groupBy(*keys).agg(F.sum(n * F.col("_c")).alias("xy"), F.sum(n * F.col("_v")).alias("xx"), F.sum(n * F.col("_w")).alias("yy"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("stretches")).where(F.col("xx") > 0)
    dof = F.greatest(F.col("n") - F.col("stretches") - 1, F.lit(1))
    g = g.withColumn("c", F.col("xy") / F.col("xx")).withColumn("err", F.sqrt(F.greatest(F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx"), F.lit(0.0)) / dof / F.col("xx")))
    return g.select(*keys, "n", "stretches", "c", "err", (F.abs("c") > 3 * F.col("err")).alias("registers"))


def north_rate(pointer: DataFrame, keys: Sequence[str], t: str = "t_s", theta: str = "theta", r: str = "r") -> DataFrame:
    """A57. The pointer's rate over a window, the radius as its check."""
    return pointer.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(theta, t).alias("rate_deg_s"), F.stddev_samp(r).alias("radius_sd"))


# ---- breaks -----------------------------------------------------------------------------------------------------------
def sup_wald_scan(track: DataFrame, keys: Sequence[str], trim: float = 0.15, chunk: int = CHUNK) -> DataFrame:
    """A46. The date of the largest change of velocity: running sums give both sides' regressions at every date in one
    pass; the statistic is the squared change of both slopes over their variances (the residuals taken as white)."""
    keys = list(keys)
    m = track.groupBy(*keys).agg(F.avg("t_s").alias("_mt"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    d = track.join(m, keys).select(*keys, "frame", (F.col("t_s") - F.col("_mt")).alias("t"), (F.col("x") - F.col("_mx")).alias("x"), (F.col("y") - F.col("_my")).alias("y"))
    sums = {"n": F.lit(1.0), "t": F.col("t"), "x": F.col("x"), "y": F.col("y"), "tt": F.col("t") * F.col("t"), "tx": F.col("t") * F.col("x"), "ty": F.col("t") * F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y")}
    d = share(d)
    c = scan(d, keys, "frame", {f"l_{k}": ("sum", v) for k, v in sums.items()}, chunk=chunk)
    tot = d.groupBy(*keys).agg(*[F.sum(v).alias(f"T_{k}") for k, v in sums.items()])
    c = c.join(tot, keys)
    L = lambda k: F.col(f"l_{k}")
    R = lambda k: F.col(f"T_{k}") - F.col(f"l_{k}")

    def side(S, v):
        sxx, sxy, syy = S("tt") - S("t") * S("t") / S("n"), S(f"t{v}") - S("t") * S(v) / S("n"), S(v + v) - S(v) * S(v) / S("n")
        return div(sxy, sxx), sxx, syy - div(sxy * sxy, sxx)

    ok = (L("n") >= F.greatest(trim * F.col("T_n"), F.lit(3.0))) & (R("n") >= F.greatest(trim * F.col("T_n"), F.lit(3.0)))
    stat = F.lit(0.0)
    for v in ("x", "y"):
        bl, sl, el = side(L, v)
        br, sr, er = side(R, v)
        s2 = (el + er) / (F.col("T_n") - 4)
        stat = stat + div((br - bl) * (br - bl), s2 * (div(F.lit(1.0), sl) + div(F.lit(1.0), sr)))
    c = c.where(ok & (F.col("T_n") > 6)).withColumn("wald", stat).where(F.col("wald").isNotNull() & ~F.isnan("wald"))
    return c.groupBy(*keys).agg(F.max_by("frame", F.struct("wald", -F.col("frame"))).alias("frame"), F.max("wald").alias("wald"))


def rate_band(track: DataFrame, keys: Sequence[str], window: int, least: int, chunk: int = CHUNK) -> DataFrame:
    """A77. The rate along the track in sliding windows of frames with its error, and over the track the spread of the
    windows' rates: regressions over bounded frames."""
    keys = list(keys)
    h = window // 2
    ex = {"vx": F.regr_slope("x", "t_s"), "vy": F.regr_slope("y", "t_s"), "n": F.count("x"), "_sxx": F.regr_sxx("x", "t_s"), "_syx": F.regr_syy("x", "t_s"), "_syy": F.regr_syy("y", "t_s")}
    d = rolling(track, keys, "frame", h, h, ex, chunk).where(F.col("n") >= least)
    e = lambda s, v: div(F.greatest(F.col(s) - F.col(v) * F.col(v) * F.col("_sxx"), F.lit(0.0)), (F.col("n") - 2) * F.col("_sxx"))
    return d.select(*keys, "frame", "n", F.hypot("vx", "vy").alias("rate"), F.sqrt(e("_syx", "vx") + e("_syy", "vy")).alias("err"))


def discontinuity(pairs: DataFrame, keys: Sequence[str], reach: float, placebo: Sequence[float]) -> DataFrame:
    """A60. The jump at a cutoff: a line either side of it, the difference of their values there, beside the same at
    placebo cutoffs; p is the share of placebos (and itself) with a jump as large.  Columns: x (from the cutoff), y."""
    keys = list(keys)
    cuts = F.explode(F.array(F.lit(0.0), *[F.lit(float(p)) for p in placebo])).alias("cut")
    d = pairs.select(*keys, "x", "y", cuts).withColumn("u", F.col("x") - F.col("cut")).where(F.abs("u") <= reach)
    side = lambda cond: (F.regr_intercept(F.when(cond, F.col("y")), F.col("u")), F.count(F.when(cond, 1)))
    (b, nb), (a, na) = side(F.col("u") < 0), side(F.col("u") >= 0)
    g = d.groupBy(*keys, "cut").agg((a - b).alias("jump"), nb.alias("before"), na.alias("after")).where((F.col("before") >= 3) & (F.col("after") >= 3))
    g = share(g)
    real = g.where(F.col("cut") == 0).drop("cut")
    null = g.where(F.col("cut") != 0).select(*keys, F.abs("jump").alias("_j"))
    j = real.join(null, keys, "left").groupBy(*keys, "jump", "before", "after").agg(F.count("_j").alias("placebos"), F.sum((F.col("_j") >= F.abs("jump")).cast("long")).alias("_k"))
    return j.select(*keys, "jump", "before", "after", "placebos", ((F.coalesce("_k", F.lit(0)) + 1) / (F.col("placebos") + 1)).alias("p"))


def block_bootstrap(residuals: DataFrame, keys: Sequence[str], block: int, draws: int, seed: int = 0) -> DataFrame:
    """A21. The slope's error under serial correlation: moving blocks of a fit's residuals in hashed order, the slope of
    each draw, their deviation.  Columns: idx (1..n), t_s, r.  Block starts are hashed; residuals follow by equi-join."""
    keys = list(keys)
    n = residuals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    b = n.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    start = F.floor(dr.uniform(seed, *[F.col(k) for k in keys], F.col("draw"), F.col("_j")) * (F.col("n") - block + 1))
    b = b.withColumn("_s", start).withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(block))))
    b = b.select(*keys, "draw", "n", (F.col("_j") * block + F.col("_i")).alias("to"), (F.col("_s") + F.col("_i")).alias("idx")).where(F.col("to") <= F.col("n"))
    # ``draws`` times the residuals, which the planner takes for a row a key: neither join may send a side through the driver
    r = b.hint("merge").join(residuals.select(*keys, "idx", "r"), [*keys, "idx"]).hint("merge").join(residuals.select(*keys, F.col("idx").alias("to"), "t_s"), [*keys, "to"])
    s = r.groupBy(*keys, "draw").agg(F.regr_slope("r", "t_s").alias("b"))
    return s.groupBy(*keys).agg(F.count(F.lit(1)).alias("draws"), F.stddev_samp("b").alias("slope_err"))


# ---- tones, companions ------------------------------------------------------------------------------------------------
def sound_lines(peaks: DataFrame, gap: float = 0.6, share_: float = 0.5, steady: float = 0.2) -> DataFrame:
    """A49. Steady tones: peaks in order of frequency, a new group at a gap over ``gap`` Hz, the strongest peak a window,
    in half of the windows or more; median and spread.  ``peaks``: video_id, window, hz, excess_db."""
    ck = F.floor(F.col("hz")).cast("long")
    d = scan(peaks, ["video_id"], "hz", {"_p": ("last", F.col("hz"))}, exclusive=True, ties=["window"], pos_chunk=ck)
    d = scan(d, ["video_id"], "hz", {"line": ("sum", F.when(F.col("_p").isNull() | (F.col("hz") - F.col("_p") > gap), 1).otherwise(0))}, ties=["window"], pos_chunk=ck)
    w = peaks.groupBy("video_id").agg(F.count_distinct("window").alias("_w"))
    one = share(d.groupBy("video_id", "line", "window").agg(F.max_by("hz", F.struct("excess_db", -F.col("hz"))).alias("hz"), F.max("excess_db").alias("db")))
    g = one.groupBy("video_id", "line").agg(F.count(F.lit(1)).alias("windows"), F.stddev_pop("hz").alias("sd"), F.avg("db").alias("db"))
    q = exact_quantiles(one, ["video_id", "line"], "hz", {"hz": 0.5})
    return g.join(w, "video_id").where(F.col("windows") >= share_ * F.col("_w")).join(q, ["video_id", "line"]).select("video_id", "hz", "sd", "db", "windows", (F.col("sd") <= steady).alias("steady"))


def companion_behaviour(companion: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A51. How much of the scene's (or screen's) motion is in a companion's places within stretches: demeaned cross
    products over squares, summed over the stretches.  Columns: stretch, own_x, own_y, v_x, v_y, held."""
    keys = list(keys)
    m = companion.groupBy(*keys, "stretch").agg(F.count(F.lit(1)).alias("_n"), *[F.covar_pop(f"own_{c}", f"v_{c}").alias(f"_c{c}") for c in "xy"], *[F.var_pop(f"v_{c}").alias(f"_v{c}") for c in "xy"], F.sum(F.col("held").cast("long")).alias("_h"))
    n = F.col("_n")
    g = m.groupBy(*keys).agg(F.sum(n).alias("frames"), F.sum("_h").alias("_h"), F.sum(n * (F.col("_cx") + F.col("_cy"))).alias("_c"), F.sum(n * (F.col("_vx") + F.col("_vy"))).alias("_v"), F.count(F.lit(1)).alias("stretches"))
    return g.select(*keys, "frames", "stretches", (F.col("_h") / F.col("frames")).alias("held_share"), F.when(F.col("_v") > 0, F.col("_c") / F.col("_v")).alias("share"))


def swing_period(angles: DataFrame, keys: Sequence[str], freqs: Sequence[float]) -> DataFrame:
    """A52. The strongest period of a companion's angle about its own line, the cycles seen and the pendulum's length
    g T^2 / 4 pi^2.  Columns: t_s, angle."""
    from skyloom.operators.series import periodogram, strongest

    keys = list(keys)
    f = angles.groupBy(*keys).agg(F.regr_slope("angle", "t_s").alias("_b"), F.regr_intercept("angle", "t_s").alias("_a"), (F.max("t_s") - F.min("t_s")).alias("_t"))
    d = share(angles.join(f, keys).select(*keys, "t_s", "_t", (F.col("angle") - (F.col("_b") * F.col("t_s") + F.col("_a"))).alias("dev")))
    s = strongest(periodogram(d, keys, freqs), keys, min(freqs), max(freqs))
    span = f.select(*keys, "_t")
    return s.join(span, keys).select(*keys, (1 / F.col("hz")).alias("period_s"), "power", "fap", (F.col("_t") * F.col("hz")).alias("cycles"), (G0 / F.pow(F.col("hz"), 2) / (4 * math.pi**2)).alias("length_m"))


# ---- pixels -----------------------------------------------------------------------------------------------------------
def pixel_stats(pixels: DataFrame, dark: float, bright: float, share_: float = 0.95) -> DataFrame:
    """A53. Each place of the picture over a video: mean pattern, whether it is dark or bright on nearly all frames (a
    mask), and the spread.  One pass of sums."""
    g = pixels.groupBy("video_id", "y", "x").agg(
        F.count(F.lit(1)).alias("frames"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.avg((F.col("v") <= dark).cast("double")).alias("_d"), F.avg((F.col("v") >= bright).cast("double")).alias("_b"))
    return g.select("video_id", "y", "x", "frames", "mean", "sd", F.when(F.col("_d") >= share_, "dark").when(F.col("_b") >= share_, "bright").alias("mask"))


def pixels_around(points: DataFrame, pixels: DataFrame, far: int) -> DataFrame:
    """Every track point with the pixels up to ``far`` from it along both axes: ``dx``, ``dy``, ``v``.  Both sides meet in tiles
    as wide as that square, of which a point touches four at most."""
    size = 2 * far + 1
    tile = lambda c: F.floor(c / F.lit(size))
    span = lambda c: F.explode(F.sequence(tile(F.col(c) - far), tile(F.col(c) + far)))
    p = points.select("video_id", "object_id", "frame", F.round("x").cast("long").alias("_cx"), F.round("y").cast("long").alias("_cy"))
    p = p.withColumn("_tx", span("_cx")).withColumn("_ty", span("_cy"))
    q = pixels.select("video_id", "frame", "y", "x", "v", tile(F.col("x")).alias("_tx"), tile(F.col("y")).alias("_ty"))
    # the planner counts an exploded side as one copy
    j = q.join(p.hint("merge"), ["video_id", "frame", "_tx", "_ty"])
    j = j.select("video_id", "object_id", "frame", (F.col("x") - F.col("_cx")).alias("dx"), (F.col("y") - F.col("_cy")).alias("dy"), "v")
    return j.where(F.col("dx").between(-far, far) & F.col("dy").between(-far, far))


def aperture_photometry(points: DataFrame, pixels: DataFrame, r: float, ring: tuple[float, float]) -> DataFrame:
    """A54. Sum over a disc of the pixels less the ring's median, at every track point: the disc's and ring's offsets are
    a short list of literals."""
    far = int(math.ceil(ring[1]))
    size = 2 * far + 1
    cells = {i * size + j: math.hypot(i, j) for i in range(-far, far + 1) for j in range(-far, far + 1)}
    disc = [c for c, d in cells.items() if d <= r]
    ringed = [c for c, d in cells.items() if d > r and ring[0] <= d <= ring[1]]
    cell = F.col("dx") * size + F.col("dy")
    part = F.when(cell.isin(disc), "disc").when(cell.isin(ringed), "ring")
    j = pixels_around(points, pixels, far).withColumn("part", part).where(F.col("part").isNotNull())
    g = j.groupBy("video_id", "object_id", "frame").agg(
        F.sum(F.when(F.col("part") == "disc", F.col("v"))).alias("_s"), F.count(F.when(F.col("part") == "disc", 1)).alias("pixels"), F.percentile(F.when(F.col("part") == "ring", F.col("v")), F.lit(0.5)).alias("background"))
    return g.where((F.col("pixels") > 0) & F.col("background").isNotNull()).select("video_id", "object_id", "frame", "pixels", "background", (F.col("_s") - F.col("pixels") * F.col("background")).alias("brightness"))


def object_stack(points: DataFrame, pixels: DataFrame, radius: int) -> DataFrame:
    """A55. The mean picture about an object: pixels by their place from its track, averaged over frames (summed before
    the shuffle)."""
    j = pixels_around(points, pixels, radius).withColumns({"dx": F.col("dx").cast("int"), "dy": F.col("dy").cast("int")})
    return j.groupBy("video_id", "object_id", "dy", "dx").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("frames"))


# ---- answers ----------------------------------------------------------------------------------------------------------
def curve_stats(curve: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """A4. An object's brightness spread over its median, its frame-to-frame spread over the same, and that over its
    background apertures' own.  Columns: curve, kind, frame, value."""
    keys = list(keys)
    k = [*keys, "curve", "kind"]
    p = previous(curve, k, "frame", {"_p": F.struct("frame", "value")}, chunk=chunk)
    step = F.when(F.col("_p.frame") == F.col("frame") - 1, F.col("value") - F.col("_p.value"))
    p = share(p.select(*k, "value", step.alias("step")))
    a = robust_scale(p, k, "value").select(*k, F.col("med").alias("_med"), F.col("scale").alias("_var"))
    b = robust_scale(p.where(F.col("step").isNotNull()), k, "step").select(*k, (F.col("scale") / math.sqrt(2)).alias("_fast"))
    s = share(a.join(b, k, "left"))
    bg = s.where(F.col("kind") == "background").groupBy(*keys).agg(F.percentile("_fast", F.lit(0.5)).alias("_bg"))  # a few apertures
    o = s.where(F.col("kind") == "object").join(bg, keys, "left")
    return o.select(*keys, "curve", div(F.col("_var"), F.abs("_med")).alias("light_var"), div(F.col("_fast"), F.abs("_med")).alias("light_fast"), F.when(F.col("_bg") > 0, F.col("_fast") / F.col("_bg")).alias("light_over_bg"))


def blind_scorecard(objects: DataFrame, named: Sequence[str]) -> DataFrame:
    """A69. Each case's verdict from its objects' labels against the class it is known to be, and whether they agree."""
    hit = F.col("label").isin(*named)
    g = objects.groupBy("case_id", "known").agg(F.bool_or(hit).alias("_h"), F.count("label").alias("judged"), F.count(F.lit(1)).alias("objects"))
    v = F.when(F.col("judged") == 0, "no power").when(F.col("_h"), "named").otherwise("not named")
    return g.select("case_id", "known", "objects", v.alias("verdict"), F.when(F.col("judged") > 0, F.col("_h") == F.col("known").isin(*named)).alias("agrees"))


def value_of_information(objects: DataFrame, unknowns: dict[str, tuple[float, float]], speed: Column, under: float, draws: int = 64, bins: int = 4, seed: int = 0) -> DataFrame:
    """A78. Which unknown would settle most of P(speed < ``under``): hashed draws of the unknowns over their ranges, and the
    drop in entropy when one is known to its quarter.  Draws are made in each object's own row and summed at once."""
    d = objects.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    d = d.withColumns({f"_u_{k}": dr.uniform(f"{seed}-{k}", F.col("object_id"), F.col("_d")) for k in unknowns})
    d = d.withColumns({k: F.lit(lo) + F.col(f"_u_{k}") * (hi - lo) for k, (lo, hi) in unknowns.items()})
    d = d.withColumn("_hit", (speed < under).cast("double"))
    h = lambda p: F.when((p > 0) & (p < 1), -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(F.lit(0.0))
    tag = F.explode(F.array(*[F.struct(F.lit(k).alias("unknown"), F.floor(F.col(f"_u_{k}") * bins).cast("int").alias("bin")) for k in unknowns]))
    c = d.select("object_id", "_hit", tag.alias("_t")).groupBy("object_id", "_t.unknown", "_t.bin").agg(F.count(F.lit(1)).alias("n"), F.sum("_hit").alias("k"))
    c = c.withColumn("_hb", F.col("n") * h(F.col("k") / F.col("n")))
    g = c.groupBy("object_id", "unknown").agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"), F.sum("_hb").alias("_hb"))
    return g.select("object_id", "unknown", (F.col("_k") / F.col("_n")).alias("p"), (h(F.col("_k") / F.col("_n")) - F.col("_hb") / F.col("_n")).alias("bits"))


def dash_spectrum(spectra: DataFrame, keys: Sequence[str], step_hz: float) -> DataFrame:
    """A80. Spectra of many dashes on one axis: each frequency over the dash's own speed, summed by bin.  Columns: cycles
    (per px), power, speed (px a second)."""
    d = spectra.where(F.col("speed") > 0).withColumn("bin", F.floor(F.col("cycles") * F.col("speed") / step_hz))
    return d.groupBy(*keys, "bin").agg(F.sum("power").alias("power"), F.count(F.lit(1)).alias("dashes"))
