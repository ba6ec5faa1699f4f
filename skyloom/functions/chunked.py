"""Ordered computation over long series without putting a whole series into one task.

``Window.partitionBy(video)`` sends every row of a video to one task. One video may hold a third of a corpus, so the
helpers here cut a series into chunks of a fixed length of its integer position and work on (key, chunk) groups, which
are bounded whatever the key holds:

* ``rolling``  -- bounded frames (medians of 21 frames, running means): rows near a border are copied to the
  neighbouring chunk, so each chunk sees its whole surroundings.
* ``scan``     -- unbounded frames (running sums, last value seen, running maximum): the chunk's own running value,
  started from a one-row-a-chunk summary of what came before.  The summary is 1/CHUNK of the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions.lineage import share

CHUNK = 65536


def _chunk(n: Column, size: int) -> Column:
    return F.floor(n / F.lit(size)).cast("long")


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    before: int,
    after: int,
    exprs: Mapping[str, Column],
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``exprs`` (aggregates) over the rows whose ``pos`` lies in [pos-before, pos+after]."""
    assert chunk >= before + after
    spread = df.withColumn(
        "_c",
        F.explode(F.sequence(_chunk(F.col(pos) - after, chunk), _chunk(F.col(pos) + before, chunk))),
    )
    w = W.partitionBy(*keys, "_c").orderBy(F.col(pos).cast("long")).rangeBetween(-before, after)
    out = spread.select("*", *[e.over(w).alias(name) for name, e in exprs.items()])
    return out.where(F.col("_c") == _chunk(F.col(pos), chunk)).drop("_c")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    spec: Mapping[str, tuple[str, Column]],
    exclusive: bool = False,
    ties: Sequence[str] = (),
    chunk: int = CHUNK,
    pos_chunk: Column | None = None,
) -> DataFrame:
    """Add running values along ``pos`` within ``keys``.

    ``spec`` maps an output name to (kind, column), kind being ``sum``, ``count`` (of non-nulls), ``max``, ``min``,
    ``last`` (latest non-null at or before the row) or ``next`` (earliest non-null at or after it).  ``exclusive``
    leaves the row's own value out.  ``pos_chunk`` replaces the fixed-length chunk id for positions that are not
    integers; it must not decrease along ``pos``.
    """
    back = {k: v for k, v in spec.items() if v[0] != "next"}
    ahead = {k: v for k, v in spec.items() if v[0] == "next"}
    base = df.withColumn("_c", _chunk(F.col(pos), chunk) if pos_chunk is None else pos_chunk)
    base = share(base.select("*", *[v[1].alias(f"_v_{k}") for k, v in spec.items()]))
    order = [F.col(pos)] + [F.col(t) for t in ties]
    ordkey = F.struct(*order)

    def whole(name: str, kind: str) -> Column:
        c = F.col(f"_v_{name}")
        if kind == "sum":
            e = F.sum(c)
        elif kind == "count":
            e = F.count(c)
        elif kind == "max":
            e = F.max(c)
        elif kind == "min":
            e = F.min(c)
        elif kind == "last":
            e = F.max_by(c, F.when(c.isNotNull(), ordkey))
        elif kind == "next":
            e = F.min_by(c, F.when(c.isNotNull(), ordkey))
        else:
            raise ValueError(kind)
        return e.alias(f"_s_{name}")

    summary = base.groupBy(*keys, "_c").agg(*[whole(k, v[0]) for k, v in spec.items()])
    wb = W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    wa = W.partitionBy(*keys).orderBy("_c").rowsBetween(1, W.unboundedFollowing)

    def before(name: str, kind: str) -> Column:
        c = F.col(f"_s_{name}")
        f = {
            "sum": lambda: F.sum(c).over(wb),
            "count": lambda: F.sum(c).over(wb),
            "max": lambda: F.max(c).over(wb),
            "min": lambda: F.min(c).over(wb),
            "last": lambda: F.last(c, True).over(wb),
            "next": lambda: F.first(c, True).over(wa),
        }[kind]()
        return f.alias(f"_o_{name}")

    offsets = summary.select(*keys, "_c", *[before(k, v[0]) for k, v in spec.items()])

    end = -1 if exclusive else 0
    w = W.partitionBy(*keys, "_c").orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    wn = W.partitionBy(*keys, "_c").orderBy(*order).rowsBetween(1 if exclusive else 0, W.unboundedFollowing)
    own = []
    for k, (kind, _) in back.items():
        c = F.col(f"_v_{k}")
        f = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda x: F.last(x, True)}[kind]
        own.append(f(c).over(w).alias(f"_r_{k}"))
    for k in ahead:
        own.append(F.first(F.col(f"_v_{k}"), True).over(wn).alias(f"_r_{k}"))
    run = base.select("*", *own)
    joined = run.join(offsets, [*keys, "_c"], "left") if keys else run.join(offsets, ["_c"], "left")

    def total(name: str, kind: str) -> Column:
        r, o = F.col(f"_r_{name}"), F.col(f"_o_{name}")
        if kind == "sum":
            c = F.when(r.isNull() & o.isNull(), F.lit(None)).otherwise(F.coalesce(r, F.lit(0)) + F.coalesce(o, F.lit(0)))
        elif kind == "count":
            c = F.coalesce(r, F.lit(0)) + F.coalesce(o, F.lit(0))
        elif kind == "max":
            c = F.greatest(r, o)
        elif kind == "min":
            c = F.least(r, o)
        else:
            c = F.coalesce(r, o)
        return c.alias(name)

    keep = [c for c in df.columns if c not in spec]
    return joined.select(*keep, *[total(k, v[0]) for k, v in spec.items()])


def row_index(df: DataFrame, keys: Sequence[str], pos: str, out: str = "idx", **kw) -> DataFrame:
    """Dense 1-based position of each row along ``pos`` within ``keys``."""
    return scan(df, keys, pos, {out: ("count", F.lit(1))}, **kw)


def previous(df: DataFrame, keys: Sequence[str], pos: str, cols: Mapping[str, Column], **kw) -> DataFrame:
    """The preceding row's values (as ``lag``); pass non-null columns, or a struct to carry nulls."""
    return scan(df, keys, pos, {k: ("last", c) for k, c in cols.items()}, exclusive=True, **kw)


def following(df: DataFrame, keys: Sequence[str], pos: str, cols: Mapping[str, Column], **kw) -> DataFrame:
    return scan(df, keys, pos, {k: ("next", c) for k, c in cols.items()}, exclusive=True, **kw)


def islands(df: DataFrame, keys: Sequence[str], pos: str, gap: int = 1, out: str = "island", chunk: int = CHUNK) -> DataFrame:
    """Number the runs of rows whose positions follow each other by at most ``gap``.

    Breaks inside a chunk are counted there; whether a chunk's first row continues the run before it is read from the
    one-row-a-chunk summary."""
    base = share(df.withColumn("_c", _chunk(F.col(pos), chunk)))
    w = W.partitionBy(*keys, "_c").orderBy(pos)
    brk = F.when(F.col(pos) - F.lag(pos).over(w) > gap, 1).otherwise(0)
    inner = base.select("*", brk.alias("_b"))
    summary = inner.groupBy(*keys, "_c").agg(F.min(pos).alias("_f"), F.max(pos).alias("_l"), F.sum("_b").alias("_n"))
    ws = W.partitionBy(*keys).orderBy("_c")
    head = F.when(F.lag("_l").over(ws).isNull() | (F.col("_f") - F.lag("_l").over(ws) > gap), 1).otherwise(0)
    offs = summary.select(*keys, "_c", "_n", head.alias("_h")).select(
        *keys, "_c",
        (F.coalesce(F.sum(F.col("_h") + F.col("_n")).over(ws.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("_h")).alias("_o"),
    )
    run = inner.select("*", F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_r"))
    return run.join(offs, [*keys, "_c"]).select(*df.columns, (F.col("_o") + F.col("_r")).alias(out))


def runs(df: DataFrame, keys: Sequence[str], pos: str, gap: int = 1, **kw) -> DataFrame:
    """One row per island: first, last position and the rows in it (combined map-side before the shuffle)."""
    return (
        islands(df, keys, pos, gap, **kw)
        .groupBy(*keys, "island")
        .agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("n"))
        .drop("island")
    )
