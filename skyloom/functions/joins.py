"""Interval, as-of and near-point joins as bucketed equi-joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.chunked import scan


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    first: str,
    last: str,
    width: int = 1024,
    how: str = "inner",
) -> DataFrame:
    """Rows of ``points`` with every interval of the same key that holds ``at`` (both ends inclusive).

    Both sides carry a bucket of ``width`` positions, which makes the range condition an equi-join and spreads a hot
    key over its buckets.
    """
    b = intervals.withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width)))
    )
    a = points.withColumn("_b", F.floor(F.col(at) / width))
    left = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    cond = F.col("a._b") == F.col("b._b")
    for c in left:
        cond = cond & c
    cond = cond & (F.col(f"a.{at}") >= F.col(f"b.{first}")) & (F.col(f"a.{at}") <= F.col(f"b.{last}"))
    # the planner does not count the copies a bucket, and would send them through the driver
    j = a.alias("a").join(b.hint("merge").alias("b"), cond, how)
    extra = [c for c in intervals.columns if c not in keys]
    return j.select(*[F.col(f"a.{c}") for c in points.columns], *[F.col(f"b.{c}") for c in extra])


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    cols: Mapping[str, tuple[str, str]],
    chunk: int,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Each left row with the right side's latest or earliest values around its ``at`` (equal times count both ways).

    ``cols`` maps an output to (``last`` | ``next``, right column).  One shuffle by (key, chunk of time).
    """
    names = {src for _, src in cols.values()}
    lcols = [c for c in left.columns]
    l_ = left.select(*lcols, *[F.lit(None).cast(right.schema[s].dataType).alias(f"_x_{s}") for s in names], F.lit(1).alias("_side"))
    r_ = right.select(
        *[F.col(c) if c in [*keys, at] else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in lcols],
        *[F.col(s).alias(f"_x_{s}") for s in names],
        F.lit(0).alias("_side"),
    )
    both = l_.unionByName(r_)
    back = {o: ("last", F.col(f"_x_{s}")) for o, (k, s) in cols.items() if k == "last"}
    ahead = {o: ("next", F.col(f"_x_{s}")) for o, (k, s) in cols.items() if k == "next"}
    if back:
        both = scan(both, keys, at, back, ties=["_side", *ties], chunk=chunk)
    if ahead:
        both = both.withColumn("_eside", -F.col("_side"))
        both = scan(both, keys, at, ahead, ties=["_eside", *ties], chunk=chunk)
    return both.where(F.col("_side") == 1).select(*lcols, *cols.keys())


def near_pairs(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    dist: float,
) -> DataFrame:
    """Pairs within ``dist`` of each other under equal keys: grid cells of ``dist``, the right side copied to the nine
    around it.  Columns of ``b`` come out with the suffix ``_2``."""
    cell = lambda c: F.floor(F.col(c) / F.lit(dist))
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b2 = b.select(*[F.col(c).alias(c if c in keys else f"{c}_2") for c in b.columns])
    b2 = b2.withColumn("_o", F.explode(offs))
    b2 = b2.withColumn("_cx", F.floor(F.col(f"{x}_2") / dist) + F.col("_o.i")).withColumn(
        "_cy", F.floor(F.col(f"{y}_2") / dist) + F.col("_o.j")
    )
    a2 = a.withColumn("_cx", cell(x)).withColumn("_cy", cell(y))
    # the planner counts the exploded side as one copy and would send all nine through the driver
    j = a2.join(b2.drop("_o").hint("merge"), [*keys, "_cx", "_cy"])
    d = F.hypot(F.col(x) - F.col(f"{x}_2"), F.col(y) - F.col(f"{y}_2"))
    return j.where(d <= dist).drop("_cx", "_cy")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over the session's shuffle partitions, 200 at least, which adaptive execution leaves apart: it
    joins partitions by their packed size, and ordered numbers pack so well that one task would then hold gigabytes."""
    return df.repartition(max(200, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)
