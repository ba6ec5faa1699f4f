"""Exact quantiles of groups of any size.

The built-in exact ``percentile`` keeps every distinct value of a group in one task's memory.  It is used where the
largest group, which is counted first, is known to fit (SMALL values).  A group holding a third of the corpus does not:
there a bounded sketch brackets each wanted rank, one pass counts what lies below
the bracket, and only the bracket's own values (about 4/ACC of the group, ties collapsed) are ordered.  The result is
the linear-interpolation quantile, the same as ``percentile``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions.lineage import share

ACC = 10000
SMALL = 200_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group (counted map-side first; one number comes back)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    acc: int = ACC,
    largest: int | None = None,
    small: int = SMALL,
) -> DataFrame:
    """One row a key: the quantiles named in ``probs`` of ``value`` (nulls left out).  ``largest``: a bound of the rows
    of a group, where the caller knows one."""
    if largest is not None and largest <= small:
        return _small(df.where(F.col(value).isNotNull()), keys, value, probs)
    rows = share(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")))
    if largest is None and largest_group(rows, keys) <= small:
        return _small(rows, keys, "_v", probs)
    eps = 4.0 / acc  # the sketch's own error either side, and two ranks of slack in a group over ``acc``
    ps = sorted(set(probs.values()))
    cuts = [q for p in ps for q in (max(p - eps, 0.0), min(p + eps, 1.0))]
    sk = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(float(c)) for c in cuts]), F.lit(acc)).alias("_q"),
    )
    brackets = [
        F.struct(
            F.lit(float(p)).alias("p"),
            F.when(F.lit(p <= eps) | (F.col("_n") <= acc), F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("lo"),
            F.when(F.lit(p >= 1 - eps) | (F.col("_n") <= acc), F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("hi"),
        )
        for i, p in enumerate(ps)
    ]
    br = sk.select(*keys, "_n", F.array(*brackets).alias("_br"))
    joined = rows.join(br, list(keys)) if keys else rows.crossJoin(F.broadcast(br))
    # one pass over the joined rows: each row is either below, inside or above each bracket
    per_p = joined.select(*keys, "_n", "_v", F.posexplode("_br").alias("_i", "_b")) if len(ps) > 1 else joined.select(
        *keys, "_n", "_v", F.lit(0).alias("_i"), F.col("_br")[0].alias("_b")
    )
    per_p = per_p.where(F.col("_v") <= F.col("_b.hi")).select(
        *keys, "_n", "_i", F.col("_b.p").alias("_p"),
        F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_v"),
    )
    counts = per_p.groupBy(*keys, "_i", "_p", "_n", "_v").agg(F.count(F.lit(1)).alias("_k"))
    w = W.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    cum = counts.withColumn("_cum", F.sum("_k").over(w)).where(F.col("_v").isNotNull())
    rank = F.col("_p") * (F.col("_n") - 1)
    # 0-based positions covered by this value: [_cum - _k, _cum - 1]
    at = lambda r: F.max(F.when((r >= F.col("_cum") - F.col("_k")) & (r <= F.col("_cum") - 1), F.col("_v")))
    got = cum.groupBy(*keys, "_i").agg(
        at(F.floor(rank)).alias("_a"), at(F.ceil(rank)).alias("_bv"), F.first(rank - F.floor(rank)).alias("_f")
    )
    pick = lambda i: F.max(F.when(F.col("_i") == i, F.col("_a") + (F.col("_bv") - F.col("_a")) * F.col("_f")))
    idx = {p: i for i, p in enumerate(ps)}
    return got.groupBy(*keys).agg(*[pick(idx[p]).alias(name) for name, p in probs.items()])


def _small(rows: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    names = list(probs)
    q = rows.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(probs[n])) for n in names])).alias("_q"))
    return q.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def robust_scale(
    df: DataFrame, keys: Sequence[str], value: str, k: float = 1.4826, largest: int | None = None, small: int = SMALL
) -> DataFrame:
    """Median and k x median absolute deviation of ``value`` per key."""
    both = share(df.select(*keys, value))
    largest = largest_group(both, keys) if largest is None else largest
    med = exact_quantiles(both, keys, value, {"med": 0.5}, largest=largest, small=small)
    dev = (both.join(med, list(keys)) if keys else both.crossJoin(F.broadcast(med))).withColumn(
        "_dev", F.abs(F.col(value) - F.col("med"))
    )
    mad = exact_quantiles(dev, keys, "_dev", {"mad": 0.5}, largest=largest, small=small)
    out = med.join(mad, list(keys)) if keys else med.crossJoin(F.broadcast(mad))
    return out.withColumn("scale", F.col("mad") * k)
