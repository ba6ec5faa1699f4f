"""Probabilities as column expressions, and the few that need iteration as vectorised functions for *aggregated* rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's 95 % interval of a share k of n (null for n = 0)."""
    p, d = k / n, 1 + z * z / n
    c = (p + z * z / (2 * n)) / d
    h = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), c - h)), F.when(n > 0, F.least(F.lit(1.0), c + h))


def gpd_sf(x: Column, xi: Column, sigma: Column) -> Column:
    """Generalised Pareto survival at excess ``x``."""
    z = 1 + xi * x / sigma
    return F.when(F.abs(xi) < 1e-9, F.exp(-x / sigma)).otherwise(F.when(z > 0, F.pow(z, -1 / xi)).otherwise(F.lit(0.0)))


def kolmogorov_sf(d: Column, n: Column) -> Column:
    """Chance of a gap of ``d`` or more between n uniform draws and the uniform (the limiting series)."""
    t = d * F.sqrt(n.cast("double"))
    big = sum((2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * t * t) for k in range(1, 9))
    small = 1 - (math.sqrt(2 * math.pi) / t) * sum(F.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * t * t)) for k in range(1, 9))
    return F.when(t <= 0, F.lit(1.0)).when(t < 1.0, small).otherwise(big)


def _steps(a: float, b: float = 0.0) -> int:
    """Terms within which a continued fraction settles: its need grows as the root of the larger parameter."""
    return 1000 + int(40 * math.sqrt(max(a, b)))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction; not a number where it does not settle."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(_steps(a, b)):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + num * d or 1e-300)
        c = 1.0 + num / (c or 1e-300)
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            return front * (f - 1.0)
    return math.nan


@F.pandas_udf(DoubleType())
def clopper_pearson_upper(wrong: pd.Series, draws: pd.Series, level: pd.Series) -> pd.Series:
    """Exact one-sided upper bound of a share, ``wrong`` of ``draws``: P(X <= wrong) = 1 - level there."""
    out = np.ones(len(wrong))
    for i, (k, n, q) in enumerate(zip(wrong, draws, level)):
        if n <= 0 or k >= n:
            continue
        if k == 0:
            out[i] = 1.0 - (1.0 - q) ** (1.0 / n)
            continue
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            # P(X <= k) = 1 - I_mid(k + 1, n - k)
            lo, hi = (mid, hi) if 1.0 - betainc(k + 1, n - k, mid) > 1.0 - q else (lo, mid)
        out[i] = (lo + hi) / 2
    return pd.Series(out)


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma; not a number where its fraction does not settle."""
    if x <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1.0 - lead * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, _steps(a)):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            return lead * h
    return math.nan


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([gammainc_upper(k / 2, v / 2) if k > 0 else None for v, k in zip(x, dof)], dtype="float64")


@F.pandas_udf(DoubleType())
def binomial_sf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= k)."""
    return pd.Series([1.0 if a <= 0 else (0.0 if a > b else betainc(a, b - a + 1, q)) for a, b, q in zip(k, n, p)], dtype="float64")


@F.pandas_udf(DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([betainc(b / 2, a / 2, b / (b + a * v)) if v > 0 else 1.0 for v, a, b in zip(f, d1, d2)], dtype="float64")
