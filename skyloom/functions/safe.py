"""Quotients that are missing, not errors, where the divisor is nought."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def corr(a: str, b: str) -> Column:
    """Pearson's r as an aggregate; null for a constant side."""
    return div(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))
