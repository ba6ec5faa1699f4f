"""Seeded draws that are the same under any partitioning: a hash of (seed, key, draw)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


# cumulative probabilities of a Poisson variable of mean 1 at 0..7
POISSON1 = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998980344)


def poisson1(u: Column) -> Column:
    c = F.lit(0)
    for p in POISSON1:
        c = c + F.when(u >= p, 1).otherwise(0)
    return c


def uniform_sql(seed: int | str, *parts: str) -> str:
    """The same number in SQL, for checking."""
    text = "||'|'||".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(CAST('0x'||substr(md5({text}),1,13) AS BIGINT)/4503599627370496.0)"


def poisson1_sql(u: str) -> str:
    return "(" + "+".join(f"(CASE WHEN {u}>={p} THEN 1 ELSE 0 END)" for p in POISSON1) + ")"
