"""A pointer's own clock: the readings at which it moved, however long the series is."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from skyloom.functions.chunked import CHUNK, following
from skyloom.functions.lineage import share
from skyloom.operators.series_joins import interpolate_at

#: A reading that moved this share of a grid step from the last update is the next one.
MOVED = 0.5


def first_moved(v: np.ndarray, begin: int, last: float, least: float) -> int:
    """The first place from ``begin`` that is ``least`` or more away from ``last``; the series' length where none is."""
    width = 64
    while begin < len(v):
        far = np.abs(v[begin : begin + width] - last) >= least
        if far.any():
            return begin + int(far.argmax())
        begin, width = begin + width, 2 * width
    return len(v)


def entries(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the records, upward and downward: only at one of these can a chunk's first update lie, whatever came before."""
    high, low = np.maximum.accumulate(v), np.minimum.accumulate(v)
    new = lambda m: np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    return new(high), new(low)


def last_update(v: np.ndarray, at: int, least: float, known: dict[int, int]) -> int:
    """The last update of a chunk of which ``at`` is one; starts that meet share the rest of their way."""
    path = []
    while at not in known:
        path.append(at)
        nxt = first_moved(v, at + 1, v[at], least)
        if nxt == len(v):
            known[at] = at
        else:
            at = nxt
    known.update(dict.fromkeys(path, known[at]))
    return known[at]


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows in order of ``keys``, handed on in whole groups, with the place at which each begins; what is held back is the last group."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        new = np.zeros(len(rows), bool)
        for k in keys:
            before = rows[k].shift()
            new |= ((rows[k] != before) & ~(rows[k].isna() & before.isna())).to_numpy(bool)
        new[0] = True
        starts = np.flatnonzero(new)
        held = rows.iloc[starts[-1] :].reset_index(drop=True)
        if len(starts) > 1:
            yield rows.iloc[: starts[-1]], starts[:-1]
    if held is not None:
        yield held, np.zeros(1, int)


def _summary(keys: list[str], least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _groups(batches, [*keys, "_c"]):
            values = rows["_v"].to_numpy(float)
            out = rows[[*keys, "_c"]].iloc[starts].reset_index(drop=True)
            told: dict[str, list[list]] = {f"_{n}{m}": [] for n in ("up", "down") for m in ("", "_at", "_last")}
            for v in np.split(values, starts[1:]):
                known: dict[int, int] = {}
                for name, places in zip(("up", "down"), entries(v), strict=True):
                    told[f"_{name}"].append(v[places].tolist())
                    told[f"_{name}_at"].append(places.tolist())
                    told[f"_{name}_last"].append([float(v[last_update(v, int(i), least, known)]) for i in places])
            yield out.assign(**told)

    return run


def _handed_on(keys: list[str], least: float):
    """Chunks of each series in order: the last update's value before each of them (null before the first)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, value = None, None
        for batch in batches:
            out = []
            columns = [batch[k] for k in keys]
            told = [batch[f"_{n}{m}"] for n in ("up", "down") for m in ("", "_last", "_at")]
            for key, up, up_last, up_at, down, down_last, down_at in zip(zip(*columns, strict=True), *told, strict=True):
                if key != before:
                    before, value = key, None
                out.append(value)
                if value is None:
                    value = float(up_last[0])  # the first reading is an update
                    continue
                # records only grow, so the first far enough is found by halving
                i = int(np.searchsorted(np.asarray(up) - value >= least, True))
                j = int(np.searchsorted(value - np.asarray(down) >= least, True))
                ways = [(up_at[i], up_last[i])] if i < len(up) else []
                ways += [(down_at[j], down_last[j])] if j < len(down) else []
                if ways:
                    value = float(min(ways)[1])
            yield batch[[*keys, "_c"]].assign(_last=pd.Series(out, dtype="float64"))

    return run


def _marked(keys: list[str], least: float):
    """Each chunk's updates; its first row tells, in ``_v``, the last update before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _groups(batches, [*keys, "_c"]):
            values = rows["_v"].to_numpy(float)
            places: list[int] = []
            for start, v in zip(starts, np.split(values, starts[1:]), strict=True):
                at = 1 if np.isnan(v[0]) else first_moved(v, 1, v[0], least)
                while at < len(v):
                    places.append(int(start) + at)
                    at = first_moved(v, at + 1, v[at], least)
            yield rows.iloc[places][[*keys, "_c", "_at", "_v"]]

    return run


def _schema(fields: Sequence[StructField], more: dict[str, str]) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{n} {t}" for n, t in more.items()])


def pointer_updates(readings: DataFrame, keys: Sequence[str], at: str, value: str, step: float, chunk: int = CHUNK) -> DataFrame:
    """W19. The readings at which a pointer moved half a grid step or more from its last update, the first of a series first.

    The rule is sequential, but a chunk's answer depends on what came before only through its first update, which is a record of the
    chunk.  So each chunk tells, for each of its records, the value of its last update if the first were there; one stream over these
    summaries hands the last value from chunk to chunk; then each chunk marks its own updates.  No task holds a series.  Null and
    non-finite readings are left out; of several readings at one place the least counts.
    """
    keys = list(keys)
    least = MOVED * step
    d = readings.where(F.col(value).isNotNull() & ~F.isnan(value) & ~F.col(value).isin(float("inf"), float("-inf")))
    d = d.groupBy(*keys, at).agg(F.min(F.col(value).cast("double")).alias("_v"))
    d = share(d.withColumn("_at", F.col(at)).withColumn("_c", F.floor(F.col(at) / chunk)))
    types = [d.schema[k] for k in [*keys, "_c"]]
    schema = _schema(types, {"_up": "array<double>", "_up_last": "array<double>", "_up_at": "array<bigint>", "_down": "array<double>", "_down_last": "array<double>", "_down_at": "array<bigint>"})
    d = d.select(*keys, "_c", "_at", "_v")
    told = d.repartition(*keys, "_c").sortWithinPartitions(*keys, "_c", "_at").mapInPandas(_summary(keys, least), schema)
    told = told.repartition(*keys).sortWithinPartitions(*keys, "_c").mapInPandas(_handed_on(keys, least), _schema(types, {"_last": "double"}))
    first = told.select(*keys, "_c", F.lit(None).cast(d.schema["_at"].dataType).alias("_at"), F.col("_last").alias("_v"))
    both = first.withColumn("_s", F.lit(0)).unionByName(d.withColumn("_s", F.lit(1)))
    both = both.repartition(*keys, "_c").sortWithinPartitions(*keys, "_c", "_s", "_at").drop("_s")
    out = _schema([*types, d.schema["_at"]], {"_v": "double"})
    marked = both.mapInPandas(_marked(keys, least), out)
    return marked.select(*keys, F.col("_at").alias(at), F.col("_v").alias(value))


def stall(updates: DataFrame, path: DataFrame, keys: Sequence[str], at: str, value: str, c: Column, hold: Column, step: float, chunk: int = CHUNK) -> DataFrame:
    """W19. The most turn a pointer owed the scene between two updates, in grid steps: the path's move over ``c`` and the hold's
    share, from an update to the frame before the next; with that interval's frames and first frame.  Three updates inside the path's
    frames at least."""
    keys = list(keys)
    ends = path.groupBy(*keys).agg(F.min(at).alias("_f0"), F.max(at).alias("_f1"))
    u = updates.select(*keys, at).join(ends, keys).where(F.col(at).between(F.col("_f0"), F.col("_f1"))).drop("_f0", "_f1")
    enough = u.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n >= 3").select(*keys)
    u = following(u.join(enough, keys, "left_semi"), keys, at, {"_next": F.col(at)}).where("_next is not null")
    u = share(u.select(*keys, F.col(at).alias("_a"), (F.col("_next") - 1).alias("_b")))
    p = path.select(*keys, at, F.col(value).cast("double").alias("_x"))
    ends = u.select(*keys, F.col("_a").alias(at)).unionByName(u.select(*keys, F.col("_b").alias(at))).distinct()
    x = share(interpolate_at(ends, p, "_x", keys, at, chunk))
    j = u.join(x.select(*keys, F.col(at).alias("_a"), F.col("_x").alias("_xa")), [*keys, "_a"]).join(x.select(*keys, F.col(at).alias("_b"), F.col("_x").alias("_xb")), [*keys, "_b"])
    frames = F.col("_b") - F.col("_a")
    owed = F.abs((F.col("_xb") - F.col("_xa")) / c + hold * frames) / step
    best = j.withColumn("steps", owed).groupBy(*keys).agg(F.max_by(F.struct("steps", (frames + 1).alias("frames"), F.col("_a").alias("at_frame")), F.struct("steps", -F.col("_a"))).alias("b"))
    return best.select(*keys, "b.*")
