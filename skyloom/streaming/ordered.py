"""Streams put in order: rows wait for the watermark, a repeated one replaces its earlier version, late ones go to the side."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skyloom.streaming.jobs import Follower

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Given what is carried (None at first), a time's place and its rows ``(slot, values)`` in slot order: what to carry and what to tell.
Step = Callable[[list[float] | None, int, list[tuple[int, list[float]]]], tuple[list[float] | None, list[list[float]]]]


#: State and timers cost a call each, so a piece of state is a bucket of many keys, and a call reads or writes all its rows of a span of time.
BUCKETS = 256
SPAN = 8  # watermark delays


class InOrder(StatefulProcessor):
    """The rows of a bucket of keys, time by time.

    Rows wait in map state, one entry a span of times, until the watermark passes their time; till then a row of the same key, time and
    slot replaces the one held.  Then a timer gives them, key by key, to ``step`` with what the key carries (value state, one entry a
    bucket) and drops them, so the state holds the rows of the watermark's delay, not a series.  Rows of times that are past when they
    arrive are told as ``late`` and change nothing.
    """

    def __init__(self, step: Step, keys: Sequence[str], span_ms: int):
        self.step, self.keys, self.span = step, keys, span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        lists = "".join(f"k{i} array<{t}>, " for i, t in enumerate(self.keys))
        self.held = handle.getMapState("held", "span long", lists + "at array<long>, frame array<long>, slot array<long>, v array<array<double>>")
        self.carried = handle.getValueState("carried", lists + "v array<array<double>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        late, new = [], {}
        names = [f"k{i}" for i in range(len(self.keys))]
        for batch in rows:
            for *own, at, frame, slot, values in zip(*(batch[c].tolist() for c in (*names, "at", "frame", "slot", "v")), strict=True):
                if at <= passed:
                    late.append((*own, frame, values, True))
                else:
                    new.setdefault(at // self.span, {})[*own, at, slot] = (frame, values)
        for span, rows_ in new.items():
            before = self._rows(span)
            soonest = min((k[-2] for k in rows_))
            if not before or soonest < min(k[-2] for k in before):
                self.handle.registerTimer(soonest)
            self._hold(span, before | rows_)
        if late:
            yield told(len(self.keys), late)

    def _rows(self, span: int) -> dict[tuple, tuple]:
        held = self.held.getValue((span,)) if self.held.containsKey((span,)) else None
        if held is None:
            return {}
        *own, at, frame, slot, v = held
        return dict(zip(zip(*own, at, slot, strict=True), zip(frame, v, strict=True), strict=True))

    def _hold(self, span: int, rows: dict[tuple, tuple]) -> None:
        *own, at, slot = map(list, zip(*rows, strict=True))
        frame, v = map(list, zip(*rows.values(), strict=True))
        self.held.updateValue((span,), (*own, at, frame, slot, [[float(x) for x in r] for r in v]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        span = expiredTimerInfo.getExpiryTimeInMs() // self.span
        rows = self._rows(span)
        due = sorted((k for k in rows if k[-2] <= passed), key=lambda k: k[-2:])
        if not due:
            return
        carried = {}
        if self.carried.exists():
            *own, v = self.carried.get()
            carried = dict(zip(zip(*own, strict=True), v, strict=True))
        out, changed = [], False
        whole: dict[tuple, list] = {}  # a key's rows of one time
        for k in due:
            whole.setdefault(k[:-1], []).append((k[-1], list(rows[k][1])))
        for k, spots in whole.items():
            own = k[:-1]
            frame = rows[*k, spots[-1][0]][0]
            after, said = self.step(carried.get(own), frame, spots)
            if after is not None:
                carried[own], changed = after, True
            out += [(*own, int(f), v, False) for f, *v in said]
        if changed:
            self.carried.update((*map(list, zip(*carried, strict=True)), [list(v) for v in carried.values()]))
        rest = {k: r for k, r in rows.items() if k[-2] > passed}
        if rest:
            self._hold(span, rest)
            self.handle.registerTimer(min(k[-2] for k in rest))
        else:
            self.held.removeKey((span,))
        if out:
            yield told(len(self.keys), out)

    def close(self) -> None:
        pass


def told(keys: int, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*(f"k{i}" for i in range(keys)), "frame", "v", "late"])


def in_order(
    rows: DataFrame, keys: Sequence[str], frame: str, slot: Column, values: Sequence[str], step: Step, delay: str, ts: str = "ts", alone: bool = False
) -> DataFrame:
    """``keys, frame, v, late``: what ``step`` tells of each time of each key, and every late row as it came.  Where times stand ``alone``
    (nothing is carried), those of one key are spread over the buckets."""
    spark = rows.sparkSession
    spark.conf.set(STORE, ROCKS)
    keys = list(keys)
    span_ms = max(1, SPAN * spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {delay}"))).first()[0])
    names = [f"k{i}" for i in range(len(keys))]
    at = F.unix_millis(ts)
    marked = rows.withWatermark(ts, delay).select(
        F.pmod(F.xxhash64(*keys, *([at] if alone else [])), F.lit(BUCKETS)).cast("int").alias("bucket"),
        *[F.col(k).alias(n) for n, k in zip(names, keys, strict=True)], at.alias("at"), F.col(frame).cast("long").alias("frame"), slot.cast("long").alias("slot"),
        F.array(*[F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))) for v in values]).alias("v"),
    )
    types = [marked.schema[n].dataType.simpleString() for n in names]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)) + ", frame long, v array<double>, late boolean"
    out = marked.groupBy("bucket").transformWithStateInPandas(InOrder(step, types, span_ms), schema, "append", "EventTime")
    return out.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def settled_points(points: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """R8. Every point once the watermark has passed it, in its last version: a repeated frame replaces the one that waits.  A frame that
    is settled stays so; what comes for it afterwards is ``late``."""
    keys = ["video_id", "object_id"]
    out = in_order(points, keys, "frame", F.lit(0), ["x", "y"], lambda carried, frame, rows: (None, [[frame, *rows[0][1]]]), delay, alone=True)
    return out.select(*keys, "frame", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), "late")


def _steps(hold: int, least: float) -> Step:
    def step(carried, frame, rows):
        seen = [*(carried or []), float(frame), rows[0][1][0]][-4 * hold :]
        said = []
        if len(seen) == 4 * hold:
            frames, levels = seen[::2], seen[1::2]
            before, after = float(np.median(levels[:hold])), float(np.median(levels[hold:]))
            if abs(after - before) >= least:
                said.append([frames[hold], before, after])
        return seen, said

    return step


def step_alerts(stats: DataFrame, hold: int = 8, least: float = 3.0, delay: str = "2 seconds") -> DataFrame:
    """R4. Steps of a picture's level in order of frames, whatever order they came in: the medians of ``hold`` frames before and from a
    frame, apart by ``least``.  Late frames come out flagged, with their level in ``before``; they are in no median."""
    out = in_order(stats, ["video_id"], "frame", F.lit(0), ["level"], _steps(hold, least), delay)
    return out.select("video_id", "frame", F.col("v")[0].alias("before"), F.get("v", F.lit(1)).alias("after"), "late")


def _follow(patience: int, gate: tuple[float, float]) -> Step:
    def step(carried, frame, rows):
        own = Follower(None if carried is None else (int(carried[0]), *carried[1:]), patience, gate)
        values = np.array([v for _, v in rows])
        spot = own.see(frame, values[:, :2], values[:, 2])
        state = own.state
        return None if state is None else [float(s) for s in state], [] if spot is None else [[frame, float(spot[0]), float(spot[1])]]

    return step


def linked_tracks(cands: DataFrame, patience: int = 40, gate: tuple[float, float] = (25.0, 12.0), delay: str = "2 seconds") -> DataFrame:
    """R1. A track a video from candidates (``slot`` tells those of a frame apart) in order of frames, each frame whole and at its last
    version.  Candidates of frames that have been linked are ``late`` and come out as they are."""
    out = in_order(cands, ["video_id"], "frame", F.col("slot"), ["x", "y", "response"], _follow(patience, gate), delay)
    return out.select("video_id", "frame", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), "late")


class Heartbeats(StatefulProcessor):
    """Units' states as they change, and ``stalled`` where one that runs is silent for too long.

    The last heartbeats of a bucket of units are value state, with a timer at the first end of a patience, at which a unit that has ended
    is forgotten; after so long a silence its state is told anew.
    """

    def __init__(self, patience_ms: int, running: str, unit: str):
        self.patience, self.running, self.unit = patience_ms, running, unit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"due long, unit array<{self.unit}>, at array<long>, state array<string>")

    def _units(self) -> tuple[int | None, dict]:
        if not self.last.exists():
            return None, {}
        due, units, ats, states = self.last.get()
        return due, dict(zip(units, zip(ats, states, strict=True), strict=True))

    def _keep(self, due: int | None, last: dict) -> None:
        """Write what is last of the units, with a timer at the first end of a patience of those that have not stalled."""
        soonest = min((at + self.patience for at, state in last.values() if state != "stalled"), default=None)
        if due is not None and due != soonest:
            self.handle.deleteTimer(due)
        if soonest is not None and due != soonest:
            self.handle.registerTimer(soonest)
        if last:
            self.last.update((soonest, list(last), *map(list, zip(*last.values(), strict=True))))
        elif self.last.exists():
            self.last.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, last = self._units()
        out = []
        beats = pd.concat(list(rows)).sort_values(["at", "state"])
        for unit, at, state in zip(beats["unit_id"].tolist(), beats["at"].tolist(), beats["state"].tolist(), strict=True):
            before = last.get(unit)
            if before and at <= before[0]:
                out.append((unit, at, state, True))
                continue
            if before and at - before[0] > self.patience:
                if before[1] == self.running:
                    out.append((unit, before[0] + self.patience, "stalled", False))
                before = None
            if before is None or state != before[1]:
                out.append((unit, at, state, False))
            last[unit] = (at, state)
        self._keep(due, last)
        if out:
            yield pd.DataFrame(out, columns=["unit_id", "at_ms", "state", "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        _, last = self._units()
        out = []
        for unit, (at, state) in list(last.items()):
            if state != "stalled" and at + self.patience <= passed:
                if state == self.running:
                    out.append((unit, at + self.patience, "stalled", False))
                    last[unit] = (at, "stalled")
                else:
                    del last[unit]
        self._keep(None, last)
        if out:
            yield pd.DataFrame(out, columns=["unit_id", "at_ms", "state", "late"])

    def close(self) -> None:
        pass


def unit_states(beats: DataFrame, patience_s: int = 600, running: str = "running", delay: str = "2 seconds") -> DataFrame:
    """R6. ``unit_id, at_ms, state, late``: every change of a unit's state, ``stalled`` at the end of ``patience_s`` without
    a heartbeat, and heartbeats that came after a later one, which change nothing.  What is kept is one row a unit that hasn't ended."""
    beats.sparkSession.conf.set(STORE, ROCKS)
    bucket = F.pmod(F.xxhash64("unit_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    rows = beats.withWatermark("ts", delay).select(bucket, "unit_id", F.unix_millis("ts").alias("at"), "state")
    unit = rows.schema["unit_id"].dataType.simpleString()
    schema = f"unit_id {unit}, at_ms long, state string, late boolean"
    return rows.groupBy("bucket").transformWithStateInPandas(Heartbeats(1000 * patience_s, running, unit), schema, "append", "EventTime")
