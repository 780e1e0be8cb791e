"""Stateful scorers: small per-key state, in event-time order whatever the micro-batches hold.

Keys are dealt to a fixed number of parts, and a part is what Spark keeps state for: each call of the processor, each timer and
each batch of results serves all keys of a part, so that a key costs no calls of its own but the update of its memory. New rows
are appended to their part's list state, one entry of arrays per chunk, without reading what waits there. An event-time timer
fires once the watermark has passed the earliest of them; the rows it has passed are then taken key by key in the order of
(us, event_id), so results do not depend on how files arrive or batches are cut. Rows later than the watermark are dropped by
Spark. A part holds the rows of one watermark delay at most, besides the few numbers of each key in its map state; with a `ttl`,
a key without events for that long is forgotten. The state lies in RocksDB, off the heap.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import pairwise
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sessionlens.operators.thinning import FREE

STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LATENESS = "10 minutes"

# --- fixed values: history lengths and factors of the risk feedback ---
HISTORY, RECENT_KINDS = 10, 20


# A stream must keep this number over its restarts, as it must keep its shuffle partitions.
PARTS = 1024

RESULT_ROWS = 10_000

Step = Callable[[list[tuple], tuple | None], tuple[list[tuple], tuple]]


class InTimeOrder(StatefulProcessor):
    """Calls `step(rows, memory)` for a key with the rows the watermark has passed, sorted; it returns results and new memory.

    A row is (event_id, us, *columns). Keys are strings here.
    """

    def __init__(self, keys: list[str], columns: dict[str, str], memory: dict[str, str], step: Step, names: list[str], ttl_us: int | None):
        self.keys, self.memory, self.step, self.names, self.ttl_us = keys, memory, step, names, ttl_us
        self.held = {k: "string" for k in keys} | {"event_id": "long", "us": "long"} | columns
        self.sweep_us = None if ttl_us is None else max(ttl_us // 8000, 1) * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} array<{t}>" for n, t in self.held.items()))
        self.known = handle.getMapState(
            "known", ", ".join(f"{k} string" for k in self.keys), ", ".join(f"{n} {t}" for n, t in [*self.memory.items(), ("last", "long")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for chunk in rows:
            self.waiting.appendValue(tuple(chunk[c].tolist() for c in self.held))
            earliest = int(chunk["us"].min())
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            self.wake(first, timerValues)
        return iter(())

    def wake(self, us: int, timer_values) -> None:
        """A timer for when the watermark has passed a time."""
        self.handle.registerTimer(max(-(-us // 1000), timer_values.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        n, due, rest = len(self.keys), defaultdict(list), []
        for chunk in self.waiting.get():
            for row in zip(*chunk, strict=True):
                if row[n + 1] <= passed:
                    due[row[:n]].append(row[n:])
                else:
                    rest.append(row)
        out = self.taken(due, passed, timerValues) if due else []
        if due and rest:
            self.waiting.put([tuple(map(list, zip(*rest[i : i + RESULT_ROWS], strict=True))) for i in range(0, len(rest), RESULT_ROWS)])
        elif due:
            self.waiting.clear()
        if rest:
            self.wake(min(r[n + 1] for r in rest), timerValues)
        if self.sweep_us and expiredTimerInfo.getExpiryTimeInMs() * 1000 % self.sweep_us == 0:
            for idle in [k for k, v in self.known.iterator() if v[-1] + self.ttl_us <= passed]:
                self.known.removeKey(idle)
        for i in range(0, len(out), RESULT_ROWS):
            yield pd.DataFrame(out[i : i + RESULT_ROWS], columns=self.names)

    def taken(self, due: dict[tuple, list[tuple]], passed: int, timer_values) -> list[tuple]:
        """Results of the rows of each key; updates what is known of the keys."""
        out, newest, any_known = [], None, self.known.exists()
        for key, rows in due.items():
            rows.sort(key=lambda r: (r[1], r[0]))
            stored = self.known.getValue(key) if any_known else None
            memory, last = (None, None) if stored is None else (tuple(stored[:-1]), stored[-1])
            for spell in self.spells(rows):
                forgotten = self.ttl_us is not None and last is not None and spell[0][1] - last >= self.ttl_us
                found, memory = self.step(spell, None if forgotten else memory)
                last = int(spell[-1][1])
                out.extend(key + f for f in found)
            if self.ttl_us is None or last + self.ttl_us > passed:
                self.known.updateValue(key, (*memory, last))
                newest = last if newest is None else max(newest, last)
            elif stored is not None:
                self.known.removeKey(key)
        if self.sweep_us and newest is not None:
            self.wake(-(-(newest + self.ttl_us) // self.sweep_us) * self.sweep_us, timer_values)
        return out

    def spells(self, rows: list[tuple]) -> list[list[tuple]]:
        """Sorted rows, cut where the key would have been forgotten."""
        if self.ttl_us is None:
            return [rows]
        cuts = [i for i, (a, b) in enumerate(pairwise(rows), 1) if b[1] - a[1] >= self.ttl_us]
        return [rows[a:b] for a, b in pairwise([0, *cuts, len(rows)])]


def in_time_order(
    stream: DataFrame, keys: list[str], columns: dict[str, str], memory: dict[str, str], step: Step, result: str,
    lateness: str = LATENESS, ttl_us: int | None = None,
) -> DataFrame:
    """Run `step` over each key's rows in event-time order.

    `columns` are the types of the columns it reads (besides `event_id` and `us`), `memory` those of its state; `result` are the
    types of the keys and, after them, of what it returns.
    """
    stream.sparkSession.conf.set(STORE_KEY, STORE)
    types = dict(f.split(" ") for f in result.split(", "))
    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).alias("_part")
    # As strings, NULL keys and large numbers pass through pandas unchanged.
    rows = stream.withWatermark("ts", lateness).select(part, *[F.col(k).cast("string").alias(k) for k in keys], "event_id", "us", *columns, "ts")
    out = rows.groupBy("_part").transformWithStateInPandas(
        InTimeOrder(keys, columns, memory, step, list(types), ttl_us),
        ", ".join(f"{n} {'string' if n in keys else t}" for n, t in types.items()), "append", "eventTime")
    return out.select(*[F.col(n).cast(t).alias(n) for n, t in types.items()])


def squash(x: float) -> float:
    return 1.0 / (1.0 + exp(-6.0 * (max(0.0, min(1.0, x)) - 0.5)))


def feedback_step(base: float, kind: str, finals: list[float], kinds: list[str], seen: int, cold_start: int, same_kind: int, decay: float) -> float:
    """The final risk of one event from the state before it; extends the state lists in place."""
    kinds.append(kind)
    del kinds[:-RECENT_KINDS]
    adjusted = base
    if seen > HISTORY and base > 1.5 * (sum(finals) / len(finals)):
        adjusted *= 1.2
    if kinds.count(kind) > same_kind:
        adjusted *= 1.1
    adjusted = max(0.0, min(1.0, adjusted * decay))
    final = squash(min(adjusted, 0.4) if seen < cold_start else adjusted)
    finals.append(final)
    del finals[:-HISTORY]
    return final


def stateful_risk(
    stream: DataFrame, cold_start: int = 250, same_kind: int = 15, decay: float = 0.95, lateness: str = LATENESS,
    ttl_us: int | None = None,
) -> DataFrame:
    """Risk with feedback per user, live. Columns: user_id, event_id, ts, us, kind, base."""

    def score(rows: list[tuple], memory: tuple | None) -> tuple[list[tuple], tuple]:
        finals, kinds, seen = ([], [], 0) if memory is None else (list(memory[0]), list(memory[1]), memory[2])
        out = []
        for event_id, _, kind, base in rows:
            out.append((event_id, feedback_step(base, kind, finals, kinds, seen, cold_start, same_kind, decay)))
            seen += 1
        return out, (finals, kinds, seen)

    return in_time_order(
        stream, ["user_id"], {"kind": "string", "base": "double"},
        {"finals": "array<double>", "kinds": "array<string>", "seen": "long"}, score,
        "user_id long, event_id long, risk double", lateness, ttl_us)


def baseline_steps(points: np.ndarray, samples: list[list[float]], established: bool, window: int, limit: float) -> tuple[list, list, bool]:
    """Walk rows through the baseline: collect, then compare; on drift keep the newest fifth and go on."""
    out = []
    for point in points:
        drift, refreshed = None, False
        if not established:
            samples.append(point.tolist())
            established = len(samples) >= max(10, window // 4)
        else:
            held = np.array(samples)
            mean, var = held.mean(axis=0), held.var(axis=0)
            spread = var > 1e-8
            if spread.any():
                z = np.abs(point[spread] - mean[spread]) / np.sqrt(var[spread])
                drift = float(np.minimum(1.0, z / 5.0).mean())
                refreshed = drift > limit
            if refreshed:
                samples = samples[-(window // 5):]
        out.append((established, drift, refreshed))
    return out, samples, established


def stateful_baseline(
    stream: DataFrame, features: list[str], window: int = 1000, limit: float = 0.15, lateness: str = LATENESS,
    ttl_us: int | None = None,
) -> DataFrame:
    """Baseline life cycle per user. Columns: user_id, event_id, ts, us and the features."""

    def follow(rows: list[tuple], memory: tuple | None) -> tuple[list[tuple], tuple]:
        flat, established = ([], False) if memory is None else (list(memory[0]), memory[1])
        samples = [flat[i : i + len(features)] for i in range(0, len(flat), len(features))]
        points = np.array([r[2:] for r in rows], dtype=float)
        steps, samples, established = baseline_steps(points, samples, established, window, limit)
        return [(r[0], *s) for r, s in zip(rows, steps, strict=True)], ([x for s in samples for x in s], established)

    return in_time_order(
        stream, ["user_id"], {f: "double" for f in features}, {"samples": "array<double>", "established": "boolean"}, follow,
        "user_id long, event_id long, established boolean, drift double, refreshed boolean", lateness, ttl_us)


def suppress_alerts(stream: DataFrame, gap_us: int, lateness: str = LATENESS) -> DataFrame:
    """One alert per user, kind and score band within the gap since the last one sent; a key is forgotten after the gap.

    Columns: user_id, kind, band, event_id, ts, us.
    """

    def thin(rows: list[tuple], memory: tuple | None) -> tuple[list[tuple], tuple]:
        blocked = FREE if memory is None else memory[0]
        out = []
        for event_id, us in rows:
            if us >= blocked:
                out.append((event_id, us))
                blocked = us + gap_us
        return out, (blocked,)

    return in_time_order(
        stream, ["user_id", "kind", "band"], {}, {"blocked": "long"}, thin,
        "user_id long, kind string, band long, event_id long, us long", lateness, gap_us)
