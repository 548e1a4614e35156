"""Decisions that depend on earlier decisions, over recordings that arrive as endless streams.

A job's rows may come shuffled and late. They wait in the job's state until the watermark has passed them, so no
earlier row can come any more, and are then handed on in order; a timer wakes the job when the watermark moves on
without new rows, and closes it when none has come for ``idle``. Nothing but waiting rows and what a decision needs
is kept: the last kept row, or, where the decision needs the scores of the whole recording, these. A job's state is
as large as the rows within the watermark's delay, so recordings may be of any length but for the latter.

The state lives in RocksDB: begin such a query within ``keyed_state``. Rows later than ``late`` are dropped, as ever.
The results are those of the batch operators of the same names over the rows that came in time.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewright.functions import rules
from tracewright.functions.text import contains_any, text_of, tokens
from tracewright.operators.steps import keyed

# The folds travel with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOUR = 3.6e9
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside keep their state in RocksDB, which state by key with timers needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def rounded(x: float, digits: int = 6) -> float:
    """As SQL rounds: halves of the decimal form go up."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


class Fold:
    """A fold over a job's rows in order. The state must be JSON; a row has its columns, ord from 0 and time_sec (hours)."""

    def start(self) -> dict[str, Any]:
        return {}

    def step(self, state: dict[str, Any], row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        raise NotImplementedError

    def finish(self, state: dict[str, Any]) -> Iterator[dict[str, Any]]:
        yield from ()


class InOrder(StatefulProcessor):
    """Gives each job's rows to a fold in the order of (ts, event_id)."""

    def __init__(self, fold: Fold, columns: list[str], kinds: str, idle_ms: int):
        self.fold, self.columns, self.kinds, self.idle_ms = fold, columns, kinds, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value holds all of a job, as each call of the store costs more than what a job's few waiting rows do.
        self.kept = handle.getValueState("kept", "n long, first_us long, last_us long, wake long, state string, waiting string")

    def handleInputRows(self, key, rows, timerValues):
        at, fresh = None, []
        for r in rows:
            at = at or [r.__fields__.index(c) for c in self.columns]
            fresh.append([r[i] for i in at])
        yield from self.advance(key[0], fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.advance(key[0], [], timerValues.getCurrentWatermarkInMs())

    def advance(self, job_id, fresh: list[list], mark: int) -> Iterator[Row]:
        """Hand on what the watermark (ms) has passed; close the job if nothing has come for long."""
        n, first, last, woken, state, waiting = self.kept.get() or (0, None, None, None, None, "[]")
        rows = sorted(json.loads(waiting) + fresh, key=lambda r: r[:2])
        n_due = sum(r[0] <= mark * 1000 for r in rows)
        state = json.loads(state) if state else self.fold.start()
        for r in rows[:n_due]:
            row = dict(zip(self.columns, r))
            first = row["ts_us"] if first is None else first
            row |= {"ord": n, "time_sec": rounded((row["ts_us"] - first) / HOUR)}
            yield from (Row(job_id=job_id, **out) for out in self.fold.step(state, row))
            n, last = n + 1, row["ts_us"]
        rest = rows[n_due:]
        done = not rest and last is not None and last // 1000 + self.idle_ms <= mark
        wake = None if done else max(rest[0][0] // 1000 + 1 if rest else last // 1000 + self.idle_ms, mark + 1)
        if woken is not None and woken != wake:
            self.handle.deleteTimer(woken)
        if done:
            yield from (Row(job_id=job_id, **out) for out in self.fold.finish(state))
            self.kept.clear()
            return
        self.kept.update((n, first, last, wake, json.dumps(state), json.dumps(rest)))
        if woken != wake:
            self.handle.registerTimer(wake)


def folded(rows: DataFrame, fold: Fold, columns: dict[str, str], out: str, late: str, idle_ms: int) -> DataFrame:
    """A stream with job_id, ts and event_id through a fold; ``columns``: names and types of what its steps read."""
    kinds = {"ts_us": "long", "event_id": "long", **columns}
    rows = rows.withWatermark("ts", late).select("job_id", "ts", F.unix_micros("ts").alias("ts_us"), F.col("event_id").cast("long"), *columns)
    processor = InOrder(fold, list(kinds), ", ".join(f"{c} {k}" for c, k in kinds.items()), idle_ms)
    return rows.groupBy("job_id").transformWithState(processor, f"job_id long, {out}", "Append", "EventTime")


DAY_MS = 86_400_000


class Boundaries(Fold):
    def __init__(self, max_segments: int):
        self.max_segments = max_segments

    def start(self):
        return {"frames": []}

    def step(self, state, row):
        state["frames"].append((row["ord"], row["time_sec"], row["boundary_score"]))
        yield from ()

    def finish(self, state):
        frames = state["frames"]
        threshold, percentile = self.limits([s for _, _, s in frames[1:]])
        calm = 1.0 if frames[-1][1] - frames[0][1] < 20 else 3.0
        rest = frames[1:]
        top = min(max(2, self.max_segments // 3), max(2, len(rest) // 4))
        high = {f[0] for f in sorted(rest, key=lambda f: (-f[2], f[0]))[:top] if f[2] >= max(0.01, percentile * 0.75)}
        kept: list[dict[str, Any]] = []
        for at, time_sec, score in rest:
            if score < threshold and at not in high or len(kept) >= self.max_segments - 1 and kept:
                continue
            found = {"ord": at, "time_sec": time_sec, "boundary_score": score}
            if kept and time_sec - kept[-1]["time_sec"] < calm:
                if score > kept[-1]["boundary_score"]:
                    kept[-1] = found | {"reason": "hysteresis-replace"}
                continue
            kept.append(found | {"reason": "adaptive-threshold" if score >= threshold else "top-percentile"})
        yield from kept

    @staticmethod
    def limits(scores: list[float]) -> tuple[float, float]:
        """Threshold and 88th percentile of a recording's scores."""
        if not scores:
            return 1.0, 1.0

        def share(values: list[float], p: float) -> float:
            values, at = sorted(values), (len(values) - 1) * p
            low, high = math.floor(at), math.ceil(at)
            if low == high or values[low] == values[high]:
                return values[low]
            return (high - at) * values[low] + (at - low) * values[high]

        middle = share(scores, 0.5)
        mad = share([abs(s - middle) for s in scores], 0.5) or 1e-6
        if max(scores) - min(scores) < 0.03:
            return share(scores, 0.94), share(scores, 0.88)
        return max(middle + 2.5 * mad, share(scores, 0.88)), share(scores, 0.88)


def boundary_candidates(frames: DataFrame, max_segments: int = 20, late: str = "6 hours", idle_ms: int = 30 * DAY_MS) -> DataFrame:
    """job_id, ord, time_sec, boundary_score, reason of a stream of frames (job_id, ts, event_id, boundary_score), when a job is closed:
    its threshold rests on all of its scores."""
    out = "ord long, time_sec double, boundary_score double, reason string"
    return folded(frames, Boundaries(max_segments), {"boundary_score": "double"}, out, late, idle_ms)


def overlap(a: list[str], b: list[str], both_empty: float) -> float:
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a and b else both_empty if not a and not b else 0.0


class ScrollCollapse(Fold):
    def start(self):
        return {"n": 0, "last": None}

    def step(self, state, row):
        last = state["last"]
        if last and self.only_scrolls(last, row):
            if len(row["ocr_text"]) > len(last["ocr_text"]):
                last |= {c: row[c] for c in ("ocr_text", "tok", "operational")}
            last |= {"end_time": row["time_sec"], "frame_count": last["frame_count"] + 1}
            return
        yield from self.finish(state)
        kept = {c: row[c] for c in ("ord", "ocr_text", "tok", "operational", "system", "screen_state_id", "boundary_score")}
        state["last"] = kept | {"start_time": row["time_sec"], "end_time": row["time_sec"], "frame_count": 1}
        state["n"] += 1

    @staticmethod
    def only_scrolls(last, row) -> bool:
        same = last["system"] == row["system"] and last["screen_state_id"] == row["screen_state_id"] and row["visual_score"] < 0.01
        if not row["ocr_text"].strip(" ") or not last["ocr_text"].strip(" "):
            return same
        still = overlap(row["tok"], last["tok"], 1.0) > 0.70 and row["boundary_score"] < 0.12
        return same and still and not row["operational"] and not last["operational"]

    def finish(self, state):
        if state["last"]:
            names = ("ord", "start_time", "end_time", "frame_count", "ocr_text", "system", "screen_state_id", "boundary_score")
            yield {"event_id": state["n"]} | {c: state["last"][c] for c in names}


def scroll_collapse(screens: DataFrame, late: str = "6 hours", idle_ms: int = 30 * DAY_MS) -> DataFrame:
    """The rows of ``screens.scroll_collapse`` of a stream (job_id, ts, event_id, ocr_text, system, screen_state_id, visual_score,
    boundary_score), each as soon as the next kept row follows it in order."""
    text = text_of(F.col("ocr_text"))
    rows = screens.withColumns({"ocr_text": text, "tok": tokens(text), "operational": contains_any(F.lower(text), rules.OPERATIONAL_TERMS)})
    columns = {"ocr_text": "string", "tok": "array<string>", "operational": "boolean", "system": "string", "screen_state_id": "int", "visual_score": "double", "boundary_score": "double"}
    out = "event_id int, ord long, start_time double, end_time double, frame_count int, ocr_text string, system string, screen_state_id int, boundary_score double"
    return folded(rows, ScrollCollapse(), columns, out, late, idle_ms)


class Dedupe(Fold):
    def __init__(self, most: int):
        self.most = most

    def start(self):
        return {"n": 0, "last": None}

    def step(self, state, row):
        last, number = state["last"], row["ord"] + 1
        if state["n"] >= self.most or row["key"] is None:
            return
        if last and row["key"] == last["key"]:
            close = abs(number - last["number"]) <= 1 or abs(row["time_sec"] - last["time_sec"]) <= 12
            there = row["screen_state_id"] is not None and row["screen_state_id"] == last["screen_state_id"]
            keyless = row["screen_state_id"] is None and last["screen_state_id"] is None
            if there if row["generic"] else close if keyless else there and close:
                return
        state["n"] += 1
        state["last"] = {"number": number, "time_sec": row["time_sec"], "key": row["key"], "screen_state_id": row["screen_state_id"]}
        yield {"step_number": state["n"], "source_number": number}


def validated(steps: DataFrame, most: int = 40, late: str = "6 hours", idle_ms: int = 30 * DAY_MS) -> DataFrame:
    """The rows of ``steps.validated`` of a stream of steps (job_id, ts, event_id, action, expected_output, system, rule_system,
    confidence, screen_state_id), each at once. Steps are numbered in order; those without an action only count."""
    columns = {"key": "string", "generic": "boolean", "screen_state_id": "int"}
    return folded(keyed(steps), Dedupe(most), columns, "step_number int, source_number int", late, idle_ms)
