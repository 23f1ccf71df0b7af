"""Stateful streams: rate limits, idempotency, sessions and pushes whose state lives in the state store and outlives a restart.

Events of a trigger are taken in their order, and triggers bring later events than those before; what comes behind the watermark is dropped by Spark. All
state is bounded for a key, and leaves by an event-time timer when it cannot matter any more. Each stream gives the rows of its batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructType

from folioflow.streaming.sessions import changed_stream

MILLIS = 1000


class Timed(StatefulProcessor):
    """Sorts a trigger's rows of a key, and keeps one timer for the key."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms long")

    def wake(self, micros: int) -> None:
        """Moves the key's timer to the first millisecond after the given time."""
        ms = micros // MILLIS + 1
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        yield self.take(key, got)

    def take(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Window(Timed):
    """The times of the last allowed events, at most as many as the limit; they leave when the newest of them is out of the window."""

    def __init__(self, order: list[str], most: int, micros: int):
        super().__init__(order)
        self.most, self.micros = most, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.times = handle.getListState("allowed", "at long")

    def take(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        held = [t for (t,) in self.times.get()] if self.times.exists() else []
        known, allowed = list(held), []
        for t in rows[self.order[0]].tolist():
            held = [x for x in held if x > t - self.micros]
            allowed.append(len(held) < self.most)
            if allowed[-1]:
                held.append(t)
        if held and held != known:
            self.times.put([(t,) for t in held])
            self.wake(held[-1] + self.micros)
        return rows.assign(allowed=allowed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.times.clear()
        self.due.clear()
        return iter(())


class Fresh(Timed):
    """The time of the last new event; it leaves after the time to live."""

    def __init__(self, order: list[str], micros: int):
        super().__init__(order)
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at long")

    def take(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        last = self.last.get()[0] if self.last.exists() else None
        known, keep = last, []
        for t in rows[self.order[0]].tolist():
            keep.append(last is None or t - last >= self.micros)
            if keep[-1]:
                last = t
        if last != known:
            self.last.update((last,))
            self.wake(last + self.micros)
        return rows[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        self.due.clear()
        return iter(())


class Session(Timed):
    """When a session was flushed and touched last and its deltas; each change of its state is a row, and so is its end after an idle time."""

    def __init__(self, key: str, order: list[str], kind: str, idle: int):
        super().__init__(order)
        self.key, self.kind, self.idle = key, kind, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.own = handle.getValueState("session", "flushed long, touched long, deltas long, state string")

    def _row(self, key, at: int, flushed, touched, deltas: int, state: str) -> tuple:
        return (key[0], at, flushed, touched, deltas, state)

    def _frame(self, rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[self.key, "at", "flushed", "touched", "deltas", "state"])
        return out.astype({"flushed": "Int64", "touched": "Int64"})

    def take(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        flushed, touched, deltas, state = self.own.get() if self.own.exists() else (None, None, 0, None)
        out = []
        for at, kind in zip(rows[self.order[0]].tolist(), rows[self.kind].tolist(), strict=True):
            last = max((x for x in (flushed, touched) if x is not None), default=at)
            if at - last > self.idle:  # its timer had no time to fire
                out.append(self._row(key, last + self.idle, flushed, touched, deltas, "abandoned"))
                flushed, touched, deltas, state = None, None, 0, None
            if kind == "flush":
                flushed = at
            else:
                touched, deltas = at, deltas + 1
            now = "dirty" if touched is not None and touched > (-1 if flushed is None else flushed) else "clean"
            if now != state:
                out.append(self._row(key, at, flushed, touched, deltas, now))
            state = now
        # the last row of a trigger says where the session stands, whether its state changed or not
        if not out or out[-1][1:5] != (at, flushed, touched, deltas):
            out.append(self._row(key, at, flushed, touched, deltas, state))
        self.own.update((flushed, touched, deltas, state))
        self.wake(max(x for x in (flushed, touched) if x is not None) + self.idle)
        return self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        flushed, touched, deltas, _ = self.own.get()
        self.own.clear()
        self.due.clear()
        end = max(x for x in (flushed, touched) if x is not None) + self.idle
        yield self._frame([self._row(key, end, flushed, touched, deltas, "abandoned")])


def _run(events: DataFrame, keys: list[str], processor: Timed, schema) -> DataFrame:
    return events.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def rate_limited_stream(events: DataFrame, key: str, at: str, order: str, most: int, seconds: int) -> DataFrame:
    """events (a stream with a watermark) with allowed: at most so many allowed ones of a key in the seconds before, rejected ones don't count."""
    schema = StructType(events.schema.fields[:]).add("allowed", BooleanType())
    return _run(events, [key], Window([at, order], most, seconds * 1_000_000), schema)


def first_in_ttl_stream(events: DataFrame, keys: list[str], at: str, order: str, micros: int) -> DataFrame:
    """New events of a stream with a watermark: no new event of the same keys lies less than micros before."""
    return _run(events, keys, Fresh([at, order], micros), events.schema)


def sessions_stream(events: DataFrame, key: str, at: str, order: str, kind: str, idle: int) -> DataFrame:
    """key, at, flushed, touched, deltas, state: each change of a session's state (dirty, clean), where it stands after each trigger, and abandoned
    more than idle micros after its last event, once the watermark has passed them or a later event comes. What comes later begins it anew."""
    own = events.schema[key].dataType.simpleString()
    return _run(events, [key], Session(key, [at, order], kind, idle), f"{key} {own}, at long, flushed long, touched long, deltas long, state string")


def pushed_stream(snapshots: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """Polls of a snapshot whose serialised payload differs from the last one sent of their key; what was sent last outlives a restart."""
    said = snapshots.withColumn("payload", F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}))
    return changed_stream(said, key, order, "payload")
