"""State machines by key with timers in event time: one recurrence, a batch form and a stream form.

A machine follows a key's rows in order of (at, seq) and may ask to be woken at a time; ``drive`` is that
order of rows and timers, used by both forms. The batch form deals rows by key, sorts them and holds
one key's state at a time. The stream form (``transformWithState``) holds a key's rows back until the
watermark has passed them, so files may come in any order, and registers one timer for what is next,
a held row or the machine's own time; a timer fires without a new row of its key. So a stream whose
rows are no later than its watermark gives exactly what the batch gives.

Times are microseconds since 1970 as bigint. Rows are ``<keys>, at, seq, kind``; rows that repeat a
(at, seq) of a key count once. Rows with a null time have no place and are left out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

HOUR = 3600 * 1_000_000
DAY = 24 * HOUR
State = Any


@dataclass(frozen=True)
class Machine:
    """``step(state, at, seq, kind)`` and ``fire(state, at)`` give the next state and rows of ``out``.

    ``due(state)`` is the time to be woken at, or None; ``fire`` has to move it on. A state is made of
    what JSON has; None is the state of a key that nothing is known of.
    """

    out: str
    step: Callable[[State, int, int, str], tuple[State, list[tuple]]]
    due: Callable[[State], int | None]
    fire: Callable[[State, int], tuple[State, list[tuple]]]


def drive(machine: Machine, state: State, last: list | None, rows: Iterable[tuple], until: int | None) -> tuple[State, list | None, list[tuple]]:
    """Rows and timers in order, timers before rows of the same time; then timers up to ``until``."""
    out: list[tuple] = []

    def timers(state: State, to: int) -> State:
        while state is not None and (at := machine.due(state)) is not None and at <= to:
            state, made = machine.fire(state, at)
            out.extend(made)
        return state

    for at, seq, kind in rows:
        if last is not None and [at, seq] == last:
            continue
        last = [at, seq]
        state, made = machine.step(timers(state, at), at, seq, kind)
        out.extend(made)
    if until is not None:
        state = timers(state, until)
    return state, last, out


def _schema(rows: DataFrame, keys: list[str], machine: Machine) -> StructType:
    schema = StructType([rows.schema[k] for k in keys])
    for f in StructType.fromDDL(machine.out):
        schema = schema.add(f)
    return schema


def batch(rows: DataFrame, keys: list[str], machine: Machine, until: int) -> DataFrame:
    """The rows that a machine gives for each key, with timers up to ``until``."""
    schema = _schema(rows, keys, machine)
    arrow, n = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = last = None
        made = lambda out: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:n] != key:
                    if key is not None:
                        out += [(*key, *r) for r in drive(machine, state, None, (), until)[2]]
                    key, state, last = row[:n], None, None
                state, last, new = drive(machine, state, last, [row[n:]], None)
                out += [(*key, *r) for r in new]
            if out:
                yield made(out)
        if key is not None and (out := [(*key, *r) for r in drive(machine, state, None, (), until)[2]]):
            yield made(out)

    rows = rows.where("at IS NOT NULL").select(*keys, "at", "seq", "kind")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "at", "seq").mapInArrow(run, schema)


class _Processor(StatefulProcessor):
    def __init__(self, machine: Machine, keys: list[str], names: list[str]):
        self.machine, self.keys, self.names = machine, keys, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "data string")
        self.held = handle.getListState("held", "at bigint, seq bigint, kind string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.held.appendList(list(zip(frame["at"].tolist(), frame["seq"].tolist(), frame["kind"].tolist())))
        yield from self._go(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go(key, timerValues)

    def _go(self, key, timers) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs() * 1000  # rows before it are complete
        state, last = json.loads(self.state.get()[0]) if self.state.exists() else (None, None)
        held = sorted(tuple(r) for r in self.held.get()) if self.held.exists() else []
        ready = [r for r in held if r[0] < passed]
        state, last, out = drive(self.machine, state, last, ready, passed - 1)
        rest = held[len(ready) :]
        self.held.put(rest) if rest else self.held.clear()
        self.state.update((json.dumps([state, last]),)) if state is not None or rest else self.state.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        wake = [t for t in (rest[0][0] if rest else None, self.machine.due(state) if state is not None else None) if t is not None]
        if wake:
            self.handle.registerTimer(min(wake) // 1000 + 1)
        yield pd.DataFrame([(*key, *r) for r in out], columns=self.names)

    def close(self) -> None:
        pass


def stream(rows: DataFrame, keys: list[str], machine: Machine, late: str) -> DataFrame:
    """The same for a stream with a ``ts`` column beside ``at``, rows at most ``late`` out of order.

    Needs the RocksDB provider of state stores. What is held for a key are its rows of the last
    ``late`` and its machine's state.
    """
    schema = _schema(rows, keys, machine)
    timed = rows.where("at IS NOT NULL").select(*keys, "at", "seq", "kind", "ts").withWatermark("ts", late)
    return timed.groupBy(*keys).transformWithStateInPandas(_Processor(machine, keys, schema.names), schema, "Append", "EventTime")


# the adaptive schedule of a source

#: Hours until the next look after so many looks without a change, the last for all more.
LADDER = (6, 12, 24, 48, 96, 168)
#: Wait after an error, and the longest time without a full reading.
ERROR_WAIT, FRESH = HOUR, 7 * DAY


def _looked(state: State, at: int, seq: int, kind: str) -> tuple[State, list[tuple]]:
    same, full, _ = state or (0, None, None)
    same = same + 1 if kind == "same" else 0 if kind == "changed" else same
    wait = ERROR_WAIT if kind == "error" else LADDER[min(same, len(LADDER) - 1)] * HOUR
    until = at + wait if full is None else min(at + wait, full + FRESH)
    return [same, at if kind == "changed" else full, max(until, at)], [(at, kind, same, until)]


SCHEDULE = Machine(
    "at bigint, event string, same bigint, next_at bigint",
    _looked,
    lambda s: s[2],
    lambda s, at: ([s[0], s[1], None], [(at, "due", s[0], at)]),
)

# retries with backoff

#: Failures that end a job, the longest wait, and the wait where no try was possible.
ATTEMPTS, LONGEST, DEFER = 5, 24 * HOUR, HOUR // 4


def _tried(state: State, at: int, seq: int, kind: str) -> tuple[State, list[tuple]]:
    """``ok`` ends a job; ``failed`` counts and doubles the wait; ``blocked`` waits without counting."""
    if kind == "ok":
        return None, [(at, "done", state[0], None)] if state else []
    if kind == "blocked":
        n, until = state[0] if state else 1, at + DEFER
    else:
        n = min(state[0] + 1, ATTEMPTS) if state else 1
        until = at + min(HOUR << (n - 1), LONGEST)
    if n >= ATTEMPTS:
        return [n, None], [(at, "gave up", n, None)]
    return [n, until], [(at, kind, n, until)]


RETRIES = Machine("at bigint, event string, attempts bigint, next_at bigint", _tried, lambda s: s[1], lambda s, at: ([s[0], None], [(at, "retry", s[0], None)]))

# findings that close when they are not seen again

#: How long a finding stays open after it was seen last.
SEEN = 3 * DAY


def _seen(state: State, at: int, seq: int, kind: str) -> tuple[State, list[tuple]]:
    """A map of symptoms to first time, last time and count."""
    state = dict(state or {})
    old = state.get(kind)
    state[kind] = [old[0], at, old[2] + 1] if old else [at, at, 1]
    return state, [] if old else [(at, kind, "opened", 1, at)]


def _unseen(state: State, at: int) -> tuple[State, list[tuple]]:
    gone = sorted(k for k, v in state.items() if v[1] + SEEN <= at)
    out = [(state[k][1] + SEEN, k, "expired", state[k][2], state[k][0]) for k in gone]
    return {k: v for k, v in state.items() if k not in gone} or None, out


FINDINGS = Machine("at bigint, symptom string, event string, occurrences bigint, first_seen bigint", _seen, lambda s: min(v[1] for v in s.values()) + SEEN, _unseen)

# the tier of a source by its recall

#: Rolling recall below which a source goes up, that it has to reach to come down, runs before either, weight of the last reading.
WEAK, STRONG, RUNS, ALPHA = 0.70, 0.90, 3, 0.4


def recall(demote: bool = False) -> Machine:
    """``kind`` is a reading between 0 and 1 as text, or empty where nothing was measured, which changes nothing.

    A tier goes up below ``WEAK`` and, if ``demote``, comes down from ``STRONG``; between the two it stays.
    """

    def step(state: State, at: int, seq: int, kind: str) -> tuple[State, list[tuple]]:
        if not kind:
            return state, []
        mean, runs, tier = state or (None, 0, "fast")
        mean = float(kind) if mean is None else ALPHA * float(kind) + (1 - ALPHA) * mean
        runs, before = runs + 1, tier
        if runs >= RUNS:
            if tier == "fast" and mean < WEAK:
                tier = "capable"
            elif tier == "capable" and demote and mean >= STRONG:
                tier = "fast"
        mean = math.floor(mean * 1000 + 0.5) / 1000
        return [mean, runs, tier], [(at, runs, mean, tier, tier != before)]

    return Machine("at bigint, runs bigint, mean double, tier string, changed boolean", step, lambda s: None, lambda s, at: (s, []))


# a daily quota with refunds


def quota(limit: int = 5) -> Machine:
    """``charge`` takes one of a day's ``limit`` or is refused; ``refund`` gives one of that day's own back, to 0 at least."""

    def step(state: State, at: int, seq: int, kind: str) -> tuple[State, list[tuple]]:
        used, refused, refunded = state[1:] if state else (0, 0, 0)
        if kind == "refund":
            event = "refunded" if used else "nothing"
            used, refunded = max(0, used - 1), refunded + (used > 0)
        else:
            event = "charged" if used < limit else "refused"
            used, refused = min(limit, used + 1), refused + (used >= limit)
        return [at // DAY, used, refused, refunded], [(at, seq, event, used, refused, refunded)]

    return Machine(
        "at bigint, seq bigint, event string, used bigint, refused bigint, refunded bigint",
        step,
        lambda s: (s[0] + 1) * DAY,
        lambda s, at: (None, [(at, None, "day over", *s[1:])]),
    )


QUOTA = quota()
