"""Circuits of sources and alerts with escalation: a small state for each key that follows its rows in order.

Each is one recurrence, used by a batch query (a group's rows in order) and by a stream (the same
state kept by Spark between batches). A group's rows pass through in Arrow batches; only the state
of the key is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Health up to which a circuit is open or half open, and how long it stays open.
OPEN, HALF, RECOVER_S = 20, 40, 24 * 3600
#: Seconds in which an alert is held back, sent ones that escalate, and within what time.
HELD_S, FIRES, FIRES_S = 6 * 3600, 3, 72 * 3600

CIRCUIT = "house bigint, ts timestamp, event_id bigint, runs bigint, health int, circuit string, fails double"
CIRCUIT_STATE = "runs bigint, health int, circuit string, fails double, ok_at double, opened double, last string, usual int"
START = (0, 100, "closed", 0.0, None, None, "", 0)
ALERT = "house bigint, kind bigint, event_id bigint, ts timestamp, sent boolean, escalated boolean"
ALERT_STATE = "fired double, first double, fires int"


def step(state: tuple, at: float, lots: int, images: float, warned: bool, dom: bool, outage: bool) -> tuple:
    """The state of a circuit after a run. A run that couldn't be made says nothing of the source."""
    runs, health, circuit, fails, ok_at, opened, last, usual = state
    runs += 1
    if outage and not lots:
        return runs, health, circuit, fails, ok_at, opened, last, usual
    health = 50
    if usual > 5:
        health += 30 if lots >= 0.8 * usual else 15 if lots >= 0.5 * usual else -10 if lots >= 0.2 * usual else -30
    elif lots:
        health += 20
    health += (20 if images >= 70 else 10 if images >= 40 else 0 if images >= 10 else -10) + (20 if dom else 10)
    if not lots:
        fails += 1
    elif warned:
        fails += 0.5
    else:
        fails, ok_at = 0.0, at
    health -= min(fails * 15, 45)
    if ok_at is not None:
        health -= min(int((at - ok_at) // 86400) * 5, 25)
    health = max(0, min(100, int(health + 0.5) if health >= 0 else 0))
    recent = [*[int(x) for x in last.split(",") if x], lots][-5:]
    some = [x for x in recent if x]
    if lots:
        usual = int(sum(some) / len(some) + 0.5)
    if health <= OPEN:
        opened = at if opened is None else opened
        circuit = "half-open" if at - opened >= RECOVER_S else "open"
    else:
        circuit, opened = "half-open" if health <= HALF else "closed", None
    return runs, health, circuit, fails, ok_at, opened, ",".join(map(str, recent)), usual


def _seconds(ts: pd.Series) -> list[float]:
    return (ts.astype("datetime64[ns]").astype("int64") / 1e9).tolist()


def _run(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    out = []
    for at, *row in zip(_seconds(rows["ts"]), rows["lots"], rows["images"], rows["warned"], rows["dom"], rows["outage"]):
        state = step(state, at, *row)
        out.append(state[:4])
    made = pd.DataFrame(out, columns=["runs", "health", "circuit", "fails"])
    return state, pd.concat([rows[["house", "ts", "event_id"]].reset_index(drop=True), made], axis=1)


def _keyed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def _followed(keys: list[str], start: tuple, run):
    """Over sorted rows: each key's rows through ``run``, its state carried from one batch to the next."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, start
        for batch in batches:
            for key, part in batch.groupby(keys, sort=False, dropna=False):
                if key != last:
                    last, state = key, start
                state, out = run(state, part)
                yield out

    return each


def circuits(runs: DataFrame) -> DataFrame:
    """Batch: health and circuit after each run of ``house, ts, event_id, lots, images, warned, dom, outage``."""
    return _keyed(runs, ["house"], ["ts", "event_id"]).mapInPandas(_followed(["house"], START, _run), CIRCUIT)


def circuit_stream(runs: DataFrame) -> DataFrame:
    """Streaming: the same for the runs as they come in; one small state for each house."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        now, out = _run(tuple(state.get) if state.exists else START, rows)
        state.update(now)
        yield out

    return runs.groupBy("house").applyInPandasWithState(update, CIRCUIT, CIRCUIT_STATE, "append", GroupStateTimeout.NoTimeout)


def _alert(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    fired, first, fires = state
    sent, raised = [], []
    for at in _seconds(rows["ts"]):
        new = fired is None or at - fired >= HELD_S
        if new:
            first, fires, fired = at if first is None else first, fires + 1, at
        sent.append(new)
        raised.append(bool(new and fires >= FIRES and at - first <= FIRES_S))
    return (fired, first, fires), rows[["house", "kind", "event_id", "ts"]].assign(sent=sent, escalated=raised)


def alerts(rows: DataFrame) -> DataFrame:
    """Batch: which alerts of ``house, kind, event_id, ts`` are sent, and which of them escalated."""
    return _keyed(rows, ["house", "kind"], ["ts", "event_id"]).mapInPandas(_followed(["house", "kind"], (None, None, 0), _alert), ALERT)


def alert_stream(rows: DataFrame) -> DataFrame:
    """Streaming: the same, with the last sent time and the count of a key as state."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = _alert(tuple(state.get) if state.exists else (None, None, 0), pd.concat(list(frames)).sort_values(["ts", "event_id"]))
        state.update(now)
        yield out

    return rows.groupBy("house", "kind").applyInPandasWithState(update, ALERT, ALERT_STATE, "append", GroupStateTimeout.NoTimeout)
