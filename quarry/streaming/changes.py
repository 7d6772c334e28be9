"""Change events, alert dedup and windowed health as streams, each with a batch twin.

A stream and its twin share the rules below, so tests can hold one against the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "key bigint, seq bigint, change string, old_value string, new_value string"
STATE = "status string, price double"


def change_events(states: DataFrame, fields: tuple[str, ...] = ("status", "price")) -> DataFrame:
    """Batch: typed changes between consecutive states ``(key, seq, *fields)`` of a key; the first field names a first state."""
    w = Window.partitionBy("key").orderBy("seq")
    rows = states.withColumns({"n": F.row_number().over(w), **{f"p_{f}": F.lag(f).over(w) for f in fields}})
    change = lambda when, kind, a, b: F.when(when, F.struct(F.lit(kind).alias("change"), a.cast("string").alias("old_value"), b.cast("string").alias("new_value")))
    later = F.col("n") > 1
    found = [change(~later, "first_seen", F.lit(None), F.col(fields[0]))] + [change(later & ~F.col(f).eqNullSafe(F.col(f"p_{f}")), f, F.col(f"p_{f}"), F.col(f)) for f in fields]
    return rows.select("key", "seq", F.explode(F.array_compact(F.array(*found))).alias("c")).select("key", "seq", "c.*")


def _text(value) -> str | None:
    return None if value is None or value != value else str(value)


def _diff(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values("seq")
    last = state.get if state.exists else None
    out = []
    for seq, status, price in zip(rows["seq"], rows["status"], rows["price"]):
        now = (_text(status), None if price != price else price)
        if last is None:
            out.append((key[0], seq, "first_seen", None, now[0]))
        else:
            if now[0] != last[0]:
                out.append((key[0], seq, "status", last[0], now[0]))
            if now[1] != last[1]:
                out.append((key[0], seq, "price", _text(last[1]), _text(now[1])))
        last = now
    state.update(last)
    yield pd.DataFrame(out, columns=["key", "seq", "change", "old_value", "new_value"])


def change_stream(states: DataFrame) -> DataFrame:
    """Streaming: the same changes; one (status, price) of state for each key."""
    return states.groupBy("key").applyInPandasWithState(_diff, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def health(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts of each source and window. ``late`` sets a watermark for streams."""
    if late:
        events = events.withWatermark("ts", late)
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return events.groupBy("user_id", F.window("ts", width).alias("w")).agg(n("view").alias("seen"), n("purchase").alias("persisted"), n("error").alias("failed")).select("user_id", F.col("w.start").alias("start"), "seen", "persisted", "failed")


def alerts_once(alerts: DataFrame, keys: list[str], within: str) -> DataFrame:
    """Streaming: an alert of the same keys comes once within the time."""
    return alerts.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def events_once(events: DataFrame, late: str) -> DataFrame:
    """Streaming: each event_id once, state bounded by the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def backoff_hours(attempts: Column) -> Column:
    """1 hour, doubled with each failed attempt, 24 at most."""
    return F.least(F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(24.0))
