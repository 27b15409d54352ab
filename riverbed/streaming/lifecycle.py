"""Lifecycle of listings as a stateful stream: a state for each id, a timer for the end of its being new.

A micro-batch reads and writes the states of the ids in it only, and the timers that are due. States are kept in the state
store with the stream's checkpoint, so a batch that is run again after a failure starts from the states before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a state has; instants in milliseconds since 1970.
STATE = "source string, price double, first_seen long, last_seen long, new_at long, active boolean, removed_at long"
EVENTS = f"id string, event string, at long, {STATE}"
NEW_DAYS = 14
_DAY = 86_400_000


class Lifecycle(StatefulProcessor):
    """Rows of an id in the order of their instants to its events: added, seen, removed, and listed, when it isn't new any more."""

    def __init__(self, new_days: int = NEW_DAYS):
        self.new_ms = new_days * _DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("listing", STATE)

    def _event(self, key, event: str, at: int) -> tuple:
        return (key[0], event, at, *self.held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.state.get() if self.state.exists() else None
        self.held, out = found, []
        every = pd.concat(list(rows)).sort_values(["at_ms", "gone"], kind="stable")
        for r in every.itertuples(index=False):
            if r.gone:
                # only what is there and active can go
                if self.held is not None and self.held[5]:
                    self.held = (*self.held[:5], False, int(r.at_ms))
                    out.append(self._event(key, "removed", int(r.at_ms)))
                continue
            price = None if pd.isna(r.price) else float(r.price)
            if self.held is None:
                new_at = int(r.at_ms) if r.baseline_ready else None
                self.held = (r.source, price, int(r.at_ms), int(r.at_ms), new_at, True, None)
                if new_at is not None:
                    self.handle.registerTimer(new_at + self.new_ms)
                out.append(self._event(key, "added", int(r.at_ms)))
            else:
                self.held = (r.source, price, self.held[2], int(r.at_ms), self.held[4], True, None)
                out.append(self._event(key, "seen", int(r.at_ms)))
        if self.held is not None:
            self.state.update(self.held)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held = self.state.get() if self.state.exists() else None
        out = []
        if self.held is not None and self.held[5]:
            out.append(self._event(key, "listed", int(expiredTimerInfo.getExpiryTimeInMs())))
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in EVENTS.split(", ")]
    made = pd.DataFrame(rows, columns=names)
    kinds = {"at": "Int64", "first_seen": "Int64", "last_seen": "Int64", "new_at": "Int64", "removed_at": "Int64"}
    return made.astype(kinds)


def lifecycle_events(stream: DataFrame, late: str = "1 day", new_days: int = NEW_DAYS) -> DataFrame:
    """``id, event, at`` and the state after it, as rows of ``id, source, price, at, gone, baseline_ready`` come in.

    ``at`` is the time of the run that captured a row; ``gone`` says that the row proves its listing inactive, which ends it
    until it is seen again; ``baseline_ready`` that the source has a baseline, without which a first sight isn't new. A listing
    that is still active ``new_days`` after it was new is listed, as soon as the watermark, which is ``late`` behind, has passed
    that time. Needs the RocksDB state store.
    """
    rows = stream.withWatermark("at", late).select("id", "source", "price", "at", "gone", "baseline_ready", F.unix_millis("at").alias("at_ms"))
    return rows.groupBy("id").transformWithStateInPandas(Lifecycle(new_days), EVENTS, "Append", "EventTime")


def latest_states(events: DataFrame) -> DataFrame:
    """``id`` and state after the last of the events written so far."""
    columns = [c.split()[0] for c in STATE.split(", ")]
    order = F.struct("at", F.array_position(F.array(*map(F.lit, ["added", "seen", "removed", "listed"])), F.col("event")))
    last = events.where("event <> 'listed'").groupBy("id").agg(F.max_by(F.struct(*columns), order).alias("s"))
    return last.select("id", "s.*")
