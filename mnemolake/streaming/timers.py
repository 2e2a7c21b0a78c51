"""The timed folds on a stream: event-time timers, state that ends, a start from what a batch pass left.

Events wait in the key's state until the watermark has passed them, so that rows that are out of order within it are
applied in order; one timer for the oldest waiting event and one for the next tick wake the key. The state store must be
RocksDB (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.timed import TIMED, Event, due, fields_of, framed, next_tick, schema_of, shown


class _Walker(StatefulProcessor):
    def __init__(self, name: str, key: str, tie: str):
        self.name, self.key, self.tie = name, key, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timed = TIMED[self.name]
        self.handle = handle
        self.held = handle.getValueState("held", "held string")
        self.waiting = handle.getListState("waiting", "ts double, tie long, event_type string, intensity double")

    def _wake(self, at: float | None) -> None:
        if at is not None:
            self.handle.registerTimer(math.ceil(at * 1000))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        held = initialState["held"].iloc[0]
        self.held.update((held,))
        self._wake(next_tick(json.loads(held), self.timed))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.waiting.appendList([(float(r.ts), int(getattr(r, self.tie)), r.event_type, float(r.intensity)) for r in part.itertuples(index=False)])
            self._wake(float(part["ts"].min()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() / 1000
        rows = sorted((Event(*r) for r in self.waiting.get()), key=lambda e: (e.ts, e.tie)) if self.waiting.exists() else []
        ready, rest = [e for e in rows if e.ts < until], [e for e in rows if e.ts >= until]
        before = json.loads(self.held.get()[0]) if self.held.exists() else None
        *steps, (held, _, _) = due(before, self.timed, ready, until)
        if ready:
            self.waiting.put([tuple(e) for e in rest]) if rest else self.waiting.clear()
        if held is None:
            self.held.clear()
        elif held != before:
            self.held.update((json.dumps(held),))
        self._wake(rest[0].ts if rest else None)
        self._wake(next_tick(held, self.timed))
        if steps:
            columns = [c.split()[0] for c in schema_of(self.timed, self.key, self.tie).split(", ")]
            yield framed([shown(key[0], what, s, fields_of(self.timed)) for _, what, s in steps], columns)


def stream_timed(events: DataFrame, name: str, late: str, *, initial: DataFrame | None = None, key: str = "user_id", tie: str = "event_id") -> DataFrame:
    """Rows as of `operators.timed.fold_timed`, each once the watermark, `late` behind the newest event, has passed it.

    initial is what `operators.timed.states` gives for the events before the stream. Events without a key, time or id are left out.
    """
    known = events.where(f"{key} IS NOT NULL AND ts IS NOT NULL AND {tie} IS NOT NULL").select(key, tie, "ts", "event_type", F.coalesce("intensity", F.lit(0.0)).alias("intensity"), F.timestamp_seconds("ts").alias("_at"))
    start = None if initial is None else initial.groupBy(key)
    return known.withWatermark("_at", late).groupBy(key).transformWithStateInPandas(_Walker(name, key, tie), schema_of(TIMED[name], key, tie), "append", "eventtime", start)
