"""Folds in which time acts too: while a key is silent, ticks change its state, until nothing changes or the state ends.

After an event the first tick comes `first` seconds later, the next ones `every` seconds apart, MOST in a row at most; an
event comes before a tick of the same moment and starts the count anew. The batch pass (`fold_timed`) and the streaming
twin (`streaming.timers`) walk through events and ticks by the same `due`, so they give the same rows.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .folds import clamp, vitality

Event = namedtuple("Event", "ts tie event_type intensity")
Timed = namedtuple("Timed", "step tick first every columns")

#: Ticks without an event in between, a day of them; a key that stays silent costs nothing after that.
MOST = 144


def _curious(state: dict | None, row: Event) -> dict:
    """Falls when an interaction interrupts; the ticks let it grow."""
    c = state["curiosity"] if state else 0.5
    return {"curiosity": max(0.15, c - 0.25) if row.event_type == "purchase" else c}


def _wonders(state: dict, ts: float) -> dict:
    return {"curiosity": min(1.0, state["curiosity"] + 0.06)}


def _active(state: dict | None, row: Event) -> dict:
    return {"activation": clamp((state["activation"] if state else 0.0) + row.intensity, 0.0), "seen": (state["seen"] if state else 0) + 1}


#: Curiosity grows from ten idle minutes on, activation lasts twenty.
TIMED = {
    "curiosity": Timed(_curious, _wonders, 600.0, 600.0, "curiosity double"),
    "vitality": Timed(vitality, lambda s, ts: vitality(s, Event(ts, None, "idle", 0.0)), 600.0, 600.0, "vitality double, talks long"),
    "activation": Timed(_active, lambda s, ts: None, 1200.0, 1200.0, "activation double, seen long"),
}


def next_tick(held: dict | None, t: Timed) -> float | None:
    """When time acts next: None if it does not."""
    if held is None or held["ticks"] >= MOST or held["still"]:
        return None
    return held["last"] + t.first + t.every * held["ticks"]


def due(held: dict | None, t: Timed, events: list[Event], until: float) -> Iterator[tuple[dict | None, Event | float, dict | None]]:
    """(what is held after, the event or the time of the tick, the state to show) for ordered events and for all ticks before `until`.

    What is held is the state with the time of the last event and the ticks since; None once a tick has ended the state.
    """
    for e in [*events, None]:
        while (at := next_tick(held, t)) is not None and at < (e.ts if e is not None else until):
            new = t.tick(held["s"], at)
            still = new is not None and {k: v for k, v in new.items() if k != "ts"} == {k: v for k, v in held["s"].items() if k != "ts"}
            held = None if new is None else {**held, "s": new, "ticks": held["ticks"] + 1, "still": still}
            if not still:
                yield held, at, new
        if e is not None:
            held = {"s": t.step(held and held["s"], e), "last": e.ts, "ticks": 0, "still": False}
            yield held, e, held["s"]
    yield held, until, None


def fields_of(t: Timed) -> list[str]:
    return [c.split()[0] for c in t.columns.split(", ")]


def shown(key, what: Event | float, state: dict | None, fields: list[str]) -> tuple:
    """(key, the event's id or null, time, kind, the state's fields); a state that ended shows nulls."""
    event = isinstance(what, Event)
    return key, what.tie if event else None, what.ts if event else what, "event" if event else "idle" if state else "expired", *(state[f] if state else None for f in fields)


def framed(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Whole numbers that may be null stay whole."""
    return pd.DataFrame({c: pd.array(v, dtype="Int64") if any(isinstance(x, int) for x in v) else pd.Series(v, dtype=object if all(x is None for x in v) else None) for c, v in zip(columns, zip(*rows, strict=True), strict=True)})


def schema_of(t: Timed, key: str, tie: str) -> str:
    return f"{key} long, {tie} long, ts double, kind string, {t.columns}"


def fold_timed(events: DataFrame, name: str, until: float, *, key: str = "user_id", tie: str = "event_id") -> DataFrame:
    """A row for each event and each tick before `until`. Events (key, tie, ts, event_type, intensity) at or after it are left out."""
    t = TIMED[name]
    return _walk(events, until, key, tie, t, schema_of(t, key, tie), lambda k, steps: [shown(k, what, s, fields_of(t)) for _, what, s in steps[:-1]])


def states(events: DataFrame, name: str, until: float, *, key: str = "user_id", tie: str = "event_id") -> DataFrame:
    """(key, held) of each key that has a state at `until`: what a stream starts from."""
    t = TIMED[name]
    return _walk(events, until, key, tie, t, f"{key} long, held string", lambda k, steps: [(k, json.dumps(h)) for h, _, _ in steps[-1:] if h is not None])


def _walk(events: DataFrame, until: float, key: str, tie: str, t: Timed, schema: str, out: Callable) -> DataFrame:
    """Rows sorted by key and time pass once with one key's state in hand; `out` gets one batch of a key's steps at a time."""
    columns = [c.split()[0] for c in schema.split(", ")]
    last_only = len(columns) == 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, k, rows = None, None, []
        for b in batches:
            for row in b.itertuples(index=False):
                now = getattr(row, key)
                if k is not None and now != k:
                    rows += out(k, list(due(held, t, [], until)))
                    held = None
                k = now
                e = Event(row.ts, getattr(row, tie), row.event_type, row.intensity)
                steps = list(due(held, t, [e], e.ts))
                held = steps[-1][0]
                if not last_only:
                    rows += out(k, steps)
            if rows:
                yield framed(rows, columns)
                rows = []
        if k is not None and (rows := out(k, list(due(held, t, [], until)))):
            yield framed(rows, columns)

    known = events.where(f"{key} IS NOT NULL AND ts < {until!r}").select(key, tie, "ts", "event_type", "intensity")
    return known.repartition(key).sortWithinPartitions(key, "ts", tie).mapInPandas(run, schema)
