"""Structured Streaming twin of the folds: the same steps, the state kept by Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import FOLDS


def stream_fold(events: DataFrame, name: str, *, key: str = "user_id", tie: str = "event_id") -> DataFrame:
    """A state row by key and micro-batch. Rows of one micro-batch are put in order of time; earlier batches are not revised."""
    step, columns = FOLDS[name]
    fields = [c.split()[0] for c in columns.split(", ")]

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", tie])
        s = json.loads(state.get[0]) if state.exists else None
        for row in rows.itertuples(index=False):
            s = step(s, row)
        state.update((json.dumps(s),))
        last = rows.iloc[-1]
        yield pd.DataFrame([(k[0], last[tie], last["ts"], *(s[f] for f in fields))], columns=[key, tie, "ts", *fields])

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, {tie} long, ts double, {columns}", "state string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by window and type; rows later than the watermark are dropped by Spark."""
    from pyspark.sql import functions as F

    return events.withWatermark(time, late).groupBy(F.window(time, size), "event_type").agg(F.count(F.lit(1)).alias("n"))
