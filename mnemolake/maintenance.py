"""Maintenance operations by name: when each is due, and running those that are."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession


class Maintenance:
    """Operations with intervals; the times of the last runs can be saved beside the tables and loaded again."""

    def __init__(self, last: dict[str, float] | None = None):
        self._ops: dict[str, tuple[Callable[[], object], float]] = {}
        self.last = dict(last or {})

    def register(self, name: str, run: Callable[[], object], every: float) -> None:
        """An operation of a name that is taken replaces the old one and goes to the end."""
        self._ops.pop(name, None)
        self._ops[name] = (run, every)

    def due(self, now: float, force: bool = False) -> list[str]:
        return [n for n, (_, every) in self._ops.items() if force or now - self.last.get(n, 0.0) >= every]

    def run_one(self, name: str, now: float, force: bool = False) -> object:
        """The operation's result, or None if it is not due. After an error the old time stands, so it is due again."""
        if name not in self.due(now, force):
            return None
        out = self._ops[name][0]()
        self.last[name] = now
        return out

    def run_all(self, now: float, force: bool = False, go_on: bool = False) -> dict[str, object]:
        """Results by name, in order of registration; with go_on an error stands in place of a result, else it is raised."""
        out: dict[str, object] = {}
        for name in self.due(now, force):
            try:
                out[name] = self.run_one(name, now, force)
            except Exception as e:  # noqa: BLE001  the caller asked to go on
                if not go_on:
                    raise
                out[name] = e
        return out

    def dry_run(self, now: float) -> dict[str, dict]:
        """What is due and when the rest will be; nothing runs."""
        return {n: {"last": self.last.get(n), "next": self.last.get(n, 0.0) + every, "due": now - self.last.get(n, 0.0) >= every} for n, (_, every) in self._ops.items()}

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(self.last),)], "state string").coalesce(1).write.mode("overwrite").text(path)

    def load(self, spark: SparkSession, path: str) -> None:
        self.last = json.loads(spark.read.text(path).first()[0])


