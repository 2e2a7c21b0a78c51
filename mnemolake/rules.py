"""Registries of validation rules: conditions as columns, all checked in one pass over a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities, the mildest first.
SEVERITIES = ["debug", "info", "warning", "error", "critical"]


class Rules:
    """Rules by name: when a row fails, and how bad that is. A rule that is switched off stays registered."""

    def __init__(self, rules: dict[str, tuple[Callable[[], Column], str]] | None = None):
        self._rules, self._off = dict(rules or {}), set()

    def register(self, name: str, fails: Callable[[], Column], severity: str = "warning") -> None:
        """A rule of a name that is taken replaces the old one."""
        if severity not in SEVERITIES:
            raise ValueError(f"unknown severity: {severity}")
        self._rules[name] = (fails, severity)

    def disable(self, name: str) -> None:
        self._off.add(name)

    def enable(self, name: str) -> None:
        self._off.discard(name)

    def summary(self) -> dict[str, list[str]]:
        return {"rules": sorted(self._rules), "disabled": sorted(self._off & self._rules.keys())}

    def codes(self, least: str = "debug") -> Column:
        """The names of the rules that a row fails, of this severity at least, in order of registration; a null condition does not fail."""
        from_ = SEVERITIES.index(least)
        on = [(n, f) for n, (f, s) in self._rules.items() if n not in self._off and SEVERITIES.index(s) >= from_]
        return F.array_compact(F.array(*(F.when(f(), F.lit(n)) for n, f in on))) if on else F.array().cast("array<string>")

    def check(self, df: DataFrame, name: str = "errors") -> DataFrame:
        return df.withColumn(name, self.codes())

    def accepted(self, df: DataFrame, least: str = "error") -> DataFrame:
        """Rows that fail no rule of this severity or worse."""
        return df.where(F.size(self.codes(least)) == 0)
