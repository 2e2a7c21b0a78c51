"""Configuration of ranking and lifecycle: fixed values, and small tables of them as expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fixed clock of the registered queries: 2025-01-01T00:00:00Z.
NOW = 1735689600.0
DAY = 86400.0

#: Weights of the retrieval score.
VECTOR_WEIGHT, FTS_WEIGHT, MIN_FUSED, BASE_WEIGHT_FACTOR = 0.7, 0.3, 0.3, 0.5
FREQUENCY, REINFORCEMENT, FRESHNESS, LONG_TERM, PROJECT_BOOST, HOUR_BOOST = 0.05, 0.10, 0.08, 0.05, 0.10, 0.05
GRAPH_MIN_SCORE, TOP_K = 0.2, 5

#: Decay per day and its floor, by memory type.
TYPE_DECAY = {
    "conversation": (0.05, 0.2), "fact": (0.03, 0.4), "emotion_label": (0.05, 0.2), "emotional_event": (0.04, 0.3), "preference": (0.02, 0.5), "user_trait": (0.01, 0.6),
    "identity": (0.005, 0.7), "decision": (0.005, 0.7), "lesson": (0.01, 0.6), "convention": (0.005, 0.7), "pitfall": (0.005, 0.7), "default": (0.05, 0.2),
}
#: Factor by memory type.
TYPE_BOOST = {"emotion": 1.2, "fact": 1.1, "user_trait": 1.15, "preference": 1.05, "conversation": 1.0, "default": 1.0}
#: Factor by query intent and memory type.
INTENT_BOOST = {"WHY": {"decision": 1.3, "lesson": 1.1, "conversation": 1.1}, "WHEN": {"conversation": 1.15, "fact": 1.1}, "ENTITY": {"fact": 1.2, "preference": 1.1, "identity": 1.1}}
#: Cues of each query intent; the first intent with a cue wins.
INTENT_CUES = {
    "WHY": ["为什么", "为何", "原因", "理由", "动机", "怎么解决", "如何解决", "怎么修", "如何修", "why", "because", "reason", "cause", "导致"],
    "WHEN": ["什么时候", "何时", "时间", "多久", "最近", "上次", "哪天", "几月", "几号", "when", "before", "after", "timeline", "时间线"],
    "ENTITY": ["什么是", "是谁", "关于", "介绍", "哪个", "哪些", "what is", "who is", "tell me about", "讲讲"],
}
#: Types that are never archived or merged by maintenance.
SOUL_TYPES = ["identity", "axiom", "rule"]
#: Relation by (kind of the new note, kind of the other).
KIND_RULES = {("decision", "pitfall"): "SOLVES", ("idea", "pitfall"): "SOLVES", ("convention", "pitfall"): "PREVENTS", ("pitfall", "decision"): "CAUSED_BY"}


def lookup(values: dict, key: Column, default) -> Column:
    """A literal map by key, with a default."""
    return F.coalesce(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items() if k != "default"))[key], F.lit(default))


def sql_case(values: dict, key: str, default) -> str:
    """The same as SQL text."""
    return "CASE " + key + "".join(f" WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in values.items() if k != "default") + f" ELSE CAST({default} AS DOUBLE) END"
