"""Trees of (node_id, parent_id) rows: paths and inheritance by pointer jumping, in as many rounds as the depth has bits.

A pointer table holds, for every node, the ancestor 1, 2, 4, ... steps up; a round joins it with itself and writes it. No
round depends on the depth otherwise, so a conversation of a thousand turns takes ten rounds. A parent that has no row of
its own is an ancestor like any other; a null parent ends the path. A cycle is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut


def _rounds(nodes: DataFrame) -> int:
    """After so many rounds only pointers on a cycle still move."""
    return nodes.count().bit_length() + 2


def ancestors(nodes: DataFrame, of: DataFrame | None = None, within: int | None = None) -> DataFrame:
    """(node_id, ancestor_id, dist) of every node, or of those in `of`, itself included; with `within`, of distances below it.

    The result has as many rows as the paths have places; each round doubles their length by one join with the pointers.
    """
    up = cut(nodes.where("parent_id IS NOT NULL").select(F.col("node_id").alias("at"), F.col("parent_id").alias("to")))
    start = nodes if of is None else of
    found = start.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("dist"))
    for i in range(_rounds(nodes)):
        step = 1 << i
        if up.isEmpty() or (within is not None and step >= within):
            return found if within is None else found.where(F.col("dist") < within)
        both = F.array(F.struct("ancestor_id", "dist"), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("ancestor_id"), (F.col("dist") + step).alias("dist"))))
        far = found.join(up, found.ancestor_id == up.at, "left").select("node_id", F.explode(F.array_compact(both)).alias("a"))
        found = far.select("node_id", "a.ancestor_id", "a.dist")
        up = cut(up.join(up.select(F.col("at").alias("to"), F.col("to").alias("next")), "to").select("at", F.col("next").alias("to")))
    raise ValueError("the parents form a cycle")


def nearest(nodes: DataFrame, marked: DataFrame, cycles: bool = False) -> DataFrame:
    """(node_id, ancestor_id, dist) of the nearest ancestor in `marked` (node_id), the node itself included; others are left out.

    One row a node in every round, whatever the depth. With `cycles`, nodes that lead into a cycle without a marked node are left out, too.
    """
    state = nodes.select("node_id", F.col("parent_id").alias("to")).join(marked.select("node_id", F.col("node_id").alias("hit")).distinct(), "node_id", "left")
    state = cut(state.select("node_id", F.when(F.col("hit").isNull(), F.col("to")).alias("to"), "hit", F.when(F.col("hit").isNotNull(), 0).alias("dist")))
    for i in range(_rounds(nodes)):
        if state.where("to IS NOT NULL").isEmpty():
            return state.where("hit IS NOT NULL").select("node_id", F.col("hit").alias("ancestor_id"), "dist")
        there = state.select(F.col("node_id").alias("to"), F.col("to").alias("next"), F.col("hit").alias("its"), F.col("dist").alias("more"))
        state = cut(state.join(there, "to", "left").select("node_id", F.col("next").alias("to"), F.coalesce("hit", "its").alias("hit"), F.coalesce("dist", F.col("more") + (1 << i)).alias("dist")))
    if cycles:
        return state.where("hit IS NOT NULL").select("node_id", F.col("hit").alias("ancestor_id"), "dist")
    raise ValueError("the parents form a cycle")


def inherited(messages: DataFrame, links: DataFrame) -> DataFrame:
    """(card, dist, message) that each card inherits along its chain of sources, the oldest link first.

    messages: (card, place, message), places count from 1 in each card. links: (card, source, upto): a card goes on from the
    first `upto` messages of its source, of none for 0, of all for null. The chains of all cards come from pointer jumping;
    each link then adds the prefix of its source, so a chain of a thousand cards takes ten rounds.
    """
    chains = ancestors(links.select(F.col("card").alias("node_id"), F.col("source").alias("parent_id")))
    part = links.join(messages.withColumnRenamed("card", "source"), "source").where(F.col("upto").isNull() | (F.col("place") <= F.col("upto"))).select(F.col("card").alias("ancestor_id"), "place", "message")
    return chains.join(part, "ancestor_id").select(F.col("node_id").alias("card"), "dist", "place", "message")
