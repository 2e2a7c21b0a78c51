"""Edits of conversation trees: each takes a snapshot and a table of requests and gives the next snapshot.

Nodes are (node_id, parent_id, conv_id, branch_label, node_type, depth, merge_target, is_valid); insights are
(node_id, text, confidence, source_ids), the conclusions that a node holds. Requests that do not apply change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forest


def snapshot(turns: DataFrame) -> DataFrame:
    """The nodes of (node_id, parent_id, conv_id, branch_label) rows: the root, trunk or branch, and how deep."""
    depth = forest.ancestors(turns.select("node_id", "parent_id")).groupBy("node_id").agg(F.max("dist").alias("depth"))
    kind = F.when(F.col("parent_id").isNull(), "root").when(F.col("branch_label").isNotNull(), "branch").otherwise("trunk")
    nodes = turns.select("node_id", "parent_id", "conv_id", "branch_label", kind.alias("node_type")).join(depth, "node_id")
    return nodes.select("*", F.lit(None).cast("long").alias("merge_target"), F.lit(True).alias("is_valid"))


def fork(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (node_id, at, label): a new branch node below `at`, one deeper; unknown places and ids that are taken are refused."""
    at = nodes.select(F.col("node_id").alias("at"), "conv_id", (F.col("depth") + 1).alias("depth"))
    new = requests.join(nodes.select("node_id"), "node_id", "left_anti").join(at, "at")
    new = new.select("node_id", F.col("at").alias("parent_id"), "conv_id", F.col("label").alias("branch_label"), F.lit("branch").alias("node_type"), "depth", F.lit(None).cast("long").alias("merge_target"), F.lit(True).alias("is_valid"))
    return nodes.unionByName(new)


def conclude(nodes: DataFrame, insights: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (node_id, text): the nodes become conclusions and hold the texts with confidence 0.8."""
    asked = nodes.join(requests, "node_id").select("node_id", "text", F.lit(0.8).alias("confidence"), F.array("node_id").alias("source_ids"))
    mark = asked.select("node_id", F.lit(True).alias("_m")).distinct()
    out = nodes.join(mark, "node_id", "left").withColumn("node_type", F.when(F.col("_m"), "conclusion").otherwise(F.col("node_type"))).drop("_m")
    return out, insights.unionByName(asked)


def trunk_ends(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv_id, trunk_id) of ends (conv_id, node_id): an end that was concluded gives way to the nearest trunk node above it, the root apart."""
    gone = ends.join(nodes.where("node_type = 'conclusion'").select("node_id"), "node_id", "left_semi")
    open_ = forest.nearest(nodes.select("node_id", "parent_id"), nodes.where("node_type = 'trunk'").select("node_id"))
    moved = gone.join(open_, "node_id", "left").select("conv_id", F.col("ancestor_id").alias("trunk_id"))
    return ends.join(gone, "node_id", "left_anti").select("conv_id", F.col("node_id").alias("trunk_id")).union(moved)


def merge(nodes: DataFrame, insights: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (node_id, target): the branch points to a trunk node, which takes its conclusions at 0.9 of their confidence."""
    trunk = nodes.where("node_type = 'trunk'").select(F.col("node_id").alias("target"))
    label = F.coalesce("branch_label", F.lit("None"))
    asked = requests.join(trunk, "target", "left_semi").join(nodes.select("node_id", label.alias("label")), "node_id")
    out = nodes.join(asked.select("node_id", "target"), "node_id", "left").withColumn("merge_target", F.coalesce("target", "merge_target")).drop("target")
    taken = insights.join(asked, "node_id").select(F.col("target").alias("node_id"), F.concat(F.lit("[merged from "), "label", F.lit("] "), "text").alias("text"), (F.col("confidence") * 0.9).alias("confidence"), F.concat("source_ids", F.array("node_id")).alias("source_ids"))
    return out, insights.unionByName(taken)


def unmerge(nodes: DataFrame, insights: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (node_id): the branch points nowhere, and its target loses the conclusions that came from it."""
    asked = nodes.where("merge_target IS NOT NULL").join(requests, "node_id", "left_semi").select(F.col("node_id").alias("_branch"), F.col("merge_target").alias("node_id"))
    left = insights.withColumn("_branch", F.explode("source_ids")).join(asked, ["node_id", "_branch"], "left_semi").select("node_id", "text", "confidence", "source_ids").distinct()
    out = nodes.join(asked.select(F.col("_branch").alias("node_id"), F.lit(True).alias("_m")), "node_id", "left").withColumn("merge_target", F.when(F.col("_m").isNull(), F.col("merge_target"))).drop("_m")
    return out, insights.join(left, ["node_id", "text", "confidence", "source_ids"], "left_anti")


def abandon(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (node_id): the whole subtree of each is no longer valid; no node goes."""
    below = forest.nearest(nodes.select("node_id", "parent_id"), requests).select("node_id", F.lit(False).alias("_v"))
    return nodes.join(below, "node_id", "left").withColumn("is_valid", F.coalesce("_v", "is_valid")).drop("_v")


def set_trunk(nodes: DataFrame, ends: DataFrame, requests: DataFrame, cascade: bool = False) -> tuple[DataFrame, DataFrame]:
    """requests (node_id): the node becomes the end of its conversation's trunk, ends (conv_id, node_id); with `cascade` its path becomes trunk. Abandoned nodes are refused; roots keep their kind."""
    asked = nodes.join(requests, "node_id", "left_semi").where("is_valid").select("conv_id", "node_id")
    mark = asked.select("node_id")
    if cascade:
        mark = forest.ancestors(nodes.select("node_id", "parent_id"), mark).select(F.col("ancestor_id").alias("node_id"))
    out = nodes.join(mark.distinct().withColumn("_m", F.lit(True)), "node_id", "left")
    out = out.withColumn("node_type", F.when(F.col("_m") & F.col("parent_id").isNotNull(), "trunk").otherwise(F.col("node_type"))).drop("_m")
    return out, ends.join(asked.select("conv_id"), "conv_id", "left_anti").unionByName(asked)


def valid(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """(node_id, valid): a node counts if its way, over merge targets and else parents, comes to a trunk node or trunk end before an abandoned one; a cycle does not."""
    end = ends.select("node_id", F.lit(True).alias("_end")).distinct()
    good = (F.col("node_type") == "trunk") & F.col("parent_id").isNotNull() | F.col("_end").isNotNull()
    known = nodes.select(F.col("node_id").alias("_next"), F.lit(True).alias("_known"))
    way = nodes.join(end, "node_id", "left").select("node_id", F.coalesce("merge_target", "parent_id").alias("_next"), "is_valid", (F.col("is_valid") & good).alias("good"))
    way = way.join(known, "_next", "left").select("node_id", F.when(F.col("_known"), F.col("_next")).alias("parent_id"), "is_valid", "good")
    first = forest.nearest(way.select("node_id", "parent_id"), way.where("good OR NOT is_valid").select("node_id"), cycles=True)
    hit = first.join(way.where("good").select(F.col("node_id").alias("ancestor_id")), "ancestor_id", "left_semi").select("node_id", F.lit(True).alias("_ok"))
    return nodes.select("node_id").join(hit, "node_id", "left").select("node_id", F.coalesce("_ok", F.lit(False)).alias("valid"))


def prune(nodes: DataFrame, insights: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (node_id): their subtrees go, roots are refused; what points to them no longer does, and conclusions that were merged from them go."""
    asked = requests.join(nodes.where("parent_id IS NOT NULL").select("node_id"), "node_id", "left_semi")
    gone = forest.nearest(nodes.select("node_id", "parent_id"), asked).select("node_id")
    out = nodes.join(gone, "node_id", "left_anti").join(gone.select(F.col("node_id").alias("merge_target"), F.lit(True).alias("_g")), "merge_target", "left")
    out = out.withColumn("merge_target", F.when(F.col("_g").isNull(), F.col("merge_target"))).select(*nodes.columns)
    lost = insights.where(F.startswith("text", F.lit("[merged from"))).withColumn("_s", F.explode("source_ids")).join(gone.select(F.col("node_id").alias("_s")), "_s", "left_semi").drop("_s").distinct()
    return out, insights.join(gone, "node_id", "left_anti").join(lost, insights.columns, "left_anti")
