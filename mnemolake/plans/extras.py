"""Sinks that write documents, remaining scopes of retrieval, joins, sets and tree edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import search, tree_edits
from ..sources.scratch import cut
from .aggregates import PROFILE, agg_profile
from .catalog import query
from .retrieval import _GRAPH, BM25, FUSED, _found, graph_queries, graph_rows, kept_index, text_index
from .trees import _DUCK_ANC, _MERGED, _SN, TREE_SCOPED, _insights, _merged, tree_scoped


@query("sink_episodic", "SELECT id, summary, round(importance, 9) AS importance FROM eg_episodic WHERE id % 3 <> 0 UNION ALL SELECT o_orderkey, concat('order ', CAST(o_orderkey AS VARCHAR)), round(least(1.0, o_totalprice / 500000), 9) FROM orders WHERE o_orderkey NOT IN (SELECT id FROM eg_episodic WHERE id % 3 <> 0)")
def sink_episodic(t):
    """Every order is offered to a store that lacks a third of them."""
    return inserted(t["eg_episodic"].where("id % 3 <> 0"), t["orders"])


def inserted(episodic, orders):
    """INSERT OR IGNORE: new ids only."""
    new = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("summary"), F.round(F.least(F.lit(1.0), F.col("o_totalprice") / 500000), 9).alias("importance"))
    old = episodic.select("id", "summary", F.round("importance", 9).alias("importance"))
    return old.union(new.join(old, "id", "left_anti"))


@query("sink_tree", """SELECT conv_id, CAST(len(list(node_id)) AS INT) AS nodes, string_agg(concat('{"id":', CAST(node_id AS VARCHAR), CASE WHEN parent_id IS NULL THEN '' ELSE concat(',"parent":', CAST(parent_id AS VARCHAR)) END, '}'), ',' ORDER BY node_id) AS topology FROM turns GROUP BY conv_id""")
def sink_tree(t):
    """Topology of each tree as JSON, apart from the content."""
    node = F.to_json(F.struct(F.col("node_id").alias("id"), F.col("parent_id").alias("parent")))
    rows = F.array_sort(F.collect_list(F.struct("node_id", node.alias("j"))))
    return t["turns"].groupBy("conv_id").agg(rows.alias("r")).select("conv_id", F.size("r").alias("nodes"), F.array_join(F.transform("r", lambda x: x["j"]), ",").alias("topology"))


@query("sink_graph_json", """SELECT concat('{"id":"mem_', CAST(id AS VARCHAR), '","type":"', type, '"}') AS line FROM memory UNION ALL SELECT concat('{"source":"', CAST(source AS VARCHAR), '","target":"', CAST(target AS VARCHAR), '","relation":"', relation, '"}') FROM project_edges""")
def sink_graph_json(t):
    """Node and link lines of the export: one line a row, so a file of any size is written by many tasks."""
    nodes = t["memory"].select(F.to_json(F.struct(F.concat(F.lit("mem_"), F.col("id").cast("string")).alias("id"), "type")).alias("line"))
    return nodes.union(t["project_edges"].select(F.to_json(F.struct(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "relation"))))


@query("sink_profile", PROFILE + """ SELECT string_agg(concat('{"category":"', category, '","id":', CAST(id AS VARCHAR), ',"observations":', CAST(observations AS VARCHAR), '}'), ',' ORDER BY category, rn) AS profile, CAST(count(*) AS BIGINT) AS traits FROM pf""")
def sink_profile(t):
    """The profile as one JSON row: a few traits of each category, so one row is enough."""
    line = F.to_json(F.struct("category", "id", "observations"))
    rows = agg_profile(t).groupBy().agg(F.array_sort(F.collect_list(F.struct("category", "rn", line.alias("j")))).alias("r"))
    return rows.select(F.array_join(F.transform("r", lambda x: x["j"]), ",").alias("profile"), F.size("r").cast("long").alias("traits"))


@query("sink_summary", "SELECT conv_id, CAST(max(turn) AS BIGINT) AS up_to, substr(max_by(text, turn), 1, 80) AS summary FROM conversations GROUP BY conv_id")
def sink_summary(t):
    return t["conversations"].groupBy("conv_id").agg(F.max("turn").alias("up_to"), F.substring(F.max_by("text", "turn"), 1, 80).alias("summary"))


@query("join_fts", f"WITH {BM25} SELECT ft.query_id, m.id, m.type, m.weight FROM ft JOIN memory m ON m.id = ft.id WHERE m.weight >= 0.3")
def join_fts(t):
    return search.fts(t["memory"], t["queries_fts"], 10, index=text_index(t)).join(t["memory"].where("weight >= 0.3").select("id", "type", "weight"), "id").select("query_id", "id", "type", "weight")


@query("join_cross_memory_node", "SELECT t.node_id, m.id AS memory_id FROM turns t JOIN memory m ON m.id = t.node_id")
def join_cross_memory_node(t):
    return t["turns"].join(t["memory"].select("id"), F.col("node_id") == F.col("id")).select("node_id", F.col("id").alias("memory_id"))


@query("range_join", "SELECT e.event_id, m.id FROM events e JOIN memory m ON e.value BETWEEN 100 * m.weight - 0.01 AND 100 * m.weight + 0.01")
def range_join(t):
    """Every event with every memory of that value."""
    return near_values(t["events"], t["memory"])


def near_values(events, memory):
    """Intervals dealt into unit buckets, so the join is an equi-join with a filter."""
    m = memory.select("id", (100 * F.col("weight") - 0.01).alias("lo"), (100 * F.col("weight") + 0.01).alias("hi"))
    m = m.withColumn("b", F.explode(F.sequence(F.floor("lo"), F.floor("hi"))))
    return events.select("event_id", "value", F.floor("value").alias("b")).join(m, "b").where(F.col("value").between(F.col("lo"), F.col("hi"))).select("event_id", "id")


@query("agg_sets", "SELECT type, character, CAST(count(*) AS BIGINT) AS n FROM memory GROUP BY CUBE (type, character)")
def agg_sets(t):
    return t["memory"].cube("type", "character").agg(F.count(F.lit(1)).alias("n"))


@query("array_map", "SELECT id, array_to_string(list_sort(list_distinct(string_split(tags, ','))), '|') AS tags, CAST(len(string_split(tags, ',')) AS INT) AS n FROM memory")
def array_map(t):
    tags = F.split("tags", ",")
    return t["memory"].select("id", F.array_join(F.array_sort(F.array_distinct(tags)), "|").alias("tags"), F.size(tags).alias("n"))


#: Patterns of rule extraction and the kind of fact each one finds, in the first 300 characters.
RULES = [
    (r"(?:我(?:是|叫|来自|住在|在.{0,20}工作))", "identity"),
    (r"(?:我的(?:名字|职业|身份|家乡)是)", "identity"),
    (r"(?:我(?:喜欢|偏好|习惯|通常|总是))", "preference"),
    (r"(?:我(?:不吃|不喜欢|讨厌|从不))", "avoidance"),
    (r"(?:哥哥(?:是|的|说|叫))", "relation"),
]
#: Words of the given prose and what stands for them in the test of the rules, the same in both engines.
_SAYS = {" the ": "我喜欢", " and ": "我是", " of ": "哥哥说", " in ": "我从不", " to ": "我的名字是"}


def rule_matches(text):
    """All matches of all rules, in the order of the rules: array of (type, statement)."""
    named = lambda kind: lambda m: F.struct(F.lit(kind).alias("type"), m.alias("statement"))
    return F.flatten(F.array(*(F.transform(F.regexp_extract_all(F.substring(text, 1, 300), F.lit(p), F.lit(0)), named(kind)) for p, kind in RULES)))


def _said(sql: str) -> str:
    for word, says in _SAYS.items():
        sql = f"replace({sql}, '{word}', '{says}')"
    return sql


@query("str_rule_extract", "SELECT id, type, statement, CAST(0.5 AS DOUBLE) AS weight FROM (" + " UNION ALL ".join(f"SELECT id, '{k}' AS type, unnest(regexp_extract_all(substr({_said('content')}, 1, 300), '{p}')) AS statement FROM memory" for p, k in RULES) + ")")
def str_rule_extract(t):
    """Every match of every rule in one pass."""
    said = F.expr(_said("content"))
    return t["memory"].select("id", F.explode(rule_matches(said)).alias("x")).select("id", "x.type", "x.statement", F.lit(0.5).alias("weight"))


@query("tree_fork", f"""WITH RECURSIVE {_DUCK_ANC}, {_SN}, dp AS (SELECT node_id, max(dist) AS depth FROM anc GROUP BY node_id)
 SELECT sn.node_id, parent_id, branch_label, node_type, CAST(depth AS INT) AS depth FROM sn JOIN dp USING (node_id) UNION ALL SELECT 10000000 + sn.node_id, sn.node_id, 'fork', 'branch', CAST(depth + 1 AS INT) FROM sn JOIN dp USING (node_id) WHERE turn = 1""")
def tree_fork(t):
    """The next snapshot: a branch forked from the second turn of every conversation."""
    asked = t["turns"].where("turn = 1").select((F.col("node_id") + 10_000_000).alias("node_id"), F.col("node_id").alias("at"), F.lit("fork").alias("label"))
    return tree_edits.fork(tree_edits.snapshot(t["turns"]), asked).select("node_id", "parent_id", "branch_label", "node_type", "depth")


@query("tree_unmerge", f"WITH {_MERGED} SELECT * FROM i0 UNION ALL SELECT target, concat('[merged from ', branch_label, '] ', text), CAST(0.72 AS DOUBLE), concat(sources, ',', CAST(mg.node_id AS VARCHAR)) FROM mg JOIN i0 ON i0.node_id = mg.node_id WHERE mg.node_id % 2 = 1")
def tree_unmerge(t):
    """The conclusions after the merges of even nodes are taken back."""
    nodes, insights = _merged(t)
    return _insights(tree_edits.unmerge(nodes, insights, t["turns"].where("node_id % 2 = 0").select("node_id"))[1])


@query("tree_abandon", f"WITH RECURSIVE {_DUCK_ANC} SELECT t.node_id, t.node_id NOT IN (SELECT a.node_id FROM anc a WHERE a.ancestor_id % 100 = 2) AS is_valid FROM turns t")
def tree_abandon(t):
    """The next snapshot after the third turn of every conversation is abandoned."""
    return tree_edits.abandon(tree_edits.snapshot(t["turns"]), t["turns"].where("turn = 2").select("node_id")).select("node_id", "is_valid")


_LIVE = "(valid_to IS NULL OR valid_to > 1735689600)"


@query("unified_semantic", f"WITH {FUSED} SELECT query_id, id, round(score, 6) AS score FROM rk WHERE {_LIVE}")
def unified_semantic(t):
    live = t["memory"].where(_LIVE).select("id")
    return search.retrieve(_found(t)).join(live, "id", "left_semi").select("query_id", "id", F.round("score", 6).alias("score"))


@query("unified_graph", f"""WITH {_GRAPH}, {FUSED.replace("queries_fts", "queries_graph")}, gl AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM gr)
 SELECT query_id, id, round(score, 6) AS score, 'graph' AS scope FROM gl WHERE r <= 5 UNION ALL SELECT query_id, id, round(score, 6), 'semantic' FROM rk WHERE {_LIVE} AND query_id NOT IN (SELECT query_id FROM gl)""")
def unified_graph(t):
    """What the entities of a query activate and the notes that hold it, with their neighbours over typed edges; a query that the graph knows nothing of is searched by meaning."""
    q, live = graph_queries(t), t["memory"].where(_LIVE).select("id")
    found = cut(search.ranked(graph_rows(t, q), [F.desc("score"), F.col("id")], 5).select("query_id", "id", F.round("score", 6).alias("score"), F.lit("graph").alias("scope")))
    rest = cut(q.join(found.select("query_id").distinct(), "query_id", "left_anti"))
    other = search.retrieve(_found(t, queries=rest, index=kept_index)).join(live, "id", "left_semi")
    return found.union(other.select("query_id", "id", F.round("score", 6), F.lit("semantic")))


@query("unified_tree", f"SELECT query_id, id, tree_score FROM ({TREE_SCOPED})")
def unified_tree(t):
    """The tree's scope in the shape of the others."""
    return tree_scoped(t).select("query_id", "id", "tree_score")


@query("fusion_score", f"WITH {FUSED} SELECT query_id, id, round(score, 6) AS score FROM sc")
def fusion_score(t):
    return _found(t).select("query_id", "id", F.round("score", 6).alias("score"))


@query("scan_bridge", f"WITH {FUSED} SELECT CAST(place AS INT) AS rank, rk.id, round(rk.score, 6) AS score, m.content FROM rk LEFT JOIN memory m ON m.id = rk.id WHERE query_id = 4")
def scan_bridge(t):
    """What the command-line bridge answers to a search: the fused one, here with the words and the vector of query 4 and its three days."""
    from ..bridge import found
    from ..schema import NOW

    q = t["queries_fts"].where("query_id = 4").first()
    v = t["embeddings"].where("vec_id = 4").first()
    return found(t, {"query": q["q"], "vector": v["embedding"], "since": NOW - 86400 * 3, "until": NOW, "top_k": 5}).select("rank", "id", F.round("score", 6).alias("score"), "content")


@query("last_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2")
def last_turns(t):
    return t["conversations"].withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("r <= 2").select("conv_id", "turn", "role")
