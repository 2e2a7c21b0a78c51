"""Conversation trees: paths and inheritance by pointer jumping over written tables (operators/forest.py)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import forest, search, tree_edits
from ..operators.search import ranked
from ..sources.scratch import cut
from .catalog import query
from .retrieval import BM25, FUSED, _found, deeper

#: (node, ancestor, distance) of every node, itself included, as the oracle has it.
_ANC = """anc(node_id, ancestor_id, dist) AS (SELECT node_id, node_id, 0 FROM {turns} UNION ALL SELECT a.node_id, t.parent_id, a.dist + 1 FROM anc a JOIN {turns} t ON t.node_id = a.ancestor_id WHERE t.parent_id IS NOT NULL)"""
_DUCK_ANC = _ANC.replace("{turns}", "turns")


def ancestors(t, of=None, within=None):
    return forest.ancestors(t["turns"].select("node_id", "parent_id"), of, within)


def below(t, marked):
    """(node_id, ancestor_id, dist): the nearest marked node on each node's path, where there is one."""
    return forest.nearest(t["turns"].select("node_id", "parent_id"), marked)


def trunk(t):
    """Nodes on the path to the last node of each conversation without a branch label on it."""
    end = t["turns"].groupBy("conv_id").agg(F.max_by("node_id", F.struct((F.col("turn") % 3 != 2).cast("int"), "turn")).alias("node_id"))
    return ancestors(t, end).select(F.col("ancestor_id").alias("node_id"))


_TRUNK = "te AS (SELECT node_id FROM (SELECT node_id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 3 <> 2 THEN 1 ELSE 0 END DESC, turn DESC) AS r FROM turns) WHERE r = 1), tp AS (SELECT ancestor_id AS node_id FROM anc WHERE node_id IN (SELECT node_id FROM te))"
_HEADS = "kd AS (SELECT parent_id, count(*) AS n FROM turns WHERE parent_id IS NOT NULL GROUP BY parent_id), hd AS (SELECT t.node_id FROM turns t LEFT JOIN kd ON kd.parent_id = t.parent_id WHERE t.parent_id IS NULL OR (n >= 2 AND t.node_id NOT IN (SELECT node_id FROM tp)))"


@query("tree_path", f"WITH RECURSIVE {_DUCK_ANC} SELECT node_id, ancestor_id, CAST(dist AS INT) AS dist FROM anc")
def tree_path(t):
    return ancestors(t)


@query("tree_context", f"WITH RECURSIVE {_DUCK_ANC} SELECT a.node_id, string_agg(concat(t.role, ': ', t.text), chr(10) ORDER BY a.dist DESC) AS context FROM anc a JOIN turns t ON t.node_id = a.ancestor_id GROUP BY a.node_id")
def tree_context(t):
    """The whole messages from the root to the node; a path bounds the group."""
    line = F.concat("role", F.lit(": "), "text")
    c = ancestors(t).join(t["turns"].select(F.col("node_id").alias("ancestor_id"), line.alias("line")), "ancestor_id")
    return c.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "line"))), lambda s: s["line"]), "\n").alias("context"))


@query("tree_compress", f"""WITH RECURSIVE {_DUCK_ANC}, x AS (SELECT node_id, ancestor_id, row_number() OVER (PARTITION BY node_id ORDER BY dist DESC) AS r, count(*) OVER (PARTITION BY node_id) AS n FROM anc) SELECT node_id, ancestor_id, CASE WHEN r <= 2 OR r > n - 3 THEN 'whole' ELSE 'summary' END AS kept FROM x""")
def tree_compress(t):
    """Two at the head and three at the tail stay whole."""
    w = Window.partitionBy("node_id")
    x = ancestors(t).withColumn("r", F.row_number().over(w.orderBy(F.desc("dist")))).withColumn("n", F.count(F.lit(1)).over(w))
    return x.select("node_id", "ancestor_id", F.when((F.col("r") <= 2) | (F.col("r") > F.col("n") - 3), "whole").otherwise("summary").alias("kept"))


@query("tree_subtree", f"WITH RECURSIVE {_DUCK_ANC} SELECT ancestor_id AS node_id, CAST(count(*) AS BIGINT) AS size, CAST(max(dist) AS INT) AS height FROM anc GROUP BY ancestor_id")
def tree_subtree(t):
    return ancestors(t).groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count(F.lit(1)).alias("size"), F.max("dist").alias("height"))


@query("tree_siblings", "SELECT a.node_id, b.node_id AS sibling FROM turns a JOIN turns b ON a.parent_id = b.parent_id AND a.node_id <> b.node_id")
def tree_siblings(t):
    b = t["turns"].select("parent_id", F.col("node_id").alias("sibling"))
    return t["turns"].join(b, "parent_id").where("node_id <> sibling").select("node_id", "sibling")


@query("tree_add", "SELECT node_id, CASE WHEN branch_label IS NOT NULL THEN 'branch' WHEN parent_id IS NULL THEN 'root' WHEN row_number() OVER (PARTITION BY parent_id ORDER BY node_id) = 1 THEN 'trunk' ELSE 'branch' END AS node_type FROM turns")
def tree_add(t):
    """A forced label makes a branch; else the first child goes on with its parent."""
    first = F.row_number().over(Window.partitionBy("parent_id").orderBy("node_id")) == 1
    return t["turns"].select("node_id", F.when(F.col("branch_label").isNotNull(), "branch").when(F.col("parent_id").isNull(), "root").when(first, "trunk").otherwise("branch").alias("node_type"))


#: The tree of each conversation as nodes with their kind, as the oracle has it.
_SN = "sn AS (SELECT t.node_id, t.parent_id, t.conv_id, t.turn, t.text, t.branch_label, CASE WHEN t.parent_id IS NULL THEN 'root' WHEN t.branch_label IS NOT NULL THEN 'branch' ELSE 'trunk' END AS node_type FROM turns t)"
_ENDS = "en AS (SELECT conv_id, node_id FROM (SELECT conv_id, node_id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 3 <> 2 THEN 1 ELSE 0 END DESC, turn DESC) AS r FROM turns) WHERE r = 1)"


def _no_insights(t):
    return t["turns"].sparkSession.createDataFrame([], "node_id long, text string, confidence double, source_ids array<bigint>")


def _concluded(t, nodes):
    """Every branch node concludes with the front of its own text."""
    asked = t["turns"].where("branch_label IS NOT NULL").select("node_id", F.substring("text", 1, 60).alias("text"))
    return tree_edits.conclude(nodes, _no_insights(t), asked)


def _merged(t):
    """Every concluded branch is merged into its parent where that is trunk."""
    nodes, insights = _concluded(t, cut(tree_edits.snapshot(t["turns"])))
    asked = t["turns"].where("branch_label IS NOT NULL AND parent_id IS NOT NULL").select("node_id", F.col("parent_id").alias("target"))
    return tree_edits.merge(nodes, insights, asked)


def _insights(insights):
    return insights.select("node_id", "text", F.round("confidence", 6).alias("confidence"), F.array_join(F.transform("source_ids", lambda x: x.cast("string")), ",").alias("sources"))


@query("tree_conclude", f"""WITH RECURSIVE {_DUCK_ANC}, {_SN}, {_ENDS}, cq AS (SELECT node_id FROM turns WHERE turn IN (3, 4)),
 tk AS (SELECT en.conv_id, CASE WHEN en.node_id IN (SELECT node_id FROM cq) THEN (SELECT min_by(a.ancestor_id, a.dist) FROM anc a JOIN sn ON sn.node_id = a.ancestor_id WHERE a.node_id = en.node_id AND sn.node_type = 'trunk' AND a.ancestor_id NOT IN (SELECT node_id FROM cq)) ELSE en.node_id END AS trunk_id FROM en)
 SELECT sn.node_id, CASE WHEN cq.node_id IS NOT NULL THEN 'conclusion' ELSE node_type END AS node_type, CASE WHEN cq.node_id IS NOT NULL THEN substr(text, 1, 40) END AS conclusion, tk.trunk_id IS NOT NULL AND tk.trunk_id = sn.node_id AS trunk_end FROM sn LEFT JOIN cq ON cq.node_id = sn.node_id LEFT JOIN tk ON tk.conv_id = sn.conv_id""")
def tree_conclude(t):
    """The next snapshot after the fourth and fifth turns are concluded, with the end that each conversation's trunk then has."""
    asked = t["turns"].where("turn IN (3, 4)").select("node_id", F.substring("text", 1, 40).alias("text"))
    nodes, insights = tree_edits.conclude(tree_edits.snapshot(t["turns"]), _no_insights(t), asked)
    nodes = cut(nodes)
    ends = t["turns"].groupBy("conv_id").agg(F.max_by("node_id", F.struct((F.col("turn") % 3 != 2).cast("int"), "turn")).alias("node_id"))
    end = tree_edits.trunk_ends(nodes, ends).where("trunk_id IS NOT NULL").select(F.col("trunk_id").alias("node_id"), F.lit(True).alias("e"))
    out = nodes.join(insights.select("node_id", F.col("text").alias("conclusion")), "node_id", "left").join(end, "node_id", "left")
    return out.select("node_id", "node_type", "conclusion", F.coalesce("e", F.lit(False)).alias("trunk_end"))


_MERGED = f"""{_SN}, i0 AS (SELECT node_id, substr(text, 1, 60) AS text, CAST(0.8 AS DOUBLE) AS confidence, CAST(node_id AS VARCHAR) AS sources FROM sn WHERE branch_label IS NOT NULL),
 mg AS (SELECT b.node_id, b.parent_id AS target, b.branch_label FROM sn b JOIN sn p ON p.node_id = b.parent_id WHERE b.branch_label IS NOT NULL AND p.node_type = 'trunk')"""


@query("tree_merge", f"WITH {_MERGED} SELECT * FROM i0 UNION ALL SELECT target, concat('[merged from ', branch_label, '] ', text), CAST(0.72 AS DOUBLE), concat(sources, ',', CAST(mg.node_id AS VARCHAR)) FROM mg JOIN i0 ON i0.node_id = mg.node_id")
def tree_merge(t):
    """The conclusions of all nodes after the merges."""
    return _insights(_merged(t)[1])


def _ends(t):
    """The end of each conversation's trunk: (conv_id, node_id)."""
    return t["turns"].groupBy("conv_id").agg(F.max_by("node_id", F.struct((F.col("turn") % 3 != 2).cast("int"), "turn")).alias("node_id"))


def _edited(t):
    """After the merges, with the subtrees of sixth turns abandoned: nodes and conclusions."""
    nodes, insights = _merged(t)
    return cut(tree_edits.abandon(nodes, t["turns"].where("turn = 5").select("node_id"))), cut(insights)


_BAD = "bd AS (SELECT DISTINCT a.node_id FROM anc a JOIN turns t ON t.node_id = a.ancestor_id WHERE t.turn = 5)"
_VALID = f"""{_ENDS}, {_BAD}, gd AS (SELECT node_id FROM sn WHERE (node_type = 'trunk' OR node_id IN (SELECT node_id FROM en)) AND node_id NOT IN (SELECT node_id FROM bd)), nx AS (SELECT sn.node_id, coalesce(mg.target, sn.parent_id) AS nxt FROM sn LEFT JOIN mg ON mg.node_id = sn.node_id),
 wk(node_id, place) AS (SELECT node_id, node_id FROM sn UNION ALL SELECT wk.node_id, nx.nxt FROM wk JOIN nx ON nx.node_id = wk.place WHERE nxt IS NOT NULL AND wk.place NOT IN (SELECT node_id FROM bd) AND wk.place NOT IN (SELECT node_id FROM gd)),
 vd AS (SELECT sn.node_id, sn.node_id IN (SELECT wk.node_id FROM wk JOIN gd ON gd.node_id = wk.place) AS valid FROM sn)"""


@query("tree_valid", f"WITH RECURSIVE {_DUCK_ANC}, {_MERGED}, {_VALID} SELECT node_id, valid FROM vd")
def tree_valid(t):
    """Whether each node's way leads to the trunk, over the branches that it was merged into, before it comes to an abandoned one."""
    return tree_edits.valid(_edited(t)[0], _ends(t))


@query("tree_context_v2", f"""WITH RECURSIVE {_DUCK_ANC}, {_MERGED}, {_BAD}, dp AS (SELECT node_id, max(dist) AS depth FROM anc GROUP BY node_id),
 ms AS (SELECT node_id, string_agg(concat(role, ': ', text), chr(10) ORDER BY dist DESC) AS messages FROM (SELECT a.node_id, a.dist, t.role, t.text, row_number() OVER (PARTITION BY a.node_id ORDER BY a.dist) AS r FROM anc a JOIN turns t ON t.node_id = a.ancestor_id) WHERE r <= 50 GROUP BY node_id),
 ci AS (SELECT node_id, text, 0 AS o, node_id AS b FROM i0 UNION ALL SELECT target, concat('[merged from ', branch_label, '] ', text), 1, mg.node_id FROM mg JOIN i0 ON i0.node_id = mg.node_id),
 cn AS (SELECT node_id, string_agg(substr(text, 1, 40), '; ' ORDER BY o, b) AS c FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY o, b) AS r FROM ci) WHERE r <= 2 GROUP BY node_id),
 en2 AS (SELECT b.node_id, b.parent_id, dp.depth, concat('[', coalesce(b.branch_label, 'branch'), ']: ', substr(b.text, 1, 60), CASE WHEN c IS NOT NULL THEN concat(' | conclusions: ', c) ELSE '' END) AS entry FROM sn b JOIN dp USING (node_id) LEFT JOIN cn ON cn.node_id = b.node_id WHERE b.node_id NOT IN (SELECT node_id FROM bd)),
 sb AS (SELECT a.node_id, string_agg(concat('depth ', CAST(e.depth AS VARCHAR), ': ', e.entry), chr(10) ORDER BY e.depth, e.node_id) AS siblings FROM anc a JOIN turns t ON t.node_id = a.ancestor_id JOIN en2 e ON e.parent_id = t.parent_id AND e.node_id <> t.node_id GROUP BY a.node_id),
 mr AS (SELECT a.node_id, string_agg(concat('[merged:', mg.branch_label, '] ', i0.text), chr(10) ORDER BY a.dist DESC, mg.node_id) AS merged FROM anc a JOIN mg ON mg.target = a.ancestor_id JOIN i0 ON i0.node_id = mg.node_id WHERE mg.node_id NOT IN (SELECT node_id FROM bd) GROUP BY a.node_id)
 SELECT ms.node_id, messages, coalesce(siblings, '') AS siblings, coalesce(merged, '') AS merged FROM ms LEFT JOIN sb USING (node_id) LEFT JOIN mr USING (node_id)""")
def tree_context_v2(t):
    """For each node the last 50 messages of its path, its valid siblings at each depth with their conclusions, and the conclusions of the valid branches merged into its path."""
    nodes, insights = _edited(t)
    path, turns = cut(ancestors(t)), t["turns"].select("node_id", "role", "text")
    joined = lambda c, order, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(c).alias("_s")))), lambda x: x["_s"]), sep)
    far = (-F.col("dist")).alias("far")
    said = path.where("dist < 50").join(turns.select(F.col("node_id").alias("ancestor_id"), F.concat("role", F.lit(": "), "text").alias("line")), "ancestor_id").groupBy("node_id").agg(joined("line", [far], "\n").alias("messages"))
    two = F.slice(F.array_sort(F.collect_list(F.struct(F.size("source_ids").alias("o"), F.element_at("source_ids", -1).alias("b"), F.substring("text", 1, 40).alias("s")))), 1, 2)
    held = insights.groupBy("node_id").agg(F.array_join(F.transform(two, lambda x: x["s"]), "; ").alias("c"))  # a node's own conclusion first
    live = nodes.where("is_valid").join(turns, "node_id").join(held, "node_id", "left")
    entry = F.concat(F.lit("depth "), F.col("depth").cast("string"), F.lit(": ["), F.coalesce("branch_label", F.lit("branch")), F.lit("]: "), F.substring("text", 1, 60), F.coalesce(F.concat(F.lit(" | conclusions: "), "c"), F.lit("")))
    beside = live.where("parent_id IS NOT NULL").select(F.col("node_id").alias("sibling"), "parent_id", "depth", entry.alias("entry"))
    on = path.select("node_id", "ancestor_id").join(nodes.select(F.col("node_id").alias("ancestor_id"), "parent_id"), "ancestor_id").join(beside, "parent_id").where("sibling <> ancestor_id")
    siblings = on.groupBy("node_id").agg(joined("entry", ["depth", "sibling"], "\n").alias("siblings"))
    gave = nodes.where("is_valid AND merge_target IS NOT NULL").select("node_id", F.col("merge_target").alias("ancestor_id"), "branch_label")
    gave = gave.join(insights.where(~F.startswith("text", F.lit("[merged from"))).select("node_id", "text"), "node_id").select("ancestor_id", F.col("node_id").alias("branch"), F.concat(F.lit("[merged:"), "branch_label", F.lit("] "), "text").alias("line"))
    merged = path.join(gave, "ancestor_id").groupBy("node_id").agg(joined("line", [far, "branch"], "\n").alias("merged"))
    out = said.join(siblings, "node_id", "left").join(merged, "node_id", "left")
    return out.select("node_id", "messages", F.coalesce("siblings", F.lit("")).alias("siblings"), F.coalesce("merged", F.lit("")).alias("merged"))


@query("tree_trunk", f"""WITH RECURSIVE {_DUCK_ANC}, {_SN}, {_ENDS}, rq AS (SELECT node_id, conv_id FROM turns WHERE turn = 2), ch AS (SELECT DISTINCT a.ancestor_id AS node_id FROM anc a JOIN rq USING (node_id)),
 e2 AS (SELECT node_id FROM rq UNION ALL SELECT node_id FROM en WHERE conv_id NOT IN (SELECT conv_id FROM rq))
 SELECT node_id, CASE WHEN parent_id IS NOT NULL AND node_id IN (SELECT node_id FROM ch) THEN 'trunk' ELSE node_type END AS node_type, node_id IN (SELECT node_id FROM e2) AS trunk_end FROM sn""")
def tree_trunk(t):
    """The next snapshot after the third turn of every conversation is made the end of its trunk, its path with it."""
    nodes, ends = tree_edits.set_trunk(cut(tree_edits.snapshot(t["turns"])), _ends(t), t["turns"].where("turn = 2").select("node_id"), cascade=True)
    return nodes.join(ends.select("node_id", F.lit(True).alias("e")), "node_id", "left").select("node_id", "node_type", F.coalesce("e", F.lit(False)).alias("trunk_end"))


@query("tree_prune", f"""WITH RECURSIVE {_DUCK_ANC}, {_MERGED}, gn AS (SELECT DISTINCT a.node_id FROM anc a JOIN turns t ON t.node_id = a.ancestor_id WHERE t.turn = 2),
 ins AS (SELECT node_id FROM i0 UNION ALL SELECT target FROM mg JOIN i0 ON i0.node_id = mg.node_id WHERE mg.node_id NOT IN (SELECT node_id FROM gn))
 SELECT sn.node_id, CASE WHEN mg.target NOT IN (SELECT node_id FROM gn) THEN mg.target END AS merge_target, (SELECT count(*) FROM ins WHERE ins.node_id = sn.node_id) AS conclusions FROM sn LEFT JOIN mg ON mg.node_id = sn.node_id WHERE sn.node_id NOT IN (SELECT node_id FROM gn)""")
def tree_prune(t):
    """The snapshot after the subtrees of third turns are cut off, with what still points somewhere and how many conclusions are left."""
    nodes, insights = tree_edits.prune(*_merged(t), t["turns"].where("turn = 2").select("node_id"))
    n = insights.groupBy("node_id").agg(F.count(F.lit(1)).alias("conclusions"))
    return nodes.join(n, "node_id", "left").select("node_id", "merge_target", F.coalesce("conclusions", F.lit(0)).alias("conclusions"))


@query("tree_delete_node", f"WITH RECURSIVE {_DUCK_ANC}, g AS (SELECT node_id, parent_id FROM turns WHERE turn = 1), n AS (SELECT t.node_id, coalesce(g.parent_id, t.parent_id) AS parent_id FROM turns t LEFT JOIN g ON g.node_id = t.parent_id WHERE t.turn <> 1), d AS (SELECT a.node_id, count(*) - 1 AS depth FROM anc a JOIN turns t ON t.node_id = a.ancestor_id WHERE t.turn <> 1 GROUP BY a.node_id) SELECT n.node_id, n.parent_id, CAST(depth AS BIGINT) AS depth FROM n JOIN d USING (node_id)")
def tree_delete_node(t):
    """Children move to the grandparent; depth is the new path's length."""
    x = t["turns"]
    gone = x.where("turn = 1").select(F.col("node_id").alias("parent_id"), F.col("parent_id").alias("up"))
    moved = x.where("turn <> 1").join(gone, "parent_id", "left").select("node_id", F.coalesce("up", "parent_id").alias("parent_id"))
    depth = ancestors(t).join(x.where("turn <> 1").select(F.col("node_id").alias("ancestor_id")), "ancestor_id", "left_semi").groupBy("node_id").agg((F.count(F.lit(1)) - 1).alias("depth"))
    return moved.join(depth, "node_id")


_FTS = BM25.replace("SELECT id, unnest([content, type, tags]) AS x, unnest([0, 1, 2]) AS f FROM memory", "SELECT node_id AS id, text AS x, 0 AS f FROM turns").split(",\n ft AS")[0]


@query("tree_search", f"""WITH RECURSIVE {_DUCK_ANC}, {_FTS}, sc AS (SELECT query_id, bm.id, bm25 FROM bm WHERE bm.id IN (SELECT node_id FROM anc WHERE ancestor_id % 100 = 1))
 SELECT query_id, id AS node_id, round(bm25, 6) AS bm25, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), id) AS rank FROM sc) WHERE rank <= 10""")
def tree_search(t):
    """Full text over all turns, inside the subtrees of second turns, ten of each query."""
    pages = t["turns"].select(F.col("node_id").alias("id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("tags"))
    inside = below(t, t["turns"].where("node_id % 100 = 1")).select(F.col("node_id").alias("id"))
    hits = search.bm25(pages, t["queries_fts"]).join(inside, "id", "left_semi")
    return ranked(hits, [F.round("bm25", 9), F.col("id")], 10).select("query_id", F.col("id").alias("node_id"), F.round("bm25", 6).alias("bm25"), "rank")


def heads(t):
    x = t["turns"]
    kids = x.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"))
    on = trunk(t).distinct().withColumn("on_trunk", F.lit(True))
    return x.join(kids, "parent_id", "left").join(on, "node_id", "left").where("parent_id IS NULL OR (n >= 2 AND on_trunk IS NULL)").select("node_id")


_CARDS = f"{_DUCK_ANC}, {_TRUNK}, {_HEADS}, cd AS (SELECT a.node_id, min_by(a.ancestor_id, a.dist) AS head FROM anc a JOIN hd ON hd.node_id = a.ancestor_id GROUP BY a.node_id)"


def cards(t):
    """The nearest head above each node."""
    return below(t, heads(t)).select("node_id", F.col("ancestor_id").alias("head"))


_DEPTHS = "dp AS (SELECT node_id, max(dist) AS depth FROM anc GROUP BY node_id)"
#: The links of cards: an override comes before a source, both before the card of the head's parent. Every fifth head stands
#: for an override to the conversation's first card, the next for a branch with that card as its source.
_LINKS = """lk AS (SELECT c.head AS target, CASE WHEN c.head % 5 <= 1 THEN r.head ELSE p.head END AS source, CASE WHEN c.head % 5 = 0 THEN 'manual' WHEN c.head % 5 = 1 THEN 'branching' ELSE 'auto' END AS kind, t.parent_id AS place
 FROM turns t JOIN cd c ON c.node_id = t.node_id AND c.head = t.node_id JOIN cd p ON p.node_id = t.parent_id JOIN cd r ON r.node_id = t.conv_id * 100)"""


def card_links(t, c):
    """(target, source, kind, place): each card that is not a conversation's first, the card that it hangs from, and the node that it branched off."""
    first = c.select((F.col("node_id") / 100).cast("long").alias("conv_id"), "node_id", F.col("head").alias("first")).where("node_id % 100 = 0").drop("node_id")
    up = c.select(F.col("node_id").alias("parent_id"), F.col("head").alias("auto"))
    x = t["turns"].select("node_id", "parent_id", "conv_id").join(c.where("node_id = head").select("node_id"), "node_id").join(up, "parent_id").join(first, "conv_id")
    rest = F.col("node_id") % 5
    return x.select(F.col("node_id").alias("target"), F.when(rest <= 1, F.col("first")).otherwise(F.col("auto")).alias("source"), F.when(rest == 0, "manual").when(rest == 1, "branching").otherwise("auto").alias("kind"), F.col("parent_id").alias("place"))


@query("tree_cards", f"""WITH RECURSIVE {_CARDS}, {_DEPTHS}, {_BAD}, {_LINKS}, up(card, above, d) AS (SELECT head, head, 0 FROM (SELECT DISTINCT head FROM cd) UNION ALL SELECT card, lk.source, d + 1 FROM up JOIN lk ON lk.target = up.above),
 cdp AS (SELECT card, max(d) AS depth FROM up GROUP BY card)
 SELECT cd.head, CAST(count(*) AS BIGINT) AS nodes, string_agg(CAST(cd.node_id AS VARCHAR), ',' ORDER BY dp.depth, cd.node_id) AS node_ids, coalesce(nullif(substr(max(CASE WHEN cd.node_id = cd.head THEN trim(t.text) END), 1, 24), ''), '无标题卡片') AS title,
  CAST(max(cdp.depth) AS INT) AS depth, max(lk.source) AS parent, arg_max(t.branch_label, CAST(dp.depth AS BIGINT) * 1000000000 + cd.node_id) FILTER (t.branch_label IS NOT NULL) AS branch_label, count(*) FILTER (cd.node_id IN (SELECT node_id FROM bd)) = 0 AS valid
 FROM cd JOIN turns t USING (node_id) JOIN dp USING (node_id) JOIN cdp ON cdp.card = cd.head LEFT JOIN lk ON lk.target = cd.head GROUP BY cd.head""")
def tree_cards(t):
    """The cards: a head with the nodes down to the next heads, by depth; title, depth and parent among the cards, the last label, and whether no node was abandoned."""
    c = cut(cards(t))
    path = cut(ancestors(t))
    links = cut(card_links(t, c))
    depth = path.groupBy("node_id").agg(F.max("dist").alias("d"))
    bad = below(t, t["turns"].where("turn = 5")).select("node_id", F.lit(True).alias("bad"))
    x = c.join(t["turns"].select("node_id", "text", "branch_label"), "node_id").join(depth, "node_id").join(bad, "node_id", "left")
    at = F.struct("d", "node_id")
    title = F.substring(F.max(F.when(F.col("node_id") == F.col("head"), F.trim("text"))), 1, 24)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["node_id"].cast("string")), ",")
    out = x.groupBy("head").agg(F.count(F.lit(1)).alias("nodes"), ids.alias("node_ids"), F.coalesce(F.when(title != "", title), F.lit("无标题卡片")).alias("title"), F.max_by("branch_label", F.when(F.col("branch_label").isNotNull(), at)).alias("branch_label"), (F.count_if("bad") == 0).alias("valid"))
    chain = forest.ancestors(c.select(F.col("head").alias("node_id")).distinct().join(links.select(F.col("target").alias("node_id"), F.col("source").alias("parent_id")), "node_id", "left"))
    deep = chain.groupBy(F.col("node_id").alias("head")).agg(F.max("dist").cast("int").alias("depth"))
    return out.join(deep, "head").join(links.select(F.col("target").alias("head"), F.col("source").alias("parent")), "head", "left").select("head", "nodes", "node_ids", "title", "depth", "parent", "branch_label", "valid")


@query("tree_links", f"WITH RECURSIVE {_CARDS}, {_LINKS} SELECT source, target, kind FROM lk WHERE source <> target")
def tree_links(t):
    """The links of cards by precedence: override, then source, then the card of the head's parent; none to itself."""
    return card_links(t, cut(cards(t))).where("source <> target").select("source", "target", "kind")


@query("tree_branch_chain", f"""WITH RECURSIVE {_CARDS}, {_DEPTHS}, {_LINKS}, ms AS (SELECT head, node_id, row_number() OVER (PARTITION BY head ORDER BY depth, node_id) AS pos FROM cd JOIN dp USING (node_id)),
 ln AS (SELECT target AS card, source, CASE WHEN target % 3 = 0 THEN 0 WHEN target % 3 = 1 THEN coalesce((SELECT pos FROM ms WHERE ms.head = lk.source AND ms.node_id = lk.place), 0) END AS upto FROM lk),
 ch(card, link, d) AS (SELECT card, card, 0 FROM ln UNION ALL SELECT ch.card, ln.source, d + 1 FROM ch JOIN ln ON ln.card = ch.link WHERE ln.source IN (SELECT card FROM ln)),
 ih AS (SELECT ch.card, d, pos, ms.node_id FROM ch JOIN ln ON ln.card = ch.link JOIN ms ON ms.head = ln.source WHERE upto IS NULL OR pos <= upto UNION ALL SELECT head, -1, pos, node_id FROM ms)
 SELECT card AS head, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY d DESC, pos) AS context, CAST(count(*) FILTER (d >= 0) AS BIGINT) AS inherited FROM ih GROUP BY card""")
def tree_branch_chain(t):
    """The context of each card: the messages that it inherits along its sources, the oldest first, then its own.

    Heads stand for the ways to branch by their rest of three: from the start (nothing inherited), from a message (its
    prefix; nothing where it is not in the source), from the whole card.
    """
    c = cut(cards(t))
    depth = ancestors(t).groupBy("node_id").agg(F.max("dist").alias("d"))
    place = F.row_number().over(Window.partitionBy("head").orderBy("d", "node_id"))
    own = cut(c.join(depth, "node_id").select(F.col("head").alias("card"), place.alias("place"), F.col("node_id").alias("message")))
    links = card_links(t, c).select(F.col("target").alias("card"), "source", F.col("place").alias("message"))
    at = own.select(F.col("card").alias("source"), "message", F.col("place").alias("at"))
    links = links.join(at, ["source", "message"], "left").select("card", "source", F.when(F.col("card") % 3 == 0, 0).when(F.col("card") % 3 == 1, F.coalesce("at", F.lit(0))).alias("upto"))
    every = forest.inherited(own, cut(links)).union(own.select("card", F.lit(-1), "place", "message"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("far"), "place", "message")))
    return every.groupBy(F.col("card").alias("head")).agg(F.array_join(F.transform(order, lambda x: x["message"].cast("string")), ",").alias("context"), F.count_if(F.col("dist") >= 0).alias("inherited"))


@query("tree_card_ops", f"WITH RECURSIVE {_DUCK_ANC} SELECT t.node_id, t.node_id + 1 AS new_parent, EXISTS (SELECT 1 FROM anc a WHERE a.node_id = t.node_id + 1 AND a.ancestor_id = t.node_id) AS cycle FROM turns t WHERE t.node_id + 1 IN (SELECT node_id FROM turns)")
def tree_card_ops(t):
    """Whether a new parent would close a cycle: it lies below the node itself."""
    x = t["turns"].select("node_id")
    ask = x.join(x.select((F.col("node_id") - 1).alias("node_id")), "node_id", "left_semi").withColumn("new_parent", F.col("node_id") + 1)
    up = ancestors(t, ask.select(F.col("new_parent").alias("node_id")).distinct()).select(F.col("node_id").alias("new_parent"), F.col("ancestor_id").alias("node_id"), F.lit(True).alias("c"))
    return ask.join(up, ["node_id", "new_parent"], "left").select("node_id", "new_parent", F.col("c").isNotNull().alias("cycle"))


@query("tree_misc", f"WITH RECURSIVE {_DUCK_ANC} SELECT node_id, max_by(CASE ancestor_id % 100 WHEN 0 THEN 'root agent' WHEN 2 THEN 'branch agent' END, -dist) FILTER (ancestor_id % 100 IN (0, 2)) AS agent FROM anc GROUP BY node_id")
def tree_misc(t):
    """An agent set on a node holds for its subtree until a nearer one."""
    name = F.when(F.col("ancestor_id") % 100 == 0, "root agent").when(F.col("ancestor_id") % 100 == 2, "branch agent")
    found = below(t, t["turns"].where("node_id % 100 IN (0, 2)")).select("node_id", name.alias("agent"))
    return t["turns"].select("node_id").join(found, "node_id", "left")


def scoped(found, turns, anc, asks, k: int):
    """Retrieved rows (query_id, id, score, arrival) as seen from a node of a tree, asks (query_id, node_id): the first k of each query.

    A row that is a turn of another conversation is left out; one that is no turn stays. A turn on the path from the root
    to the node gains 0.4, another one on a branch of that path 0.2.
    """
    node = turns.select(F.col("node_id").alias("id"), "conv_id", "branch_label")
    path = asks.join(anc, "node_id").select("query_id", F.col("ancestor_id").alias("id"))
    labels = path.join(node, "id").groupBy("query_id").agg(F.collect_set("branch_label").alias("labels"))
    here = asks.join(turns.select("node_id", F.col("conv_id").alias("session")), "node_id").select("query_id", "session")
    x = found.join(here, "query_id").join(labels, "query_id").join(node, "id", "left").where("conv_id IS NULL OR conv_id = session")
    x = x.join(path.withColumn("on_path", F.lit(True)), ["query_id", "id"], "left")
    scope = F.when(F.col("on_path"), "path").when(F.array_contains("labels", F.col("branch_label")), "branch").otherwise("global")
    x = x.withColumn("tree_scope", scope).withColumn("s", F.col("score") + F.when(F.col("tree_scope") == "path", 0.4).when(F.col("tree_scope") == "branch", 0.2).otherwise(0.0))
    return ranked(x, [F.desc(F.round("s", 9)), F.desc(F.round("score", 9)), F.col("arrival"), F.col("id")], k).select("query_id", "id", "tree_scope", F.round("s", 4).alias("tree_score"))


_ASKS = "ak AS (SELECT conv_id AS query_id, max_by(node_id, turn) AS node_id FROM turns WHERE conv_id IN (SELECT query_id FROM queries_fts) GROUP BY conv_id), pt AS (SELECT ak.query_id, a.ancestor_id AS id, a.dist FROM ak JOIN anc a USING (node_id)), lb AS (SELECT DISTINCT query_id, branch_label FROM pt JOIN turns ON turns.node_id = pt.id WHERE branch_label IS NOT NULL)"


def _asks(t):
    """The last turn of the conversation of each query's number: (query_id, node_id)."""
    last = t["turns"].groupBy("conv_id").agg(F.max_by("node_id", "turn").alias("node_id"))
    return last.join(t["queries_fts"].select(F.col("query_id").alias("conv_id")), "conv_id").select(F.col("conv_id").alias("query_id"), "node_id")


TREE_SCOPED = f"""WITH RECURSIVE {_DUCK_ANC}, {deeper(FUSED, 15)}, {_ASKS},
 sx AS (SELECT rk.query_id, rk.id, rk.score, rk.arrival, CASE WHEN pt.id IS NOT NULL THEN 'path' WHEN lb.branch_label IS NOT NULL THEN 'branch' ELSE 'global' END AS tree_scope FROM rk JOIN ak ON ak.query_id = rk.query_id LEFT JOIN turns t ON t.node_id = rk.id
  LEFT JOIN pt ON pt.query_id = rk.query_id AND pt.id = rk.id LEFT JOIN lb ON lb.query_id = rk.query_id AND lb.branch_label = t.branch_label WHERE (valid_to IS NULL OR valid_to > 1735689600) AND (t.conv_id IS NULL OR t.conv_id = rk.query_id)),
 sy AS (SELECT *, score + CASE tree_scope WHEN 'path' THEN 0.4 WHEN 'branch' THEN 0.2 ELSE 0 END AS s FROM sx)
 SELECT query_id, id, tree_scope, CAST(round(s, 4) AS DOUBLE) AS tree_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, round(score, 9) DESC, arrival, id) AS r FROM sy) WHERE r <= 5"""


@query("tree_scoped", TREE_SCOPED)
def tree_scoped(t):
    """The fused retrieval of each query, 15 rows deep, from the last turn of the conversation of its number; five stay."""
    asks = _asks(t)
    live = t["memory"].where("valid_to IS NULL OR valid_to > 1735689600").select("id")
    return scoped(search.retrieve(_found(t, 15), 15).join(live, "id", "left_semi"), t["turns"], ancestors(t, asks.select("node_id")), asks, 5)


_FRONT = "substr(trim(t.text), 1, 80)"
_PATHS = f"""WITH RECURSIVE {_DUCK_ANC}, ak AS (SELECT conv_id AS query_id, max_by(node_id, turn) AS node_id FROM turns WHERE conv_id IN (SELECT item_id FROM benchmark WHERE item_id < 20) GROUP BY conv_id), pt AS (SELECT ak.query_id, a.ancestor_id AS id, a.dist FROM ak JOIN anc a USING (node_id)),
 lb AS (SELECT DISTINCT query_id, branch_label FROM pt JOIN turns ON turns.node_id = pt.id WHERE branch_label IS NOT NULL), queries_path AS (SELECT query_id, string_agg({_FRONT}, ' ' ORDER BY dist DESC) AS q FROM pt JOIN turns t ON t.node_id = pt.id GROUP BY query_id)"""


@query("memory_retriever", f"""{_PATHS}, {deeper(FUSED, 12).replace("queries_fts", "queries_path")},
 cr AS (SELECT rk.query_id, rk.id, rk.score + CASE WHEN lb.branch_label IS NOT NULL THEN 0.3 ELSE 0 END AS s, rk.arrival FROM rk JOIN turns t ON t.node_id = rk.id LEFT JOIN pt ON pt.query_id = rk.query_id AND pt.id = rk.id LEFT JOIN lb ON lb.query_id = rk.query_id AND lb.branch_label = t.branch_label WHERE pt.id IS NULL),
 pa2 AS (SELECT query_id, id, 'path' AS source, CAST(1 AS DOUBLE) AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist) AS r FROM pt) WHERE r <= 6)
 SELECT * FROM pa2 UNION ALL SELECT query_id, id, 'cross', round(s, 6) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, arrival, id) AS r FROM cr WHERE s >= 0.15) WHERE r <= 6""")
def memory_retriever(t):
    """Of each asked node: what the turns on its path hold, and what the fused search finds for the path's text on other branches.

    A turn holds the memory of its number; its summary, the first 80 characters, stands for it in the query. Those found off the path gain 0.3 on a branch of the path; six of each side.
    """
    asks = _asks(t)
    path = cut(ancestors(t, asks.select("node_id")).join(asks, "node_id").select("query_id", F.col("ancestor_id").alias("id"), "dist"))
    node = t["turns"].select(F.col("node_id").alias("id"), "branch_label", F.substring(F.trim("text"), 1, 80).alias("front"))
    said = path.join(node, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "front"))).alias("x"))
    queries = cut(said.select("query_id", F.array_join(F.transform("x", lambda s: s["front"]), " ").alias("q")))
    labels = path.join(node.where("branch_label IS NOT NULL"), "id").select("query_id", "branch_label", F.lit(0.3).alias("more")).distinct()
    cross = search.retrieve(_found(t, 12, queries), 12).select("query_id", "id", "score", "arrival").join(path.select("query_id", "id"), ["query_id", "id"], "left_anti")
    cross = cross.join(node.drop("front"), "id").join(labels, ["query_id", "branch_label"], "left").withColumn("s", F.col("score") + F.coalesce("more", F.lit(0.0))).where("s >= 0.15")
    cross = ranked(cross, [F.desc(F.round("s", 9)), F.col("arrival"), F.col("id")], 6).select("query_id", "id", F.lit("cross").alias("source"), F.round("s", 6).alias("relevance"))
    return ranked(path, [F.col("dist")], 6).select("query_id", "id", F.lit("path").alias("source"), F.lit(1.0).alias("relevance")).union(cross)


@query("join_session_filter", "SELECT node_id FROM turns WHERE list_contains(string_split(concat('node:', CAST(node_id AS VARCHAR), ' session:', CAST(conv_id % 7 AS VARCHAR)), ' '), 'session:3')")
def join_session_filter(t):
    tags = F.split(F.concat(F.lit("node:"), "node_id", F.lit(" session:"), (F.col("conv_id") % 7).cast("string")), " ")
    return t["turns"].where(F.array_contains(tags, "session:3")).select("node_id")
