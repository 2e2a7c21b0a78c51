"""Mutations: each takes a snapshot and changes and gives the next snapshot."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..sources.fixtures import pair_parts
from .catalog import query


@query("sink_store", """WITH m AS (SELECT max(id) AS top FROM memory), n AS (SELECT event_id, concat('event ', event_type) AS content, least(1.0, greatest(0.0, value / 100)) AS weight, row_number() OVER (ORDER BY event_id) AS rn FROM events)
 SELECT CAST(top + rn AS BIGINT) AS id, content, round(weight, 6) AS weight FROM n, m UNION ALL SELECT id, content, round(weight, 6) FROM memory""")
def sink_store(t):
    """The new snapshot: all rows that were there and one for every event, weights clamped, ids after the largest in order of the event."""
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))
    new = numbered(t["events"].select("event_id", F.concat(F.lit("event "), "event_type").alias("content"), F.round(weight, 6).alias("weight")), [F.col("event_id")], "n")
    new = new.join(F.broadcast(t["memory"].agg(F.max("id").alias("top")))).select((F.col("top") + F.col("n")).alias("id"), "content", "weight")
    return new.unionByName(t["memory"].select("id", "content", F.round("weight", 6).alias("weight")))


@query("merge_into", """SELECT a.id, CASE WHEN length(b.content) > length(a.content) THEN b.content ELSE a.content END AS content, greatest(a.weight, b.weight) AS weight, CAST(a.access_count + 1 AS INT) AS access_count,
 round(least(1.0, a.reinforcement + greatest(0.0, b.reinforcement) + 0.05), 6) AS reinforcement, array_to_string(list_concat(string_split(a.tags, ','), list_filter(string_split(b.tags, ','), x -> NOT list_contains(string_split(a.tags, ','), x))), ' ') AS tags
 FROM memory a JOIN memory b ON b.id = a.id + 1 WHERE a.id % 2 = 0""")
def merge_into(t):
    """Merge a row into its elder: the longer text (a tie keeps the old), the larger weight, both tag sets in order."""
    a = t["memory"].where("id % 2 = 0")
    b = t["memory"].select((F.col("id") - 1).alias("id"), F.col("content").alias("c2"), F.col("weight").alias("w2"), F.col("tags").alias("t2"), F.col("reinforcement").alias("r2"))
    return a.join(b, "id").select(
        "id", F.when(F.length("c2") > F.length("content"), F.col("c2")).otherwise(F.col("content")).alias("content"), F.greatest("weight", "w2").alias("weight"), (F.col("access_count") + 1).alias("access_count"),
        F.round(F.least(F.lit(1.0), F.col("reinforcement") + F.greatest(F.lit(0.0), "r2") + 0.05), 6).alias("reinforcement"), F.array_join(F.array_union(F.split("tags", r"[,\s]+"), F.split("t2", r"[,\s]+")), " ").alias("tags"),
    )


@query("sink_access", """WITH a AS (SELECT event_id % 500 AS id, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1)
 SELECT m.id, CAST(access_count + coalesce(n, 0) AS BIGINT) AS access_count, round(least(1.0, weight + 0.05 * coalesce(n, 0)), 6) AS weight FROM memory m LEFT JOIN a ON a.id = m.id""")
def sink_access(t):
    n = t["events"].groupBy((F.col("event_id") % 500).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    n0 = F.coalesce("n", F.lit(0))
    return t["memory"].join(n, "id", "left").select("id", (F.col("access_count") + n0).cast("long").alias("access_count"), F.round(F.least(F.lit(1.0), F.col("weight") + 0.05 * n0), 6).alias("weight"))


@query("sink_evidence", """WITH d AS (SELECT id, sum(delta_rein) AS r, sum(delta_disp) AS p, count(*) AS n FROM evidence GROUP BY id)
 SELECT m.id, round(reinforcement + coalesce(r, 0), 6) AS reinforcement, round(disputation + coalesce(p, 0), 6) AS disputation, CAST(1 + coalesce(n, 0) AS BIGINT) AS evidence_version FROM memory m LEFT JOIN d ON d.id = m.id""")
def sink_evidence(t):
    d = t["evidence"].groupBy("id").agg(F.sum("delta_rein").alias("r"), F.sum("delta_disp").alias("p"), F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return t["memory"].join(d, "id", "left").select("id", F.round(F.col("reinforcement") + zero("r"), 6).alias("reinforcement"), F.round(F.col("disputation") + zero("p"), 6).alias("disputation"), (1 + zero("n")).cast("long").alias("evidence_version"))


@query("sink_delete", "SELECT id FROM memory WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def sink_delete(t):
    gone = t["labels"].where("toxic = 1").select(F.col("doc_id").alias("id"))
    return t["memory"].select("id").join(gone, "id", "left_anti")


@query("sink_edge", """WITH n AS (SELECT l_orderkey % 200 AS source, l_partkey % 200 AS target, upper(CASE l_linenumber % 2 WHEN 0 THEN 'solves' ELSE 'relates_to' END) AS relation, round(l_discount, 4) AS weight, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
 r AS (SELECT *, row_number() OVER (PARTITION BY source, target, relation ORDER BY seq DESC, weight DESC) AS rn FROM n WHERE source <> target)
 SELECT source, target, relation, weight FROM r WHERE rn = 1""")
def sink_edge(t):
    """The last write of each (source, target, relation) wins; self edges and nulls are rejected."""
    rel = F.upper(F.when(F.col("l_linenumber") % 2 == 0, "solves").otherwise("relates_to"))
    n = t["lineitem"].select((F.col("l_orderkey") % 200).alias("source"), (F.col("l_partkey") % 200).alias("target"), rel.alias("relation"), F.round("l_discount", 4).alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return n.where("source <> target").groupBy("source", "target", "relation").agg(F.max_by("weight", F.struct("seq", "weight")).alias("weight"))


@query("sink_entity", "SELECT id, arg_min(name, p_partkey) AS name FROM (SELECT p_partkey % 100 AS id, concat(p_brand, ' ', p_type) AS name, p_partkey FROM part) GROUP BY id")
def sink_entity(t):
    """INSERT OR IGNORE: the first write of an id stays."""
    return t["part"].groupBy((F.col("p_partkey") % 100).alias("id")).agg(F.min_by(F.concat("p_brand", F.lit(" "), "p_type"), "p_partkey").alias("name"))


@query("sink_alias", "SELECT entity_id, alias FROM eg_aliases UNION SELECT p_partkey, concat('alias ', CAST(p_size AS VARCHAR)) FROM part")
def sink_alias(t):
    """INSERT OR IGNORE on the pair: pairs that are there, and every pair that is new."""
    new = t["part"].select(F.col("p_partkey").alias("entity_id"), F.concat(F.lit("alias "), F.col("p_size").cast("string")).alias("alias"))
    return t["eg_aliases"].union(new).distinct()


@query("sink_link", """WITH n AS (SELECT l_orderkey AS memory_id, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_partkey % 50 + 1 END AS entity_id, round(l_discount, 9) AS link_weight, l_linenumber AS seq FROM lineitem),
 o AS (SELECT memory_id, entity_id, round(link_weight, 9) AS link_weight, 0 AS seq FROM eg_episodic_entities)
 SELECT memory_id, entity_id, arg_min(link_weight, seq * 100 + link_weight) AS link_weight FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY memory_id, entity_id""")
def sink_link(t):
    """INSERT OR IGNORE on (memory, entity): the link that is there stays, of new ones the first."""
    entity = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).otherwise(F.col("l_partkey") % 50 + 1)
    new = t["lineitem"].select(F.col("l_orderkey").alias("memory_id"), entity.alias("entity_id"), F.round("l_discount", 9).alias("link_weight"), F.col("l_linenumber").cast("long").alias("seq"))
    old = t["eg_episodic_entities"].select("memory_id", "entity_id", F.round("link_weight", 9).alias("link_weight"), F.lit(0).cast("long").alias("seq"))
    return old.unionByName(new).groupBy("memory_id", "entity_id").agg(F.min_by("link_weight", F.struct("seq", "link_weight")).alias("link_weight"))


@query("sink_eg_edge", """WITH d AS (SELECT l_partkey % 300 + 1 AS src, l_suppkey % 40 + 400 AS dst, l_discount AS delta FROM lineitem UNION ALL SELECT src, dst, 0.25 FROM eg_edges WHERE co_occurrence_count > 1),
 a AS (SELECT src, dst, weight, co_occurrence_count AS n FROM eg_edges UNION ALL SELECT src, dst, delta, 1 FROM d) SELECT src, dst, round(least(1.0, sum(weight)), 9) AS weight, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY src, dst""")
def sink_eg_edge(t):
    """Upsert of deltas into the edges: weights add up and are capped at 1, counts go up by one a delta. As deltas are not negative, their order does not matter."""
    deltas = t["lineitem"].select((F.col("l_partkey") % 300 + 1).alias("src"), (F.col("l_suppkey") % 40 + 400).alias("dst"), F.col("l_discount").cast("double").alias("weight"))
    deltas = deltas.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))  # few keys, so before the edges meet them
    again = t["eg_edges"].where("co_occurrence_count > 1").select("src", "dst", F.lit(0.25), F.lit(1).cast("long"))
    rows = t["eg_edges"].select("src", "dst", "weight", F.col("co_occurrence_count").alias("n")).union(deltas).union(again)
    return rows.repartition(pair_parts(t), "src", "dst").groupBy("src", "dst").agg(F.round(F.least(F.lit(1.0), F.sum("weight")), 9).alias("weight"), F.sum("n").alias("n"))


@query("sink_activation", """SELECT user_id % 50 AS memory_id, round(max_by(value, event_id), 6) AS score, CAST(max(event_id) * 60 + 1200 AS BIGINT) AS expires_at FROM events GROUP BY 1""")
def sink_activation(t):
    """The last activation of each memory, with its end 20 minutes later."""
    return t["events"].groupBy((F.col("user_id") % 50).alias("memory_id")).agg(F.round(F.max_by("value", "event_id"), 6).alias("score"), (F.max("event_id") * 60 + 1200).cast("long").alias("expires_at"))


@query("sink_directive", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY character ORDER BY created_at DESC, id DESC) AS rn FROM directives)
 SELECT id, character, content FROM k WHERE rn <= 50 UNION ALL SELECT 0, character, 'new' FROM directives GROUP BY character""")
def sink_directive(t):
    """The newest 50 of each character stay, then the new one is added."""
    rn = F.row_number().over(Window.partitionBy("character").orderBy(F.desc("created_at"), F.desc("id")))
    kept = t["directives"].withColumn("rn", rn).where("rn <= 50").select("id", "character", "content")
    return kept.union(t["directives"].select("character").distinct().select(F.lit(0).cast("long"), "character", F.lit("new")))


@query("sink_expire", "SELECT id, is_active AND (expires_at = 0 OR expires_at > 1735689600) AS is_active FROM directives")
def sink_expire(t):
    return t["directives"].select("id", F.expr("is_active AND (expires_at = 0 OR expires_at > 1735689600)").alias("is_active"))


@query("sink_event", """SELECT event_id, event_type, substr(props, 1, 100) AS preview FROM events WHERE event_type IN ('purchase', 'signup', 'error', 'click')""")
def sink_event(t):
    """Append the events of known types, with a preview of the payload."""
    return t["events"].where(F.col("event_type").isin("purchase", "signup", "error", "click")).select("event_id", "event_type", F.substring("props", 1, 100).alias("preview"))


@query("sink_skill", r"""WITH w AS (SELECT p_partkey AS seq, CASE WHEN p_size % 2 = 0 THEN concat('size-', CAST(p_size AS VARCHAR)) ELSE concat('Size ', CAST(p_size AS VARCHAR)) END AS name, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS description FROM part),
 n AS (SELECT name, arg_max(description, seq) AS description FROM w WHERE regexp_full_match(name, '[a-z0-9]+(-[a-z0-9]+)*') AND description <> '' GROUP BY name) SELECT name, description FROM n UNION ALL SELECT name, min(description) FROM skills WHERE name NOT IN (SELECT name FROM n) GROUP BY name""")
def sink_skill(t):
    """The next snapshot: writes with a kebab-case name and a description replace the skill of that name, the last one wins; others are refused."""
    even = F.col("p_size") % 2 == 0
    name = F.when(even, F.concat(F.lit("size-"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("Size "), F.col("p_size").cast("string")))
    writes = t["part"].select("p_partkey", name.alias("name"), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_type")).alias("description"))
    new = writes.where(F.col("name").rlike("^[a-z0-9]+(-[a-z0-9]+)*$") & (F.col("description") != "")).groupBy("name").agg(F.max_by("description", "p_partkey").alias("description"))
    return new.union(t["skills"].join(new, "name", "left_anti").groupBy("name").agg(F.min("description").alias("description")))


@query("sink_mermaid", """WITH n AS (SELECT conv_id, node_id, concat('n', CAST(node_id AS VARCHAR), '["', replace(replace(substr(regexp_replace(text, '[\\s"]+', ' ', 'g'), 1, 28), '[', '('), ']', ')'), '"]') AS line FROM turns),
 e AS (SELECT conv_id, node_id, concat('n', CAST(parent_id AS VARCHAR), ' --> n', CAST(node_id AS VARCHAR)) AS line FROM turns WHERE parent_id IS NOT NULL)
 SELECT conv_id, concat('graph TD', chr(10), string_agg(line, chr(10) ORDER BY kind, node_id)) AS mermaid FROM (SELECT conv_id, node_id, line, 0 AS kind FROM n UNION ALL SELECT conv_id, node_id, line, 1 FROM e) GROUP BY conv_id""")
def sink_mermaid(t):
    """The graph of every conversation."""
    return drawn(t["turns"])


def drawn(x):
    """Node lines, then edge lines; one conversation bounds a group."""
    label = F.replace(F.replace(F.substring(F.regexp_replace("text", r'[\s"]+', " "), 1, 28), F.lit("["), F.lit("(")), F.lit("]"), F.lit(")"))
    nodes = x.select("conv_id", F.lit(0).alias("kind"), "node_id", F.concat(F.lit("n"), "node_id", F.lit('["'), label, F.lit('"]')).alias("line"))
    edges = x.where("parent_id IS NOT NULL").select("conv_id", F.lit(1).alias("kind"), "node_id", F.concat(F.lit("n"), "parent_id", F.lit(" --> n"), "node_id").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("kind", "node_id", "line"))), lambda s: s["line"])
    return nodes.union(edges).groupBy("conv_id").agg(F.concat(F.lit("graph TD\n"), F.array_join(lines, "\n")).alias("mermaid"))


@query("sink_state", "SELECT user_id, max_by(event_type, event_id) AS last_type, CAST(max(event_id) AS BIGINT) AS revision FROM events GROUP BY user_id")
def sink_state(t):
    """One state row by key, the last write wins."""
    return t["events"].groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.max("event_id").alias("revision"))
