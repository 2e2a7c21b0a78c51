"""Scans and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import like
from .catalog import query

MEM = "id, type, weight, created"


@query("scan_get", f"SELECT {MEM} FROM memory WHERE id = 7")
def scan_get(t):
    return t["memory"].where("id = 7").select("id", "type", "weight", "created")


@query("scan_get_batch", f"SELECT {MEM} FROM memory WHERE id IN (1, 5, 11, 99999999)")
def scan_get_batch(t):
    ids = t["memory"].sparkSession.createDataFrame([(1,), (5,), (11,), (99999999,)], "id long")
    return t["memory"].join(F.broadcast(ids), "id", "left_semi").select("id", "type", "weight", "created")


@query("scan_list_all", f"SELECT {MEM} FROM memory WHERE type = 'fact' AND character = 'ch_a' ORDER BY id DESC LIMIT 50")
def scan_list_all(t):
    return t["memory"].where("type = 'fact' AND character = 'ch_a'").orderBy(F.desc("id")).limit(50).select("id", "type", "weight", "created")


@query("scan_time_range", f"SELECT {MEM} FROM memory WHERE created BETWEEN 1733000000 AND 1735000000 ORDER BY weight DESC, last_accessed DESC, id LIMIT 40")
def scan_time_range(t):
    return t["memory"].where(F.col("created").between(1733000000, 1735000000)).orderBy(F.desc("weight"), F.desc("last_accessed"), "id").limit(40).select("id", "type", "weight", "created")


@query("scan_structured", f"""SELECT {MEM} FROM memory WHERE contains(tags, 'v5_project:src1') AND contains(tags, 'v5_kind:pitfall') AND type = 'fact'
 AND (contains(lower(content), 'the') OR contains(tags, 'the')) AND created >= 1731000000 ORDER BY weight DESC, id DESC LIMIT 30""")
def scan_structured(t):
    facets = [F.col("tags").contains("v5_project:src1"), F.col("tags").contains("v5_kind:pitfall"), F.col("type") == "fact", like(F.col("content"), F.lit("the")) | like(F.col("tags"), F.lit("the")), F.col("created") >= 1731000000]
    out = t["memory"]
    for f in facets:
        out = out.where(f)
    return out.orderBy(F.desc("weight"), F.desc("id")).limit(30).select("id", "type", "weight", "created")


@query("scan_valid_to", "SELECT CAST(id AS VARCHAR) AS key, valid_to FROM memory")
def scan_valid_to(t):
    return t["memory"].select(F.col("id").cast("string").alias("key"), "valid_to")


@query("scan_reflections", "SELECT id, importance FROM reflections WHERE character = 'ch_1' AND status = 'CONFIRMED' AND importance >= 0.2 ORDER BY importance DESC, created_at DESC, id LIMIT 20")
def scan_reflections(t):
    return t["reflections"].where("character = 'ch_1' AND status = 'CONFIRMED' AND importance >= 0.2").orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(20).select("id", "importance")


@query("scan_directives", "SELECT id, content, created_at FROM directives WHERE character = 'ch_2' AND is_active AND (expires_at = 0 OR expires_at > 1735689600)")
def scan_directives(t):
    return t["directives"].where("character = 'ch_2' AND is_active AND (expires_at = 0 OR expires_at > 1735689600)").select("id", "content", "created_at")


@query("scan_edges", "SELECT source, target, relation, weight FROM project_edges WHERE source IN (3, 7, 10) OR target IN (3, 7, 10)")
def scan_edges(t):
    """Two equi-joins instead of one join on OR, so a long list of ids still hashes."""
    e = t["project_edges"]
    ids = e.sparkSession.createDataFrame([(3,), (7,), (10,)], "k long")
    out = e.join(F.broadcast(ids), e.source == ids.k, "left_semi")
    return out.union(e.join(F.broadcast(ids), e.target == ids.k, "left_semi")).dropDuplicates(["source", "target", "relation"])


@query("scan_aliases", "SELECT entity_id, alias FROM eg_aliases WHERE entity_id = 9")
def scan_aliases(t):
    return t["eg_aliases"].where("entity_id = 9")


@query("scan_vault", r"""WITH v AS (SELECT page_id, lower(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS body, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages),
 s AS (SELECT page_id, CAST(contains(body, 'the') AS INT) + CAST(contains(body, 'page') AS INT) + CASE WHEN contains(title, 'the') OR contains(title, 'page') THEN 2 ELSE 0 END AS s FROM v)
 SELECT page_id, CAST(s AS BIGINT) AS hits, CAST(round(least(0.8, 0.15 * s), 6) AS DOUBLE) AS weight, CAST(round(least(1.0, 0.12 * s), 6) AS DOUBLE) AS score FROM s WHERE s > 0""")
def scan_vault(t):
    """Notes ranked by the query's words: one for each word present, two if one is in the title."""
    words = ["the", "page"]
    v = t["pages"].select("page_id", F.lower(F.regexp_replace("html", "<[^>]*>", " ")).alias("body"), F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    s = sum((F.col("body").contains(w).cast("int") for w in words), F.lit(0)) + F.when(F.col("title").contains(words[0]) | F.col("title").contains(words[1]), 2).otherwise(0)
    return v.select("page_id", s.cast("long").alias("hits")).where("hits > 0").select("page_id", "hits", F.round(F.least(F.lit(0.8), 0.15 * F.col("hits")), 6).alias("weight"), F.round(F.least(F.lit(1.0), 0.12 * F.col("hits")), 6).alias("score"))


@query("scan_skills", "SELECT id, name, description FROM skills WHERE name <> '' AND description <> '' AND NOT starts_with(name, '.')")
def scan_skills(t):
    return t["skills"].where("name <> '' AND description <> '' AND NOT startswith(name, '.')").select("id", "name", "description")


@query("scan_tree", """SELECT conv_id, CAST(count(*) AS BIGINT) AS nodes, CAST(count(branch_label) AS BIGINT) AS branches, min(node_id) AS root, CAST(max(turn) AS INT) AS last_turn FROM turns GROUP BY conv_id""")
def scan_tree(t):
    return t["turns"].groupBy("conv_id").agg(F.count(F.lit(1)).alias("nodes"), F.count("branch_label").alias("branches"), F.min("node_id").alias("root"), F.max("turn").alias("last_turn"))


@query("scan_vectors", "SELECT id, type, CAST(len(embedding) AS INT) AS dim FROM vectors")
def scan_vectors(t):
    return t["vectors"].select("id", "type", F.size("embedding").alias("dim"))
