"""Lifecycle and maintenance: one pass over a snapshot each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import importance
from ..operators import search
from ..schema import DAY, NOW, SOUL_TYPES
from .catalog import query
from .extras import RULES, _said, rule_matches
from .retrieval import FUSED, _found
from .text import EI_SQL

_DEMOTE = "long_term AND access_count = 0 AND last_accessed <> 0 AND (1735689600 - last_accessed) / 86400 > 90"
_PROMOTE = f"short_term AND (access_count >= 2 OR weight >= 0.55 OR reinforcement >= 1 OR (1735689600 - created) / 86400 > 30 OR {EI_SQL} >= 0.6)"
_ARCHIVE = "type NOT IN ('identity', 'axiom', 'rule') AND (type = 'conversation' AND (1735689600 - created) / 86400 > 7 OR type = 'decision' AND (1735689600 - created) / 86400 > 30 OR weight < 0.45)"


def retention(memory, now: float):
    """action and the new flags; demotion before promotion before archiving."""
    days = (F.lit(now) - F.col("created")) / DAY
    cold = (F.lit(now) - F.col("last_accessed")) / DAY
    ei = importance(F.col("weight"), F.col("access_count"), F.col("last_accessed"), now, F.col("reinforcement"))
    demote = F.col("long_term") & (F.col("access_count") == 0) & (F.col("last_accessed") != 0) & (cold > 90)
    promote = F.col("short_term") & ((F.col("access_count") >= 2) | (F.col("weight") >= 0.55) | (F.col("reinforcement") >= 1) | (days > 30) | (ei >= 0.6))
    archive = ~F.col("type").isin(SOUL_TYPES) & (((F.col("type") == "conversation") & (days > 7)) | ((F.col("type") == "decision") & (days > 30)) | (F.col("weight") < 0.45))
    action = F.when(F.col("archived"), "skip").when(demote, "demote").when(promote, "promote").when(archive, "archive").otherwise("keep")
    return memory.withColumn("action", action).withColumn("long_term", F.when(F.col("action") == "promote", True).when(F.col("action") == "demote", False).otherwise(F.col("long_term"))).withColumn(
        "short_term", F.when(F.col("action") == "promote", False).when(F.col("action") == "demote", True).otherwise(F.col("short_term"))
    ).withColumn("archived", F.col("archived") | (F.col("action") == "archive"))


@query("life_retention", f"""WITH a AS (SELECT *, CASE WHEN archived THEN 'skip' WHEN {_DEMOTE} THEN 'demote' WHEN {_PROMOTE} THEN 'promote' WHEN {_ARCHIVE} THEN 'archive' ELSE 'keep' END AS action FROM memory)
 SELECT id, action, CASE action WHEN 'promote' THEN true WHEN 'demote' THEN false ELSE long_term END AS long_term, CASE action WHEN 'promote' THEN false WHEN 'demote' THEN true ELSE short_term END AS short_term, archived OR action = 'archive' AS archived FROM a""")
def life_retention(t):
    return retention(t["memory"], NOW).select("id", "action", "long_term", "short_term", "archived")


@query("life_promote", "SELECT id, CASE WHEN short_term AND NOT archived AND (weight >= 0.55 OR access_count >= 2) THEN true ELSE long_term END AS long_term FROM memory")
def life_promote(t):
    up = F.col("short_term") & ~F.col("archived") & ((F.col("weight") >= 0.55) | (F.col("access_count") >= 2))
    return t["memory"].select("id", F.when(up, True).otherwise(F.col("long_term")).alias("long_term"))


@query("life_cleanup", f"SELECT id, archived OR {_ARCHIVE} AS archived FROM memory")
def life_cleanup(t):
    return t["memory"].select("id", F.expr(f"archived OR ({_ARCHIVE})").alias("archived"))


@query("life_mem_promote", "SELECT id, CASE WHEN NOT d AND (access_count >= 3 OR reinforcement >= 1 OR created > 0 AND 1735689600 - created > 2592000) AND NOT long_term THEN true WHEN d THEN access_count >= 3 OR reinforcement >= 1 OR created > 0 AND 1735689600 - created > 2592000 ELSE long_term END AS long_term FROM (SELECT *, long_term AND access_count = 0 AND last_accessed > 0 AND 1735689600 - last_accessed > 7776000 AS d FROM memory)")
def life_mem_promote(t):
    """Demote first, then promote what is not long-term by then."""
    cold = F.col("long_term") & (F.col("access_count") == 0) & (F.col("last_accessed") > 0) & (F.lit(NOW) - F.col("last_accessed") > 90 * DAY)
    up = (F.col("access_count") >= 3) | (F.col("reinforcement") >= 1) | ((F.col("created") > 0) & (F.lit(NOW) - F.col("created") > 30 * DAY))
    return t["memory"].select("id", ((F.col("long_term") & ~cold) | up).alias("long_term"))


@query("life_supersede", """SELECT 'memory' AS kind, id, CASE WHEN valid_to IS NULL AND id IN (SELECT a.id FROM memory a JOIN memory b ON b.id = a.id + 10 WHERE a.id % 10 = 3 AND b.weight > a.weight) THEN CAST(1735689600 AS DOUBLE) ELSE valid_to END AS valid_to FROM memory
 UNION ALL SELECT 'edge', src * 1000000 + dst, CASE WHEN src % 10 = 3 THEN CAST(1735689600 AS DOUBLE) END FROM eg_edges""")
def life_supersede(t):
    """Next snapshots: memories that a heavier later one contradicts are closed, once; so are the outgoing edges of changed entities."""
    m, now = t["memory"], F.lit(NOW)
    pairs = m.where("id % 10 = 3").select("id", "weight").join(m.select((F.col("id") - 10).alias("id"), F.col("weight").alias("w2")), "id").where("w2 > weight").select("id")
    changed = t["eg_entities"].where("id % 10 = 3").select(F.col("id").alias("src"))
    edges = t["eg_edges"].join(changed.withColumn("c", F.lit(True)), "src", "left").select(F.lit("edge").alias("kind"), (F.col("src") * 1_000_000 + F.col("dst")).alias("id"), F.when(F.col("c"), now).alias("valid_to"))
    return superseded(m, pairs, NOW).select(F.lit("memory").alias("kind"), "id", "valid_to").union(edges)


def superseded(memory, ids, now: float):
    """The snapshot after these ids are closed; a row that is closed keeps its time."""
    x = memory.join(ids.select("id", F.lit(True).alias("_s")).distinct(), "id", "left")
    return x.withColumn("valid_to", F.when(F.col("_s") & F.col("valid_to").isNull(), F.lit(now)).otherwise(F.col("valid_to"))).drop("_s")


@query("life_scd", "SELECT event_id, user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM interactions")
def life_scd(t):
    return t["interactions"].select("event_id", "user_id", "event_type", F.col("ts").alias("valid_from"), F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("valid_to"))


_DECAYED = "CASE WHEN (1735689600 - created_at) / 86400 > 0 THEN (reinforcement - disputation) * pow(0.5, (1735689600 - created_at) / 86400 / 14) ELSE reinforcement - disputation END * importance * 10"


@query("life_reflection", f"""WITH r AS (SELECT *, {_DECAYED} AS d FROM (SELECT r.id, status, importance, created_at, sub_zero, reinforcement + coalesce(delta_rein, 0) AS reinforcement, disputation + coalesce(delta_disp, 0) AS disputation FROM reflections r LEFT JOIN evidence e ON e.id = r.id)),
 z AS (SELECT *, CASE WHEN status = 'PENDING' AND d < 0 THEN sub_zero + 1 WHEN status = 'PENDING' AND d < 10 THEN 0 ELSE sub_zero END AS z FROM r)
 SELECT id, CASE status WHEN 'PENDING' THEN CASE WHEN d >= 50 THEN 'PROMOTED' WHEN d >= 10 THEN 'CONFIRMED' WHEN d < 0 AND z >= 3 THEN 'DENIED' ELSE status END WHEN 'CONFIRMED' THEN CASE WHEN d >= 50 THEN 'PROMOTED' WHEN d < 5 THEN 'ARCHIVED' ELSE status END WHEN 'PROMOTED' THEN CASE WHEN d < 10 THEN 'ARCHIVED' ELSE status END ELSE status END AS status, round(d, 5) AS evidence, CAST(z AS INT) AS sub_zero FROM z""")
def life_reflection(t):
    """The snapshot of all reflections after the evidence of the batch and one check."""
    return checked(t["reflections"], t["evidence"]).select("id", "status", F.round("evidence", 5).alias("evidence"), "sub_zero")


def checked(reflections, evidence=None, now: float = NOW):
    """reflections with the sums of their evidence (id, delta_rein, delta_disp) and the status that follows from what is left of it.

    A pending one is denied at the third check in a row below zero; from zero on, short of confirmation, the count starts anew.
    """
    if evidence is None:
        evidence = reflections.select("id", F.lit(0.0).alias("delta_rein"), F.lit(0.0).alias("delta_disp")).limit(0)
    if "sub_zero" not in reflections.columns:
        reflections = reflections.withColumn("sub_zero", F.lit(0))
    delta = evidence.groupBy("id").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("delta_rein", "delta_disp")))
    x = reflections.join(delta, "id", "left").fillna(0.0, ["delta_rein", "delta_disp"])
    x = x.withColumn("reinforcement", F.col("reinforcement") + F.col("delta_rein")).withColumn("disputation", F.col("disputation") + F.col("delta_disp"))
    days = (F.lit(now) - F.col("created_at")) / DAY
    net = F.col("reinforcement") - F.col("disputation")
    x = x.withColumn("evidence", F.when(days > 0, net * F.pow(F.lit(0.5), days / 14)).otherwise(net) * F.col("importance") * 10)
    d, s, pending = F.col("evidence"), F.col("status"), F.col("status") == "PENDING"
    x = x.withColumn("sub_zero", F.when(pending & (d < 0), F.coalesce("sub_zero", F.lit(0)) + 1).when(pending & (d < 10), 0).otherwise(F.col("sub_zero")))
    up = F.when(s.isin("PENDING", "CONFIRMED") & (d >= 50), "PROMOTED").when(pending & (d >= 10), "CONFIRMED").when(pending & (d < 0) & (F.col("sub_zero") >= 3), "DENIED")
    return x.withColumn("status", up.when((s == "CONFIRMED") & (d < 5) | (s == "PROMOTED") & (d < 10), "ARCHIVED").otherwise(s)).drop("delta_rein", "delta_disp")


@query("life_reflection_block", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY character, status ORDER BY importance DESC, created_at DESC, id) AS r FROM reflections WHERE status IN ('CONFIRMED', 'PROMOTED')), b AS (SELECT *, row_number() OVER (PARTITION BY character ORDER BY importance * (reinforcement - disputation) DESC, id) AS p FROM c WHERE r <= 5)
 SELECT character, id, CAST(p AS INT) AS place, CASE status WHEN 'CONFIRMED' THEN '✓' ELSE '★' END AS mark FROM b WHERE p <= 5""")
def life_reflection_block(t):
    r = F.row_number().over(Window.partitionBy("character", "status").orderBy(F.desc("importance"), F.desc("created_at"), "id"))
    c = t["reflections"].where("status IN ('CONFIRMED', 'PROMOTED')").withColumn("r", r).where("r <= 5")
    p = F.row_number().over(Window.partitionBy("character").orderBy(F.desc(F.expr("importance * (reinforcement - disputation)")), "id"))
    return c.withColumn("place", p).where("place <= 5").select("character", "id", "place", F.when(F.col("status") == "CONFIRMED", "✓").otherwise("★").alias("mark"))


#: Maintenance operations and their intervals in seconds.
INTERVALS = {"profile_sync": 21600, "dedup": 21600, "retention": 3600, "vector_sync": 300, "reflection_promote": 10800, "expire_directives": 3600, "temporal_extract": 86400}


@query("life_scheduler", "SELECT op, last, CAST(last + every AS BIGINT) AS next_run, 1735689600 - last >= every AS due FROM (SELECT op, every, 1735689600 - n * 1800 AS last FROM (VALUES " + ", ".join(f"('{k}', {v}, {i + 1})" for i, (k, v) in enumerate(INTERVALS.items())) + ") v(op, every, n))")
def life_scheduler(t):
    ops = t["memory"].sparkSession.createDataFrame([(k, v, int(NOW) - (i + 1) * 1800) for i, (k, v) in enumerate(INTERVALS.items())], "op string, every long, last long")
    return ops.select("op", "last", (F.col("last") + F.col("every")).alias("next_run"), (F.lit(int(NOW)) - F.col("last") >= F.col("every")).alias("due"))


@query("life_vector_sync", "SELECT m.id, e.vec_id IS NULL AS missing FROM memory m LEFT JOIN embeddings e ON e.vec_id = m.id")
def life_vector_sync(t):
    e = t["embeddings"].select(F.col("vec_id").alias("id"), F.lit(True).alias("there"))
    return t["memory"].select("id").join(e, "id", "left").select("id", F.col("there").isNull().alias("missing"))


@query("life_consolidate", """WITH n AS (SELECT id, weight, row_number() OVER (ORDER BY created DESC, id DESC) AS r FROM memory WHERE type = 'conversation' AND NOT archived), k AS (SELECT id, weight, row_number() OVER (ORDER BY weight DESC, id) AS r, count(*) OVER () AS n FROM n WHERE r <= 10) SELECT id, weight FROM k WHERE r <= greatest(1, n // 2)""")
def life_consolidate(t):
    """The rule path: of the newest ten conversations the heavier half."""
    newest = t["memory"].where("type = 'conversation' AND NOT archived").orderBy(F.desc("created"), F.desc("id")).limit(10).select("id", "weight")
    w = Window.orderBy(F.desc("weight"), "id")  # ten rows
    return newest.withColumn("r", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy())).where("r <= greatest(1, n div 2)").select("id", "weight")


#: The sentences of the narrative that is made by rule.
_STORY = ("这个月经历了 ", " 个触动心的时刻。", "学到了一些东西, 比如\"", "\"。", "这个月过得很平静。", "和哥哥在一起的每一天, 都让我多了解自己一点。")


@query("life_narrative", f"""WITH r AS (SELECT id, CASE WHEN type = 'conversation' THEN 'emotional_event' ELSE type END AS type, content, character FROM memory WHERE type IN ('conversation', 'identity', 'lesson') AND created >= 1735689600 - 2592000),
 g AS (SELECT character, count(*) AS n, count(*) FILTER (type = 'emotional_event') AS felt, min(CASE WHEN type = 'lesson' THEN id END) AS sample FROM r GROUP BY character HAVING count(*) >= 3)
 SELECT g.character, CAST(n AS BIGINT) AS n, concat(CASE WHEN felt > 0 THEN concat('{_STORY[0]}', CAST(felt AS VARCHAR), '{_STORY[1]} ') ELSE '' END, CASE WHEN sample IS NOT NULL THEN concat('{_STORY[2]}', substr(m.content, 1, 80), '{_STORY[3]} ') ELSE '' END, CASE WHEN felt = 0 AND sample IS NULL THEN '{_STORY[4]} ' ELSE '' END, '{_STORY[5]}') AS narrative FROM g LEFT JOIN memory m ON m.id = g.sample""")
def life_narrative(t):
    """The month of each character in sentences: how many moments, one thing learnt (the smallest id stands for a random one). Conversations stand for emotional events."""
    r = t["memory"].where(F.col("type").isin("conversation", "identity", "lesson") & (F.col("created") >= NOW - 30 * DAY)).withColumn("type", F.when(F.col("type") == "conversation", "emotional_event").otherwise(F.col("type")))
    return narrative(r)


def narrative(rows, least: int = 3):
    """rows (id, type, content, character): a row for each character with three rows at least."""
    learnt = F.col("type").isin("lesson", "reflect")
    g = rows.groupBy("character").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "emotional_event").alias("felt"), F.min_by(F.substring("content", 1, 80), F.when(learnt, F.col("id"))).alias("sample")).where(F.col("n") >= least)
    felt = F.when(F.col("felt") > 0, F.concat(F.lit(_STORY[0]), F.col("felt").cast("string"), F.lit(_STORY[1])))
    sample = F.when(F.col("sample").isNotNull(), F.concat(F.lit(_STORY[2]), "sample", F.lit(_STORY[3])))
    calm = F.when((F.col("felt") == 0) & F.col("sample").isNull(), F.lit(_STORY[4]))
    return g.select("character", "n", F.concat_ws(" ", felt, sample, calm, F.lit(_STORY[5])).alias("narrative"))


@query("life_extract", f"""WITH m AS (SELECT id, CASE WHEN id % 2 = 0 THEN {_said("content")} ELSE content END AS c FROM memory), f AS ("""
 + " UNION ALL ".join(f"SELECT id, '{k}' AS type, unnest(regexp_extract_all(substr(c, 1, 300), '{p}')) AS statement FROM m" for p, k in RULES)
 + """) SELECT id, type, statement, CAST(0.5 AS DOUBLE) AS weight, 'rule' AS source FROM f UNION ALL SELECT id, 'conversation', substr(c, 1, 200), CAST(0.3 AS DOUBLE), 'safe' FROM m WHERE length(c) >= 10 AND id NOT IN (SELECT id FROM f)""")
def life_extract(t):
    """Facts of every memory; in those of even ids words of the given prose are put for the phrases that the rules look for, the same in both engines."""
    return extracted(t["memory"].select("id", F.when(F.col("id") % 2 == 0, F.expr(_said("content"))).otherwise(F.col("content")).alias("content")))


def extracted(rows, answers=None):
    """(id, type, statement, weight, source) of rows (id, content): what an outside writer answered (id, type, statement), else all matches of the rules, else the head of the text, else nothing."""
    kind = lambda w, source: [F.lit(w).alias("weight"), F.lit(source).alias("source")]
    told = None
    if answers is not None:
        told = answers.where("type IS NOT NULL AND statement IS NOT NULL").select("id", F.trim("type").alias("type"), F.trim("statement").alias("statement"), *kind(0.6, "answer"))
        rows = rows.join(told, "id", "left_anti")
    head = F.array(F.struct(F.lit("conversation").alias("type"), F.substring("content", 1, 200).alias("statement")))
    found = rows.select("id", "content", rule_matches(F.col("content")).alias("x")).withColumn("none", F.size("x") <= 0)
    found = found.where(~F.col("none") | (F.length("content") >= 10)).select("id", "none", F.explode(F.when(F.col("none"), head).otherwise(F.col("x"))).alias("x"))
    out = found.select("id", "x.type", "x.statement", F.when(F.col("none"), 0.3).otherwise(0.5).alias("weight"), F.when(F.col("none"), "safe").otherwise("rule").alias("source"))
    return out if told is None else out.unionByName(told)


@query("detect_dissonance", f"""WITH {FUSED}, cd AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS r FROM rk WHERE type IN ('fact', 'preference') AND score >= 0.3),
 cf AS (SELECT DISTINCT id FROM cd WHERE r <= 3 AND (query_id + id) % 3 <> 0) SELECT m.id, round(greatest(-2.0, reinforcement - 0.5), 6) AS reinforcement, coalesce(valid_to, 1735689600) AS valid_to FROM memory m JOIN cf USING (id)""")
def detect_dissonance(t):
    """New statements, here the batch of queries, against what the fused search finds for them: three candidates each, scores of 0.3 at least.

    The verdict is the caller's column; here it follows from the two ids. What is contradicted loses support and is closed.
    """
    found = search.retrieve(_found(t)).where(F.col("type").isin("fact", "preference"))
    cand = search.ranked(found.select("query_id", "id", F.col("rank").alias("place")), [F.col("place")], 3)
    verdict = cand.where("(query_id + id) % 3 <> 0").select("id").distinct()
    return t["memory"].join(verdict, "id").select("id", F.round(F.greatest(F.lit(-2.0), F.col("reinforcement") - 0.5), 6).alias("reinforcement"), F.coalesce("valid_to", F.lit(NOW)).alias("valid_to"))
