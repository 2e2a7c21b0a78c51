"""Aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import first_of, repeat_grams
from ..operators.search import small
from .catalog import query

#: Categories of a trait and their words; the first category with a word wins.
TRAITS = {
    "communication_style": ["语气", "长度", "风格", "直接", "委婉", "短句", "详细"],
    "topic_preference": ["话题", "兴趣", "关注", "喜欢", "关心"],
    "response_pattern": ["回应", "沉默", "继续", "结束", "接话"],
    "emotional_tone": ["开心", "烦躁", "焦虑", "沉默", "高兴", "低落", "生气"],
    "work_style": ["工作", "代码", "项目", "调试", "技术"],
}


@query("agg_stats", """SELECT "by", key, n, n_long, avg_weight FROM (SELECT CASE WHEN grouping(type) = 0 THEN 'type' WHEN grouping(character) = 0 THEN 'character' ELSE 'all' END AS "by", coalesce(type, character, '') AS key, CAST(count(*) AS BIGINT) AS n,
 CAST(count(*) FILTER (long_term) AS BIGINT) AS n_long, round(avg(weight), 3) AS avg_weight FROM memory GROUP BY GROUPING SETS ((type), (character), ())) WHERE "by" <> 'character' OR key <> ''
 UNION ALL SELECT 'table', 'reflections', CAST(count(*) AS BIGINT), NULL, NULL FROM reflections UNION ALL SELECT 'table', 'events', CAST(count(*) AS BIGINT), NULL, NULL FROM events UNION ALL SELECT 'table', 'active_directives', CAST(count(*) FILTER (is_active) AS BIGINT), NULL, NULL FROM directives""")
def agg_stats(t):
    """One scan of the memories for totals, types and characters (but the empty one), and how many reflections, events and active directives there are."""
    g = t["memory"].groupingSets([["type"], ["character"], []], "type", "character").agg(F.count(F.lit(1)).alias("n"), F.count_if("long_term").alias("n_long"), F.round(F.avg("weight"), 3).alias("avg_weight"), F.grouping("type").alias("g_type"), F.grouping("character").alias("g_char"))
    by = F.when(F.col("g_type") == 0, "type").when(F.col("g_char") == 0, "character").otherwise("all")
    out = g.select(by.alias("by"), F.coalesce("type", "character", F.lit("")).alias("key"), "n", "n_long", "avg_weight").where("by <> 'character' OR key <> ''")
    for name, rows in (("reflections", t["reflections"]), ("events", t["events"]), ("active_directives", t["directives"].where("is_active"))):
        out = out.union(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("table"), F.lit(name), "n", F.lit(None).cast("long"), F.lit(None).cast("double")))
    return out


@query("agg_refl_stats", "SELECT status, CAST(count(*) AS BIGINT) AS n, round(avg(importance), 6) AS importance FROM reflections GROUP BY status")
def agg_refl_stats(t):
    return t["reflections"].groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("importance"), 6).alias("importance"))


@query("agg_dir_stats", "SELECT type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (is_active AND (expires_at = 0 OR expires_at > 1735689600)) AS BIGINT) AS n_active FROM directives GROUP BY type")
def agg_dir_stats(t):
    return t["directives"].groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("is_active AND (expires_at = 0 OR expires_at > 1735689600)")).alias("n_active"))


@query("agg_eg_stats", "SELECT (SELECT count(*) FROM eg_entities) AS entities, (SELECT count(*) FROM eg_aliases) AS aliases, (SELECT count(*) FROM eg_edges) AS edges, (SELECT count(*) FROM eg_episodic) AS episodic")
def agg_eg_stats(t):
    parts = [t[n].select(F.lit(n).alias("k")) for n in ("eg_entities", "eg_aliases", "eg_edges", "eg_episodic")]
    u = parts[0]
    for p in parts[1:]:
        u = u.union(p)
    return u.agg(*(F.count_if(F.col("k") == f"eg_{n}").alias(n) for n in ("entities", "aliases", "edges", "episodic")))


@query("agg_project_stats", "SELECT regexp_extract(tags, 'v5_project:([^,]*)', 1) AS project, regexp_extract(tags, 'v5_kind:([^,]*)', 1) AS kind, CAST(least(100, count(*)) AS BIGINT) AS n FROM memory GROUP BY 1, 2")
def agg_project_stats(t):
    return t["memory"].groupBy(F.regexp_extract("tags", "v5_project:([^,]*)", 1).alias("project"), F.regexp_extract("tags", "v5_kind:([^,]*)", 1).alias("kind")).agg(F.least(F.lit(100), F.count(F.lit(1))).cast("long").alias("n"))


@query("agg_distinct", "SELECT memory_id, CAST(count(DISTINCT entity_id) AS BIGINT) AS entity_count FROM eg_episodic_entities GROUP BY memory_id")
def agg_distinct(t):
    return t["eg_episodic_entities"].groupBy("memory_id").agg(F.count_distinct("entity_id").alias("entity_count"))


#: Words of the given prose that stand for a word of each category, the same in both engines.
_HINTS = {"communication_style": "ing and", "topic_preference": "es the", "response_pattern": "er of", "emotional_tone": "on in", "work_style": "ed to"}


def _has(text: str, category: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in [*TRAITS[category], _HINTS[category]]) + ")"


PROFILE = f"""WITH pc AS (SELECT id, CASE {" ".join(f"WHEN {_has('content', c)} THEN '{c}'" for c in TRAITS)} ELSE 'uncategorized' END AS category, weight, reinforcement, disputation, access_count, substr(content, 1, 30) AS head, created FROM (SELECT * REPLACE (substr(content, 1, 60) AS content) FROM memory WHERE type = 'user_trait' ORDER BY created DESC, id DESC LIMIT 200)),
 pq AS (SELECT *, weight * (1 + reinforcement - disputation) AS s FROM pc), pd AS (SELECT *, row_number() OVER (PARTITION BY category, head ORDER BY s DESC, id) AS dup FROM pq),
 pr AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY s DESC, id) AS rn FROM pd WHERE dup = 1),
 pf AS (SELECT category, id, CAST(rn AS INT) AS rn, round(least(0.95, weight + 0.1 * reinforcement), 2) AS confidence, CAST(least(50, access_count + 1) AS INT) AS observations FROM pr WHERE rn <= 5)"""


@query("agg_profile", PROFILE + " SELECT * FROM pf")
def agg_profile(t):
    """Per category the five strongest traits of the newest 200 (the feature's own bound), one for each head of 30 characters."""
    new = t["memory"].where("type = 'user_trait'").orderBy(F.desc("created"), F.desc("id")).limit(200)
    words = {c: [*w, _HINTS[c]] for c, w in TRAITS.items()}
    c = new.withColumn("category", first_of(F.substring("content", 1, 60), words, "uncategorized")).withColumn("head", F.substring("content", 1, 30)).withColumn("s", F.expr("weight * (1 + reinforcement - disputation)"))
    order = [F.desc("s"), F.col("id")]
    d = c.withColumn("dup", F.row_number().over(Window.partitionBy("category", "head").orderBy(*order))).where("dup = 1")
    r = d.withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where("rn <= 5")
    return r.select("category", "id", "rn", F.round(F.least(F.lit(0.95), F.col("weight") + 0.1 * F.col("reinforcement")), 2).alias("confidence"), F.least(F.lit(50), F.col("access_count") + 1).cast("int").alias("observations"))


@query("agg_votes", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c) SELECT user_id, event_type AS topic, CAST(n AS BIGINT) AS votes FROM r WHERE rn = 1")
def agg_votes(t):
    """The most frequent value, the earliest of equals."""
    c = t["events"].groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("f"))
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("f"))).alias("topic"), F.max("n").alias("votes"))


@query("agg_token_rarity", """WITH tk AS (SELECT DISTINCT query_id, unnest(list_distinct(string_split(lower(q), ' '))) AS token FROM queries_fts), d AS (SELECT DISTINCT token FROM tk WHERE length(token) >= 2)
 SELECT token, CAST(count(m.id) AS BIGINT) AS df FROM d LEFT JOIN memory m ON contains(lower(m.content), token) AND NOT m.archived GROUP BY token""")
def agg_token_rarity(t):
    """In how many live memories each query token stands as a substring: the tokens of the batch against all rows."""
    tokens = t["queries_fts"].select(F.explode(F.array_distinct(F.split(F.lower("q"), " "))).alias("token")).where(F.length("token") >= 2).distinct()
    low = t["memory"].where("NOT archived").select(F.lower("content").alias("low"))
    hits = low.join(small(tokens), F.col("low").contains(F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return tokens.join(hits, "token", "left").select("token", F.coalesce("df", F.lit(0)).alias("df"))


@query("agg_ngram_counts", """WITH w AS (SELECT character, turn, list_transform(list_filter(regexp_extract_all(text, '[a-zA-Z0-9_]+'), x -> length(x) > 1), x -> lower(x)) AS tk FROM responses),
 g AS (SELECT character, turn, array_to_string(tk[i : i + 4], ' ') AS ngram FROM w, unnest(range(1, len(tk) - 3)) AS u(i) WHERE len(tk) >= 5), c AS (SELECT character, turn, ngram, count(*) AS f FROM g GROUP BY ALL)
 SELECT character, ngram, CAST(round(sum(least(1.0, 0.1 * f)), 6) AS DOUBLE) AS weight, CAST(count(*) - 1 AS BIGINT) AS hit_count FROM c GROUP BY character, ngram""")
def agg_ngram_counts(t):
    """5-grams of each response: weight min(0.1 f, 1) a response; the first sighting counts no hit."""
    g = t["responses"].select("character", "turn", F.explode(repeat_grams(F.col("text"), 5)).alias("ngram")).groupBy("character", "turn", "ngram").agg(F.count(F.lit(1)).alias("f"))
    return g.groupBy("character", "ngram").agg(F.round(F.sum(F.least(F.lit(1.0), 0.1 * F.col("f"))), 6).alias("weight"), (F.count(F.lit(1)) - 1).alias("hit_count"))


@query("agg_rep_stats", "SELECT character, CAST(count(*) AS BIGINT) AS n, CAST(max(turn) AS BIGINT) AS last_turn FROM responses GROUP BY character")
def agg_rep_stats(t):
    return t["responses"].groupBy("character").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn"))


@query("agg_approx")
def agg_approx(t):
    """Sketches in one pass: distinct parts, the most frequent flags with their counts, medians by two methods."""
    top = F.expr("approx_top_k(l_returnflag, 3)")
    kll = F.expr("kll_sketch_get_quantile_double(kll_sketch_agg_double(CAST(l_extendedprice AS DOUBLE)), 0.5D)")
    return t["lineitem"].agg(F.approx_count_distinct("l_partkey").alias("parts"), F.approx_percentile("l_quantity", 0.5).alias("median_quantity"), top.alias("frequent"), kll.alias("median_price"))


@query("keep_n_newest", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) SELECT user_id, event_id FROM r WHERE rn <= 20")
def keep_n_newest(t):
    return t["events"].withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).where("rn <= 20").select("user_id", "event_id")


@query("topk_per_group", "WITH r AS (SELECT type, id, weight, row_number() OVER (PARTITION BY type ORDER BY weight DESC, id) AS rn FROM memory) SELECT type, id, weight, CAST(rn AS INT) AS rn FROM r WHERE rn <= 5")
def topk_per_group(t):
    return t["memory"].withColumn("rn", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("weight"), "id"))).where("rn <= 5").select("type", "id", "weight", "rn")


@query("running_budget", """WITH c AS (SELECT id, type, weight, greatest(1, length(content)) AS tokens FROM memory), s AS (SELECT *, row_number() OVER w AS rn, sum(tokens) OVER (PARTITION BY type ORDER BY weight DESC, id ROWS UNBOUNDED PRECEDING) AS run FROM c WINDOW w AS (PARTITION BY type ORDER BY weight DESC, id))
 SELECT type, id, CAST(rn AS INT) AS rn, CAST(run AS BIGINT) AS used FROM s WHERE run <= 12000 OR rn = 1""")
def running_budget(t):
    """Rows in score order until the first that does not fit; the first always stays. Running sums never fall, so no row after it fits."""
    w = Window.partitionBy("type").orderBy(F.desc("weight"), "id")
    s = t["memory"].select("id", "type", "weight", F.greatest(F.lit(1), F.length("content")).alias("tokens"))
    s = s.withColumn("rn", F.row_number().over(w)).withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.where("used <= 12000 OR rn = 1").select("type", "id", "rn", "used")


@query("first_last", "SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS last_user, CAST(max(turn) AS BIGINT) AS turns FROM conversations GROUP BY conv_id")
def first_last(t):
    return t["conversations"].groupBy("conv_id").agg(F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("last_user"), F.max("turn").alias("turns"))


@query("adjacent_dedup", """WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, event_id, event_type FROM e WHERE p IS NULL OR p <> event_type""")
def adjacent_dedup(t):
    e = t["events"].select("user_id", "event_id", "event_type", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("p"))
    return e.where("p IS NULL OR p <> event_type").drop("p")


@query("lag_gap", "SELECT event_id, user_id, round(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) AS gap_s FROM interactions")
def lag_gap(t):
    return t["interactions"].select("event_id", "user_id", F.round(F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), 3).alias("gap_s"))


@query("paging", "SELECT id FROM memory ORDER BY id LIMIT 20 OFFSET 40")
def paging(t):
    return t["memory"].select("id").orderBy("id").offset(40).limit(20)


@query("set_token_overlap", """SELECT a.id AS a, b.id AS b, CAST(len(list_intersect(string_split(a.tags, ','), string_split(b.tags, ','))) AS INT) AS overlap FROM memory a JOIN memory b ON b.id = a.id + 4""")
def set_token_overlap(t):
    b = t["memory"].select((F.col("id") - 4).alias("id"), F.col("id").alias("b"), F.col("tags").alias("t2"))
    return t["memory"].join(b, "id").select(F.col("id").alias("a"), "b", F.size(F.array_intersect(F.split("tags", ","), F.split("t2", ","))).alias("overlap"))


@query("set_union_sources", "SELECT id, CAST(count(*) AS BIGINT) AS paths, round(max(s), 6) AS best FROM (SELECT id, weight AS s FROM memory UNION ALL SELECT id, delta_rein FROM evidence UNION ALL SELECT source, weight FROM project_edges) GROUP BY id")
def set_union_sources(t):
    u = t["memory"].select("id", F.col("weight").alias("s")).union(t["evidence"].select("id", "delta_rein")).union(t["project_edges"].select("source", "weight"))
    return u.groupBy("id").agg(F.count(F.lit(1)).alias("paths"), F.round(F.max("s"), 6).alias("best"))


@query("set_except", "SELECT id FROM memory WHERE weight < 0.45 EXCEPT SELECT id FROM memory WHERE access_count >= 2 OR reinforcement >= 1")
def set_except(t):
    m = t["memory"]
    return m.where("weight < 0.45").select("id").join(m.where("access_count >= 2 OR reinforcement >= 1").select("id"), "id", "left_anti").distinct()


@query("emotion_search", """WITH m AS (SELECT id, CASE WHEN id % 8 = 0 THEN 'emotional_event' ELSE 'emotion_label' END AS type, content, tags FROM memory WHERE type IN ('conversation', 'lesson')),
 r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id DESC) AS rn FROM m) SELECT id, type FROM r WHERE rn <= 200 AND contains(concat(content, ' ', tags), 'src1') ORDER BY type DESC, rn LIMIT 15""")
def emotion_search(t):
    """The newest 200 events, then the newest 200 labels, those with the tag, first 15. Two types of the table stand for these."""
    m = t["memory"].where(F.col("type").isin("conversation", "lesson")).withColumn("type", F.when(F.col("type") == "conversation", "emotional_event").otherwise("emotion_label"))
    return by_emotion(m, "src1", 15)


def by_emotion(memory, tag: str, k: int):
    r = memory.where(F.col("type").isin("emotional_event", "emotion_label")).withColumn("rn", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("id")))).where("rn <= 200")
    return r.where(F.concat_ws(" ", "content", "tags").contains(tag)).orderBy(F.desc("type"), "rn").limit(k).select("id", "type")
