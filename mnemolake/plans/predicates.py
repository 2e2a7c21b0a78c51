"""Filters, guards and validation rules as expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import any_of, ascii_lower, first_of, like
from ..schema import INTENT_CUES
from ..rules import Rules
from .catalog import query

#: Words that ask for a recall; openings of trivial talk.
RECALL_CUES = ["记得", "上次", "之前", "回顾", "回忆", "我们聊过", "聊过", "关于", "最近", "查一下", "你记得", "之前说的", "上次说的", "提到", "说过", "remember", "recall", "earlier", "before", "previously", "what about", "you said", "last time", "do you remember"]
TRIVIAL = ["你好", "hello", "hi", "嗨", "早上好", "下午好", "晚上好", "晚安", "谢谢", "感谢", "好的", "ok", "嗯", "在吗", "拜拜", "再见", "辛苦了"]
#: Texts that are not worth storing.
SKIP = ["ok", "嗯", "好的", "hi", "hello"]
#: Openings of narration instead of an answer.
NARRATION = ["okay", "ok", "sure", "alright", "got it", "here", "below", "i am", "let me", "certainly", "sure,", "好的，", "好的,", "当然，", "当然,", "当然可以", "以下是", "下面是", "作为", "我是一个"]
#: Memory types that validate.
TYPES = ["fact", "conversation", "emotion", "reflection", "event", "task", "thought", "dream", "emotional_event", "emotion_label", "activity_reflection", "identity", "preference", "lesson", "milestone", "decision", "dissonance", "narrative", "philosophy", "audit", "self_discovery", "self_reflection", "inner_monologue", "thought_marker", "technological_discovery", "repair_test", "test", "user_trait"]
#: State kinds and their domain and type.
STATE_KINDS = [
    ("identity.name", "profile", "fact"), ("identity.nature", "profile", "fact"), ("identity.creator", "profile", "fact"), ("identity.created", "profile", "fact"), ("identity.vibe", "profile", "preference"), ("affect", "affect", "state"),
    ("relationship", "relation", "state"), ("vitality", "vitality", "state"), ("self_narrative", "narrative", "narrative"), ("metacog", "metacog", "state"), ("care", "care", "state"), ("curiosity", "curiosity", "state"),
]


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(text: str, words) -> str:
    return f"len(list_filter({_list(words)}, x -> contains({text}, x))) > 0"


def _starts(text: str, words) -> str:
    return f"len(list_filter({_list(words)}, x -> starts_with({text}, x))) > 0"


@query("like_search", "SELECT id, weight FROM memory WHERE contains(lower(content), 'the th') AND weight >= 0.3 AND NOT archived ORDER BY weight DESC, id DESC LIMIT 50")
def like_search(t):
    return t["memory"].where((F.col("weight") >= 0.3) & ~F.col("archived") & like(F.col("content"), F.lit("THE th"))).orderBy(F.desc("weight"), F.desc("id")).limit(50).select("id", "weight")


@query("like_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM memory WHERE contains(lower(content), 'tion') AND weight >= 0.3 AND NOT archived")
def like_count(t):
    return t["memory"].where((F.col("weight") >= 0.3) & ~F.col("archived") & like(F.col("content"), F.lit("tion"))).agg(F.count(F.lit(1)).alias("n"))


@query("filter_min_weight", "SELECT id FROM memory WHERE weight >= 0.5 AND NOT contains(content, 'stupid') AND NOT contains(content, 'idiot')")
def filter_min_weight(t):
    return t["memory"].where((F.col("weight") >= 0.5) & ~any_of(F.col("content"), ["stupid", "idiot"])).select("id")


@query("filter_known", "SELECT id, contains(content, 'erth') OR contains('the and of erth', content) AS known FROM memory")
def filter_known(t):
    return t["memory"].select("id", (F.col("content").contains("erth") | F.lit("the and of erth").contains(F.col("content"))).alias("known"))


@query("filter_valid", "SELECT id FROM memory WHERE valid_to IS NULL OR valid_to > 1735689600")
def filter_valid(t):
    return t["memory"].where("valid_to IS NULL OR valid_to > 1735689600").select("id")


_T = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"


@query("should_recall", f"""SELECT conv_id, turn, {_any("lower(text)", RECALL_CUES)} OR (NOT (length({_T}) < 20 AND {_starts(_T, TRIVIAL)}) AND length({_T}) >= 8) AS recall FROM conversations""")
def should_recall(t):
    s = F.btrim("text", F.lit(" \t\n\r"))
    trivial = (F.length(s) < 20) & _starting(s, TRIVIAL)
    return t["conversations"].select("conv_id", "turn", (any_of(F.lower("text"), RECALL_CUES) | (~trivial & (F.length(s) >= 8))).alias("recall"))


def _starting(c, words):
    out = F.lit(False)
    for w in words:
        out = out | F.startswith(c, F.lit(w))
    return out


@query("should_store", f"SELECT conv_id, turn, length({_T}) >= 6 AND NOT list_contains({_list(SKIP)}, lower({_T})) AS store FROM conversations")
def should_store(t):
    s = F.btrim("text", F.lit(" \t\n\r"))
    return t["conversations"].select("conv_id", "turn", ((F.length(s) >= 6) & ~F.lower(s).isin(SKIP)).alias("store"))


@query("guard", f"""SELECT conv_id, turn, list_filter([CASE WHEN {_starts(f"lower({_T})", NARRATION)} THEN 'narration' END, CASE WHEN starts_with({_T}, '{{') OR starts_with({_T}, '[') THEN 'json' END,
 CASE WHEN contains(text, '```') THEN 'fence' END, CASE WHEN length({_T}) > 800 THEN 'length' END], x -> x IS NOT NULL) AS errors FROM conversations""")
def guard(t):
    """Why a structured statement must not be stored; clean rows have an empty list."""
    s = F.btrim("text", F.lit(" \t\n\r"))
    codes = [(_starting(F.lower(s), NARRATION), "narration"), (F.startswith(s, F.lit("{")) | F.startswith(s, F.lit("[")), "json"), (F.col("text").contains("```"), "fence"), (F.length(s) > 800, "length")]
    return t["conversations"].select("conv_id", "turn", F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in codes))).alias("errors"))


@query("validate_memory", f"""SELECT id, list_filter([CASE WHEN length(trim(content)) = 0 THEN 'empty' END, CASE WHEN length(content) > 10000 THEN 'too_long' END, CASE WHEN NOT list_contains({_list(TYPES)}, type) THEN 'type' END,
 CASE WHEN weight < 0 OR weight > 1 THEN 'weight' END, CASE WHEN greatest(abs(pad_p), abs(pad_a), abs(pad_d)) > 0.99 THEN 'pad' END], x -> x IS NOT NULL) AS errors FROM memory""")
def validate_memory(t):
    """One code for each rule that a row fails."""
    return memory_rules().check(t["memory"]).select("id", "errors")


def memory_rules() -> Rules:
    """The rules that a memory is held against."""
    return Rules(
        {
            "empty": (lambda: F.length(F.trim("content")) == 0, "error"), "too_long": (lambda: F.length("content") > 10000, "warning"), "type": (lambda: ~F.col("type").isin(TYPES), "warning"),
            "weight": (lambda: (F.col("weight") < 0) | (F.col("weight") > 1), "warning"), "pad": (lambda: F.greatest(F.abs("pad_p"), F.abs("pad_a"), F.abs("pad_d")) > 0.99, "info"),
        }
    )


@query("validate_query", "SELECT query_id, CASE WHEN length(trim(q)) < 2 THEN 'short' WHEN length(q) > 500 THEN 'long' ELSE '' END AS error FROM queries_fts")
def validate_query(t):
    return t["queries_fts"].select("query_id", F.when(F.length(F.trim("q")) < 2, "short").when(F.length("q") > 500, "long").otherwise("").alias("error"))


@query("validate_entity", "SELECT id, entity IN ('user', 'self', 'relationship', 'world') AS valid FROM reflections")
def validate_entity(t):
    return t["reflections"].select("id", F.col("entity").isin("user", "self", "relationship", "world").alias("valid"))


@query("state_key", f"""WITH k AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in STATE_KINDS)}) v(key, domain, type)), e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'affect' WHEN 1 THEN 'care' WHEN 2 THEN 'identity.name' ELSE 'unknown' END AS key FROM events)
 SELECT event_id, key, domain, type FROM e LEFT JOIN k USING (key)""")
def state_key(t):
    kinds = t["events"].sparkSession.createDataFrame(STATE_KINDS, "key string, domain string, type string")
    key = F.when(F.col("event_id") % 4 == 0, "affect").when(F.col("event_id") % 4 == 1, "care").when(F.col("event_id") % 4 == 2, "identity.name").otherwise("unknown")
    return t["events"].select("event_id", key.alias("key")).join(F.broadcast(kinds), "key", "left").select("event_id", "key", "domain", "type")


@query("detect_intent", f"""SELECT conv_id, turn, CASE WHEN {_any("lower(text)", INTENT_CUES["WHY"])} THEN 'WHY' WHEN {_any("lower(text)", INTENT_CUES["WHEN"])} THEN 'WHEN' WHEN {_any("lower(text)", INTENT_CUES["ENTITY"])} THEN 'ENTITY' ELSE 'GENERAL' END AS intent FROM conversations""")
def detect_intent(t):
    return t["conversations"].select("conv_id", "turn", first_of(F.lower("text"), INTENT_CUES, "GENERAL").alias("intent"))


@query("filter_tags", "SELECT id FROM memory WHERE list_contains(string_split(tags, ','), 'v5_project:src1') AND list_contains(string_split(tags, ','), 'v5_domain:en')")
def filter_tags(t):
    """Facets matched whole: src1 is not src10."""
    tags = F.split("tags", r"[,\s]+")
    return t["memory"].where(F.array_contains(tags, "v5_project:src1") & F.array_contains(tags, "v5_domain:en")).select("id")


@query("filter_fold", "SELECT id, contains(lower(content), 'thnd') AS hit FROM memory")
def filter_fold(t):
    return t["memory"].select("id", ascii_lower(F.col("content")).contains("thnd").alias("hit"))
