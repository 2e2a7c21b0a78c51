"""Scalar text and mathematics functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import NOW
from .catalog import query
from .predicates import _any, _list

#: Words by emotion, in order of priority, and the words of a question.
EMOTIONS = {
    "烦躁": ["烦", "讨厌", "崩溃", "又", "怎么又", "受不了", "气死", "靠", "妈的", "fuck", "shit", "damn", "wtf", "垃圾", "bug", "卡死", "挂了", "报错", "又坏了", "服了", "无语", "裂开", "炸了", "不行", "失败", "还是不行", "又报错了"],
    "悲伤": ["难过", "伤心", "哭", "呜呜", "唉", "哎", "sigh", "sad", "失落", "孤独", "寂寞", "累了", "好累", "不想"],
    "开心": ["哈哈", "呵呵", "开心", "高兴", "太好了", "棒", "厉害", "赞", "牛", "喜欢", "爱", "好耶", "nice", "great", "awesome", "wow", "优秀", "漂亮", "完美", "耶", "666", "好呀", "真好", "不错", "nb", "tql", "太强了"],
    "感谢": ["谢谢", "感谢", "多谢", "辛苦了", "麻烦了", "thank", "thanks", "thx", "appreciate", "感恩", "多谢了", "帮大忙"],
    "好奇": ["为什么", "怎么", "如何", "什么", "能不能", "可以吗", "请问", "想知道", "好奇", "怎么回事", "why", "how", "what", "是不是", "真的吗", "是吗", "啥意思", "没懂", "什么意思"],
}
QUESTIONS = ["为什么", "怎么回", "如何", "什么", "是不是", "可以吗", "能不能", "怎么回事", "为啥"]
AGAIN, AGAIN_WITH, STILL = ["又"], ["报错", "失败", "坏", "卡", "崩", "错", "bug", "不行"], ["怎么又", "还是不行"]
#: Patterns of a task.
TASK = [r"[A-Za-z]:\\|\\\\", r"\.py\b|\.ts\b|\.js\b|\.rs\b", "```", r"\/\/|\/\*", "def |class |import |from ", r"git\s+\w+"]
TASK_WORDS = ["refactor", "debug", "fix", "implement", "write", "create", "analyze", "compare", "summarize", "explain"]
#: Lines that say nothing.
FILLERS = ["好的。", "好的", "嗯。", "嗯", "哦。", "哦", "啊。", "好的好的", "明白了。", "明白了", "收到。", "收到", "ok。", "ok", "okay"]
#: Window titles and what one does there; the first that fits wins.
WINDOWS = [("visual studio", "code"), ("code", "code"), ("chrome", "web"), ("discord", "chat"), ("steam", "game"), ("word", "document"), ("terminal", "terminal")]
#: Labels of the affect axes and of vitality, by threshold.
PLEASURE = [(-1.0, "低落"), (-0.5, "低沉"), (-0.1, "平和"), (0.1, "愉悦"), (0.5, "欣喜")]
AROUSAL = [(-1.0, "困倦"), (-0.5, "放松"), (-0.1, "平静"), (0.1, "专注"), (0.5, "兴奋")]
DOMINANCE = [(-1.0, "顺从"), (-0.5, "乖巧"), (-0.1, "中立"), (0.1, "自信"), (0.5, "强势")]


def _case(value: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {a} THEN '{n}'" for a, n in reversed(table)) + f" ELSE '{table[0][1]}' END"


_S = r"trim(regexp_replace(content, '\s+', ' ', 'g'))"


@query("str_probe", f"SELECT id, CASE " + " ".join(f"WHEN instr({_S}, '{c}') - 1 BETWEEN 6 AND 24 THEN substr({_S}, 1, instr({_S}, '{c}') - 1)" for c in "，。；;！？") + f" ELSE substr({_S}, 1, 14) END AS probe FROM memory")
def str_probe(t):
    return t["memory"].select("id", X.probe(F.col("content")).alias("probe"))


@query("str_tok_cjk2", "SELECT query_id, list_filter(list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+(?:-[a-z0-9]+)*')), x -> length(x) >= 2).list_sort() AS tokens FROM queries_fts")
def str_tok_cjk2(t):
    return t["queries_fts"].select("query_id", F.array_sort(F.filter(X.query_tokens(F.col("q")), lambda w: w.rlike("^[a-z0-9]"))).alias("tokens"))


@query("str_tok_tree", "SELECT node_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9一-龥]+'), x -> length(x) > 1) AS tokens FROM turns")
def str_tok_tree(t):
    return t["turns"].select("node_id", X.tree_tokens(F.col("text")).alias("tokens"))


@query("str_tok_rep", "SELECT character, turn, list_transform(list_filter(regexp_extract_all(text, '[a-zA-Z0-9_]+'), x -> length(x) > 1), x -> lower(x)) AS tokens FROM responses")
def str_tok_rep(t):
    return t["responses"].select("character", "turn", X.repeat_tokens(F.col("text")).alias("tokens"))


@query("str_ngrams", """WITH w AS (SELECT character, turn, list_transform(list_filter(regexp_extract_all(text, '[a-zA-Z0-9_]+'), x -> length(x) > 1), x -> lower(x)) AS tk FROM responses)
 SELECT character, turn, CASE WHEN len(tk) >= 5 THEN list_transform(range(1, len(tk) - 3), i -> array_to_string(tk[i : i + 4], ' ')) ELSE [] END AS grams FROM w""")
def str_ngrams(t):
    return t["responses"].select("character", "turn", X.repeat_grams(F.col("text"), 5).alias("grams"))


@query("str_topic", "SELECT event_id, user_id, regexp_extract_all(text, '[一-鿿]{2,6}')[1:5] AS topics FROM interactions")
def str_topic(t):
    return t["interactions"].select("event_id", "user_id", F.slice(F.regexp_extract_all("text", F.lit("[一-鿿]{2,6}"), F.lit(0)), 1, 5).alias("topics"))


@query("str_norm_entity", r"SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(concat(p_brand, ' (', p_type, ')')), '\([^)]*\)', '', 'g'), '[\s_—-]+', '', 'g') AS norm FROM part")
def str_norm_entity(t):
    """Lower case, full-width to half-width, parentheses and separators dropped."""
    wide, narrow = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    s = F.translate(F.lower(F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")"))), wide, narrow)
    return t["part"].select(F.col("p_partkey").alias("id"), F.regexp_replace(F.regexp_replace(s, r"\([^)]*\)", ""), r"[\s_—-]+", "").alias("norm"))


@query("str_alias", r"SELECT p_partkey AS id, regexp_extract(s, '([A-Za-z0-9#]+) \(aka ([^)]+)\)', 1) AS name, regexp_extract(s, '([A-Za-z0-9#]+) \(aka ([^)]+)\)', 2) AS alias FROM (SELECT p_partkey, concat(p_brand, ' (aka ', p_type, ')') AS s FROM part)")
def str_alias(t):
    s = F.concat("p_brand", F.lit(" (aka "), "p_type", F.lit(")"))
    return t["part"].select(F.col("p_partkey").alias("id"), F.regexp_extract(s, r"([A-Za-z0-9#]+) \(aka ([^)]+)\)", 1).alias("name"), F.regexp_extract(s, r"([A-Za-z0-9#]+) \(aka ([^)]+)\)", 2).alias("alias"))


_CLASS = " ".join(f"WHEN regexp_matches(text, '{p}') THEN 'task'" for p in TASK)


@query("str_classify", f"SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'conversation' {_CLASS} WHEN {_any('lower(text)', TASK_WORDS)} THEN 'task' ELSE 'conversation' END AS kind FROM conversations")
def str_classify(t):
    task = X.any_of(F.lower("text"), TASK_WORDS)
    for p in TASK:
        task = task | F.col("text").rlike(p)
    return t["conversations"].select("conv_id", "turn", F.when(F.trim("text") == "", "conversation").when(task, "task").otherwise("conversation").alias("kind"))


@query("str_emotion", f"""SELECT event_id, CASE WHEN {_any("text", AGAIN)} AND {_any("text", AGAIN_WITH)} OR {_any("text", STILL)} THEN '烦躁' WHEN {_any("text", QUESTIONS)} AND {_any("text", EMOTIONS["好奇"])} THEN '好奇' """ + " ".join(f"WHEN {_any('text', w)} THEN '{k}'" for k, w in EMOTIONS.items()) + " ELSE '平静' END AS emotion FROM (SELECT event_id, lower(text) AS text FROM interactions)")
def str_emotion(t):
    x = F.lower("text")
    again = X.any_of(x, AGAIN) & X.any_of(x, AGAIN_WITH) | X.any_of(x, STILL)
    asks = X.any_of(x, QUESTIONS) & X.any_of(x, EMOTIONS["好奇"])
    return t["interactions"].select("event_id", F.when(again, "烦躁").when(asks, "好奇").otherwise(X.first_of(x, EMOTIONS, "平静")).alias("emotion"))


@query("str_activity", "SELECT page_id, CASE " + " ".join(f"WHEN contains(lower(html), '{k}') THEN '{v}'" for k, v in WINDOWS) + " END AS activity FROM pages")
def str_activity(t):
    out = F.lit(None).cast("string")
    for k, v in reversed(WINDOWS):
        out = F.when(F.lower("html").contains(k), v).otherwise(out)
    return t["pages"].select("page_id", out.alias("activity"))


@query("str_category", f"SELECT event_id, CASE WHEN {_any('text', ['谢谢', '太好了'])} THEN 'warm' WHEN {_any('text', ['失败', '烦'])} THEN 'cold' ELSE 'uncategorized' END AS category FROM interactions")
def str_category(t):
    return t["interactions"].select("event_id", X.first_of(F.col("text"), {"warm": ["谢谢", "太好了"], "cold": ["失败", "烦"]}, "uncategorized").alias("category"))


@query("str_remember", "SELECT event_id, CASE unit WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END * CAST(n AS BIGINT) + 1735689600 AS due FROM (SELECT event_id, regexp_extract(s, '([0-9]+)([mhd])', 1) AS n, regexp_extract(s, '([0-9]+)([mhd])', 2) AS unit FROM (SELECT event_id, concat('remind me in ', CAST(event_id % 9 + 1 AS VARCHAR), CASE event_id % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'h' ELSE 'd' END) AS s FROM events))")
def str_remember(t):
    s = F.concat(F.lit("remind me in "), (F.col("event_id") % 9 + 1).cast("string"), F.when(F.col("event_id") % 3 == 0, "m").when(F.col("event_id") % 3 == 1, "h").otherwise("d"))
    n, unit = F.regexp_extract(s, "([0-9]+)([mhd])", 1).cast("long"), F.regexp_extract(s, "([0-9]+)([mhd])", 2)
    return t["events"].select("event_id", (F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(86400) * n + int(NOW)).cast("long").alias("due"))


@query("str_frontmatter", r"SELECT id, regexp_extract(doc, 'name: ([^\n]*)', 1) AS name, regexp_extract(doc, 'description: ([^\n]*)', 1) AS description, length(regexp_replace(doc, '^---\n(?:[^\n]*\n)*?---\n', '')) AS body_chars FROM (SELECT id, concat('---', chr(10), 'name: ', name, chr(10), 'description: ', description, chr(10), '---', chr(10), body) AS doc FROM skills)")
def str_frontmatter(t):
    doc = F.concat(F.lit("---\nname: "), "name", F.lit("\ndescription: "), "description", F.lit("\n---\n"), "body")
    meta = F.str_to_map(F.regexp_extract(doc, r"^---\n((?:[^\n]*\n)*?)---\n", 1), F.lit("\n"), F.lit(": "))
    return t["skills"].select("id", meta["name"].alias("name"), meta["description"].alias("description"), F.length(F.regexp_replace(doc, r"^---\n(?:[^\n]*\n)*?---\n", "")).cast("long").alias("body_chars"))


_LINES = f"list_filter(list_transform(string_split(content, chr(10)), x -> trim(x)), x -> length(x) >= 2 AND NOT list_contains({_list(FILLERS)}, x))"


@query("str_compress", rf"""WITH k AS (SELECT id, content, {_LINES} AS l FROM memory), d AS (SELECT id, length(content) AS n, trim(regexp_replace(array_to_string(list_transform(list_filter(range(1, len(l) + 1), i -> i = 1 OR l[i] <> l[i - 1]), i -> l[i]), chr(10)), '\s+', ' ', 'g')) AS s FROM k),
 f AS (SELECT id, n, regexp_replace(s, '(\s*[，。、；：,.!?])(?:\s*[，。、；：,.!?]+\s*)+', '\1', 'g') AS s FROM d), g AS (SELECT id, n, s, greatest(1, CAST(floor(n * 0.5) AS BIGINT)) AS target FROM f),
 h AS (SELECT *, greatest(1, CAST(floor(length(s) * (greatest(1, target // 2) / greatest(1, length(s)))) AS BIGINT)) AS half FROM g)
 SELECT id, CASE WHEN n >= 40 AND greatest(1, length(s)) > target THEN concat(substr(s, 1, half), ' … ', right(s, half)) ELSE s END AS short FROM h""")
def str_compress(t):
    """Drop fillers and repeated lines, collapse spaces and runs of marks, then cut the middle to half the size."""
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 2) & ~x.isin(FILLERS))
    k = t["memory"].select("id", F.length("content").alias("n"), lines.alias("l"))
    k = k.select("id", "n", F.filter("l", lambda x, i: (i == 0) | (x != F.get("l", i - 1))).alias("l"))
    s = F.regexp_replace(X.collapse(F.array_join("l", "\n")), r"(\s*[，。、；：,.!?])(?:\s*[，。、；：,.!?]+\s*)+", "$1")
    k = k.select("id", "n", s.alias("s")).withColumn("target", F.greatest(F.lit(1), F.floor(F.col("n") * 0.5)))
    k = k.withColumn("half", F.greatest(F.lit(1), F.floor(F.length("s") * (F.greatest(F.lit(1), F.floor(F.col("target") / 2)) / F.greatest(F.lit(1), F.length("s"))))).cast("int"))
    cut = F.concat(F.col("s").substr(F.lit(1), F.col("half")), F.lit(" … "), F.right("s", F.col("half")))
    return k.select("id", F.when((F.col("n") >= 40) & (F.greatest(F.lit(1), F.length("s")) > F.col("target")), cut).otherwise(F.col("s")).alias("short"))


@query("str_esttok", "SELECT id, CAST(greatest(1, length(content)) AS BIGINT) AS est, CAST(length(regexp_replace(content, '[^一-鿿]', '', 'g')) + floor(1.3 * len(regexp_extract_all(content, '[a-zA-Z]+'))) AS BIGINT) AS mixed FROM memory")
def str_esttok(t):
    return t["memory"].select("id", F.greatest(F.lit(1), F.length("content")).cast("long").alias("est"), (F.length(F.regexp_replace("content", "[^一-鿿]", "")) + F.floor(1.3 * F.regexp_count("content", F.lit("[a-zA-Z]+")))).cast("long").alias("mixed"))


@query("str_summary", "SELECT conv_id, substr(min_by(text, turn), 1, 80) AS summary FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id")
def str_summary(t):
    return t["conversations"].where("role = 'user' AND trim(text) <> ''").groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 80).alias("summary"))


@query("str_clean_profile", "SELECT id, trim(regexp_replace(content, '^(Is|In|The) ', '')) AS line FROM memory WHERE weight >= 0.7 AND length(content) <= 2000 AND type IN ('preference', 'user_trait')")
def str_clean_profile(t):
    return t["memory"].where("weight >= 0.7 AND length(content) <= 2000 AND type IN ('preference', 'user_trait')").select("id", F.trim(F.regexp_replace("content", "^(Is|In|The) ", "")).alias("line"))


@query("str_json_array", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def str_json_array(t):
    """A JSON object out of fenced or padded output."""
    padded = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return t["events"].select("event_id", F.from_json(F.regexp_extract(padded, r"(?s)(\{.*\})", 1), "k long")["k"].alias("k"))


@query("json_payload", "SELECT id, concat('{\"id\":', CAST(id AS VARCHAR), ',\"type\":\"', type, '\"}') AS payload FROM memory")
def json_payload(t):
    return t["memory"].select("id", F.to_json(F.struct("id", "type")).alias("payload"))


@query("date_period", f"SELECT id, CASE WHEN h < 5 THEN '深夜' WHEN h < 8 THEN '清晨' WHEN h < 11 THEN '上午' WHEN h < 13 THEN '中午' WHEN h < 18 THEN '下午' WHEN h < 22 THEN '晚上' ELSE '深夜' END AS period FROM (SELECT id, CAST(floor(created / 3600) AS BIGINT) + 8 - 24 * ((CAST(floor(created / 3600) AS BIGINT) + 8) // 24) AS h FROM memory)")
def date_period(t):
    return t["memory"].select("id", X.period(F.pmod(F.floor(F.col("created") / 3600) + 8, F.lit(24))).alias("period"))


@query("date_gap", """SELECT id, CASE WHEN g < 60 THEN '刚刚' WHEN g < 3600 THEN concat(CAST(CAST(floor(g / 60) AS BIGINT) AS VARCHAR), '分钟') WHEN g < 86400 THEN CASE WHEN floor((g % 3600) / 60) > 0 THEN concat(CAST(CAST(floor(g / 3600) AS BIGINT) AS VARCHAR), '小时', CAST(CAST(floor((g % 3600) / 60) AS BIGINT) AS VARCHAR), '分') ELSE concat(CAST(CAST(floor(g / 3600) AS BIGINT) AS VARCHAR), '小时') END
 ELSE concat(CAST(CAST(floor(g / 86400) AS BIGINT) AS VARCHAR), '天') END AS gap FROM (SELECT id, 1735689600 - created AS g FROM memory)""")
def date_gap(t):
    return t["memory"].select("id", X.gap(F.lit(NOW) - F.col("created")).alias("gap"))


@query("date_tempo", r"SELECT id, regexp_extract(s, '(\d{4}-\d{2}-\d{2})', 1) AS day FROM (SELECT o_orderkey AS id, concat('due ', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), ' ', o_orderpriority) AS s FROM orders)")
def date_tempo(t):
    s = F.concat(F.lit("due "), F.to_date("o_orderdate").cast("string"), F.lit(" "), "o_orderpriority")
    return t["orders"].select(F.col("o_orderkey").alias("id"), F.regexp_extract(s, r"(\d{4}-\d{2}-\d{2})", 1).alias("day"))


@query("math_halflife", """SELECT id, round(r, 6) AS reinforcement, round(d, 6) AS disputation, round(r - d, 6) AS evidence FROM (SELECT id, CASE WHEN days > 0 THEN reinforcement * pow(0.5, days / 14.0) ELSE reinforcement END AS r, CASE WHEN days > 0 THEN disputation * pow(0.5, days / 7.0) ELSE disputation END AS d
 FROM (SELECT *, CASE WHEN last_accessed > 0 THEN (1735689600 - last_accessed) / 86400.0 ELSE 0 END AS days FROM memory))""")
def math_halflife(t):
    days = F.when(F.col("last_accessed") > 0, (F.lit(NOW) - F.col("last_accessed")) / 86400.0).otherwise(0.0)
    half = lambda v, h: F.when(days > 0, F.col(v) * F.pow(F.lit(0.5), days / h)).otherwise(F.col(v))
    m = t["memory"].select("id", half("reinforcement", 14.0).alias("r"), half("disputation", 7.0).alias("d"))
    return m.select("id", F.round("r", 6).alias("reinforcement"), F.round("d", 6).alias("disputation"), F.round(F.col("r") - F.col("d"), 6).alias("evidence"))


EI_SQL = "greatest(0.0, least(1.0, weight)) * (1 + least(0.5, reinforcement * 0.5)) * greatest(1, length(bin(access_count + 1))) * CASE WHEN last_accessed > 0 THEN pow(0.5, greatest(0, (1735689600 - last_accessed) / 86400.0) / 30.0) ELSE 1.0 END"


@query("math_ei", f"SELECT id, round({EI_SQL}, 6) AS ei FROM memory")
def math_ei(t):
    return t["memory"].select("id", F.round(X.importance(F.col("weight"), F.col("access_count"), F.col("last_accessed"), NOW, F.col("reinforcement")), 6).alias("ei"))


@query("math_label", f"SELECT id, {_case('pad_p', PLEASURE)} AS pleasure, {_case('pad_a', AROUSAL)} AS arousal, {_case('pad_d', DOMINANCE)} AS dominance FROM memory")
def math_label(t):
    return t["memory"].select("id", X.step_label(F.col("pad_p"), PLEASURE).alias("pleasure"), X.step_label(F.col("pad_a"), AROUSAL).alias("arousal"), X.step_label(F.col("pad_d"), DOMINANCE).alias("dominance"))


@query("math_mood", "SELECT id, CASE WHEN pad_p > 0.15 AND pad_a > 0.1 THEN '开心' WHEN pad_p > 0.15 THEN '愉悦' WHEN pad_p < -0.15 THEN '低落' WHEN pad_a > 0.25 THEN '专注' ELSE '平静' END AS mood FROM memory")
def math_mood(t):
    p, a = F.col("pad_p"), F.col("pad_a")
    return t["memory"].select("id", F.when((p > 0.15) & (a > 0.1), "开心").when(p > 0.15, "愉悦").when(p < -0.15, "低落").when(a > 0.25, "专注").otherwise("平静").alias("mood"))


@query("math_mood_tags", """SELECT id, list_filter([CASE WHEN pad_p > 0.15 THEN CASE WHEN pad_a > 0.1 THEN '开心' ELSE '愉悦' END WHEN pad_p < -0.15 THEN CASE WHEN pad_a > -0.05 THEN '难过' ELSE '低落' END END, CASE WHEN pad_a > 0.25 THEN '专注' END, CASE WHEN NOT (pad_p > 0.15 OR pad_p < -0.15 OR pad_a > 0.25) THEN '平静' END], x -> x IS NOT NULL) AS tags FROM memory""")
def math_mood_tags(t):
    p, a = F.col("pad_p"), F.col("pad_a")
    first = F.when(p > 0.15, F.when(a > 0.1, "开心").otherwise("愉悦")).when(p < -0.15, F.when(a > -0.05, "难过").otherwise("低落"))
    return t["memory"].select("id", F.array_compact(F.array(first, F.when(a > 0.25, F.lit("专注")), F.when(~((p > 0.15) | (p < -0.15) | (a > 0.25)), F.lit("平静")))).alias("tags"))


@query("math_lorenz", "WITH RECURSIVE l AS (SELECT doc_id AS id, 0 AS i, CAST(1 + (doc_id % 5) * 0.1 AS DOUBLE) AS x, CAST(1 AS DOUBLE) AS y, CAST(20 AS DOUBLE) AS z FROM documents UNION ALL SELECT id, i + 1, x + 0.01 * 10.0 * (y - x), y + 0.01 * (x * (28.0 - z) - y), z + 0.01 * (x * y - (8.0 / 3.0) * z) FROM l WHERE i < 40) SELECT id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM l WHERE i = 40")
def math_lorenz(t):
    """The system of every document."""
    return lorenz(t["documents"])


def lorenz(documents):
    """Euler steps of the Lorenz system as a fold over a sequence."""
    start = F.struct((1 + (F.col("doc_id") % 5) * F.lit(0.1)).cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(20.0).alias("z"))
    step = lambda s, _: F.struct((s["x"] + 0.01 * 10.0 * (s["y"] - s["x"])).alias("x"), (s["y"] + 0.01 * (s["x"] * (28.0 - s["z"]) - s["y"])).alias("y"), (s["z"] + 0.01 * (s["x"] * s["y"] - (8.0 / 3.0) * s["z"])).alias("z"))
    out = documents.select(F.col("doc_id").alias("id"), F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, step).alias("s"))
    return out.select("id", *(F.round(f"s.{c}", 4).alias(c) for c in "xyz"))


@query("math_eca", """WITH RECURSIVE s AS (SELECT doc_id AS id, 0 AS i, list_transform(range(0, 64), k -> CAST((((doc_id % 1000003) * 7919 + k * 104729) // 64) % 2 AS INT)) AS c FROM documents
 UNION ALL SELECT id, i + 1, list_transform(range(1, 65), k -> CASE c[(k + 62) % 64 + 1] * 4 + c[k] * 2 + c[k % 64 + 1] WHEN 0 THEN 0 WHEN 4 THEN 0 WHEN 7 THEN 0 ELSE 1 END) FROM s WHERE i < 16) SELECT id, CAST(list_sum(c) AS DOUBLE) / 64 AS live FROM s WHERE i = 16""")
def math_eca(t):
    """Rule 110 over a ring of 64 cells, 16 steps, seeded by the id; share of live cells."""
    ring = F.sequence(F.lit(0), F.lit(63))
    seed = F.transform(ring, lambda i: (F.floor(((F.col("doc_id") % 1000003) * 7919 + i * 104729) / 64) % 2).cast("int"))
    rule = lambda s: F.transform(ring, lambda i: F.element_at(F.array(*(F.lit(int(b)) for b in f"{110:08b}"[::-1])), F.element_at(s, F.pmod(i - 1, F.lit(64)) + 1) * 4 + F.element_at(s, i + 1) * 2 + F.element_at(s, F.pmod(i + 1, F.lit(64)) + 1) + 1))
    cells = F.aggregate(F.sequence(F.lit(1), F.lit(16)), seed, lambda s, _: rule(s))
    return t["documents"].select(F.col("doc_id").alias("id"), (F.aggregate(cells, F.lit(0), lambda a, b: a + b) / 64).alias("live"))


@query("math_ais", """WITH d AS (SELECT vec_id AS det, embedding AS v FROM embeddings WHERE vec_id < 10) SELECT e.vec_id AS id, round(least(1.0, greatest(0.0, min((sqrt(list_sum(list_transform(list_zip(e.embedding, d.v), x -> (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))) - 0.5) / 1.5))), 4) AS novelty FROM embeddings e, d GROUP BY e.vec_id""")
def math_ais(t):
    """Novelty: the distance to the nearest of ten detectors beyond its radius, scaled and clamped. The detectors are a list of bounded size, so one scan does."""
    dets = t["embeddings"].where("vec_id < 10").agg(F.collect_list("embedding").alias("dets"))
    dist = lambda v: (F.sqrt(F.aggregate(F.zip_with("embedding", v, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda a, b: a + b)) - 0.5) / 1.5
    e = t["embeddings"].join(F.broadcast(dets))
    return e.select(F.col("vec_id").alias("id"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.array_min(F.transform("dets", dist)))), 4).alias("novelty"))


@query("hash_id", "SELECT id, left(sha256(content), 16) AS hash FROM memory")
def hash_id(t):
    return t["memory"].select("id", F.left(F.sha2("content", 256), F.lit(16)).alias("hash"))
