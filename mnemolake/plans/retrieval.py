"""Retrieval queries: full text, vectors, fusion, fallbacks and scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import first_of, query_tokens, repeat_grams
from ..operators import search
from ..operators.string_join import holders
from ..operators.text_index import SegmentedIndex
from ..operators.vector_index import VectorIndex
from ..schema import INTENT_BOOST, INTENT_CUES, NOW, TYPE_BOOST, TYPE_DECAY, sql_case
from ..sources.scratch import cut, new_path, state_of
from .catalog import query
from .graphs import entity_graph, entity_graph_sql
from .predicates import _any
from .text import EI_SQL

_TOKENS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}\p{{Co}}]+')"
BM25 = f"""dt AS (SELECT id, f, {_TOKENS.format("x")} AS ts FROM (SELECT id, unnest([content, type, tags]) AS x, unnest([0, 1, 2]) AS f FROM memory)),
 dz AS (SELECT id, sum(len(ts)) AS d FROM dt GROUP BY id), st AS (SELECT count(*) AS total, avg(d) AS mean FROM dz),
 qw AS (SELECT query_id, unnest(regexp_split_to_array(q, '\\s+')) AS w FROM queries_fts), qp AS (SELECT query_id, {_TOKENS.format("w")} AS p FROM qw), qt AS (SELECT query_id, p, count(*) AS times FROM qp WHERE len(p) > 0 GROUP BY ALL),
 ps AS (SELECT DISTINCT p FROM qt), po AS (SELECT id, f, i, ts, ts[i] AS token FROM dt, unnest(range(1, len(ts) + 1)) AS u(i)),
 fr AS (SELECT p, id, count(*) AS f FROM po JOIN ps ON po.token = ps.p[1] WHERE ts[i : i + len(p) - 1] = p GROUP BY p, id), df AS (SELECT p, count(*) AS df FROM fr GROUP BY p),
 bm AS (SELECT query_id, id, -sum(times * CASE WHEN ln((total - df + 0.5) / (df + 0.5)) > 0 THEN ln((total - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))) AS bm25
  FROM fr JOIN df USING (p) JOIN dz USING (id) JOIN qt USING (p), st GROUP BY query_id, id),
 ft AS (SELECT * FROM (SELECT query_id, bm.id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), bm.id) AS rank FROM bm JOIN memory m ON m.id = bm.id WHERE NOT archived) WHERE rank <= 10)"""


def _dot(a, b):
    return f"list_sum(list_transform(list_zip({a}, {b}), x -> CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"


KNN = f"""qv AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id < 20),
 cs AS (SELECT query_id, v.id, v.type, v.weight, least(1.0, greatest(0.0, {_dot("embedding", "qv")} / (sqrt({_dot("embedding", "embedding")}) * sqrt({_dot("qv", "qv")})))) AS score FROM vectors v, qv),
 kn AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM cs) WHERE rank <= 10)"""
TIME = """tr AS (SELECT query_id, 1735689600.0 - 86400 * 3 AS lo, 1735689600.0 AS hi FROM queries_fts WHERE query_id % 4 = 0),
 tm AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, last_accessed DESC, id) AS rank FROM memory JOIN tr ON created BETWEEN lo AND hi) WHERE rank <= 10)"""
_PER_DAY, _FLOOR = sql_case({k: v[0] for k, v in TYPE_DECAY.items()}, "type", 0.05), sql_case({k: v[1] for k, v in TYPE_DECAY.items()}, "type", 0.2)
_WANTED = "CASE intent " + " ".join(f"WHEN '{i}' THEN {sql_case(v, 'type', 1.0)}" for i, v in INTENT_BOOST.items()) + " ELSE 1.0 END"
_INTENT = "CASE " + " ".join(f"WHEN {_any('lower(q)', w)} THEN '{i}'" for i, w in INTENT_CUES.items()) + " ELSE 'GENERAL' END"
FUSED = f"""{BM25}, {KNN}, {TIME},
 pa AS (SELECT query_id, id, 0 AS no, rank, CAST(0.3 / rank AS DOUBLE) AS raw FROM ft UNION ALL SELECT query_id, id, 1, rank, 0.7 * score FROM kn UNION ALL SELECT query_id, id, 2, rank, 1.0 FROM tm),
 mg AS (SELECT query_id, id, min(no * 100 + rank) AS arrival, sum(raw) AS raw, sum(CASE WHEN no = 0 THEN raw ELSE 0 END) AS raw_fts, sum(CASE WHEN no = 1 THEN raw ELSE 0 END) AS raw_vector, sum(CASE WHEN no = 2 THEN raw ELSE 0 END) AS raw_time FROM pa GROUP BY query_id, id),
 att AS (SELECT mg.*, arrival // 100 AS no, type, weight, content, valid_to, CASE WHEN arrival // 100 = 1 THEN 0 ELSE created END AS created, CASE WHEN arrival // 100 = 1 THEN 0 ELSE access_count END AS access_count, CASE WHEN arrival // 100 = 1 THEN 0 ELSE reinforcement END AS reinforcement,
  CASE WHEN arrival // 100 = 1 THEN 0 ELSE last_accessed END AS last_accessed, CASE WHEN arrival // 100 = 1 THEN false ELSE long_term END AS long_term, {_INTENT} AS intent FROM mg JOIN memory USING (id) JOIN queries_fts USING (query_id)),
 sg AS (SELECT *, 0.5 + 0.5 * weight AS s_weight, CASE WHEN no <> 2 AND created <> 0 AND (1735689600 - created) / 86400 > 0 THEN greatest({_FLOOR}, 1 - {_PER_DAY} * (1735689600 - created) / 86400) ELSE 1.0 END AS s_decay, {sql_case(TYPE_BOOST, "type", 1.0)} * {_WANTED} AS s_type,
  CASE WHEN access_count > 0 THEN least(0.25, length(bin(access_count + 1)) * 0.05) ELSE 0 END + CASE WHEN reinforcement > 0 THEN least(0.15, reinforcement * 0.10) ELSE 0 END + CASE WHEN last_accessed > 0 AND 1735689600 - last_accessed < 604800 THEN 0.08 ELSE 0 END + CASE WHEN long_term THEN 0.05 ELSE 0 END AS s_use,
  CASE WHEN created <> 0 AND (CAST(floor(created / 3600) AS BIGINT) % 24 <= 1 OR CAST(floor(created / 3600) AS BIGINT) % 24 >= 23) THEN 0.05 ELSE 0 END AS s_situation, {EI_SQL} AS s_ei FROM att),
 sc AS (SELECT *, raw * s_weight * s_decay * s_type * (1 + s_use) * (1 + s_situation) AS score FROM sg),
 rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, arrival, id) AS place FROM sc WHERE score >= 0.3) WHERE place <= 5)"""


def deeper(sql: str, k: int) -> str:
    """The fused SQL for k rows a query instead of five."""
    return sql.replace("WHERE rank <= 10)", f"WHERE rank <= {max(2 * k, 6)})").replace("WHERE place <= 5)", f"WHERE place <= {k})")


_INDEXES: dict[tuple, SegmentedIndex] = {}


def text_index(t) -> SegmentedIndex:
    """The full-text index of the memory table. That of a folder is kept while the session lasts and its documents are the same."""
    spark, key = t["memory"].sparkSession, _index_key(t)
    if key not in _INDEXES:
        index = SegmentedIndex(spark, new_path(spark, "text-index"))
        index.upsert(t["memory"])
        if key is None:
            return index
        _INDEXES[key] = index
    return _INDEXES[key]


def _index_key(t) -> tuple | None:
    spark = t["memory"].sparkSession
    return (spark.sparkContext.applicationId, t.sf_dir, state_of(spark, f"{t.sf_dir}/documents.parquet")) if hasattr(t, "sf_dir") else None


def kept_index(t) -> SegmentedIndex | None:
    """The index if the session has it; one batch alone does not pay for making it, so its phrases are looked for in the texts."""
    return _INDEXES.get(_index_key(t))


def _found(t, k=search.TOP_K, queries=None, index=text_index):
    queries = t["queries_fts"] if queries is None else queries
    qv = t["embeddings"].where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    times = queries.where("query_id % 4 = 0").select("query_id", F.lit(NOW - 86400 * 3).alias("lo"), F.lit(NOW).alias("hi"))
    return search.scored(search.candidates(t["memory"], t["vectors"], queries, qv, times, k, index(t)), queries, NOW)


@query("fts_bm25", f"WITH {BM25} SELECT query_id, id, round(bm25, 6) AS bm25, CAST(rank AS INT) AS rank FROM ft")
def fts_bm25(t):
    """The first ten live rows of each query, from the index."""
    return search.fts(t["memory"], t["queries_fts"], 10, index=text_index(t)).select("query_id", "id", F.round("bm25", 6).alias("bm25"), "rank")


@query("bm25_all", f"WITH {BM25} SELECT query_id, id, round(bm25, 6) AS bm25 FROM bm")
def bm25_all(t):
    return search.bm25(t["memory"], t["queries_fts"], text_index(t)).select("query_id", "id", F.round("bm25", 6).alias("bm25"))


@query("knn_cosine", f"WITH {KNN} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM kn")
def knn_cosine(t):
    qv = t["embeddings"].where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return search.knn(t["vectors"], qv, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _indexed(t) -> VectorIndex:
    v = t["vectors"].select("id", "embedding")
    index = VectorIndex(v.sparkSession, new_path(v.sparkSession, "vectors"))
    index.build("all", v)
    return index


@query("knn_index")
def knn_index(t):
    """The vectors of knn_cosine's queries against the index: its probed cells, reranked by the original vectors."""
    qv = t["embeddings"].where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return _indexed(t).search(qv, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("knn_updated", f"""WITH v AS (SELECT id, CASE WHEN id % 10 = 7 THEN list_transform(embedding, x -> -x) ELSE embedding END AS e FROM vectors WHERE id % 10 <> 3), q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id < 20),
 s AS (SELECT query_id, id, {_dot("e", "qv")} / sqrt({_dot("e", "e")} * {_dot("qv", "qv")}) AS score FROM v, q) SELECT query_id, id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 10""")
def knn_updated(t):
    """The exact path of the index after a write: ids that end in 3 are gone, vectors of those that end in 7 are turned round."""
    index, v = _indexed(t), t["vectors"]
    turned = v.where("id % 10 = 7").select("id", F.transform("embedding", lambda x: -x).alias("embedding"))
    index.merge("write", turned, v.where("id % 10 = 3").select("id"))
    qv = t["embeddings"].where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return index.exact(qv, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("mean_pool", "SELECT CAST(label AS BIGINT) AS label, CAST(pos AS BIGINT) AS pos, round(avg(x), 5) AS mean FROM (SELECT label, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, pos")
def mean_pool(t):
    e = t["embeddings"].select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy(F.col("label").cast("long").alias("label"), F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


_SIGNALS = "round(raw_fts, 4) AS fts, round(raw_vector, 4) AS vector, round(raw_time, 4) AS time, round(s_weight, 4) AS base_weight, round(s_decay, 4) AS type_decay, round(s_type, 4) AS type_boost, round(s_use, 4) AS frequency, round(s_situation, 4) AS situational, round(s_ei, 4) AS ei"
_DOUBLE = ", ".join(f"CAST({x.split(' AS ')[0]} AS DOUBLE) AS {x.split(' AS ')[1]}" for x in _SIGNALS.replace(", 4)", "| 4)").split(", ")).replace("| 4)", ", 4)")


def _signals(df):
    names = {"raw_fts": "fts", "raw_vector": "vector", "raw_time": "time", "s_weight": "base_weight", "s_decay": "type_decay", "s_type": "type_boost", "s_use": "frequency", "s_situation": "situational", "s_ei": "ei"}
    return df.select("query_id", "id", *(F.round(c, 4).alias(n) for c, n in names.items()))


#: Queries that the fused search leaves short: words seldom seen, or of other scripts.
_HARD = [(101, "stupid thndhe unheard"), (102, "quux xyzzy erst"), (103, "主力战机 文艺 ndst"), (104, "page"), (105, "margin"), (106, "erhe ndon"), (107, "track nosuchword")]
_NOTES = r"nt AS (SELECT page_id AS note_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, trim(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS body FROM pages)"
_ALL = "queries_all AS (SELECT query_id, q FROM queries_fts UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in _HARD) + "))"
_FALLBACK = r"""nn AS (SELECT q.query_id, q.q, count(rk.id) AS n FROM queries_all q LEFT JOIN rk ON rk.query_id = q.query_id GROUP BY q.query_id, q.q),
 tp AS (SELECT query_id, n, flatten(list_transform(regexp_extract_all(lower(q), '[一-鿿]+|[a-z0-9]+(?:-[a-z0-9]+)*'), p -> CASE WHEN regexp_matches(p, '^[一-鿿]') AND length(p) >= 3 THEN list_concat([p], list_transform(range(1, length(p)), i -> substr(p, i, 2))) WHEN length(p) >= 2 THEN [p] ELSE [] END)) AS ws FROM nn WHERE n < 5),
 tw AS (SELECT query_id, n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM tp), tk AS (SELECT query_id, n, w, min(i) AS i, count(*) OVER (PARTITION BY query_id) AS words FROM tw GROUP BY query_id, n, w),
 hit AS (SELECT w, id, weight FROM (SELECT DISTINCT w FROM tk WHERE words >= 2) JOIN memory ON contains(lower(content), w) AND NOT archived), dfk AS (SELECT w, count(*) AS df FROM hit GROUP BY w),
 t3 AS (SELECT * FROM (SELECT w, id, row_number() OVER (PARTITION BY w ORDER BY weight DESC, id DESC) AS r FROM hit) WHERE r <= 3),
 od AS (SELECT tk.query_id, n, t3.id, min(CAST(df AS BIGINT) * 1000000 + i * 1000 + r) AS o FROM tk JOIN dfk USING (w) JOIN t3 USING (w) WHERE words >= 2 AND NOT EXISTS (SELECT 1 FROM rk WHERE rk.query_id = tk.query_id AND rk.id = t3.id) GROUP BY ALL),
 ob AS (SELECT *, count(*) OVER (PARTITION BY query_id ORDER BY o // 1000 RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY query_id ORDER BY o) AS p FROM od),
 kw AS (SELECT query_id, id, n + p AS rank FROM ob WHERE n + before < 5), n2 AS (SELECT nn.query_id, nn.q, n + (SELECT count(*) FROM kw WHERE kw.query_id = nn.query_id) AS n FROM nn),
 vq AS (SELECT query_id, n, list_filter(regexp_split_to_array(lower(trim(q)), '[\s,，。、]+'), x -> length(x) >= 2) AS ws FROM n2 WHERE n < 3),
 vh AS (SELECT query_id, n, note_id, title, body, len(list_filter(ws, x -> contains(lower(body), x))) AS b, len(list_filter(ws, x -> contains(lower(title), x))) AS t FROM vq, nt),
 vr AS (SELECT *, b + CASE WHEN t > 0 THEN 2 ELSE 0 END AS hits, row_number() OVER (PARTITION BY query_id ORDER BY b + CASE WHEN t > 0 THEN 2 ELSE 0 END DESC, note_id) AS rank FROM vh WHERE b > 0),
 vc AS (SELECT *, substr(concat('[vault] ', title, ': ', trim(regexp_replace(substr(body, 1, 300), '\s+', ' ', 'g'))), 1, 400) AS content FROM vr WHERE rank <= 5 - n),
 vt AS (SELECT * FROM vc QUALIFY rank = min(rank) OVER (PARTITION BY query_id, content))"""


@query("fusion_retrieve", f"""WITH {_ALL}, {FUSED.replace("queries_fts", "queries_all")}, {_NOTES}, {_FALLBACK}
 SELECT query_id, CAST(id AS VARCHAR) AS id, CAST(place AS INT) AS rank, round(score, 6) AS score, intent, CASE no WHEN 0 THEN 'fts' WHEN 1 THEN 'vector' ELSE 'time' END AS source FROM rk
 UNION ALL SELECT query_id, CAST(id AS VARCHAR), CAST(rank AS INT), CAST(0.45 AS DOUBLE), {_INTENT}, 'kw' FROM kw JOIN queries_all USING (query_id)
 UNION ALL SELECT query_id, concat('vault:', CAST(note_id AS VARCHAR)), CAST(n + rank AS INT), CAST(round(least(1.0, hits * 0.12), 6) AS DOUBLE), {_INTENT}, 'vault' FROM vt JOIN queries_all USING (query_id)""")
def fusion_retrieve(t):
    """The fused search of a batch; queries left short of five rows are filled up by their words, those short of three by notes."""
    hard = t["queries_fts"].sparkSession.createDataFrame(_HARD, "query_id long, q string")
    queries = t["queries_fts"].select(F.col("query_id").cast("long").alias("query_id"), "q").union(hard)
    notes = t["pages"].select(F.col("page_id").alias("note_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_replace("html", "<[^>]*>", " ").alias("body"))
    return completed(search.retrieve(_found(t, queries=queries)), t["memory"], queries, notes)


def completed(found, memory, queries, notes, k=search.TOP_K):
    """(query_id, id, rank, score, intent, source): found rows, then those of the two fallbacks; ids of notes begin with vault:."""
    found = cut(found.select("query_id", "id", "rank", F.round("score", 6).alias("score"), "intent", "source"))
    kw = cut(search.keyword_fallback(memory, queries, found, k))
    more = search.note_fallback(notes, queries, found.select("query_id").union(kw.select("query_id")), k)
    intent = queries.select("query_id", first_of(F.lower("q"), INTENT_CUES, "GENERAL").alias("intent"))
    added = kw.select("query_id", F.col("id").cast("string").alias("id"), "rank", F.lit(0.45).alias("score"), F.lit("kw").alias("source"))
    added = added.union(more.select("query_id", F.concat(F.lit("vault:"), F.col("note_id").cast("string")), (F.col("before") + F.col("rank")).cast("int"), F.round("score", 6), F.lit("vault")))
    return found.withColumn("id", F.col("id").cast("string")).unionByName(added.join(search.small(intent), "query_id").select("query_id", "id", "rank", "score", "intent", "source"))


@query("fusion_signals", f"WITH {FUSED} SELECT query_id, id, {_DOUBLE} FROM sc")
def fusion_signals(t):
    return _signals(_found(t))


#: The words of an explanation.
_WHY = {"vector": "向量", "fts": "关键词", "time": "时间", "fused": "语义融合", "intent": "意图", "type": "类型加权×"}
_PATHS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN raw_{c} > 0 THEN concat('{_WHY[c]}', printf('%.2f', round(raw_{c}, 4))) END" for c in ("vector", "fts", "time")) + "], x -> x IS NOT NULL), '+')"
_EXPLAIN = f"""array_to_string(list_filter([concat('{_WHY["fused"]}(', {_PATHS}, ')'), CASE WHEN intent <> 'GENERAL' THEN concat('{_WHY["intent"]}', intent) END, CASE WHEN round(s_type, 4) <> 1 THEN concat('{_WHY["type"]}', CAST(round(s_type, 4) AS DOUBLE)) END, CASE WHEN s_ei > 0 THEN concat('EI=', printf('%.2f', round(s_ei, 4))) END], x -> x IS NOT NULL), '，')"""


@query("explain", f"WITH {FUSED} SELECT query_id, id, {_EXPLAIN} AS why FROM rk")
def explain(t):
    """Why a row was found: the paths with their shares, the intent, the boost of its type, its importance."""
    return search.retrieve(_found(t)).select("query_id", "id", why().alias("why"))


def why():
    two = lambda c: F.format_string("%.2f", F.round(c, 4))
    paths = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"raw_{c}") > 0, F.concat(F.lit(_WHY[c]), two(f"raw_{c}"))) for c in ("vector", "fts", "time")))), "+")
    parts = [F.concat(F.lit(_WHY["fused"] + "("), paths, F.lit(")")), F.when(F.col("intent") != "GENERAL", F.concat(F.lit(_WHY["intent"]), "intent")), F.when(F.round("s_type", 4) != 1, F.concat(F.lit(_WHY["type"]), F.round("s_type", 4).cast("string"))), F.when(F.col("s_ei") > 0, F.concat(F.lit("EI="), two("s_ei")))]
    return F.array_join(F.array_compact(F.array(*parts)), "，")


@query("fusion_exclude", f"WITH {FUSED} SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, arrival, id) AS p2 FROM sc WHERE score >= 0.3 AND NOT contains(content, 'stupid')) WHERE p2 <= 5")
def fusion_exclude(t):
    """Rows that hold an excluded text score -1 before the cut."""
    found = _found(t)
    return search.retrieve(found.withColumn("score", F.when(F.col("content").contains("stupid"), -1.0).otherwise(F.col("score")))).select("query_id", "id", F.round("score", 6).alias("score"))


@query("topk_score", f"WITH {FUSED} SELECT query_id, CAST(count(*) AS BIGINT) AS n, round(max(score), 6) AS best FROM rk GROUP BY query_id")
def topk_score(t):
    return search.retrieve(_found(t)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best"))


@query("rank_recip", f"WITH {BM25} SELECT query_id, id, CAST(round(0.3 / rank, 6) AS DOUBLE) AS contribution FROM ft")
def rank_recip(t):
    return search.fts(t["memory"], t["queries_fts"], 10, index=text_index(t)).select("query_id", "id", F.round(0.3 / F.col("rank"), 6).alias("contribution"))


@query("kw_fallback", f"WITH {_ALL}, rk AS (SELECT query_id, id FROM (SELECT q.query_id, m.id, row_number() OVER (PARTITION BY q.query_id ORDER BY m.id) AS r FROM queries_all q JOIN memory m ON m.id % 20 = q.query_id % 20) WHERE r <= query_id % 6), {_FALLBACK.split(' vq AS')[0].rstrip(' ,' + chr(10))} SELECT query_id, id, CAST(rank AS INT) AS rank, CAST(0.45 AS DOUBLE) AS score FROM kw")
def kw_fallback(t):
    """Rarest query words first, three rows of each, for queries that have from none to five rows already."""
    hard = t["queries_fts"].sparkSession.createDataFrame(_HARD, "query_id long, q string")
    queries = t["queries_fts"].select(F.col("query_id").cast("long").alias("query_id"), "q").union(hard)
    have = t["memory"].select("id", (F.col("id") % 20).alias("m")).join(search.small(queries.select("query_id", (F.col("query_id") % 20).alias("m"))), "m")
    have = search.ranked(have, [F.col("id")], 6).where("rank <= query_id % 6").select("query_id", "id")
    return search.keyword_fallback(t["memory"], queries, cut(have), 5).withColumn("score", F.lit(0.45))


@query("unified_lexical", f"WITH {BM25} SELECT ft.query_id, ft.id, CAST(round(0.3 / ft.rank, 6) AS DOUBLE) AS score FROM ft JOIN memory m ON m.id = ft.id WHERE m.valid_to IS NULL OR m.valid_to > 1735689600")
def unified_lexical(t):
    live = t["memory"].where(f"valid_to IS NULL OR valid_to > {int(NOW)}").select("id")
    return search.fts(t["memory"], t["queries_fts"], 10, index=text_index(t)).join(live, "id", "left_semi").select("query_id", "id", F.round(0.3 / F.col("rank"), 6).alias("score"))


@query("unified_temporal", f"WITH {FUSED}, r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, arrival, id) AS p2 FROM sc WHERE score >= 0.3) WHERE p2 <= 10), lv AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p2) AS p3 FROM r2 WHERE valid_to IS NULL OR valid_to > 1735689600) SELECT query_id, id, CAST(p3 AS INT) AS rank, round(score, 6) AS score FROM lv WHERE p3 <= 5")
def unified_temporal(t):
    """Twice the rows, then those that are still valid: the filter stands after the cut, as it changes the result."""
    live = t["memory"].where(f"valid_to IS NULL OR valid_to > {int(NOW)}").select("id")
    return search.ranked(search.retrieve(_found(t), k=10).withColumnRenamed("rank", "p2").join(live, "id", "left_semi"), [F.col("p2")], 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


_SEM = "se AS (SELECT query_id, id, score FROM rk), cn AS (SELECT query_id, count(*) AS n FROM se GROUP BY query_id)"
#: Queries that name entities, beside the given ones.
_NAMED = [(201, "what came with alias 30"), (202, "alias 7, again"), (203, "erhe brand#"), (204, "who is alias 12 to alias 21")]
_GRAPH_QUERIES = "queries_graph AS (SELECT query_id, q FROM queries_fts UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in _NAMED) + "))"
#: The graph's rows: memories that the query's entities activate, then notes that hold the query and their neighbours; the first one of an id counts.
_PROJECT = """gh AS (SELECT query_id, id FROM (SELECT query_id, m.id, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, m.id DESC) AS r FROM queries_graph JOIN memory m ON contains(lower(content), lower(q)) AND NOT archived) WHERE r <= 5),
 gn AS (SELECT query_id, target AS id FROM gh JOIN project_edges ON source = gh.id UNION SELECT query_id, source FROM gh JOIN project_edges ON target = gh.id),
 ga AS (SELECT query_id, id, max(s) AS score FROM (SELECT query_id, id, 0.8 AS s FROM gh UNION ALL SELECT query_id, id, 0.5 FROM gn) GROUP BY query_id, id)"""
_GRAPH = f"""{_GRAPH_QUERIES}, {entity_graph_sql("queries_graph", 10, 0.2)}, {_PROJECT}, gb AS (SELECT query_id, id, CAST(score AS DOUBLE) AS score FROM eg UNION ALL SELECT query_id, id, CAST(score AS DOUBLE) FROM ga WHERE NOT EXISTS (SELECT 1 FROM eg WHERE eg.query_id = ga.query_id AND eg.id = ga.id)),
 gr AS (SELECT gb.* FROM gb JOIN memory m ON m.id = gb.id WHERE valid_to IS NULL OR valid_to > 1735689600)"""


def graph_queries(t):
    named = t["queries_fts"].sparkSession.createDataFrame(_NAMED, "query_id long, q string")
    return t["queries_fts"].select(F.col("query_id").cast("long").alias("query_id"), "q").union(named)


def graph_rows(t, queries):
    """(query_id, id, score) of the graph search of a batch: the entity graph and the project graph together; an id that both know keeps the first one's score."""
    entities = cut(entity_graph(t, queries, 10, 0.2).select("query_id", "id", "score"))
    live = t["memory"].where(f"valid_to IS NULL OR valid_to > {int(NOW)}").select("id")
    low = t["memory"].where("NOT archived AND content IS NOT NULL").select("id", "weight", F.lower("content").alias("x"))
    asked = queries.select("query_id", F.lower("q").alias("needle")).where("needle <> ''")
    hits = holders(asked.select("needle").distinct(), low.select("id", "x")).join(asked, "needle").join(low.select("id", "weight"), "id")
    hits = cut(search.ranked(hits, [F.desc("weight"), F.desc("id")], 5).select("query_id", "id"))
    e = t["project_edges"]
    ends = e.select(F.col("source").alias("id"), F.col("target").alias("near")).union(e.select("target", "source"))
    near = ends.join(hits, "id").select("query_id", F.col("near").alias("id"), F.lit(0.5).alias("score"))
    notes = hits.withColumn("score", F.lit(0.8)).union(near).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return entities.union(notes.join(entities, ["query_id", "id"], "left_anti").select("query_id", "id", "score")).join(live, "id", "left_semi").select("query_id", "id", "score")


@query("unified_auto", f"""WITH {_GRAPH}, {FUSED.replace("queries_fts", "queries_graph")}, {_SEM}, need AS (SELECT q.query_id FROM queries_graph q LEFT JOIN cn USING (query_id) WHERE coalesce(n, 0) < 3 OR {_INTENT} = 'ENTITY'),
 u AS (SELECT query_id, id, score FROM se UNION ALL SELECT query_id, id, score FROM gr WHERE query_id IN (SELECT query_id FROM need)), b AS (SELECT query_id, id, max(score) AS score FROM u GROUP BY query_id, id),
 v AS (SELECT b.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, b.id) AS rank FROM b JOIN memory m ON m.id = b.id WHERE score > 0 AND (m.valid_to IS NULL OR m.valid_to > 1735689600)) SELECT query_id, id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM v WHERE rank <= 5""")
def unified_auto(t):
    """Semantic rows; queries with fewer than three of them, or about an entity, also take those of the graph search. No driver round trip."""
    q = graph_queries(t)
    se = cut(search.retrieve(_found(t, queries=q, index=kept_index)).select("query_id", "id", "score"))
    need = q.join(se.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where((F.coalesce("n", F.lit(0)) < 3) | (first_of(F.lower("q"), INTENT_CUES, "GENERAL") == "ENTITY")).select("query_id", "q")
    best = se.union(graph_rows(t, need)).groupBy("query_id", "id").agg(F.max("score").alias("score")).where("score > 0")
    live = t["memory"].where(f"valid_to IS NULL OR valid_to > {int(NOW)}").select("id")
    return search.ranked(best.join(live, "id", "left_semi"), [F.desc(F.round("score", 9)), F.col("id")], 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("join_merge_paths", f"WITH {FUSED} SELECT query_id, id, round(raw, 6) AS raw, CAST(no AS INT) AS first_path FROM sc")
def join_merge_paths(t):
    return _found(t).select("query_id", "id", F.round("raw", 6).alias("raw"), F.col("arrival.no").alias("first_path"))


@query("search_skills", """WITH q AS (SELECT * FROM (VALUES (1, 'brand-12'), (2, 'steel'), (3, 'size 7 copper')) v(query_id, q)), tk AS (SELECT query_id, q, list_distinct(list_filter(regexp_extract_all(lower(q), '[a-z0-9]+(?:-[a-z0-9]+)*'), x -> length(x) >= 2)) AS ws FROM q),
 s AS (SELECT query_id, id, CAST(len(ws) AS INT) AS n, CASE WHEN contains(name, q) THEN 6 ELSE 0 END + CAST(list_sum(list_transform(ws, x -> CASE WHEN contains(name, x) THEN 3 ELSE 0 END + CASE WHEN contains(lower(description), x) THEN 2 ELSE 0 END + CASE WHEN contains(lower(body), x) THEN 1 ELSE 0 END)) AS INT) AS s FROM skills, tk)
 SELECT query_id, id, CAST(least(6 + 2 * n + 3, s) AS INT) AS score FROM s WHERE s > 0""")
def search_skills(t):
    """Name over description over body, capped."""
    q = t["skills"].sparkSession.createDataFrame([(1, "brand-12"), (2, "steel"), (3, "size 7 copper")], "query_id int, q string").withColumn("ws", query_tokens(F.col("q")))
    s = t["skills"].join(search.small(q))
    point = lambda x: F.when(F.col("name").contains(x), 3).otherwise(0) + F.when(F.lower("description").contains(x), 2).otherwise(0) + F.when(F.lower("body").contains(x), 1).otherwise(0)
    total = F.when(F.col("name").contains(F.col("q")), 6).otherwise(0) + F.aggregate(F.transform("ws", point), F.lit(0), lambda a, b: a + b)
    return s.select("query_id", "id", total.alias("s"), F.size("ws").alias("n")).where("s > 0").select("query_id", "id", F.least(6 + 2 * F.col("n") + 3, F.col("s")).cast("int").alias("score"))


@query("anti_repeat_check", """WITH w AS (SELECT character, turn, list_transform(list_filter(regexp_extract_all(text, '[a-zA-Z0-9_]+'), x -> length(x) > 1), x -> lower(x)) AS tk FROM responses),
 g AS (SELECT character, turn, array_to_string(tk[i : i + 4], ' ') AS ngram FROM w, unnest(range(1, len(tk) - 3)) AS u(i) WHERE len(tk) >= 5), mx AS (SELECT character, max(turn) AS last FROM g GROUP BY character),
 o AS (SELECT character, turn, ngram, count(*) AS f FROM g JOIN mx USING (character) WHERE turn < last GROUP BY ALL), c0 AS (SELECT character, ngram, sum(least(1.0, 0.1 * f)) AS w, count(*) - 1 AS h FROM o GROUP BY ALL),
 c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY character ORDER BY w DESC, ngram) AS r FROM c0) WHERE r <= 500), st AS (SELECT character, count(*) AS n, sum(h) / count(*) AS a FROM c GROUP BY character),
 x AS (SELECT g.character, g.ngram, c.w, c.h, st.n, st.a FROM g JOIN mx ON mx.character = g.character AND g.turn = mx.last JOIN st ON st.character = g.character LEFT JOIN c ON c.character = g.character AND c.ngram = g.ngram)
 SELECT character, CAST(round(sum(CASE WHEN w IS NULL THEN 0 ELSE w * ln((n - h + 0.5) / (h + 0.5) + 1) * 1.5 / (1 + 1.5 * (0.25 + 0.75 / greatest(a, 1))) END) / count(*), 4) AS DOUBLE) AS score FROM x GROUP BY character""")
def anti_repeat_check(t):
    """The last response of each character against the 500 heaviest 5-grams of those before."""
    r = t["responses"].select("character", "turn", "text")
    last = r.where(F.size(repeat_grams(F.col("text"), 5)) > 0).groupBy("character").agg(F.max("turn").alias("last"))  # before any gram is a row
    r = r.join(last, "character")
    return repeat_score(r.where("turn < last"), r.where("turn = last").select("character", "text")).where("known").select("character", F.round("score", 4).alias("score"))


#: Responses of one character that are made into grams in one task, and of all characters of a task.
MANY, TASK_RESPONSES = 2_000, 50_000


def top_grams(grams):
    """(character, top) of grams (character, turn, ngram): n and the mean a of the 500 heaviest grams, and these with their w and h. Where rows lie by character, nothing is shuffled."""
    old = grams.groupBy("character", "ngram", "turn").agg(F.count(F.lit(1)).alias("f")).groupBy("character", "ngram").agg(F.sum(F.least(F.lit(1.0), 0.1 * F.col("f"))).alias("w"), (F.count(F.lit(1)) - 1).alias("h"))
    c = search.ranked(old, [F.desc("w"), F.col("ngram")], 500, "character")
    found = F.map_from_entries(F.collect_list(F.struct("ngram", F.struct("w", "h"))))
    return c.groupBy("character").agg(F.struct(F.count(F.lit(1)).alias("n"), (F.sum("h") / F.count(F.lit(1))).alias("a"), found.alias("grams")).alias("top"))


def repeat_score(used, candidates):
    """(character, text, known, score) of candidates (character, text); known: the character has used grams. used: (character, turn, text).

    A gram weighs a tenth for each time a response used it, one response at most 1. Responses are dealt out by character as
    texts and become grams where they lie; those of a character of more than MANY are dealt out as grams.
    """
    grams = lambda df: df.select("character", "turn", F.explode(repeat_grams(F.col("text"), 5)).alias("ngram"))
    sizes = used.groupBy("character").agg(F.count(F.lit(1)).alias("responses"))
    busy = cut(sizes.where(F.col("responses") > MANY).select("character"))
    tasks = max(used.sparkSession.sparkContext.defaultParallelism, used.count() // TASK_RESPONSES + 1)
    here = top_grams(grams(used.join(busy, "character", "left_anti").repartition(tasks, "character")))
    apart = top_grams(grams(used.join(busy, "character", "left_semi")).repartition("character", "ngram"))
    x = candidates.select("character", "text").join(here.withColumnRenamed("top", "top1"), "character", "left").join(apart.withColumnRenamed("top", "top2"), "character", "left")
    x = x.select("character", "text", F.coalesce("top1", "top2").alias("top"), repeat_grams(F.col("text"), 5).alias("grams"))
    x = x.select("character", "text", "top.n", "top.a", F.explode(F.transform("grams", lambda g: F.element_at("top.grams", g))).alias("g")).select("*", "g.w", "g.h")
    s = F.col("w") * F.log((F.col("n") - F.col("h") + 0.5) / (F.col("h") + 0.5) + 1) * 1.5 / (1 + 1.5 * (0.25 + 0.75 / F.greatest("a", F.lit(1.0))))
    return x.groupBy("character", "text").agg(F.bool_or(F.col("n").isNotNull()).alias("known"), (F.sum(F.coalesce(s, F.lit(0.0))) / F.count(F.lit(1))).alias("score"))
