"""The engine's tables, derived from the driver's parquet files with the same SQL in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parts import part_of

#: Tables of the driver.
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: Derived tables, in dependency order; valid in both engines.
DERIVED = {
    "memory": """SELECT doc_id AS id, text AS content,
 CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN 'conversation' WHEN 1 THEN 'fact' WHEN 2 THEN 'preference' WHEN 3 THEN 'user_trait' WHEN 4 THEN 'decision' WHEN 5 THEN 'lesson' WHEN 6 THEN 'identity' ELSE 'fact' END AS type,
 concat('v5_domain:', lang, ',v5_project:', source, ',v5_kind:', CASE CAST((doc_id + (doc_id - doc_id % 20) / 20) % 4 AS INT) WHEN 0 THEN 'decision' WHEN 1 THEN 'pitfall' WHEN 2 THEN 'convention' ELSE 'idea' END) AS tags,
 CAST((doc_id * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS weight, CAST((doc_id * 7) % 6 AS INT) AS access_count,
 CASE WHEN doc_id % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1735689600 - 86400 * ((doc_id * 13) % 120) - 1800 AS DOUBLE) END AS last_accessed,
 CAST(1735689600 - 86400 * ((doc_id * 11) % 60) - 3600 * (doc_id % 24) - 60 AS DOUBLE) AS created,
 doc_id % 5 <> 0 AS short_term, doc_id % 5 = 0 AS long_term,
 CAST((doc_id * 17) % 201 - 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS pad_p, CAST((doc_id * 19) % 201 - 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS pad_a, CAST((doc_id * 23) % 201 - 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS pad_d,
 CASE WHEN doc_id % 3 = 0 THEN 'ch_a' ELSE '' END AS character,
 CAST((doc_id * 3) % 13 AS DOUBLE) / CAST(10 AS DOUBLE) AS reinforcement, CAST((doc_id * 5) % 7 AS DOUBLE) / CAST(10 AS DOUBLE) AS disputation,
 CASE WHEN doc_id % 9 = 4 THEN doc_id - 4 END AS source_memory_id, doc_id % 11 = 0 AS archived,
 CASE WHEN doc_id % 7 = 0 THEN CAST(1735689600 - 86400 * ((doc_id % 5) - 2) AS DOUBLE) END AS valid_to FROM documents""",
    "turns": """SELECT conv_id * 100 + turn AS node_id, conv_id, CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 2 THEN conv_id * 100 + turn - 2 ELSE conv_id * 100 + turn - 1 END AS parent_id,
 CAST(turn AS INT) AS turn, role, text, CASE WHEN turn % 3 = 2 THEN concat('b', CAST(turn AS STRING)) END AS branch_label FROM conversations""",
    "eg_episodic_entities": """SELECT l_orderkey AS memory_id, l_partkey AS entity_id, MAX(GREATEST(CAST(0.3 AS DOUBLE), LEAST(CAST(1 AS DOUBLE), l_quantity / CAST(50 AS DOUBLE)))) AS link_weight
 FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "eg_episodic": "SELECT o_orderkey AS id, concat('order ', CAST(o_orderkey AS STRING)) AS summary, LEAST(CAST(1 AS DOUBLE), o_totalprice / CAST(500000 AS DOUBLE)) AS importance FROM orders",
    "eg_edges": """SELECT a.entity_id AS src, b.entity_id AS dst, LEAST(CAST(1 AS DOUBLE), SUM(CAST(0.1 AS DOUBLE) * e.importance)) AS weight, COUNT(*) AS co_occurrence_count
 FROM eg_episodic_entities a JOIN eg_episodic_entities b ON a.memory_id = b.memory_id AND a.entity_id < b.entity_id JOIN eg_episodic e ON e.id = a.memory_id GROUP BY a.entity_id, b.entity_id""",
    "eg_entities": "SELECT p_partkey AS id, concat(p_brand, ' ', CAST(p_partkey AS STRING)) AS name FROM part",
    "eg_aliases": "SELECT p_partkey AS entity_id, concat('alias ', CAST(p_partkey % 50 AS STRING)) AS alias FROM part WHERE p_partkey % 3 = 0",
    "evidence": "SELECT doc_id AS id, CAST(quality AS DOUBLE) * CAST(0.5 AS DOUBLE) AS delta_rein, CAST(toxic AS DOUBLE) * CAST(0.5 AS DOUBLE) AS delta_disp FROM labels",
    "interactions": """SELECT user_id, event_id, CAST(date_part('EPOCH', ts) AS DOUBLE) AS ts, event_type, LEAST(CAST(1 AS DOUBLE), value / CAST(300 AS DOUBLE)) AS intensity,
 CASE event_type WHEN 'purchase' THEN '谢谢你 太好了' WHEN 'error' THEN '失败 烦' WHEN 'signup' THEN '开心 完成了' WHEN 'view' THEN '什么' ELSE '好' END AS text FROM events""",
    "responses": "SELECT conv_id AS character, turn, text FROM conversations WHERE role = 'assistant'",
    "vectors": "SELECT e.vec_id AS id, e.embedding, m.type, m.weight FROM embeddings e JOIN memory m ON m.id = e.vec_id",
    "queries_fts": "SELECT item_id AS query_id, regexp_extract(text, '^[^ ]* [^ ]* [^ ]*', 0) AS q FROM benchmark WHERE item_id < 20",
    "reflections": """SELECT doc_id AS id, text, concat('ch_', CAST(doc_id % 3 AS STRING)) AS character, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'PENDING' WHEN 1 THEN 'CONFIRMED' WHEN 2 THEN 'PROMOTED' ELSE 'DENIED' END AS status,
 CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'user' WHEN 1 THEN 'self' ELSE 'relationship' END AS entity, CAST((doc_id * 29) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS importance,
 CAST((doc_id * 7) % 60 AS DOUBLE) AS reinforcement, CAST((doc_id * 5) % 20 AS DOUBLE) AS disputation, CAST(1735689600 - 86400 * (doc_id % 90) AS DOUBLE) AS created_at, CAST(1735689600 - 86400 * (doc_id % 30) AS DOUBLE) AS updated_at, CAST((doc_id - doc_id % 4) / 4 % 3 AS INT) AS sub_zero FROM documents""",
    "directives": """SELECT c_custkey AS id, concat('ch_', CAST(c_custkey % 5 AS STRING)) AS character, c_mktsegment AS type, c_name AS content, CAST(1735689600 - 3600 * (c_custkey % 200) AS DOUBLE) AS created_at,
 CASE WHEN c_custkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1735689600 - 3600 * (c_custkey % 200) + 259200 AS DOUBLE) END AS expires_at, c_custkey % 13 <> 0 AS is_active FROM customer""",
    "project_edges": """SELECT doc_id AS source, doc_id + 1 AS target, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'SOLVES' WHEN 1 THEN 'PREVENTS' WHEN 2 THEN 'CAUSED_BY' ELSE 'RELATES_TO' END AS relation,
 CAST((doc_id * 11) % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS weight FROM documents WHERE doc_id % 3 = 0""",
    "skills": "SELECT p_partkey AS id, lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '-')) AS name, p_type AS description, concat(p_brand, ' size ', CAST(p_size AS STRING)) AS body FROM part",
}
_SPARK = {"queries_fts": DERIVED["queries_fts"], "interactions": DERIVED["interactions"].replace("date_part('EPOCH', ts)", "CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS DOUBLE) / 1000000D")}
_DUCK = {"skills": DERIVED["skills"].replace("'-')", "'-', 'g')")}


#: Order lines, and pairs of them, that one task holds in hash tables and sorts.
LINES, PAIRS = 500_000, 1_000_000


def parts(t: _Tables, of: int = LINES) -> int:
    """How many tasks the order lines are dealt out to, so that a task's memory does not grow with them."""
    return max(t.spark.sparkContext.defaultParallelism, t["lineitem"].count() // of + 1)


def pair_parts(t: _Tables) -> int:
    """The same for pairs, of which there are about two a line."""
    return parts(t, PAIRS // 2)


def _links(t: _Tables) -> DataFrame:
    """eg_episodic_entities by one shuffle, which the joins by memory go on using."""
    weight = F.greatest(F.lit(0.3), F.least(F.lit(1.0), F.col("l_quantity") / F.lit(50.0)))
    lines = t["lineitem"].select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity_id"), weight.alias("link_weight"))
    return lines.repartition(parts(t), "memory_id").groupBy("memory_id", "entity_id").agg(F.max("link_weight").alias("link_weight"))


def _made(t: _Tables) -> DataFrame:
    """Pairs (src, dst, w) of the entities of a memory, made where its links lie, from one row a memory."""
    ids = t["eg_episodic_entities"].groupBy("memory_id").agg(F.array_sort(F.collect_list("entity_id")).alias("ids"))
    ids = ids.where("size(ids) > 1").join(t["eg_episodic"].select(F.col("id").alias("memory_id"), "importance"), "memory_id")
    one = ids.select("ids", (F.lit(0.1) * F.col("importance")).alias("w"), F.posexplode("ids").alias("i", "src"))
    return one.select("src", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("dst"), "w")


def _pairs(t: _Tables) -> DataFrame:
    """eg_edges: pairs are summed after the shuffle, as hardly two of a task are equal."""
    return _summed(_made(t).repartition(pair_parts(t), "src", "dst"))


def _out(t: _Tables) -> DataFrame:
    """The rows of eg_edges with a part, dealt out by it: all edges of a source lie in one of `.parts` parts."""
    n = pair_parts(t)
    out = _summed(_made(t).withColumn("part", part_of("src", n)).repartitionById(n, "part"), "part")
    out.parts = n
    return out


def _summed(pairs: DataFrame, *more: str) -> DataFrame:
    return pairs.groupBy(*more, "src", "dst").agg(F.least(F.lit(1.0), F.sum("w")).alias("weight"), F.count(F.lit(1)).alias("co_occurrence_count"))


#: Tables that Spark makes by a plan of its own, with the rows of their SQL.
_PLANS = {"eg_episodic_entities": _links, "eg_edges": _pairs, "eg_out_edges": _out}


def uses(sql: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", sql) is not None


def needed(sql: str) -> list[str]:
    """Derived tables that the SQL reads, directly or not, in order."""
    want: set[str] = set()
    for name in reversed(DERIVED):
        if uses(sql, name) or any(uses(DERIVED[w], name) for w in want):
            want.add(name)
    return [n for n in DERIVED if n in want]


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All tables by name; lazily planned, each reads only what a query asks of it."""
    return _Tables(spark, sf_dir)


class _Tables(dict):
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name in _PLANS:
            df = _PLANS[name](self)
        elif name in DERIVED:
            sql = _SPARK.get(name, DERIVED[name])
            parts = [n for n in [*BASE, *DERIVED] if n != name and uses(sql, n)]
            df = self.spark.sql(re.sub(r"\b(" + "|".join(parts) + r")\b(?=[\s)]|$)", lambda m: "{" + m[1] + "}" if m[1] in parts else m[1], sql) if parts else sql, **{n: self[n] for n in parts})
        else:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self[name] = df
        return df


def with_tables(sql: str) -> str:
    """DuckDB SQL with the derived tables it needs in front."""
    sql = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)
    names = needed(sql)
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({_DUCK.get(n, DERIVED[n])})" for n in names)
    sql = sql.strip()
    if sql[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{sql[15:]}"
    if sql[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"
