"""Command-line bridge: one JSON request on stdin, one JSON answer on stdout.

    echo '{"action": "search", "query": "words", "top_k": 5}' | python -m mnemolake.bridge SF_DIR [STORE]

Memories are added to STORE, a folder of stored snapshots; without one, `add` is refused.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators import search
from .schema import NOW
from .sources.fixtures import tables
from .sources.snapshots import Snapshots


def found(t: dict[str, DataFrame], request: dict, now: float = NOW, index=None) -> DataFrame:
    """(rank, id, score, content) of the fused search for the request's words, its `vector` and its range of time (`since`, `until`), of 1 to 20 rows."""
    spark = t["memory"].sparkSession
    k = min(20, max(1, int(request.get("top_k", 5))))
    queries = spark.createDataFrame([(0, request["query"].strip())], "query_id long, q string")
    vector = request.get("vector")
    qv = spark.createDataFrame([(0, [float(x) for x in vector])] if vector else [], "query_id long, qv array<float>")
    times = spark.createDataFrame([(0, float(request["since"]), float(request.get("until", now)))] if "since" in request else [], "query_id long, lo double, hi double")
    hits = search.retrieve(search.scored(search.candidates(t["memory"], t["vectors"], queries, qv, times, k, index), queries, now), k)
    return hits.select("rank", "id", "score").join(t["memory"].select("id", "content"), "id", "left")


def answer(engine: Engine, request: dict) -> dict:
    """search, add, context_stats or activity; anything else, and what a request lacks, is an error in the answer."""
    t, action = engine.t, request.get("action")
    if action == "search":
        if not (request.get("query") or "").strip():
            return {"ok": True, "results": []}
        return {"ok": True, "results": [r.asDict() for r in found(t, request, engine.now, engine.index).orderBy("rank").collect()]}  # 20 rows at most
    if action == "add":
        content = (request.get("content") or "").strip()
        if not content:
            return {"ok": False, "error": "empty content"}
        if "memory" not in engine.stored:
            return {"ok": False, "error": "no store to add to"}
        row = (content, request.get("type") or "fact", request.get("tags") or "", float(request.get("weight", 0.6)))
        new = engine.t["memory"].sparkSession.createDataFrame([row], "content string, type string, tags string, weight double")
        return {"ok": True, "id": engine.memory_store(new, F.col("content")).first()["id"]}
    if action == "context_stats":
        by_type = t["memory"].groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()  # as many rows as there are types
        return {"ok": True, "stats": {"total": sum(r["n"] for r in by_type), "by_type": {r["type"]: r["n"] for r in by_type}}}
    if action == "activity":
        last = t["events"].orderBy(F.desc("event_id")).select("event_type").first()
        return {"ok": True, "activity": last["event_type"] if last else ""}
    return {"ok": False, "error": f"unknown action {action!r}"}


def main() -> None:
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    stored = {"memory": Snapshots(spark, sys.argv[2])} if len(sys.argv) > 2 else {}
    try:
        out = answer(Engine(tables(spark, sys.argv[1]), stored=stored), json.load(sys.stdin))
    except json.JSONDecodeError as e:
        out = {"ok": False, "error": f"bad request: {e}"}
    print(json.dumps(out, ensure_ascii=False))


if __name__ == "__main__":
    main()
