from pyspark.sql import functions as F

from mnemolake.engine import Engine
from mnemolake.sources.fixtures import tables


def test_every_tool_is_a_method():
    names = Engine({}).tools()
    assert len(names) == len(set(names)) == 48 and all(callable(getattr(Engine, n)) for n in names)
    assert Engine({}).tools(["care"]) == ["care_check", "care_status"] and len(Engine({}).tools(["nothing"])) == 48


def test_snapshots(spark, sf):
    e = Engine(dict(tables(spark, sf)) | {n: tables(spark, sf)[n] for n in ("memory", "responses", "skills", "directives", "reflections", "interactions", "conversations", "pages", "vectors", "queries_fts")})
    before = e.t["memory"].count()
    e.memory_store(spark.createDataFrame([("a", "fact", "", 7.0), ("b", "fact", "", -1.0)], "content string, type string, tags string, weight double"), F.col("content"))
    assert e.t["memory"].count() == before + 2
    new = e.t["memory"].where("content IN ('a', 'b')").orderBy("id").collect()
    assert [r["weight"] for r in new] == [1.0, 0.0] and new[1]["id"] == new[0]["id"] + 1
    e.memory_delete(spark.createDataFrame([(new[0]["id"],)], "id long"))
    assert e.t["memory"].count() == before + 1
    said = e.t["responses"].limit(1).collect()[0]
    used = spark.createDataFrame([(said["character"], said["text"])], "character long, text string")
    assert e.anti_repeat_check(used).first()["score"] > 0.1 and e.anti_repeat_penalty(used, over=0.1).count() == 1
    e.anti_repeat_clear(said["character"])
    assert e.anti_repeat_check(used).first()["score"] == 0.0
    e.skill_write(spark.createDataFrame([(1_000_000, "deploy-windows", "how to", "x"), (1_000_001, "Not Kebab", "d", "x")], "id long, name string, description string, body string"))
    e.skill_write(spark.createDataFrame([(1_000_002, "deploy-windows", "how to, again", "x")], "id long, name string, description string, body string"))
    assert [r["description"] for r in e.skill_get("deploy-windows").collect()] == ["how to, again"] and e.skill_get("Not Kebab").count() == 0
    assert e.skill_search(spark.createDataFrame([(1, "deploy-windows")], "query_id int, q string")).first()["name"] == "deploy-windows"
    e.reflect_run_op("retention")
    for name in ("memory_stats", "directive_stats", "reflection_stats", "emotion_label", "self_discover", "latest_thought", "proactive_check", "activity_status", "project_stats", "care_status", "vitality", "relationship", "curiosity_check", "subconscious", "narrative_generate", "context_compression_stats", "skill_list", "self_model", "anti_repeat_stats"):
        assert getattr(e, name)().limit(1).count() >= 0


def test_search_falls_back_and_is_kept(spark, sf, tmp_path):
    from mnemolake.operators.text_index import SegmentedIndex

    t = tables(spark, sf)
    memory = t["memory"].where("id < 40").withColumn("created", F.lit(1.0)).withColumn("access_count", F.lit(0)).withColumn("weight", F.lit(0.1)).withColumn("archived", F.lit(False)).withColumn("content", F.when(F.col("id") == 7, "the 主力战机 takes off").otherwise(F.col("content")))
    e = Engine({"memory": memory, "vectors": t["vectors"].where("false"), "notes": spark.createDataFrame([(1, "Harbour", "ships come in"), (2, "Hills", "no such thing")], "note_id long, title string, body string")})
    queries = spark.createDataFrame([(1, "战机 文艺"), (2, "ships ahoy"), (3, "qqq")], "query_id long, q string")
    none = spark.createDataFrame([], "query_id long, qv array<float>"), spark.createDataFrame([], "query_id long, lo double, hi double")
    got = {(r["query_id"], r["id"], r["rank"], r["source"]) for r in e.memory_search(queries, *none, key="a").collect()}
    assert (1, "7", 1, "kw") in got and (2, "vault:1", 1, "vault") in got and not [g for g in got if g[0] == 3]
    kept = e.memory_search(queries.where("false"), *none, key="a")
    assert {(r["query_id"], r["id"], r["rank"], r["source"]) for r in kept.collect()} == got
    e.index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    e.index.upsert(memory)
    assert {(r["query_id"], r["id"], r["rank"], r["source"]) for r in e.memory_search(queries, *none).collect()} == got
    e.memory_delete(spark.createDataFrame([(7,)], "id long"))
    assert (1, "7", 1, "kw") not in {(r["query_id"], r["id"], r["rank"], r["source"]) for r in e.memory_search(queries, *none, key="a").collect()}


def test_store_merges_what_repeats(spark):
    schema = "id long, content string, type string, tags string, weight double, access_count int, last_accessed double, created double, reinforcement double, archived boolean"
    text = "the release goes out on friday evening"
    old = [(5, text, "fact", "a,b", 0.5, 2, 0.0, 1.0, 0.2, False), (6, text, "lesson", "c", 0.9, 0, 0.0, 1.0, 0.0, False), (7, text + "!", "fact", "", 0.4, 0, 0.0, 1.0, 0.0, True)]
    e = Engine({"memory": spark.createDataFrame(old, schema)})
    new = [(text + ", not before", "fact", "b,d", 0.7), (text, "fact", "v5_key:x", 0.1), ("the release goes out on mondays", "preference", "", 2.0)]
    e.memory_store(spark.createDataFrame(new, "content string, type string, tags string, weight double"), F.col("weight"))
    got = {r["id"]: r for r in e.t["memory"].collect()}
    assert sorted(got) == [5, 6, 7, 8, 9] and (got[8]["tags"], got[9]["weight"]) == ("v5_key:x", 1.0)
    r = got[5]
    assert (r["content"], r["tags"], r["weight"], r["access_count"], round(r["reinforcement"], 6), r["last_accessed"]) == (text + ", not before", "a b d", 0.7, 3, 0.25, e.now)
    assert got[6]["access_count"] == got[7]["access_count"] == 0
    e.reflect_run_op("dedup")  # a keyed row and those of other types stay
    assert {r["id"] for r in e.t["memory"].where("archived").collect()} == {7}
    more = [(20, text, "lesson", "c", 0.1, 0, 0.0, 1.0, 0.0, False)]
    e.t["memory"] = e.t["memory"].unionByName(spark.createDataFrame(more, schema))
    e.reflect_run_op("dedup")
    assert {r["id"] for r in e.t["memory"].where("archived").collect()} == {7, 20}


def test_project_notes_are_tagged_and_linked(spark, sf):
    schema = "id long, content string, type string, tags string, weight double, access_count int, last_accessed double, created double, reinforcement double, archived boolean"
    old = [(1, "sqlite locks under load", "lesson", "v5_project:p,v5_kind:pitfall", 0.5, 0, 0.0, 1.0, 0.0, False), (2, "sqlite locks under load", "lesson", "v5_project:other,v5_kind:pitfall", 0.5, 0, 0.0, 1.0, 0.0, False)]
    e = Engine({"memory": spark.createDataFrame(old, schema), "project_edges": spark.createDataFrame([], "source long, target long, relation string, weight double")})
    notes = [("we retry when sqlite locks", "Decision", "p", "x", 0.7), ("nobody knows this kind", "rumour", "p", "", 0.7)]
    stored = e.project_note(spark.createDataFrame(notes, "content string, kind string, project string, tags string, weight double"), F.col("content"))
    assert [(r["id"], r["type"], r["tags"]) for r in stored.collect()] == [(3, "decision", "x,v5_project:p,v5_kind:decision,v5_domain:project")]
    assert [tuple(r) for r in e.t["project_edges"].collect()] == [(3, 1, "SOLVES", 0.6)]


def test_every_scheduled_op_runs(spark, sf):
    from mnemolake.plans.lifecycle import INTERVALS

    t = tables(spark, sf)
    for op in INTERVALS:
        assert Engine({n: t[n] for n in ("memory", "directives", "reflections", "embeddings", "vectors")}).reflect_run_op(op).count() > 0, op
