"""Gates, checks of reflections, extraction in stages and the bridge, by hand."""

import json

from pyspark.sql import functions as F

from mnemolake.bridge import answer
from mnemolake.engine import Engine
from mnemolake.plans.folds import gates
from mnemolake.plans.lifecycle import checked, extracted
from mnemolake.schema import NOW
from mnemolake.sources.fixtures import tables
from mnemolake.sources.snapshots import Snapshots


def test_gates_close_in_order(spark):
    open_ = (400.0, 400.0, False, 0.0, 0.5, 0.9, 10.0)
    shut = [(299.0, "just talked"), (299.9, "just spoke"), (True, "task pending"), (-0.31, "sleepy"), (0.19, "not lonely"), (0.39, "not curious"), (300.5, "away")]
    rows = [(0, *open_), (1, None, None, False, None, None, None, None), (2, 300.0, 300.0, False, -0.3, 0.2, 0.4, 300.0)]
    want = {0: "ok", 1: "ok", 2: "ok"}
    for i, (value, why) in enumerate(shut):
        rows.append((10 + i, *open_[:i], value, *open_[i + 1 :]))
        want[10 + i] = why
        rows.append((20 + i, *open_[:i], *(v for v, _ in shut[i:])))  # all later ones closed too
        want[20 + i] = why
    df = spark.createDataFrame(rows, "user_id long, talk double, spoke double, pending boolean, arousal double, loneliness double, curiosity double, idle double")
    got = gates(df).collect()
    assert {r["user_id"]: r["reason"] for r in got} == want and all(r["speak"] == (r["reason"] == "ok") for r in got)


def test_a_reflection_is_denied_at_the_third_check_below_zero(spark):
    schema = "id long, status string, importance double, reinforcement double, disputation double, created_at double, sub_zero int"
    r = spark.createDataFrame([(1, "PENDING", 1.0, 0.0, 0.0, NOW, 0), (2, "PENDING", 1.0, 0.0, 1.0, NOW, 1), (3, "CONFIRMED", 1.0, 0.0, 0.0, NOW, 2), (4, "PENDING", 1.0, 6.0, 0.0, NOW, 2), (5, "PENDING", None, None, 1.0, NOW, None)], schema)
    against = spark.createDataFrame([(1, 0.0, 0.5), (1, None, 0.5), (99, 1.0, 1.0)], "id long, delta_rein double, delta_disp double")
    none = against.limit(0)
    state = lambda x: {i["id"]: (i["status"], i["sub_zero"]) for i in x.collect()}
    one = checked(r, against)
    assert state(one) == {1: ("PENDING", 1), 2: ("PENDING", 2), 3: ("ARCHIVED", 2), 4: ("PROMOTED", 2), 5: ("PENDING", None)}
    two = checked(one.select(r.columns), none)
    assert state(two)[1] == ("PENDING", 2) and state(two)[2] == ("DENIED", 3)
    better = spark.createDataFrame([(1, 1.5, 0.0)], "id long, delta_rein double, delta_disp double")
    assert state(checked(two.select(r.columns), better))[1] == ("PENDING", 0)  # from zero on the count starts anew


def test_extraction_in_stages(spark):
    rows = spark.createDataFrame([(1, "我喜欢茶, 我是老师"), (2, "nothing of the kind here"), (3, "short"), (4, None), (5, "我喜欢茶"), (6, "x" * 300 + "我喜欢")], "id long, content string")
    told = spark.createDataFrame([(5, " preference ", " tea "), (5, "fact", "a cup a day"), (2, None, "x")], "id long, type string, statement string")
    got = sorted((r["id"], r["source"], r["type"], r["statement"], r["weight"]) for r in extracted(rows, told).collect())
    assert got == [(1, "rule", "identity", "我是", 0.5), (1, "rule", "preference", "我喜欢", 0.5), (2, "safe", "conversation", "nothing of the kind here", 0.3), (5, "answer", "fact", "a cup a day", 0.6), (5, "answer", "preference", "tea", 0.6), (6, "safe", "conversation", "x" * 200, 0.3)]


def test_bridge(spark, sf, tmp_path):
    t = tables(spark, sf)
    t["memory"] = t["memory"].where("id < 300")
    e = Engine(t, stored={"memory": Snapshots(spark, f"file://{tmp_path}/m", buckets=4)})
    added = answer(e, {"action": "add", "content": " a zebra crossed the quiet harbour road ", "weight": 3})
    assert added["ok"]
    hits = answer(e, {"action": "search", "query": "zebra harbour", "top_k": 100})
    assert hits["results"][0]["id"] == added["id"] and hits["results"][0]["content"] == "a zebra crossed the quiet harbour road"
    json.dumps(hits)
    assert answer(e, {"action": "search", "query": "  "}) == {"ok": True, "results": []}
    assert answer(e, {"action": "context_stats"})["stats"]["total"] == e.t["memory"].count()
    last = t["events"].orderBy(F.desc("event_id")).first()["event_type"]
    assert answer(e, {"action": "activity"}) == {"ok": True, "activity": last}
    assert not any(answer(e, r)["ok"] for r in ({"action": "add", "content": " "}, {"action": "fly"}, {}))
    assert answer(Engine(tables(spark, sf)), {"action": "add", "content": "x"}) == {"ok": False, "error": "no store to add to"}
