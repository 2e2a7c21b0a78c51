"""Stored snapshots: merges by bucket, replays, stopped writers, plans that do not grow."""

import pytest
from pyspark.sql import functions as F

from mnemolake.engine import Engine
from mnemolake.sources.snapshots import Snapshots

SCHEMA = "id long, x string, n int"


def held(store):
    return {r["id"]: (r["x"], r["n"]) for r in store.read().collect()}


def test_merge_replay_and_stopped_writers(spark, tmp_path, monkeypatch):
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    store = Snapshots(spark, f"file://{tmp_path}/s", buckets=8)
    with pytest.raises(ValueError):
        store.read()
    assert store.merge("a", df([(i, "old", i) for i in range(40)]))
    want = {i: ("old", i) for i in range(40)}
    first = store.version()[1]["buckets"]
    assert store.merge("b", df([(3, "new", None), (99, "more", 1)]), spark.createDataFrame([(4,), (3,), (1234,)], "id long"))
    want |= {3: ("new", None), 99: ("more", 1)}
    del want[4]
    assert held(store) == want
    same = [k for k, v in store.version()[1]["buckets"].items() if first.get(k) == v]
    assert len(same) >= 4  # untouched buckets stay where they are
    number = store.version()[0]
    assert not store.merge("b", df([(3, "again", 0)])) and store.version()[0] == number
    for step in ("_rows", "_write", "_publish"):
        with monkeypatch.context() as m:
            m.setattr(Snapshots, step, lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
            with pytest.raises(RuntimeError):
                store.merge("c", df([(5, "c", 0)]))
        assert held(Snapshots(spark, store.path, buckets=8)) == want
    # another writer comes first: the merge starts over on its version
    publish, other = Snapshots._publish, Snapshots(spark, store.path, buckets=8)

    def late(self, n, content):
        monkeypatch.setattr(Snapshots, "_publish", publish)
        assert other.merge("d", df([(6, "d", 0)]))
        return publish(self, n, content)

    monkeypatch.setattr(Snapshots, "_publish", late)
    assert store.merge("c", df([(5, "c", 0)]))
    want |= {5: ("c", 0), 6: ("d", 0)}
    assert held(store) == want and {r["id"] for r in store.read(1).collect()} == set(range(40))
    store.vacuum()
    assert held(store) == want


def test_plans_do_not_grow_with_the_writes(spark, tmp_path):
    schema = "id long, content string, type string, tags string, weight double, access_count int, last_accessed double, created double, reinforcement double, archived boolean"
    store = Snapshots(spark, f"file://{tmp_path}/m", buckets=4)
    e = Engine({"memory": spark.createDataFrame([(5, "the release goes out on friday evening", "fact", "a", 0.5, 2, 0.0, 1.0, 0.2, False)], schema)}, stored={"memory": store})
    new = spark.createDataFrame([("the release goes out on friday evening, not before", "fact", "b", 0.7), ("something else altogether", "lesson", "", 0.1)], "content string, type string, tags string, weight double")
    e.memory_store(new, F.col("weight"))
    assert {r["id"]: r["access_count"] for r in e.t["memory"].collect()} == {5: 3, 6: None}
    sizes = []
    for i in range(12):
        e.memory_delete(spark.createDataFrame([(6 if i == 0 else 1000,)], "id long"))
        sizes.append(len(e.t["memory"]._jdf.queryExecution().analyzed().treeString().splitlines()))
    assert len(set(sizes)) == 1 and [r["id"] for r in Snapshots(spark, store.path, buckets=4).read().collect()] == [5]
