"""The full-text index after writes, merges and stopped writers, against a scan of the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import search
from mnemolake.operators.text_index import SegmentedIndex
from mnemolake.sources.fixtures import tables
from mnemolake.sources.scratch import new_path

SCHEMA = "id long, content string, type string, tags string, weight double, archived boolean"


def rounded(df):
    return {(r["query_id"], r["id"], round(r["bm25"], 8)) for r in df.collect()}


def some_rows(rng, ids, long=1):
    words = ["the", "of", "harbour", "ship", "sea-gull", "träume", "x1", "rain", "gull", "sea"]
    return [(i, None if i % 17 == 5 else " ".join(rng.choices(words, [40, 30, 1, 2, 2, 1, 1, 5, 3, 3], k=rng.randint(0, 30 * long))), "fact", "v5_domain:en", 0.5, i % 11 == 0) for i in ids]


QUERIES = [(1, "harbour the"), (2, "sea-gull rain"), (3, "nothing here"), (4, "the of"), (5, "traume the the"), (6, "")]


def test_writes_change_the_answer_without_a_rebuild(spark, tmp_path):
    rng = random.Random(31)
    q = spark.createDataFrame(QUERIES, "query_id long, q string")
    index = SegmentedIndex(spark, f"file://{tmp_path}/i", span=16)
    assert index.top(q, 5).collect() == []
    held = {r[0]: r for r in some_rows(rng, range(120))}
    index.upsert(spark.createDataFrame(list(held.values()), SCHEMA))

    def check():
        memory = spark.createDataFrame(list(held.values()), SCHEMA)
        assert rounded(index.all(q)) == rounded(search.bm25(memory, q))
        live = memory.where("NOT archived").select("id")
        for k in (4,):
            assert rounded(index.top(q, k, live)) == rounded(search.fts(memory, q, k))

    new = some_rows(rng, [3, 4, 50, 200, 201])  # updates and inserts
    held |= {r[0]: r for r in new}
    index.upsert(spark.createDataFrame(new, SCHEMA))
    index.delete(spark.createDataFrame([(4,), (60,), (61,), (9999,)], "id long"))
    for i in (4, 60, 61):
        del held[i]
    check()
    number, content = index.version()
    assert len(content["segments"]) == 2 and len(content["dead"]) == 2
    assert index.delete(spark.createDataFrame([(4,)], "id long")) == number  # gone already
    index.merge()
    assert len(index.version()[1]["segments"]) == 1 and not index.version()[1]["dead"]
    assert index.vacuum() and not index.vacuum()
    check()


def test_a_stopped_writer_changes_nothing(spark, tmp_path, monkeypatch):
    rng = random.Random(32)
    q = spark.createDataFrame(QUERIES, "query_id long, q string")
    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    index.upsert(spark.createDataFrame(some_rows(rng, range(40)), SCHEMA))
    before = rounded(index.all(q))
    more = spark.createDataFrame(some_rows(rng, range(20, 60)), SCHEMA)
    for step in ("_segment", "_tombstones", "_publish"):
        with monkeypatch.context() as m:
            m.setattr(SegmentedIndex, step, lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
            with pytest.raises(RuntimeError):
                index.upsert(more)
        assert rounded(SegmentedIndex(spark, index.path).all(q)) == before
    other = SegmentedIndex(spark, index.path)
    number, content = index.version()
    assert other._publish(number + 1, content) and not index._publish(number + 1, content)  # one of two writers
    index.upsert(more)
    assert rounded(other.all(q)) != before


def test_pruned_blocks_are_not_read(spark, tmp_path):
    rng = random.Random(33)
    rows = some_rows(rng, range(3000))
    rows += [(5000 + i, "harbour " * 6, "fact", "", 0.5, False) for i in range(12)]
    memory = spark.createDataFrame(rows, SCHEMA)
    index = SegmentedIndex(spark, f"file://{tmp_path}/i", span=32)
    index.upsert(memory)
    q = spark.createDataFrame([(1, "harbour"), (2, "harbour the")], "query_id long, q string")
    assert rounded(index.top(q, 5)) == rounded(search.fts(memory.withColumn("archived", F.lit(False)), q, 5))
    assert index.read < index.held / 4


def test_given_tables(spark, sf):
    t = tables(spark, sf)
    index = SegmentedIndex(spark, new_path(spark, "index"))
    index.upsert(t["memory"])
    assert rounded(index.top(t["queries_fts"], 10, t["memory"].where("NOT archived").select("id"))) == rounded(search.fts(t["memory"], t["queries_fts"], 10))


def test_a_build_shuffles_texts_and_no_postings(spark, tmp_path):
    rng = random.Random(34)
    memory = spark.createDataFrame([*some_rows(rng, range(90), long=8), (None, "rain rain", "fact", "", 0.5, False)], SCHEMA)
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    index = SegmentedIndex(spark, f"file://{tmp_path}/i", span=16)
    index.upsert(memory)
    assert shuffled() - before <= 91 + 40  # a row each, and the partial sums of two statistics
    assert list(index.version()[1]["segments"].values())[0][0] == 91  # the row without an id counts
    blocks = index._blocks(index.version()[1])
    assert blocks.count() == blocks.select("token", "range").distinct().count()
    q = spark.createDataFrame(QUERIES, "query_id long, q string")
    assert {(a, b) for a, b, _ in rounded(index.all(q))} == {(a, b) for a, b, _ in rounded(search.bm25(memory.where("id IS NOT NULL"), q))}
