"""Folds with ticks: by hand, and the stream against the batch pass, out of order, restarted and started from a batch's state."""

import random

import pytest
from pyspark.sql import functions as F

from mnemolake.operators.timed import MOST, fold_timed, states
from mnemolake.streaming.timers import stream_timed

SCHEMA = "user_id long, event_id long, ts double, event_type string, intensity double"


def rows_of(df, after=float("-inf"), until=float("inf")):
    out = {}
    for r in df.collect():
        if after <= r["ts"] < until:
            at = (r["user_id"], r["ts"], r["kind"], r["event_id"])
            assert at not in out  # each moment once
            out[at] = [round(v, 9) if v is not None else None for k, v in r.asDict().items() if k not in ("user_id", "ts", "kind", "event_id")]
    return out


def values(df):
    return [tuple(r) for r in df.orderBy("user_id", "ts").collect()]


def test_ticks_by_hand(spark):
    e = spark.createDataFrame([(1, 1, 0.0, "view", 0.3), (1, 2, 1900.0, "purchase", 0.2), (2, 3, 100.0, "view", 0.9), (2, 4, 700.0, "view", 0.9), (None, 5, 1.0, "view", 0.1), (3, 6, 5000.0, "view", 0.1)], SCHEMA)
    got = values(fold_timed(e, "curiosity", 3000.0).where("user_id = 1"))
    assert [(r[1], r[2], r[3]) for r in got] == [(1, 0.0, "event"), (None, 600.0, "idle"), (None, 1200.0, "idle"), (None, 1800.0, "idle"), (2, 1900.0, "event"), (None, 2500.0, "idle")]
    assert [r[4] for r in got] == pytest.approx([0.5, 0.56, 0.62, 0.68, 0.43, 0.49])
    # an event at the moment of a tick comes first
    assert [r[3] for r in values(fold_timed(e, "curiosity", 1000.0).where("user_id = 2"))] == ["event", "event"]
    got = values(fold_timed(e, "activation", 1901.0))
    assert got == [(1, 1, 0.0, "event", 0.3, 1), (1, None, 1200.0, "expired", None, None), (1, 2, 1900.0, "event", 0.2, 1), (2, 3, 100.0, "event", 0.9, 1), (2, 4, 700.0, "event", 1.0, 2), (2, None, 1900.0, "expired", None, None)]
    assert fold_timed(e.where("user_id = 1"), "curiosity", 1e7).agg(F.max("curiosity")).first()[0] == 1.0
    assert fold_timed(e.where("event_id = 1"), "curiosity", 1e7).count() == 1 + 9  # until nothing changes
    assert fold_timed(e.where("event_id = 1"), "vitality", 1e7).count() <= 1 + MOST
    assert fold_timed(e.limit(0), "curiosity", 1e7).count() == 0
    assert {r["user_id"] for r in states(e, "activation", 2000.0).collect()} == {1}


@pytest.mark.parametrize("name", ["curiosity", "vitality", "activation"])
def test_stream_is_batch(spark, tmp_path, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(5)
    rows = sorted(((rng.randrange(5), i, rng.uniform(0, 20000), rng.choice(["view", "purchase", "error"]), rng.random()) for i in range(150)), key=lambda r: r[2] + rng.uniform(0, 900))  # out of order by 900 s at most
    early = [r for r in rows if r[2] < 4000]
    later = [r for r in rows if r[2] >= 4000]
    x = spark.createDataFrame(rows, SCHEMA)
    initial = states(spark.createDataFrame(early, SCHEMA), name, 4000.0)

    def feed(i, part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = stream_timed(stream, name, "1000 seconds", initial=initial).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    third = len(later) // 3
    feed(0, later[:third])
    feed(1, later[third : 2 * third])
    run()
    feed(2, later[2 * third :])
    run()  # a restart goes on where the last one stopped
    feed(3, [(99, 999, 30000.0, "view", 0.0)])  # moves the watermark to 29,000
    run()
    out = spark.read.schema(f"user_id long, event_id long, ts double, kind string, {'activation double, seen long' if name == 'activation' else 'curiosity double' if name == 'curiosity' else 'vitality double, talks long'}").parquet(f"{tmp_path}/out")
    assert rows_of(out) == rows_of(fold_timed(x, name, 29000.0), after=4000.0)
