"""Streams with kept state against the same over the finished table, over restarts."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagequarry.sources.views import table
from pagequarry.streaming.replay import stale_dropped, undo_state
from pagequarry.streaming.stateful import fresh_stream, undo_stream

FOLDER = "/root/testdata/sf0.001"
PARTS = 4


@pytest.fixture(scope="module")
def events(spark):
    i = F.col("event_id")
    kind = F.when(i % 4 == 3, "undo").when(i % 9 == 8, "redo").otherwise("do")
    e = table(spark, FOLDER, "events").select("user_id", "event_id", "ts", kind.alias("kind"), (i % 5).alias("generation"))
    part = F.ntile(PARTS).over(Window.orderBy("ts", "event_id"))
    return [r for r in e.withColumn("part", part).orderBy("ts", "event_id").collect()]


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def put(spark, rows, folder):
    spark.createDataFrame(rows).drop("part").coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, make, folder, checkpoint, out):
    """All that is there now, a file a batch."""
    stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(str(out))

    make(stream).writeStream.outputMode("update").option("checkpointLocation", str(checkpoint)).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination(240)


def over_restarts(spark, events, make, tmp_path):
    """Half of the files, then, by a new query from the same checkpoint, the others one by one."""
    for last in (PARTS // 2, PARTS - 1, PARTS):
        before = 0 if last == PARTS // 2 else PARTS // 2 if last == PARTS - 1 else PARTS - 1
        for part in range(before + 1, last + 1):
            put(spark, [r for r in events if r.part == part], tmp_path / "in")
        run(spark, make, tmp_path / "in", tmp_path / "state", tmp_path / "out")
    return spark.read.parquet(str(tmp_path / "out"))


def test_undo_over_restarts(spark, events, store, tmp_path):
    got = over_restarts(spark, events, undo_stream, tmp_path)
    newest = got.groupBy("user_id").agg(F.max_by(F.struct("can_undo", "can_redo", "top"), "batch").alias("x"), F.max("generation").alias("generation"))
    want = {r.user_id: (r.can_undo, r.can_redo, r.top) for r in undo_state(spark, FOLDER).collect()}
    assert {r.user_id: tuple(r.x) for r in newest.collect()} == want
    counts = {}
    for r in events:
        counts[r.user_id] = counts.get(r.user_id, 0) + 1
    assert {r.user_id: r.generation for r in newest.collect()} == counts
    assert got.select("batch").distinct().count() == PARTS


def test_depth_is_kept_over_batches(spark, store, tmp_path):
    from datetime import datetime, timedelta

    rows = [(1, i, datetime(2024, 1, 1) + timedelta(seconds=i), "do" if i < 250 else "undo") for i in range(400)]
    make = lambda part: spark.createDataFrame(part, "user_id long, event_id long, ts timestamp, kind string")
    for k, (a, b) in enumerate([(0, 120), (120, 251), (251, 400)]):
        make(rows[a:b]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark, undo_stream, tmp_path / "in", tmp_path / "state", tmp_path / "out")
        last = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("batch")).first()
        assert (last.can_undo, last.can_redo, last.top) == [(100, 0, 119), (99, 1, 248), (0, 100, None)][k]


def test_fresh_results_over_restarts(spark, events, store, tmp_path):
    got = over_restarts(spark, events, fresh_stream, tmp_path)
    want = sorted((r.user_id, r.event_id, r.generation) for r in stale_dropped(spark, FOLDER).collect())
    assert sorted((r.user_id, r.event_id, r.generation) for r in got.collect()) == want


def test_idle_users_lose_their_stacks(spark, store, tmp_path):
    from datetime import datetime

    kinds = "user_id long, event_id long, ts timestamp, kind string"
    make = lambda stream: undo_stream(stream, idle_ms=60_000)
    at = lambda m, s=0: datetime(2024, 1, 1, 0, m, s)
    for rows in ([(1, 1, at(0), "do"), (2, 2, at(0), "do")], [(2, 3, at(0, 50), "do"), (3, 4, at(5), "do")], [(3, 5, at(9), "do")], [(3, 6, at(10), "undo")]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark, make, tmp_path / "in", tmp_path / "state", tmp_path / "out")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.user_id, r.generation) for r in got.where("closed").collect()) == [(1, 1), (2, 2)]
    last = got.where("user_id = 3 and not closed").orderBy(F.desc("generation")).first()
    assert (last.can_undo, last.can_redo, last.generation) == (1, 1, 3)
