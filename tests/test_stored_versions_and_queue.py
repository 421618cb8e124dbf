"""The stored version history and the change queue: batches, repeats, crashes, retries."""

import datetime

import pytest
from pyspark.sql import functions as F

from codeloom.operators.versions import retained
from codeloom.sources.version_store import VersionStore
from codeloom.streaming.queue import ChangeQueue

SCHEMA = "version_id long, project_id string, path string, content string, ts timestamp, is_favorite boolean"
CHANGE = "id long, kind string"


def saves(spark, rows):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, f"p{i % 3}", f"f{i % 5}", f"text {i}", start + datetime.timedelta(hours=i // 2), i % 11 == 0) for i in rows], SCHEMA)


def test_batches_give_what_one_pass_gives(spark, tmp_path):
    store = VersionStore.create(saves(spark, range(0, 60)), str(tmp_path / "s"), buckets=8, keep=2)
    one_file = saves(spark, [0, 15, 30]).select("project_id", "path").distinct()
    before = {r["bucket"]: r["held_by"] for r in store.held().collect()}
    store.save(saves(spark, [75, 90]))  # one file, so one bucket
    after = {r["bucket"]: r["held_by"] for r in store.held().collect()}
    assert sum(after[b] != g for b, g in before.items()) == 1
    for batch in (range(60, 75), range(60, 75), range(76, 90), range(91, 130)):
        store.save(saves(spark, batch))
    want = {r["version_id"] for r in retained(saves(spark, range(130)), 2).collect()}
    rows = store.versions().collect()
    assert {r["version_id"] for r in rows} == want and len(rows) == len(want)
    own = store.versions(one_file).collect()
    assert {(r["project_id"], r["path"]) for r in own} == {("p0", "f0")} and {r["version_id"] for r in own} == {i for i in want if i % 15 == 0}


def test_batch_that_breaks_off_and_is_repeated(spark, tmp_path, monkeypatch):
    store = VersionStore.create(saves(spark, range(10)), str(tmp_path / "s"), buckets=2, keep=5)
    with monkeypatch.context() as m:
        m.setattr(store._generations, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.save(saves(spark, range(10, 12)))
    assert store.versions().count() == 10
    store.save(saves(spark, range(10, 12)))
    assert VersionStore(spark, str(tmp_path / "s")).versions().count() == 12


def test_queue_retries_and_fences(spark, tmp_path):
    calls = []

    def deliver(rows, batch, attempt):
        calls.append((batch, attempt))
        if batch == 1 and attempt < 3 or batch == 2:
            raise ConnectionError("down")
        return rows.withColumn("kind", F.upper("kind"))

    queue = ChangeQueue(spark, str(tmp_path / "q"), deliver, F.when(F.col("kind").isNull(), "no kind")).open()
    batches = [spark.createDataFrame([(10 * n, "a"), (10 * n + 1, None)], CHANGE) for n in range(3)]
    for n, batch in enumerate(batches):
        queue.process(batch, n)
    for n, batch in enumerate(batches):  # run again, as after a restart
        queue.process(batch, n)
    assert calls == [(0, 1), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]
    assert sorted(tuple(r) for r in queue.sent(CHANGE).collect()) == [(0, "A", 1, 0), (10, "A", 3, 1)]
    dead = sorted((r["id"], r["reason"], r["attempts"], r["batch_id"]) for r in queue.dead(CHANGE).collect())
    assert dead == [(1, "no kind", 0, 0), (11, "no kind", 0, 1), (20, "ConnectionError: down", 3, 2), (21, "no kind", 0, 2)]


def test_crash_between_delivery_and_commit(spark, tmp_path, monkeypatch):
    queue = ChangeQueue(spark, str(tmp_path / "q")).open()
    batch = spark.createDataFrame([(1, "a"), (2, "b")], CHANGE)
    with monkeypatch.context() as m:
        m.setattr(queue._log, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            queue.process(batch, 0)
    queue.process(batch, 0)
    assert queue.sent(CHANGE).count() == 2 and queue.dead(CHANGE).count() == 0


def test_queue_as_a_stream(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(n, "a")], CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    queue = ChangeQueue(spark, str(tmp_path / "q")).open().run(stream, str(tmp_path / "c"))
    spark.createDataFrame([(9, "b")], CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    queue.run(stream, str(tmp_path / "c"))
    assert sorted(r["id"] for r in queue.sent(CHANGE).collect()) == [0, 1, 2, 9]


def test_contents_are_stored_once(spark, tmp_path):
    """Texts of many versions, of later batches and of buckets that are written again."""
    def batch(rows):
        return saves(spark, rows).withColumn("content", F.when(F.col("version_id") != 7, F.concat(F.lit("text "), (F.col("version_id") % 4).cast("string"))))

    store = VersionStore.create(batch(range(40)), str(tmp_path / "s"), buckets=4, keep=100)
    store.save(batch(range(30, 60)))
    stored = spark.read.parquet(str(tmp_path / "s" / "contents"))
    assert sorted(r["content"] for r in stored.collect()) == ["text 0", "text 1", "text 2", "text 3"]
    assert "content" not in spark.read.parquet(str(tmp_path / "s" / "versions")).columns
    got = {r["version_id"]: r["content"] for r in store.versions().collect()}
    assert got == {r["version_id"]: r["content"] for r in batch(range(60)).collect()}
