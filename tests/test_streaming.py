"""Stream jobs: equality with one batch for any split of the input, restart from a checkpoint, gate, sinks."""

import pytest
from pyspark.sql import functions as F

from codeloom.sources import snapshots as SN
from codeloom.streaming import blocks as SB, merge as SM, sinks as SK

SCHEMA = "project_id string, path string, event_id bigint, ts timestamp, content string"
EVENTS = [("p", "A.py", 1, "a\nb"), ("p", "a.py", 2, "a\nb\nc"), ("p", "a.py", 3, "q\nr\ns"), ("p", "a.py", 4, "a\nb\nc"), ("p", "b.py", 5, "x"),
          ("p", "a.py", 6, "a\nb\nd"), ("p", "b.py", 7, "x")]
EXPECTED = {(1, "added", None), (2, "updated", "EXTENSION"), (3, "conflict", "UNRELATED"), (4, "unchanged", None), (5, "added", None),
            (6, "updated", "MODIFICATION"), (7, "unchanged", None)}


def write(spark, rows, folder, name):
    df = spark.createDataFrame([(p, f, i, c) for p, f, i, c in rows], "project_id string, path string, event_id bigint, content string")
    df.withColumn("ts", F.timestamp_seconds("event_id")).select("project_id", "path", "event_id", "ts", "content").coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder, out, state):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    SK.run_available(SM.live_merge(stream), out, state)
    return {(r.event_id, r.status, r.update_type) for r in spark.read.parquet(out).collect()}


@pytest.mark.parametrize("cuts", [[7], [1, 2, 3, 4, 5, 6, 7], [3, 7]])
def test_live_merge_for_any_split_with_restart(spark, tmp_path, cuts):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    start, got = 0, set()
    for n, end in enumerate(cuts):
        write(spark, EVENTS[start:end], folder, f"part{n}")
        got = run(spark, folder, out, state)  # every call is a restart from the checkpoint
        start = end
    assert got == EXPECTED


def test_capture_writes_statuses_changes_and_versions(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, EVENTS, folder, "all")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
    SK.start_live_capture(stream, out, str(tmp_path / "state"), availableNow=True).awaitTermination()
    assert spark.read.parquet(f"{out}/merged").count() == 7
    assert {r.type for r in spark.read.parquet(f"{out}/changes").collect()} == {"file_added", "file_updated", "conflict"}
    assert spark.read.parquet(f"{out}/versions").count() == 4


def test_gate_waits_for_rest(spark, tmp_path):
    rows = [(1, "e", "half", 0.0, True), (1, "e", "whole", 0.2, False), (2, "e", "busy", 0.3, True), (3, "e", "clock", 5000.0, False)]
    df = spark.createDataFrame(rows, "page_id bigint, element_id string, text string, s double, busy boolean")
    df.select("page_id", "element_id", "text", F.col("s").cast("timestamp").alias("ts"), "busy").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("page_id bigint, element_id string, text string, ts timestamp, busy boolean").parquet(str(tmp_path / "in"))
    SK.run_available(SM.complete_blocks(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {(r.page_id, r.text) for r in spark.read.schema(SM.GATED).parquet(str(tmp_path / "out")).collect()} == {(1, "whole")}


def test_append_once_is_idempotent(spark, tmp_path):
    for _ in range(2):
        SK.append_once(spark.range(5), 3, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 5


def test_busy_and_code_like(spark):
    df = spark.createDataFrame([("msg is-typing", None, "p", "x"), ("a", "streaming", "p", "x"), ("a", None, "pre", "x"), ("a", None, "p", "def f():\n" + "x" * 60), ("a", None, "p", "prose")],
                               "c string, s string, t string, x string")
    got = df.select(SB.is_busy("c", "s").alias("b"), SB.looks_like_code("c", "t", "x").alias("k")).collect()
    assert [(r.b, r.k) for r in got] == [(True, False), (True, False), (False, True), (False, True), (False, False)]


def test_snapshot_round_trip_and_project_sink(spark, tmp_path):
    files = spark.createDataFrame([(1, "p", "a.py", "python", "x\n\"q\""), (2, "q", "b/c.py", "python", "y")], "file_id bigint, project_id string, path string, language string, content string")
    records = SN.snapshot_records(files)
    SN.write_snapshot(records, str(tmp_path / "s"))
    back = SN.read_snapshot(spark, str(tmp_path / "s"))
    assert back.drop(SN.CORRUPT).exceptAll(records).count() == 0 and back.count() == 4
    SN.write_projects(files, str(tmp_path / "z"))
    assert spark.read.parquet(str(tmp_path / "z/files")).where("project_id = 'q'").first().path == "b/c.py"
    assert spark.read.parquet(str(tmp_path / "z/manifest")).count() == 2


@pytest.mark.parametrize("cuts", [[6], [1, 2, 3, 4, 5, 6], [2, 4, 6]])
def test_gate_gives_the_same_for_any_split(spark, tmp_path, cuts):
    rows = [(1, "e", "first", 0.0), (2, "e", "clock", 1200.0), (1, "e", "first", 1800.0), (1, "e", "second", 1801.0), (1, "e", "third", 1801.2), (3, "e", "clock", 9000.0)]
    start = 0
    for n, end in enumerate(cuts):
        df = spark.createDataFrame([(*r, False) for r in rows[start:end]], "page_id bigint, element_id string, text string, s double, busy boolean")
        df.select("page_id", "element_id", "text", F.col("s").cast("timestamp").alias("ts"), "busy").coalesce(1).write.parquet(str(tmp_path / f"in/part{n}"))
        stream = (spark.readStream.schema("page_id bigint, element_id string, text string, ts timestamp, busy boolean")
                  .option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")))
        SK.run_available(SM.complete_blocks(stream), str(tmp_path / "out"), str(tmp_path / "state"))
        start = end
    got = [(r.page_id, r.text) for r in spark.read.schema(SM.GATED).parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [(1, "first"), (1, "third"), (2, "clock")]
