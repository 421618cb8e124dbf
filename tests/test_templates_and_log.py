"""The template feed and the bounded log in stream state."""

import datetime

from codeloom.operators import template_feed as TF
from codeloom.streaming import log as LG, sinks as SK


def feed(spark, *rows):
    full = [(seq, kind, id, f.get("name"), f.get("description"), f.get("category"), None, f.get("tags"), f.get("files")) for seq, kind, id, f in rows]
    return spark.createDataFrame(full, TF.FEED)


def test_feed(spark):
    files = [("a.txt", "text", "x")]
    rows = feed(spark, (1, "add", "a", {"name": "A", "files": files}), (2, "change", "a", {"description": "new"}), (3, "change", "a", {"category": "web"}),
                (4, "add", "b", {"name": "B"}), (5, "delete", "b", {}), (6, "change", "b", {"name": "late"}), (7, "change", "c", {"name": "never added"}),
                (8, "add", "d", {"name": "D", "description": "old"}), (9, "delete", "d", {}), (10, "add", "d", {"name": "D2"}), (11, "delete", "e", {}))
    found = {r["id"]: r for r in TF.compacted(rows).collect()}
    assert set(found) == {"a", "d"}
    assert (found["a"]["name"], found["a"]["description"], found["a"]["category"], found["a"]["tags"]) == ("A", "new", "web", ["custom"])
    assert [tuple(f) for f in found["a"]["files"]] == files
    assert (found["d"]["name"], found["d"]["description"], found["d"]["language"], found["d"]["files"]) == ("D2", "", "text", [])
    assert TF.compacted(rows.limit(0)).count() == 0


def test_exchange(spark):
    one = TF.compacted(feed(spark, (1, "add", "a", {"name": "A", "files": [("a", "text", "x")], "tags": ["t"]})))
    lines = TF.to_json(one).unionByName(spark.createDataFrame([("{",), (None,), ('{"template":{"name":"","files":[]}}',), ('{"template":{"name":"n"}}',)], "value string"))
    read = TF.from_json(lines, 7)
    assert read.where("problem IS NOT NULL").count() == 4
    back = TF.compacted(read.where("problem IS NULL").drop("problem"))
    assert back.drop("id").collect() == one.drop("id").collect() and back.first()["id"].startswith("imported_")


def test_log_over_batches_and_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = datetime.datetime(2024, 1, 1)
    schema = "source_id long, ts timestamp, event_id long, type string"
    rows = [(i % 2, start + datetime.timedelta(seconds=(i * 7) % 20), i, "even" if i % 2 == 0 else "odd") for i in range(40)]

    def put(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = SK.run_updates(LG.bounded_logs(stream, 5), ["source_id"], str(tmp_path / "out"), str(tmp_path / "state"))
        return {r["source_id"]: r["event_ids"] for r in found.collect()}

    def want(part):
        return {s: [r[2] for r in sorted((r for r in part if r[0] == s), key=lambda r: (r[1], r[2]), reverse=True)[:5]] for s in {r[0] for r in part}}

    put(rows[:10]), put(rows[10:25])
    assert run() == want(rows[:25])
    put([r for r in rows[25:] if r[0] == 1])
    assert run() == want(rows[:25] + [r for r in rows[25:] if r[0] == 1])
