"""The stored set of seen keys."""

from pyspark.sql import functions as F

from codeloom.sources.seen_set import SeenSet


def keys(spark, rows):
    return spark.createDataFrame([(None if i is None else f"key {i}",) for i in rows], "key string")


def test_filters_keep_out_most_unseen_keys_and_no_seen_one(spark, tmp_path):
    known = SeenSet(spark, str(tmp_path / "s")).open()
    assert known.seen(keys(spark, range(5))).count() == 0
    known.add(keys(spark, range(8000)))  # three filters
    known.add(keys(spark, [*range(7000, 9000), None, 7000]))
    assert known._filters().where("generation = 0").count() == 3 and known._keys().count() == 9000
    assert known.possibly_seen(keys(spark, range(9000))).count() == 9000
    assert known.possibly_seen(keys(spark, range(20000, 40000))).count() < 20000 * 0.05
    assert known.seen(keys(spark, range(8990, 30000))).count() == 10


def test_flags(spark, tmp_path):
    known = SeenSet(spark, str(tmp_path / "s")).open()
    rows = keys(spark, [1, 2, 2, None]).withColumnRenamed("key", "hash")
    assert {r["seen"] for r in known.flagged(rows).collect()} == {False}
    known.add(keys(spark, [2, 3]))
    known.add(keys(spark, []))
    assert sorted((r["hash"] or "", r["seen"]) for r in SeenSet(spark, str(tmp_path / "s")).flagged(rows).collect()) == [
        ("", False), ("key 1", False), ("key 2", True), ("key 2", True)]


def test_stored_keys_are_joined_after_the_filters(spark, tmp_path):
    known = SeenSet(spark, str(tmp_path / "s")).open()
    known.add(keys(spark, range(100)))
    plan = known.seen(keys(spark, range(200)))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "bits" not in plan
