from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from codeloom.llm import url_lists as u

CAPTURES = [
    (1, "http://www.a.example/x/y?q=1", D(2024, 1, 5)), (2, "https://user@WWW.a.example.:8080/x", D(2024, 1, 15)), (3, "http://a.example", D(2024, 1, 5)),
    (4, "http://b.example/x//y/z", D(2024, 1, 5)), (5, None, D(2024, 1, 5)), (6, "not a url", D(2024, 1, 5)), (7, "http://b.example/", None),
    (8, "http://xa.example/", D(2024, 1, 5)), (1, "http://www.a.example/x/y?q=1", D(2024, 1, 5)), (9, "", D(2024, 1, 5))]
LOG = [
    ("l1", "*.a.example", "block", D(2024, 1, 1)), ("l1", "*.a.example", None, D(2024, 1, 10)), ("l1", "*.a.example", "block", D(2024, 1, 12)),
    ("l2", "www.a.example/x", "allow", D(2024, 1, 2)), ("l2", "www.a.example/x", "allow", D(2024, 1, 3)), ("l2", "www.a.example/x", None, D(2024, 1, 4, 12)),
    ("l1", "b.example/x/y", "allow", D(2024, 1, 5)), ("l2", "b.example/x/y", "block", D(2024, 1, 5)), (None, "b.example", "block", D(2024, 1, 1)),
    ("l1", None, "block", D(2024, 1, 1)), ("l1", "b.example", "block", None), ("l1", "xa.example", "block", D(2024, 1, 6))]


def _brute(captures, log):
    """Each capture against each entry's changes, one by one."""
    entries = {}
    for name, entry, verdict, at in log:
        if None not in (name, entry, at):
            entries.setdefault((name, entry), {}).setdefault(at, []).append(verdict)
    out = []
    for page, url, at, keys in captures:
        hits = []
        for (name, entry), changes in entries.items():
            past = [t for t in changes if at is not None and t <= at]
            if keys and entry in keys and past:
                said = sorted(v for v in changes[max(past)] if v is not None)
                if said:
                    hits.append((-len(entry), said[0] != "block", entry, name, said[0]))
        best = min(hits, default=None)
        out.append((page, url, best and best[4], best and best[2], best and best[3], len(hits)))
    return sorted(out, key=repr)


def _frames(spark, captures=CAPTURES, log=LOG):
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp_ntz").withColumn("entry", F.lit("clash")).withColumn("rid", F.lit(1))
    return c, spark.createDataFrame(log, "list string, entry string, verdict string, at timestamp_ntz")


@pytest.mark.parametrize("together", [1, 512])
def test_against_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(u, "TOGETHER", together)
    captures, log = _frames(spark)
    keys = [(r[0], r[1], r[2], r[3]) for r in captures.select("page_id", "url", "fetched_at", u.keys_of(F.col("url"))).collect()]
    found = [(r["page_id"], r["url"], r["verdict"], r["entry"], r["list"], r["active"]) for r in u.judged(captures, log).collect()]
    assert sorted(found, key=repr) == _brute(keys, LOG)


def test_keys(spark):
    frame = spark.createDataFrame([("https://user@WWW.a.Example.:8080/X/y?z#f",), ("http://h/1/2/3/4/5/6",), ("nothing",), (None,)], "url string")
    keys = [r[0] for r in frame.select(u.keys_of(F.col("url"))).collect()]
    assert set(keys[0]) == {"www.a.example", "*.www.a.example", "*.a.example", "*.example", "www.a.example/X", "www.a.example/X/y"}
    assert set(keys[1]) == {"h", "*.h", "h/1", "h/1/2", "h/1/2/3", "h/1/2/3/4"}
    assert keys[2] is None and keys[3] is None


def test_intervals(spark):
    _, log = _frames(spark)
    found = {(r["entry"], r["verdict"], r["valid_from"], r["valid_to"]) for r in u.intervals(log).collect() if r["entry"].endswith("a.example/x") or r["entry"] == "*.a.example"}
    assert found == {("*.a.example", "block", D(2024, 1, 1), D(2024, 1, 10)), ("*.a.example", "block", D(2024, 1, 12), None),
                     ("www.a.example/x", "allow", D(2024, 1, 2), D(2024, 1, 4, 12))}


def test_empty(spark):
    captures, log = _frames(spark)
    assert u.judged(captures.limit(0), log).count() == 0
    assert [r["active"] for r in u.judged(captures, log.limit(0)).collect()] == [0] * len(CAPTURES)


def test_plan_is_native(spark):
    captures, log = _frames(spark)
    plan = u.judged(captures, log)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_entries_of_any_depth(spark):
    captures, log = _frames(spark, [(1, "http://h.example/a/b/c/d/e/f/g", D(2024, 1, 5)), (2, "http://h.example/a/b/c/d/e", D(2024, 1, 5))],
                            [("l1", "h.example/a/b/c/d/e/f", "block", D(2024, 1, 1)), ("l1", "h.example/a", "allow", D(2024, 1, 1))])
    found = {r["page_id"]: (r["verdict"], r["entry"], r["active"]) for r in u.judged(captures, log).collect()}
    assert found == {1: ("block", "h.example/a/b/c/d/e/f", 2), 2: ("allow", "h.example/a", 1)}
