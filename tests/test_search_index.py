"""The stored search index against a scan of the whole table."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import search as S, search_index as I
from codeloom.operators.search_index import SearchIndex, grams
from codeloom.plans import search as P
from codeloom.sources import views as V
from codeloom.sources.tables import Tables
from oracle import SF

QUERIES = ["the", "Er the_of", "e", "an", "😀 naïve", "https example", "no such words zzqy", "  ", "doc_0.TXT"]


@pytest.fixture(scope="module")
def table(spark):
    rows = P.table(Tables(spark, SF))
    odd = rows.where("type = 'file'").limit(2).withColumn("key", F.concat(F.lit("odd_"), "key")).withColumn("content", F.when(F.col("key").endswith("1"), "NAÏVE 😀 text"))
    odd = odd.withColumn("search_text", F.lower(F.concat_ws(" ", "name", "path", "content")))
    return rows.unionByName(odd).cache()


def both(index, table, query):
    now = P._now()
    got = index.matches(query, now).select("key", F.round("score", 6).alias("s")).collect()
    want = S.matches(table, query, now).select("key", F.round("score", 6).alias("s")).collect()
    assert sorted(got) == sorted(want), query


def test_grams():
    assert grams("abcd") == ["abc", "bcd"] and grams("ab") == ["ab"] and grams("") == []


def test_queries_and_updates(spark, table, tmp_path):
    index = SearchIndex.create(table, str(tmp_path / "index"), slots=4, buckets=8)
    for query in QUERIES:
        both(index, table, query)
    changed = table.where("language = 'en'").withColumn("content", F.lit("wholly new zzqy words")).withColumn("search_text", F.lower(F.concat_ws(" ", "name", "path", "content")))
    added = changed.limit(1).withColumn("key", F.lit("file_new"))
    index.update(changed.unionByName(added), table.where("is_favorite"))
    now = table.join(changed.select("key"), "key", "left_anti").where("NOT is_favorite").unionByName(changed).unionByName(added).cache()
    for query in ("the", "wholly zzqy", "https example"):
        both(index, now, query)
    again = table.where("is_favorite").limit(3)
    index.update(again)  # rows that were taken out come back
    now = now.unionByName(again)
    both(index, now, "https example")
    smaller = index.compacted(str(tmp_path / "compacted"))
    assert smaller._generations.committed() == [0]
    both(smaller, now, "an")


def test_change_that_breaks_off_does_not_count(spark, table, tmp_path, monkeypatch):
    index = SearchIndex.create(table, str(tmp_path / "index"), slots=2, buckets=2)
    changed = table.where("type = 'file'").limit(5).withColumn("content", F.lit("zzqy")).withColumn("search_text", F.lit("zzqy"))
    with monkeypatch.context() as m:
        m.setattr(index._generations, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            index.update(changed)
    both(index, table, "zzqy")
    index.update(changed)
    assert index.matches("zzqy", P._now()).count() == 5


def test_scan_reads_the_querys_postings_alone(spark, table, tmp_path):
    index = SearchIndex.create(table, str(tmp_path / "index"), slots=4, buckets=8)
    plan = index.postings(["the"])._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):]
    assert "bucket" in filters[:filters.index("PushedFilters")] and "gram" in filters[filters.index("PushedFilters"):]
    assert "search_text" not in plan and "content" not in plan


def test_postings_are_short_numbers(spark, tmp_path):
    """Rows are named by their distance in a group, not by their keys; characters of any plane, and rows far apart."""
    rows = spark.range(0, 5000, numPartitions=3).select((F.col("id") * 20).alias("row_id"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("a\0😀"), F.col("id").cast("string"))).alias("search_text"))
    found = I._postings(rows, 4).cache()
    assert found.schema["places"].dataType.simpleString() == "array<smallint>"
    for gram, want in (("😀", lambda n: True), ("\0😀", lambda n: True), ("a\0", lambda n: True), ("😀77", lambda n: str(n).startswith("77")), ("4999", None), ("499", lambda n: "499" in str(n))):
        got = found.where(F.col("gram") == gram).select((F.col("first") + F.explode("places")).alias("n")).collect()
        assert sorted(r["n"] for r in got) == ([] if want is None else [20 * n for n in range(5000) if n % 9 and want(n)])
