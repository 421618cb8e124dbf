import hashlib
import re

import pytest
from pyspark.sql import functions as F

from codeloom.llm import exact


def _brute(rows):
    """(id, keep, size, kept rows per text) by comparing whole texts."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", text or ""), []).append(doc)
    out = []
    for text, ids in groups.items():
        keep = min(ids, key=lambda i: (i is None, i or 0))
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def _rows(found):
    return sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found.collect()], key=repr)


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_against_brute_force(spark, odd_docs, size):
    docs = odd_docs if size > 1 else odd_docs.where("length(text) < 200 or text is null")
    found = exact.duplicate_classes(docs, size=size)
    want = _brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert _rows(found) == want
    assert found.where("kept").groupBy("text_sha256").count().where("count <> 1").isEmpty()
    assert found.where("kept").count() == len({w[3] for w in want})


@pytest.mark.parametrize("hashed", [lambda b: F.lit(7).cast("long"), lambda b: F.length(b).cast("long")])
def test_equal_hashes_do_not_join_texts(spark, hashed):
    texts = ["aaaa bbbb cccc", "aaaa bbbb cccd", "aaaa bbbb cccc", "bbbb aaaa cccc", "", None, "aaaa", "aaaa bbbb", "x" * 50, "x" * 49 + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert _rows(exact.duplicate_classes(docs, size=5, hashed=hashed)) == _brute(list(enumerate(texts)))


def test_staying_rows(spark, odd_docs, no_docs):
    kept = exact.without_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    normal = [re.sub(r"[ \t-\r]+", " ", t or "") for _, t in rows]
    assert len(normal) == len(set(normal))
    assert set(normal) == {re.sub(r"[ \t-\r]+", " ", r["text"] or "") for r in odd_docs.collect()}
    assert exact.without_duplicates(no_docs).count() == 0 and exact.duplicate_classes(no_docs).count() == 0


def test_plan_is_native(odd_docs):
    plan = exact.duplicate_classes(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_columns_with_inner_names_stay(spark):
    from codeloom.llm import simhash
    docs = spark.createDataFrame([(1, "a b c d e", 7, "k"), (2, "a  b c d e", 8, "k"), (2, "a  b c d e", 8, "k")], "doc_id long, text string, _key int, _chosen_id string")
    assert [tuple(r) for r in exact.without_duplicates(docs).collect()] == [(1, "a b c d e", 7, "k")]
    assert simhash.one_of_each(docs).columns == docs.columns
