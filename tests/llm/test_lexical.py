import math
import re
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import lexical
from codeloom.llm.queries import CHECKS, QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, queries, k):
    """Every document against every query."""
    docs = [(i, plain_terms(t)) for i, t in docs if i is not None]
    docs = [(i, t) for i, t in docs if t]
    counts = [(i, Counter(t), len(t)) for i, t in docs]
    n, total = len(docs), sum(len(t) for _, t in docs)
    df = Counter(t for _, c, _ in counts for t in c)
    found = []
    for item, text in queries:
        scores = []
        for i, c, length in counts:
            m = 75 + 25 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            scores.append((-score, i))
        found += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(s for s in scores if s[0])[:k], 1)]
    return sorted(found)


@pytest.mark.parametrize("text", ["", "A.b!C", "é É x1_2y", "İß z\x85q 😀a-b", "\x00a\x7fb\t", "don't"])
def test_terms(text):
    assert [t.decode() for t in lexical.terms_of(text)] == plain_terms(text)


@pytest.mark.parametrize("seed", range(4))
def test_search_against_all_documents(spark, monkeypatch, seed):
    generator = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    chance = 1 / np.arange(1, 61) ** 1.1
    chance /= chance.sum()
    docs = [(int(i), " ".join(generator.choice(words, p=chance, size=int(generator.integers(0, 40))))) for i in range(300)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(50)]
    queries = [(q, " ".join(generator.choice(words, size=int(generator.integers(1, 14))))) for q in range(25)] + [(99, "w0 w0 unknown w5 W5")]
    monkeypatch.setattr(lexical, "SEED_EVERY", 3)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 32)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    # Workers import the module anew, so blocks there have their usual size; three partitions give three blocks.
    found = lexical.search(lexical.index(frame), asked, k=7, at_once=10)
    assert sorted(map(tuple, found.collect())) == plain_search(docs, queries, 7)


def lists_and_log(generator, docs, queries, terms=40):
    postings = []
    for t in range(terms):
        at = np.flatnonzero(generator.random(docs) < min(0.9, 3 / (t + 1))).astype(np.int32)
        postings.append((at, generator.integers(0, 1000, size=len(at)) * (1 + t)))
    asked = [{int(t): int(generator.integers(1, 3)) for t in generator.choice(terms, size=int(generator.integers(1, 9)), replace=False)} for _ in range(queries)]
    log = lexical._log(list(range(queries)), asked, np.array([len(d) for d, _ in postings]), docs, docs * 9)
    return postings, asked, log


@pytest.mark.parametrize("seed", range(5))
def test_blocks_pass_over_nothing_that_counts(seed):
    generator = np.random.default_rng(seed)
    postings, asked, log = lists_and_log(generator, 500, 60)
    lists = lexical.pair_lists(postings, np.arange(500, dtype=np.int64) * 3, log)
    totals = np.zeros((60, 500), dtype=np.int64)
    for q, counted in enumerate(asked):
        for t, r in counted.items():
            totals[q, postings[t][0]] += r * postings[t][1]
    alone, tight, _ = lexical.bounds(lists, log, 60)
    assert (tight <= alone).all() and (tight >= totals.max(axis=1)).all() and (tight < alone).any()
    for share in (0, 0.5, 0.9):
        least = (totals.max(axis=1) * share).astype(np.int64)
        touched = []
        found = {q: (d.tolist(), s.tolist()) for q, d, s in lexical.answers(lists, log, least, 10, touched)}
        for q in range(60):
            want = sorted((-s, 3 * d) for d, s in enumerate(totals[q].tolist()) if s > 0 and s >= least[q])[:10]
            assert found.get(q, ([], [])) == ([d for _, d in want], [-s for s, _ in want])
        if share == 0.9:
            assert sum(r for _, r in touched) < 0.7 * sum(len(postings[t][0]) for counted in asked for t in counted)


def test_pair_bounds_skip_where_term_bounds_do_not():
    a, b = (np.arange(0, 50, dtype=np.int32), np.full(50, 10)), (np.arange(50, 100, dtype=np.int32), np.full(50, 9))
    log = lexical._log([7], [{0: 1, 1: 1}], np.array([50, 50]), 100, 100)
    lists = lexical.pair_lists([a, b], np.arange(100), log)
    alone, tight, _ = lexical.bounds(lists, log, 1)
    assert alone.tolist() == [19] and tight.tolist() == [10]
    assert not list(lexical.answers(lists, log, np.array([11]), 5))


def test_odd_rows(spark, odd_docs, no_docs):
    asked = spark.createDataFrame([(1, "one two"), (2, None), (3, "..."), (1, "word x"), (None, "one"), (4, "naïve 日本")], "item_id long, text string")
    found = lexical.search(lexical.index(odd_docs), asked, k=50)
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = plain_search(docs, [(1, "one two")], 50) + plain_search(docs, [(1, "word x")], 50) + plain_search(docs, [(4, "naïve 日本")], 50)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert lexical.search(lexical.index(no_docs), asked).count() == 0
    assert lexical.search(lexical.index(odd_docs), asked.limit(0)).count() == 0


def test_query_on_more_rows(spark):
    import duckdb
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.01/{name}.parquet'")
    found = QUERIES["op12_pair_bound_maxscore"](spark, "/root/testdata/sf0.01")
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(CHECKS["op12_pair_bound_maxscore"]).fetchall())
