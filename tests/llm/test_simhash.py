import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import simhash
from codeloom.llm.components import components
from codeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _print(text, words=4):
    found = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(found[i:i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def _roots(names, links):
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def _brute(prints):
    """Components of fingerprints by comparing all pairs."""
    v = np.array(sorted(set(prints)), dtype=np.uint64)
    a, b = np.nonzero(np.bitwise_count(v[:, None] ^ v[None]) <= 4)
    return _roots(v.tolist(), zip(v[a].tolist(), v[b].tolist()))


def _planted(seed, bases=40, copies=15):
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 2 ** 64, bases, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(k) for k in draw.choice(64, draw.integers(1, 7), replace=False))) for _ in range(copies)]
    return draw.permutation(np.unique(np.concatenate([base, *[base ^ f for f in flips], base[:5] ^ base[5:10] & np.uint64(7)])))


@pytest.mark.parametrize("seed", range(4))
def test_descent_spans_all_close_pairs(seed):
    v = _planted(seed)
    half = len(v) // 3

    def swapped(x):
        return (x << np.uint64(32)) | (x >> np.uint64(32))
    links = []
    for turn in (lambda x: x, swapped):
        for left, right in ((v[:half], None), (v[half:], None), (v[:half], v[half:])):
            a, b = simhash.close_links(turn(left), None if right is None else turn(right))
            assert (np.bitwise_count(a ^ b) <= 4).all()
            links += zip(turn(a).tolist(), turn(b).tolist())
    assert _roots(v.tolist(), links) == _brute(v.tolist())


@pytest.mark.parametrize("block, depth", [(8192, 6), (16, 0), (5, 3)])
def test_blocks_and_depths(spark, block, depth):
    v = _planted(9, 30, 10)
    frame = spark.createDataFrame([(x,) for x in v.view(np.int64).tolist()], "print long")
    links = simhash.links(frame, len(v), block=block, least_depth=depth).collect()
    assert _roots(v.tolist(), [(r["a"] % 2 ** 64, r["b"] % 2 ** 64) for r in links]) == _brute(v.tolist())


def test_components(spark):
    draw = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [tuple(draw.integers(200, 260, 2).tolist()) for _ in range(45)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = _roots(sorted({n for a, b in links if a != b for n in (a, b)}), links)
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, duck):
    found = {r["doc_id"]: r for r in QUERIES["op6_simhash_trie_join"](spark, SF).collect()}
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    prints = {d: _print(t) for d, t in rows}
    roots = _brute(prints.values())
    least = {}
    for doc, p in prints.items():
        least[roots[p]] = min(doc, least.get(roots[p], doc))
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in found.items()} == {d: (f"{p:016x}", least[roots[p]]) for d, p in prints.items()}


def test_chunks_do_not_change_prints(monkeypatch):
    text = "One two THREE four five\tsix seven\x0beight nine ten  eleven twelve é日 " * 7
    assert simhash.fingerprint(text) == _print(text)
    cut = [0, *[i + 1 for i, c in enumerate(text) if c in " \t"][::3], len(text)]
    monkeypatch.setattr(simhash, "chunks", lambda t: [t[a:b] for a, b in zip(cut, cut[1:])])
    assert simhash.fingerprint(text) == _print(text)


def test_odd_rows(odd_docs, no_docs):
    found = simhash.near_duplicates(odd_docs)
    assert found.count() == odd_docs.count()
    assert {r["fingerprint"] for r in found.where("doc_id in (0, 1, 2, 3)").collect()} == {"0" * 16}
    assert {r["component_id"] for r in found.where("doc_id in (0, 1, 2, 3, 100, 103)").collect()} == {0}
    kept = simhash.one_of_each(odd_docs)
    roots = _brute([int(r["fingerprint"], 16) for r in found.collect()])
    assert kept.columns == odd_docs.columns and kept.count() == len(set(roots.values()))
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0


def test_large_group_of_near_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common words of a long text " * 60), F.col("id").cast("string")).alias("text"))
    found = simhash.near_duplicates(docs)
    assert found.select("component_id").distinct().count() == 1 and found.count() == 3000
