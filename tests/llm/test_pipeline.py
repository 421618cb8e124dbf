"""The pipeline against a plain version, stage by stage."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from codeloom.llm import pii, quality, simhash
from codeloom.llm.queries.op03_quality import learnt
from codeloom.llm.shared import written

SF = "/root/testdata/sf0.001"


def _plain(rows, weights):
    """Ids and texts that stay, worked out row by row."""
    features, plain, bias = quality.Features(), weights[:-1].astype(np.float32), float(weights[-1])
    good = {d: t for d, t in rows.items() if features.score(t or "", plain, bias) >= 0.3}
    first = {}
    for d in sorted(good):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", good[d] or ""), d)
    prints = {d: simhash.fingerprint(good[d]) for d in first.values()}
    stays, seen = [], set()
    for d in sorted(prints):
        if d in seen:
            continue
        stays.append(d)
        group, todo = {d}, [d]
        while todo:
            p = prints[todo.pop()]
            close = {e for e, q in prints.items() if e not in group and bin(p ^ q).count("1") <= 4}
            group |= close
            todo += close
        seen |= group
    model = pii.train()
    out = {}
    for d in stays:
        _, base, more = next(pii._found(model, [good[d]]))
        out[d] = pii.masked(good[d], base + more)
    return out


def test_stages(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns, name
    want = _plain(rows, learnt(spark, SF))
    assert 0 < len(want) < len(rows)
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
    assert docs.where("n_chars <> length(text)").isEmpty()
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed["doc_id"]) == set(want)
    for r in packed.itertuples():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            rows = docs.withColumnRenamed("doc_id", "doc_id")
            assert stage(spark, rows, SF).count() >= 0


@pytest.mark.parametrize("at, kept", [(1, 9), (2, 8)])
def test_decisions(spark, odd_docs, at, kept):
    found = corpus_pipeline.STAGES[at][1](spark, odd_docs, SF)
    assert 0 < found.count() < odd_docs.count()
