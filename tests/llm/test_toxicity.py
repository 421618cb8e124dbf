import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import toxicity
from codeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def plain_segments(values):
    """Maximal scoring segments by their recursive definition: the best segment (shortest first), then both sides of it."""
    best, at = 0.0, None
    for i in range(len(values)):
        total = 0.0
        for j in range(i, len(values)):
            total += values[j]
            if total > best + 1e-9 or (at and abs(total - best) <= 1e-9 and j - i < at[1] - at[0]):
                best, at = total, (i, j)
    if at is None:
        return []
    left, right = plain_segments(values[:at[0]]), plain_segments(values[at[1] + 1:])
    return [*left, (*at, best), *((a + at[1] + 1, b + at[1] + 1, s) for a, b, s in right)]


@pytest.mark.parametrize("seed", range(40))
def test_segments_against_definition(seed):
    generator = np.random.default_rng(seed)
    n = int(generator.integers(1, 40))
    values = np.where(generator.random(n) < 0.4, generator.random(n) * 3, -0.7)
    places = np.flatnonzero(values > 0)
    found = toxicity.segments(places.tolist(), values[places].tolist(), -0.7)
    want = plain_segments(values.tolist())
    assert [(s.first, s.last) for s in found] == [(a, b) for a, b, _ in want]
    assert np.allclose([s.score for s in found], [s for *_, s in want])


def test_many_segments_are_quick():
    places = list(range(0, 600_000, 3))
    assert len(toxicity.segments(places, [0.1] * len(places))) > 0


def test_features():
    assert toxicity.features("worthless,") == ["=worthless", "wor", "wort", "worth", "worthl"]
    assert toxicity.features("a-bcde") == ["=a", "=bcde", "bcd"] and toxicity.features("...") == []
    assert toxicity.features("x" * 60) == ["x" * n for n in (3, 4, 5, 6)]


def test_chance_falls_with_each_segment():
    model = toxicity.Model({}, 2.0, 0.1, 9.0)
    some = [toxicity.Segment(0, 0, 4.0), toxicity.Segment(9, 9, 4.0), toxicity.Segment(20, 20, 4.0)]
    values = [toxicity.chance(some[:r], 100, model) for r in range(4)]
    assert math.isclose(values[0], 10) and math.isclose(values[1], 10 * math.exp(-8)) and values == sorted(values, reverse=True)
    assert toxicity.chance([], 0, model) == 1


def test_held_out_accuracy(spark):
    found = QUERIES["op11_toxic_segments"](spark, SF)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (rows["held_out"] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in rows["doc_id"]]).all()
    assert ((rows["score"] >= 0.7) == (rows["predicted"] == 1)).all() and rows["score"].between(0, 1).all()
    apart = rows[rows["held_out"]]
    bad, good = (apart[apart["toxic"] == t] for t in (1, 0))
    assert len(bad) > 100 and bad["predicted"].mean() >= 0.9 and good["predicted"].mean() <= 0.04
    assert (bad["score"].to_numpy()[:, None] > good["score"].to_numpy()[None]).mean() > 0.96


def sentences(generator, insults, words=400):
    text = [f"w{int(i)}" for i in generator.integers(0, 500, size=words)]
    for at in insults:
        text[at] = ["grudfen", "grudlow", "Grudish!"][at % 3]
    return " ".join(text)


@pytest.fixture(scope="module")
def taught(spark):
    generator = np.random.default_rng(5)
    rows = [(i, sentences(generator, [50, 51, 53, 300, 301] if i % 5 == 0 else [], 400)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)] + [(None, 1), (7, None), (9999, 1)], "doc_id long, toxic int")
    return docs, labels, toxicity.train(docs, labels)


def test_passages_are_found_where_they_stand(spark, taught):
    docs, _, model = taught
    found = toxicity.passages(docs, model).toPandas()
    texts = dict(docs.collect())
    assert set(found["doc_id"]) == {i for i in range(200) if i % 5 == 0} and (found.groupby("doc_id").size() == 2).all()
    for row in found.itertuples():
        words = row.text.split()
        assert texts[row.doc_id][row.start:row.end] == row.text and len(words) in (2, 4)
        assert words[0].lower().startswith("grud") and words[-1].lower().startswith("grud") and row.expected <= toxicity.SIGNIFICANT
    scored = toxicity.score(docs, model).toPandas()
    assert (scored["predicted"] == (scored["doc_id"] % 5 == 0)).all() and (scored[scored["predicted"] == 1]["passages"] == 2).all()


def test_model_hangs_on_rows_alone(taught):
    docs, labels, model = taught
    again = toxicity.train(docs.repartition(5, "text"), labels.repartition(3))
    assert again.scores == pytest.approx(model.scores) and again[1:] == pytest.approx(model[1:])


def test_chunks_do_not_change_scores(taught, monkeypatch):
    docs, _, model = taught
    known = toxicity._Scores(model.scores)
    text = docs.first()["text"]
    whole = toxicity._hits(toxicity._tokens(text), known)
    cut = [0, *[i + 1 for i, c in enumerate(text) if c == " "][::7], len(text)]
    monkeypatch.setattr(toxicity, "chunks", lambda t: [t[a:b] for a, b in zip(cut, cut[1:])])
    assert toxicity._hits(toxicity._tokens(text), known) == whole


def test_odd_rows(spark, odd_docs, no_docs, taught):
    model = taught[2]
    clash = odd_docs.withColumn("score", F.lit("mine")).withColumn("passages", F.lit(1)).withColumn("label", F.lit("x"))
    found = toxicity.score(clash, model)
    assert found.count() == odd_docs.count() and found.where("score is null").count() == 0
    assert found.where("text is null or trim(text) = ''").select("score").distinct().count() == 1
    assert toxicity.score(no_docs, model).count() == 0 and toxicity.passages(no_docs, model).count() == 0
    assert toxicity.passages(odd_docs, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (10, 0), (11, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    weak = toxicity.train(clash, labels)
    assert weak.scores == {} and {r["predicted"] for r in toxicity.score(odd_docs, weak).collect()} == {0}
    assert toxicity.train(no_docs, labels.limit(0)).scores == {}
