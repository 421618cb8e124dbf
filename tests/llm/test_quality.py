import zlib

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import quality
from codeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = QUERIES["op3_quality_classifier"](spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (rows["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in rows["doc_id"]]).all()
    assert ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all() and rows["score"].between(0, 1).all()
    apart = rows[rows["held_out"]]
    assert len(apart) > 50 and (apart["predicted"] == apart["quality"]).mean() >= 0.95
    good, bad = (apart[apart["quality"] == q]["score"].to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.98


def test_chunks_do_not_change_features(monkeypatch):
    text = "Alpha beta, GAMMA!! delta-1 épsilon  zeta\nalpha alpha *** eta " * 9
    whole = quality.Features().counted(text)
    weights = np.random.default_rng(0).normal(size=1 << quality.BITS).astype(np.float32)
    score = quality.Features().score(text, weights, 0.1)
    cut = [0, *[i + 1 for i, c in enumerate(text) if c in " \n"][::5], len(text)]
    monkeypatch.setattr(quality, "chunks", lambda t: [t[a:b] for a, b in zip(cut, cut[1:])])
    parts = quality.Features().counted(text)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])
    assert abs(quality.Features().score(text, weights, 0.1) - score) < 1e-9


def test_model_hangs_on_rows_alone(spark):
    rows = [(i, f"good words here {i}" if i % 3 else f"JUNK!! JUNK!! {i}", int(i % 3 > 0)) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    a = quality.fit(frame.repartition(1), "doc_id", "text", "label")
    b = quality.fit(frame.repartition(7, "text"), "doc_id", "text", "label")
    assert np.allclose(a, b) and np.abs(a).sum() > 0
    found = quality.score(frame, a).toPandas()
    assert (found["predicted"] == found["label"]).mean() > 0.95


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (10, 0), (11, None), (None, 1), (99999, 1)], "doc_id long, label int")
    weights = quality.fit(quality.training_rows(odd_docs, labels, "doc_id", "label"), "doc_id", "text", "label")
    clash = odd_docs.withColumn("score", F.lit("mine"))
    found = quality.score(clash, weights)
    assert found.count() == odd_docs.count() and found.where("score is null").count() == 0
    assert found.where("text is null or trim(text) = ''").select("score").distinct().count() == 1
    assert quality.score(no_docs, weights).count() == 0
    nothing = quality.fit(quality.training_rows(odd_docs, labels.limit(0), "doc_id", "label"), "doc_id", "text", "label")
    assert not nothing.any()
    assert {r["score"] for r in quality.score(odd_docs, nothing).collect()} == {0.5}


def test_column_named_as_the_label(spark):
    docs = spark.createDataFrame([(i, f"good words {i}" if i % 2 else f"JUNK!! {i}", "mine") for i in range(40)], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    weights = quality.fit(quality.training_rows(docs, labels, "doc_id", "label"), "doc_id", "text", "label")
    found = quality.score(docs, weights).toPandas()
    assert (found["predicted"] == found["doc_id"] % 2).all() and (found["label"] == "mine").all()


class PlainFTRL:
    """The same updates with one number at a time, in dictionaries."""

    def __init__(self):
        self.z, self.n = {}, {}

    def weight(self, i):
        z = self.z.get(i, 0.0)
        if abs(z) <= quality.L1:
            return 0.0
        return -(z - (1 if z > 0 else -1) * quality.L1) / ((quality.BETA + self.n.get(i, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    def learn(self, values, label):
        weights = {i: self.weight(i) for i in values}
        p = 1 / (1 + np.exp(-sum(weights[i] * v for i, v in values.items())))
        for i, v in values.items():
            g = (p - label) * v
            n = self.n.get(i, 0.0)
            self.z[i] = self.z.get(i, 0.0) + g - ((n + g * g) ** 0.5 - n ** 0.5) / quality.ALPHA * weights[i]
            self.n[i] = n + g * g


def test_updates_against_plain_ones():
    generator = np.random.default_rng(2)
    plain, model = PlainFTRL(), quality.FollowTheLeader()
    for _ in range(300):
        at = generator.choice(50, size=6, replace=False)
        values = generator.random(6)
        label = int(at.min() < 5)
        plain.learn({**dict(zip(at.tolist(), values.tolist())), 1 << quality.BITS: 1.0}, label)
        model.learn(at, values, label)
    found = model.weights()
    assert np.allclose([found[i] for i in [*range(50), 1 << quality.BITS]], [plain.weight(i) for i in [*range(50), 1 << quality.BITS]])
    assert not found[50:1 << quality.BITS].any()
