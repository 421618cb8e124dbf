import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import nearest as ann
from codeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def _brute(rows, k):
    """Best k of each query, (score, id) by score and id."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def _found(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_query_recall(spark):
    found = _found(QUERIES["op5_cross_polytope"](spark, SF))
    want = _brute(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect(), 20)
    assert set(found) == set(want)
    hits = 0
    for q, rows in found.items():
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in [r[1] for r in rows]
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(rows, rows[1:]))
        hits += len({r[1] for r in rows} & {w[0] for w in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_lengths_copies_and_odd_vectors(spark):
    draw = np.random.default_rng(1)
    rows = [(i, (draw.normal(size=6) * draw.uniform(0.1, 9)).tolist()) for i in range(60)]
    rows += [(i, rows[3][1]) for i in range(100, 160)]  # copies of one vector
    odd = [(500, None), (520, [0.0] * 6), (540, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (560, [float("nan")] * 6), (580, [float("inf")] + [0.0] * 5), (600, [1.0, 2.0]), (None, [1.0] * 6), (100, rows[3][1])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("class", F.lit("x"))
    found, want = _found(ann.nearest(frame, F.col("id") % 20 == 0, block=16)), _brute(rows, 20)
    assert set(found) == set(want)
    hits = sum(len({r[1] for r in found[q]} & {w[0] for w in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want) and all(len(r) == 20 for r in found.values())
    copies = [q for q in want if rows[3][1] == dict(rows)[q]]
    for q in copies:
        # Nearer vectors come first, then the copies by id, the query's own row left out.
        assert [r[1] for r in found[q]] == [w[0] for w in want[q]]


def test_few_rows_and_none(spark):
    rows = [(i, [float(i == j) for j in range(4)] if i < 4 else [1.0, 1.0, 0.5, float(i)]) for i in range(8)]
    found = _found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0))
    assert [r[1] for r in found[0]] == [w[0] for w in _brute(rows, 20)[0]] and len(found[0]) == 7
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(none, F.col("id") % 20 == 0).count() == 0
    alone = spark.createDataFrame([(20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(alone, F.col("id") % 20 == 0).count() == 0


def test_joined_hashes(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 8))
    hashes = ann.Hashes(8, float(np.linalg.norm(x, axis=1).max()), False, 2, 3)
    buckets, probes = hashes.buckets(x), hashes.probed(x)
    assert buckets.shape == (300, 3) and len(set(buckets[:, 0]) & set(buckets[:, 1])) == 0
    unit = ann.Hashes(8, 1.0, True, 2, 3)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert (unit.probed(u).reshape(300, 3, -1)[:, :, 0] == unit.buckets(u)).all()
    h = ann.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8)) and probes.shape[1] == 3 * hashes.probes


def test_recall_does_not_fall_with_the_number_of_rows(spark, monkeypatch):
    # So small a bound on a bucket stands for a table of many rows, from which on hashes were joined.
    monkeypatch.setattr(ann, "ROWS_A_BUCKET", 0.05, raising=False)
    draw = np.random.default_rng(8)
    x = draw.normal(size=(2000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]
    found, want = _found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0)), _brute(rows, 20)
    hits = sum(len({r[1] for r in found[q]} & {w[0] for w in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_a_longer_stray_row_leaves_out_itself_alone(spark):
    draw = np.random.default_rng(9)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(60)]
    short = [(i, draw.normal(size=3).tolist()) for i in range(200, 230)]
    stray = [(400, draw.normal(size=7).tolist())]
    frame = spark.createDataFrame(rows + short + stray, "vec_id long, embedding array<double>")
    found = _found(ann.nearest(frame, F.col("id") % 20 == 0))
    for group in (rows, short):
        want = _brute(group, 20)
        assert want and set(want) <= set(found)
        assert sum(len({r[1] for r in found[q]} & {w[0] for w in want[q]}) for q in want) >= 0.9 * 20 * len(want)
        assert all({r[1] for r in found[q]} <= {i for i, _ in group} for q in want)
    assert 400 not in found
