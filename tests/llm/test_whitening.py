import math

import numpy as np
import pytest

from codeloom.llm import whitening
from codeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain(vectors):
    """Distinct integer vectors, their count, sums, eigenvalues and eigenvectors, by the dense solver."""
    x = np.array(sorted({tuple(math.floor(256 * float(c)) for c in v) for v in vectors}), dtype=np.float64)
    away = x - x.sum(axis=0) / len(x)
    values, vectors = np.linalg.eigh(away.T @ away / len(x))
    return len(x), [int(s) for s in x.sum(axis=0)], values[::-1], vectors[:, ::-1]


def test_query_against_dense_solver(spark, duck):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, sums, values, vectors = plain([r["embedding"] for r in rows])
    found = QUERIES["op13_spectrum_slicing"](spark, SF).toPandas()
    assert len(found) == 4 * len(rows) and (found["n"] == n).all() and found["identity_error"].max() < 1e-9
    table = {r["vec_id"]: np.array([math.floor(256 * float(c)) for c in r["embedding"]]) for r in rows}
    for k, part in found.groupby("component"):
        assert np.allclose(part["explained"], values[k - 1] / values.sum(), rtol=1e-12)
        want = np.array([(table[i] - np.array(sums) / n) @ vectors[:, k - 1] for i in part["vec_id"]]) / math.sqrt(values[k - 1])
        got = part["whitened"].to_numpy()
        assert np.allclose(got * np.sign(got @ want), want, atol=1e-9)
        assert part["deviation"].tolist() == [sum((n * int(x) - s) ** 2 for x, s in zip(table[i], sums)) for i in part["vec_id"]]


@pytest.mark.parametrize("seed", range(6))
def test_inertia_counts(seed):
    generator = np.random.default_rng(seed)
    a = generator.integers(-4, 5, size=(9, 9))
    a = np.tril(a) + np.tril(a, -1).T
    values = np.linalg.eigvalsh(a.astype(float))
    for shift in [*generator.normal(scale=5, size=20), -100, 100]:
        assert whitening.above(a.astype(float), float(shift)) == (values > shift).sum()


def test_counts_where_the_diagonal_is_zero():
    a = np.array([[0.0, 2, 1], [2, 0, 3], [1, 3, 0]])
    assert whitening.above(a, 0.0) == (np.linalg.eigvalsh(a) > 0).sum()
    assert whitening.above(np.zeros((3, 3)), 0.0) == 0


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [5, 5, 5, 1, 0], [9, 9 - 1e-9, 2, 2, 0], [1, 0, 0, 0, 0], [1e12, 1, 1e-3, 1e-9, 0], [2, 2, 2, 2, 2]])
def test_leading_with_ties_and_clusters(values):
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(5, 5)))[0]
    a = (q * np.array(values)) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.leading(a, 4)
    want = np.linalg.eigvalsh(a)[::-1][:len(found)]
    assert np.allclose(found, want, atol=1e-13 * max(values)) and len(found) == sum(v > 5e-15 * max(values) for v in values[:4])
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-12)
    assert np.allclose(a @ vectors, vectors * found, atol=1e-12 * max(values))


def test_wide_matrix():
    x = np.random.default_rng(1).normal(size=(400, 120))
    a = np.cov(x.T)
    found, vectors = whitening.leading(a)
    assert np.allclose(found, np.linalg.eigvalsh(a)[::-1][:4], rtol=1e-13)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 1.0]), (2, [0.1, 0.2, 0.3]), (3, [0.0, -0.0, 0.0]), (4, None), (5, [0.5, None, 1.0]), (6, [nan, 0.0, 0.0]),
            (7, [inf, 0.0, 0.0]), (1, [0.5, -0.25, 1.0]), (8, [0.501, -0.25, 1.0]), (9, []), (None, [-3.7, 2.0, 0.4]), (10, [1.0, 2.0]),
            (11, [0.3, -2.0]), (12, [1e38, 0.0, 0.0]), (13, [900.25, -70000.5, 1e6])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, n string, dim int")
    found = whitening.whitened(frame).toPandas()
    three = found[~found["vec_id"].isin([10, 11])]
    kept = [(i, v) for i, v in rows if i not in (4, 5, 6, 7, 9, 10, 11, 12)]
    n, sums, values, _ = plain([v for _, v in kept])
    assert n == 5 and (three["n"] == n).all() and len(three) == 3 * len(kept)
    assert np.allclose(three.groupby("component")["explained"].first(), values / values.sum(), rtol=1e-4)
    away = {i: sum((n * math.floor(256 * c) - s) ** 2 for c, s in zip(v, sums)) for i, v in kept if i is not None}
    assert all(away[i] == d for i, d in zip(three["vec_id"], three["deviation"]) if not np.isnan(i))
    two = found[found["vec_id"].isin([10, 11])]
    assert len(two) == 2 and (two["n"] == 2).all() and np.allclose(two["whitened"].abs(), 1)
    assert whitening.whitened(frame.limit(0)).count() == 0
    assert whitening.whitened(frame.where("vec_id = 1")).count() == 0
    huge = spark.createDataFrame([(1, [2.0 ** 54]), (2, [-2.0 ** 54]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert whitening.whitened(huge).toPandas()["deviation"].isna().tolist().count(True) == 2
