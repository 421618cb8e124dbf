from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from codeloom.llm import pieces
from codeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "  ", "Hello  world\n tab\t x", "▁literal ▁ x", "日本語テキスト 😀 é́", "a" * 200 + " b", " lead", "trail  ", "x\ry\r\n", "\x00\x01", "abc " * 50 + "é" * 60]


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(PATH)


def _keys(n, seed=1):
    return np.random.default_rng(seed).integers(0, 2 ** 63, n).astype(np.uint64)


def test_decoding_is_lossless(lattice):
    for text, ids in zip(ODD, lattice.sampled(ODD, _keys(len(ODD)))):
        assert lattice.decoded(ids) == text


def _chances(lattice, word):
    """All cuts of a word and their exact chances."""
    found = {}

    def go(at, cut, weight):
        if at == len(word):
            found[tuple(cut)] = weight
        for end in range(at + 1, len(word) + 1):
            if (piece := lattice.pieces.get(word[at:end])) is not None:
                go(end, [*cut, piece], weight * lattice.weights[piece])
    go(0, [], 1.0)
    total = sum(found.values())
    return {c: w / total for c, w in found.items()}


@pytest.mark.parametrize("longest, n", [(48, 40000), (3, 4000)])
def test_chances_are_those_of_the_lattice(lattice, monkeypatch, longest, n):
    monkeypatch.setattr(pieces, "LONG_WORD", longest)
    found = Counter(tuple(i.tolist()) for i in lattice.sampled(["there"] * n, _keys(n)))
    want = _chances(lattice, " there")
    assert set(found) <= set(want)
    likely = {c: p for c, p in want.items() if n * p > 5}
    assert sum((found[c] - n * p) ** 2 / (n * p) for c, p in likely.items()) < 3 * len(likely) + 12


def test_sharpness(lattice):
    sharp, flat = (Counter(tuple(i.tolist()) for i in pieces.Lattice(PATH, s).sampled(["there"] * 500, _keys(500))) for s in (3.0, 0.1))
    assert len(sharp) < len(flat)


def test_rows_are_cut_alike_in_any_company(lattice, monkeypatch):
    texts, keys = [t * 3 for t in ODD], _keys(len(ODD))
    together = lattice.sampled(texts, keys)
    alone = [lattice.sampled([t], keys[i:i + 1])[0] for i, t in enumerate(texts)]
    monkeypatch.setattr(pieces, "TOGETHER", 40)
    parts = lattice.sampled(texts, keys)
    assert all(np.array_equal(a, b) and np.array_equal(a, c) for a, b, c in zip(together, alone, parts))


def test_query(spark, duck, lattice):
    found = QUERIES["op10_sampled_segmentation"](spark, SF).toPandas().set_index("doc_id").sort_index()
    assert len(found) == duck.execute("SELECT count(*) FROM documents").fetchall()[0][0] and found["lossless"].all()
    again = pieces.segmented(spark.read.parquet(f"{SF}/documents.parquet").repartition(5, "source"), PATH).toPandas().set_index("doc_id").sort_index()
    assert (again["ids_crc32"] == found["ids_crc32"]).all() and (again["n_pieces"] == found["n_pieces"]).all()


def test_odd_rows(odd_docs, no_docs):
    cut = pieces.segmented(odd_docs, PATH, seed=3)
    assert cut.count() == odd_docs.count() and cut.where("not lossless").isEmpty()
    texts = sorted([r["text"] for r in pieces.joined(cut, PATH).collect()])
    assert texts == sorted([r["text"] or "" for r in odd_docs.collect()])
    other = pieces.segmented(odd_docs, PATH, seed=4)
    assert cut.where("doc_id = 10").first()["ids"] != other.where("doc_id = 10").first()["ids"]
    assert pieces.segmented(no_docs, PATH).count() == 0
