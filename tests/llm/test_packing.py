import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codeloom.llm import packing
from codeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|> a<|startoftext|>b  <|end oftext|>", "ΑΣ ΣΑΣ. ΣΑΣ́ x", "é ́a  b c\x1cd\x0be\x85f", "I'll don't 's ' s", "１２３ ½ ② ٣4", "한국어 가 test", "😀😀🏽 a​b", "", "  \n",
       " a", "DŽ ǅ İ, İSTANBUL!", "﻿x \x00y", "ΑΣ́ͅ Σ", "à\ń", "don'' x'!s Ab'S", "Kelvin: K Å.", "a" * 5000, "!?" * 300, "Straße, ŉ! ﬁn.",
       "plain İ", "ÀÉ «Ça» – “l'Été’s” 3½ €5", "tab\x0bfeed\x0cunit\x1fsep", "<|startoftext|>Plain", "µ ª º", "A\x1f B \x1f c"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizers(tokenizer, duck):
    texts = ODD + [r[0] for r in duck.execute("SELECT text FROM documents").fetchall()]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder = packing.WordEncoder(PATH, None)
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder.ids_of(texts)] == want
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder.ids_of(texts)] == want  # from memory


def test_forgetting_and_chunks_do_not_change_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 3)
    monkeypatch.setattr(packing, "CHUNK", 20)
    monkeypatch.setattr(packing, "chunks", lambda t: [w + " " for w in t.split(" ")])
    texts = ["the quick, brown fox jumps!! over the lazy dog and more", "short", "words"] * 2
    assert [np.frombuffer(i, "<u4").tolist() for i in packing.WordEncoder(PATH, None).ids_of(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_another_tokenizer_encodes_whole_texts(tmp_path):
    from tokenizers import models, pre_tokenizers
    other = Tokenizer(models.WordLevel({"a": 0, "b c": 1, "?": 2}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Split(", ", "removed")
    other.save(str(tmp_path / "other.json"))
    found = packing.WordEncoder(str(tmp_path / "other.json"), None).ids_of(["a, b c, x", "", "B c"])
    assert [np.frombuffer(i, "<u4").tolist() for i in found] == [[0, 1, 2], [], [2]]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4095, 4096, 4097, 12345])
def test_binary_lengths(n):
    found = packing.binary_lengths(n)
    assert sum(found) == n and all(x & (x - 1) == 0 and x <= 4096 for x in found) and found == sorted(found, reverse=True)
    assert len(set(x for x in found if x < 4096)) == len([x for x in found if x < 4096])


def test_query(spark, duck, tokenizer):
    found = QUERIES["op9_power_of_two_packing"](spark, SF).toPandas()
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert sorted(found["sequence_id"]) == list(range(len(found))) and (found["offset"] == 0).all()
    assert set(found["doc_id"]) == set(texts)
    for doc, rows in found.sort_values("start").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (rows["doc_tokens"] == len(ids)).all() and rows["length"].sum() == len(ids)
        at = 0
        for r in rows.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes()) and r.length & (r.length - 1) == 0 and r.length <= 4096
            at += r.length


def test_odd_rows(odd_docs, no_docs):
    found = packing.pack(odd_docs, PATH).toPandas()
    assert found["sequence_id"].nunique() == len(found)
    assert found[found["start"] == 0].shape[0] == odd_docs.count()
    none = found[found["doc_id"] == 0]
    assert none["length"].tolist() == [1] and none["ids"].tolist() == [b"\2\0\0\0"]
    assert packing.pack(no_docs, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.token_pieces(odd_docs, PATH, longest=1000)
