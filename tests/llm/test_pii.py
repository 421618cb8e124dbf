import hashlib
import random
import re
import time

import numpy as np
import pytest

from codeloom.llm import pii
from codeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _plain(text):
    """The base kinds by their patterns as written."""
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@pytest.fixture(scope="module")
def model():
    return pii.train()


def test_base_spans_equal_the_patterns():
    draw = random.Random(5)
    for _ in range(15000):
        text = "".join(draw.choice("a1@.-+ 5(%_09é٣\n") for _ in range(draw.randint(0, 40)))
        assert pii.base_spans(text) == _plain(text)


def test_query(spark, duck):
    found = {r["doc_id"]: r for r in QUERIES["op4_personal_data"](spark, SF).collect()}
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(found) == len(rows)
    for doc, text in rows:
        base, row = _plain(text or ""), found[doc]
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert row["spans"] == joined or row["spans"].startswith(f"{joined}," if joined else "crf_")


def _best_by_trying(model, shapes):
    """The best labelling by trying all of them."""
    scores, step = pii._scores(model, *pii._features(np.array([shapes])))[0], model.step + pii._BARRED
    rows = [((s,), scores[0][s] + pii._FIRST[s]) for s in range(pii.STATES)]
    for t in range(1, len(shapes)):
        rows = [((*path, s), w + step[path[-1], s] + scores[t][s]) for path, w in rows for s in range(pii.STATES)]
    return max(rows, key=lambda r: r[1])


def test_viterbi_equals_trying_all():
    draw, model = np.random.default_rng(3), pii.Model()
    for part in model.parts():
        part += draw.normal(size=part.shape)
    for _ in range(5):
        shapes = draw.integers(1, len(pii.SHAPES), 4).tolist()
        assert tuple(pii.viterbi(model, np.array([shapes]))[0]) == _best_by_trying(model, shapes)[0]


def test_slope_is_that_of_the_likelihood():
    draw, model = np.random.default_rng(4), pii.Model()
    for part in model.parts():
        part += 0.1 * draw.normal(size=part.shape)
    shapes, states, lengths = np.array([[5, 9, 12], [20, 7, 0]]), np.array([[0, 1, 2], [3, 4, 0]]), np.array([3, 2])

    def loss():
        total = 0.0
        for s, y, n in zip(shapes, states, lengths):
            scores, step = pii._scores(model, *pii._features(np.array([s[:n]])))[0], model.step + pii._BARRED
            own = pii._FIRST[y[0]] + scores[0][y[0]] + sum(step[y[t - 1], y[t]] + scores[t][y[t]] for t in range(1, n))
            ahead = scores[0] + pii._FIRST
            for t in range(1, n):
                ahead = pii._logsum(ahead[:, None] + step, 0) + scores[t]
            total += pii._logsum(ahead, 0) - own
        return total

    slope = pii._slope(model, shapes, states, lengths)
    for part, found, at in ((model.single, slope[0], (2, 5, 0)), (model.single, slope[0], (3, 9, 1)), (model.step, slope[2], (1, 2)), (model.double, slope[1], (0, 5 * len(pii.SHAPES) + 9, 2))):
        part[at] += 1e-5
        high = loss()
        part[at] -= 2e-5
        assert abs((high - loss()) / 2e-5 - found[at]) < 1e-4
        part[at] += 1e-5


def test_model_finds_new_and_leaves_clean(model):
    def added(text):
        return [(k, text[a:b]) for k, a, b in pii.added_spans(model, [text], [pii.base_spans(text)])[0]]

    assert added('ther token = "0123456789abcdef0123456789abcdef01234567" end') == [("crf_secret", "0123456789abcdef0123456789abcdef01234567")]
    assert added("iner 1234567890123456 ther") == [("crf_card", "1234567890123456")]
    for clean in ("Licensed under CC BY-NC 4.0.", "GNU General Public License, version 3.", "In 1999, 12 of 345 were there.", "no digits at all", "", "a\nb"):
        assert added(clean) == []


def test_masking(model):
    text = "Mail a.b@c.example.org or +1 (017) 555-7713, 10.0.0.1!"
    assert pii.masked(text, pii.base_spans(text)) == "Mail [EMAIL] or [PHONE], [IP]!"


def test_long_texts_take_linear_time(model):
    for text in ("1" * 200000, "x" * 200000 + "@", "a@" * 20000, "+1(" * 20000, "1.2." * 20000):
        start = time.time()
        list(pii._found(model, [text]))
        assert time.time() - start < 10


def test_odd_rows(spark, odd_docs, no_docs, model):
    found = pii.personal_data(odd_docs, model)
    assert found.count() == odd_docs.count() and found.where("spans is null").count() == 0
    new = pii.without_personal_data(odd_docs, model)
    assert new.columns == odd_docs.columns and new.count() == odd_docs.count()
    assert new.where("text is null").count() == odd_docs.where("text is null").count()
    assert new.where("doc_id = 12").first()["text"] == "[EMAIL] [PHONE] [IP] [CARD]"
    assert pii.personal_data(no_docs, model).count() == 0 and pii.without_personal_data(no_docs, model).count() == 0


def test_spans_do_not_depend_on_their_place(model):
    phone, card = "(017) 555-7713", "4556 7375 8689 9854"

    def added(text):
        return [(k, text[a:b]) for k, a, b in pii.added_spans(model, [text], [pii.base_spans(text)])[0]]

    one = added(f"12 ab 34 cd call {card} or {phone} now")
    assert one
    for before in range(236, 262):
        text = "7 " * before + f"12 ab 34 cd call {card} or {phone} now"
        assert added(text)[-len(one):] == one
    token = "q" * 60 + "7" + "w" * 60
    assert [text[a:b] for text in [f"see {token}."] for row, places in pii.rows_of_words(text) for a, b in places if b - a > 9] == [token]


def test_windows_decoded_together_equal_each_alone(model, monkeypatch):
    draw = random.Random(7)
    texts = ["".join(draw.choice(["12", "+1 (017) ", "ab", " ", "-", "@", "4556 7375 ", "Xy9", "\n"]) for _ in range(n)) for n in [3, 40, 90, 700, 5, 700, 0, 300, 41]]
    base = [pii.base_spans(t) for t in texts]
    together = pii.added_spans(model, texts, base)
    assert together == [pii.added_spans(model, [t], [b])[0] for t, b in zip(texts, base)]
    monkeypatch.setattr(pii, "WORDS_AT_ONCE", 7)
    assert pii.added_spans(model, texts, base) == together


def test_examples_are_not_from_the_tables(duck):
    import re
    from codeloom.llm.pii_examples import EXAMPLES
    spans = {s for s in re.findall(r"\{\w+\|([^}]*)\}", EXAMPLES)} | {w for w in re.findall(r"\w+", EXAMPLES) if len(w) >= 12}
    assert len(spans) > 20
    for folder in ("sf0.001", "sf0.1"):
        for table, column in (("documents", "text"), ("pages", "html"), ("conversations", "text"), ("benchmark", "text")):
            hits = duck.execute(f"SELECT s FROM unnest(?) u(s) WHERE EXISTS (SELECT 1 FROM '/root/testdata/{folder}/{table}.parquet' WHERE contains({column}, s))", [sorted(spans)]).fetchall()
            assert hits == [], (folder, table, hits)
