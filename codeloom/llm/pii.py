"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds to them.

The model reads windows around digits and ``@`` signs, without which none of its kinds can be. A window is a row of
words and marks; each is known by its shape and its neighbours' shapes. Windows are decoded whole, those of similar
length together, by Viterbi's recurrence on arrays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from codeloom.llm.pii_examples import EXAMPLES
from codeloom.llm.shared import slices

# The base kinds, in the order in which spans are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Kinds that the model adds, in the order in which they follow the base kinds.
ADDED = ("crf_email", "crf_ip", "crf_card", "crf_phone", "crf_secret")
_LABELS = ("email", "ip", "card", "phone", "secret")
#: State 0 is outside; of kind k, 2k + 1 begins a span and 2k + 2 goes on.
STATES = 1 + 2 * len(_LABELS)

Span = tuple[str, int, int]


# ---- fixed patterns

def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            end = found.end()
            yield start, end
        else:
            end = max(end, at)
        at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by kind and start, in code points."""
    found = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


# ---- shapes

_DIGIT = re.compile("[0-9]")
_HINT = re.compile("[0-9@]+")
_WORD = re.compile(r"[^\W_]+|[^\w\s]|_")
#: Code points read on either side of a hint, and on to the end of the word there.
REACH = 48
#: Words, with those that fill up shorter windows, that are decoded together, unless one window has more; scores are worked out for as many.
WORDS_AT_ONCE = 1 << 16
_REST = re.compile(r"[^\W_]*")
_HEX = frozenset("0123456789abcdefABCDEF")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SHAPES = ["edge", "a", "A", "Aa", "aA", "other", "mark", "d1", "d2", "d3", "d4", "d5", "d9", "d13", "d20", "hex1", "hex16", "hex24",
          "hex41", "mix1", "mix16", *_MARKS]
_SHAPE = {s: i for i, s in enumerate(SHAPES)}


def shape(word: str) -> int:
    if len(word) == 1 and word in _SHAPE and not word.isalnum():
        return _SHAPE[word]
    n = len(word)
    if word.isascii() and word.isdigit():
        name = f"d{n}" if n < 5 else "d5" if n < 9 else "d9" if n < 13 else "d13" if n < 20 else "d20"
    elif word.isalpha():
        name = "a" if word.islower() else "A" if word.isupper() else "Aa" if word[1:].islower() else "aA"
    elif word.isalnum():
        if _HEX.issuperset(word):
            name = "hex1" if n < 16 else "hex16" if n < 24 else "hex24" if n < 41 else "hex41"
        else:
            name = "mix1" if n < 16 else "mix16"
    else:
        name = "mark"
    return _SHAPE.get(name, _SHAPE["other"])


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of ``text`` around its hints, from word border to word border; ranges that meet are one.

    A range does not cross a line end outside hints.
    """
    begin = stop = None
    for hint in _HINT.finditer(text):
        a = max(text.rfind("\n", max(0, hint.start() - REACH), hint.start()) + 1, hint.start() - REACH, 0)
        line = text.find("\n", hint.end(), hint.end() + REACH)
        b = min(line if line >= 0 else len(text), hint.end() + REACH)
        # What the range before has is not looked at again, so that a long word with many hints takes linear time.
        while a > (stop or 0) and text[a].isalnum() and text[a - 1].isalnum():
            a -= 1
        if b > (stop or 0) and b < len(text) and text[b - 1].isalnum():
            b = _REST.match(text, b).end()
        if begin is None:
            begin, stop = a, b
        elif a <= stop:
            stop = max(stop, b)
        else:
            yield begin, stop
            begin, stop = a, b
    if begin is not None:
        yield begin, stop


def rows_of_words(text: str) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
    """Shapes and ranges of the words of each window, the whole window in one row."""
    for a, b in windows(text):
        places = [m.span() for m in _WORD.finditer(text, a, b)]
        if places:
            yield [shape(text[x:y]) for x, y in places], places


# ---- the model

_OFFSETS = (-2, -1, 0, 1, 2)


class Model:
    """Weights: of a state by the shapes at five places and by two pairs of shapes, and of a state after another."""

    def __init__(self):
        n = len(SHAPES)
        self.single = np.zeros((len(_OFFSETS), n, STATES))
        self.double = np.zeros((2, n * n, STATES))
        self.step = np.zeros((STATES, STATES))

    def parts(self) -> list[np.ndarray]:
        return [self.single, self.double, self.step]


def _features(shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of shapes (padded with 0): the shapes at five places, and the two pairs."""
    rows, length = shapes.shape
    wide = np.zeros((rows, length + 4), dtype=np.int64)
    wide[:, 2:-2] = shapes
    at = np.stack([wide[:, 2 + o:2 + o + length] for o in _OFFSETS])
    n = len(SHAPES)
    return at, np.stack([at[1] * n + at[2], at[2] * n + at[3]])


def _scores(model: Model, single: np.ndarray, double: np.ndarray) -> np.ndarray:
    return sum(model.single[i][single[i]] for i in range(len(_OFFSETS))) + sum(model.double[i][double[i]] for i in range(2))


def _allowed() -> np.ndarray:
    """Steps that no labelling has: going on with a kind that was not begun."""
    barred = np.zeros((STATES, STATES))
    for k in range(len(_LABELS)):
        going = 2 * k + 2
        barred[[s for s in range(STATES) if s not in (going - 1, going)], going] = -1e4
    return barred


_BARRED = _allowed()
_FIRST = np.array([-1e4 if s and s % 2 == 0 else 0.0 for s in range(STATES)])


def viterbi(model: Model, shapes: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """The best states of each row; rows are padded with 0 to equal length, and the longer ones come first.

    Scores are worked out for some columns at a time, so a long row keeps one byte a word and state.
    """
    rows, length = shapes.shape
    lengths = np.full(rows, length) if lengths is None else lengths
    # Rows that have a word at each place: the first ones.
    live = np.searchsorted(-lengths, -np.arange(length), side="left").tolist()
    wide = np.zeros((rows, length + 4), dtype=np.int64)
    wide[:, 2:-2] = shapes
    step = model.step + _BARRED
    back = np.zeros((length, rows, STATES), dtype=np.int8)
    best = np.empty((rows, STATES))
    columns = max(1, WORDS_AT_ONCE // rows)
    for start in range(0, length, columns):
        some = wide[:live[start], start:start + columns + 4]
        single, double = _features(some)
        scores = _scores(model, single[:, :, 2:-2], double[:, :, 2:-2])
        for t in range(start, min(start + columns, length)):
            n = live[t]
            if t == 0:
                best[:] = scores[:, 0] + _FIRST
                continue
            every = best[:n, :, None] + step[None]
            back[t, :n] = every.argmax(axis=1)
            best[:n] = every.max(axis=1) + scores[:n, t - start]
    states = np.zeros((rows, length), dtype=np.int64)
    states[np.arange(rows), lengths - 1] = best.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        n = live[t]
        states[:n, t - 1] = back[t, np.arange(n), states[:n, t]]
    return states


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def _slope(model: Model, shapes: np.ndarray, states: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Expected less observed counts of each weight, by the forward and backward recurrences."""
    single, double = _features(shapes)
    scores, step = _scores(model, single, double), model.step + _BARRED
    rows, length, _ = scores.shape
    live = np.arange(length)[None] < lengths[:, None]
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0] + _FIRST
    for t in range(1, length):
        found = _logsum(ahead[:, t - 1, :, None] + step[None], 1) + scores[:, t]
        ahead[:, t] = np.where(live[:, t, None], found, ahead[:, t - 1])
    for t in range(length - 2, -1, -1):
        found = _logsum(step[None] + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(live[:, t + 1, None], found, 0.0)
    total = _logsum(ahead[:, -1], 1)
    share = np.exp(ahead + behind - total[:, None, None]) * live[:, :, None]
    share[np.arange(rows)[:, None], np.arange(length)[None], states] -= live
    found = [np.zeros_like(p) for p in model.parts()]
    for i in range(len(_OFFSETS)):
        np.add.at(found[0][i], single[i], share)
    for i in range(2):
        np.add.at(found[1][i], double[i], share)
    for t in range(1, length):
        pair = np.exp(ahead[:, t - 1, :, None] + step[None] + (scores[:, t] + behind[:, t])[:, None, :] - total[:, None, None])
        found[2] += (pair * live[:, t, None, None]).sum(axis=0)
        np.add.at(found[2], (states[:, t - 1], states[:, t]), -live[:, t].astype(float))
    return found


def labelled(examples: str) -> list[tuple[list[int], list[int]]]:
    """(shapes, states) of the windows of marked sentences."""
    found = []
    for line in examples.strip().split("\n"):
        text, spans = "", []
        for piece in re.split(r"(\{\w+\|[^}]*\})", line):
            if marked := re.fullmatch(r"\{(\w+)\|([^}]*)\}", piece):
                spans.append((_LABELS.index(marked[1]), len(text), len(text) + len(marked[2])))
                piece = marked[2]
            text += piece
        for shapes, places in rows_of_words(text):
            states = [next((2 * k + (1 if a == x else 2) for k, a, b in spans if a <= x < b), 0) for x, _ in places]
            found.append((shapes, states))
    return found


def train(examples: str = EXAMPLES, rounds: int = 120, rate: float = 0.3, shrink: float = 0.02) -> Model:
    """A model fitted to a small labelled table by steps of adaptive length along the slope of its likelihood."""
    rows = labelled(examples)
    lengths = np.array([len(s) for s, _ in rows])
    shapes, states = (np.zeros((len(rows), lengths.max()), dtype=np.int64) for _ in range(2))
    for i, (s, y) in enumerate(rows):
        shapes[i, :len(s)], states[i, :len(y)] = s, y
    model = Model()
    seen = [np.full_like(p, 1e-6) for p in model.parts()]
    for _ in range(rounds):
        for weights, slope, square in zip(model.parts(), _slope(model, shapes, states, lengths), seen):
            slope = slope + shrink * weights
            square += slope * slope
            weights -= rate * slope / np.sqrt(square)
    return model


def added_spans(model: Model, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans that the model finds in each text and that meet none of the base spans, by kind and start."""
    waiting = [(i, shapes, places) for i, text in enumerate(texts) for shapes, places in rows_of_words(text)]
    waiting.sort(key=lambda row: -len(row[1]))
    found: list[list[Span]] = [[] for _ in texts]
    start = 0
    while start < len(waiting):
        longest = len(waiting[start][1])
        part = waiting[start:start + min(512, max(1, WORDS_AT_ONCE // longest))]
        # A row far shorter than the first waits, so that little is filled up.
        part = [row for row in part if 2 * len(row[1]) > longest]
        start += len(part)
        lengths = np.array([len(s) for _, s, _ in part])
        shapes = np.zeros((len(part), longest), dtype=np.int64)
        for row, (_, s, _) in zip(shapes, part):
            row[:len(s)] = s
        for (i, _, places), states in zip(part, viterbi(model, shapes, lengths)):
            if not states.any():
                continue
            spans: list[list[int]] = []
            for state, (a, b) in zip(states.tolist(), places):
                if state % 2:
                    spans.append([state // 2, a, b])
                elif state:
                    spans[-1][2] = b
            found[i] += [(ADDED[k], a, b) for k, a, b in spans
                         if _HINT.search(texts[i], a, b) and not any(a < y and x < b for _, x, y in base[i])]
    return [sorted(s, key=lambda x: (ADDED.index(x[0]), x[1])) for s in found]


# ---- tables

def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _found(model: Model, texts: list[str | None]) -> Iterator[tuple[str, list[Span], list[Span]]]:
    whole = [t or "" for t in texts]
    hinted = [i for i, t in enumerate(whole) if _HINT.search(t)]
    base: list[list[Span]] = [[] for _ in whole]
    more: list[list[Span]] = [[] for _ in whole]
    for i in hinted:
        base[i] = base_spans(whole[i])
    for i, spans in zip(hinted, added_spans(model, [whole[i] for i in hinted], [base[i] for i in hinted])):
        more[i] = spans
    yield from zip(whole, base, more)


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of each text, in code points; a null text counts as empty. Map-only; rows may repeat."""
    schema = T.StructType([docs.schema[id_col], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more))
                    for _, base, more in _found(model, batch.column(1).to_pylist())]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.select(id_col, docs[text_col].cast("string").alias("_text")).mapInArrow(search, schema)


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind; spans that meet are one, named by the first."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{kind.removeprefix('crf_').upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def without_personal_data(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in their texts masked; a null text stays null, other columns stay as they are."""
    at = docs.columns.index(text_col)

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            new = [None if old is None else masked(text, base + more)
                   for old, (text, base, more) in zip(texts, _found(model, texts))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(replaced, docs.schema)
