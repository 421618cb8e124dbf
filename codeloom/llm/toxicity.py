"""Toxic passages as maximum-scoring segments.

A token's evidence is the log-odds of its word, or of a beginning of it, between toxic and clean labelled documents,
with a Dirichlet prior from the counts of the whole corpus. A linear scan (Ruzzo and Tompa) finds every maximal segment
of a text's token scores. Chance segments of clean text follow an extreme-value law, whose rate and size are fitted to
clean labelled documents: it gives each segment the number expected by chance, and the significant segments of a text
are combined by the law of their sum.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from codeloom.llm.shared import chunks, slices, written

#: About so many labelled rows of each label are learnt from (those with the smallest hashes of their id).
TRAINING_ROWS = 16_384
#: Lengths of the beginnings of a word that count as evidence beside the word; longer words count by these alone.
BEGINNINGS = (3, 4, 5, 6)
LONGEST_WORD = 48
#: A word or beginning is evidence from so many toxic training documents on; a model holds this many at most.
LEAST_DOCS, MOST_FEATURES = 3, 262_144
#: Tokens that the prior counts for, standard errors taken off log-odds, and least log-odds that stay.
PRIOR, ERRORS, LEAST_ODDS = 10_000.0, 2.5, math.log(4)
#: Share of marked tokens in a toxic passage.
SHARE = 0.1
#: Segments expected by chance, at most, for one that counts as significant.
SIGNIFICANT = 0.05
THRESHOLD = 0.7
#: Tokens whose evidence a worker remembers at a time.
REMEMBERED = 400_000
_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r"\S+")
_DRIFT = math.log(1 - SHARE)


class Model(NamedTuple):
    """Scores of words and beginnings, and the law of chance segments: expected number = size * tokens * exp(-rate * score)."""
    scores: dict[str, float]
    rate: float
    size: float
    clean_for_toxic: float


class Segment(NamedTuple):
    first: int
    last: int
    score: float


def features(token: str) -> list[str]:
    """A token's words (``=word``) and the beginnings of its longer words."""
    found = []
    for word in (token,) if token.isalnum() else _WORD.findall(token):
        if len(word) <= LONGEST_WORD:
            found.append("=" + word)
        found += [word[:n] for n in BEGINNINGS if len(word) > n]
    return found


class _Scores(dict):
    """Score of a token: that of its strongest evidence, or 0 for none."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self._scores = scores

    def __missing__(self, token: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        get = self._scores.get
        value = self[token] = max((get(f, 0.0) for f in features(token)), default=0.0)
        return value


def _tokens(text: str) -> Iterator[list[str]]:
    for chunk in chunks(text):
        yield chunk.lower().split()


def segments(places: list[int], scores: list[float], drift: float = _DRIFT) -> list[Segment]:
    """All maximal scoring segments of a sequence with ``scores`` at ``places`` and ``drift`` elsewhere, in linear time.

    Each segment found so far keeps the sums before and behind it, and the nearest earlier one with a smaller sum before.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum behind, earlier segment
    total, last = 0.0, -1
    for place, score in zip(places, scores):
        before = total + drift * (place - last - 1)
        total, last = before + score, place
        first = place
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((first, place, before, total, j))
                break
            joined = j
            first, _, before, _, j = found[joined]
            del found[joined:]
    return [Segment(a, b, behind - before) for a, b, before, behind, _ in found]


def _hits(tokens: Iterator[list[str]], scores: dict[str, float]) -> tuple[int, list[int], list[float]]:
    """How many tokens there are, and the places and scores of those with evidence."""
    count, places, values = 0, [], []
    for part in tokens:
        own = np.fromiter(map(scores.__getitem__, part), np.float64, len(part))
        at = np.flatnonzero(own)
        places += (at + count).tolist()
        values += own[at].tolist()
        count += len(part)
    return count, places, values


def expected(found: list[Segment], tokens: int, model: Model) -> list[float]:
    """The number of chance segments with at least each one's score in a clean text of so many tokens."""
    return [model.size * max(tokens, 1) * math.exp(-model.rate * s.score) for s in found]


def chance(found: list[Segment], tokens: int, model: Model) -> float:
    """The expected number of clean texts, for this one, whose segments are together as strong: the best r segments for the best r.

    The r best normalised scores add up to T; a chance sum reaches it at exp(-T) T^(r-1) / (r! (r-1)!), and choosing r
    costs a factor of 2 for each further segment. Without segments every text is as strong.
    """
    offset = math.log(model.size * max(tokens, 1))
    best, total = max(offset, 0.0), 0.0
    for r, score in enumerate(sorted((s.score for s in found), reverse=True), 1):
        own = model.rate * score - offset
        if own <= 0:
            break  # weaker ones add nothing
        total += own
        value = -total + (r - 1) * (math.log(total) + math.log(2)) - math.lgamma(r + 1) - math.lgamma(r)
        best = min(best, value)
    return math.exp(min(best, 700.0))


def _lead(tokens: list[str]) -> int:
    """The smallest hash of three tokens in a row; of all tokens where there are fewer."""
    codes = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in tokens), np.uint64, len(tokens))
    if len(codes) < 3:
        return zlib.crc32(codes.tobytes())
    mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return int((mixed >> np.uint64(1)).min())


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """Training texts with their label, about ``rows`` of each label, one for texts whose smallest window hash is equal.

    Copies of a text, near ones too, would count as evidence of their own; most have that hash in common.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), (F.col(label_col).cast("int") > 0).cast("int").alias("label"),
        (F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / (1 << 30)).alias("place"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, rows / counts.get(1, 1)).otherwise(rows / counts.get(0, 1))
    chosen = known.where(F.col("place") < share).select("id", "label")  # about 2 * rows narrow rows at most
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "id").select("label", "text")
    schema = pa.schema([("label", pa.int32()), ("text", pa.string()), ("lead", pa.int64())])

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            leads = [_lead([t for part in _tokens(text) for t in part]) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leads, pa.int64())], schema=schema)

    marked = joined.mapInArrow(led, "label int, text string, lead long")
    # Of texts with one lead that with the smallest hash: a window over narrow keys would move the texts twice.
    return marked.groupBy("label", "lead").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")


def _candidates(toxic: DataFrame) -> list[str]:
    """Words and beginnings that several toxic training documents hold."""
    schema = pa.schema([("feature", pa.string()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.update({f for part in _tokens(text) for token in set(part) for f in features(token)})
            if len(held) > REMEMBERED:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

    counted = toxic.select("text").mapInArrow(count, "feature string, docs long").groupBy("feature").agg(F.sum("docs").alias("docs"))
    rows = counted.where(F.col("docs") >= LEAST_DOCS).orderBy(F.desc("docs"), "feature").limit(MOST_FEATURES).toArrow()
    return rows["feature"].to_pylist()


_COUNTS = ["everywhere", "toxic", "clean", "toxic_docs", "clean_docs"]


def _counts(texts: DataFrame, candidates: list[str]) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """Of each candidate its tokens in rows of any label (null: the corpus), and its tokens and documents by label.

    A token that a text repeats counts once in it. ``texts`` has ``label`` and ``text``. Tasks count whole texts and send
    numbers, at most one row a candidate.
    """
    shared = texts.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(candidates)})
    size = len(candidates)
    schema = pa.schema([("feature", pa.int32()), *((c, pa.int64()) for c in _COUNTS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        tokens = {None: Counter(), 1: Counter(), 0: Counter()}
        docs = {1: Counter(), 0: Counter()}
        totals = dict.fromkeys(tokens, 0)
        table = np.zeros((len(_COUNTS), size + 1), dtype=np.int64)  # the last place holds all tokens

        def flush() -> None:
            for row, (held, label) in enumerate(((tokens, None), (tokens, 1), (tokens, 0), (docs, 1), (docs, 0))):
                for token, n in held[label].items():
                    for f in features(token):
                        if (at := number.get(f)) is not None:
                            table[row, at] += n
                held[label].clear()

        for batch in slices(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                present = {token for part in _tokens(text or "") for token in part}
                tokens[label].update(present)
                totals[label] += len(present)
                if present and label is not None:  # a document counts once for a feature, however many of its tokens have it
                    docs_row = 3 if label == 1 else 4
                    own = {number.get(f, size) for token in present for f in features(token)}
                    own.discard(size)
                    table[docs_row, list(own)] += 1
            if sum(map(len, tokens.values())) > REMEMBERED:
                flush()
        flush()
        table[:3, size] = totals[None], totals[1], totals[0]
        at = np.flatnonzero(table.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(row[at]) for row in table)], schema=schema)

    sums = texts.mapInArrow(count, "feature int, " + ", ".join(f"{c} long" for c in _COUNTS)).groupBy("feature").agg(
        *(F.sum(c).alias(c) for c in _COUNTS)).toArrow()
    at = sums["feature"].to_numpy()
    found, totals = {}, {}
    for c in _COUNTS:
        whole = np.zeros(size + 1)
        whole[at] = sums[c].to_numpy()
        found[c], totals[c] = whole[:size], int(whole[size])
    return found, totals


def _evidence(candidates: list[str], own: dict[str, np.ndarray], tokens: dict[str, int], prior: np.ndarray) -> dict[str, float]:
    """Scores of the candidates whose log-odds are surely high, words first, then beginnings, longest first.

    A beginning is evidence where it is no weaker than the longer ones that are, or where it is evidence without their
    tokens: "wor" is none only because "worthless" is.
    """
    number = {f: i for i, f in enumerate(candidates)}
    whole = np.array([own[c] for c in _COUNTS[1:]], dtype=float).reshape(4, -1)
    left = whole.copy()

    def sure(counts: np.ndarray, i: int) -> float:
        toxic, clean, toxic_docs, clean_docs = counts.tolist()
        if toxic_docs < LEAST_DOCS:
            return 0.0
        odds = (math.log((toxic + prior[i]) / (tokens["toxic"] + PRIOR - toxic)) - math.log((clean + prior[i]) / (tokens["clean"] + PRIOR - clean)))
        # Tokens of one document are no independent evidence: the error is that of the numbers of documents.
        return odds - ERRORS * math.sqrt(1 / (toxic_docs + prior[i]) + 1 / (clean_docs + prior[i]))

    scores, longer = {}, np.zeros(len(candidates))
    for i in sorted(range(len(candidates)), key=lambda i: (candidates[i][0] != "=", -len(candidates[i]), candidates[i])):
        value = sure(whole[:, i], i)
        if value < longer[i]:
            value = sure(left[:, i], i)
        if value < LEAST_ODDS:
            continue
        scores[candidates[i]] = math.log(1 - SHARE + SHARE * math.exp(value))
        word = candidates[i].removeprefix("=")
        shorter = list({number[word[:n]] for n in BEGINNINGS if len(word) > n and word[:n] in number})
        longer[shorter] = np.maximum(longer[shorter], value)
        left[:, shorter] = np.maximum(left[:, shorter] - left[:, [i]], 0.0)
    return scores


def _law(training: DataFrame, scores: dict[str, float]) -> tuple[float, float]:
    """Rate and size of the law of chance segments, from the clean training documents.

    The rate solves mean(exp(rate * score)) = 1 over their tokens, one more token with the highest score added. The size
    makes the share of documents with a segment of at most one expected that of the law, and of at most ``SIGNIFICANT``
    expected no more than that of the law.
    """
    shared = training.sparkSession.sparkContext.broadcast(scores)
    schema = pa.schema([("tokens", pa.int64()), ("best", pa.float64()), ("scores", pa.list_(pa.float64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Scores(shared.value)
        for batch in slices(batches):
            rows = []
            for text in batch.column(0).to_pylist():
                n, places, values = _hits(_tokens(text), known)
                rows.append((n, max((s.score for s in segments(places, values)), default=0.0), values))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows = training.where("label = 0").select("text").mapInArrow(scan, "tokens long, best double, scores array<double>").where("tokens > 0")
    table = rows.select("tokens", "best").toArrow()  # one row a clean training document, TRAINING_ROWS of them
    marks = rows.select(F.explode("scores").alias("score")).groupBy("score").count().toArrow()  # one row a distinct score of the model
    lengths, best = table["tokens"].to_numpy(), table["best"].to_numpy()
    values = np.append(marks["score"].to_numpy(), max(scores.values(), default=1.0))
    counts = np.append(marks["count"].to_numpy(), 1).astype(float)
    everything = max(float(lengths.sum()), counts.sum() + 1)

    def mean(rate: float) -> float:
        return float((counts * np.exp(np.minimum(rate * values, 700))).sum() / everything + (1 - counts.sum() / everything) * math.exp(rate * _DRIFT))

    low, high = 0.0, 1.0
    while mean(high) < 1 and high < 1e3:
        low, high = high, 2 * high
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    rate = max(low, 1e-3)
    alone = np.log(np.maximum(lengths, 1)) - rate * best  # logarithms of the numbers expected at a size of 1
    sizes = [-math.log(1 - (int((alone <= math.log(most)).sum()) + 1) / (len(best) + 2)) / most for most in (1.0, SIGNIFICANT)]
    return rate, max(sizes)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          rows: int = TRAINING_ROWS) -> Model:
    """A model learnt from labelled documents and, for the prior, from the token counts of all ``docs``.

    ``labels`` holds an id and a label (above 0: toxic); null ids and labels are left out, ids without a document do not
    count, and null texts are empty. Without toxic documents no word is evidence. The driver holds the model's features,
    at most ``MOST_FEATURES``, and one row for each clean training document.
    """
    training = written(_labelled(docs, labels, id_col, text_col, label_col, rows), "labelled-texts")
    candidates = _candidates(training.where("label = 1"))
    everywhere = docs.select(F.lit(None).cast("int").alias("label"), F.col(text_col).cast("string").alias("text"))
    corpus, all_tokens = _counts(everywhere, candidates)
    own, tokens = _counts(training, candidates)
    prior = PRIOR * (corpus["everywhere"] + 1) / (all_tokens["everywhere"] + len(candidates) + 1)
    scores = _evidence(candidates, own, tokens, prior)
    rate, size = _law(training, scores)
    by_label = {r["toxic"]: r["count"] for r in labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
                .groupBy((F.col(label_col).cast("int") > 0).alias("toxic")).count().collect()}
    return Model(scores, rate, size, (by_label.get(False, 0) + 1) / (by_label.get(True, 0) + 1))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and ``passages``, the number of significant ones.

    Whole texts, no shuffle; columns of those names are replaced. The score is that of the odds clean to toxic times
    ``chance``. A null, empty or blank text is scored as one of no segments.
    """
    kept = docs.drop("score", "predicted", "passages")
    at = kept.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = _Scores(model.scores)
        for batch in slices(batches):
            values, numbers = [], []
            for text in batch.column(at).to_pylist():
                n, places, marks = _hits(_tokens(text or ""), known)
                found = segments(places, marks)
                values.append(1 / (1 + model.clean_for_toxic * chance(found, n, model)))
                numbers.append(sum(e <= SIGNIFICANT for e in expected(found, n, model)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, pa.float64()), pa.array([int(v >= threshold) for v in values], pa.int32()), pa.array(numbers, pa.int64())],
                names=[*batch.schema.names, "score", "predicted", "passages"])

    extra = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", T.LongType())]
    return kept.mapInArrow(scored, T.StructType([*kept.schema.fields, *extra]))


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", most: float = SIGNIFICANT) -> DataFrame:
    """Every significant passage: doc_id, start and end (code points, end exclusive), score, expected, text."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64()), ("text", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = _Scores(model.scores)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, places, marks = _hits(_tokens(text or ""), known)
                found = segments(places, marks)
                strong = [(s, e) for s, e in zip(found, expected(found, n, model)) if e <= most]
                if strong:
                    ends = {i for s, _ in strong for i in (s.first, s.last)}
                    spans = {i: m.span() for i, m in enumerate(_TOKEN.finditer(text)) if i in ends}
                    rows += [(doc, spans[s.first][0], spans[s.last][1], s.score, e, text[spans[s.first][0]:spans[s.last][1]]) for s, e in strong]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return narrow.mapInArrow(find, "doc_id long, start long, end long, score double, expected double, text string")
