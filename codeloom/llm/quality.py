"""Text quality by hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text's features are counts of its words, of its word shapes, and of neighbouring pairs of either (a repeated
word is one pair of shapes), hashed into a fixed number of weights and divided by the number of words. A score is
a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from codeloom.llm.shared import chunks, slices

BITS = 18
FAMILIES = 4
#: Labelled rows that a model is fitted on at most (those with the smallest hash of their id).
TRAINING_ROWS = 16_000
#: Parts of the training rows that are fitted apart and averaged; fixed, so that a model depends on the rows alone.
PARTS = 4
#: Step size, its offset, and the two penalties of the updates.
ALPHA, BETA, L1, L2 = 20.0, 0.05, 0.0002, 0.001
THRESHOLD = 0.3
_WORD = re.compile(r"\w+|[^\w\s]+")
#: Words whose hashes a worker remembers at a time.
REMEMBERED = 400_000


class _Hashes(dict):
    """Two 32-bit hashes in one integer: of a word in lower case, and of its shape."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        lower = word.lower()
        if word == lower:
            shape = "a" if word.isalpha() else "9" if word.isdigit() else word[0] if not word[0].isalnum() else "m"
        else:
            shape = "A" if len(word) > 1 and word == word.upper() else "Aa" if word[1:] == lower[1:] else "aA"
        if len(word) > 1 and not word[0].isalnum():
            shape = f"{word[0]}+"
        code = self[word] = zlib.crc32(lower.encode("utf-8", "replace")) << 32 | zlib.crc32(shape.encode("utf-8", "replace"))
        return code


def _slots(codes: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Weight numbers, one row a family, of each word and of each word with its predecessor (0: none)."""
    word, shape = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    found = np.empty((FAMILIES, len(codes)), dtype=np.uint64)
    before_word, before_shape = follows >> np.uint64(32), follows & np.uint64(0xFFFFFFFF)
    found[0] = word
    found[1] = shape ^ np.uint64(0x5BD1E995)
    found[2] = word * np.uint64(0x9E3779B1) + before_word * np.uint64(0x85EBCA77)
    found[3] = np.where(word == before_word, np.uint64(1), shape * np.uint64(0xC2B2AE3D) + before_shape * np.uint64(0x27D4EB2F))
    found *= np.uint64(0x9E3779B97F4A7C15)
    return (found >> np.uint64(64 - BITS)).astype(np.int64)


class Features:
    """Weight numbers of texts. A text is read in chunks that end at blanks, so no chunk cuts a word."""

    def __init__(self):
        self._hashes = _Hashes()

    def slots(self, text: str) -> Iterator[np.ndarray]:
        last = np.zeros(1, dtype=np.uint64)
        for chunk in chunks(text):
            codes = np.fromiter(map(self._hashes.__getitem__, _WORD.findall(chunk)), dtype=np.uint64)
            if len(codes):
                yield _slots(codes, np.concatenate((last, codes[:-1])))
                last = codes[-1:]

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct weight numbers, and for each its count divided by the number of words."""
        parts = [np.unique(s, return_counts=True) for s in self.slots(text)]
        if not parts:
            return np.empty(0, dtype=np.int64), np.empty(0)
        at, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([p[1] for p in parts]))
        return at, counts * FAMILIES / counts.sum()

    def score(self, text: str, weights: np.ndarray, bias: float) -> float:
        total, words = 0.0, 0
        for slots in self.slots(text):
            total += float(weights[slots].sum(dtype=np.float64))
            words += slots.shape[1]
        return float(1 / (1 + np.exp(-(bias + (total / words if words else 0.0)))))


class FollowTheLeader:
    """Logistic regression fitted one row after the other (per-coordinate FTRL-proximal). The last weight is the bias."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        at, values = np.append(at, 1 << BITS), np.append(values, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(labelled: DataFrame, id_col: str, text_col: str, label_col: str) -> np.ndarray:
    """Weights (the last is the bias) learnt from labelled rows, whose number ``training_rows`` bounds.

    Rows with a null label take no part; a null text counts as empty. Rows are learnt from in the order of their
    id's hash, so repeated runs and any partitioning give the same model. With no labelled rows all weights are 0.
    """
    keyed = labelled.where(F.col(label_col).isNotNull()).select(
        F.xxhash64(F.col(id_col).cast("string")).alias("key"), F.col(id_col).cast("string").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"))
    part = F.pmod(F.col("key"), F.lit(PARTS)).cast("int")
    dealt = keyed.withColumn("part", part).repartition(PARTS, "part").sortWithinPartitions("part", "key", "id", "text", "label")
    schema = pa.schema([("slot", pa.int32()), ("weight", pa.float64())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model, part = Features(), FollowTheLeader(), None

        def learnt() -> pa.RecordBatch:
            w = model.weights()
            at = np.flatnonzero(w).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], schema=schema)

        for batch in slices(batches):
            for text, label, own in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "label", "part"))):
                if part is not None and own != part:
                    yield learnt()
                    model = FollowTheLeader()
                part = own
                model.learn(*features.counted(text), label)
        if part is not None:
            yield learnt()

    found = dealt.mapInArrow(learn, "slot int, weight double").groupBy("slot").agg((F.sum("weight") / PARTS).alias("weight"))
    weights = np.zeros((1 << BITS) + 1)
    table = found.toArrow()  # at most 2**BITS + 1 rows
    weights[table["slot"].to_numpy()] = table["weight"].to_numpy()
    return weights


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, rows: int = TRAINING_ROWS) -> DataFrame:
    """At most ``rows`` documents with a label, chosen on the narrow label table, so that texts of others never move.

    A column of ``docs`` that has the label column's name gives way to the label.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, label_col)
    chosen = chosen.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col, label_col).limit(rows)
    return docs.drop(label_col).join(F.broadcast(chosen), id_col)  # no more than `rows` narrow rows


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), whole texts, no shuffle.

    Columns of those names are replaced. An empty, null or blank text gets the score of the bias.
    """
    kept = docs.drop("score", "predicted")
    at = kept.columns.index(text_col)
    plain, bias = weights[:-1].astype(np.float32), float(weights[-1])
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches):
            found = np.array([features.score(t or "", shared.value, bias) for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return kept.mapInArrow(scored, schema)
