"""Ranked lexical search: MaxScore whose bounds are tightened by pairs of terms.

Documents lie in blocks. A block's index holds the postings of its terms; for a log of queries it also holds, for
chosen pairs of their terms, the documents with both and the largest impact both have together. A query's bound in a
block is the sum of its terms' largest impacts, less what each pair's joint maximum says they cannot reach together.
Blocks, then terms, then documents whose bound is below the score of the k-th document so far are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.llm.shared import CHUNK, slices, written

#: A block is closed at so many documents, or at so many terms with repeats.
BLOCK_DOCS, BLOCK_TERMS = 8192, 2_000_000
#: Queries that are answered together; more are answered in several rounds.
QUERIES_AT_ONCE = 4096
#: One block of so many is searched first; its scores are the thresholds for the others.
SEED_EVERY = 16
#: Bounds of saturation (fixed values of the ranking formula).
FREE, SLOPE, SATURATION, GAIN = 75, 25, 12, 1_000_000_000

_UPPER = bytes(range(65, 91))
_TABLE = bytes(c + 32 if c in _UPPER else c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
POSTINGS = "block long, term binary, df long, total long, docs binary, counts binary"


def terms_of(text: bytes | str | None) -> list[bytes]:
    """A text's terms in order, as UTF-8: runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    if isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    return text.translate(_TABLE).split() if text else []


class _Block:
    """Postings of documents that arrive one after the other."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.keys: list[np.ndarray] = []  # term number << 32 | document
        self.counts: list[np.ndarray] = []
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.total = 0

    def add(self, doc: int, text: bytes | None) -> None:
        here, numbers, length = len(self.ids), self.numbers, 0
        parts = []
        text = text or b""
        for start, end in _cuts(text):
            terms = text[start:end].translate(_TABLE).split()
            for term in set(terms).difference(numbers):
                numbers[term] = len(numbers)
            parts.append(np.unique(np.fromiter(map(numbers.__getitem__, terms), np.int64, len(terms)), return_counts=True))
            length += len(terms)
        if not length:
            return
        at, counts = parts[0] if len(parts) == 1 else _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        self.keys.append(at << 32 | here)
        self.counts.append(counts)
        self.ids.append(doc)
        self.lengths.append(length)
        self.total += length

    def rows(self, block: int) -> pa.RecordBatch:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        term = keys >> 32
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        docs, tfs = (keys & 0xFFFFFFFF).astype("<i4").tobytes(), counts.astype("<i4").tobytes()
        cuts = [*(4 * starts).tolist(), len(docs)]
        df, total = np.diff(cuts) // 4, np.add.reduceat(counts, starts)
        names = list(self.numbers)
        # The block's own row has no term: document ids and lengths.
        head = [len(self.ids), self.total, np.array(self.ids, "<i8").tobytes(), np.array(self.lengths, "<i8").tobytes()]
        columns = [[block] * (len(names) + 1), [None, *names], [head[0], *df.tolist()], [head[1], *total.tolist()],
                   [head[2], *(docs[a:b] for a, b in zip(cuts, cuts[1:]))], [head[3], *(tfs[a:b] for a, b in zip(cuts, cuts[1:]))]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                                          names=["block", "term", "df", "total", "docs", "counts"])


def _cuts(text: bytes) -> Iterator[tuple[int, int]]:
    """Ends of pieces of a long text, each cut behind a blank."""
    start = 0
    while len(text) - start > CHUNK:
        end = text.find(b" ", start + CHUNK)
        if end < 0:
            break
        yield start, end
        start = end
    yield start, len(text)


def _summed(at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(at, return_inverse=True)
    return found, np.bincount(back, weights=counts).astype(np.int64)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings of all terms of all documents, block by block, as a table in the shared folder. No shuffle.

    A null or empty text, and one without terms, is in no block. Rows with the same id are documents of their own;
    a row with a null id is left out, since no result could name it. Other columns are not looked at.
    """
    narrow = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"),
                                                         F.col(text_col).cast("string").cast("binary").alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = _Block(), TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.add(doc, text)
                if len(block.ids) >= BLOCK_DOCS or block.total >= BLOCK_TERMS:
                    yield from slices([block.rows(number)], 16384)
                    block, number = _Block(), number + 1
        if block.ids:
            yield from slices([block.rows(number)], 16384)

    return written(narrow.mapInArrow(build, POSTINGS), "postings")


class Log(NamedTuple):
    """Queries as numbers: of each (query, term) its query, term and repeats, and of each query the pairs of its terms."""
    items: list[int]
    weights: np.ndarray  # of each term
    query: np.ndarray
    term: np.ndarray
    repeats: np.ndarray
    pairs: np.ndarray  # distinct pairs of terms, two columns
    pair_query: np.ndarray
    pair: np.ndarray
    pair_repeats: np.ndarray  # repeats that both terms of the pair have in the query
    docs: int
    terms: int


def _weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _log(items: list[int], lists: list[dict[int, int]], df: np.ndarray, docs: int, terms: int) -> Log:
    weights = np.array([_weight(docs, int(d)) for d in df], dtype=np.int64)
    query, term, repeats, pairs, pair_query, pair, pair_repeats = [], [], [], {}, [], [], []
    for q, counted in enumerate(lists):
        # Heavy terms seldom share documents, so neighbours by weight lose most of their independent bound.
        order = sorted((t for t in counted if df[t]), key=lambda t: (-weights[t] * counted[t], t))
        query += [q] * len(order)
        term += order
        repeats += [counted[t] for t in order]
        for a, b in zip(order[::2], order[1::2]):
            key = (min(a, b), max(a, b))
            pair_query.append(q)
            pair.append(pairs.setdefault(key, len(pairs)))
            pair_repeats.append(min(counted[a], counted[b]))
    whole = np.array
    return Log(items, weights, whole(query, np.int64), whole(term, np.int64), whole(repeats, np.int64),
               whole(list(pairs), np.int64).reshape(-1, 2), whole(pair_query, np.int64), whole(pair, np.int64), whole(pair_repeats, np.int64), docs, terms)


class Lists(NamedTuple):
    """A block's postings for a log: documents and impacts of its terms, and the joint lists of its pairs."""
    ids: np.ndarray
    starts: np.ndarray  # of each term of the log, and the end
    docs: np.ndarray
    impacts: np.ndarray
    best: np.ndarray  # largest impact of each term
    pair_starts: np.ndarray
    pair_docs: np.ndarray
    joint: np.ndarray  # largest impact of each pair: of both terms together, or of one where that is larger


def pair_lists(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, log: Log) -> Lists:
    """``lists`` holds each term's documents and impacts; adds, pair by pair, the intersection and its joint maximum."""
    best = np.array([i.max(initial=0) for _, i in lists], dtype=np.int64)
    dense = np.zeros(len(ids), dtype=np.int64)
    joint, found = [], []
    for a, b in log.pairs.tolist():
        (docs_a, impacts_a), (docs_b, impacts_b) = lists[a], lists[b]
        top = max(best[a], best[b])
        common = docs_a[:0]
        if len(docs_a) and len(docs_b):
            dense[docs_a] = impacts_a + 1  # an impact may be 0: one more says that the document is there
            held = dense[docs_b]
            both = held > 0
            common = docs_b[both]
            if len(common):
                top = max(top, (held[both] - 1 + impacts_b[both]).max())
            dense[docs_a] = 0
        joint.append(top)
        found.append(common)
    none = [np.zeros(0, np.int32)]
    return Lists(ids, np.cumsum([0, *(len(d) for d, _ in lists)]), np.concatenate([d for d, _ in lists] or none),
                 np.concatenate([i for _, i in lists] or none).astype(np.int64), best,
                 np.cumsum([0, *map(len, found)]), np.concatenate(found or none), np.array(joint, dtype=np.int64))


def bounds(lists: Lists, log: Log, queries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query of the log the bound by terms alone, the bound with pairs, and of each pair use what it takes off."""
    alone = np.bincount(log.query, weights=log.repeats * lists.best[log.term], minlength=queries).astype(np.int64)
    off = log.pair_repeats * (lists.best[log.pairs[log.pair]].sum(axis=1) - lists.joint[log.pair]) if len(log.pair) else np.zeros(0, np.int64)
    return alone, alone - np.bincount(log.pair_query, weights=off, minlength=queries).astype(np.int64), off


def answers(lists: Lists, log: Log, least: np.ndarray, k: int, touched: list | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, documents, scores): a block's best k for each query that may reach ``least``, its threshold.

    ``touched`` gathers (query, postings that were read), for tests of how much is passed over.
    """
    queries = len(log.items)
    alone, tight, off = bounds(lists, log, queries)
    starts = np.searchsorted(log.query, np.arange(queries + 1))
    pair_starts = np.searchsorted(log.pair_query, np.arange(queries + 1))
    total = np.zeros(len(lists.ids), dtype=np.int64)
    seen = np.zeros(len(lists.ids), dtype=bool)
    for q in np.flatnonzero((tight >= np.maximum(least, 1)) & (alone > 0)).tolist():
        here = slice(starts[q], starts[q + 1])
        terms, repeats = log.term[here], log.repeats[here]
        # Terms stand in pairs: (0, 1), (2, 3), ... What the last ones can add together bounds the rest of a document's score.
        most = repeats * lists.best[terms]
        gain = np.zeros(len(terms), dtype=np.int64)
        gain[1:2 * (pair_starts[q + 1] - pair_starts[q]):2] = off[pair_starts[q]:pair_starts[q + 1]]
        pairwise = [int(most[i:i + 2].sum() - gain[i:i + 2].sum()) for i in range(0, len(terms), 2)]
        rest = [0]
        for value in reversed(pairwise):
            rest.append(rest[-1] + value)
        rest = rest[::-1]  # of each pair and all behind it
        floor = max(int(least[q]), 1)
        chosen = None  # documents that may still get there; None while every document of a list may
        reached: list[np.ndarray] = []
        read = 0
        for p in range(len(pairwise)):
            if chosen is None and rest[p] < floor:  # documents in these lists alone cannot reach the threshold
                chosen = np.unique(np.concatenate(reached)) if reached else np.zeros(0, np.int64)
            if chosen is not None:
                chosen = chosen[total[chosen] + rest[p] >= floor]
                if not len(chosen):
                    break
            for i in range(2 * p, min(2 * p + 2, len(terms))):
                a, b = lists.starts[terms[i]], lists.starts[terms[i] + 1]
                docs, impacts = lists.docs[a:b], lists.impacts[a:b]
                if chosen is None:
                    total[docs] += repeats[i] * impacts
                    new = docs[~seen[docs]]
                    seen[new] = True
                    reached.append(new)
                    read += len(docs)
                elif len(docs):
                    at = np.minimum(np.searchsorted(docs, chosen), len(docs) - 1)
                    met = docs[at] == chosen
                    total[chosen[met]] += repeats[i] * impacts[at[met]]
                    read += int(met.sum())
            if len(reached) and (p + 1 == len(pairwise) or rest[p + 1]):
                pool = chosen if chosen is not None else np.concatenate(reached)
                if len(pool) > k:  # each total is a lower bound of a score, so the k-th of them is one of the threshold
                    floor = max(floor, int(np.partition(total[pool], len(pool) - k)[len(pool) - k]))
        touched_docs = np.concatenate(reached) if reached else np.zeros(0, np.int64)
        final = touched_docs if chosen is None else chosen
        scores = total[final]
        kept = scores >= floor
        final, scores = final[kept], scores[kept]
        order = np.lexsort((lists.ids[final], -scores))[:k]
        if touched is not None:
            touched.append((q, read))
        if len(order):
            yield q, lists.ids[final[order]], scores[order]
        total[touched_docs] = 0
        seen[touched_docs] = False


def _impacts(counts: np.ndarray, lengths: np.ndarray, weight: int, log: Log) -> np.ndarray:
    m = FREE + (SLOPE * lengths * log.docs) // log.terms
    return weight * ((GAIN * counts) // (1000 * counts + SATURATION * m))


def _decoded(rows: pa.Table, log: Log) -> Lists:
    """The lists of one block, from its postings rows with the numbers of their terms (null: the block's own row)."""
    lists = [(np.zeros(0, np.int32), np.zeros(0, np.int64))] * len(log.weights)
    found = list(zip(*(rows[c].to_pylist() for c in ("number", "docs", "counts"))))
    ids = lengths = np.zeros(0, np.int64)
    for number, docs, counts in found:
        if number is None:
            ids, lengths = np.frombuffer(docs, "<i8"), np.frombuffer(counts, "<i8")
    for number, docs, counts in found:
        if number is not None:
            at = np.frombuffer(docs, "<i4")
            lists[number] = (at, _impacts(np.frombuffer(counts, "<i4").astype(np.int64), lengths[at], int(log.weights[number]), log))
    return pair_lists(lists, ids, log)


_LISTS = pa.schema([("block", pa.int64()), *((name, pa.binary()) for name in Lists._fields)])
_TYPES = {"docs": "<i4", "pair_docs": "<i4"}


def lists_table(postings: DataFrame, numbered: DataFrame, log: Log) -> DataFrame:
    """One row a block: its lists for the log, as a table in the shared folder (``numbered``: term, number)."""
    shared = postings.sparkSession.sparkContext.broadcast(log)
    # Blocks are numbered by the task that wrote them; a block's rows for the log meet in one task, bounded by the block.
    own = postings.where("term is null").select("block", F.lit(None).cast("int").alias("number"), "docs", "counts")
    rows = postings.join(F.broadcast(numbered), "term").select("block", "number", "docs", "counts").unionByName(own)

    def build(table: pa.Table) -> pa.Table:
        lists = _decoded(table, shared.value)
        packed = [np.asarray(v).astype(_TYPES.get(n, "<i8")).tobytes() for n, v in zip(Lists._fields, lists)]
        return pa.Table.from_arrays([pa.array([table["block"][0].as_py()]), *(pa.array([v], pa.binary()) for v in packed)], schema=_LISTS)

    schema = ", ".join(f"{f.name} {'long' if f.name == 'block' else 'binary'}" for f in _LISTS)
    return written(rows.groupBy("block").applyInArrow(build, schema), "pair-lists")


def _searched(lists: DataFrame, log: Log, least: np.ndarray, k: int) -> DataFrame:
    """Each block's best k documents of each query, from the thresholds on."""
    shared = lists.sparkSession.sparkContext.broadcast((log, least))
    schema = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, least = shared.value
        for batch in slices(batches, 1):
            found = Lists(*(np.frombuffer(batch.column(batch.schema.get_field_index(n))[0].as_py(), _TYPES.get(n, "<i8")) for n in Lists._fields))
            for q, docs, scores in answers(found, log, least, k):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), q), pa.int32()), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())], schema=schema)

    return lists.mapInArrow(search, "query int, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _round(postings: DataFrame, items: list[int], texts: list[str | None], k: int) -> DataFrame:
    """Ranked results of a bounded number of queries."""
    spark = postings.sparkSession
    numbers: dict[bytes, int] = {}
    lists = []
    for text in texts:
        counted: dict[int, int] = {}
        for term in terms_of(text):
            number = numbers.setdefault(term, len(numbers))
            counted[number] = counted.get(number, 0) + 1
        lists.append(counted)
    numbered = spark.createDataFrame(list(zip(map(bytearray, numbers), numbers.values())), "term binary, number int")
    counted = postings.join(F.broadcast(numbered), "term").groupBy("number").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(numbers), dtype=np.int64)
    df[counted["number"].to_numpy()] = counted["df"].to_numpy()
    docs, terms = postings.where("term is null").agg(F.sum("df"), F.sum("total")).first()
    log = _log(items, lists, df, docs or 0, terms or 0)
    blocks = lists_table(postings, numbered, log)
    seed = F.pmod(F.xxhash64("block"), F.lit(SEED_EVERY)) == 0
    nothing = np.zeros(len(items), dtype=np.int64)
    first = written(_best(_searched(blocks.where(seed), log, nothing, k), k), "first-answers")
    kth = first.where(F.col("rank") == k).select("query", "score").toArrow()  # one row a query
    least = nothing.copy()
    least[kth["query"].to_numpy()] = kth["score"].to_numpy()
    rest = _searched(blocks.where(~seed), log, least, k)
    named = spark.createDataFrame(list(enumerate(items)), "query int, item_id long")
    best = _best(first.select("query", "doc_id", "score").unionByName(rest), k)
    return best.join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score")


def search(postings: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text",
           at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """The k best documents of an ``index`` for each query: item_id, rank (from 1), doc_id, score (above 0).

    Equal scores stand in the order of doc_id. A query without a term that occurs has no rows; queries with equal
    ids are searched apart, each with its own ranks; a null id is left out. Queries are answered in rounds of ``at_once``,
    whose texts, numbered terms and thresholds are what the driver holds and tasks get.
    """
    own = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    spark = queries.sparkSession
    found: DataFrame | None = None
    for items, texts in _rounds(own, at_once):
        part = _round(postings, items, texts, k)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _rounds(queries: DataFrame, at_once: int) -> Iterable[tuple[list[int], list[str | None]]]:
    items, texts = [], []
    for row in queries.sort("item_id", "text").toLocalIterator():
        items.append(row["item_id"])
        texts.append(row["text"])
        if len(items) == at_once:
            yield items, texts
            items, texts = [], []
    if items:
        yield items, texts
