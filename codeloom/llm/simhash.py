"""Near-duplicates by SimHash: fingerprints, and a binary trie joined with itself.

Sorted fingerprints are a binary trie: the node of a prefix is a range of them. Pairs of nodes are descended
together; a level at which their bits differ costs one, and a pair whose cost exceeds the budget is dropped with
all below it. The trie is cut into subtrees of bounded size, and a task descends one pair of subtrees.

Of two fingerprints at distance d, one half of the bits differs in d // 2 places at most. So the trie is built
twice, with either half first, and the first half's levels have that smaller budget: few pairs of nodes live, and
none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from codeloom.llm.components import components
from codeloom.llm.shared import chunks, rows_once, slices, written

WORDS = 4
DISTANCE = 4
SEED = 42
BITS = 64
#: Fingerprints of a block, and the least number of levels above the subtrees (64 subtrees keep a small cluster busy).
BLOCK = 8192
LEAST_DEPTH = 6
#: Pairs of nodes that are descended at a time, and pairs of fingerprints that a pair of nodes is compared by.
NODES_AT_ONCE = 1 << 18
SMALL = 8
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# ---- fingerprints

def _shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``words`` words, repeats included; of all words, where there are fewer."""
    carried: list[bytes] = []
    digest = xxhash.xxh64_intdigest
    began = False
    for chunk in chunks(text):
        # bytes.split() cuts at exactly these blanks: space and 0x09 to 0x0D.
        found = carried + chunk.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if len(found) >= words:
            began = True
            joined = memoryview(b" ".join(found))
            ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
            starts = [0, *(ends[:len(found) - words] + 1).tolist()]
            yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:].tolist())], dtype=np.uint64)
            carried = found[len(found) - words + 1:]
        else:
            carried = found
    if not began and carried:
        yield np.array([digest(b" ".join(carried), SEED)], dtype=np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a whole text: a bit is 1 if it is set in over half the hashes; 0 for a text without words."""
    ones, total = np.zeros(BITS, dtype=np.int64), 0
    for hashes in _shingle_hashes(text or "", words):
        for start in range(0, len(hashes), 1 << 14):
            part = hashes[start:start + (1 << 14)]
            ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, key, print): ``print`` holds the 64 bits as a signed long, ``key`` is a hash of the text. A null text has no words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], names=["id", "key", "print"])

    return narrow.mapInArrow(hashed, T.StructType([*narrow.schema.fields[:2], T.StructField("print", T.LongType())]))


# ---- the descent of a pair of subtrees

def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links between nodes below ``n``, as many as span the same components."""
    root, kept = np.arange(n), []
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        if not len(a):
            break
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        # Each root that is the higher end of a link is hung below one lower root; no circle can arise.
        hung, at = np.unique(high, return_index=True)
        kept.append((a[at], b[at]))
        root[hung] = low[at]
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    if not kept:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def _compare(pairs: tuple, values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of pairs of small nodes."""
    alo, ahi, blo, bhi = pairs
    wide = bhi - blo
    sizes = (ahi - alo) * wide
    which = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    a, b = alo[which] + within // wide[which], blo[which] + within % wide[which]
    near = (np.bitwise_count(values[a] ^ values[b]) <= distance) & (a < b)
    return a[near], b[near]


def close_links(left: np.ndarray, right: np.ndarray | None, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of ``left`` and ``right`` (of ``left`` alone, if that is None) that span all close ones.

    Both are distinct unsigned 64-bit numbers, and no number is in both. The first half of the bits may differ in
    ``distance // 2`` places, all bits in ``distance``.
    """
    values = np.sort(left) if right is None else np.concatenate((np.sort(left), np.sort(right)))
    n, cut = len(values), len(left)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def keep(found: tuple[np.ndarray, np.ndarray]) -> None:
        nonlocal links, held
        links.append(found)
        held += len(found[0])
        if held > 4 * NODES_AT_ONCE:
            links = [_forest(np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]), n)]
            held = len(links[0][0])

    start = (np.array([0]), np.array([cut]), np.array([0 if right is None else cut]), np.array([n]), np.array([0]))
    waiting = [(0, start)] if cut and n > (cut if right is not None else 1) else []
    zeros: dict[int, np.ndarray] = {}
    while waiting:
        level, (alo, ahi, blo, bhi, cost) = waiting.pop()
        small = (ahi - alo) * (bhi - blo) <= SMALL
        if level == BITS:
            small[:] = True
        if small.any():
            keep(_compare(tuple(x[small] for x in (alo, ahi, blo, bhi)), values, distance))
            alo, ahi, blo, bhi, cost = (x[~small] for x in (alo, ahi, blo, bhi, cost))
        if not len(alo):
            continue
        if level not in zeros:
            bit = (values >> np.uint64(BITS - 1 - level)) & np.uint64(1)
            zeros[level] = np.concatenate(([0], np.cumsum(bit == 0)))
        count = zeros[level]
        amid, bmid = alo + count[ahi] - count[alo], blo + count[bhi] - count[blo]
        budget = distance // 2 if level < BITS // 2 else distance
        dear = cost < budget
        mirrored = dear & (alo != blo)  # of a node with itself, one of the two crossings is enough
        below = [
            (alo, amid, blo, bmid, cost), (amid, ahi, bmid, bhi, cost),
            tuple(x[dear] for x in (alo, amid, bmid, bhi, cost + 1)), tuple(x[mirrored] for x in (amid, ahi, blo, bmid, cost + 1))]
        joined = [np.concatenate(x) for x in zip(*below)]
        full = (joined[0] < joined[1]) & (joined[2] < joined[3]) & ~((joined[0] == joined[2]) & (joined[1] - joined[0] == 1) & (joined[3] - joined[2] == 1))
        joined = [x[full] for x in joined]
        for at in range(0, len(joined[0]), NODES_AT_ONCE):
            waiting.append((level + 1, tuple(x[at:at + NODES_AT_ONCE] for x in joined)))
    if not links:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    a, b = _forest(np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]), n)
    return values[a], values[b]


# ---- the trie over all fingerprints

def _prefix(value: Column, depth: int) -> Column:
    return F.shiftrightunsigned(value, BITS - depth) if depth else F.lit(0).cast("long")


def _halves_swapped(value: Column) -> Column:
    return F.shiftleft(value, 32).bitwiseOR(F.shiftrightunsigned(value, 32))


def links(prints: DataFrame, rows: int, distance: int = DISTANCE, block: int = BLOCK, least_depth: int = LEAST_DEPTH) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``print``) that span all pairs within ``distance``.

    ``rows`` is their number. Depth of the cut: as many levels as make subtrees of ``block`` fingerprints, were they
    even; a larger subtree is dealt into several blocks. Each fingerprint takes part in as many pairs of subtrees as
    there are prefixes within the first half's budget.
    """
    depth = max(least_depth, int(np.ceil(np.log2(max(rows, 1) / block))))
    depth = min(depth, BITS // 2)
    # Differences of prefixes within the budget: a list that grows with the square of the depth at most.
    flips = [sum(1 << i for i in bits) for k in range(distance // 2 + 1) for bits in combinations(range(depth), k)]
    found = []
    for first in (F.col("print"), _halves_swapped(F.col("print"))):
        keyed = prints.select(first.alias("value")).withColumn("prefix", _prefix(F.col("value"), depth))
        sizes = keyed.groupBy("prefix").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("value"), F.col("parts")).cast("int").alias("part")
        blocks = written(keyed.join(sizes, "prefix").select("prefix", "parts", part, "value").groupBy("prefix", "parts", "part")
                         .agg(F.collect_list("value").alias("values")), "trie-blocks")  # about `block` values at most
        nodes = blocks.select("prefix", "part")
        flip = F.explode(F.array(*[F.lit(x).cast("long") for x in flips])).alias("flip")
        beside = (nodes.select("prefix", "part", flip).select("prefix", "part", F.col("prefix").bitwiseXOR(F.col("flip")).alias("other"))
                  .where("prefix <= other")
                  .join(nodes.select(F.col("prefix").alias("other"), F.col("part").alias("other_part")), "other")
                  .where((F.col("prefix") < F.col("other")) | (F.col("part") <= F.col("other_part"))))
        right = blocks.select(F.col("prefix").alias("other"), F.col("part").alias("other_part"), F.col("values").alias("right"))
        pairs = (beside.join(blocks.select("prefix", "part", F.col("values").alias("left")), ["prefix", "part"])
                 .join(right, ["other", "other_part"])
                 .select(F.when((F.col("prefix") == F.col("other")) & (F.col("part") == F.col("other_part")), F.lit(True))
                         .otherwise(F.lit(False)).alias("same"), "left", "right"))
        close = pairs.repartition(F.xxhash64("left"), F.xxhash64("right")).mapInArrow(_descended(distance), "a long, b long")
        if found:
            close = close.select(_halves_swapped(F.col("a")).alias("a"), _halves_swapped(F.col("b")).alias("b"))
        found.append(close)
    return found[0].unionByName(found[1])


def _descended(distance: int):
    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column(0)[i].as_py()
                left, right = (batch.column(c)[i].values.to_numpy().view(np.uint64) for c in (1, 2))
                a, b = close_links(left, None if same else right, distance)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])
    return descend


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, distance: int) -> DataFrame:
    """(id, key, print, component_id) of every row."""
    known = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = written(known.groupBy("print").agg(F.min("id").alias("least")), "distinct-fingerprints")
    found = components(links(distinct.select("print"), distinct.count(), distance))
    rooted = distinct.join(found, distinct["print"] == found["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.join(rooted.join(least, "root").select("print", "root", "component_id"), "print")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable).

    Texts without words, null ones included, have fingerprint 0 and are linked like any other. A null id counts as
    larger than all others; a component of null ids alone has a null component_id. Rows may repeat. Other columns
    are not looked at.
    """
    return _classes(docs, id_col, text_col, words, distance).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """Of each component the row with the smallest id (of several, that with the smallest hash of its text), with all columns."""
    classes = _classes(docs, id_col, text_col, words, distance).groupBy("root", "id", "key").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "copies")).alias("first")
    chosen = classes.groupBy("root").agg(first).select("first.id", "first.key", "first.copies")
    return rows_once(docs, id_col, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), written(chosen, "staying"))
