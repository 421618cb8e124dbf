"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by fast Hadamard pseudo-rotations (signs, transform, three times over) and falls to the nearest
signed axis. Several such tables are kept; a query also probes the axes that come next. Candidates of a bucket are
reranked exactly, block by block, and only the best of each query leave a task.

A table is one hash, whatever the number of rows: joined hashes would make smaller buckets, but meet a neighbour that is
hardly nearer than a random row far less often. Buckets grow with the rows, and are dealt into more blocks.

Largest inner product is searched on vectors of any length: where lengths differ, one more component makes all rows
equally long without changing any product with a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.llm.shared import written

TABLES = 8
#: Rows of a bucket that are compared with queries at a time; a larger bucket is dealt into several blocks.
BLOCK = 1024
QUERIES_AT_ONCE = 512
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row, whose length is a power of two, scaled to keep lengths."""
    rows, n = x.shape
    half = 1
    while half < n:
        pairs = x.reshape(rows, n // (2 * half), 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(rows, n)
        half *= 2
    return x / np.sqrt(n)


class Hashes:
    """``tables`` hashes, each of ``joined`` rotations, of vectors with ``dims`` components and length ``longest`` at most."""

    def __init__(self, dims: int, longest: float, even: bool, joined: int, tables: int = TABLES, probes: int | None = None):
        self.dims, self.longest, self.even, self.joined, self.tables = dims, longest, even, joined, tables
        self.wide = 1 << int(np.ceil(np.log2(max(2, dims + (0 if even else 1)))))
        # Uneven lengths turn near vectors further apart, so twice as many axes are probed.
        axes = self.wide // 4 if even else self.wide // 2
        self.probes = min(probes or max(4, axes if joined == 1 else 4 * axes), self.wide ** joined)
        self.signs = np.random.default_rng(SEED).choice(np.array([-1.0, 1.0]), (tables, joined, 3, self.wide))

    def _turned(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        for signs in self.signs[table, part]:
            x = hadamard(x * signs)
        return x

    def _widened(self, x: np.ndarray, query: bool) -> np.ndarray:
        lengths = np.linalg.norm(x, axis=1)
        found = np.zeros((len(x), self.wide))
        if query or self.even:
            found[:, :self.dims] = x / lengths[:, None]
        else:
            found[:, :self.dims] = x / self.longest
            found[:, self.dims] = np.sqrt(np.maximum(0.0, 1.0 - (lengths / self.longest) ** 2))
        return found

    def _axes(self, turned: np.ndarray, axis: np.ndarray) -> np.ndarray:
        return 2 * axis + (np.take_along_axis(turned, axis, 1) > 0)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table."""
        x = self._widened(x, False)
        found = np.zeros((len(x), self.tables), dtype=np.int64)
        for t in range(self.tables):
            found[:, t] = t
            for part in range(self.joined):
                turned = self._turned(x, t, part)
                found[:, t] = found[:, t] * (2 * self.wide) + self._axes(turned, np.abs(turned).argmax(axis=1)[:, None])[:, 0]
        return found

    def probed(self, x: np.ndarray) -> np.ndarray:
        """The ``probes`` buckets of each table that each query looks into, the likeliest first."""
        x = self._widened(x, True)
        found = np.zeros((len(x), self.tables, self.probes), dtype=np.int64)
        for t in range(self.tables):
            chosen, miss = np.full((len(x), 1), t, dtype=np.int64), np.zeros((len(x), 1))
            for part in range(self.joined):
                turned = self._turned(x, t, part)
                order = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :min(self.probes, self.wide)]
                high = np.take_along_axis(np.abs(turned), order, 1)
                every = chosen[:, :, None] * (2 * self.wide) + self._axes(turned, order)[:, None, :]
                missed = miss[:, :, None] + ((high[:, :1] - high) ** 2)[:, None, :]
                every, missed = every.reshape(len(x), -1), missed.reshape(len(x), -1)
                best = np.argsort(missed, axis=1, kind="stable")[:, :self.probes]
                chosen, miss = np.take_along_axis(every, best, 1), np.take_along_axis(missed, best, 1)
            found[:, t] = chosen
        return found.reshape(len(x), -1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles from a column of byte strings."""
    size = len(column[0].as_buffer()) // 8
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64)
    return flat.reshape(len(column), size)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: it is not null, not zero, and all its components are finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def vector_classes(rows: DataFrame, id_col: str, vector_col: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """Equal vectors as one: (class, ids, least, v) with the ``keep`` smallest ids, and (id, v) of all rows that take part.

    Rows with equal vectors have equal products with any query, and ties go to smaller ids, so larger ones cannot be
    among the best. Rows that repeat id and vector count once.
    """
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + 0.0).alias("v"))
    vectors = vectors.where(F.col("id").isNotNull() & usable(F.col("v")))
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    few = vectors.withColumn("place", place).where(F.col("place") <= keep)
    ids = F.sort_array(F.collect_set("id")).alias("ids")
    return few.groupBy("v").agg(ids).select(F.monotonically_increasing_id().alias("class"), "ids", F.col("ids")[0].alias("least"), "v"), vectors


def _hashed(classes: DataFrame, tables: int, probes: int | None, query: bool) -> DataFrame:
    """(class, least, v as bytes, buckets). Vectors with different numbers of components have no bucket in common."""
    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Hashes] = {}
        for batch in batches:
            every = batch.column(3).to_numpy()
            for dims in np.unique(every).tolist():
                some = batch.filter(pa.array(every == dims))
                if dims not in known:
                    longest, shortest = some.column(4)[0].as_py(), some.column(5)[0].as_py()
                    known[dims] = Hashes(dims, longest, longest - shortest <= 1e-6 * longest, 1, tables, probes)
                x = some.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                buckets = known[dims].probed if query else known[dims].buckets
                found = np.concatenate([buckets(x[i:i + 1024]) for i in range(0, len(x), 1024)]) + (dims << 32)
                offsets = pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([r.tobytes() for r in x], pa.binary()),
                     pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], names=["class", "least", "v", "buckets"])

    return (classes.select("class", "least", "v", "dims", "longest", "shortest")
            .mapInArrow(turned, "class long, least long, v binary, buckets array<long>"))


def _best(found: list[np.ndarray], keep: int) -> np.ndarray:
    """Of (query, class, least, score) rows, each query's best ``keep``, each class once."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows["least"], -rows["score"], rows["query"]))]
    same = np.zeros(len(rows), dtype=bool)
    same[1:] = (rows["query"][1:] == rows["query"][:-1]) & (rows["class"][1:] == rows["class"][:-1])
    rows = rows[~same]  # a class comes with the same score and least id each time, so its rows stand side by side
    starts = np.flatnonzero(np.concatenate(([True], rows["query"][1:] != rows["query"][:-1]))) if len(rows) else np.empty(0, dtype=np.int64)
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    return rows[place < keep]


_FOUND = np.dtype([("query", np.int64), ("class", np.int64), ("least", np.int64), ("score", np.float64)])


def _reranked(keep: int):
    """Rows come sorted by bucket and block, the block's own rows before the queries."""
    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, leasts, vectors = None, [], [], []
        whole: np.ndarray | None = None
        found, held = [], 0

        def given() -> Iterator[pa.RecordBatch]:
            if found:
                rows = _best(found, keep)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in _FOUND.names], names=list(_FOUND.names))

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, part, query = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            changes = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(part) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows]):
                if (bucket[a], part[a]) != block:
                    block, ids, leasts, vectors, whole = (bucket[a], part[a]), [], [], [], None
                some = batch.slice(a, b - a)
                if not query[a]:
                    ids.append(some.column(3).to_numpy())
                    leasts.append(some.column(4).to_numpy())
                    vectors.append(_matrix(some.column(5)))
                    continue
                if not vectors:
                    continue
                if whole is None:
                    ids, leasts, whole = [np.concatenate(ids)], [np.concatenate(leasts)], np.concatenate(vectors)
                asking, names = _matrix(some.column(5)), some.column(3).to_numpy()
                for start in range(0, len(asking), QUERIES_AT_ONCE):
                    q = asking[start:start + QUERIES_AT_ONCE]
                    rough = q @ whole.T
                    floor = np.partition(rough, -min(keep, len(whole)), axis=1)[:, -min(keep, len(whole))]
                    slack = 1e-9 * (np.abs(rough).max(axis=1) + 1e-300)
                    i, j = np.nonzero(rough >= (floor - slack)[:, None])
                    rows = np.empty(len(i), dtype=_FOUND)
                    rows["query"], rows["class"], rows["least"] = names[start + i], ids[0][j], leasts[0][j]
                    rows["score"] = (q[i] * whole[j]).sum(axis=1)  # the same order of terms for every pair
                    found.append(rows)
                    held += len(rows)
                if held > 1 << 19:
                    found = [_best(found, keep)]
                    held = len(found[0])
                    if held > 1 << 18:
                        yield from given()
                        found, held = [], 0
        yield from given()
    return rerank


def _matched(index: DataFrame, probes: DataFrame, keep: int, block: int) -> DataFrame:
    """(query, class, least, score): of each probed block the best ``keep``. Both sides: (bucket, class, least, v)."""
    sizes = index.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = index.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part"),
                                               F.lit(False).alias("query"), "class", "least", "v")
    asked = probes.join(sizes, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                                F.lit(True).alias("query"), "class", "least", "v")
    together = dealt.unionByName(asked).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "query")
    return together.mapInArrow(_reranked(keep), "query long, class long, least long, score double")


def nearest(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            tables: int = TABLES, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of each row for which ``queries`` holds.

    Nearest means largest inner product in double precision; ties go to the smaller id; a row is no candidate of
    itself. Vectors that are null, zero or not finite take no part. Only vectors with equally many components have a
    product, so each number of components is searched apart. A query for which the tables give fewer than ``k`` rows
    although there are more is compared with all rows, in blocks.
    """
    grouped, vectors = vector_classes(rows, id_col, vector_col, k + 1)
    stored = written(grouped, "vector-classes")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    lengths = written(stored.groupBy(F.size("v").alias("dims")).agg(F.max(length).alias("longest"), F.min(length).alias("shortest"),
                                                                    F.sum(F.size("ids")).alias("held")), "vector-lengths")
    # One row for each number of components.
    classes = stored.withColumn("dims", F.size("v")).join(F.broadcast(lengths), "dims")
    asking = written(vectors.where(queries).select(F.col("id").alias("query_id"), "v").distinct().join(stored.select("v", "class"), "v").select("query_id", "class"), "queries")
    if lengths.isEmpty():
        return asking.select("query_id", F.lit(0).alias("rank"), F.col("class").alias("vec_id"), F.lit(0.0).alias("score"))
    asked = classes.join(asking.select("class").distinct(), "class", "left_semi")
    index = _hashed(classes, tables, probes, False).withColumn("bucket", F.explode("buckets")).drop("buckets")
    probed = _hashed(asked, tables, probes, True).withColumn("bucket", F.explode("buckets")).drop("buckets")
    found = _ranked(_matched(index, probed, k + 1, block), stored, k + 1)
    found = written(found, "nearest")
    given = found.select("class", F.size("best").alias("given"))
    wanting = asked.join(given, "class", "left").where(F.coalesce("given", F.lit(0)) < F.least(F.lit(k + 1), F.col("held")))
    if not wanting.isEmpty():
        alike = F.shiftright(F.col("buckets")[0], 32).alias("bucket")  # the number of components
        plain = [_hashed(x, tables, probes, False).select(alike, "class", "least", "v") for x in (classes, wanting)]
        again = _ranked(_matched(plain[0], plain[1], k + 1, block), stored, k + 1)
        found = found.join(again.select("class"), "class", "left_anti").unionByName(again)
    best = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    return (asking.join(found, "class").select("query_id", F.posexplode(best).alias("rank", "found"))
            .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("found.id").alias("vec_id"), F.col("found.score").alias("score")))


def _ranked(matched: DataFrame, classes: DataFrame, keep: int) -> DataFrame:
    """(class, best): of each query class the best ``keep`` rows, as (score, id)."""
    once = matched.groupBy("query", "class", "least").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least"))
    few = once.withColumn("place", place).where(F.col("place") <= keep)
    each = few.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("id"))
    # At most keep * keep rows of a query meet here.
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), "id")))
    best = F.transform(F.slice(best, 1, keep), lambda b: F.struct(b["id"].alias("id"), (-b["below"]).alias("score")))
    return each.groupBy("query").agg(best.alias("best")).select(F.col("query").alias("class"), "best")
