"""A stored index for substring search: postings of one to three characters, written once and updated by row.

Rows are written first and numbered; a posting is the distance of its row's number from the first of its group.
A query reads the postings of its own grams, intersects them, fetches the rows that may match by their slot, and
scores these alone. Updates are generations of their own: a row counts in the newest generation that names it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.operators import search as S
from codeloom.sources.generations import Generations

LONGEST = 3
#: Rows whose postings a worker holds before it writes them out, code points of them, and the most that row numbers may be apart.
ROWS_AT_ONCE, TEXT_AT_ONCE, PLACES = 1024, 2_000_000, 2 ** 15
_POSTINGS = "gram string, first long, places array<short>"


def grams(needle: str) -> list[str]:
    """What a text that contains ``needle`` has to hold: its substrings of three characters, or a shorter needle itself."""
    return sorted({needle[i:i + LONGEST] for i in range(max(len(needle) - LONGEST + 1, 1))}) if needle else []


def _held(text: str) -> np.ndarray:
    """The grams of a text, each once, as numbers: 21 bits a character, counted from 1."""
    one = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    found = [one]
    for n in range(1, LONGEST):
        found.append(found[-1][:-1] + (one[n:] << 21 * n))
    return np.unique(np.concatenate(found))


def _gram(number: int) -> str:
    return "".join(chr((number >> 21 * n & 2 ** 21 - 1) - 1) for n in range(LONGEST) if number >> 21 * n)


def _postings(rows: DataFrame, buckets: int) -> DataFrame:
    """``gram, first, places, bucket``: the rows that hold a gram, numbered from ``first``; one a gram and group of rows read together."""
    schema = pa.schema([("gram", pa.string()), ("first", pa.int64()), ("places", pa.list_(pa.int16()))])

    def written(held: list[np.ndarray], places: list[int], first: int) -> Iterator[pa.RecordBatch]:
        numbers = np.concatenate(held or [np.empty(0, np.int64)])
        if not len(numbers):
            return
        order = np.argsort(numbers, kind="stable")
        numbers, at = numbers[order], np.repeat(np.array(places, np.int16), [len(h) for h in held])[order]
        starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)).astype(np.int32)), pa.array(at))
        names = pa.array([_gram(n) for n in numbers[starts].tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(starts), first)), lists], schema=schema)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        places: list[int] = []
        size = first = 0
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and not 0 <= number - first < PLACES or len(held) >= ROWS_AT_ONCE or size >= TEXT_AT_ONCE:
                    yield from written(held, places, first)
                    held, places, size = [], [], 0
                if not held:
                    first = number
                held.append(_held(text or ""))
                places.append(number - first)
                size += len(text or "")
        yield from written(held, places, first)

    return rows.select("row_id", "search_text").mapInArrow(lists, _POSTINGS).withColumn("bucket", _part("gram", buckets))


def _part(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


class SearchIndex:
    """The index in one folder. ``create`` writes it, ``update`` adds a generation, the rest reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self._generations = Generations(spark, folder)
        schema, slots, buckets = self._generations.note().split("\n")
        self.spark, self.folder, self.schema, self.slots, self.buckets = spark, folder, schema, int(slots), int(buckets)

    @classmethod
    def create(cls, table: DataFrame, folder: str, slots: int = 32, buckets: int = 32) -> SearchIndex:
        """Index all rows of a search table. ``slots`` part the rows by key, ``buckets`` the postings by gram."""
        Generations(table.sparkSession, folder).begin(f"{table.schema.toDDL()}\n{slots}\n{buckets}")
        index = cls(table.sparkSession, folder)
        index._add(table, table.select("key").limit(0))
        return index

    def _add(self, rows: DataFrame, removed: DataFrame) -> None:
        g, number = self._generations, self._generations.next()
        slotted = rows.withColumn("slot", _part("key", self.slots)).repartition("slot", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(4)))
        g.write(slotted.sortWithinPartitions("slot", "key").withColumn("row_id", F.monotonically_increasing_id()), "rows", number, "slot")
        written = self.spark.read.schema("row_id long, search_text string").parquet(f"{self.folder}/rows/generation={number}")
        # Postings are dealt by (bucket, hash of the gram) and sorted, so that a file's statistics leave out other grams.
        dealt = _postings(written, self.buckets).repartition("bucket", F.pmod(F.xxhash64("gram", F.lit(1)), F.lit(4))).sortWithinPartitions("bucket", "gram")
        g.write(dealt, "postings", number, "bucket")
        # Only changes of a written index are named; keys of the first generation are its rows.
        named = rows.select("key").unionByName(removed.select("key")).distinct()
        g.write(named if number else named.limit(0), "changes", number)
        g.commit(number)

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """Rows of ``changed`` replace those with their keys or are added; keys of ``removed`` (column key) go."""
        gone = removed.select("key") if removed is not None else changed.select("key").limit(0)
        self._add(changed.select(*self._columns()), gone)

    def _columns(self) -> list[str]:
        return [f"`{name}`" for name in self.spark.createDataFrame([], self.schema).columns]

    def postings(self, wanted: list[str]) -> DataFrame:
        """Lists of the wanted grams; buckets and grams are filters of the scan."""
        numbers = [r[0] for r in self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(_part("gram", self.buckets)).distinct().collect()]
        rows = self._generations.read("postings", f"{_POSTINGS}, bucket int")
        return rows.where(F.col("bucket").isin(numbers) & F.col("gram").isin(wanted))

    def candidates(self, needles: list[str]) -> DataFrame:
        """``key, generation`` of the rows that hold all grams of at least one needle, in their newest generation."""
        sets = [grams(n) for n in dict.fromkeys(needles) if n]
        if not sets:
            return self.spark.createDataFrame([], "key string, generation long")
        found = self.postings(sorted(set().union(*sets))).select("generation", "gram", "first", F.explode("places").alias("place"))
        found = found.groupBy("generation", (F.col("first") + F.col("place")).alias("row_id")).agg(
            *[F.count_if(F.col("gram").isin(own)).alias(f"n{i}") for i, own in enumerate(sets)])
        names = self._generations.read("rows", "key string, row_id long")
        counts = found.join(names, ["generation", "row_id"]).groupBy("key", "generation").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(sets))])
        whole = F.lit(False)
        for i, own in enumerate(sets):
            whole = whole | (F.col(f"n{i}") == len(own))  # a row names a gram once
        met = counts.where(whole).select("key", "generation")
        later = self._generations.read("changes", "key string").groupBy("key").agg(F.max("generation").alias("newest"))
        return met.join(later, "key", "left").where("newest IS NULL OR newest <= generation").drop("newest")

    def rows(self, needles: list[str]) -> DataFrame:
        """Search-table rows that may hold one of the needles; slots without a candidate are not read. All hold an empty one."""
        if "" in needles:
            return self.current()
        found = self.candidates(needles).withColumn("slot", _part("key", self.slots))
        table = self._generations.read("rows", f"{self.schema}, slot int")
        return table.join(found, ["generation", "slot", "key"], "left_semi").drop("generation", "slot")

    def matches(self, query: str, now: Column, **filters) -> DataFrame:
        """All rows with a positive score, as ``search.matches`` gives them from the whole table."""
        return S.matches(self.rows([query.lower().strip(), *S.tokens(query)]), query, now, **filters)

    def search_files(self, query: str, project: str | None = None) -> DataFrame:
        return S.search_files(self.rows([query.lower().strip()]), query, project)

    def current(self) -> DataFrame:
        """All rows in their newest generation."""
        later = self._generations.read("changes", "key string").groupBy("key").agg(F.max("generation").alias("newest"))
        table = self._generations.read("rows", f"{self.schema}, slot int").join(later, "key", "left").where("newest IS NULL OR newest <= generation")
        return table.select(*self._columns())

    def compacted(self, folder: str) -> SearchIndex:
        """The current rows as a new index of one generation."""
        return SearchIndex.create(self.current(), folder, self.slots, self.buckets)
