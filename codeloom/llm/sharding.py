"""Shards of nearly equal bytes, by sampled splitters.

Records are ordered by a key. A sample in which a record's chance grows with its size gives splitters, the splitters
give ranges, and a range that turns out too full is sampled and split again. Ranges are then measured exactly, so
each record's place in the whole order is known, and shards are cut from that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from codeloom.llm.shared import written

#: Ranges for each shard, and records for each range; the larger number of ranges is taken, up to MOST_RANGES.
RANGES_PER_SHARD = 32
ROWS_PER_RANGE = 1_000_000
MOST_RANGES = 1 << 16
#: Sampled keys for each range.
SAMPLES = 8
#: A range of more than this many times its share is split again.
OVERFULL = 2.0
#: Equal keys of no more than this part of a shard stay together.
TOGETHER = 0.02


def _sampled(keyed: DataFrame, number: int, rows: int, size: int) -> np.ndarray:
    """``number`` keys at most, drawn without return, with chances in proportion to size: (hash, id) rows, sorted.

    The draw hangs on key and id alone, so it is the same in every run. ``rows`` and ``size`` are those of the table: the
    waits are exponential, so all but about twice ``number`` are left out by a threshold before the rest is sorted.
    """
    uniform = (F.pmod(F.xxhash64("hash", "rid", F.lit("draw")), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    drawn = keyed.select("hash", "rid", (-F.log(uniform) / F.greatest(F.col("size"), F.lit(1))).alias("wait"))
    if rows > 4 * number:
        longest = 2.0 * number / max(size, rows)
        while drawn.where(F.col("wait") <= longest).count() < number:  # where few large records hold most of the size
            longest *= 4
        drawn = drawn.where(F.col("wait") <= longest)
    found = drawn.orderBy("wait", "hash", "rid").limit(number).select("hash", "rid").toArrow()
    return np.array(sorted(zip(found["hash"].to_pylist(), found["rid"].to_pylist())), dtype=np.int64).reshape(-1, 2)


def _before(hashes: np.ndarray) -> np.ndarray:
    """Splitters that stand before all rows of these hashes."""
    return np.stack((hashes, np.full(len(hashes), np.iinfo(np.int64).min)), axis=1)


def _range_of(hashes: np.ndarray, ids: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """How many splitters are not above each (hash, id)."""
    found = np.searchsorted(splitters[:, 0], hashes, "right")
    low = np.searchsorted(splitters[:, 0], hashes, "left")
    tied = np.flatnonzero(low < found)
    if len(tied):
        # Splitters with the same hash: their ids decide. Few hashes are so full that they hold splitters.
        for first in np.unique(low[tied]):
            rows = tied[low[tied] == first]
            found[rows] = first + np.searchsorted(splitters[first:found[rows[0]], 1], ids[rows], "right")
    return found


def _with_range(keyed: DataFrame, splitters: np.ndarray) -> DataFrame:
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("hash", "rid"))
            yield batch.append_column("range", pa.array(_range_of(hashes, ids, splitters), pa.int64()))

    return keyed.mapInArrow(placed, T.StructType([*keyed.schema.fields, T.StructField("range", T.LongType())]))


def _measured(keyed: DataFrame, splitters: np.ndarray) -> np.ndarray:
    """(range, bytes, rows), a row for each range that is not empty; there are no more ranges than splitters and one."""
    found = _with_range(keyed.select("hash", "rid", "size"), splitters).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    table = found.toArrow()
    sizes = np.stack([table[c].to_numpy() for c in ("range", "bytes", "rows")], axis=1).astype(np.int64)
    return sizes[sizes[:, 0].argsort()]


def splitters_of(keyed: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Splitters of ranges none of which is overfull (unless it is a single record), and the ranges' exact sizes."""
    total = keyed.agg(F.count("*"), F.sum("size")).first()
    rows, size = total[0], total[1] or 0
    ranges = int(min(MOST_RANGES, max(RANGES_PER_SHARD * shards, rows // ROWS_PER_RANGE)))
    sample = _sampled(keyed, SAMPLES * ranges, rows, size)
    splitters = _before(np.unique(sample[SAMPLES::SAMPLES, 0]))
    share = max(1.0, size / ranges)
    while True:
        sizes = _measured(keyed, splitters)
        full = sizes[(sizes[:, 1] > OVERFULL * share) & (sizes[:, 2] > 1)]
        if not len(full):
            return splitters, sizes
        inside = _with_range(keyed, splitters).join(F.broadcast(keyed.sparkSession.createDataFrame([(int(r),) for r in full[:, 0]], "range long")), "range")
        # As many more splitters as the ranges lack; no more ranges are full than MOST_RANGES.
        lacking = int(np.ceil(full[:, 1] / share).sum())
        more = _sampled(inside.select("hash", "rid", "size"), SAMPLES * lacking, int(full[:, 2].sum()), int(full[:, 1].sum()))
        # A hash that fills two shares or more is split by row number; others are borders between hashes.
        hashes, counts = np.unique(more[:, 0], return_counts=True)
        heavy = np.isin(more[:, 0], hashes[counts >= OVERFULL * SAMPLES])
        grown = np.unique(np.concatenate((splitters, _before(hashes), more[heavy][SAMPLES // 2::SAMPLES])), axis=0)
        if len(grown) == len(splitters):
            return splitters, sizes
        splitters = grown


def shards_of(keyed: DataFrame, shards: int) -> DataFrame:
    """``keyed`` (columns hash, rid, size and others) with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    Shards hold sizes as nearly equal as whole records allow: a record goes where the middle of its bytes falls.
    Records with the same hash go together if they are no more than TOGETHER of a shard. An empty table gives no
    rows; shards stay empty where records are fewer than shards.
    """
    splitters, sizes = splitters_of(keyed, shards)
    spark = keyed.sparkSession
    before = np.cumsum(sizes[:, 1:], axis=0) - sizes[:, 1:]
    total = int(sizes[:, 1].sum())
    firsts = spark.createDataFrame([(int(r), int(b), int(n)) for r, (b, n) in zip(sizes[:, 0], before)], "range long, bytes_before long, rows_before long")
    within = Window.partitionBy("range").orderBy("hash", "rid")
    group = Window.partitionBy("range", "hash")
    placed = (_with_range(keyed, splitters)
              .withColumn("end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("place", F.row_number().over(within).cast("long") - 1)
              .withColumn("group_size", F.sum("size").over(group)).withColumn("group_end", F.max("end").over(group))
              .join(F.broadcast(firsts), "range"))  # no more rows than ranges
    whole = F.col("group_size") <= int(TOGETHER * total / shards)
    middle = F.when(whole, 2 * F.col("group_end") - F.col("group_size")).otherwise(2 * F.col("end") - F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor((middle + 2 * F.col("bytes_before")) * shards / (2 * max(total, 1)))).cast("int")
    ordered = written(placed.select(*keyed.columns, shard.alias("shard"), (F.col("rows_before") + F.col("place")).alias("order")), "shards")
    starts = ordered.groupBy("shard").agg(F.min("order").alias("start"))
    return ordered.join(F.broadcast(starts), "shard").select(*keyed.columns, "shard", (F.col("order") - F.col("start")).alias("slot"))


def sized(docs: DataFrame, key: Column, size: Column, *keep: Column) -> DataFrame:
    """The narrow table that is sharded: a hash of ``key``, a number that tells rows apart, the size, and what is kept.

    It is written once, so contents are read once and row numbers stay as they are.
    """
    return written(docs.select(F.xxhash64(key).alias("hash"), F.monotonically_increasing_id().alias("rid"), size.cast("long").alias("size"), *keep), "sizes")
