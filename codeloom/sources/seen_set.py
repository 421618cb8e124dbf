"""Keys seen in earlier scans: a stored hash set that grows by one generation a scan.

Each generation has Bloom filters, one for each block of keys and as many blocks as its number of keys asks for. They
keep keys that were never seen out of the join with the stored keys, which settles all others exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.session import cut_lineage
from codeloom.sources.generations import Generations

#: Bits of one filter (that of Spark's bitmap functions), bits for each key, hashes of a key.
BITS, BITS_A_KEY, HASHES = 32768, 10, 4
PARTS = 32


def _places(key: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BITS)).cast("int") for i in range(1, HASHES + 1)])


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1


class SeenSet:
    """The set in one folder; ``open`` begins an empty one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._generations = Generations(spark, folder)

    def open(self) -> SeenSet:
        self._generations.begin()
        return self

    def _filters(self) -> DataFrame:
        return self._generations.read("filters", "blocks long, block long, bits binary")

    def _keys(self) -> DataFrame:
        return self._generations.read("keys", "key string, part int")

    def possibly_seen(self, keys: DataFrame) -> DataFrame:
        """Distinct keys (column ``key``) that the filters do not rule out."""
        keys = keys.select("key").where("key IS NOT NULL").distinct()
        sizes = self._filters().select("generation", "blocks").distinct() if self._generations.committed() else None  # one row a scan
        if sizes is None or sizes.isEmpty():
            return keys.limit(0)
        scans = [(r["generation"], r["blocks"]) for r in sizes.collect()]
        each = F.array(*[F.struct(F.lit(g).cast("long").alias("generation"), F.pmod(F.xxhash64("key"), F.lit(b)).cast("long").alias("block")) for g, b in scans])
        asked = keys.select("key", F.inline(each))
        met = asked.join(self._filters().select("generation", "block", "bits"), ["generation", "block"])
        return met.where(F.forall(_places(F.col("key")), lambda p: _is_set(F.col("bits"), p))).select("key").distinct()

    def seen(self, keys: DataFrame) -> DataFrame:
        """Distinct keys that an earlier scan held."""
        # Cut here: the optimizer would join with the stored keys first, and filter what is left.
        found = cut_lineage(self.possibly_seen(keys)).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))
        if not self._generations.committed():
            return found.select("key")
        return found.join(self._keys().select("key", "part"), ["key", "part"], "left_semi").select("key")

    def flagged(self, rows: DataFrame, key: str = "hash") -> DataFrame:
        """``rows`` with ``seen``; a null key is never seen."""
        found = self.seen(rows.select(F.col(key).alias("key"))).select(F.col("key").alias("_seen_key"), F.lit(True).alias("_seen"))
        return rows.join(found, F.col(key) == F.col("_seen_key"), "left").withColumn("seen", F.coalesce("_seen", F.lit(False))).drop("_seen_key", "_seen")

    def add(self, keys: DataFrame) -> None:
        """One scan's keys (column ``key``), those not seen before."""
        number = self._generations.next()
        own = keys.select("key").where("key IS NOT NULL").distinct()
        new = cut_lineage(own.join(self.seen(own), "key", "left_anti"))
        blocks = max(-(-new.count() * BITS_A_KEY // BITS), 1)
        parted = new.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))
        self._generations.write(parted.repartition("part"), "keys", number, "part")
        bits = new.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.explode(_places(F.col("key"))).alias("place"))
        filters = bits.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
        self._generations.write(filters.select(F.lit(blocks).cast("long").alias("blocks"), F.col("block").cast("long").alias("block"), "bits"), "filters", number)
        self._generations.commit(number)
