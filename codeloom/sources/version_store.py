"""Version history kept as a stored table: a batch of saves rewrites the buckets of its files and no others.

Contents lie beside the versions, every text once, and are never rewritten; versions name them by ``content_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.functions.text import content_key
from codeloom.operators.versions import KEY, MAX_VERSIONS, retained
from codeloom.session import cut_lineage
from codeloom.sources.generations import Generations

_HELD = "bucket int, held_by long, versions long"
_CONTENTS = "content_key binary, content string"


def _parted(versions: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Versions with content keys in place of contents, and the texts; versions without contents have none."""
    if "content" not in versions.columns:
        return versions, None
    keyed = versions.withColumn("content_key", content_key("content"))
    return keyed.drop("content"), keyed.select("content_key", "content").where("content_key IS NOT NULL").dropDuplicates(["content_key"])


class VersionStore:
    """All versions of a file lie in one bucket; retention is applied to a bucket whenever it is written."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._generations = Generations(spark, folder)
        schema, buckets, keep = self._generations.note().split("\n")
        self.schema, self.buckets, self.keep = schema, int(buckets), int(keep)

    @classmethod
    def create(cls, versions: DataFrame, folder: str, buckets: int = 64, keep: int = MAX_VERSIONS, contents: DataFrame | None = None) -> VersionStore:
        """A new store; ``versions`` has ``version_id, ts, is_favorite``, the key columns, and any others.

        Contents come with the versions, as the column ``content``, or beside them: versions then have a ``content_key``
        and ``contents`` (content_key, content) each text once. Of these, texts that no version needs are not stored.
        """
        if contents is None:
            versions, contents = _parted(versions)
        Generations(versions.sparkSession, folder).begin(f"{versions.schema.toDDL()}\n{buckets}\n{keep}")
        store = cls(versions.sparkSession, folder)
        store._write(versions.withColumn("bucket", store._bucket()), None, contents)
        return store

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def held(self) -> DataFrame:
        """One row a bucket that is not empty: the generation that holds it and its number of versions."""
        newest = max(self._generations.committed())
        return self._generations.read("held", _HELD).where(F.col("generation") == newest).drop("generation")

    def _versions(self, held: DataFrame | None = None) -> DataFrame:
        """Kept versions as they are stored, of all buckets or of some."""
        held = (self.held() if held is None else held).select("bucket", F.col("held_by").alias("generation"))
        return self._generations.read("versions", f"{self.schema}, bucket int").join(held, ["generation", "bucket"], "left_semi").drop("generation")

    def versions(self, keys: DataFrame | None = None) -> DataFrame:
        """Kept versions, with ``bucket`` and contents; given ``keys``, those of their files, from their buckets alone."""
        if keys is None:
            rows = self._versions()
        else:
            keys = keys.select(*KEY).distinct().withColumn("bucket", self._bucket())
            rows = self._versions(self.held().join(keys.select("bucket").distinct(), "bucket", "left_semi")).join(keys, [*KEY, "bucket"], "left_semi")
        return rows.join(self._contents(), "content_key", "left").drop("content_key") if self._has_contents() else rows

    def _has_contents(self) -> bool:
        return "content_key" in [f.name for f in self._fields()]

    def _contents(self) -> DataFrame:
        return self._generations.read("contents", _CONTENTS).drop("generation")

    def save(self, saves: DataFrame, contents: DataFrame | None = None) -> None:
        """Add a batch, with contents as for ``create``. A version that is saved again replaces itself, so a batch may be repeated.

        Files keep their newest ``keep`` versions and all favourites; what was dropped before has enough newer ones
        and cannot come back, so batches in any number give what one pass over all saves gives.
        """
        if contents is None and "content" in saves.columns:
            saves, contents = _parted(cut_lineage(saves))
        new = cut_lineage(saves.select(*[f.name for f in self._fields()]).withColumn("bucket", self._bucket()))
        touched = cut_lineage(new.select("bucket").distinct())
        kept = self._versions().join(touched, "bucket", "left_semi").join(new.select("version_id"), "version_id", "left_anti")
        self._write(kept.unionByName(new), touched, contents)

    def _fields(self):
        return self.spark.createDataFrame([], self.schema).schema.fields

    def _write(self, rows: DataFrame, touched: DataFrame | None, contents: DataFrame | None) -> None:
        number = self._generations.next()
        dealt = retained(rows, self.keep).repartition("bucket", F.pmod(F.xxhash64("version_id"), F.lit(4))).sortWithinPartitions("bucket", *KEY, "ts")
        self._generations.write(dealt, "versions", number, "bucket")
        written = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.folder}/versions/generation={number}")
        fresh = written.groupBy("bucket").agg(F.lit(number).cast("long").alias("held_by"), F.count("*").alias("versions"))
        if touched is not None:
            fresh = fresh.unionByName(self.held().join(touched, "bucket", "left_anti"))
        self._generations.write(fresh, "held", number)
        if contents is not None:
            needed = contents.join(written.select("content_key").distinct(), "content_key", "left_semi")
            if number:
                needed = needed.join(self._contents().select("content_key"), "content_key", "left_anti")
            self._generations.write(needed.select("content_key", "content"), "contents", number)
        self._generations.commit(number)
