"""Folders that change by whole generations.

The parts of a change are written first, below the number of their generation; they count from the moment that number
stands in the manifest. A change that breaks off leaves files that nobody reads, and its number is used again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_MANIFEST = "generation long, note string"


class Generations:
    """The manifest of one folder. It has one row a change since the folder was last written anew."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _manifest(self) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest")

    def begin(self, note: str = "") -> None:
        """An empty folder's manifest, or one that forgets every generation, with ``note`` in its first row."""
        self._row(-1, note).write.mode("overwrite").parquet(f"{self.folder}/manifest")

    def _row(self, generation: int, note: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(generation).cast("long").alias("generation"), F.lit(note).alias("note"))

    def note(self) -> str:
        return self._manifest().where("generation = -1").first()["note"]

    def committed(self) -> list[int]:
        return sorted(r["generation"] for r in self._manifest().where("generation >= 0").select("generation").distinct().collect())

    def next(self) -> int:
        return max(self.committed(), default=-1) + 1

    def commit(self, generation: int, note: str = "") -> None:
        self._row(generation, note).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def write(self, df: DataFrame, table: str, generation: int, *partitions: str, **options: str | int) -> None:
        """One table's part of a generation, replacing what an earlier attempt left."""
        df.write.mode("overwrite").options(**options).partitionBy(*partitions).parquet(f"{self.folder}/{table}/generation={generation}")

    def read(self, table: str, schema: str) -> DataFrame:
        """The committed parts of a table, with the column ``generation``."""
        rows = self.spark.read.schema(f"{schema}, generation long").option("basePath", f"{self.folder}/{table}").parquet(f"{self.folder}/{table}")
        return rows.where(F.col("generation").isin(self.committed()))
