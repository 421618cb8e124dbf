"""A store of project files with one directory a project, changed by keyed upserts.

An upsert writes the projects it touches anew, below the number of its generation, and a manifest that says which
generation holds each project. It counts once the manifest is switched; directories of other projects stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.session import cut_lineage
from codeloom.sources.generations import Generations

COLUMNS = ["id", "project_id", "path", "language", "content"]
_ROWS = "id string, path string, language string, content string, project_id string"
_MANIFEST = "project_id string, held_by long, files long, size long"


class ProjectStore:
    def __init__(self, spark: SparkSession, folder: str, rows_a_file: int = 100_000, characters_a_file: int = 64 << 20):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.rows_a_file, self.characters_a_file = rows_a_file, characters_a_file
        self._generations = Generations(spark, folder)

    @classmethod
    def create(cls, files: DataFrame, folder: str, **sizes: int) -> ProjectStore:
        """A new store of ``files`` (``COLUMNS``; ids are unique, rows without id or project are left out)."""
        Generations(files.sparkSession, folder).begin()
        store = cls(files.sparkSession, folder, **sizes)
        store._write(_whole(files), None)
        return store

    def manifest(self) -> DataFrame:
        """One row a project: the generation that holds it, its number of files and their size."""
        newest = max(self._generations.committed())
        return self._generations.read("held", _MANIFEST).where(F.col("generation") == newest).drop("generation")

    def files(self, projects: DataFrame | None = None) -> DataFrame:
        """Stored files, with ``generation``; only of ``projects`` (column project_id) if given. Other directories are not read."""
        held = self.manifest()
        if projects is not None:
            held = held.join(projects.select("project_id").distinct(), "project_id", "left_semi")
        rows = self._generations.read("files", _ROWS)
        there = held.select("project_id", F.col("held_by").alias("generation"))
        return rows.join(there, ["generation", "project_id"], "left_semi").select(*COLUMNS, "generation")

    def upsert(self, records: DataFrame) -> None:
        """Records replace the files with their ids, in whatever project these lie, or are added."""
        new = cut_lineage(_whole(records))  # read several times
        # Ids and projects alone say which projects are touched: those of the records, and those that lose a file to another.
        held = self.files().select("id", "project_id").join(new.select("id"), "id", "left_semi").select("project_id")
        touched = cut_lineage(new.select("project_id").unionByName(held).distinct())
        kept = self.files(touched).drop("generation").join(new.select("id"), "id", "left_anti")
        self._write(kept.unionByName(new), touched)

    def delete(self, ids: DataFrame) -> None:
        """Files with these ids (column id) go; only their projects are written again."""
        gone = cut_lineage(ids.select("id").distinct())
        touched = cut_lineage(self.files().select("id", "project_id").join(gone, "id", "left_semi").select("project_id").distinct())
        self._write(self.files(touched).drop("generation").join(gone, "id", "left_anti"), touched)

    def _write(self, rows: DataFrame, touched: DataFrame | None) -> None:
        number = self._generations.next()
        rows = rows.select(*COLUMNS)
        # A project is cut into as many parts as its size asks for, so that a large one is written by many tasks.
        sizes = rows.groupBy("project_id").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("size"))
        parts = F.greatest(F.ceil(F.col("files") / self.rows_a_file), F.ceil(F.col("size") / self.characters_a_file), F.lit(1))
        dealt = rows.join(sizes.select("project_id", parts.cast("int").alias("_parts")), "project_id")
        dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts"))).repartition("project_id", "_part").drop("_parts", "_part")
        self._generations.write(dealt, "files", number, "project_id", maxRecordsPerFile=self.rows_a_file)
        written = self.spark.read.schema(_ROWS).parquet(f"{self.folder}/files/generation={number}")
        fresh = written.groupBy("project_id").agg(F.lit(number).cast("long").alias("held_by"), F.count("*").alias("files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("size"))
        if touched is not None:
            fresh = fresh.unionByName(self.manifest().join(touched, "project_id", "left_anti"))
        self._generations.write(fresh, "held", number)
        self._generations.commit(number)  # the switch


def _whole(records: DataFrame) -> DataFrame:
    return records.where("id IS NOT NULL AND project_id IS NOT NULL").select(*COLUMNS)
