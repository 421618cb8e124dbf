"""JSON snapshots of projects and files, and the partitioned project sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.operators.exports import manifest

VERSION = "1.0.0"
RECORD = "kind string, id string, project_id string, path string, language string, content string"
CORRUPT = "_corrupt_record"


def snapshot_records(files: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Records of a snapshot: every project and file, or those of the chosen project ids."""
    if chosen is not None:
        files = files.join(chosen.select("project_id").distinct(), "project_id", "left_semi")
    none = F.lit(None).cast("string")
    f = files.select(F.lit("file").alias("kind"), F.col("file_id").cast("string").alias("id"), "project_id", "path", "language", "content")
    p = files.select("project_id").distinct().select(
        F.lit("project").alias("kind"), F.col("project_id").alias("id"), "project_id", none.alias("path"), none.alias("language"), none.alias("content"))
    return p.unionByName(f)


def snapshot_header(records: DataFrame) -> DataFrame:
    return records.agg(F.lit(VERSION).alias("version"), F.count_if(F.col("kind") == "project").alias("projects"),
                       F.count_if(F.col("kind") == "file").alias("files"), F.sum(F.length("content")).alias("size"))


def to_lines(records: DataFrame) -> DataFrame:
    return records.select(F.to_json(F.struct(*[c for c in records.columns])).alias("value"))


def write_snapshot(records: DataFrame, path: str) -> None:
    to_lines(records).write.mode("overwrite").text(f"{path}/records")
    to_lines(snapshot_header(records)).write.mode("overwrite").text(f"{path}/header")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed records of JSON lines; a malformed line keeps its text in ``_corrupt_record``."""
    schema = f"{RECORD}, {CORRUPT} string"
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.withColumn("r", parsed).select("r.*")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(f"{path}/records"))


def validation_errors(records: DataFrame) -> DataFrame:
    """One row per problem: malformed line, project or file without id, file without project."""
    checks = F.array(
        F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed record")),
        F.when(F.col(CORRUPT).isNull() & F.col("id").isNull(), F.concat(F.initcap("kind"), F.lit(" missing id"))),
        F.when((F.col("kind") == "file") & F.col("project_id").isNull(), F.lit("File missing projectId")))
    return records.select("kind", "id", "project_id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("error"))


def header_errors(headers: DataFrame) -> DataFrame:
    return headers.where("version IS NULL").select(F.lit("Missing version field").alias("error"))


def upsert(existing: DataFrame, records: DataFrame) -> DataFrame:
    """Stored files after an import: valid imported rows replace rows with their id.

    Ids are unique on either side, so this is an anti-join and a union, without a window.
    """
    valid = records.where((F.col("kind") == "file") & F.col("id").isNotNull() & F.col("project_id").isNotNull())
    new = valid.select("id", "project_id", "path", "language", "content").withColumn("imported", F.lit(True))
    kept = existing.join(new.select("id"), "id", "left_anti").withColumn("imported", F.lit(False))
    return kept.select(*new.columns).unionByName(new)


def import_counts(records: DataFrame) -> DataFrame:
    ok = F.col("id").isNotNull()
    return records.agg(F.count_if(ok & (F.col("kind") == "project")).alias("projects_imported"),
                       F.count_if(ok & (F.col("kind") == "file") & F.col("project_id").isNotNull()).alias("files_imported"))


def write_projects(files: DataFrame, path: str, files_per_task: int = 100_000) -> None:
    """One directory per project, and the manifest beside them. Paths must be unique (resolve duplicates first).

    Rows are spread by (project, path) so that a large project is written by many tasks.
    """
    spread = files.repartition(F.col("project_id"), F.pmod(F.xxhash64("path"), F.lit(32)))
    spread.write.mode("overwrite").partitionBy("project_id").option("maxRecordsPerFile", files_per_task).parquet(f"{path}/files")
    manifest(files).write.mode("overwrite").parquet(f"{path}/manifest")
