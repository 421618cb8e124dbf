"""Queries: snapshots written and read back, and the project store they are imported into."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from codeloom.plans.exports import _LINES, _damaged
from codeloom.plans.registry import query
from codeloom.plans.sqltext import sql
from codeloom.session import cut_lineage, ensure_checkpoint_dir
from codeloom.sources import snapshots as SN, views as V
from codeloom.sources.project_store import ProjectStore
from codeloom.sources.seen_set import SeenSet
from codeloom.sources.version_store import VersionStore
from codeloom.streaming.queue import ChangeQueue

_CHOSEN = "(SELECT 'src' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey < 2)"


def new_folder(t, label: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{label}-{uuid.uuid4().hex}"


def chosen(t) -> DataFrame:
    return t("nation").where("n_regionkey < 2").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("project_id"))


def imported_store(t) -> ProjectStore:
    """A store of the labelled documents, into which a snapshot of some projects is imported from its files.

    The snapshot holds whole and damaged lines. A second import of the same snapshot changes nothing.
    """
    labelled = t("labels").select(F.col("doc_id").alias("file_id")).distinct()
    there = V.files(t).join(labelled, "file_id", "left_semi").withColumn("id", F.col("file_id").cast("string"))
    store = ProjectStore.create(there, new_folder(t, "project-store"))
    path = new_folder(t, "snapshot")
    lines = _damaged(t).join(chosen(t), F.get_json_object("value", "$.project_id") == F.col("project_id"), "left_semi")
    lines.write.text(f"{path}/records")
    records = SN.read_snapshot(t.spark, path).where("kind = 'file'")
    store.upsert(records)
    return store


_IMPORTED = f"""{_LINES}, imp AS (SELECT * FROM d WHERE n NOT IN (2, 3, 4) AND project_id IN {_CHOSEN}),
stored AS (SELECT CAST(file_id AS VARCHAR) AS id, project_id, path, content || '!' AS content FROM imp
  UNION ALL SELECT CAST(file_id AS VARCHAR), project_id, path, content FROM files WHERE file_id IN (SELECT doc_id FROM labels) AND file_id NOT IN (SELECT file_id FROM imp)),
held AS (SELECT *, CAST(CASE WHEN project_id IN (SELECT project_id FROM imp) THEN 1 ELSE 0 END AS BIGINT) AS generation FROM stored)"""


@query("s12_written_snapshot", sql(f"""
SELECT kind, id, project_id, path, language, content FROM (
  SELECT 'file' AS kind, CAST(file_id AS VARCHAR) AS id, project_id, path, language, content FROM files
  UNION ALL SELECT DISTINCT 'project', project_id, project_id, NULL, NULL, NULL FROM files) WHERE project_id IN {_CHOSEN}""", "files"))
def written_snapshot(t):
    path = new_folder(t, "snapshot")
    SN.write_snapshot(SN.snapshot_records(V.files(t), chosen(t)), path)
    return SN.read_snapshot(t.spark, path).drop(SN.CORRUPT)


@query("s13_stored_import", sql(f"WITH {_IMPORTED} SELECT id, project_id, path, content, generation FROM held", "files"))
def stored_import(t):
    """Projects without imported files keep the directories of the first generation."""
    return imported_store(t).files().select("id", "project_id", "path", "content", "generation")


@query("s15_store_manifest", sql(f"""WITH {_IMPORTED}
SELECT project_id, generation AS held_by, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS size FROM held GROUP BY project_id, generation""", "files"))
def store_manifest(t):
    return imported_store(t).manifest()


@query("s15_store_after_delete", sql(f"""WITH {_IMPORTED}, gone AS (SELECT id, project_id FROM held WHERE len(string_split(content, chr(10))) = 1)
SELECT id, CASE WHEN project_id IN (SELECT project_id FROM gone) THEN 2 ELSE generation END AS generation FROM held WHERE id NOT IN (SELECT id FROM gone)""", "files"))
def after_delete(t):
    """Files of a single line are deleted again."""
    store = imported_store(t)
    store.delete(store.files().where(F.size(F.split("content", "\n")) == 1))
    return store.files().select("id", "generation")


# --- versions saved in batches ------------------------------------------------------------------
def version_store(t, keep: int = 4) -> VersionStore:
    """All versions, saved as three batches of ten days; the second one twice, as after a crash."""
    v, contents = V.version_records(t), V.contents(t)
    parts = [v.where(F.col("ts") < F.lit("2024-01-11").cast("timestamp")),
             v.where(F.col("ts").between(F.lit("2024-01-11").cast("timestamp"), F.lit("2024-01-20 23:59:59.999999").cast("timestamp"))),
             v.where(F.col("ts") >= F.lit("2024-01-21").cast("timestamp"))]
    store = VersionStore.create(parts[0], new_folder(t, "version-store"), buckets=16, keep=keep, contents=contents)
    for part in (parts[1], parts[1], parts[2]):
        store.save(part, contents)
    return store


@query("v1_version_store", sql("""
SELECT version_id, project_id, path, size, is_favorite FROM (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY ts DESC, version_id DESC) AS r FROM versions)
WHERE r <= 4 OR is_favorite""", "versions"))
def stored_versions(t):
    return version_store(t).versions().select("version_id", "project_id", "path", "size", "is_favorite")


# --- the change queue ---------------------------------------------------------------------------
_CHANGE = "event_id long, user_id long, event_type string, value double"


def _receiver(rows: DataFrame, batch_id: int, attempt: int) -> DataFrame:
    """A receiver that is down for errors, and answers signups at the second and purchases at the third attempt."""
    kind = rows.select("event_type").first()
    needed = {"signup": 2, "purchase": 3, "error": 99}.get(kind[0] if kind else None, 1)
    if attempt < needed:
        raise ConnectionError(f"receiver of {kind[0]} is down")
    return rows


def worked_off(t) -> ChangeQueue:
    """Events as queued changes, by files of one type each, one file a batch; changes below 1 in value are refused."""
    folder = new_folder(t, "change-queue")
    t("events").select("event_id", "user_id", "event_type", "value").repartition("event_type").write.partitionBy("event_type").parquet(f"{folder}/changes")
    stream = t.spark.readStream.schema(_CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/changes")
    refused = F.when(F.col("value").isNull(), F.lit("no value")).when(F.col("value") < 1, F.lit("value below 1"))
    return ChangeQueue(t.spark, f"{folder}/queue", _receiver, refused).open().run(stream, f"{folder}/checkpoint")


@query("st9_delivered_changes", """
SELECT event_id, user_id, event_type, CAST(CASE event_type WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 1 END AS BIGINT) AS attempts FROM events WHERE value >= 1 AND event_type <> 'error'""")
def delivered(t):
    return worked_off(t).sent(_CHANGE).select("event_id", "user_id", "event_type", "attempts")


@query("st9_dead_letters", """
SELECT event_id, CASE WHEN value IS NULL THEN 'no value' WHEN value < 1 THEN 'value below 1' ELSE 'ConnectionError: receiver of error is down' END AS reason,
  CAST(CASE WHEN coalesce(value, 0) < 1 THEN 0 ELSE 3 END AS BIGINT) AS attempts FROM events WHERE coalesce(value, 0) < 1 OR event_type = 'error'""")
def dead_letters(t):
    return worked_off(t).dead(_CHANGE).select("event_id", "reason", "attempts")


# --- keys seen over many scans ------------------------------------------------------------------
@query("j5_seen_over_scans", sql("""
SELECT file_id, file_id % 4 AS scan, min(file_id % 4) OVER (PARTITION BY content) < file_id % 4 AS seen FROM files""", "files"))
def seen_over_scans(t):
    """All files in four scans, each flagged against those before it."""
    known = SeenSet(t.spark, new_folder(t, "seen-set")).open()
    rows = V.files(t).select("file_id", F.sha2("content", 256).alias("hash"), (F.col("file_id") % 4).alias("scan"))
    rows, found = cut_lineage(rows), None
    for n in range(4):
        scan = rows.where(F.col("scan") == n)
        part = cut_lineage(known.flagged(scan).select("file_id", "scan", "seen"))
        found = part if found is None else found.unionByName(part)
        known.add(scan.select(F.col("hash").alias("key")))
    return found
