"""Version history: numbering, retention, as-of lookup, predecessors, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions.text import default, line_count
from codeloom.operators.ranking import numbered

KEY = ["project_id", "path"]
MAX_VERSIONS = 20
#: What one task may have of a file; a larger file's versions and texts are linked and fetched in pieces.
FILE_VERSIONS = 1_000_000
FILE_BYTES = 64_000_000


def _minute(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / 60)


def new_versions(saves: DataFrame) -> DataFrame:
    """Version records of a batch of saves, with the defaults of the fields left open."""
    content = F.coalesce("content", F.lit(""))
    return saves.select(
        F.sha2(F.concat_ws("\u0001", "project_id", "path", F.unix_micros("ts").cast("string"), F.sha2(content, 256)), 256).alias("version_key"),
        "version_id", "project_id", "path", "content", F.length(content).alias("size"),
        F.when(content == "", F.lit(0)).otherwise(line_count(content)).alias("lines"), "ts",
        default("change_type", "manual_edit").alias("change_type"), default("source", "unknown").alias("source"),
        F.lit(False).alias("is_favorite"))


def number_versions(versions: DataFrame) -> DataFrame:
    """``version_no`` 1..n per file in time order, counted without one task per file."""
    return numbered(versions, KEY, [F.col("ts"), F.col("version_id")], _minute(F.col("ts")), "version_no")


def retained(versions: DataFrame, keep: int = MAX_VERSIONS) -> DataFrame:
    """The newest ``keep`` versions per file and all favourites.

    The rank filter alone is a plain top-k, which Spark limits per partition before the
    shuffle; favourites are added back by id.
    """
    narrow = versions.select("version_id", "ts", "is_favorite", *KEY)
    w = Window.partitionBy(*KEY).orderBy(F.col("ts").desc(), F.col("version_id").desc())
    newest = narrow.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).select("version_id")
    ids = newest.unionByName(narrow.where("is_favorite").select("version_id")).distinct()
    return versions.join(ids, "version_id", "left_semi")


def save_versions(existing: DataFrame, saves: DataFrame, keep: int = MAX_VERSIONS) -> DataFrame:
    return retained(existing.unionByName(saves, allowMissingColumns=True), keep)


def as_of(probes: DataFrame, versions: DataFrame) -> DataFrame:
    """For each probe (probe_id, project_id, path, ts) the newest version at or before its time.

    One sorted pass over the union of both sides, cut by minute: the last version of earlier
    minutes is carried in from one row per (file, minute), so neither many probes nor a file
    with many versions meets in one task or multiplies.
    """
    v = versions.select(*KEY, "ts", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("probe_id"), "version_id")
    p = probes.select(*KEY, "ts", F.lit(1).alias("side"), "probe_id", F.lit(None).cast("bigint").alias("version_id"))
    rows = v.unionByName(p).withColumn("minute", _minute(F.col("ts")))
    inside = Window.partitionBy(*KEY, "minute").orderBy("ts", "side", "version_id")
    local = rows.withColumn("found", F.last("version_id", ignorenulls=True).over(
        inside.rowsBetween(Window.unboundedPreceding, 0)))
    last = v.groupBy(*KEY, _minute(F.col("ts")).alias("minute")).agg(
        F.max_by("version_id", F.struct("ts", "version_id")).alias("last_version"))
    ahead = rows.select(*KEY, "minute").distinct().join(last, [*KEY, "minute"], "left")
    before = Window.partitionBy(*KEY).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    carried = ahead.withColumn("carried", F.last("last_version", ignorenulls=True).over(before)).drop("last_version")
    return (local.where("side = 1").join(carried, [*KEY, "minute"], "left")
            .select("probe_id", *KEY, "ts", F.coalesce("found", "carried").alias("version_id")))


def linked_versions(versions: DataFrame) -> DataFrame:
    """``version_id, version_no, old_version``: the id before each version's own in its file (null for the first)."""
    n = number_versions(versions.select("version_id", "ts", *KEY))
    before = n.select(F.col("project_id").alias("b_project"), F.col("path").alias("b_path"), (F.col("version_no") + 1).alias("b_no"),
                      F.col("version_id").alias("old_version"))
    return n.join(before, (F.col("project_id") == F.col("b_project")) & (F.col("path") == F.col("b_path"))
                    & (F.col("version_no") == F.col("b_no")), "left").select("version_id", "version_no", "old_version")


def with_predecessor(versions: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Each version with the id and content of the one before it (null for the first).

    Ids are numbered and linked without contents, which then are fetched by id. With ``contents`` (content_key, content;
    keys unique), versions have a ``content_key`` in place of the content: only keys are fetched by id, and no version
    carries a text through a shuffle.
    """
    linked = linked_versions(versions)
    held = "content" if contents is None else "content_key"
    before = versions.select(F.col("version_id").alias("old_version"), F.col(held).alias(f"old_{held}"))
    found = versions.join(linked, "version_id").join(before, "old_version", "left")
    if contents is None:
        return found
    return found.join(contents.select(F.col("content_key").alias("old_content_key"), F.col("content").alias("old_content")), "old_content_key", "left")


def predecessor_keys(versions: DataFrame) -> DataFrame:
    """``pair_id, old_key, new_key``: the content keys of each version that has a predecessor and of that predecessor."""
    linked = linked_versions(versions).where("old_version IS NOT NULL")
    new = versions.select("version_id", F.col("content_key").alias("new_key"))
    old = versions.select(F.col("version_id").alias("old_version"), F.col("content_key").alias("old_key"))
    return linked.join(new, "version_id").join(old, "old_version").select(F.col("version_id").alias("pair_id"), "old_key", "new_key")


def ids_repeat(versions: DataFrame) -> bool:
    return not versions.groupBy("version_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def large_files(versions: DataFrame, texts: DataFrame) -> DataFrame:
    """``project_id, path`` of the files that are too large for one task, by their versions or by their texts."""
    many = versions.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > FILE_VERSIONS)
    long = texts.groupBy(*KEY).agg(F.sum(F.octet_length("content")).alias("n")).where(F.col("n") > FILE_BYTES)
    return many.unionByName(long).select(*KEY).distinct()


def file_pairs(versions: DataFrame, texts: DataFrame) -> DataFrame:
    """``pair_id, old, new``: the pairs of texts of each version and its predecessor, a row per file and pair.

    ``versions`` have unique ids and a ``content_key``; ``texts`` has ``project_id, path, content_key, content``. ``pair_id``
    holds the ids of the versions that have the pair. A file's versions and texts meet in one task, so each is shuffled
    once, by file, whatever number of pairs a text is in. Files are bounded as ``large_files`` says.
    """
    w = Window.partitionBy(*KEY).orderBy("ts", "version_id")
    linked = versions.select(*KEY, "ts", "version_id", "content_key").where("project_id IS NOT NULL AND path IS NOT NULL").withColumn(
        "old", F.lag(F.struct("content_key")).over(w)).where("old IS NOT NULL")
    pairs = linked.groupBy(*KEY, F.col("old.content_key").alias("old_key"), F.col("content_key").alias("new_key")).agg(
        F.collect_list("version_id").alias("pair_id"))
    held = pairs.groupBy(*KEY).agg(F.collect_list(F.struct("pair_id", "old_key", "new_key")).alias("pairs"))
    found = texts.groupBy(*KEY).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("content_key", "content")))).alias("texts"))
    apart = held.join(found, KEY, "left").select("texts", F.inline("pairs"))
    return apart.select("pair_id", F.element_at("texts", F.col("old_key")).alias("old"), F.element_at("texts", F.col("new_key")).alias("new"))


def with_texts(keyed: DataFrame, contents: DataFrame) -> DataFrame:
    """Rows with the texts ``old`` and ``new`` that ``old_key`` and ``new_key`` name; a null key names none."""
    for side in ("old", "new"):
        keyed = keyed.join(contents.select(F.col("content_key").alias(f"{side}_key"), F.col("content").alias(side)), f"{side}_key", "left")
    return keyed


def version_pairs(pairs: DataFrame, versions: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Contents of requested (pair_id, old_version, new_version) pairs.

    With ``contents``, versions have a ``content_key`` in place of the content. The texts of a pair of keys then are
    fetched once, whatever number of pairs have them.
    """
    held, old, new = ("content", "old", "new") if contents is None else ("content_key", "old_key", "new_key")
    a = versions.select(F.col("version_id").alias("old_version"), F.col(held).alias(old))
    b = versions.select(F.col("version_id").alias("new_version"), F.col(held).alias(new))
    found = pairs.join(a, "old_version").join(b, "new_version")
    if contents is None:
        return found
    texts = with_texts(found.select(old, new).distinct(), contents).select(F.col(old).alias("_old"), F.col(new).alias("_new"), "old", "new")
    return found.join(texts, F.col(old).eqNullSafe(F.col("_old")) & F.col(new).eqNullSafe(F.col("_new"))).drop("_old", "_new", old, new)


def statistics(versions: DataFrame) -> DataFrame:
    """Per project: versions, files, most changed file (lowest path on ties), first and last time."""
    per_file = versions.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return per_file.groupBy("project_id").agg(
        F.sum("n").alias("versions"), F.count("*").alias("files"),
        F.min_by("path", F.struct(-F.col("n"), F.col("path"))).alias("most_changed"), F.max("n").alias("most_changed_count"),
        F.min("first").alias("first_at"), F.max("last").alias("last_at"))


def change_types(versions: DataFrame) -> DataFrame:
    return versions.groupBy("project_id", F.coalesce("change_type", F.lit("unknown")).alias("change_type")).agg(F.count("*").alias("versions"))


def timeline(versions: DataFrame) -> DataFrame:
    """Versions per project and UTC day. The changes of a day are the versions themselves, keyed by ``day``."""
    return with_day(versions).groupBy("project_id", "day").agg(F.count("*").alias("changes"), F.count_distinct("path").alias("files"))


def with_day(versions: DataFrame) -> DataFrame:
    return versions.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def timeline_changes(versions: DataFrame) -> DataFrame:
    """The changes below each day of the timeline, newest first: ``place`` counts from 0 within (project, day).

    Numbered by minute, so that a busy day is no single task; a page of a day is a range of places.
    """
    rows = with_day(versions).select("project_id", "day", "version_id", "path", "change_type", "size", "ts")
    found = numbered(rows, ["project_id", "day"], [F.col("ts").desc(), F.col("version_id").desc()], -_minute(F.col("ts")), "_n")
    return found.withColumn("place", F.col("_n") - 1).drop("_n")


def toggled(versions: DataFrame, toggles: DataFrame) -> DataFrame:
    """Flip the favourite mark of the listed versions; a version listed twice flips back."""
    odd = toggles.groupBy("version_id").agg((F.count("*") % 2 == 1).alias("flip"))
    return versions.join(odd, "version_id", "left").withColumn(
        "is_favorite", F.when(F.coalesce("flip", F.lit(False)), ~F.col("is_favorite")).otherwise(F.col("is_favorite"))).drop("flip")


def without_versions(versions: DataFrame, ids: DataFrame | None = None, projects: DataFrame | None = None) -> DataFrame:
    out = versions
    if ids is not None:
        out = out.join(ids, "version_id", "left_anti")
    if projects is not None:
        out = out.join(projects, "project_id", "left_anti")
    return out
