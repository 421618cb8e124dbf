"""Exact duplicates, path conflicts, resolution strategies and reports.

Groups may hold a large share of the corpus, so every group is reduced by
pre-aggregated counts and min/max; members are kept in long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import paths as P
from codeloom.functions.text import content_hash, line_count
from codeloom.operators.ranking import numbered, rows_of, winners
from codeloom.session import cut_lineage

COARSE = 1_000_000  # ids per coarse group when numbering inside a path


def hashed(files: DataFrame) -> DataFrame:
    """Adds ``hash``, ``size``, ``lines``; downstream steps carry these instead of the content."""
    return (files.withColumn("hash", content_hash("content")).withColumn("size", F.length("content"))
            .withColumn("lines", line_count("content")))


def exact_groups(h: DataFrame) -> DataFrame:
    """Content hashes held by more than one file."""
    return (h.groupBy("hash").agg(F.count("*").alias("files"), F.min("file_id").alias("first_file"))
            .where("files > 1").withColumn("excess", F.col("files") - 1))


def path_conflicts(h: DataFrame) -> DataFrame:
    """Paths (case-folded, per project) with more than one content."""
    per_content = h.groupBy("project_id", F.lower("path").alias("path"), "hash").agg(F.count("*").alias("n"))
    return (per_content.groupBy("project_id", "path")
            .agg(F.sum("n").alias("files"), F.count("*").alias("contents")).where("contents > 1"))


def resolve_by_path(files: DataFrame, strategy: str = "latest", case_folded: bool = False) -> DataFrame:
    """One file per (project, path): the last or the first to arrive."""
    if strategy not in ("latest", "keep_latest", "keep_first"):
        raise ValueError(f"{strategy} does not pick one file; see merge_parts and keep_both")
    key = F.lower("path") if case_folded else F.col("path")
    chosen = winners(files.select("project_id", key.alias("_key"), "file_id"), ["project_id", "_key"], "file_id",
                     F.col("file_id"), last=strategy != "keep_first")
    return rows_of(files, chosen, "file_id")


def merge_parts(files: DataFrame) -> DataFrame:
    """Strategy ``merge`` in long form: the merged file of a path is its parts in order.

    A path may collect any number of contents, so parts are numbered rather than
    glued into one value; ``merged_text`` glues a bounded number at a time.
    """
    parts = numbered(files, ["project_id", "path"], [F.col("file_id")], F.floor(F.col("file_id") / COARSE), "part")
    return parts.select("project_id", "path", "part", "file_id", "content",
                        F.length("content").alias("size"), line_count("content").alias("lines"))


def merge_totals(files: DataFrame) -> DataFrame:
    """Sizes and lines of merged files are the sums of their parts."""
    return files.groupBy("project_id", "path").agg(
        F.count("*").alias("parts"), F.sum(F.length("content")).alias("size"), F.sum(line_count("content")).alias("lines"))


def merged_text(parts: DataFrame, per_piece: int = 64, separator: str = "\n\n") -> DataFrame:
    """Merged contents in numbered pieces of ``per_piece`` parts; a path's pieces, joined likewise, are its whole text."""
    return (parts.groupBy("project_id", "path", F.floor((F.col("part") - 1) / per_piece).alias("piece"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))),
                                          lambda p: p["content"]), separator).alias("content")))


def keep_both(files: DataFrame) -> DataFrame:
    """All files; the k-th repeat of a path becomes ``dir/stem_copyK.ext``.

    Where that name is already taken by a real file of the project, the file id is added.
    """
    n = numbered(files, ["project_id", "path"], [F.col("file_id")], F.floor(F.col("file_id") / COARSE), "_rn")
    n = n.withColumn("copy", F.col("_rn") - 1).drop("_rn")
    renamed = F.when(F.col("copy") == 0, F.col("path")).otherwise(
        P.suffixed("path", F.concat(F.lit("_copy"), F.col("copy").cast("string"))))
    n = n.withColumn("original_path", F.col("path")).withColumn("path", renamed)
    taken = files.select(F.col("project_id").alias("t_project"), F.col("path").alias("t_path")).distinct()
    joined = n.join(taken, (F.col("copy") > 0) & (F.col("project_id") == F.col("t_project"))
                    & (F.col("path") == F.col("t_path")), "left")
    clash = P.suffixed("path", F.concat(F.lit("_"), F.col("file_id").cast("string")))
    return joined.withColumn("path", F.when(F.col("t_path").isNotNull(), clash).otherwise(F.col("path"))).drop(
        "t_project", "t_path")


def survivor(strategy: str) -> tuple[Column, bool]:
    """Ordering that puts a group's survivor at the max (True) or the min (False).

    Ties fall to the file that came first.
    """
    arrival = -F.col("file_id")
    if strategy in ("latest", "keep_latest"):
        return F.struct(F.col("ts"), arrival), True
    if strategy == "largest":
        return F.struct(F.col("size"), arrival), True
    return F.col("file_id"), False  # first, merge and anything unknown keep the first


def survivors(members: DataFrame, keys: list[str], strategy: str = "latest") -> DataFrame:
    """Survivor id per group; ``members`` holds the keys, file_id, ts and size."""
    best, last = survivor(strategy)
    return winners(members, keys, "file_id", best, last)


def losers(h: DataFrame, similar_members: DataFrame | None = None, strategy: str = "latest") -> DataFrame:
    """Ids removed by duplicate resolution: all non-survivors of exact, path and similar groups.

    Survivors are found by aggregation and joined back by group key; a group's rows
    never gather in one task because the joined side has one row per group.
    """
    # hashes are computed in one pass over the contents; the rest works on these narrow rows
    narrow = cut_lineage(h.select("file_id", "project_id", F.lower("path").alias("path"), "hash", "ts", "size"))

    def beaten(groups: DataFrame, keys: list[str]) -> DataFrame:
        keep = survivors(groups, keys, strategy).withColumnRenamed("file_id", "keeper")
        return groups.join(keep, keys).where("file_id <> keeper").select("file_id")

    conflicts = path_conflicts(narrow).select("project_id", "path")
    out = beaten(narrow, ["hash"]).unionByName(
        beaten(narrow.join(conflicts, ["project_id", "path"], "left_semi"), ["project_id", "path"]))
    if similar_members is not None:
        out = out.unionByName(beaten(similar_members.join(narrow.select("file_id", "ts", "size"), "file_id"), ["group_id"]))
    return out.distinct()


def without_duplicates(files: DataFrame, removed: DataFrame) -> DataFrame:
    return files.join(removed, "file_id", "left_anti")


def statistics(h: DataFrame) -> DataFrame:
    """Totals of one corpus: files, excess of exact groups, excess of path conflicts."""
    h = cut_lineage(h.select("project_id", "path", "hash"))
    exact = h.groupBy("hash").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("total_files"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("exact_duplicates"))
    paths = path_conflicts(h).agg(F.struct(F.coalesce(F.sum(F.col("files") - 1), F.lit(0)).alias("excess"),
                                           F.count("*").alias("groups")).alias("p"))
    return exact.withColumn("_p", paths.scalar()).select(
        "*", F.col("_p.excess").alias("path_duplicates"), F.col("_p.groups").alias("path_groups"),
        (F.col("exact_duplicates") + F.col("_p.excess")).alias("duplicate_files")).drop("_p")


def recommendations(stats: DataFrame) -> DataFrame:
    """Rows for the findings that apply; ``stats`` may lack near-duplicate counts."""
    for c in ("near_duplicates", "similar_groups"):
        if c not in stats.columns:
            stats = stats.withColumn(c, F.lit(0).cast("bigint"))
    rows = F.array(
        F.struct(F.lit("exact_duplicates").alias("type"), F.lit("remove_duplicates").alias("action"),
                 F.col("exact_duplicates").alias("n"),
                 F.concat(F.lit("Found "), F.col("exact_duplicates").cast("string"), F.lit(
                     " exact duplicate files. Consider removing them to reduce project size.")).alias("message")),
        F.struct(F.lit("near_duplicates").alias("type"), F.lit("review_similar").alias("action"),
                 F.col("near_duplicates").alias("n"),
                 F.concat(F.lit("Found "), F.col("near_duplicates").cast("string"), F.lit(
                     " near-duplicate files (similar content). Review them to ensure they serve different purposes.")).alias("message")),
        F.struct(F.lit("similar_files").alias("type"), F.lit("consolidate").alias("action"),
                 F.col("similar_groups").alias("n"),
                 F.concat(F.col("similar_groups").cast("string"), F.lit(
                     " groups of similar files detected. Consider consolidating or renaming them.")).alias("message")))
    return stats.select(F.explode(rows).alias("r")).select("r.type", "r.action", "r.message", "r.n").where("n > 0").drop("n")


def group_report(h: DataFrame) -> DataFrame:
    """Long form of exact and path groups: one row per member."""
    cols = ["path", "size", "lines", "language", "file_id"]
    h = cut_lineage(h.select("project_id", "hash", *cols))
    exact = h.join(exact_groups(h).select("hash", "files"), "hash").select(
        F.lit("exact").alias("group_type"), F.col("hash").alias("group_key"), F.col("files").alias("count"), *cols)
    low = h.withColumn("_low", F.lower("path"))
    conflict = path_conflicts(h).select("project_id", F.col("path").alias("_low"), "files")
    path = low.join(conflict, ["project_id", "_low"]).select(
        F.lit("path_conflict").alias("group_type"), F.concat("project_id", F.lit("/"), "_low").alias("group_key"),
        F.col("files").alias("count"), *cols)
    return exact.unionByName(path)


def repeated_paths(files: DataFrame) -> DataFrame:
    return files.groupBy("project_id", "path").agg(F.count("*").alias("count")).where("count > 1")


def seen_before(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Flag files whose content hash occurs in an earlier scan."""
    known = seen.select(F.col("hash").alias("seen_hash")).distinct()
    return files.join(known, F.col("hash") == F.col("seen_hash"), "left").withColumn(
        "previously_extracted", F.col("seen_hash").isNotNull()).drop("seen_hash")


def only_new(files: DataFrame, seen: DataFrame) -> DataFrame:
    return files.join(seen.select("hash"), "hash", "left_anti")
