"""Merging new material into what is there: batches, conflicts, sources, replicas, split blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import paths as P
from codeloom.functions.similarity import update_type
from codeloom.functions.text import line_count, strip
from codeloom.operators.ranking import rows_of, winners


def _last_per_path(files: DataFrame) -> DataFrame:
    """The last arrival per (project, case-folded path)."""
    keyed = files.withColumn("path_key", F.lower("path"))
    return rows_of(keyed, winners(keyed, ["project_id", "path_key"], "file_id", F.col("file_id")), "file_id")


def merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Status of every path: kept, added, updated, unchanged or conflict, with both contents."""
    old = _last_per_path(existing).select(
        F.col("project_id").alias("o_project"), F.col("path_key").alias("o_key"), F.col("path").alias("old_path"),
        F.col("file_id").alias("old_file"), F.col("content").alias("old_content"))
    new = _last_per_path(incoming).select(
        F.col("project_id").alias("n_project"), F.col("path_key").alias("n_key"), F.col("path").alias("new_path"),
        F.col("file_id").alias("new_file"), F.col("content").alias("new_content"))
    joined = old.join(new, (F.col("o_project") == F.col("n_project")) & (F.col("o_key") == F.col("n_key")), "full_outer")
    both = F.col("old_file").isNotNull() & F.col("new_file").isNotNull()
    changed = both & (F.col("old_content") != F.col("new_content"))
    kind = F.when(changed, update_type("old_content", "new_content"))
    status = (F.when(F.col("old_file").isNull(), F.lit("added")).when(F.col("new_file").isNull(), F.lit("kept"))
              .when(~changed, F.lit("unchanged")).when(F.col("update_type") == "UNRELATED", F.lit("conflict"))
              .otherwise(F.lit("updated")))
    return (joined.withColumn("update_type", kind).withColumn("status", status)
            .withColumn("project_id", F.coalesce("o_project", "n_project"))
            .withColumn("path", F.coalesce("old_path", "new_path")).withColumn("path_key", F.coalesce("o_key", "n_key"))
            .drop("o_project", "n_project", "o_key", "n_key", "old_path", "new_path"))


def merged_files(merged: DataFrame) -> DataFrame:
    """Project files after the merge: new content where added or updated, else the old one."""
    content = F.when(F.col("status").isin("added", "updated"), F.col("new_content")).otherwise(F.col("old_content"))
    return merged.select("project_id", "path", "status", content.alias("content")).withColumn(
        "size", F.length("content")).withColumn("lines", line_count("content"))


def merge_summary(merged: DataFrame) -> DataFrame:
    return merged.groupBy("project_id").agg(*[
        F.count_if(F.col("status") == s).alias(s) for s in ("added", "updated", "unchanged", "conflict", "kept")])


def resolve_conflicts(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply KEEP_OLD, USE_NEW, KEEP_BOTH or RENAME_NEW in bulk; without a decision the old file stays."""
    d = decisions.select(F.col("project_id").alias("d_project"), F.col("path_key").alias("d_key"), "resolution")
    joined = conflicts.join(d, (F.col("project_id") == F.col("d_project")) & (F.col("path_key") == F.col("d_key")), "left")
    choice = F.col("resolution")
    action = (F.when(choice.isin("USE_NEW", "KEEP_BOTH", "RENAME_NEW"), F.lower(choice)).otherwise(F.lit("keep_old")))
    content = (F.when(action.isin("use_new", "rename_new"), F.col("new_content"))
               .when(action == "keep_both", F.concat("old_content", F.lit("\n\n"), "new_content"))
               .otherwise(F.col("old_content")))
    path = F.when(action == "rename_new", P.suffixed("path", F.lit("_v2"))).otherwise(F.col("path"))
    return joined.select("project_id", "path_key", action.alias("action"), path.alias("path"), content.alias("content")).withColumn(
        "size", F.length("content")).withColumn("lines", line_count("content"))


def merge_sources(files: DataFrame) -> DataFrame:
    """Union of many projects by case-folded path: the newest content wins, ties go to the earlier source."""
    keyed = files.select("file_id", "project_id", F.lower("path").alias("path_key"), "ts")
    won = keyed.groupBy("path_key").agg(
        F.min_by("file_id", F.struct(-F.unix_micros("ts"), F.col("project_id"), F.col("file_id"))).alias("file_id"),
        F.count("*").alias("copies"))
    return files.join(won, "file_id").withColumn("size", F.length("content")).withColumn("lines", line_count("content"))


def contributing_sources(files: DataFrame) -> DataFrame:
    """Sources of each merged path in long form: a popular path may come from any number of them."""
    return files.select(F.lower("path").alias("path_key"), "project_id").distinct()


def reconcile(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Direction per id: the newer side wins, equal times conflict, a missing side receives."""
    a = local.select(F.col("id").alias("l_id"), F.col("updated").alias("l_updated"))
    b = remote.select(F.col("id").alias("r_id"), F.col("updated").alias("r_updated"))
    both = a.join(b, F.col("l_id") == F.col("r_id"), "full_outer")
    direction = (F.when(F.col("r_id").isNull() | (F.col("l_updated") > F.col("r_updated")), F.lit("pushed"))
                 .when(F.col("l_id").isNull() | (F.col("r_updated") > F.col("l_updated")), F.lit("pulled"))
                 .otherwise(F.lit("conflict")))
    return both.select(F.coalesce("l_id", "r_id").alias("id"), direction.alias("direction"))


def _ends_open(content: Column) -> Column:
    text = strip(content)
    return (text != "") & ~text.endswith("}") & ~text.endswith(";")


def _continues(content: Column) -> Column:
    text = strip(content)
    starts = F.lit(False)
    for word in ("import", "class", "function", "//", "/*"):
        starts = starts | F.startswith(text, F.lit(word))
    return ~starts


def merge_split_blocks(blocks: DataFrame) -> DataFrame:
    """Fold each page's blocks in order, joining a block to the run before it.

    A block joins when it has the path of the run's head, or the run ends open, the block
    does not start a unit of its own and the languages agree. The fold runs over the blocks
    of one page, which come from one input row.
    """
    entry = F.struct(F.col("block_index"), F.col("file_name"), F.col("language"), F.col("content"), F.lit(1).alias("parts"))
    pages = blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias("b"))
    kind = "array<struct<block_index:int,file_name:string,language:string,content:string,parts:int>>"

    def step(acc: Column, b: Column) -> Column:
        head = F.element_at(acc, -1)
        joins = (head["file_name"] == b["file_name"]) | (
            _ends_open(head["content"]) & _continues(b["content"]) & head["language"].eqNullSafe(b["language"]))
        grown = F.struct(head["block_index"].alias("block_index"), head["file_name"].alias("file_name"),
                         head["language"].alias("language"),
                         F.concat(head["content"], F.lit("\n"), b["content"]).alias("content"),
                         (head["parts"] + 1).alias("parts"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(
            F.concat(acc, F.array(b)))

    folded = F.aggregate(F.slice("b", 2, F.size("b")), F.slice("b", 1, 1).cast(kind),
                         lambda acc, b: step(acc, b).cast(kind))
    return (pages.select("page_id", F.explode(folded).alias("r")).select("page_id", "r.*")
            .withColumn("lines", line_count("content")).withColumn("size", F.octet_length("content")))


def attach_content(listing: DataFrame, contents: DataFrame) -> DataFrame:
    """Content of listed files by path, else by file name (the first file of that name)."""
    by_path = contents.groupBy(F.col("page_id").alias("p_page"), F.col("path").alias("p_path")).agg(
        F.min_by("block_id", "block_index").alias("p_block"))
    by_name = contents.groupBy(F.col("page_id").alias("n_page"), F.col("name").alias("n_name")).agg(
        F.min_by("block_id", "block_index").alias("n_block"))
    found = (listing.join(by_path, (F.col("page_id") == F.col("p_page")) & (F.col("path") == F.col("p_path")), "left")
             .join(by_name, (F.col("page_id") == F.col("n_page")) & (F.col("name") == F.col("n_name")), "left")
             .withColumn("content_block", F.coalesce("p_block", "n_block")))
    texts = contents.select(F.col("block_id").alias("content_block"), "content")
    return found.drop("p_page", "p_path", "p_block", "n_page", "n_name", "n_block").join(texts, "content_block", "left")
