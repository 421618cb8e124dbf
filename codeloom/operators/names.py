"""File names of blocks: the cascade, sanitising, uniqueness per page, paths found in trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codeloom.functions import language as G, naming as N, paths as P, refine as R
from codeloom.functions.text import computed, once

# Groups below are one page, which is one row of the crawl, so their windows stay bounded.


def resolve_names(blocks: DataFrame) -> DataFrame:
    """``strategy`` and sanitised ``file_name`` of every block; a pure projection."""
    found = N.resolve("code", "label", "text_before", "text_after", "surrounding_text", "language", "block_index")
    clean = once(found, lambda n: F.struct(n["strategy"].alias("strategy"),
                                           once(n["name"], P.sanitised_path_name).alias("file_name")))
    return blocks.withColumn("_n", clean).select(*blocks.columns, "_n.strategy", "_n.file_name")


def unique_names(named: DataFrame) -> DataFrame:
    """The k-th use of a name on a page becomes ``stem_k.ext`` (extension in lower case)."""
    w = Window.partitionBy("page_id", "file_name").orderBy("block_index")
    k = F.row_number().over(w)
    name = F.col("file_name")
    return named.withColumn("use", k).withColumn("file_name", F.when(
        F.col("use") > 1, F.concat(P.stem(name), F.lit("_"), F.col("use").cast("string"), F.lower(P.extension(name))))
        .otherwise(name))


def name_counts(named: DataFrame) -> DataFrame:
    return named.groupBy("page_id", "file_name").agg(F.count("*").alias("uses"))


def with_tree_paths(named: DataFrame, tree_paths: DataFrame) -> DataFrame:
    """Bare names take the path of the page's last tree line with that name."""
    last = tree_paths.groupBy("page_id", "name").agg(F.max_by("path", "pos").alias("tree_path"))
    last = last.withColumnRenamed("page_id", "t_page").withColumnRenamed("name", "t_name")
    bare = ~F.col("file_name").contains("/")
    joined = named.join(last, bare & (F.col("page_id") == F.col("t_page")) & (F.col("file_name") == F.col("t_name")),
                        "left")
    return joined.withColumn("file_name", F.when(
        F.col("tree_path").isNotNull(), P.sanitised_path_name("tree_path")).otherwise(F.col("file_name"))
    ).drop("t_page", "t_name", "tree_path")


def identify_languages(named: DataFrame) -> DataFrame:
    """Final language: declared, else by name, else by content."""
    return named.withColumn("language", G.identify("code", "language", "file_name"))


def mapped_files(typed: DataFrame) -> DataFrame:
    """Blocks as project files: placed path, latest block of a page wins a path."""
    placed = typed.withColumn("path", P.placed("file_name", "language"))
    w = Window.partitionBy("page_id", "path").orderBy(F.col("block_index").desc())
    first = F.min("block_index").over(Window.partitionBy("page_id", "path"))
    return (placed.withColumn("position", first).withColumn("_r", F.row_number().over(w))
            .where("_r = 1").drop("_r").withColumn("name", P.base_name("path")))


def directories(files: DataFrame, key: str = "project_id") -> DataFrame:
    """All proper path prefixes, once each."""
    return files.select(key, F.explode(P.ancestors("path")).alias("directory")).distinct()


def ingest_defaults(raw: DataFrame) -> DataFrame:
    """Derived defaults of a batch of new files (name, directory, counts, order of arrival in the batch)."""
    from codeloom.functions.text import default, line_count
    path = default("path", default("name", F.concat(F.lit("file_"), F.col("position").cast("string"), F.lit(".txt"))))
    content = default("content", "")
    return raw.select(
        "project_id", path.alias("path"), default("name", P.base_name(F.coalesce("path", F.lit("")))).alias("name"),
        P.directory(F.coalesce("path", F.lit(""))).alias("directory"), default("language", "text").alias("language"),
        content.alias("content"), line_count(content).alias("line_count"), F.length(content).alias("size"),
        F.col("position").alias("order"))


def refine_names(files: DataFrame) -> DataFrame:
    """Refined name, confidence and reasons of every file; signals are columns of their own."""
    s = R.signals(F.col("content"), F.col("language"))
    sig = F.struct(*[s[k].alias(k) for k in [*R.SIGNALS, *R.CARRIED]])
    rows = computed(files, signals=sig)
    name, confidence, reason = R.propose(F.col("signals"), F.col("language"), F.col("file_name"))
    empty = F.coalesce(F.col("content"), F.lit("")) == ""
    return rows.select(
        *files.columns, "signals", F.when(empty, F.col("file_name")).otherwise(name).alias("refined_name"),
        F.when(empty, F.lit(0.0)).otherwise(confidence).alias("confidence"),
        F.when(empty, F.lit("No content to analyze")).otherwise(reason).alias("reason"))


def normalised_arrivals(blocks: DataFrame, now) -> DataFrame:
    """Files of arriving blocks with placeholder names and fallbacks for the fields left open."""
    from codeloom.functions.text import default, line_count
    name = default("file_name", F.concat(F.lit("file_"), F.col("block_id").cast("string"), F.lit(".txt")))
    content = default("content", "")
    return blocks.select(
        "block_id", name.alias("file_name"), default("path", name).alias("path"), content.alias("content"),
        F.coalesce(F.when(F.col("language") != "", F.col("language")), G.from_content(content)).alias("language"),
        F.length(content).alias("size"), line_count(content).alias("lines"), default("source", "live_scan").alias("source"),
        F.coalesce("ts", now).alias("ts"))
