"""Corpus statistics, trends and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import metrics as M, paths as P
from codeloom.functions.text import line_count


def file_metrics(files: DataFrame) -> DataFrame:
    """Per-file lines, bytes and line metrics; a map-only job."""
    return files.select(
        "project_id", "file_id", "path", F.lower(F.coalesce("language", F.lit("text"))).alias("language"), "ts",
        line_count("content").alias("lines"), F.octet_length("content").alias("bytes"),
        M.functions("content").alias("functions"), M.classes("content").alias("classes"),
        M.imports("content").alias("imports"), M.comment_lines("content", "language").alias("comment_lines"),
        M.blank_lines("content").alias("blank_lines"))


def _percent(part: Column, whole: Column) -> Column:
    return F.round(part / whole * 100).cast("bigint")


def project_statistics(m: DataFrame) -> DataFrame:
    g = m.groupBy("project_id").agg(
        F.count("*").alias("total_files"), *[F.sum(c).alias(f"total_{c}") for c in (
            "lines", "bytes", "functions", "classes", "imports", "comment_lines", "blank_lines")])
    return g.withColumn("comment_ratio", _percent(F.col("total_comment_lines"), F.col("total_lines"))).withColumn(
        "blank_ratio", _percent(F.col("total_blank_lines"), F.col("total_lines")))


def language_breakdown(m: DataFrame) -> DataFrame:
    return m.groupBy("project_id", "language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))


def extension_counts(files: DataFrame) -> DataFrame:
    ext = F.when(F.col("path").contains("."), F.lower(P.extension("path"))).otherwise(F.lit("no-extension"))
    return files.groupBy("project_id", ext.alias("extension")).agg(F.count("*").alias("files"))


def language_distribution(m: DataFrame) -> DataFrame:
    """Files, lines and distinct projects per language.

    Folded per (language, project) first, so the distinct count never shuffles file rows.
    """
    per = m.groupBy("language", "project_id").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    return per.groupBy("language").agg(F.sum("files").alias("files"), F.sum("lines").alias("lines"),
                                       F.count("*").alias("projects"))


def top_languages(m: DataFrame, n: int = 10) -> DataFrame:
    return language_distribution(m).orderBy(F.col("lines").desc(), "language").limit(n)


def overview(m: DataFrame) -> DataFrame:
    per = m.groupBy("project_id", "language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
    return per.agg(
        F.count_distinct("project_id").alias("total_projects"), F.sum("files").alias("total_files"),
        F.sum("lines").alias("total_lines"), F.sum("bytes").alias("total_bytes"),
        F.count_distinct("language").alias("languages")).withColumn(
        "average_files", F.round(F.col("total_files") / F.col("total_projects")).cast("bigint")).withColumn(
        "average_lines", F.round(F.col("total_lines") / F.col("total_projects")).cast("bigint"))


def project_sizes(m: DataFrame) -> DataFrame:
    return m.groupBy("project_id").agg(F.count("*").alias("files"), F.sum("bytes").alias("size"))


def productivity(o: DataFrame) -> DataFrame:
    """Score out of 100 from an overview row, with its parts; at most ten languages count."""
    projects = F.least(F.col("total_projects") * 10, F.lit(30))
    files = F.least(F.col("total_files") * 2, F.lit(25))
    lines = F.when(F.col("total_lines") > 0, F.least(F.log10("total_lines") * 15, F.lit(25.0))).otherwise(F.lit(0.0))
    languages = F.least(F.least("languages", F.lit(10)) * 5, F.lit(20))
    return o.select(projects.alias("projects_score"), files.alias("files_score"),
                    F.round(lines).cast("bigint").alias("lines_score"), languages.alias("languages_score"),
                    F.round(projects + files + lines + languages).cast("bigint").alias("score"))


def calendar(spark, last_day: str, days: int) -> DataFrame:
    """The ``days`` days ending at ``last_day``."""
    return spark.range(1).select(F.explode(F.sequence(
        F.date_sub(F.lit(last_day).cast("date"), days - 1), F.lit(last_day).cast("date"))).alias("day"))


def scan_history(m: DataFrame, last_day: str, days: int = 30) -> DataFrame:
    """Scans, files and lines per day, zero-filled. One project is one scan on each day it has files."""
    per = m.groupBy(F.to_date("ts").alias("d"), "project_id").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    daily = per.groupBy("d").agg(F.count("*").alias("scans"), F.sum("files").alias("files"), F.sum("lines").alias("lines"))
    # the calendar side is tiny and fixed; the daily side is one row per day
    return calendar(m.sparkSession, last_day, days).join(daily, F.col("day") == F.col("d"), "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("scans", "files", "lines")])


def language_trend(m: DataFrame, last_day: str, days: int = 30) -> DataFrame:
    """Files per day and language in long form; days without files keep a row without language."""
    daily = m.groupBy(F.to_date("ts").alias("d"), "language").agg(F.count("*").alias("files"))
    return calendar(m.sparkSession, last_day, days).join(daily, F.col("day") == F.col("d"), "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "language", F.coalesce("files", F.lit(0)).alias("files"))


def structure_summary(files: DataFrame) -> DataFrame:
    """Per project, per (project, language) and per (project, source) in one pass."""
    sized = files.select("project_id", "language", "source", F.length("content").alias("size"), line_count("content").alias("lines"))
    return sized.groupingSets(
        [[F.col("project_id"), F.col("language")], [F.col("project_id"), F.col("source")], [F.col("project_id")]],
        F.col("project_id"), F.col("language"), F.col("source")).agg(
        F.count("*").alias("files"), F.sum("size").alias("size"), F.sum("lines").alias("lines"))


def directory_counts(directories: DataFrame) -> DataFrame:
    return directories.groupBy("project_id").agg(F.count("*").alias("directories"))


def quick_stats(files: DataFrame) -> DataFrame:
    """Language counts with the overall row."""
    sized = files.select(F.coalesce("language", F.lit("unknown")).alias("language"), F.length("content").alias("size"),
                         line_count("content").alias("lines"))
    return sized.groupingSets([[F.col("language")], []], F.col("language")).agg(
        F.count("*").alias("files"), F.sum("size").alias("size"), F.sum("lines").alias("lines"))


def project_file_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("project_id").agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("size"))


def corpus_usage(files: DataFrame) -> DataFrame:
    per = files.groupBy("project_id").agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"))
    return per.agg(F.count("*").alias("projects"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def session_statistics(changes: DataFrame) -> DataFrame:
    """Per scan: distinct elements, changes by type, duration in seconds."""
    kinds = ("file_added", "file_updated", "file_removed", "conflict")
    return changes.groupBy("scan_id").agg(
        F.count("*").alias("changes"), *[F.count_if(F.col("type") == k).alias(k) for k in kinds],
        (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("duration"))


def session_elements(changes: DataFrame) -> DataFrame:
    return changes.select("scan_id", "element_id").distinct().groupBy("scan_id").agg(F.count("*").alias("elements"))


def scan_summary(blocks: DataFrame, files: DataFrame, trees: DataFrame) -> DataFrame:
    """Per page: blocks, distinct contents, duplicates, mapped files, trees, lines and size of the files."""
    per_text = blocks.groupBy("page_id", F.sha2("code", 256).alias("hash")).agg(F.count("*").alias("n"))
    b = per_text.groupBy("page_id").agg(F.sum("n").alias("total_blocks"), F.count("*").alias("unique_files"),
                                        (F.sum("n") - F.count("*")).alias("duplicates"))
    f = files.groupBy("page_id").agg(F.count("*").alias("total_files"), F.sum(F.length("content")).alias("total_size"),
                                     F.sum(line_count("content")).alias("total_lines"))
    t = trees.groupBy("page_id").agg(F.count("*").alias("trees"))
    return b.join(f, "page_id", "left").join(t, "page_id", "left").withColumn("trees", F.coalesce("trees", F.lit(0)))


# --- framework and tooling profile ----------------------------------------------------
# --- fixed values: language -> recommended editor extensions ---------------------------
EDITOR_EXTENSIONS = {
    "python": ["ms-python.python", "ms-python.vscode-pylance"],
    "javascript": ["dbaeumer.vscode-eslint", "esbenp.prettier-vscode"],
    "typescript": ["dbaeumer.vscode-eslint", "esbenp.prettier-vscode"],
    "html": ["ecmel.vscode-html-css"], "css": ["ecmel.vscode-html-css"],
    "markdown": ["yzhang.markdown-all-in-one"], "rust": ["rust-lang.rust-analyzer"], "go": ["golang.go"],
}
# --- fixed values: entry files a launch entry is made for ------------------------------
ENTRY_FILES = ["app.py", "main.py", "index.js", "app.js", "main.js", "main.ts"]


def frameworks(files: DataFrame) -> DataFrame:
    """Framework from file names, and the first entry file with its launcher."""
    low = F.lower("path")
    entry = F.when(low.isin(*ENTRY_FILES), F.col("path"))
    g = files.groupBy("project_id").agg(
        F.bool_or(low.contains("next.config")).alias("next"), F.bool_or(low.contains("vite.config")).alias("vite"),
        F.bool_or(low == "package.json").alias("node"),
        F.min_by(entry, F.when(entry.isNotNull(), F.struct("position", "file_id"))).alias("entry_file"))
    framework = (F.when(F.col("next"), F.lit("nextjs")).when(F.col("vite"), F.lit("vite")).when(F.col("node"), F.lit("nodejs")))
    launcher = F.when(F.col("entry_file").endswith(".py"), F.lit("python")).when(F.col("entry_file").isNotNull(), F.lit("node"))
    return g.select("project_id", framework.alias("framework"), "entry_file", launcher.alias("launcher"))


def recommended_extensions(files: DataFrame) -> DataFrame:
    pairs = [F.lit(x) if isinstance(x, str) else F.array(*[F.lit(e) for e in x]) for kv in EDITOR_EXTENSIONS.items() for x in kv]
    langs = files.select("project_id", "language").distinct()
    return langs.select("project_id", F.explode(F.element_at(F.create_map(*pairs), F.col("language"))).alias("extension")).distinct()
