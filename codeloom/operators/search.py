"""Ranked search over projects and files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import paths as P
from codeloom.functions.text import computed, occurrences

# --- fixed values: score of each kind of match -----------------------------------------
FIELD_SCORES = [("name", 100), ("path", 50), ("source_url", 30), ("page_title", 40), ("source_site", 25)]
NAME_EQUAL, TAG, LANGUAGE, TOKEN, CONTENT, FAVORITE = 200, 60, 40, 5, 20, 10
TOKEN_HIT, TOKEN_CAP = 2, 30
FILE_SCORES = [("name", 100), ("path", 70), ("directory", 40), ("language", 50)]
FILE_CONTENT, FILE_EARLY, EARLY_CHARS = 30, 20, 100

COLUMNS = ["key", "type", "project_id", "name", "path", "directory", "language", "languages", "tags", "source_url", "page_title",
           "source_site", "content", "size", "created_at", "is_favorite", "search_text"]


def search_table(projects: DataFrame, files: DataFrame) -> DataFrame:
    """One row per project and per file with lower-cased text; write it as Parquet to search repeatedly."""
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    p = projects.select(
        F.concat(F.lit("project_"), F.col("project_id").cast("string")).alias("key"), F.lit("project").alias("type"),
        F.col("project_id").cast("string").alias("project_id"), "name", none.alias("path"), none.alias("directory"),
        none.alias("language"), "languages", "tags", "source_url", "page_title", "source_site", none.alias("content"),
        F.col("total_size").cast("bigint").alias("size"), "created_at", "is_favorite",
        F.lower(F.concat_ws(" ", "name", "source_url", "page_title", "source_site", "languages", "tags")).alias("search_text"))
    name, folder = P.base_name("path"), P.directory("path")
    f = files.select(
        F.concat(F.lit("file_"), F.col("file_id").cast("string")).alias("key"), F.lit("file").alias("type"),
        F.col("project_id").cast("string").alias("project_id"), name.alias("name"), "path", folder.alias("directory"), "language",
        empty.alias("languages"), empty.alias("tags"), none.alias("source_url"), none.alias("page_title"), none.alias("source_site"),
        "content", F.length("content").cast("bigint").alias("size"), F.col("ts").alias("created_at"), F.lit(False).alias("is_favorite"),
        F.lower(F.concat_ws(" ", name, "path", folder, "language", "content")).alias("search_text"))
    return p.unionByName(f)


def tokens(query: str) -> list[str]:
    return [x for x in re.split(r"[\s_-]+", query.lower()) if len(x) > 1]


def token_column(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"[\s_-]+"), lambda x: F.length(x) > 1)


def _points(test: Column, points: int) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(points)).otherwise(F.lit(0))


def relevance(query: str, now: Column) -> Column:
    """Score of a row with its lower-cased ``content_text``; recency only counts for rows that match at all."""
    low = query.lower().strip()
    parts = [_points(F.lower(c).contains(low), n) for c, n in FIELD_SCORES]
    parts.append(_points(F.lower("name") == low, NAME_EQUAL))
    for c, n in (("tags", TAG), ("languages", LANGUAGE)):
        parts.append(F.size(F.filter(c, lambda x: F.lower(x).contains(low))) * n)
    text = F.col("content_text")
    parts.append(_points(text.contains(low), CONTENT))
    for t in tokens(query):
        parts.append(_points(F.col("search_text").contains(t), TOKEN))
        parts.append(F.least(F.coalesce(occurrences(text, t), F.lit(0)) * TOKEN_HIT, F.lit(TOKEN_CAP)))  # ``least`` skips nulls
    parts.append(_points(F.col("is_favorite"), FAVORITE))
    base = reduce(lambda a, b: a + b, parts)
    matched = reduce(lambda a, b: a + b, parts[:-1])
    days = (F.unix_micros(now) - F.unix_micros("created_at")) / 86_400_000_000
    recency = F.greatest(F.lit(0.0), F.lit(10.0) - days / 30)
    return F.when(matched > 0, base + recency).otherwise(F.lit(0.0))


SORTS = {"relevance": lambda: [F.col("score").desc()], "name": lambda: [F.col("name")],
         "date": lambda: [F.col("created_at").desc()], "size": lambda: [F.col("size").desc()]}


def matches(table: DataFrame, query: str, now: Column, type: str | None = None, language: str | None = None,
            favorite: bool | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """All rows with a positive score; filters come first and reach the scan."""
    out = table
    if type is not None:
        out = out.where(F.col("type") == type)
    if language is not None:
        out = out.where(F.col("language") == language)
    if favorite is not None:
        out = out.where(F.col("is_favorite") == favorite)
    if since is not None:
        out = out.where(F.col("created_at") >= since)
    if until is not None:
        out = out.where(F.col("created_at") <= until)
    out = computed(out, content_text=F.lower("content"))
    return computed(out, score=relevance(query, now)).where("score > 0").drop("content_text")


def search(table: DataFrame, query: str, now: Column, sort: str = "relevance", offset: int = 0, limit: int = 50, **filters) -> DataFrame:
    """One page of hits, a top-k plan; ties are broken by key."""
    return matches(table, query, now, **filters).orderBy(*SORTS[sort](), F.col("key")).offset(offset).limit(limit)


def file_relevance(query: str) -> Column:
    low = query.lower().strip()
    parts = [_points(F.lower(c).contains(low), n) for c, n in FILE_SCORES]
    parts.append(_points(F.lower("name") == low, NAME_EQUAL))
    at = F.instr(F.lower("content"), low)
    parts += [_points(at > 0, FILE_CONTENT), _points((at > 0) & (at <= EARLY_CHARS), FILE_EARLY)]
    return reduce(lambda a, b: a + b, parts)


def snippet(query: str, width: int = 200) -> Column:
    """Text around the first hit with ellipses, or the first ``width`` characters."""
    low = query.lower().strip()
    at = F.instr(F.lower("content"), low) - 1
    start = F.greatest(F.lit(0), at - 50)
    end = F.least(F.length("content"), at + len(low) + width - 50)
    cut = F.substring(F.col("content"), start + 1, end - start)
    return F.when(at < 0, F.substring(F.col("content"), 1, width)).otherwise(F.concat(
        F.when(start > 0, F.lit("...")).otherwise(F.lit("")), cut, F.when(end < F.length("content"), F.lit("...")).otherwise(F.lit(""))))


def search_files(table: DataFrame, query: str, project: str | None = None) -> DataFrame:
    out = table.where("type = 'file'")
    if project is not None:
        out = out.where(F.col("project_id") == project)
    return out.withColumn("score", file_relevance(query)).where("score > 0").withColumn("snippet", snippet(query))


def suggestions(table: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    described = F.when(F.col("type") == "project", F.lit("Project")).otherwise(F.coalesce("language", F.lit("File")))
    return (table.where(F.startswith(F.lower("name"), F.lit(prefix.lower()))).orderBy("name", "key").limit(limit)
            .select("key", "type", F.col("name").alias("text"), described.alias("description")))


def by_language(table: DataFrame, language: str) -> DataFrame:
    return table.where((F.col("type") == "file") & (F.col("language") == language.lower()))


def by_tag(table: DataFrame, tag: str) -> DataFrame:
    """Case-insensitive on both sides."""
    return table.where((F.col("type") == "project") & F.exists("tags", lambda x: F.lower(x) == tag.lower()))


def popular_languages(table: DataFrame) -> DataFrame:
    return table.where("type = 'file' AND language IS NOT NULL").groupBy("language").agg(F.count("*").alias("count"))


def corpus_statistics(table: DataFrame) -> DataFrame:
    per = table.groupBy("type", "language").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    is_file = F.col("type") == "file"
    return per.agg(
        F.sum("n").alias("total_indexed"), F.sum(F.when(~is_file, F.col("n")).otherwise(0)).alias("project_count"),
        F.sum(F.when(is_file, F.col("n")).otherwise(0)).alias("file_count"),
        F.sum(F.when(is_file, F.col("size")).otherwise(0)).alias("total_size"),
        F.count_distinct(F.when(is_file, F.col("language"))).alias("unique_languages"))
