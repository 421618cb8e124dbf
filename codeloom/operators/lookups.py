"""Filters, lookups, paging and quality gates over the stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions import paths as P
from codeloom.functions.text import strip
from codeloom.rules.languages import VALID_LANGUAGES


def list_projects(projects: DataFrame, site: str | None = None, language: str | None = None,
                  favorite: bool | None = None) -> DataFrame:
    """All matching projects; page the result with :func:`page`."""
    out = projects
    if site is not None:
        out = out.where(F.col("source_site") == site)
    if language is not None:
        out = out.where(F.array_contains("languages", language))
    if favorite:
        out = out.where("is_favorite")
    return out


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of an ordered listing; Spark plans it as a top-(offset + limit)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_more(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 20) -> DataFrame:
    """A page whose rows carry ``has_more``: one row beyond the page is looked at, never the rest."""
    ahead = df.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = ahead.withColumn("row", F.row_number().over(Window.orderBy(*order)))  # limit + 1 rows at most
    return numbered.withColumn("has_more", F.max("row").over(Window.partitionBy()) > limit).where(F.col("row") <= limit)


def search_projects(projects: DataFrame, query: str) -> DataFrame:
    low = query.lower()
    test = F.exists("tags", lambda x: F.lower(x).contains(low)) | F.exists("languages", lambda x: F.lower(x).contains(low))
    for c in ("name", "source_url", "page_title"):
        test = test | F.coalesce(F.lower(c).contains(low), F.lit(False))
    return projects.where(test)


def search_files(files: DataFrame, query: str, project: str | None = None) -> DataFrame:
    low = query.lower()
    test = F.lit(False)
    for c in ("path", "language", "content"):
        test = test | F.coalesce(F.lower(c).contains(low), F.lit(False))
    out = files if project is None else files.where(F.col("project_id") == project)
    return out.where(test)


def by_index(df: DataFrame, **values) -> DataFrame:
    """Equality on scalar columns, membership on array columns, all combined."""
    kinds = dict(df.dtypes)
    out = df
    for name, value in values.items():
        out = out.where(F.array_contains(name, value) if kinds[name].startswith("array") else F.col(name) == F.lit(value))
    return out


def by_range(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def cascade_delete(projects: DataFrame, children: DataFrame, before: Column) -> tuple[DataFrame, DataFrame]:
    """Projects created at or after ``before``, and the children of those."""
    gone = projects.where(F.col("created_at") < before).select("project_id")
    return projects.where(F.col("created_at") >= before), children.join(gone, "project_id", "left_anti")


def newest_per_user(history: DataFrame, limit: int) -> DataFrame:
    """Newest ``limit`` entries per user, newest first; the rank filter is pushed below the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("entry_id").desc())
    return history.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def export_set(files: DataFrame, extensions: list[str]) -> DataFrame:
    return files.where(P.export_extension("path").isin(*extensions))


def reordered(files: DataFrame, order: DataFrame) -> DataFrame:
    """Positions taken from the rows of ``order`` (project_id, file_id, place); files not listed keep theirs."""
    places = order.select("project_id", "file_id", F.col("place").cast("bigint").alias("_place"))
    return files.join(places, ["project_id", "file_id"], "left").withColumn("position", F.coalesce("_place", F.col("position").cast("bigint"))).drop("_place")


def valid_code(code: Column | str) -> Column:
    return F.coalesce(F.length(strip(code)) >= 3, F.lit(False))


def quality_gate(files: DataFrame) -> DataFrame:
    """Validity of each record by field."""
    return files.select(
        "file_id", P.valid_path("path").alias("valid_path"), P.valid_file_name(P.base_name("path")).alias("valid_name"),
        F.lower("language").isin(*VALID_LANGUAGES).alias("valid_language"),
        P.valid_project_name("project_id").alias("valid_project"), valid_code("content").alias("valid_code"))


def structure_findings(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Errors (no files, bad path) and warnings (repeated path, empty content) per project.

    The repeat count is an aggregate joined back on its group key, not a window over the group.
    """
    repeats = (files.groupBy("project_id", "path").agg(F.count("*").alias("n"), F.min("file_id").alias("first"))
               .where("n > 1").withColumnRenamed("project_id", "r_project").withColumnRenamed("path", "r_path"))
    flagged = files.join(repeats, (F.col("project_id") == F.col("r_project")) & (F.col("path") == F.col("r_path")), "left")
    quoted = F.concat(F.lit('"'), F.col("path"), F.lit('"'))
    checks = F.array(
        F.when(~P.valid_path("path"), F.struct(F.lit("error").alias("severity"),
                                               F.concat(F.lit("Invalid file path: "), quoted).alias("message"))),
        F.when(F.col("n").isNotNull() & (F.col("file_id") > F.col("first")),
               F.struct(F.lit("warning").alias("severity"), F.concat(F.lit("Duplicate file path: "), quoted).alias("message"))),
        F.when(~valid_code("content"), F.struct(F.lit("warning").alias("severity"), F.concat(
            F.lit("Empty or invalid content in: "), quoted).alias("message"))))
    found = flagged.select("project_id", "file_id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("c")).select(
        "project_id", "file_id", "c.*")
    empty = projects.select("project_id").join(files.select("project_id"), "project_id", "left_anti").select(
        "project_id", F.lit(None).cast("bigint").alias("file_id"), F.lit("error").alias("severity"),
        F.lit("Project has no files").alias("message"))
    return found.unionByName(empty)


def project_with_files(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Projects with their files in order, one row per file (projects without files keep one row).

    Nesting is left to the sink: a project may hold more files than one row should.
    """
    f = files.select(F.col("project_id").alias("f_project"), "file_id", "path", "position")
    return projects.join(f, F.col("project_id") == F.col("f_project"), "left").drop("f_project")


def nested_files(joined: DataFrame, per_row: int = 10_000) -> DataFrame:
    """``files`` array per project and page of ``per_row`` positions, counted from 0; projects without files have page 0."""
    page = F.coalesce(F.floor(F.col("position") / per_row), F.lit(0)).alias("page")
    entry = F.when(F.col("file_id").isNotNull(), F.struct("position", "file_id", "path"))
    return joined.groupBy("project_id", page).agg(
        F.array_sort(F.collect_list(entry)).alias("files"))


def row_counts(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
