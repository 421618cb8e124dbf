"""Exports as text tables: documents in ordered parts, assembled file sets, transcripts.

A document of a project is a set of rows ``section, sort_key, text``; in that order they are
its text. Nothing gathers a project, so one of any size can be exported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import html as H
from codeloom.functions.text import default, line_count, strip
from codeloom.operators.dependencies import manifest_lines
from codeloom.operators.trees import drawn_tree
from codeloom.rules import scaffolding as S

PART = ["project_id", "path", "section", "sort_key", "text"]


def _part(df: DataFrame, path: str, section: int, sort_key: Column | str, text: Column) -> DataFrame:
    return df.select("project_id", F.lit(path).alias("path"), F.lit(section).alias("section"),
                     (F.lit(sort_key) if isinstance(sort_key, str) else sort_key).alias("sort_key"), text.alias("text"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _arrival(c: str = "file_id") -> Column:
    return F.lpad(F.col(c).cast("string"), 19, "0")


def _by_path() -> Column:
    return F.concat(F.lower("path"), F.lit("\u0001"), _arrival())


def markdown_parts(files: DataFrame) -> DataFrame:
    """One markdown document per project: counts, sorted paths, files in alphabetical order."""
    totals = files.groupBy("project_id").agg(F.count("*").alias("n"), F.sum(line_count("content")).alias("lines"))
    head = F.concat(F.lit("# "), F.col("project_id"), F.lit("\n\n## Project Statistics\n- **Files:** "), F.col("n").cast("string"),
                    F.lit("\n- **Total Lines:** "), F.col("lines").cast("string"), F.lit("\n\n## Project Structure\n\n```text\n"))
    body = F.concat(F.lit("### `"), "path", F.lit("`\n\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), strip("content"), F.lit("\n```\n\n"))
    doc = "project.md"
    return _union([
        _part(totals, doc, 0, "", head),
        _part(files, doc, 1, F.concat("path", F.lit("\u0001"), _arrival()), F.concat(F.lit("  "), "path", F.lit("\n"))),
        _part(totals, doc, 2, "", F.lit("```\n\n## Files\n\n")),
        _part(files, doc, 3, _by_path(), body)])


def html_parts(files: DataFrame) -> DataFrame:
    """One HTML document per project, files in order of arrival, contents escaped."""
    projects = files.select("project_id").distinct()
    doc, name = "project.html", H.escape("project_id")
    return _union([
        _part(projects, doc, 0, "", F.concat(F.lit("<!DOCTYPE html><html><head><title>"), name, F.lit("</title></head><body><h1>"), name,
                                             F.lit("</h1><h2>Files Index</h2><ul>"))),
        _part(files, doc, 1, _arrival(), F.concat(F.lit("<li>"), H.escape("path"), F.lit("</li>"))),
        _part(projects, doc, 2, "", F.lit("</ul>")),
        _part(files, doc, 3, _arrival(), F.concat(
            F.lit('<div class="file-header"><h3>'), H.escape("path"), F.lit("</h3></div><pre><code>"), H.escape("content"), F.lit("</code></pre>"))),
        _part(projects, doc, 4, "", F.lit("</body></html>"))])


def readme_parts(files: DataFrame) -> DataFrame:
    """README per project: tree, file table, languages, set-up notes by language."""
    doc = "README.md"
    sized = files.select("project_id", "path", "file_id", default("language", "text").alias("language"), line_count("content").alias("lines"))
    projects = sized.select("project_id").distinct()
    languages = sized.groupBy("project_id", "language").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"))
    notes = [(title, "### " + title + "\n```bash\n" + "\n".join(rows) + "\n```\n\n", [k for k, v in S.SETUP.items() if v[0] == title])
             for title, rows in dict.fromkeys((v[0], tuple(v[1])) for v in S.SETUP.values())]
    order = F.when(F.lit(False), F.lit(0))
    text = F.when(F.lit(False), F.lit(""))
    for i, (_, note, langs) in enumerate(notes):
        order = order.when(F.col("language").isin(*langs), F.lit(i))
        text = text.when(F.col("language").isin(*langs), F.lit(note))
    known = languages.select("project_id", order.alias("i"), text.alias("text")).where("i IS NOT NULL").distinct()
    generic = projects.join(known.select("project_id"), "project_id", "left_anti")
    row = F.concat(F.lit("| `"), "path", F.lit("` | "), "language", F.lit(" | "), F.col("lines").cast("string"), F.lit(" |\n"))
    lang_row = F.concat(F.lit("- **"), "language", F.lit("**: "), F.col("n").cast("string"), F.lit(" files, "), F.col("lines").cast("string"), F.lit(" lines\n"))
    return _union([
        _part(projects, doc, 0, "", F.concat(F.lit("# "), F.col("project_id"), F.lit("\n\n## Project Structure\n\n```\n"))),
        _part(drawn_tree(files.select("project_id", "path", "file_id")), doc, 1, F.col("sort_key"), F.concat("line", F.lit("\n"))),
        _part(projects, doc, 2, "", F.lit("```\n\n## Files Overview\n\n| File | Language | Lines |\n|------|----------|-------|\n")),
        _part(sized, doc, 3, _arrival(), row),
        _part(projects, doc, 4, "", F.lit("\n## Languages Used\n\n")),
        _part(languages, doc, 5, F.col("language"), lang_row),
        _part(projects, doc, 6, "", F.lit("\n## Getting Started\n\n")),
        _part(known, doc, 7, F.col("i").cast("string"), F.col("text")),
        _part(generic, doc, 7, "", F.lit("Open the project files in your preferred editor and review the code.\n"))])


def ignore_parts(files: DataFrame) -> DataFrame:
    """Ignore list per project from its language set, languages in alphabetical order."""
    doc = ".gitignore"
    languages = files.select("project_id", "language").distinct()
    texts = F.create_map(*[F.lit(x) for k, rows in S.IGNORE_BY_LANGUAGE.items() for x in (k, "\n".join(rows) + "\n\n")])
    own = languages.withColumn("text", F.element_at(texts, F.col("language"))).where("text IS NOT NULL")
    projects = languages.select("project_id").distinct()
    plain = projects.join(own.select("project_id"), "project_id", "left_anti")

    def block(rows):
        return F.lit("\n".join(rows) + "\n")

    return _union([
        _part(projects, doc, 0, "", block(S.IGNORE_HEAD)),
        _part(own, doc, 1, F.col("language"), F.col("text")),
        _part(plain, doc, 1, "", block([*S.IGNORE_GENERIC, ""])),
        _part(projects, doc, 2, "", block(S.IGNORE_TAIL))])


def transcript_lines(messages: DataFrame) -> DataFrame:
    """``- author: text`` per turn; the lines of a conversation in turn order are its transcript."""
    author = F.when(F.col("role") == "user", F.lit("User")).when(F.col("role") == "assistant", F.lit("Assistant")).otherwise(F.lit("Unknown"))
    return messages.select("conv_id", "turn", F.concat(F.lit("- "), author, F.lit(": "), "text").alias("line"))


def assembled(files: DataFrame, deps: DataFrame, mains: DataFrame) -> DataFrame:
    """Mapped files and generated files (README, ignore list, manifests) of every project, in parts."""
    own = files.select("project_id", "path", F.lit(0).alias("section"), _arrival().alias("sort_key"), F.col("content").alias("text"))
    generated = _union([readme_parts(files), ignore_parts(files), manifest_lines(deps, mains).select(
        "project_id", "path", "section", "sort_key", F.concat("line", F.lit("\n")).alias("text"))])
    return own.withColumn("auto_generated", F.lit(False)).unionByName(generated.withColumn("auto_generated", F.lit(True)))


def manifest(files: DataFrame) -> DataFrame:
    """What a project export holds: number of files and total size."""
    return files.groupBy("project_id").agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("size"))
