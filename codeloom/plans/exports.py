"""Queries: exports, snapshots, generated files."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import dependencies as D, exports as E
from codeloom.plans import analytics

from codeloom.plans.registry import query
from codeloom.plans.sqltext import escaped, q, sql, strip
from codeloom.rules import scaffolding as S
from codeloom.session import cut_lineage
from codeloom.sources import snapshots as SN, views as V


def stored(t):
    """The files as a table at rest: documents read it several times over."""
    return cut_lineage(analytics.stored(t).select("project_id", "file_id", "path", "language", "content", "position"))


NL = "chr(10)"


def _lit(text: str) -> str:
    return q(text)


_KEY = "lpad(CAST(file_id AS VARCHAR), 19, '0')"


def _part(path: str, section: int, sort_key: str, text: str, source: str) -> str:
    """One section of a document, a row for each row of ``source``."""
    return f"SELECT project_id, {q(path)} AS path, CAST({section} AS BIGINT) AS section, {sort_key} AS sort_key, {text} AS text FROM {source}"


@query("e1_markdown_documents", sql(" UNION ALL ".join([
    _part("project.md", 0, "''", f"""'# ' || project_id || {_lit(chr(10) * 2 + '## Project Statistics' + chr(10) + '- **Files:** ')} || CAST(count(*) AS VARCHAR)
  || {_lit(chr(10) + '- **Total Lines:** ')} || CAST(CAST(sum(len(string_split(content, {NL}))) AS BIGINT) AS VARCHAR) || {_lit(chr(10) * 2 + '## Project Structure' + chr(10) * 2 + '```text' + chr(10))}""",
          "stored GROUP BY project_id"),
    _part("project.md", 1, f"path || chr(1) || {_KEY}", f"'  ' || path || {NL}", "stored"),
    _part("project.md", 2, "''", _lit('```' + chr(10) * 2 + '## Files' + chr(10) * 2), "(SELECT DISTINCT project_id FROM stored)"),
    _part("project.md", 3, f"lower(path) || chr(1) || {_KEY}", f"'### `' || path || '`' || {NL} || {NL} || '```' || language || {NL} || {strip('content')} || {NL} || '```' || {NL} || {NL}", "stored")]), "stored"))
def markdown(t):
    return E.markdown_parts(stored(t))


@query("e1_html_documents", sql(" UNION ALL ".join([
    _part("project.html", 0, "''", "'<!DOCTYPE html><html><head><title>' || project_id || '</title></head><body><h1>' || project_id || '</h1><h2>Files Index</h2><ul>'", "(SELECT DISTINCT project_id FROM stored)"),
    _part("project.html", 1, _KEY, f"'<li>' || {escaped('path')} || '</li>'", "stored"),
    _part("project.html", 2, "''", "'</ul>'", "(SELECT DISTINCT project_id FROM stored)"),
    _part("project.html", 3, _KEY, f"""'<div class="file-header"><h3>' || {escaped('path')} || '</h3></div><pre><code>' || {escaped('content')} || '</code></pre>'""", "stored"),
    _part("project.html", 4, "''", "'</body></html>'", "(SELECT DISTINCT project_id FROM stored)")]), "stored"))
def html(t):
    return E.html_parts(stored(t))


_titles = list(dict.fromkeys((v[0], tuple(v[1])) for v in S.SETUP.values()))
_setup = ", ".join(f"({q(k)}, {i}, {q('### ' + v[0] + chr(10) + '```bash' + chr(10) + chr(10).join(v[1]) + chr(10) + '```' + chr(10) * 2)})"
                   for k, v in S.SETUP.items() for i in [_titles.index((v[0], tuple(v[1])))])
_LINE = """array_to_string(list_transform(lasts[1:len(lasts) - 1], lambda b: CASE WHEN b THEN '    ' ELSE '│   ' END), '')
  || CASE WHEN lasts[-1] THEN '└── ' ELSE '├── ' END || string_split(node, '/')[-1] || CASE WHEN is_dir THEN '/' ELSE '' END"""


_TREE_KEY = "array_to_string(list_transform(keys, lambda k: lpad(CAST(k[1] AS VARCHAR), 19, '0') || k[2]), chr(1))"
_PROJECTS = "(SELECT DISTINCT project_id FROM stored)"
_LANGUAGES = f"(SELECT project_id, language, count(*) AS n, CAST(sum(len(string_split(content, {NL}))) AS BIGINT) AS lines FROM stored GROUP BY ALL)"
_NOTES = f"(SELECT DISTINCT project_id, i, note FROM stored s JOIN (VALUES {_setup}) v(language, i, note) ON v.language = s.language)"


@query("e2_readme_documents", sql(" UNION ALL ".join([
    _part("README.md", 0, "''", f"'# ' || project_id || {_lit(chr(10) * 2 + '## Project Structure' + chr(10) * 2 + '```' + chr(10))}", _PROJECTS),
    _part("README.md", 1, _TREE_KEY, f"{_LINE} || {NL}", "drawn"),
    _part("README.md", 2, "''", _lit('```' + chr(10) * 2 + '## Files Overview' + chr(10) * 2 + '| File | Language | Lines |' + chr(10) + '|------|----------|-------|' + chr(10)), _PROJECTS),
    _part("README.md", 3, _KEY, f"'| `' || path || '` | ' || language || ' | ' || CAST(len(string_split(content, {NL})) AS VARCHAR) || ' |' || {NL}", "stored"),
    _part("README.md", 4, "''", _lit(chr(10) + '## Languages Used' + chr(10) * 2), _PROJECTS),
    _part("README.md", 5, "language", f"'- **' || language || '**: ' || CAST(n AS VARCHAR) || ' files, ' || CAST(lines AS VARCHAR) || ' lines' || {NL}", _LANGUAGES),
    _part("README.md", 6, "''", _lit(chr(10) + '## Getting Started' + chr(10) * 2), _PROJECTS),
    _part("README.md", 7, "CAST(i AS VARCHAR)", "note", _NOTES),
    _part("README.md", 7, "''", _lit('Open the project files in your preferred editor and review the code.' + chr(10)),
          f"{_PROJECTS} WHERE project_id NOT IN (SELECT project_id FROM {_NOTES})")]), "drawn"))
def readme(t):
    return E.readme_parts(stored(t))


_ign = ", ".join(f"({q(k)}, {q(chr(10).join(rows) + chr(10) * 2)})" for k, rows in S.IGNORE_BY_LANGUAGE.items())


_OWN = f"(SELECT DISTINCT project_id, s.language, v.text AS own FROM stored s JOIN (VALUES {_ign}) v(language, text) ON v.language = s.language)"


@query("e3_ignore_lists", sql(" UNION ALL ".join([
    _part(".gitignore", 0, "''", _lit(chr(10).join(S.IGNORE_HEAD) + chr(10)), _PROJECTS),
    _part(".gitignore", 1, "language", "own", _OWN),
    _part(".gitignore", 1, "''", _lit(chr(10).join([*S.IGNORE_GENERIC, '']) + chr(10)), f"{_PROJECTS} WHERE project_id NOT IN (SELECT project_id FROM {_OWN})"),
    _part(".gitignore", 2, "''", _lit(chr(10).join(S.IGNORE_TAIL) + chr(10)), _PROJECTS)]), "stored"))
def ignore_lists(t):
    return E.ignore_parts(stored(t))


@query("e5_transcript_lines", """
SELECT conv_id, turn, '- ' || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'Unknown' END || ': ' || text AS line FROM conversations""")
def transcripts(t):
    return E.transcript_lines(t("conversations"))


@query("u5_assembled_files", sql(f"""
SELECT project_id, path, false AS auto_generated, CAST(length(content) AS BIGINT) AS size FROM stored
UNION ALL SELECT DISTINCT project_id, '.gitignore', true, NULL FROM stored UNION ALL SELECT DISTINCT project_id, 'README.md', true, NULL FROM stored
UNION ALL SELECT DISTINCT project_id, CASE ecosystem WHEN 'python' THEN 'requirements.txt' WHEN 'node' THEN 'package.json' WHEN 'go' THEN 'go.mod' ELSE 'pom-dependencies.xml' END, true, NULL
FROM dependencies""", "dependencies"))
def assembled(t):
    s = stored(t)
    parts = E.assembled(s, D.dependencies(s), D.main_files(s))
    key = F.when(F.col("auto_generated"), F.lit("")).otherwise(F.col("sort_key"))
    sized = parts.groupBy("project_id", "path", "auto_generated", key.alias("k")).agg(F.sum(F.length("text")).alias("size"))
    return sized.select("project_id", "path", "auto_generated", F.when(~F.col("auto_generated"), F.col("size")).alias("size"))


@query("s12_snapshot_records", sql("""
SELECT kind, id, project_id, path, language, content FROM (
  SELECT 'file' AS kind, CAST(file_id AS VARCHAR) AS id, project_id, path, language, content FROM files
  UNION ALL SELECT DISTINCT 'project', project_id, project_id, NULL, NULL, NULL FROM files)
WHERE project_id IN (SELECT 'src' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey < 2)""", "files"))
def snapshot(t):
    """Written as JSON lines and read back."""
    chosen = t("nation").where("n_regionkey < 2").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("project_id"))
    return SN.parse_lines(SN.to_lines(SN.snapshot_records(V.files(t), chosen))).drop(SN.CORRUPT)


@query("s12_snapshot_header", sql("""
SELECT '1.0.0' AS version, count(DISTINCT project_id) AS projects, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS size FROM files""", "files"))
def snapshot_header(t):
    return SN.snapshot_header(SN.snapshot_records(V.files(t)))


def _damaged(t):
    """Snapshot lines as they may arrive: whole, cut short, without id, without project."""
    f = V.files(t).withColumn("lines", F.size(F.split("content", "\n")))
    whole = F.to_json(F.struct(
        F.lit("file").alias("kind"), F.when(F.col("lines") != 2, F.col("file_id").cast("string")).alias("id"),
        F.when(F.col("lines") != 3, F.col("project_id")).alias("project_id"), "path", "language", F.concat("content", F.lit("!")).alias("content")))
    return f.select(F.when(F.col("lines") == 4, F.concat(F.lit('{"kind": "file", "id": '), whole)).otherwise(whole).alias("value"))


_LINES = "d AS (SELECT *, len(string_split(content, chr(10))) AS n FROM files)"


@query("s13_imported_files", sql(f"""
WITH {_LINES} SELECT CAST(file_id AS VARCHAR) AS id, project_id, path, CASE WHEN n IN (2, 3, 4) THEN content ELSE content || '!' END AS content, n NOT IN (2, 3, 4) AS imported
FROM d WHERE n NOT IN (2, 3, 4) OR file_id IN (SELECT doc_id FROM labels)""", "files"))
def imported(t):
    there = V.files(t).join(t("labels").select(F.col("doc_id").alias("file_id")), "file_id", "left_semi").withColumn("id", F.col("file_id").cast("string"))
    return SN.upsert(there, SN.parse_lines(_damaged(t))).select("id", "project_id", "path", "content", "imported")


@query("s13_import_counts", sql(f"WITH {_LINES} SELECT CAST(0 AS BIGINT) AS projects_imported, count(*) AS files_imported FROM d WHERE n NOT IN (2, 3, 4)", "files"))
def import_counts(t):
    return SN.import_counts(SN.parse_lines(_damaged(t)))


@query("s14_import_errors", sql(f"""
WITH {_LINES} SELECT CASE n WHEN 2 THEN 'File missing id' WHEN 3 THEN 'File missing projectId' ELSE 'malformed record' END AS error, count(*) AS rows
FROM d WHERE n IN (2, 3, 4) GROUP BY 1""", "files"))
def import_errors(t):
    return SN.validation_errors(SN.parse_lines(_damaged(t))).groupBy("error").agg(F.count("*").alias("rows"))


@query("s15_export_manifest", sql("SELECT project_id, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS size FROM stored GROUP BY project_id", "stored"))
def export_manifest(t):
    return E.manifest(stored(t))
