"""Queries: lint and dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import dependencies as D, lint as L
from codeloom.operators.ranking import coarse_text, numbered
from codeloom.plans.analytics import stored
from codeloom.plans.naming import _norm
from codeloom.plans.registry import query
from codeloom.plans.sqltext import add_view, like, q, rx, sql, strip, sub
from codeloom.rules import dependencies as R
from codeloom.sources import views as V

# Lint input: blocks by normalised declared language, several files per language.
add_view("lint_files", f"SELECT block_id AS file_id, coalesce(nullif({_norm('language')}, ''), 'text') AS language, code AS content FROM code_blocks", ["code_blocks"])
add_view("lint_lines", "SELECT file_id, language, i AS line, content[i] AS t FROM (SELECT file_id, language, string_split(content, chr(10)) AS content FROM lint_files), "
                       "LATERAL (SELECT unnest(range(1, len(content) + 1)) AS i)", ["lint_files"])


def lint_files(t):
    from codeloom.functions.language import normalised
    from codeloom.functions.text import default
    return V.code_blocks(t).select(F.col("block_id").alias("file_id"), default(normalised("language"), "text").alias("language"), F.col("code").alias("content"))


def _n(c: str) -> str:
    return f"(length(content) - length(replace(content, {q(c)}, '')))"


def _row(severity: str, message: str, where: str, line: str = "line") -> str:
    src = "lint_lines" if line == "line" else "lint_files"
    return f"SELECT file_id, language, '{severity}' AS severity, {message} AS message, {line} AS line FROM {src} WHERE {where}"


_T, _IND = strip("t"), "(length(t) - length(ltrim(t, ' ' || chr(9) || chr(10) || chr(13))))"
_LONG = "'Line too long (' || CAST(length(t) AS VARCHAR) || ' chars, max 120)'"
_BR = f"'Mismatched braces: ' || CAST({_n('{')} AS VARCHAR) || ' opening, ' || CAST({_n('}')} AS VARCHAR) || ' closing'"
_PA = f"'Mismatched parentheses: ' || CAST({_n('(')} AS VARCHAR) || ' opening, ' || CAST({_n(')')} AS VARCHAR) || ' closing'"
_NL = "len(string_split(content, chr(10)))"
_JS, _PY = "language IN ('javascript', 'typescript')", f"language = 'python' AND {_T} <> '' AND NOT starts_with({_T}, '#')"
_YA, _CSS = f"language = 'yaml' AND {_T} <> '' AND NOT starts_with({_T}, '#')", f"language = 'css' AND {_T} <> '' AND NOT starts_with({_T}, '/*') AND NOT starts_with({_T}, '*')"
_KW = " OR ".join(f"contains(upper(content), '{k}')" for k in L.SQL_KEYWORDS)
_N = "CAST(NULL AS BIGINT)"
_PARTS = {
    "l1_javascript": [
        _row("warning", "'Consider using === instead of =='", f"{_JS} AND contains({_T}, '==') AND NOT contains({_T}, '===') AND NOT contains({_T}, '!==')"),
        _row("info", "'console.log statement found'", f"{_JS} AND contains(t, 'console.log')"), _row("warning", _LONG, f"{_JS} AND length(t) > 120"),
        _row("error", _BR, f"{_JS} AND {_n('{')} <> {_n('}')}", _N), _row("error", _PA, f"{_JS} AND {_n('(')} <> {_n(')')}", _N)],
    "l2_python": [
        _row("warning", "'Indentation should be multiples of 4 spaces'", f"{_PY} AND {_IND} % 4 <> 0"),
        _row("info", "'print() statement found'", f"{_PY} AND contains(t, 'print(')"), _row("warning", _LONG, f"{_PY} AND length(t) > 120"),
        _row("info", "'No main block detected'", f"language = 'python' AND NOT contains(content, 'if __name__') AND NOT contains(content, 'def main') AND {_NL} > 10", _N)],
    "l4_css": [
        _row("error", _BR, f"language = 'css' AND {_n('{')} <> {_n('}')}", _N), _row("warning", "'Avoid using !important'", f"{_CSS} AND contains(t, '!important')"),
        _row("warning", _LONG, f"{_CSS} AND length(t) > 120")],
    "l5_json": [_row("error", "'Invalid JSON'", r"language = 'json' AND NOT (json_valid(content) AND NOT regexp_matches(content, ',\s*[}\]]'))", _N)],
    "l6_yaml": [
        _row("warning", "'YAML indentation should be even spaces'", f"{_YA} AND starts_with(t, ' ') AND {_IND} % 2 <> 0"),
        _row("error", "'YAML does not allow tabs, use spaces'", f"{_YA} AND contains(t, chr(9))")],
    "l7_markdown": [
        "SELECT file_id, language, 'warning' AS severity, 'Add space after # in heading' AS message, line FROM md WHERE open = 0 AND (regexp_matches(t, '^#+[^# ]') OR regexp_matches(t, '^#+$'))",
        "SELECT file_id, language, 'info', 'Consider using markdown links for URLs', line FROM md WHERE open = 0 AND contains(t, 'http') AND NOT contains(t, '[') AND NOT contains(t, '<')",
        "SELECT file_id, language, 'warning', 'Unclosed code block', NULL FROM (SELECT file_id, language, arg_max(open, line) AS o FROM md GROUP BY ALL) WHERE o = 1"],
    "l8_sql": [
        _row("info", "'No SQL keywords detected'", f"language = 'sql' AND NOT ({_KW}) AND {_NL} > 3", _N),
        _row("warning", "'SELECT without FROM clause'", f"language = 'sql' AND starts_with(upper({_T}), 'SELECT') AND NOT contains(upper({_T}), 'FROM')"),
        _row("warning", "'SELECT * is not recommended, specify columns'", f"language = 'sql' AND starts_with(upper({_T}), 'SELECT') AND contains(t, '*')")],
    "l9_shell": [
        _row("info", "'Missing shebang line (#!/bin/bash)'", f"language = 'bash' AND NOT starts_with({strip('string_split(content, chr(10))[1]')}, '#!')", _N),
        _row("error", "'Unclosed double quote'", f"language = 'bash' AND {_n(chr(34))} % 2 = 1", _N), _row("error", "'Unclosed single quote'", f"language = 'bash' AND {_n(chr(39))} % 2 = 1", _N)],
    "l3_html": [
        _row("warning", "'Missing DOCTYPE declaration'", "language = 'html' AND NOT contains(content, '<!DOCTYPE') AND contains(content, '<html')", _N),
        _row("warning", "'Missing <title> tag in <head>'", "language = 'html' AND NOT contains(content, '<title>') AND contains(content, '<head>')", _N),
        "SELECT file_id, language, 'error', m, NULL FROM html_errors"],
    "l10_unsupported": [_row("info", "'No validator available for ' || language", f"language NOT IN ({', '.join(q(x) for x in L.SUPPORTED)})", _N)],
}
add_view("md", f"""SELECT *, sum(CASE WHEN starts_with({_T}, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line) % 2 AS open
FROM lint_lines WHERE language = 'markdown'""", ["lint_lines"])
_void = ", ".join(q(x) for x in L.VOID_TAGS)
add_view("html_tags", rf"""
SELECT file_id, language, row_number() OVER (PARTITION BY file_id ORDER BY i) AS i, tag, name FROM (
  SELECT file_id, language, i, tags[i] AS tag, lower(regexp_extract(tags[i], '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name
  FROM (SELECT file_id, language, regexp_extract_all(content, '</?[a-zA-Z][a-zA-Z0-9]*[^>]*/?>') AS tags FROM lint_files WHERE language = 'html'),
       LATERAL (SELECT unnest(range(1, len(tags) + 1)) AS i))
WHERE name NOT IN ({_void}) AND (starts_with(tag, '</') OR NOT ends_with(tag, '/>'))""", ["lint_files"])
# the recursive walk keeps the stack of each file after each of its tags
add_view("walk", """
  SELECT file_id, language, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS stack, CAST(NULL AS VARCHAR) AS message FROM (SELECT DISTINCT file_id, language FROM html_tags)
  UNION ALL SELECT h.file_id, h.language, h.i, CASE WHEN NOT starts_with(h.tag, '</') THEN list_append(w.stack, h.name)
      WHEN len(w.stack) > 0 AND w.stack[-1] = h.name THEN w.stack[1:len(w.stack) - 1] ELSE w.stack END,
    CASE WHEN NOT starts_with(h.tag, '</') THEN NULL WHEN len(w.stack) = 0 THEN 'Unexpected closing tag </' || h.name || '>'
      WHEN w.stack[-1] <> h.name THEN 'Mismatched tag: expected </' || w.stack[-1] || '>, got </' || h.name || '>' END
  FROM walk w JOIN html_tags h ON h.file_id = w.file_id AND h.i = w.i + 1""", ["html_tags"], recursive=True)
add_view("html_errors", """
SELECT file_id, language, message AS m FROM walk WHERE message IS NOT NULL
  UNION ALL SELECT file_id, language, 'Unclosed tag: <' || unnest(stack) || '>' FROM walk w WHERE i = (SELECT max(i) FROM html_tags h WHERE h.file_id = w.file_id)""", ["walk"])
_LANGS = {"l1_javascript": ["javascript", "typescript"], "l2_python": ["python"], "l3_html": ["html"], "l4_css": ["css"], "l5_json": ["json"],
          "l6_yaml": ["yaml"], "l7_markdown": ["markdown"], "l8_sql": ["sql"], "l9_shell": ["bash"]}


def _views(parts) -> list[str]:
    text = " ".join(parts)
    return [v for v in ("lint_lines", "lint_files", "md", "html_errors") if f"FROM {v}" in text]


def _check(parts) -> str:
    return sql("\nUNION ALL ".join(parts), *_views(parts))


def _register_language(name: str):
    @query(name, _check(_PARTS[name]))
    def lint_language(t, languages=_LANGS[name]):
        return L.findings(lint_files(t).where(F.col("language").isin(*languages)))


for _name in _LANGS:
    _register_language(_name)

_ALL = [p for parts in _PARTS.values() for p in parts]
_FOUND = "\nUNION ALL ".join(_ALL)


@query("l10_all_findings", _check(_ALL))
def all_findings(t):
    return L.findings(lint_files(t))


def _found_check(body: str) -> str:
    return sql(f"WITH found AS ({_FOUND}), r AS (SELECT f.file_id, f.language, count(*) FILTER (x.severity = 'error') AS errors, "
               f"count(*) FILTER (x.severity <> 'error') AS warnings FROM lint_files f LEFT JOIN found x ON x.file_id = f.file_id GROUP BY ALL)\n{body}",
               "lint_lines", "lint_files", "md", "html_errors")


@query("l10_file_results", _found_check("SELECT *, errors = 0 AS valid FROM r"))
def file_results(t):
    f = lint_files(t)
    return L.results(f, L.findings(f))


@query("a15_lint_summary", _found_check("""SELECT count(*) AS total, count(*) FILTER (errors = 0) AS valid, count(*) FILTER (errors > 0) AS invalid,
  CAST(sum(errors) AS BIGINT) AS total_errors, CAST(sum(warnings) AS BIGINT) AS total_warnings,
  printf('%.1f', round(count(*) FILTER (errors = 0) / count(*) * 100, 1)) || '%' AS pass_rate FROM r"""))
def lint_summary(t):
    f = lint_files(t)
    return L.summary(L.results(f, L.findings(f)))


@query("x3_own_lint_rules", sql("""
SELECT file_id, line, 'No puts in scripts' AS message FROM lint_lines WHERE language = 'ruby' AND regexp_matches(t, 'puts')""", "lint_lines"))
def own_lint_rules(t):
    f = lint_files(t).where("language = 'ruby'")
    return L.findings(f, [L.LintRule("Ruby", "warning", "puts", "No puts in scripts")]).where("line IS NOT NULL").select("file_id", "line", "message")


# --- dependencies ------------------------------------------------------------------------------
_std = ", ".join(q(x) for x in R.PYTHON_STDLIB)
_go = ", ".join(q(x) for x in R.GO_STDLIB)
_GO_IMPORT = r'^import\s+"([^"]+)"'
_REQ = rx("t", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""")
_IMP = rx("t", r"""import\s+.*\s+from\s+['"]([^'"]+)['"]""")
add_view("dependencies", rf"""
SELECT DISTINCT project_id, ecosystem, package FROM (
  WITH l AS (SELECT project_id, language, unnest(string_split(content, chr(10))) AS t FROM stored),
  py AS (SELECT project_id, coalesce({rx(strip('t'), r'^import\s+([\w.]+)')}, {rx(strip('t'), r'^from\s+([\w.]+)\s+import')}) AS m FROM l WHERE language = 'python'),
  js AS (SELECT project_id, coalesce({_REQ}, {_IMP}) AS m FROM l WHERE language IN ('javascript', 'typescript')),
  go AS (SELECT project_id, coalesce({rx(strip('t'), '^"([^"]+)"')}, {rx(strip('t'), _GO_IMPORT)}) AS m FROM l WHERE language = 'go')
  SELECT project_id, 'python' AS ecosystem, string_split(m, '.')[1] AS package FROM py WHERE m IS NOT NULL AND string_split(m, '.')[1] NOT IN ({_std})
  UNION ALL SELECT project_id, 'node', CASE WHEN starts_with(m, '@') THEN array_to_string(string_split(m, '/')[1:2], '/') ELSE string_split(m, '/')[1] END
    FROM js WHERE NOT starts_with(m, '.') AND NOT starts_with(m, '/')
  UNION ALL SELECT project_id, 'go', m FROM go WHERE NOT starts_with(m, '.') AND NOT starts_with(m, '/') AND string_split(m, '/')[1] NOT IN ({_go})
  UNION ALL SELECT project_id, 'java', 'org.springframework.boot:spring-boot-starter-web' FROM stored WHERE language = 'java'
    AND (contains(content, 'org.springframework') OR contains(content, '@SpringBootApplication') OR contains(content, '@RestController'))
  UNION ALL SELECT project_id, 'java', 'org.junit.jupiter:junit-jupiter' FROM stored WHERE language = 'java' AND (contains(content, 'org.junit') OR contains(content, '@Test')))""", ["stored"])
_cands = " ".join(f"WHEN bool_or(ends_with(path, '{x}')) THEN '{x}'" for x in R.MAIN_FILES)
add_view("main_files", f"""
SELECT project_id, coalesce(CASE {_cands} END, arg_min(path, file_id), 'index.js') AS main_file FROM stored
WHERE language IN ('javascript', 'typescript') GROUP BY project_id""", ["stored"])


@query("a10_dependencies", sql("SELECT * FROM dependencies", "dependencies"))
def dependencies(t):
    return D.dependencies(stored(t))


@query("a11_main_files", sql("SELECT * FROM main_files", "main_files"))
def main_files(t):
    return D.main_files(stored(t))


_PKG = "coalesce(nullif(substr(" + sub(sub("lower(d.project_id)", "[^a-z0-9_.-]", "-"), "^-+|-+$") + ", 1, 214), ''), 'extracted-project')"
_MAIN = "coalesce((SELECT main_file FROM main_files m WHERE m.project_id = d.project_id), 'index.js')"
_COMMENT = "# Auto-generated from the extracted files"


_MANIFESTS = rf"""
SELECT project_id, 'requirements.txt' AS path, {q(_COMMENT)} || chr(10) || '# Review and update versions as needed' || chr(10) || chr(10) || string_agg(package, chr(10) ORDER BY package) AS text
FROM dependencies WHERE ecosystem = 'python' GROUP BY ALL
UNION ALL SELECT d.project_id, 'package.json', '{{' || chr(10) || '  "name": "' || {_PKG} || '",' || chr(10) || '  "version": "1.0.0",' || chr(10) || '  "main": "' || {_MAIN} || '",' || chr(10)
  || '  "scripts": {{' || chr(10) || '    "start": "node ' || {_MAIN} || '",' || chr(10) || '    "test": "echo \"Error: no test specified\" && exit 1"' || chr(10) || '  }},' || chr(10)
  || '  "dependencies": {{' || chr(10) || string_agg('    "' || package || '": "^latest"', ',' || chr(10) ORDER BY package) || chr(10) || '  }}' || chr(10) || '}}'
FROM dependencies d WHERE ecosystem = 'node' GROUP BY d.project_id
UNION ALL SELECT d.project_id, 'go.mod', 'module github.com/user/' || lower(d.project_id) || chr(10) || chr(10) || 'go 1.21' || chr(10) || chr(10) || 'require (' || chr(10)
  || string_agg(chr(9) || package || ' latest', chr(10) ORDER BY package) || chr(10) || ')' FROM dependencies d WHERE ecosystem = 'go' GROUP BY d.project_id
UNION ALL SELECT d.project_id, 'pom-dependencies.xml', '<dependencies>' || chr(10) || string_agg('  <dependency><groupId>' || string_split(package, ':')[1] || '</groupId><artifactId>'
  || string_split(package, ':')[2] || '</artifactId></dependency>', chr(10) ORDER BY package) || chr(10) || '</dependencies>' FROM dependencies d WHERE ecosystem = 'java' GROUP BY d.project_id"""


@query("a10_manifest_texts", sql(_MANIFESTS, "dependencies", "main_files"))
def manifest_texts(t):
    """Manifest lines glued to texts; a sample project has at most sixty-four files, so its manifest is short."""
    s = stored(t)
    lines = D.manifest_lines(D.dependencies(s), D.main_files(s))
    return lines.groupBy("project_id", "path").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("section", "sort_key", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query("a10_manifest_lines", sql(f"""
SELECT project_id, path, unnest(range(len(lines))) AS place, unnest(lines) AS line FROM (SELECT project_id, path, string_split(text, chr(10)) AS lines FROM ({_MANIFESTS}))""", "dependencies", "main_files"))
def manifest_lines(t):
    """Manifests as numbered rows: a project may have any number of packages."""
    s = stored(t)
    lines = D.manifest_lines(D.dependencies(s), D.main_files(s))
    # Frame lines have sections below or above that of the packages; these are many, and differ in their first letters.
    coarse = F.struct(F.col("section"), coarse_text(F.col("sort_key")))
    found = numbered(lines, ["project_id", "path"], [F.col("section"), F.col("sort_key")], coarse, "n")
    return found.select("project_id", "path", (F.col("n") - 1).alias("place"), "line")
