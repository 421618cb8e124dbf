"""Queries: filters and lookups, statistics, trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import html as H, metrics as MT
from codeloom.operators import analytics as A, lookups as L, names as O
from codeloom.operators.ranking import coarse_text, numbered
from codeloom.plans.naming import code_files
from codeloom.plans.registry import query
from codeloom.plans.sqltext import add_view, base_name, like, q, sql, strip
from codeloom.rules import languages as RL
from codeloom.sources import views as V

add_view("stored", f"SELECT *, block_id AS file_id, {base_name('path')} AS name FROM code_files", ["code_files"])


def stored(t):
    """Mapped code files as stored records."""
    return code_files(t).withColumn("file_id", F.col("block_id"))


# --- P: filters and lookups ------------------------------------------------------------
@query("p3_project_listing", sql("""
SELECT project_id, name, source_site, (SELECT count(*) FROM projects WHERE list_contains(languages, 'en') AND is_favorite) AS total
FROM projects WHERE list_contains(languages, 'en') AND is_favorite ORDER BY created_at DESC, project_id LIMIT 10 OFFSET 5""", "projects"))
def project_listing(t):
    found = L.list_projects(V.projects(t), language="en", favorite=True)
    total = found.agg(F.count("*").alias("n"))
    return L.page(found, [F.col("created_at").desc(), F.col("project_id")], 5, 10).withColumn("total", total.scalar()).select(
        "project_id", "name", "source_site", "total")


@query("p4_project_search", sql("""
SELECT project_id FROM projects WHERE contains(lower(name), 'TAG-3') OR contains(lower(source_url), 'tag-3') OR contains(lower(page_title), 'tag-3')
  OR len(list_filter(tags, lambda x: contains(lower(x), 'tag-3'))) > 0 OR len(list_filter(languages, lambda x: contains(lower(x), 'tag-3'))) > 0""", "projects"))
def project_search(t):
    return L.search_projects(V.projects(t), "Tag-3").select("project_id")


@query("p5_file_search", sql("""
SELECT file_id FROM files WHERE project_id = 'src3' AND (contains(lower(path), 'tion') OR contains(lower(language), 'tion') OR contains(lower(content), 'tion'))""", "files"))
def file_search(t):
    return L.search_files(V.files(t), "TION", "src3").select("file_id")


@query("p6_index_lookups", sql("""
SELECT 'scalar' AS kind, project_id FROM projects WHERE source_site LIKE '%.org' AND source_site = (SELECT min(source_site) FROM projects WHERE source_site LIKE '%.org')
UNION ALL SELECT 'multi', project_id FROM projects WHERE list_contains(tags, 'https')
UNION ALL SELECT 'compound', project_id FROM projects WHERE is_favorite = true AND list_contains(tags, 'Tag-2')""", "projects"))
def index_lookups(t):
    p = V.projects(t)
    first_site = p.where(F.col("source_site").endswith(".org")).agg(F.min("source_site").alias("s"))
    scalar = p.where(F.col("source_site") == first_site.scalar()).select(F.lit("scalar").alias("kind"), "project_id")
    multi = L.by_index(p, tags="https").select(F.lit("multi").alias("kind"), "project_id")
    compound = L.by_index(p, is_favorite=True, tags="Tag-2").select(F.lit("compound").alias("kind"), "project_id")
    return scalar.unionByName(multi).unionByName(compound)


@query("p7_range_lookup", "SELECT event_id, user_id, value FROM events WHERE value BETWEEN 10 AND 20")
def range_lookup(t):
    return L.by_range(t("events"), "value", 10, 20).select("event_id", "user_id", "value")


@query("p8_field_lookups", sql("""
SELECT 'language' AS kind, file_id FROM files WHERE language = 'de' UNION ALL SELECT 'path', file_id FROM files WHERE project_id = 'src5' AND path = 'en/Doc_0.txt'
UNION ALL SELECT 'favorite', version_id FROM versions WHERE is_favorite""", "files", "versions"))
def field_lookups(t):
    f = V.files(t)
    return (L.by_index(f, language="de").select(F.lit("language").alias("kind"), "file_id")
            .unionByName(L.by_index(f, project_id="src5", path="en/Doc_0.txt").select(F.lit("path").alias("kind"), "file_id"))
            .unionByName(V.versions(t).where("is_favorite").select(F.lit("favorite").alias("kind"), F.col("version_id").alias("file_id"))))


@query("p9_change_filters", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND user_id = 7")
def change_filters(t):
    return L.by_index(t("events"), event_type="purchase", user_id=7).select("event_id", "user_id")


@query("p10_export_set", sql("""
SELECT file_id, path FROM stored WHERE CASE WHEN contains(path, '.') THEN lower(string_split(path, '.')[-1]) ELSE 'no-ext' END IN ('py', 'md', 'no-ext')""", "stored"))
def export_set(t):
    return L.export_set(stored(t), ["py", "md", "no-ext"]).select("file_id", "path")


_VALID_PATH = r"""(length(trim(path)) > 0 AND length(path) <= 4096 AND NOT regexp_matches(path, '[<>:"|?*\x00-\x1F]')
  AND len(list_filter(regexp_split_to_array(path, '[/\\]'), lambda s: length(s) < 1 OR length(s) > 255)) = 0)"""
_langs = ", ".join(q(x) for x in RL.VALID_LANGUAGES)


@query("p11_quality_gate", sql(rf"""
SELECT block_id AS file_id, {_VALID_PATH} AS valid_path,
  (length(trim({base_name('path')})) > 0 AND length({base_name('path')}) <= 255 AND NOT regexp_matches({base_name('path')}, '[<>:"/\\|?*\x00-\x1F]')
   AND NOT regexp_matches({base_name('path')}, '^\.+$')) AS valid_name,
  lower(language) IN ({_langs}) AS valid_language, length(project_id) <= 100 AS valid_project, length({strip('code')}) >= 3 AS valid_code
FROM (SELECT *, label || CASE WHEN length(text_before) > 5 THEN '/' ELSE '' END || text_before AS path FROM code_blocks)""", "code_blocks"))
def quality_gate(t):
    b = V.code_blocks(t).select(
        F.col("block_id").alias("file_id"), "language", "project_id", F.col("code").alias("content"),
        F.concat("label", F.when(F.length("text_before") > 5, F.lit("/")).otherwise(F.lit("")), "text_before").alias("path"))
    return L.quality_gate(b)


@query("p12_structure_findings", sql(f"""
WITH f AS (SELECT source AS project_id, block_id AS file_id, label AS path, CASE WHEN language = '' THEN '' ELSE code END AS content FROM code_blocks),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY file_id) AS rn FROM f)
SELECT project_id, file_id, 'error' AS severity, 'Invalid file path: "' || path || '"' AS message FROM r WHERE NOT {_VALID_PATH}
UNION ALL SELECT project_id, file_id, 'warning', 'Duplicate file path: "' || path || '"' FROM r WHERE rn > 1
UNION ALL SELECT project_id, file_id, 'warning', 'Empty or invalid content in: "' || path || '"' FROM r WHERE length({strip('content')}) < 3
UNION ALL SELECT n_name, NULL, 'error', 'Project has no files' FROM nation WHERE n_name NOT IN (SELECT project_id FROM f)""", "code_blocks"))
def structure_findings(t):
    files = V.code_blocks(t).select(F.col("source").alias("project_id"), F.col("block_id").alias("file_id"), F.col("label").alias("path"),
                                    F.when(F.col("language") == "", F.lit("")).otherwise(F.col("code")).alias("content"))
    projects = t("nation").select(F.col("n_name").alias("project_id")).unionByName(t("documents").select(F.col("source").alias("project_id")))
    return L.structure_findings(projects, files)


@query("j1_projects_with_files", sql("""
SELECT p.project_id, s.block_id AS file_id, s.path, s.position FROM (SELECT DISTINCT 'p' || CAST(doc_id // 32 AS VARCHAR) AS project_id FROM documents) p
LEFT JOIN code_files s ON s.project_id = p.project_id""", "code_files"))
def projects_with_files(t):
    p = t("documents").select(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 32).cast("string")).alias("project_id")).distinct()
    return L.project_with_files(p, stored(t))


@query("j1_nested_files", sql("""
SELECT project_id, position // 10000 AS page, string_agg(CAST(position AS VARCHAR) || ':' || CAST(block_id AS VARCHAR) || ':' || path, '|' ORDER BY position, block_id) AS files
FROM code_files GROUP BY ALL""", "code_files"))
def nested_files(t):
    p = stored(t).select("project_id").distinct()
    n = L.nested_files(L.project_with_files(p, stored(t)))
    return n.select("project_id", "page", F.array_join(F.transform("files", lambda f: F.concat_ws(
        ":", f["position"].cast("string"), f["file_id"].cast("string"), f["path"])), "|").alias("files"))


# --- T, W7, W9: ordering and paging -----------------------------------------------------
@query("t2_cursor_page", """
SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS row, true AS has_more FROM (
  SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100)""")
def cursor_page(t):
    return L.page_with_more(t("events").select("event_id", "ts"), [F.col("ts").desc(), F.col("event_id")], 100, 50).select(
        "event_id", "row", "has_more")


@query("t4_reordered_files", sql("""
WITH o AS (SELECT project_id, block_id, row_number() OVER (PARTITION BY project_id ORDER BY path DESC, block_id) - 1 AS place
           FROM code_files WHERE language <> 'text')
SELECT f.project_id, f.block_id AS file_id, coalesce(o.place, f.position) AS position FROM code_files f
LEFT JOIN o ON o.project_id = f.project_id AND o.block_id = f.block_id""", "code_files"))
def reordered(t):
    s = stored(t)
    listed = s.where("language <> 'text'").select("project_id", "file_id", "path")
    order = numbered(listed, ["project_id"], [F.col("path").desc(), F.col("file_id")], -coarse_text(F.col("path")), "n").withColumn("place", F.col("n") - 1)
    return L.reordered(s, order).select("project_id", "file_id", "position")


@query("w7_scan_history_cap", """
SELECT user_id, event_id AS entry_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events
QUALIFY rank <= 20""")
def history_cap(t):
    h = t("events").select("user_id", F.col("event_id").alias("entry_id"), "ts")
    return L.newest_per_user(h, 20).select("user_id", "entry_id", "rank")


@query("w9_recent_searches", """
SELECT conv_id AS user_id, turn AS entry_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations
WHERE role = 'user' QUALIFY rank <= 50""")
def recent_searches(t):
    h = t("conversations").where("role = 'user'").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("entry_id"), F.col("turn").alias("ts"))
    return L.newest_per_user(h, 50).select("user_id", "entry_id", "rank")


# --- A: statistics -------------------------------------------------------------------------
def _lines_like(pattern: str, x: str = "content") -> str:
    return f"len(list_filter(list_transform(string_split({x}, chr(10)), lambda y: {strip('y')}), lambda y: {like('y', '^' + pattern)}))"


add_view("metrics", f"""
SELECT project_id, file_id, path, lower(language) AS language, ts, len(string_split(content, chr(10))) AS lines, octet_length(encode(content)) AS bytes,
  {_lines_like(MT.FUNCTIONS)} AS functions, {_lines_like(MT.CLASSES)} AS classes, {_lines_like(MT.IMPORTS)} AS imports,
  CASE WHEN lower(language) IN ('python', 'bash', 'ruby', 'yaml') THEN {_lines_like('#')} WHEN lower(language) IN ('html', 'xml') THEN {_lines_like('<!--')}
       WHEN lower(language) = 'sql' THEN {_lines_like('--')} ELSE {_lines_like(MT.SLASH_COMMENT)} END AS comment_lines,
  len(list_filter(string_split(content, chr(10)), lambda y: {strip('y')} = '')) AS blank_lines FROM stored""", ["stored"])


def metrics(t):
    return A.file_metrics(stored(t))


def _sum(*names: str) -> str:
    return ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)


@query("a9_file_metrics", sql("SELECT * EXCLUDE (ts, path) FROM metrics", "metrics"))
def file_metrics(t):
    return metrics(t).drop("ts", "path")


_TOT = ", ".join(f"CAST(sum({c}) AS BIGINT) AS total_{c}" for c in ("lines", "bytes", "functions", "classes", "imports", "comment_lines", "blank_lines"))


@query("a4_project_statistics", sql(f"""
SELECT *, CAST(round(total_comment_lines / total_lines * 100) AS BIGINT) AS comment_ratio, CAST(round(total_blank_lines / total_lines * 100) AS BIGINT) AS blank_ratio
FROM (SELECT project_id, count(*) AS total_files, {_TOT} FROM metrics GROUP BY project_id)""", "metrics"))
def project_statistics(t):
    return A.project_statistics(metrics(t))


@query("a4_language_breakdown", sql(f"SELECT project_id, language, count(*) AS files, {_sum('lines')} FROM metrics GROUP BY ALL", "metrics"))
def language_breakdown(t):
    return A.language_breakdown(metrics(t))


@query("a4_extension_counts", sql(r"""
SELECT project_id, CASE WHEN contains(path, '.') THEN '.' || lower(string_split(path, '.')[-1]) ELSE 'no-extension' END AS extension, count(*) AS files
FROM stored GROUP BY ALL""", "stored"))
def extension_counts(t):
    return A.extension_counts(stored(t))


_OVER = f"""SELECT count(DISTINCT project_id) AS total_projects, count(*) AS total_files, CAST(sum(lines) AS BIGINT) AS total_lines,
  CAST(sum(bytes) AS BIGINT) AS total_bytes, count(DISTINCT language) AS languages,
  CAST(round(count(*) / count(DISTINCT project_id)) AS BIGINT) AS average_files, CAST(round(sum(lines) / count(DISTINCT project_id)) AS BIGINT) AS average_lines FROM metrics"""


@query("a5_overview", sql(_OVER, "metrics"))
def overview(t):
    return A.overview(metrics(t))


@query("a5_top_languages", sql("""
SELECT language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, count(DISTINCT project_id) AS projects FROM metrics
GROUP BY language ORDER BY lines DESC, language LIMIT 10""", "metrics"))
def top_languages(t):
    return A.top_languages(metrics(t))


@query("a5_project_sizes", sql("SELECT project_id, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS size FROM metrics GROUP BY project_id", "metrics"))
def project_sizes(t):
    return A.project_sizes(metrics(t))


_CAL = "SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day"


@query("a6_scan_history", sql(f"""
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT project_id) AS scans, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM metrics GROUP BY 1),
c AS ({_CAL})
SELECT strftime(c.day, '%Y-%m-%d') AS day, coalesce(scans, 0) AS scans, coalesce(files, 0) AS files, coalesce(lines, 0) AS lines
FROM c LEFT JOIN d ON d.day = c.day""", "metrics"))
def scan_history(t):
    return A.scan_history(metrics(t), "2024-01-30", 30)


@query("a7_language_trend", sql(f"""
WITH d AS (SELECT CAST(ts AS DATE) AS day, language, count(*) AS files FROM metrics GROUP BY ALL), c AS ({_CAL})
SELECT strftime(c.day, '%Y-%m-%d') AS day, language, coalesce(files, 0) AS files FROM c LEFT JOIN d ON d.day = c.day""", "metrics"))
def language_trend(t):
    return A.language_trend(metrics(t), "2024-01-30", 30)


@query("a8_productivity", sql(f"""
WITH o AS ({_OVER}), s AS (SELECT least(total_projects * 10, 30) AS projects_score, least(total_files * 2, 25) AS files_score,
  least(log10(total_lines) * 15, 25) AS l, least(least(languages, 10) * 5, 20) AS languages_score FROM o)
SELECT projects_score, files_score, CAST(round(l) AS BIGINT) AS lines_score, languages_score,
  CAST(round(projects_score + files_score + l + languages_score) AS BIGINT) AS score FROM s""", "metrics"))
def productivity(t):
    return A.productivity(A.overview(metrics(t)))


@query("a3_structure_summary", sql("""
SELECT project_id, language, source, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS size, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines
FROM stored GROUP BY GROUPING SETS ((project_id, language), (project_id, source), (project_id))""", "stored"))
def structure_summary(t):
    return A.structure_summary(stored(t))


@query("a3_directory_counts", sql("""
SELECT project_id, count(DISTINCT array_to_string(parts[1:i], '/')) AS directories FROM (SELECT project_id, string_split(path, '/') AS parts FROM code_files),
  LATERAL (SELECT unnest(range(1, len(parts))) AS i) GROUP BY project_id""", "code_files"))
def directory_counts(t):
    return A.directory_counts(O.directories(stored(t)))


@query("a18_row_counts", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in ("pages", "documents", "conversations", "events")))
def row_counts(t):
    return L.row_counts(**{n: t(n) for n in ("pages", "documents", "conversations", "events")})


@query("a18_corpus_usage", sql("SELECT count(DISTINCT project_id) AS projects, count(*) AS files, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes FROM files", "files"))
def corpus_usage(t):
    return A.corpus_usage(V.files(t))


@query("a19_quick_stats", sql("""
SELECT language, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS size, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines
FROM stored GROUP BY GROUPING SETS ((language), ())""", "stored"))
def quick_stats(t):
    return A.quick_stats(stored(t))


_KIND = "CASE event_type WHEN 'signup' THEN 'file_added' WHEN 'click' THEN 'file_updated' WHEN 'error' THEN 'conflict' WHEN 'purchase' THEN 'file_removed' ELSE 'scan_started' END"


def change_log(t):
    """Events in the role of the change log."""
    kind = (F.when(F.col("event_type") == "signup", "file_added").when(F.col("event_type") == "click", "file_updated")
            .when(F.col("event_type") == "error", "conflict").when(F.col("event_type") == "purchase", "file_removed").otherwise("scan_started"))
    return t("events").select(F.col("user_id").alias("scan_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"), F.col("props").alias("element_id"))


@query("a21_session_statistics", f"""
WITH c AS (SELECT user_id AS scan_id, ts, props, {_KIND} AS type FROM events)
SELECT scan_id, count(*) AS changes, count(*) FILTER (type = 'file_added') AS file_added, count(*) FILTER (type = 'file_updated') AS file_updated,
  count(*) FILTER (type = 'file_removed') AS file_removed, count(*) FILTER (type = 'conflict') AS conflict,
  CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS duration, count(DISTINCT props) AS elements FROM c GROUP BY scan_id""")
def session_statistics(t):
    c = change_log(t)
    return A.session_statistics(c).join(A.session_elements(c), "scan_id")


@query("a23_project_totals", sql("SELECT project_id, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS size FROM files GROUP BY project_id", "files"))
def project_totals(t):
    return A.project_file_totals(V.files(t))


def _profile_files(t):
    return stored(t).withColumn("path", F.when(F.col("position") < 4, F.substring_index("path", "/", -1)).otherwise(F.col("path")))


_PROFILE = f"profile AS (SELECT * EXCLUDE (path), CASE WHEN position < 4 THEN {base_name('path')} ELSE path END AS path FROM stored)"
_ENTRY = ", ".join(q(x) for x in A.ENTRY_FILES)


@query("a25_frameworks", sql(f"""
WITH {_PROFILE}, g AS (SELECT project_id, bool_or(contains(lower(path), 'next.config')) AS n, bool_or(contains(lower(path), 'vite.config')) AS v,
  bool_or(lower(path) = 'package.json') AS p FROM profile GROUP BY project_id),
e AS (SELECT project_id, path FROM profile WHERE lower(path) IN ({_ENTRY}) QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY position, file_id) = 1)
SELECT g.project_id, CASE WHEN n THEN 'nextjs' WHEN v THEN 'vite' WHEN p THEN 'nodejs' END AS framework, e.path AS entry_file,
  CASE WHEN ends_with(e.path, '.py') THEN 'python' WHEN e.path IS NOT NULL THEN 'node' END AS launcher FROM g LEFT JOIN e ON e.project_id = g.project_id""", "stored"))
def frameworks(t):
    return A.frameworks(_profile_files(t))


_EXTS = ", ".join(f"({q(k)}, {q(e)})" for k, es in A.EDITOR_EXTENSIONS.items() for e in es)


@query("a25_editor_extensions", sql(f"""
SELECT DISTINCT s.project_id, v.extension FROM stored s JOIN (VALUES {_EXTS}) v(language, extension) ON v.language = s.language""", "stored"))
def editor_extensions(t):
    return A.recommended_extensions(stored(t))
