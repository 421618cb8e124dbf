"""Queries: versions and diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import diffs as D, versions as O
from codeloom.plans.registry import query
from codeloom.plans.sqltext import add_view, sql
from codeloom.sources import views as V

add_view("numbered_versions", "SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY ts, version_id) AS version_no FROM versions", ["versions"])
add_view("predecessors", """
SELECT *, lag(version_id) OVER w AS old_version, lag(content) OVER w AS old_content FROM versions
WINDOW w AS (PARTITION BY project_id, path ORDER BY ts, version_id)""", ["versions"])
add_view("version_diffs", "SELECT version_id AS pair_id, old_content AS old, content AS new FROM predecessors WHERE old_version IS NOT NULL", ["predecessors"])


def by_pair(t, find):
    """``find(pairs, whole)`` of each version and its predecessor; a pair of texts that several versions have is gone through once.

    Texts come to their files. Only where ids repeat, or a file is too large for a task, texts come to their pairs.
    """
    records, texts = V.version_records(t), V.file_texts(t)
    if O.ids_repeat(records):
        return _by_key(t, find, O.predecessor_keys(records))
    large = O.large_files(records, texts)
    if large.isEmpty():
        return D.for_owners(find(O.file_pairs(records, texts), True))
    listed = F.broadcast(large)
    small = D.for_owners(find(O.file_pairs(records.join(listed, O.KEY, "left_anti"), texts.join(listed, O.KEY, "left_anti")), True))
    return small.unionByName(_by_key(t, find, O.predecessor_keys(records.join(listed, O.KEY, "left_semi"))))


def _by_key(t, find, keyed):
    pairs, owners = D.text_pairs(keyed, V.contents(t))
    return D.for_owners(find(pairs, False), owners)


@query("w5_numbered_versions", sql("SELECT version_id, version_no FROM numbered_versions", "numbered_versions"))
def numbered_versions(t):
    return O.number_versions(V.versions(t)).select("version_id", "version_no")


_KEEP = "SELECT version_id, project_id, path FROM (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY ts DESC, version_id DESC) AS r FROM versions) WHERE r <= {} OR is_favorite"


@query("w6_retained_versions", sql(_KEEP.format(3), "versions"))
def retained(t):
    return O.retained(V.versions(t), 3).select("version_id", "project_id", "path")


@query("v1_saved_versions", sql("""
WITH n AS (SELECT file_id AS version_id, project_id, path, content, ts FROM files WHERE file_id NOT IN (SELECT version_id FROM versions WHERE change_type = 'view')),
a AS (SELECT version_id, project_id, path, size, lines, ts, change_type, is_favorite FROM versions WHERE change_type = 'view'
  UNION ALL SELECT version_id, project_id, path, length(content), CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END, ts, 'manual_edit', false FROM n)
SELECT version_id, project_id, path, size, lines, change_type, is_favorite FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY ts DESC, version_id DESC) AS r FROM a) WHERE r <= 4 OR is_favorite""", "versions", "files"))
def saved_versions(t):
    there = V.versions(t).where("change_type = 'view'")
    saves = V.files(t).withColumnRenamed("file_id", "version_id").join(there.select("version_id"), "version_id", "left_anti").withColumn(
        "change_type", F.lit("")).withColumn("source", F.lit(None).cast("string"))
    return O.save_versions(there, O.new_versions(saves), 4).select(
        "version_id", "project_id", "path", "size", "lines", "change_type", "is_favorite")


@query("j7_version_as_of", sql("""
SELECT f.file_id AS probe_id, f.project_id, f.path, (SELECT arg_max(v.version_id, (v.ts, v.version_id)) FROM versions v
  WHERE v.project_id = f.project_id AND v.path = f.path AND v.ts <= f.ts + INTERVAL 2 HOUR) AS version_id FROM files f""", "files", "versions"))
def version_as_of(t):
    probes = V.files(t).select(F.col("file_id").alias("probe_id"), "project_id", "path", (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("ts"))
    return O.as_of(probes, V.versions(t)).select("probe_id", "project_id", "path", "version_id")


@query("j8_predecessors", sql("SELECT version_id, old_version, length(old_content) AS old_size, size FROM predecessors", "predecessors"))
def predecessors(t):
    return O.with_predecessor(V.version_records(t), V.contents(t)).select("version_id", "old_version", F.length("old_content").alias("old_size"), "size")


@query("j8_version_pairs", sql("""
SELECT e.event_id AS pair_id, length(a.content) AS old_size, length(b.content) AS new_size FROM events e
JOIN versions a ON a.version_id = e.user_id JOIN versions b ON b.version_id = e.user_id * 2 + 1""", "versions"))
def version_pairs(t):
    pairs = t("events").select(F.col("event_id").alias("pair_id"), F.col("user_id").alias("old_version"), (F.col("user_id") * 2 + 1).alias("new_version"))
    return O.version_pairs(pairs, V.version_records(t), V.contents(t)).select("pair_id", F.length("old").alias("old_size"), F.length("new").alias("new_size"))


@query("a12_version_statistics", sql("""
WITH p AS (SELECT project_id, path, count(*) AS n, min(ts) AS a, max(ts) AS b FROM versions GROUP BY ALL)
SELECT project_id, CAST(sum(n) AS BIGINT) AS versions, count(*) AS files, arg_min(path, (-n, path)) AS most_changed, max(n) AS most_changed_count,
  strftime(min(a), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(b), '%Y-%m-%d %H:%M:%S') AS last_at FROM p GROUP BY project_id""", "versions"))
def version_statistics(t):
    s = O.statistics(V.versions(t))
    return s.withColumn("first_at", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss")).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@query("a12_change_types", sql("SELECT project_id, change_type, count(*) AS versions FROM versions GROUP BY ALL", "versions"))
def change_types(t):
    return O.change_types(V.versions(t))


@query("a13_timeline", sql("""
SELECT project_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS changes, count(DISTINCT path) AS files FROM versions GROUP BY ALL""", "versions"))
def timeline(t):
    return O.timeline(V.versions(t))


@query("a13_timeline_changes", sql("""
SELECT project_id, strftime(ts, '%Y-%m-%d') AS day, version_id, path, change_type, size,
  row_number() OVER (PARTITION BY project_id, strftime(ts, '%Y-%m-%d') ORDER BY ts DESC, version_id DESC) - 1 AS place FROM versions""", "versions"))
def timeline_changes(t):
    return O.timeline_changes(V.versions(t)).drop("ts")


@query("v7_toggled_favorites", sql("""
WITH g AS (SELECT user_id AS version_id, count(*) % 2 = 1 AS flip FROM events GROUP BY 1)
SELECT v.version_id, CASE WHEN coalesce(flip, false) THEN NOT is_favorite ELSE is_favorite END AS is_favorite FROM versions v LEFT JOIN g ON g.version_id = v.version_id""", "versions"))
def toggled(t):
    return O.toggled(V.versions(t), t("events").select(F.col("user_id").alias("version_id"))).select("version_id", "is_favorite")


@query("v7_deleted_versions", sql("""
SELECT version_id FROM versions WHERE version_id NOT IN (SELECT doc_id FROM labels) AND project_id NOT IN (SELECT 'src' || CAST(n_regionkey AS VARCHAR) FROM nation)""", "versions"))
def deleted(t):
    ids = t("labels").select(F.col("doc_id").alias("version_id"))
    projects = t("nation").select(F.concat(F.lit("src"), F.col("n_regionkey").cast("string")).alias("project_id")).distinct()
    return O.without_versions(V.versions(t), ids, projects).select("version_id")


# --- diffs: the check computes the longest common subsequence row by row -------------------
_LCS = """
WITH RECURSIVE p AS (SELECT pair_id, {a} AS a, {b} AS b FROM version_diffs),
dp AS (SELECT pair_id, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0) AS r FROM p
  UNION ALL SELECT dp.pair_id, dp.i + 1, list_reduce(range(1, len(p.b) + 1), lambda acc, j: list_append(acc, greatest(acc[-1], dp.r[j + 1],
      CASE WHEN p.a[dp.i + 1] = p.b[j] THEN dp.r[j] + 1 ELSE 0 END)), [0])
  FROM dp JOIN p ON p.pair_id = dp.pair_id WHERE dp.i < len(p.a)),
lcs AS (SELECT dp.pair_id, dp.r[-1] AS n, len(p.a) AS la, len(p.b) AS lb FROM dp JOIN p ON p.pair_id = dp.pair_id WHERE dp.i = len(p.a))
"""
_SPLIT = {"a": "string_split(old, chr(10))", "b": "string_split(new, chr(10))"}


@query("a20_diff_statistics", sql(_LCS.format(**_SPLIT) + """
SELECT pair_id, lb - n AS added, la - n AS removed, CAST(n AS BIGINT) AS unchanged FROM lcs""", "version_diffs"))
def diff_statistics(t):
    return by_pair(t, lambda pairs, whole: D.diff_statistics(D.diff_lines(pairs, whole=whole)))


_TRIM = {k: f"list_transform({v}, lambda x: rtrim(x, ' ' || chr(9) || chr(10) || chr(13)))" for k, v in _SPLIT.items()}


@query("v4_diff_without_trailing_blanks", sql(_LCS.format(**_TRIM) + """
SELECT pair_id, lb - n AS added, la - n AS removed, CAST(n AS BIGINT) AS unchanged FROM lcs""", "version_diffs"))
def diff_blanks(t):
    return by_pair(t, lambda pairs, whole: D.diff_statistics(D.diff_lines(pairs, ignore_trailing_blanks=True, whole=whole)))


@query("v2_diff_replay", sql("SELECT pair_id, old, new FROM version_diffs", "version_diffs"))
def diff_replay(t):
    """Old and new text rebuilt from the diff rows alone."""
    return by_pair(t, lambda pairs, whole: D.rebuilt_texts(D.diff_lines(pairs, whole=whole)))


@query("v3_approximate_diff", sql("SELECT pair_id, old, new FROM version_diffs", "version_diffs"))
def approximate_diff(t):
    """Old and new text rebuilt from the rows of the approximate walk."""
    return by_pair(t, lambda pairs, whole: D.rebuilt_texts(D.diff_lines(pairs, approximate=True, whole=whole)))


@query("v2_diff_lines")
def diff_lines(t):
    return by_pair(t, lambda pairs, whole: D.diff_lines(pairs))


@query("v5_unified_text")
def unified_text(t):
    return by_pair(t, lambda pairs, whole: D.unified_text(D.diff_lines(pairs, whole=whole)))


@query("w8_diff_line_numbers", sql("""
SELECT pair_id, max(len(string_split(old, chr(10)))) AS last_old, max(len(string_split(new, chr(10)))) AS last_new FROM version_diffs GROUP BY pair_id""", "version_diffs"))
def diff_line_numbers(t):
    return by_pair(t, lambda pairs, whole: D.last_numbers(D.numbered_lines(D.diff_lines(pairs, whole=whole))))


@query("v6_changed_line_sets", sql("""
SELECT pair_id, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS only_old,
  len(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))) AS only_new
FROM (SELECT pair_id, string_split(old, chr(10)) AS a, string_split(new, chr(10)) AS b FROM version_diffs)""", "version_diffs"))
def changed_sets(t):
    return by_pair(t, lambda pairs, whole: D.changed_line_sets(pairs))


@query("v6_changed_line_bags", sql("""
WITH u AS (SELECT pair_id, unnest(string_split(old, chr(10))) AS line, -1 AS n FROM version_diffs UNION ALL
  SELECT pair_id, unnest(string_split(new, chr(10))), 1 FROM version_diffs), g AS (SELECT pair_id, line, sum(n) AS n FROM u GROUP BY ALL)
SELECT pair_id, CAST(sum(greatest(-n, 0)) AS BIGINT) AS lost, CAST(sum(greatest(n, 0)) AS BIGINT) AS gained FROM g GROUP BY pair_id""", "version_diffs"))
def changed_bags(t):
    return by_pair(t, D.changed_line_bags)
