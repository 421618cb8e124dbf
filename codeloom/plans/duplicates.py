"""Queries: exact, path and near duplicates and their resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions.similarity import corpus_similarity, line_set, update_similarity, update_type
from codeloom.operators import duplicates as D, near_duplicates as ND
from codeloom.plans.registry import query
from codeloom.plans.sqltext import add_view, base_name, ext, sql, stem, strip
from codeloom.sources import views as V

add_view("hashed", "SELECT *, sha256(content) AS hash, length(content) AS size, len(string_split(content, chr(10))) AS lines FROM files",
         ["files"])
add_view("path_conflicts", """
SELECT project_id, lower(path) AS path, count(*) AS files, count(DISTINCT hash) AS contents FROM hashed
GROUP BY project_id, lower(path) HAVING count(DISTINCT hash) > 1""", ["hashed"])


def hashed(t):
    return D.hashed(V.files(t))


@query("d1_exact_groups", sql("""
SELECT hash, count(*) AS files, min(file_id) AS first_file, count(*) - 1 AS excess FROM hashed
GROUP BY hash HAVING count(*) > 1""", "hashed"))
def exact_groups(t):
    return D.exact_groups(hashed(t))


@query("d2_path_conflicts", sql("SELECT * FROM path_conflicts", "path_conflicts"))
def path_conflicts(t):
    return D.path_conflicts(hashed(t))


def _by_path(direction: str) -> str:
    return sql(f"""
SELECT file_id, project_id, path, content FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY file_id {direction}) AS rn FROM files) WHERE rn = 1""", "files")


@query("d3_latest", _by_path("DESC"))
def latest(t):
    return D.resolve_by_path(V.files(t), "latest").select("file_id", "project_id", "path", "content")


@query("d3_keep_first", _by_path("ASC"))
def keep_first(t):
    return D.resolve_by_path(V.files(t), "keep_first").select("file_id", "project_id", "path", "content")


@query("d3_merge_totals", sql("""
SELECT project_id, path, count(*) AS parts, CAST(sum(length(content)) AS BIGINT) AS size,
       CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines FROM files GROUP BY ALL""", "files"))
def merge_totals(t):
    return D.merge_totals(V.files(t))


@query("d3_merge_text", sql("""
SELECT project_id, path, piece, string_agg(content, chr(10) || chr(10) ORDER BY file_id) AS content
FROM (SELECT *, (row_number() OVER (PARTITION BY project_id, path ORDER BY file_id) - 1) // 64 AS piece FROM files) GROUP BY ALL""", "files"))
def merge_text(t):
    return D.merged_text(D.merge_parts(V.files(t)))


@query("d4_keep_both", sql(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY file_id) - 1 AS copy FROM files),
r AS (SELECT *, CASE WHEN copy = 0 THEN path ELSE substr(path, 1, length(path) - length({base_name('path')})) || {stem(base_name('path'))}
        || '_copy' || CAST(copy AS VARCHAR) || {ext(base_name('path'))} END AS new_path FROM n)
SELECT file_id, project_id, path AS original_path, copy, CASE WHEN copy > 0 AND EXISTS (
    SELECT 1 FROM files f WHERE f.project_id = r.project_id AND f.path = r.new_path)
  THEN regexp_replace(new_path, '\\.txt$', '_' || CAST(file_id AS VARCHAR) || '.txt') ELSE new_path END AS path FROM r""".replace("\\\\", "\\"), "files"))
def keep_both(t):
    return D.keep_both(V.files(t)).select("file_id", "project_id", "original_path", "copy", "path")


def _survivors(order: str) -> str:
    return sql(f"""
SELECT hash, file_id FROM (SELECT hash, file_id, row_number() OVER (PARTITION BY hash ORDER BY {order}) AS rn FROM hashed)
WHERE rn = 1""", "hashed")


@query("d6_survivors_latest", _survivors("ts DESC, file_id"))
def survivors_latest(t):
    return D.survivors(hashed(t), ["hash"], "latest")


@query("d6_survivors_largest", sql("""
SELECT project_id, path, file_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY size DESC, file_id) AS rn FROM hashed)
WHERE rn = 1""", "hashed"))
def survivors_largest(t):
    return D.survivors(hashed(t), ["project_id", "path"], "largest")


@query("d6_survivors_first", _survivors("file_id"))
def survivors_first(t):
    return D.survivors(hashed(t), ["hash"], "first")


_LOSERS = """losers AS (
  SELECT file_id FROM (SELECT file_id, row_number() OVER (PARTITION BY hash ORDER BY ts DESC, file_id) AS rn FROM hashed) WHERE rn > 1
  UNION SELECT file_id FROM (SELECT h.file_id, row_number() OVER (PARTITION BY h.project_id, lower(h.path) ORDER BY h.ts DESC, h.file_id) AS rn
    FROM hashed h JOIN path_conflicts c ON c.project_id = h.project_id AND c.path = lower(h.path)) WHERE rn > 1)"""


@query("d7_resolved_files", sql(f"""
WITH {_LOSERS} SELECT file_id, project_id, path, hash FROM hashed WHERE file_id NOT IN (SELECT file_id FROM losers)""", "path_conflicts"))
def resolved(t):
    h = hashed(t)
    return D.without_duplicates(h, D.losers(h)).select("file_id", "project_id", "path", "hash")


_STATS = """stats AS (SELECT * FROM (SELECT CAST(sum(n) AS BIGINT) AS total_files, CAST(sum(n - 1) AS BIGINT) AS exact_duplicates
    FROM (SELECT count(*) AS n FROM hashed GROUP BY hash)),
  (SELECT CAST(coalesce(sum(files - 1), 0) AS BIGINT) AS path_duplicates, count(*) AS path_groups FROM path_conflicts))"""


@query("d8_statistics", sql(f"WITH {_STATS} SELECT *, exact_duplicates + path_duplicates AS duplicate_files FROM stats", "path_conflicts"))
def statistics(t):
    return D.statistics(hashed(t))


@query("d8_recommendations", sql(f"""
WITH {_STATS} SELECT 'exact_duplicates' AS type, 'remove_duplicates' AS action, 'Found ' || CAST(exact_duplicates AS VARCHAR)
  || ' exact duplicate files. Consider removing them to reduce project size.' AS message FROM stats WHERE exact_duplicates > 0""", "path_conflicts"))
def recommendations(t):
    return D.recommendations(D.statistics(hashed(t)))


@query("d9_group_report", sql("""
SELECT 'exact' AS group_type, h.hash AS group_key, g.n AS count, h.path, h.size, h.lines, h.language, h.file_id
FROM hashed h JOIN (SELECT hash, count(*) AS n FROM hashed GROUP BY hash HAVING count(*) > 1) g ON g.hash = h.hash
UNION ALL SELECT 'path_conflict', h.project_id || '/' || lower(h.path), c.files, h.path, h.size, h.lines, h.language, h.file_id
FROM hashed h JOIN path_conflicts c ON c.project_id = h.project_id AND c.path = lower(h.path)""", "path_conflicts"))
def group_report(t):
    return D.group_report(hashed(t))


@query("d9_repeated_paths", sql(
    "SELECT project_id, path, count(*) AS count FROM files GROUP BY ALL HAVING count(*) > 1", "files"))
def repeated_paths(t):
    return D.repeated_paths(V.files(t))


_SEEN = "seen AS (SELECT sha256(text) AS hash FROM benchmark UNION ALL SELECT sha256(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def seen_hashes(t):
    """Hashes of earlier scans: the labelled documents and the benchmark texts."""
    labelled = t("documents").join(t("labels").select("doc_id"), "doc_id", "left_semi").select(F.sha2("text", 256).alias("hash"))
    return labelled.unionByName(t("benchmark").select(F.sha2("text", 256).alias("hash")))


@query("j5_seen_before", sql(f"""
WITH {_SEEN} SELECT file_id, hash, hash IN (SELECT hash FROM seen) AS previously_extracted FROM hashed""", "hashed"))
def seen_before(t):
    return D.seen_before(hashed(t), seen_hashes(t)).select("file_id", "hash", "previously_extracted")


@query("j5_only_new", sql(f"WITH {_SEEN} SELECT file_id, hash FROM hashed WHERE hash NOT IN (SELECT hash FROM seen)", "hashed"))
def only_new(t):
    return D.only_new(hashed(t), seen_hashes(t)).select("file_id", "hash")


_NEAR = f"""
WITH RECURSIVE l AS (SELECT DISTINCT file_id, {strip('x')} AS line FROM (SELECT file_id, unnest(string_split(content, chr(10))) AS x FROM files)),
n AS (SELECT file_id, count(*) AS n FROM l GROUP BY file_id),
p AS (SELECT a.file_id AS a, b.file_id AS b, count(*) AS shared FROM l a JOIN l b ON a.line = b.line AND a.file_id < b.file_id GROUP BY ALL),
e AS (SELECT p.a, p.b, shared / (na.n + nb.n - shared) AS similarity FROM p JOIN n na ON na.file_id = a JOIN n nb ON nb.file_id = b
      JOIN hashed ha ON ha.file_id = a JOIN hashed hb ON hb.file_id = b
      WHERE shared / (na.n + nb.n - shared) >= 0.85 AND shared < na.n + nb.n - shared
        AND abs(ha.lines - hb.lines) <= greatest(ha.lines, hb.lines) * 0.5),
ids AS (SELECT id, row_number() OVER (ORDER BY id) AS rn, (SELECT list(e.a) FROM e WHERE e.b = id) AS earlier
        FROM (SELECT a AS id FROM e UNION SELECT b FROM e)),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS seeds
  UNION ALL SELECT ids.rn, CASE WHEN earlier IS NOT NULL AND list_has_any(seeds, earlier) THEN seeds ELSE list_append(seeds, ids.id) END
  FROM walk JOIN ids ON ids.rn = walk.i + 1),
s AS (SELECT unnest(seeds) AS seed FROM walk WHERE i = (SELECT max(i) FROM walk)),
m AS (SELECT min(e.a) AS group_id, e.b AS file_id FROM e JOIN s ON s.seed = e.a WHERE e.b NOT IN (SELECT seed FROM s) GROUP BY e.b),
members AS (SELECT m.group_id, m.file_id, round(e.similarity, 6) AS similarity FROM m JOIN e ON e.a = m.group_id AND e.b = m.file_id
  UNION ALL SELECT DISTINCT group_id, group_id, NULL FROM m)
"""


@query("j6_d5_near_duplicate_members", sql(_NEAR + "SELECT * FROM members", "hashed"))
def near_members(t):
    return ND.near_duplicate_members(V.files(t)).withColumn("similarity", F.round("similarity", 6))


@query("d5_near_duplicate_groups", sql(_NEAR + """
SELECT group_id, count(*) AS files, arg_min(similarity, file_id) FILTER (similarity IS NOT NULL) AS similarity FROM members GROUP BY group_id""", "hashed"))
def near_groups(t):
    return ND.near_duplicate_groups(near_members(t))


# --- similarity of neighbouring documents --------------------------------------------
_PAIRS = """pairs AS (SELECT f.file_id, f.content AS new, g.content AS old FROM files f JOIN files g ON g.file_id = f.file_id - 20)"""
_old, _new = "string_split(old, chr(10))", "string_split(new, chr(10))"


def _set(x: str, keep_blank: bool) -> str:
    trimmed = f"list_transform({x}, lambda y: {strip('y')})"
    return f"list_distinct({trimmed if keep_blank else f'list_filter({trimmed}, lambda y: length(y) > 0)'})"


def pairs(t):
    """Each document with its predecessor of the same source."""
    f = V.files(t).select("file_id", F.col("content").alias("new"))
    g = V.files(t).select((F.col("file_id") + 20).alias("file_id"), F.col("content").alias("old"))
    return f.join(g, "file_id")


@query("f20_corpus_similarity", sql(f"""
WITH {_PAIRS} SELECT file_id, round(CASE WHEN old = new THEN 1.0 WHEN old = '' OR new = '' THEN 0.0
  WHEN abs(len({_old}) - len({_new})) > greatest(len({_old}), len({_new})) * 0.5 THEN 0.0
  ELSE len(list_intersect({_set(_old, True)}, {_set(_new, True)})) / len(list_distinct(list_concat({_set(_old, True)}, {_set(_new, True)}))) END, 6) AS similarity
FROM pairs""", "files"))
def f20(t):
    return pairs(t).select("file_id", F.round(corpus_similarity("old", "new"), 6).alias("similarity"))


_SIM_B = f"""CASE WHEN old = '' OR new = '' THEN 0.0 WHEN old = new THEN 1.0
  WHEN len({_set(_old, False)}) = 0 AND len({_set(_new, False)}) = 0 THEN 1.0
  WHEN len({_set(_old, False)}) = 0 OR len({_set(_new, False)}) = 0 THEN 0.0
  ELSE len(list_intersect({_set(_old, False)}, {_set(_new, False)})) / greatest(len({_set(_old, False)}), len({_set(_new, False)})) END"""
UPDATE_TYPE = f"""CASE WHEN old = '' OR new = '' THEN 'REPLACEMENT'
  WHEN starts_with(new, old) AND length(new) > length(old) THEN 'EXTENSION'
  WHEN starts_with(old, new) AND length(old) > length(new) THEN 'MODIFICATION'
  WHEN {_SIM_B} > 0.5 THEN 'MODIFICATION' WHEN {_SIM_B} > 0.2 THEN 'REPLACEMENT' ELSE 'UNRELATED' END"""


@query("f21_update_similarity", sql(f"WITH {_PAIRS} SELECT file_id, round({_SIM_B}, 6) AS similarity FROM pairs", "files"))
def f21(t):
    return pairs(t).select("file_id", F.round(update_similarity("old", "new"), 6).alias("similarity"))


@query("f23_update_types", sql(f"""
WITH {_PAIRS}, v AS (SELECT file_id, 'a' AS kind, old, new FROM pairs UNION ALL SELECT file_id, 'b', old, old || new FROM pairs
  UNION ALL SELECT file_id, 'c', old || new, old FROM pairs UNION ALL SELECT file_id, 'd', old, replace(old, chr(10), ' x' || chr(10)) || new FROM pairs)
SELECT file_id, kind, {UPDATE_TYPE} AS update_type FROM v""", "files"))
def f23(t):
    p = pairs(t)
    def variant(kind, old, new):
        return F.struct(F.lit(kind).alias("kind"), old.alias("o"), new.alias("n"))

    old, new = F.col("old"), F.col("new")
    v = p.select("file_id", F.inline(F.array(
        variant("a", old, new), variant("b", old, F.concat(old, new)), variant("c", F.concat(old, new), old),
        variant("d", old, F.concat(F.replace(old, F.lit("\n"), F.lit(" x\n")), new)))))
    return v.select("file_id", "kind", update_type("o", "n").alias("update_type"))


@query("u4_line_sets", sql(f"""
WITH {_PAIRS} SELECT file_id, len(list_intersect({_set(_old, True)}, {_set(_new, True)})) AS shared,
  len(list_distinct(list_concat({_set(_old, True)}, {_set(_new, True)}))) AS united FROM pairs""", "files"))
def u4(t):
    a, b = line_set("old"), line_set("new")
    return pairs(t).select("file_id", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_union(a, b)).alias("united"))
