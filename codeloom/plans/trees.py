"""Queries: directory trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import analytics as A, names as N, trees as T
from codeloom.plans.analytics import stored
from codeloom.plans.naming import code_files, named
from codeloom.plans.registry import query
from codeloom.plans.sqltext import add_view, base_name, q, sql, strip, sub
from codeloom.sources import views as V

add_view("tree_lines", f"""
WITH l AS (SELECT block_id AS text_id, i - 1 AS pos, t[i] AS line FROM (SELECT block_id, string_split(code, chr(10)) AS t FROM code_blocks),
  LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i) WHERE regexp_matches(t[i], {q(T.BOX)})),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY text_id ORDER BY pos) AS run FROM l),
n AS (SELECT *, count(*) OVER (PARTITION BY text_id, run) AS n FROM r)
SELECT text_id, dense_rank() OVER (PARTITION BY text_id ORDER BY run) - 1 AS tree_id, pos, line FROM n WHERE n >= 2""", ["code_blocks"])
_pieces = r"regexp_extract_all(line, '[\s\S]{1,4}')"
_flags = f"list_transform({_pieces}, lambda p: regexp_matches(p, '[{T.CHARS} ]'))"
add_view("tree_entries", rf"""
SELECT *, row_number() OVER (PARTITION BY text_id, tree_id ORDER BY pos) AS i FROM (
  SELECT text_id, tree_id, pos, coalesce(list_position({_flags}, false) - 1, len({_flags})) AS depth, {strip(sub('line', T.NAME_PREFIX))} AS name FROM tree_lines)
WHERE name <> ''""", ["tree_lines"])
# parent of a line: nearest earlier line of smaller depth
add_view("tree_nodes", """
SELECT n.text_id, n.tree_id, n.i, n.pos, n.depth, n.name, n.name AS path, CAST(1 AS BIGINT) AS level FROM tree_entries n
WHERE NOT EXISTS (SELECT 1 FROM tree_entries p WHERE p.text_id = n.text_id AND p.tree_id = n.tree_id AND p.i < n.i AND p.depth < n.depth)
UNION ALL SELECT c.text_id, c.tree_id, c.i, c.pos, c.depth, c.name, t.path || '/' || c.name, t.level + 1 FROM tree_nodes t JOIN (
  SELECT n.*, (SELECT max(p.i) FROM tree_entries p WHERE p.text_id = n.text_id AND p.tree_id = n.tree_id AND p.i < n.i AND p.depth < n.depth) AS parent FROM tree_entries n) c
ON c.text_id = t.text_id AND c.tree_id = t.tree_id AND c.parent = t.i""", ["tree_entries"], recursive=True)
add_view("tree_leaves", """
SELECT *, coalesce(lead(depth) OVER (PARTITION BY text_id, tree_id ORDER BY i) <= depth, true) AS is_leaf FROM tree_nodes""", ["tree_nodes"])


def texts(t):
    return V.code_blocks(t).select(F.col("block_id").alias("text_id"), F.col("code").alias("text"))


@query("s9_tree_lines", sql("SELECT * FROM tree_lines", "tree_lines"))
def tree_lines(t):
    return T.tree_lines(texts(t))


@query("w3_tree_depth", sql("SELECT text_id, tree_id, pos, depth, name FROM tree_entries", "tree_entries"))
def tree_depth(t):
    return T.tree_lines(texts(t)).select("text_id", "tree_id", "pos", T.depth("line").alias("depth"), T.name("line").alias("name")).where("name <> ''")


@query("w4_tree_nodes", sql("SELECT text_id, tree_id, pos, depth, name, path, level, is_leaf FROM tree_leaves", "tree_leaves"))
def tree_nodes(t):
    return T.tree_nodes(T.tree_lines(texts(t)))


@query("w4_tree_summary", sql("""
SELECT text_id, tree_id, count(*) FILTER (is_leaf) AS files, count(*) FILTER (NOT is_leaf) AS directories, max(level) AS depth FROM tree_leaves GROUP BY ALL""", "tree_leaves"))
def tree_summary(t):
    return T.tree_summary(T.tree_nodes(T.tree_lines(texts(t))))


_P = r"'^([│├└─|\s\-]*)(.+)$'"
add_view("indent_lines", rf"""
SELECT page_id, block_index, row_number() OVER (PARTITION BY page_id, block_index ORDER BY i) AS i, length(regexp_extract(x, {_P}, 1)) AS level,
  {strip(f'regexp_extract(x, {_P}, 2)')} AS name FROM (
  SELECT page_id, block_index, i, t[i] AS x FROM (SELECT page_id, block_index, string_split(code, chr(10)) AS t FROM code_blocks
    WHERE contains(code, '├──') OR contains(code, '└──') OR regexp_matches(code, '(?:^|\n)\s*\|-\s+')), LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i))
WHERE {strip('x')} <> ''""", ["code_blocks"])
add_view("indent_walk", rf"""
SELECT DISTINCT page_id, block_index, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(l BIGINT, p VARCHAR)[]) AS stack, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS path FROM indent_lines
UNION ALL SELECT n.page_id, n.block_index, n.i, CASE WHEN dir THEN list_append(open, {{'l': n.level, 'p': p}}) ELSE open END,
  CASE WHEN dir THEN NULL ELSE bare END, CASE WHEN dir THEN NULL ELSE p END
FROM indent_walk w JOIN indent_lines n ON n.page_id = w.page_id AND n.block_index = w.block_index AND n.i = w.i + 1,
LATERAL (SELECT list_filter(w.stack, lambda s: s.l < n.level) AS open, {strip("regexp_replace(n.name, '/$', '')")} AS bare),
LATERAL (SELECT CASE WHEN len(open) = 0 OR open[-1].p = '' THEN bare ELSE open[-1].p || '/' || bare END AS p, ends_with(n.name, '/') OR NOT contains(bare, '.') AS dir)""",
         ["indent_lines"], recursive=True)
add_view("tree_paths", """
SELECT page_id, name, arg_max(path, (block_index, i)) AS path FROM indent_walk WHERE name IS NOT NULL GROUP BY ALL""", ["indent_walk"])


@query("j2_project_tree_paths", sql("SELECT * FROM tree_paths", "tree_paths"))
def tree_paths(t):
    p = T.project_tree_paths(V.code_blocks(t))
    return p.groupBy("page_id", "name").agg(F.max_by("path", "pos").alias("path"))


@query("j2_names_with_tree_paths", sql("""
SELECT b.block_id, CASE WHEN contains(b.file_name, '/') OR t.path IS NULL THEN b.file_name ELSE
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(t.path, '[<>:"\\\\|?*\\x00-\\x1F]', '_', 'g'), '^\\.+|\\.+$', '', 'g'), '[ \\t\\n\\r]+', '_', 'g'), '_{2,}', '_', 'g') END AS file_name
FROM unique_blocks b LEFT JOIN tree_paths t ON t.page_id = b.page_id AND t.name = b.file_name""".replace("\\\\", "\\"), "unique_blocks", "tree_paths"))
def names_with_tree_paths(t):
    return N.with_tree_paths(N.unique_names(named(t)), T.project_tree_paths(V.code_blocks(t))).select("block_id", "file_name")


# each node: prefixes of paths; order and connectors from the first arrival below it
add_view("drawn", f"""
WITH pre AS (SELECT project_id, file_id, path, string_split(path, '/') AS parts FROM stored),
x AS (SELECT project_id, file_id, array_to_string(parts[1:i], '/') AS node, i, len(parts) AS n FROM pre, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
n AS (SELECT project_id, node, min(file_id) AS arrival, min(i) AS level, bool_or(i < n) AS is_dir, regexp_replace(node, '/?[^/]*$', '') AS parent FROM x GROUP BY project_id, node),
m AS (SELECT *, row_number() OVER (PARTITION BY project_id, parent ORDER BY arrival DESC, node DESC) = 1 AS is_last FROM n)
SELECT m.project_id, m.node, m.level, m.is_dir, list(a.is_last ORDER BY a.level) AS lasts, list((a.arrival, a.node) ORDER BY a.level) AS keys
FROM m JOIN m a ON a.project_id = m.project_id AND (a.node = m.node OR starts_with(m.node, a.node || '/')) GROUP BY ALL""", ["stored"])
_LINE = f"""array_to_string(list_transform(lasts[1:len(lasts) - 1], lambda b: CASE WHEN b THEN '    ' ELSE '│   ' END), '')
  || CASE WHEN lasts[-1] THEN '└── ' ELSE '├── ' END || {base_name('node')} || CASE WHEN is_dir THEN '/' ELSE '' END"""


@query("e4_drawn_trees", sql(f"""SELECT project_id, node, array_to_string(list_transform(keys, lambda k: lpad(CAST(k[1] AS VARCHAR), 19, '0') || k[2]), chr(1)) AS sort_key,
  {_LINE} AS line FROM drawn""", "drawn"))
def drawn_trees(t):
    """A row for each line; in the order of sort_key they are a project's tree."""
    return T.drawn_tree(stored(t))


@query("a2_scan_summary", sql("""
WITH b AS (SELECT page_id, count(*) AS total_blocks, count(DISTINCT sha256(code)) AS unique_files, count(*) - count(DISTINCT sha256(code)) AS duplicates FROM code_blocks GROUP BY page_id),
f AS (SELECT page_id, count(*) AS total_files, CAST(sum(length(content)) AS BIGINT) AS total_size, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS total_lines FROM code_files GROUP BY page_id),
t AS (SELECT text_id // 8 AS page_id, count(DISTINCT (text_id, tree_id)) AS trees FROM tree_lines GROUP BY 1)
SELECT b.*, total_files, total_size, total_lines, coalesce(trees, 0) AS trees FROM b LEFT JOIN f ON f.page_id = b.page_id LEFT JOIN t ON t.page_id = b.page_id""", "code_files", "tree_lines"))
def scan_summary(t):
    trees = T.tree_lines(texts(t)).select(F.floor(F.col("text_id") / 8).alias("page_id"), "text_id", "tree_id").distinct()
    return A.scan_summary(V.code_blocks(t), code_files(t), trees)
