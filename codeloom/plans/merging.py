"""Queries: merges, conflicts, replicas, templates, teams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import html as H
from codeloom.operators import blocks as B, merging as M, teams as T, template_feed as TF
from codeloom.plans.duplicates import UPDATE_TYPE
from codeloom.plans.naming import code_files, typed
from codeloom.plans.registry import query
from codeloom.plans.sqltext import add_view, base_name, ext, q, sql, stem, strip
from codeloom.rules.sites import SITES, SiteRule
from codeloom.rules.templates import TEMPLATES
from codeloom.sources import views as V

_last = """SELECT * FROM (SELECT *, lower(path) AS path_key, row_number() OVER (PARTITION BY project_id, lower(path) ORDER BY file_id DESC) AS rn
  FROM files WHERE file_id {} (SELECT doc_id FROM labels)) WHERE rn = 1"""
add_view("merged", f"""
SELECT project_id, path_key, path, old AS old_content, new AS new_content, CASE WHEN both_sides AND old <> new THEN ut END AS update_type,
       CASE WHEN old_file IS NULL THEN 'added' WHEN new_file IS NULL THEN 'kept' WHEN old = new THEN 'unchanged'
            WHEN ut = 'UNRELATED' THEN 'conflict' ELSE 'updated' END AS status
FROM (SELECT *, old_file IS NOT NULL AND new_file IS NOT NULL AS both_sides, {UPDATE_TYPE} AS ut FROM (
  SELECT coalesce(o.project_id, n.project_id) AS project_id, coalesce(o.path_key, n.path_key) AS path_key,
         coalesce(o.path, n.path) AS path, o.content AS old, n.content AS new, o.file_id AS old_file, n.file_id AS new_file
  FROM ({_last.format('IN')}) o FULL JOIN ({_last.format('NOT IN')}) n ON o.project_id = n.project_id AND o.path_key = n.path_key))""", ["files"])


def merged(t):
    """Labelled documents are what is there, the others come in."""
    f, labelled = V.files(t), t("labels").select(F.col("doc_id").alias("file_id"))
    return M.merge(f.join(labelled, "file_id", "left_semi"), f.join(labelled, "file_id", "left_anti"))


@query("j4_incremental_merge", sql("SELECT project_id, path_key, path, status, update_type FROM merged", "merged"))
def merge_status(t):
    return merged(t).select("project_id", "path_key", "path", "status", "update_type")


@query("j4_merged_files", sql("""
SELECT project_id, path, status, content, length(content) AS size, len(string_split(content, chr(10))) AS lines FROM (
  SELECT project_id, path, status, CASE WHEN status IN ('added', 'updated') THEN new_content ELSE old_content END AS content FROM merged)""", "merged"))
def merged_files(t):
    return M.merged_files(merged(t))


@query("a22_merge_summary", sql("""
SELECT project_id, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'updated') AS updated,
  count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'conflict') AS conflict,
  count(*) FILTER (status = 'kept') AS kept FROM merged GROUP BY project_id""", "merged"))
def merge_summary(t):
    return M.merge_summary(merged(t))


@query("a22_recomputed_totals", sql("""
SELECT project_id, count(*) AS total_files, CAST(sum(length(c)) AS BIGINT) AS total_size, CAST(sum(len(string_split(c, chr(10)))) AS BIGINT) AS total_lines
FROM (SELECT project_id, CASE WHEN status IN ('added', 'updated') THEN new_content ELSE old_content END AS c FROM merged) GROUP BY project_id""", "merged"))
def recomputed(t):
    return M.merged_files(merged(t)).groupBy("project_id").agg(
        F.count("*").alias("total_files"), F.sum("size").alias("total_size"), F.sum("lines").alias("total_lines"))


_CHOICES = ["KEEP_OLD", "USE_NEW", "KEEP_BOTH", "RENAME_NEW"]


@query("d10_resolved_conflicts", sql(f"""
WITH d AS (SELECT source AS project_id, lower(lang || '/Doc_' || CAST(doc_id // 200 AS VARCHAR) || '.txt') AS path_key,
    (['KEEP_OLD', 'USE_NEW', 'KEEP_BOTH', 'RENAME_NEW', 'OTHER'])[max(n_chars) % 5 + 1] AS resolution FROM documents GROUP BY ALL),
r AS (SELECT m.*, CASE WHEN resolution IN ('USE_NEW', 'KEEP_BOTH', 'RENAME_NEW') THEN lower(resolution) ELSE 'keep_old' END AS action
  FROM merged m LEFT JOIN d ON d.project_id = m.project_id AND d.path_key = m.path_key WHERE status = 'conflict')
SELECT project_id, path_key, action, CASE WHEN action = 'rename_new' THEN regexp_replace(path, '\\.txt$', '_v2.txt') ELSE path END AS path,
  CASE WHEN action IN ('use_new', 'rename_new') THEN new_content WHEN action = 'keep_both' THEN old_content || chr(10) || chr(10) || new_content ELSE old_content END AS content
FROM r""".replace("\\\\", "\\"), "merged"))
def resolved_conflicts(t):
    choices = F.array(*[F.lit(c) for c in [*_CHOICES, "OTHER"]])
    decisions = t("documents").groupBy(
        F.col("source").alias("project_id"),
        F.lower(F.concat(F.col("lang"), F.lit("/Doc_"), F.floor(F.col("doc_id") / 200).cast("string"), F.lit(".txt"))).alias("path_key")
    ).agg(F.element_at(choices, (F.max("n_chars") % 5 + 1).cast("int")).alias("resolution"))
    return M.resolve_conflicts(merged(t).where("status = 'conflict'"), decisions).select(
        "project_id", "path_key", "action", "path", "content")


@query("d11_merged_split_blocks", sql(f"""
WITH RECURSIVE b AS (SELECT page_id, block_index, file_name, language, code AS content FROM typed_blocks),
fold AS (SELECT page_id, block_index, block_index AS head, file_name, language, content, CAST(1 AS BIGINT) AS parts FROM b WHERE block_index = 0
  UNION ALL SELECT b.page_id, b.block_index, CASE WHEN j THEN f.head ELSE b.block_index END, CASE WHEN j THEN f.file_name ELSE b.file_name END,
    CASE WHEN j THEN f.language ELSE b.language END, CASE WHEN j THEN f.content || chr(10) || b.content ELSE b.content END,
    CASE WHEN j THEN f.parts + 1 ELSE 1 END
  FROM fold f JOIN b ON b.page_id = f.page_id AND b.block_index = f.block_index + 1, LATERAL (SELECT f.file_name = b.file_name OR (
    {strip('f.content')} <> '' AND NOT ends_with({strip('f.content')}, '}}') AND NOT ends_with({strip('f.content')}, ';')
    AND NOT starts_with({strip('b.content')}, 'import') AND NOT starts_with({strip('b.content')}, 'class')
    AND NOT starts_with({strip('b.content')}, 'function') AND NOT starts_with({strip('b.content')}, '//')
    AND NOT starts_with({strip('b.content')}, '/*') AND f.language = b.language) AS j))
SELECT page_id, head AS block_index, file_name, language, content, parts, octet_length(encode(content)) AS size, len(string_split(content, chr(10))) AS lines
FROM (SELECT *, row_number() OVER (PARTITION BY page_id, head ORDER BY block_index DESC) AS rn FROM fold) WHERE rn = 1""", "typed_blocks"))
def split_blocks(t):
    return M.merge_split_blocks(typed(t).withColumnRenamed("code", "content"))


@query("u1_merged_sources", sql("""
SELECT path_key, file_id, project_id, content, copies, length(content) AS size FROM (
  SELECT *, lower(path) AS path_key, count(*) OVER (PARTITION BY lower(path)) AS copies,
    row_number() OVER (PARTITION BY lower(path) ORDER BY ts DESC, project_id, file_id) AS rn FROM files) WHERE rn = 1""", "files"))
def merge_sources(t):
    return M.merge_sources(V.files(t)).select("path_key", "file_id", "project_id", "content", "copies", "size")


@query("u1_contributing_sources", sql("SELECT DISTINCT lower(path) AS path_key, project_id FROM files", "files"))
def sources(t):
    return M.contributing_sources(V.files(t))


@query("u1_merged_totals", sql("""
SELECT count(*) AS total_files, CAST(sum(length(content)) AS BIGINT) AS total_size, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS total_lines
FROM (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY ts DESC, project_id, file_id) AS rn FROM files) WHERE rn = 1""", "files"))
def merged_totals(t):
    return M.merge_sources(V.files(t)).agg(
        F.count("*").alias("total_files"), F.sum("size").alias("total_size"), F.sum("lines").alias("total_lines"))


@query("j9_reconciled_replicas", """
WITH l AS (SELECT user_id AS id, max(ts) AS u FROM events WHERE event_id % 2 = 0 GROUP BY 1),
     r AS (SELECT user_id AS id, max(ts) AS u FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(l.id, r.id) AS id, CASE WHEN r.id IS NULL OR l.u > r.u THEN 'pushed' WHEN l.id IS NULL OR r.u > l.u THEN 'pulled'
  ELSE 'conflict' END AS direction FROM l FULL JOIN r ON l.id = r.id""")
def reconcile(t):
    return M.reconcile(*V.replicas(t))


@query("j3_attached_content", sql(f"""
WITH c AS (SELECT *, {base_name('path')} AS name FROM code_files),
l AS (SELECT page_id, block_id, CASE WHEN block_index >= 4 THEN 'moved/' || {base_name('path')} ELSE path END AS path, {base_name('path')} AS name FROM code_files)
SELECT l.page_id, l.block_id, l.path, coalesce(
  (SELECT arg_min(c.block_id, c.block_index) FROM c WHERE c.page_id = l.page_id AND c.path = l.path),
  (SELECT arg_min(c.block_id, c.block_index) FROM c WHERE c.page_id = l.page_id AND c.name = l.name)) AS content_block FROM l""", "code_files"))
def attached(t):
    files = code_files(t)
    listing = files.select("page_id", "block_id", F.when(
        F.col("block_index") >= 4, F.concat(F.lit("moved/"), "name")).otherwise(F.col("path")).alias("path"), "name")
    return M.attach_content(listing, files).select("page_id", "block_id", "path", "content_block")


# --- retention of projects -------------------------------------------------------------
@query("j11_cascade_delete", sql("""
WITH old AS (SELECT project_id FROM projects WHERE created_at < TIMESTAMP '2024-01-01 01:00:00')
SELECT p.project_id, b.block_index FROM projects p LEFT JOIN prose_blocks b ON b.page_id = p.project_id
WHERE p.project_id NOT IN (SELECT project_id FROM old)""", "projects", "prose_blocks"))
def cascade(t):
    from codeloom.operators.lookups import cascade_delete
    children = B.extract_prose_blocks(t.spread("pages")).select(F.col("page_id").alias("project_id"), "block_index")
    kept, kept_children = cascade_delete(V.projects(t).select("project_id", "created_at"), children,
                                         F.timestamp_seconds(F.lit(V.EPOCH + 3600)))
    return kept.join(kept_children, "project_id", "left").select("project_id", "block_index")


# --- templates -----------------------------------------------------------------------
_TPL = ",\n".join(f"({q(x.id)}, {q(p)}, {q(lang)}, {q(c)})" for x in TEMPLATES for p, lang, c in x.files)
_IDS = "[" + ", ".join(q(x.id) for x in TEMPLATES) + "]"


def template_requests(t):
    """One project per document, asking for the templates in turn."""
    ids = F.array(*[F.lit(x.id) for x in TEMPLATES])
    return t("documents").select(F.col("doc_id").alias("project_id"),
                                 F.element_at(ids, (F.col("doc_id") % len(TEMPLATES) + 1).cast("int")).alias("template_id"))


@query("j12_instantiated_templates", f"""
WITH tpl AS (SELECT * FROM (VALUES {_TPL}) v(template_id, path, language, content)),
req AS (SELECT doc_id AS project_id, ({_IDS})[doc_id % {len(TEMPLATES)} + 1] AS template_id, text FROM documents)
SELECT r.project_id, r.template_id, path, language, CASE WHEN path = 'README.md' AND text <> '' THEN text ELSE content END AS content
FROM req r JOIN tpl ON tpl.template_id = r.template_id""")
def instantiated(t):
    overrides = t("documents").select(F.col("doc_id").alias("project_id"), F.lit("README.md").alias("path"), F.col("text").alias("content"))
    return T.instantiate(template_requests(t), T.template_rows(t.spark), overrides).select(
        "project_id", "template_id", "path", "language", "content")


def own_templates(t):
    """Templates users made of their sources: one per source, a file per language."""
    f = t("documents").groupBy("source", "lang").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    return f.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(
        F.concat("lang", F.lit(".txt")).alias("path"), F.col("lang").alias("language"), F.col("n").cast("string").alias("content")))).alias("files")
    ).select(F.concat(F.lit("custom_"), "source").alias("id"), F.concat(F.lit("Own "), "source").alias("name"),
             F.lit("made by hand").alias("description"), F.lit("custom").alias("category"), F.lit("text").alias("language"),
             F.array(F.lit("custom"), F.col("source")).alias("tags"), "files")


add_view("templates", f"""
SELECT id, name, description, category, language, tags, false AS is_custom FROM (VALUES {', '.join(
    f"({q(x.id)}, {q(x.name)}, {q(x.description)}, {q(x.category)}, {q(x.language)}, [{', '.join(q(g) for g in x.tags)}])" for x in TEMPLATES)})
  v(id, name, description, category, language, tags)
UNION ALL SELECT DISTINCT 'custom_' || source, 'Own ' || source, 'made by hand', 'custom', 'text', ['custom', source], true FROM documents""", [])


@query("p13_template_filters", sql("""
SELECT 'category' AS filter, id FROM templates WHERE category = 'web' UNION ALL
SELECT 'language', id FROM templates WHERE language = 'text' UNION ALL
SELECT 'tag', id FROM templates WHERE list_contains(tags, 'custom') UNION ALL
SELECT 'text', id FROM templates WHERE contains(lower(name), 'src1') OR contains(lower(description), 'src1') OR contains(lower(category), 'src1')
  OR contains(lower(language), 'src1') OR len(list_filter(tags, lambda x: contains(lower(x), 'src1'))) > 0""", "templates"))
def template_filters(t):
    all_templates = T.template_rows(t.spark, own_templates(t))
    parts = [("category", dict(category="web")), ("language", dict(language="Text")), ("tag", dict(tag="custom")), ("text", dict(text="SRC1"))]
    out = None
    for name, kw in parts:
        part = T.search_templates(all_templates, **kw).select(F.lit(name).alias("filter"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("a16_template_stats", sql("""
SELECT category, language, count(*) AS templates, count(*) FILTER (is_custom) AS custom FROM templates
GROUP BY GROUPING SETS ((category), (language), ())""", "templates"))
def template_stats(t):
    return T.template_stats(T.template_rows(t.spark, own_templates(t)))


@query("u3_all_templates", sql("SELECT id, name, category, is_custom FROM templates", "templates"))
def all_templates(t):
    return T.template_rows(t.spark, own_templates(t)).select("id", "name", "category", "is_custom")


# --- teams and deployments ---------------------------------------------------------------
@query("j10_resolved_invites", """
SELECT o.o_orderkey AS invite_id, c.c_custkey AS team_id, c.c_name AS team_name, o.o_orderkey % 25 AS user_id,
  o.o_orderkey % 25 = c.c_nationkey AS already_member,
  CASE WHEN o.o_orderkey % 25 = c.c_nationkey AND c.c_mktsegment = 'BUILDING' THEN 'owner' ELSE 'member' END AS role
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
WHERE o.o_orderstatus = 'P' AND o.o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1996-01-01'""")
def invites(t):
    o = t("orders").select(
        F.col("o_orderkey").alias("invite_id"), F.col("o_custkey").alias("team_id"), (F.col("o_orderkey") % 25).alias("user_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit("pending")).otherwise(F.lit("used")).alias("status"),
        (F.col("o_orderdate") + F.expr("INTERVAL 90 DAY")).alias("expires_at"))
    c = t("customer")
    teams = c.select(F.col("c_custkey").alias("team_id"), F.col("c_name").alias("team_name"))
    members = c.select(F.col("c_custkey").alias("team_id"), F.col("c_nationkey").cast("bigint").alias("user_id"), F.when(
        F.col("c_mktsegment") == "BUILDING", F.lit("owner")).otherwise(F.lit("member")).alias("role"))
    return T.resolve_invites(o, teams, members, F.lit("1996-01-01").cast("timestamp_ntz")).select(
        "invite_id", "team_id", "team_name", "user_id", "already_member", "role")


@query("a24_attribution", """
SELECT d.source AS project_id, e.user_id, count(*) AS contributions, count(DISTINCT e.event_type) AS kinds,
  strftime(min(e.ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(e.ts), '%Y-%m-%d %H:%M:%S') AS last_at
FROM events e JOIN documents d ON d.doc_id = e.event_id GROUP BY ALL""")
def attribution(t):
    c = t("events").join(t("documents").select(F.col("doc_id").alias("event_id"), F.col("source").alias("project_id")), "event_id")
    a = T.attribution(c.withColumnRenamed("event_type", "type"))
    return a.withColumn("first_at", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss")).withColumn(
        "last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@query("a24_member_roles", """
SELECT c_custkey % 100 AS team_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'owner' ELSE 'member' END AS role, count(*) AS members
FROM customer GROUP BY ALL""")
def member_roles(t):
    return T.member_roles(t("customer").select((F.col("c_custkey") % 100).alias("team_id"), F.when(
        F.col("c_mktsegment") == "BUILDING", F.lit("owner")).otherwise(F.lit("member")).alias("role")))


def deployments(t):
    return t("orders").select(
        F.col("o_orderkey").alias("deployment_id"), F.col("o_orderpriority").alias("provider"), F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderstatus") == "F", F.lit("success")).when(F.col("o_orderstatus") == "P", F.lit("deployed"))
        .otherwise(F.lit("failed")).alias("status"))


@query("a17_deployment_stats", """
SELECT o_orderpriority AS provider, count(*) AS total, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS success,
  count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS failed,
  CAST(round(count(*) FILTER (o_orderstatus IN ('F', 'P')) / count(*) * 100) AS BIGINT) AS success_rate
FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def deployment_stats(t):
    return T.deployment_stats(deployments(t))


@query("t5_newest_deployments", """
SELECT o_orderkey AS deployment_id, o_orderpriority AS provider FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def newest_deployments(t):
    return T.newest_first(deployments(t), "ts", "deployment_id", 100).select("deployment_id", "provider")


# --- user-made site rules ------------------------------------------------------------------
@query("x1_own_site_rules", """
SELECT page_id, CASE WHEN regexp_matches(url, 'example[.]org') THEN 'Own' WHEN regexp_matches(url, '^http:') THEN 'Plain' ELSE 'Generic' END AS site
FROM pages""")
def own_rules(t):
    from codeloom.rules.sites import with_rules
    rules = with_rules(SiteRule("Plain", "^http:"), SiteRule("Own", "example[.]org"))
    assert rules[2:] == SITES
    return B.route_sites(t("pages"), rules).select("page_id", "site")


@query("x2_site_rule_findings", """
WITH r AS (SELECT page_id AS rule_id, regexp_extract(url, '/([a-z]{2})/[0-9]+$', 1) AS name, CASE WHEN starts_with(url, 'https') THEN url ELSE '' END AS domain,
  page_id % 3 AS n FROM pages)
SELECT rule_id, 'Parser name is required' AS message FROM r WHERE name = '' UNION ALL
SELECT rule_id, 'Domain is required' FROM r WHERE domain = '' UNION ALL
SELECT rule_id, 'At least one selector is required' FROM r WHERE n = 0""")
def rule_findings(t):
    rules = t("pages").select(
        F.col("page_id").alias("rule_id"), F.regexp_extract("url", "/([a-z]{2})/[0-9]+$", 1).alias("name"),
        F.when(F.col("url").startswith("https"), F.col("url")).otherwise(F.lit("")).alias("domain"),
        F.slice(F.array(F.lit("pre"), F.lit("code")), F.lit(1), (F.col("page_id") % 3).cast("int")).alias("selectors"))
    return T.validate_site_rules(rules)


# --- users' templates as a feed of changes --------------------------------------------------------
def template_changes(t):
    """Every event changes the template of its user: signups and purchases add it, errors delete it, others change it."""
    kind = F.when(F.col("event_type").isin("signup", "purchase"), F.lit("add")).when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("change"))
    return t("events").select(
        F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("custom_"), F.col("user_id").cast("string")).alias("id"),
        F.when(kind != "change", F.concat(F.lit("Template "), F.col("event_id").cast("string"))).alias("name"),
        F.when(F.col("event_type") != "click", F.col("props")).alias("description"), F.when(F.col("value") > 50, F.lit("web")).alias("category"),
        F.lit(None).cast("string").alias("language"), F.when(F.col("event_type") == "view", F.array("event_type")).alias("tags"),
        F.when(F.col("event_type") != "view", F.array(F.struct(F.lit("a.txt").alias("path"), F.lit("text").alias("language"), F.col("event_type").alias("content")))).alias("files"))


_FEED = """
f AS (SELECT event_id AS seq, 'custom_' || CAST(user_id AS VARCHAR) AS id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'add' WHEN event_type = 'error' THEN 'delete' ELSE 'change' END AS kind,
  CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN 'Template ' || CAST(event_id AS VARCHAR) END AS name, CASE WHEN event_type <> 'click' THEN props END AS description,
  CASE WHEN value > 50 THEN 'web' END AS category, CASE WHEN event_type = 'view' THEN event_type END AS tag, CASE WHEN event_type <> 'view' THEN event_type END AS body FROM events),
s AS (SELECT id, max(seq) FILTER (kind = 'add') AS a, max(seq) FILTER (kind = 'delete') AS d FROM f GROUP BY id),
r AS (SELECT f.* FROM f JOIN s USING (id) WHERE seq >= a AND a > coalesce(d, -1) AND kind <> 'delete'),
c AS (SELECT id, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(coalesce(description, ''), seq) FILTER (kind = 'add' OR description IS NOT NULL) AS description,
  arg_max(coalesce(category, 'custom'), seq) FILTER (kind = 'add' OR category IS NOT NULL) AS category, 'text' AS language,
  arg_max(coalesce(tag, 'custom'), seq) FILTER (kind = 'add' OR tag IS NOT NULL) AS tag, arg_max(body, seq) FILTER (body IS NOT NULL) AS body FROM r GROUP BY id)"""


@query("x5_template_feed", f"WITH {_FEED} SELECT * FROM c")
def template_feed(t):
    return TF.compacted(template_changes(t)).select("id", "name", "description", "category", "language", F.get("tags", F.lit(0)).alias("tag"),
                                                    F.get("files", F.lit(0))["content"].alias("body"))


@query("x5_exchanged_templates", f"""
WITH {_FEED} SELECT name, category, 'imported' AS kind, count(*) AS rows FROM c GROUP BY name, category
UNION ALL SELECT NULL, NULL, 'not a template', count(*) FROM events""")
def exchanged_templates(t):
    """The compacted templates, written as JSON and read again, beside lines that hold none."""
    lines = TF.to_json(TF.compacted(template_changes(t))).unionByName(t("events").select(F.col("props").alias("value")))
    read = TF.from_json(lines)
    good = TF.compacted(read.where("problem IS NULL").drop("problem")).select("name", "category", F.lit("imported").alias("kind"))
    bad = read.where("problem IS NOT NULL").select(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("category"), F.col("problem").alias("kind"))
    return good.unionByName(bad).groupBy("name", "category", "kind").agg(F.count("*").alias("rows"))
