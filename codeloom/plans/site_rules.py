"""Queries: site rules that users make, applied to the pages of their domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeloom.functions import html as H
from codeloom.operators import elements as E, site_rules as SR
from codeloom.plans.registry import query
from codeloom.plans.sqltext import content, q, sql, strip
from codeloom.sources import views as V

_NAV = ("Nav", ["article > h1", "div.ad"], ["nav li a"], ["article", "footer"])
_FOOT = ("Foot", ["body > footer"], [], ["nav"])


def rule_changes(t) -> DataFrame:
    """Saves and deletes of rules, one for each page: the rule of a host says what to take from its pages.

    Hosts of even page numbers save the first kind of rule, those of odd ones the second; pages whose path ends in a
    fragment or a query string delete the rule of their host.
    """
    pages = t("pages").select("page_id", H.host("url").alias("host"), F.col("url").rlike("[#?]").alias("deleted"))
    kind = F.col("page_id") % 2 == 0

    def pick(i: int):
        a, b = (F.array(*[F.lit(s) for s in r[i]]).cast("array<string>") if i else F.lit(r[i]) for r in (_NAV, _FOOT))
        return F.when(kind, a).otherwise(b)

    return pages.select(F.concat(F.lit("rule-"), F.element_at(F.split("host", r"\."), -1)).alias("rule_id"), pick(0).alias("name"),
                        F.concat(F.lit("example."), F.element_at(F.split("host", r"\."), -1)).alias("domain"), pick(1).alias("block_selectors"),
                        pick(2).alias("label_selectors"), pick(3).alias("container_selectors"), F.col("page_id").alias("seq"), "deleted")


_CHANGES = r"""
changes AS (SELECT 'rule-' || string_split(host, '.')[-1] AS rule_id, CASE WHEN page_id % 2 = 0 THEN 'Nav' ELSE 'Foot' END AS name, 'example.' || string_split(host, '.')[-1] AS domain,
  page_id AS seq, regexp_matches(url, '[#?]') AS deleted FROM (SELECT *, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages)),
rules AS (SELECT * FROM changes WHERE NOT deleted QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY seq DESC) = 1
  AND (rule_id, seq) IN (SELECT rule_id, max(seq) FROM changes GROUP BY rule_id))"""
_NAV_COUNT = len(_NAV[1])


@query("x2_saved_rules", f"WITH {_CHANGES} SELECT rule_id, name, domain, seq FROM rules")
def saved_rules(t):
    return SR.current(rule_changes(t)).select("rule_id", "name", "domain", "seq")


def _exchanged(t) -> DataFrame:
    """The rules of the first kind, written as JSON and read again under new ids, beside lines that hold no rule."""
    saved = rule_changes(t).where("NOT deleted AND name = 'Nav'").groupBy("domain").agg(F.max_by(F.struct("rule_id", "name", *SR.SELECTORS), "seq").alias("r")).select("domain", "r.*")
    damaged = t("pages").select(F.substring("html", 1, 40).alias("value"))
    return SR.from_json(SR.to_json(saved).unionByName(damaged))


@query("x2_exchanged_rules", f"""WITH {_CHANGES} SELECT 'Nav' AS name, domain, CAST({_NAV_COUNT} AS BIGINT) AS blocks, CAST(NULL AS VARCHAR) AS problem, CAST(1 AS BIGINT) AS rows
FROM changes WHERE NOT deleted AND name = 'Nav' GROUP BY domain
UNION ALL SELECT NULL, NULL, NULL, 'not a site rule', count(*) FROM pages""")
def exchanged(t):
    return _exchanged(t).groupBy("name", "domain", F.size("block_selectors").alias("blocks"), "problem").agg(F.count("*").alias("rows"))


def in_use(t):
    """All saved and imported rules; the saved ones go first."""
    imported = _exchanged(t).where("problem IS NULL").drop("problem").withColumn("seq", F.lit(-1).cast("long"))
    return SR.compiled(SR.current(rule_changes(t)).unionByName(imported))


def _host_rule() -> str:
    return r"""
page AS (SELECT page_id, html, coalesce(r.name, 'Nav') AS kind, r.name IS NULL AS imported FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/]*(example\.[a-z]+)', 1) AS domain FROM pages) p
  LEFT JOIN rules r ON r.domain = p.domain WHERE r.name IS NOT NULL OR p.domain IN (SELECT domain FROM changes WHERE NOT deleted AND name = 'Nav'))"""


_TEXT = {k: strip(content(f"regexp_extract(html, {q(p)}, 1)")) for k, p in
         {"h1": "<article><h1>([^<]*)</h1>", "ad": '<div class="ad">([^<]*)</div>', "footer": "<footer>([^<]*)</footer>", "label": "([^<>]*)</a></li></ul></nav>"}.items()}


@query("x1_own_rule_blocks", sql(f"""WITH {_CHANGES}, {_host_rule()},
found AS (SELECT page_id, kind AS site, 1 AS priority, {_TEXT['ad']} AS code, {_TEXT['label']} AS label FROM page WHERE kind = 'Nav'
  UNION ALL SELECT page_id, kind, 0, {_TEXT['h1']}, {_TEXT['label']} FROM page WHERE kind = 'Nav'
  UNION ALL SELECT page_id, kind, 0, {_TEXT['footer']}, NULL FROM page WHERE kind = 'Foot')
SELECT page_id, site, row_number() OVER (PARTITION BY page_id ORDER BY priority) - 1 AS block_index, code, nullif(label, '') AS label FROM found WHERE length(code) >= 10"""))
def own_rule_blocks(t):
    pages = t.spread("pages", "page_id", "url", "html")
    return E.site_blocks(pages, in_use(t)).where(F.col("site").isin("Nav", "Foot")).select("page_id", "site", "block_index", "code", "label")


@query("x1_own_rule_containers", sql(f"""WITH {_CHANGES}, {_host_rule()} SELECT page_id, kind AS site, CASE kind WHEN 'Nav' THEN '<article>' ELSE '<nav>' END AS tag FROM page"""))
def own_rule_containers(t):
    pages = t.spread("pages", "page_id", "url", "html")
    return E.message_containers(pages, in_use(t)).where(F.col("site").isin("Nav", "Foot")).select("page_id", "site", "tag")


@query("x1_own_rules_on_code_pages", sql(f"""
SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS host, nullif({strip(content("regexp_extract(html, '<span class=.filename.>([^<]*)<', 1)"))}, '') AS label, length({strip(content("regexp_extract(html, '(?is)<pre><code[^>]*>(.*?)</code>', 1)"))}) AS size
FROM code_pages WHERE regexp_matches(url, 'blog.example|docs.example') AND length({strip(content("regexp_extract(html, '(?is)<pre><code[^>]*>(.*?)</code>', 1)"))}) >= 10""", "code_pages"))
def on_code_pages(t):
    """Rules for the two sample hosts that no built-in rule knows."""
    hosts = t.spark.createDataFrame([("a", "Blog", "blog.example.org", ["pre > code"], ["span.filename"], [], 1), ("b", "Docs", "docs.example.net", ["div.message pre"], [".filename"], [], 2)], SR.RULE + ", seq long")
    found = E.site_blocks(V.code_pages(t), SR.compiled(hosts)).where(F.col("site").isin("Blog", "Docs"))
    return found.select("page_id", F.regexp_extract("url", "://([^/]*)", 1).alias("host"), "label", F.length("code").alias("size"))
