"""Queries: block extraction, routing, fences, headings, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import html as H
from codeloom.functions.text import content_hash, format_bytes, legacy_hash, normalise_blanks, truncate
from codeloom.operators import blocks as B
from codeloom.plans.registry import query
from codeloom.plans import sqltext as S
from codeloom.plans.sqltext import add_view, q, rx, sql, strip, sub
from codeloom.rules import naming as N
from codeloom.rules.sites import SITES
from codeloom.sources import views as V

NOISE = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"


def _segments(tags: str) -> str:
    """Pieces of the noise-free page, each starting right after an opening tag."""
    return rf"""SELECT page_id, url, p AS piece, i AS seg FROM (
  SELECT page_id, url, string_split(regexp_replace({sub('html', NOISE)}, '(?i)<({tags})((?:[ \t\r\n][^>]*)?)>', chr(1) || '\1' || chr(2) || '\2' || chr(3), 'g'), chr(1)) AS parts
  FROM %s), LATERAL (SELECT unnest(parts) AS p, generate_subscripts(parts, 1) AS i) WHERE i > 1"""


def _site(url: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({url}, {q(r.pattern)}) THEN {q(r.site)}" for r in SITES)
    return f"CASE {whens} ELSE 'Generic' END"


PROSE_END = (r"(?is)</?(?:p|li|ul|ol|dl|div|pre|table|h[1-6]|article|section|nav|footer|header|main|"
             r"blockquote|figure|body|html)(?:[ \t\r\n/][^>]*)?>.*")
_body = "substr(piece, instr(piece, chr(3)) + 1)"
add_view("prose_blocks", f"""
SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY seg) - 1 AS block_index, code,
       lower(string_split(piece, chr(2))[1]) AS tag, length(code) AS size, len(string_split(code, chr(10))) AS lines
FROM (SELECT *, {strip(S.content(f"regexp_replace({_body}, {q(PROSE_END)}, '')"))} AS code
      FROM ({_segments('p|li') % 'pages'})) WHERE length(code) >= 10""", [])

_pre = f"regexp_replace({_body}, '(?is)</pre>.*', '')"
_inner = rf"""CASE WHEN regexp_matches({_pre}, '(?i)<code[ \t\r\n>]')
  THEN regexp_extract({_pre}, '(?is)<code(?:[ \t\r\n][^>]*)?>(.*?)(?:</code>|\z)', 1) ELSE {_pre} END"""
add_view("html_code_blocks", rf"""
SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY seg) - 1 AS block_index, code,
       coalesce({rx('classes', r'language-(\w+)')}, {rx('classes', r'lang-(\w+)')}, {rx('classes', r'hljs\s+(\w+)')}, 'text') AS language,
       classes, length(code) AS size, len(string_split(code, chr(10))) AS lines
FROM (SELECT *, {strip(S.content(_inner))} AS code,
        lower(regexp_extract({_body}, '(?is)^[^<]*<code[^>]*class="([^"]*)"', 1)) AS classes
      FROM ({_segments('pre') % 'code_pages'})) WHERE length(code) >= 10""", ["code_pages"])


@query("s1_extract_prose_blocks", sql(
    f"SELECT page_id, block_index, code, tag, {_site('url')} AS source, size, lines FROM prose_blocks", "prose_blocks"))
def extract_prose(t):
    return B.extract_prose_blocks(t.spread("pages")).select(
        "page_id", "block_index", "code", "tag", "source", "size", "lines")


@query("s1_extract_code_blocks", sql(
    f"SELECT page_id, block_index, code, language, {_site('url')} AS source, size, lines FROM html_code_blocks",
    "html_code_blocks"))
def extract_code(t):
    return B.extract_code_blocks(V.code_pages(t)).select(
        "page_id", "block_index", "code", "language", "source", "size", "lines")


@query("s2_scoped_blocks", sql("""
SELECT b.page_id, row_number() OVER (PARTITION BY b.page_id ORDER BY b.block_index) - 1 AS block_index, b.code, b.size, b.lines
FROM prose_blocks b JOIN pages p ON p.page_id = b.page_id
WHERE b.block_index BETWEEN p.page_id % 4 AND p.page_id % 4 + length(p.url) % 9""", "prose_blocks"))
def scoped_blocks(t):
    pages = t.spread("pages")
    selections = t("pages").select("page_id", (F.col("page_id") % 4).alias("from_pos"),
                                   (F.col("page_id") % 4 + F.length("url") % 9).alias("to_pos"))
    return B.scoped(B.extract_prose_blocks(pages), selections).select(
        "page_id", "block_index", "code", "size", "lines")


@query("s3_route_sites", sql(f"""
SELECT page_id, url, {_site('url')} AS site FROM code_pages
UNION ALL SELECT page_id, url, {_site('url')} AS site FROM pages""", "code_pages"))
def route_sites(t):
    return B.route_sites(V.code_pages(t).select("page_id", "url").unionByName(
        t("pages").select("page_id", "url")))


@query("f12_decode_entities", f"""
SELECT page_id, {S.decoded('html')} AS decoded FROM pages""")
def decode_entities(t):
    return t.spread("pages").select("page_id", H.decode_entities("html").alias("decoded"))


@query("f13_normalise_blanks", """
SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(9), '  ') AS text FROM documents""")
def blanks(t):
    return t.spread("documents", "doc_id", "text").select("doc_id", normalise_blanks("text").alias("text"))


@query("f14_report_formats", """
SELECT doc_id, CASE
  WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' Bytes'
  ELSE regexp_replace(regexp_replace(printf('%.2f', round(b / 1024.0, 2)), '0+$', ''), '\\.$', '') || ' KB' END AS bytes,
  CASE WHEN length(text) <= 50 THEN text ELSE substr(text, 1, 47) || '...' END AS short
FROM (SELECT doc_id, text, octet_length(encode(text)) AS b FROM documents)""".replace("\\\\", "\\"))
def formats(t):
    return t.spread("documents", "doc_id", "text").select(
        "doc_id", format_bytes(F.octet_length("text")).alias("bytes"), truncate("text").alias("short"))


@query("f15_file_mentions", sql(f"""
SELECT block_id, i - 1 AS position, m AS mention
FROM (SELECT block_id, regexp_extract_all(code, {q(N.FILE_LIKE)}, 1) AS ms FROM code_blocks),
     LATERAL (SELECT unnest(ms) AS m, generate_subscripts(ms, 1) AS i)""", "code_blocks"))
def mentions(t):
    return B.file_mentions(V.code_blocks(t).select("block_id", "code"), "code")


@query("f16_fenced_blocks", sql(r"""
SELECT block_id, i - 1 AS block_index, coalesce(nullif(regexp_extract(f, '^```(\w+)?\n', 1), ''), 'text') AS language,
       regexp_extract(f, '^```(?:\w+)?\n([\s\S]*?)```', 1) AS code
FROM (SELECT block_id, regexp_extract_all('Use this:' || chr(10) || '```' || language || chr(10) || code || chr(10)
        || '```' || chr(10) || 'and' || chr(10) || '```' || chr(10) || source || '```', '```(\w+)?\n([\s\S]*?)```') AS fs
      FROM code_blocks), LATERAL (SELECT unnest(fs) AS f, generate_subscripts(fs, 1) AS i)""", "code_blocks"))
def fences(t):
    nl = F.lit("\n")
    message = F.concat(F.lit("Use this:\n```"), F.col("language"), nl, F.col("code"), F.lit("\n```\nand\n```\n"),
                       F.col("source"), F.lit("```"))
    return B.fenced_blocks(V.code_blocks(t).select("block_id", message.alias("text")))


def _heads(level: int) -> str:
    return (f"list_transform(regexp_extract_all(html, '(?is)<h{level}(?:[ \\t\\r\\n][^>]*)?>(.*?)</h{level}>', 1), "
            f"lambda h: {strip(S.content('h'))})")


def _project_name(table: str) -> str:
    host = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
    platform = " ".join(f"WHEN contains({host}, {q(a)}) THEN {q(b)}" for a, b in N.PLATFORMS)
    caption = strip(S.content("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
    for s in N.TITLE_SUFFIXES:
        caption = sub(caption, s)
    caption = strip(sub(strip(caption), "[^a-zA-Z0-9 _-]"))
    generic = ", ".join(q(g) for g in N.GENERIC_HEADINGS)
    return f"""SELECT page_id, '[' || CASE {platform} ELSE 'Web' END || '] ' || coalesce(
  list_filter(list_concat({_heads(1)}, {_heads(2)}), lambda h: length(h) BETWEEN 3 AND 49 AND lower(h) NOT IN ({generic}))[1],
  nullif({caption}, ''), 'Extracted Project') AS project_name FROM {table}"""


@query("f17_project_names", sql(
    f"{_project_name('pages')} UNION ALL {_project_name('code_pages')}", "code_pages"))
def project_names(t):
    return B.project_names(t.spread("pages", "page_id", "url", "html")).unionByName(B.project_names(V.code_pages(t)))


@query("f18_fingerprints", "SELECT doc_id, sha256(text) AS hash, length(text) AS size, "
                           "len(string_split(text, chr(10))) AS lines FROM documents")
def fingerprints(t):
    return B.with_fingerprint(t.spread("documents", "doc_id", "text"), "text").select(
        "doc_id", "hash", "size", "lines")


@query("f18_legacy_hash")
def legacy(t):
    return t.spread("documents", "doc_id", "text").select("doc_id", legacy_hash("text").alias("hash32"))


@query("p1_blocks_by_language", sql(
    "SELECT block_id, language, label FROM code_blocks WHERE language = lower('Python')", "code_blocks"))
def by_language(t):
    return B.of_language(V.code_blocks(t), "Python").select("block_id", "language", "label")


@query("p2_blocks_by_keyword", sql("""
SELECT block_id, language FROM code_blocks WHERE contains(lower(code), lower('Server'))
   OR contains(lower(label), lower('Server')) OR contains(lower(surrounding_text), lower('Server'))""", "code_blocks"))
def by_keyword(t):
    return B.with_keyword(V.code_blocks(t), "Server").select("block_id", "language")


@query("a1_page_summary", sql("""
SELECT page_id, count(*) AS blocks, CAST(sum(size) AS BIGINT) AS size, CAST(sum(lines) AS BIGINT) AS lines
FROM prose_blocks GROUP BY page_id""", "prose_blocks"))
def page_summary(t):
    return B.page_summary(B.extract_prose_blocks(t.spread("pages")))


@query("a1_page_languages", sql(
    "SELECT page_id, language, count(*) AS blocks FROM code_blocks GROUP BY ALL", "code_blocks"))
def page_languages(t):
    return B.page_languages(V.code_blocks(t))


@query("scan_pages", sql(f"""
WITH b AS (SELECT *, sha256(code) AS hash, {_site('url')} AS site FROM prose_blocks)
SELECT site, tag, count(*) AS blocks, count(DISTINCT hash) AS distinct_blocks, count(*) - count(DISTINCT hash) AS duplicates,
       CAST(sum(size) AS BIGINT) AS size, CAST(sum(lines) AS BIGINT) AS lines
FROM b GROUP BY site, tag""", "prose_blocks"))
def scan_pages(t):
    """Flagship: blocks, exact duplicates and sizes per site, from raw pages."""
    b = B.with_fingerprint(B.extract_prose_blocks(t.spread("pages")))
    per_text = b.groupBy("source", "tag", "hash").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("lines").alias("lines"))
    return per_text.groupBy(F.col("source").alias("site"), "tag").agg(
        F.sum("n").alias("blocks"), F.count("*").alias("distinct_blocks"),
        (F.sum("n") - F.count("*")).alias("duplicates"), F.sum("size").alias("size"), F.sum("lines").alias("lines"))
