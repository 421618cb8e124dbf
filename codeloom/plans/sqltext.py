"""SQL text of the checks: the canonical views and recurring expressions in DuckDB's dialect.

Each check is a second statement of what the job computes, written line by
line and row by row where the job works on whole texts.
"""

from __future__ import annotations

from codeloom.sources.samples import HOSTS, SAMPLES


def q(value: str | None) -> str:
    """A string literal."""
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


def rx(x: str, pattern: str, group: int = 1) -> str:
    """Regex group of the first match, null when empty."""
    return f"nullif(regexp_extract({x}, {q(pattern)}, {group}), '')"


def like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def sub(x: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(replacement)}, 'g')"


def lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def mapped(x: str, table: dict[str, str], otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"CASE {x} {whens} ELSE {otherwise} END"


def base_name(x: str) -> str:
    return f"string_split({x}, '/')[-1]"


def ext(x: str) -> str:
    return rf"regexp_extract({x}, '\.[^.]*$')"


def stem(x: str) -> str:
    return rf"regexp_replace({x}, '\.[^.]*$', '')"


def escaped(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '''', '&#39;')")


def decoded(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def content(x: str) -> str:
    """Decoded text of an HTML fragment."""
    return decoded(sub(x, "<[^>]*>"))


_SAMPLES = ",\n".join(
    "(" + ", ".join([str(i)] + [q(v) for v in (s.language, s.label, s.before, s.after, s.around, s.prefix, s.code)]) + ")"
    for i, s in enumerate(SAMPLES))
_HOSTS = "[" + ", ".join(q(h) for h in HOSTS) + "]"

VIEWS = {
    "files": r"""
SELECT doc_id AS file_id, source AS project_id, lang || '/Doc_' || CAST(doc_id // 200 AS VARCHAR) || '.txt' AS path,
       lang AS language, text AS content, make_timestamp((1704067200 + doc_id * 60) * 1000000) AS ts
FROM documents""",
    "samples": f"SELECT * FROM (VALUES {_SAMPLES}) v(i, language, label, before, after, around, prefix, code)",
    "code_blocks": f"""
SELECT doc_id // 8 AS page_id, CAST(doc_id % 8 AS BIGINT) AS block_index, 'p' || CAST(doc_id // 64 AS VARCHAR) AS project_id,
       'https://' || ({_HOSTS})[(doc_id // 8) % {len(HOSTS)} + 1] || '/c/' || CAST(doc_id // 8 AS VARCHAR) AS url,
       doc_id AS block_id, source, s.language, s.label, s.before AS text_before, s.after AS text_after,
       s.around AS surrounding_text,
       replace(s.code, '@@', CASE WHEN s.prefix IS NULL
           THEN translate(text, '"' || chr(92) || chr(10) || chr(13) || chr(9), '     ')
           ELSE replace(text, chr(10), chr(10) || s.prefix) END) AS code,
       make_timestamp((1704067200 + doc_id * 60) * 1000000) AS ts
FROM documents JOIN samples s ON s.i = doc_id % {len(SAMPLES)}""",
    "code_pages": f"""
SELECT block_id AS page_id, url,
  '<html><head><title>Session ' || CAST(block_id AS VARCHAR)
  || ' - Chat</title><style>pre{{}}</style></head><body><h1>Chat</h1><h2>Topic ' || source
  || '</h2><div class="message user-turn"><p>Please help</p></div><div class="message bot-reply"><p>Use &amp;lt; here</p>'
  || CASE WHEN label <> '' THEN '<span class="filename">' || {escaped('label')} || '</span>' ELSE '' END
  || '<pre><code class="hljs language-' || language || '">' || {escaped('code')} || '</code></pre><p>'
  || {escaped('text_after')}
  || '</p><pre>   </pre><script>var x = ''<pre>no</pre>'';</script></div></body></html>' AS html
FROM code_blocks""",
    "versions": """
SELECT e.event_id AS version_id, f.project_id, f.path, f.content, length(f.content) AS size,
       len(string_split(f.content, chr(10))) AS lines, e.ts, e.event_type AS change_type, e.value > 50 AS is_favorite
FROM files f JOIN events e ON f.file_id = e.event_id % (SELECT count(*) FROM documents)""",
    "projects": rf"""
SELECT page_id AS project_id, {strip(content("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS name, url AS source_url,
       lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS source_site,
       {strip(content("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS page_title,
       CASE WHEN contains(html, '&amp;') THEN [regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{{2}})/', 1), 'entities']
            ELSE [regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{{2}})/', 1)] END AS languages,
       ['Tag-' || CAST(page_id % 7 AS VARCHAR), string_split(url, ':')[1]] AS tags,
       page_id % 5 = 0 AS is_favorite, make_timestamp((1704067200 + page_id * 60) * 1000000) AS created_at,
       length(html) AS total_size
FROM pages""",
}
NEEDS = {"code_blocks": ["samples"], "code_pages": ["code_blocks"], "versions": ["files"]}


RECURSIVE: set[str] = set()


def add_view(name: str, sql: str, needs: list[str], recursive: bool = False) -> None:
    VIEWS[name] = sql
    NEEDS[name] = needs
    if recursive:
        RECURSIVE.add(name)


def sql(body: str, *views: str) -> str:
    """``body`` preceded by the views it reads, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in NEEDS.get(name, []):
            visit(dep)
        if name not in order:
            order.append(name)

    for v in views:
        visit(v)
    if not order:
        return body
    ctes = ",\n".join(f"{name} AS {'' if name in RECURSIVE else 'MATERIALIZED '}({VIEWS[name].strip()})" for name in order)
    if RECURSIVE & set(order):
        ctes = "RECURSIVE " + ctes
    head = body.lstrip()
    if head[:5].upper() == "WITH ":
        rest = head[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {ctes.removeprefix('RECURSIVE ')},\n{rest[10:]}"
        return f"WITH {ctes},\n{rest}"
    return f"WITH {ctes}\n{body}"
