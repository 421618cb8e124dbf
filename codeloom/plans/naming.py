"""Queries: file names and languages of code blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import language as G, naming as FN, paths as P
from codeloom.operators import names as O
from codeloom.plans.registry import query
from codeloom.plans.sqltext import add_view, base_name, ext, like, mapped, q, rx, sql, stem, strip, sub
from codeloom.rules import languages as L, naming as N
from codeloom.sources import views as V

# --- the cascade, restated line by line -------------------------------------------

_first = "list_filter(list_transform({lines}, lambda x: {rx}), lambda x: x IS NOT NULL)[1]"


def _first_match(lines: str, pattern: str, group: int = 1) -> str:
    return _first.format(lines=lines, rx=rx("x", pattern, group))


CODE_LINES = "string_split(code, chr(10))"
LABEL = f"coalesce({rx('label', N.FILE_LIKE)}, CASE WHEN label <> '' AND length(label) < 50 AND NOT contains(label, chr(10)) THEN label END)"
COMMENT = _first_match(f"{CODE_LINES}[1:5]", N.COMMENT_NAME.replace(r"(?:^|\n)", "^"))
BEFORE = _first_match("string_split(text_before, chr(10))[-3:]", N.FILE_LIKE)
AFTER = _first_match("string_split(text_after, chr(10))[1:3]", N.FILE_LIKE)
SURROUND = f"coalesce({rx('surrounding_text', N.CREATE_PHRASE)}, {rx('surrounding_text', N.FILE_LIKE)})"
CREATE = rx("code", N.CREATE_PHRASE)
_py = _first_match(CODE_LINES, r"^(?:from\s+(\.[.\w/]+)\s+import|import\s+(\.[.\w/]+))", 0)
PY_IMPORT = rf"regexp_replace(replace(regexp_extract({_py}, '^(?:from|import)\s+(\.[.\w/]+)', 1), '.', '/'), '^/', '') || '.py'"
_mods = rf"""list_filter(list_transform({CODE_LINES}, lambda x: regexp_extract(x, 'from\s+[''"]([^''"]+)[''"]', 1)),
  lambda m: (starts_with(m, '.') OR contains(m, '/')) AND NOT ends_with(m, '/'))[1]"""
_ext = "CASE WHEN language = 'typescript' THEN '.ts' ELSE '.js' END"
_seg = f"string_split({_mods}, '/')[-1]"
JS_IMPORT = f"CASE WHEN ends_with({_seg}, {_ext}) THEN {_seg} ELSE {_seg} || {_ext} END"
IMPORT = f"CASE WHEN language = 'python' THEN {PY_IMPORT} WHEN language IN ('javascript', 'typescript') THEN {JS_IMPORT} END"
_info = f"regexp_extract({strip(CODE_LINES + '[1]')}, " + r"'```\s*(\w+)\s*(.*)', 2)"
FENCE = f"CASE WHEN starts_with(code, '```') THEN nullif({strip(_info)}, '') END"


def _all(patterns: list[str], text: str) -> str:
    tests = [f"NOT {like(text, p[1:])}" if p.startswith("!") else like(text, p) for p in patterns]
    return " AND ".join(tests) or "true"


def _prints(rows, text: str) -> str:
    whens = "".join(
        f" WHEN {'' if lang is None else f'language = {q(lang)} AND '}{_all(ps, text)} THEN {q(name)}"
        for lang, ps, name in rows)
    return f"CASE{whens} END"


_kept = f"list_filter(list_transform(string_split(body, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
_ign = f"len(list_filter({_kept}, lambda x: {like('x', N.IGNORE_LINE)}))"
CONTENT = f"""coalesce(
  CASE WHEN len(list_filter(string_split(body, chr(10)), lambda x: {like('x', N.TREE_LINE)})) >= 3 THEN 'project-structure.txt' END,
  CASE WHEN language = 'json' OR starts_with(body, '{{') THEN CASE{''.join(f" WHEN {_all(ps, 'body')} THEN {q(n)}" for ps, n in N.JSON_KINDS)} END END,
  {_prints(N.FINGERPRINTS_BEFORE_IGNORE, 'body')},
  CASE WHEN language IN ('', 'text') AND {_ign} >= 3 AND {_ign} > len({_kept}) * 0.5
       THEN CASE WHEN contains(body, 'docker') THEN '.dockerignore' ELSE '.gitignore' END END,
  {_prints(N.FINGERPRINTS_AFTER_IGNORE, 'body')})"""


def _heading_line(x: str) -> str:
    t = strip(x)
    clean = strip(sub(t, "[:;-]"))

    def num(p):
        return (f"CASE WHEN {like(t, p)} THEN coalesce(CAST(TRY_CAST(regexp_extract({t}, {q(p)}, 1) AS BIGINT) AS VARCHAR), '')"
                f" || chr(1) || {strip(f'regexp_extract({t}, {q(p)}, 2)')} END")
    return (f"coalesce({num(N.HEADING_BLOCK)}, {num(N.HEADING_MARKDOWN)}, {num(N.HEADING_NUMBERED)}, "
            f"CASE WHEN length({t}) > 2 AND length({t}) <= 70 AND len(regexp_split_to_array({t}, '\\s+')) <= 10 "
            f"AND NOT {like(clean, N.FILLER)} AND NOT contains({clean}, '```') THEN chr(1) || {clean} END)")


def _heading(text: str) -> str:
    return (f"list_filter(list_transform(list_reverse(string_split({text}, chr(10))[-6:]), lambda x: {_heading_line('x')}), "
            "lambda x: x IS NOT NULL)[1]")


FOUND = f"coalesce(CASE WHEN text_before <> '' THEN {_heading('text_before')} END, CASE WHEN surrounding_text <> '' THEN {_heading('surrounding_text')} END)"
_slug = r"nullif(substr(regexp_replace(regexp_replace(lower(string_split(found, chr(1))[2]), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40), '')"
NAME_EXT = mapped("lower(language)", L.NAME_EXTENSION, "'.txt'")
HEADING = (f"{_slug} || CASE WHEN string_split(found, chr(1))[1] <> '' THEN '_' || string_split(found, chr(1))[1] ELSE '' END || {NAME_EXT}")
GENERATED = (f"coalesce({mapped('lower(language)', L.WHOLE_NAME)}, coalesce(nullif(lower(language), ''), 'snippet') || '_' || "
             f"CAST(block_index + 1 AS VARCHAR) || {NAME_EXT})")


def _sanitised(x: str) -> str:
    s = sub(x, r'[<>:"\\|?*\x00-\x1F]', "_")
    s = sub(s, r"^\.+|\.+$")
    s = f"substr({sub(sub(s, '[ \\t\\n\\r]+', '_'), '_{2,}', '_')}, 1, 255)"
    return f"coalesce(nullif({s}, ''), 'unnamed_file.txt')"


_CASCADE = list(zip(FN.STRATEGIES, [LABEL, COMMENT, BEFORE, AFTER, SURROUND, CREATE, IMPORT, FENCE, CONTENT, HEADING, GENERATED]))
add_view("candidates", f"""
SELECT *, {', '.join(f'{e} AS c_{s}' for s, e in _CASCADE)}
FROM (SELECT *, {strip('code')} AS body, {FOUND} AS found FROM code_blocks)""", ["code_blocks"])
add_view("named_blocks", f"""
SELECT *, CASE {' '.join(f"WHEN c_{s} IS NOT NULL THEN '{s}'" for s, _ in _CASCADE)} END AS strategy,
       {_sanitised('coalesce(' + ', '.join(f'c_{s}' for s, _ in _CASCADE) + ')')} AS file_name
FROM candidates""", ["candidates"])
add_view("unique_blocks", f"""
SELECT * EXCLUDE (file_name), CASE WHEN use > 1 THEN {stem('file_name')} || '_' || CAST(use AS VARCHAR) || lower({ext('file_name')}) ELSE file_name END AS file_name
FROM (SELECT *, row_number() OVER (PARTITION BY page_id, file_name ORDER BY block_index) AS use FROM named_blocks)""",
         ["named_blocks"])


def _norm(x: str, aliases=L.ALIASES) -> str:
    low = strip(f"lower({x})")
    return mapped(low, aliases, low)


_base = f"string_split(string_split(lower(file_name), '/')[-1], chr(92))[-1]"
BY_NAME = f"coalesce({mapped(_base, L.SPECIAL_FILES)}, {mapped(f'regexp_extract({_base}, {q(chr(92) + ".[^.]*$")})', L.EXTENSION_LANGUAGE)})"


def _scored(table, text: str, bonus: bool) -> str:
    """Best language of one row through a correlated list of (score, -order, language)."""
    items = []
    for order, (lang, weight, needles) in enumerate(table):
        score = " + ".join(f"CASE WHEN contains({text}, {q(n)}) THEN {weight} ELSE 0 END" for n in needles)
        if bonus and lang == "json":
            score += rf" + CASE WHEN json_valid({text}) AND NOT regexp_matches({text}, ',\s*[}}\]]') THEN 10 ELSE -2 END"
        if bonus and lang == "yaml":
            score += (f" + CASE WHEN NOT starts_with({text}, '{{') AND NOT starts_with({text}, '[') AND "
                      f"len(list_filter(string_split({text}, chr(10)), lambda x: contains(x, ': '))) > "
                      f"len(string_split({text}, chr(10))) * 0.5 THEN 5 ELSE 0 END")
        items.append(f"{{'s': {score}, 'o': {-order}, 'l': {q(lang)}}}")
    return f"list_max([{', '.join(items)}])"


BY_CONTENT = f"CASE WHEN body = '' THEN 'text' WHEN (top).s > 0 THEN (top).l ELSE 'text' END"
add_view("typed_blocks", f"""
SELECT * EXCLUDE (language), coalesce(CASE WHEN language NOT IN ('', 'text') THEN {_norm('language')} END, {BY_NAME}, {BY_CONTENT}) AS language
FROM (SELECT *, {_scored(L.INDICATORS, 'body', True)} AS top FROM unique_blocks)""", ["unique_blocks"])


def _normal_path(x: str) -> str:
    parts = f"list_filter(string_split(replace({x}, chr(92), '/'), '/'), lambda p: p <> '' AND p <> '.')"
    return (f"array_to_string(list_reduce({parts}, lambda acc, p: CASE WHEN p = '..' THEN acc[1:len(acc)-1] "
            f"ELSE list_append(acc, p) END, CAST([] AS VARCHAR[])), '/')")


FOLDER = mapped("lower(language)", L.LANGUAGE_FOLDER)
PLACED = (f"CASE WHEN contains(file_name, '/') OR contains(file_name, chr(92)) THEN {_normal_path('file_name')} "
          f"WHEN {FOLDER} IS NOT NULL THEN {FOLDER} || '/' || file_name ELSE file_name END")
add_view("code_files", f"""
SELECT * EXCLUDE (r) FROM (
  SELECT *, min(block_index) OVER (PARTITION BY page_id, path) AS position,
         row_number() OVER (PARTITION BY page_id, path ORDER BY block_index DESC) AS r
  FROM (SELECT page_id, project_id, block_id, block_index, code AS content, language, source, ts, {PLACED} AS path FROM typed_blocks))
WHERE r = 1""", ["typed_blocks"])


def named(t):
    return O.resolve_names(V.code_blocks(t))


def typed(t):
    return O.identify_languages(O.unique_names(named(t)))


def code_files(t):
    return O.mapped_files(typed(t)).withColumnRenamed("code", "content")


@query("f1_resolve_names", sql("SELECT block_id, strategy, file_name FROM named_blocks", "named_blocks"))
def resolve_names(t):
    return named(t).select("block_id", "strategy", "file_name")


@query("f1_candidates", sql("""
SELECT block_id, c_label AS f1a_label, c_comment AS f1b_comment, c_text_before AS f1c_before, c_text_after AS f1c_after,
       c_heading AS f1d_heading, c_surrounding AS f1e_surrounding, c_create_phrase AS f1e_create, c_import AS f1f_import,
       c_fence AS f1g_fence, c_content AS f1h_content, c_generated AS f1i_generated FROM candidates""", "candidates"))
def candidates(t):
    return V.code_blocks(t).select(
        "block_id", FN.from_label("label").alias("f1a_label"), FN.from_comment("code").alias("f1b_comment"),
        FN.from_text_before("text_before").alias("f1c_before"), FN.from_text_after("text_after").alias("f1c_after"),
        FN.from_heading("text_before", "surrounding_text", "language").alias("f1d_heading"),
        FN.from_surrounding("surrounding_text").alias("f1e_surrounding"),
        FN.from_create_phrase("code").alias("f1e_create"), FN.from_import("code", "language").alias("f1f_import"),
        FN.from_fence("code").alias("f1g_fence"), FN.from_content("code", "language").alias("f1h_content"),
        FN.generated("language", "block_index").alias("f1i_generated"))


@query("f2_sanitised_names", f"""
SELECT page_id, {_sanitised("'.' || url || '..'")} AS visible,
       substr({sub(sub(sub(sub('url', r'[<>:"/\\|?*\x00-\x1F]', '_'), r'^\.+|\.+$'), '[ \t\n\r]+', '_'), '_{2,}', '_')}, 1, 255) AS file_name,
       coalesce(nullif(substr({sub(sub('lower(url)', '[^a-z0-9_.-]', '-'), '^-+|-+$')}, 1, 214), ''), 'extracted-project') AS package,
       'github.com/user/' || {sub(sub('lower(url)', '[^a-z0-9_.-]', '-'), '^-+|-+$')} AS module
FROM pages""")
def sanitised(t):
    return t("pages").select(
        "page_id", P.sanitised_path_name(F.concat(F.lit("."), "url", F.lit(".."))).alias("visible"),
        P.sanitised_file_name("url").alias("file_name"), P.package_name("url").alias("package"),
        P.module_name("url").alias("module"))


@query("f3_path_columns", sql(f"""
SELECT file_id, {base_name('path')} AS name, {ext('path')} AS extension, {stem(base_name('path'))} AS stem,
       regexp_replace(path, '/?[^/]*$', '') AS directory FROM files""", "files"))
def path_columns(t):
    return V.files(t).select("file_id", P.base_name("path").alias("name"), P.extension("path").alias("extension"),
                             P.stem(P.base_name("path")).alias("stem"), P.directory("path").alias("directory"))


@query("f4_normalised_paths", sql(f"""
SELECT file_id, {_normal_path("'./src//' || language || '/../../' || project_id || chr(92) || '..' || chr(92) || 'x/' || path")} AS path
FROM files""", "files"))
def normalised_paths(t):
    raw = F.concat(F.lit("./src//"), "language", F.lit("/../../"), "project_id", F.lit("\\..\\x/"), "path")
    return V.files(t).select("file_id", P.normalised(raw).alias("path"))


@query("f5_placed_paths", sql(f"SELECT block_id, {PLACED} AS path FROM typed_blocks", "typed_blocks"))
def placed_paths(t):
    return typed(t).select("block_id", P.placed("file_name", "language").alias("path"))


@query("f6_normalised_languages", sql(
    f"SELECT block_id, {_norm('language')} AS language, {_norm('language', L.BLOCK_ALIASES)} AS block_language FROM code_blocks",
    "code_blocks"))
def normalised_languages(t):
    return V.code_blocks(t).select("block_id", G.normalised("language").alias("language"),
                                   G.normalised("language", L.BLOCK_ALIASES).alias("block_language"))


@query("f7_language_by_name", sql(f"""
SELECT block_id, {BY_NAME} AS language, {mapped('lower(language)', L.LANGUAGE_EXTENSION, "'.txt'")} AS extension
FROM named_blocks""", "named_blocks"))
def language_by_name(t):
    from codeloom.functions.text import lookup
    return named(t).select(
        "block_id", G.from_file_name("file_name").alias("language"),
        F.coalesce(lookup(L.LANGUAGE_EXTENSION, F.lower("language")), F.lit(".txt")).alias("extension"))


@query("f8_identify_languages", sql("SELECT block_id, file_name, language FROM typed_blocks", "typed_blocks"))
def identify(t):
    return typed(t).select("block_id", "file_name", "language")


@query("f8_language_by_content", sql(f"""
SELECT block_id, {BY_CONTENT} AS language FROM (SELECT *, {_scored(L.INDICATORS, 'body', True)} AS top
FROM (SELECT block_id, {strip('code')} AS body FROM code_blocks))""", "code_blocks"))
def by_content(t):
    return V.code_blocks(t).select("block_id", G.from_content("code").alias("language"))


@query("f9_second_scorers", sql(f"""
SELECT block_id, CASE WHEN (u).s > 0 THEN (u).l ELSE 'text' END AS unit_language,
       CASE WHEN (b).s >= 2 THEN (b).l END AS block_language
FROM (SELECT block_id, {_scored(L.UNIT_INDICATORS, 'code', False)} AS u, {_scored(L.BLOCK_INDICATORS, 'code', False)} AS b
      FROM code_blocks)""", "code_blocks"))
def second_scorers(t):
    return V.code_blocks(t).select("block_id", G.from_content_unit("code").alias("unit_language"),
                                   G.from_content_block("code").alias("block_language"))


def _confidence() -> str:
    whens = []
    for lang, needles in L.CONFIDENCE_INDICATORS.items():
        hits = " + ".join(f"CAST(contains(code, {q(n)}) AS INTEGER)" for n in needles)
        whens.append(f"WHEN language = {q(lang)} THEN ({hits}) / {len(needles)}.0")
    return f"CASE WHEN language = 'text' THEN 0.0 {' '.join(whens)} ELSE 0.5 END"


@query("f10_language_confidence", sql(
    f"SELECT block_id, language, CAST(round(CAST({_confidence()} AS DOUBLE), 4) AS DOUBLE) AS confidence FROM code_blocks", "code_blocks"))
def confidence(t):
    return V.code_blocks(t).select("block_id", "language", F.round(G.confidence("code", "language"), 4).alias("confidence"))


@query("s6_block_languages", sql(f"""
SELECT page_id, block_index, coalesce({_norm('''coalesce(
    nullif(regexp_extract(classes, 'language-(\\w+)', 1), ''), nullif(regexp_extract(classes, 'lang-(\\w+)', 1), ''),
    nullif(regexp_extract(classes, 'hljs\\s+(\\w+)', 1), ''))''', L.BLOCK_ALIASES)},
    CASE WHEN (b).s >= 2 THEN (b).l END) AS block_language
FROM (SELECT page_id, block_index, classes, {_scored(L.BLOCK_INDICATORS, 'code', False)} AS b FROM html_code_blocks)""", "html_code_blocks"))
def block_languages(t):
    from codeloom.operators import blocks as B
    b = B.extract_code_blocks(V.code_pages(t)).withColumn("label", F.lit(None).cast("string"))
    return B.block_languages(b).select("page_id", "block_index", "block_language")


@query("w1_unique_names", sql("SELECT block_id, use, file_name FROM unique_blocks", "unique_blocks"))
def unique_names(t):
    return O.unique_names(named(t)).select("block_id", "use", "file_name")


@query("a26_name_counts", sql(
    "SELECT page_id, file_name, count(*) AS uses FROM named_blocks GROUP BY ALL", "named_blocks"))
def name_counts(t):
    return O.name_counts(named(t))


@query("w2_mapped_files", sql(
    "SELECT page_id, path, block_id, position, language FROM code_files", "code_files"))
def mapped_files(t):
    return code_files(t).select("page_id", "path", "block_id", "position", "language")


@query("u2_directories", sql("""
SELECT DISTINCT project_id, array_to_string(parts[1:i], '/') AS directory
FROM (SELECT project_id, string_split(path, '/') AS parts FROM code_files),
     LATERAL (SELECT unnest(range(1, len(parts))) AS i)""", "code_files"))
def directories(t):
    return O.directories(code_files(t))


@query("s11_ingest_defaults", sql(f"""
SELECT project_id, coalesce(nullif(label, ''), 'file_' || CAST(block_index AS VARCHAR) || '.txt') AS path,
       {base_name('label')} AS name, regexp_replace(label, '/?[^/]*$', '') AS directory, coalesce(nullif(language, ''), 'text') AS language,
       length(code) AS size, len(string_split(code, chr(10))) AS line_count, CAST(block_index AS BIGINT) AS "order", sha256(code) AS hash
FROM code_blocks""", "code_blocks"))
def ingest_defaults(t):
    raw = V.code_blocks(t).select("project_id", F.col("label").alias("path"), F.lit(None).cast("string").alias("name"),
                                  "language", F.col("code").alias("content"), F.col("block_index").alias("position"))
    return O.ingest_defaults(raw).withColumn("hash", F.sha2("content", 256)).drop("content")
