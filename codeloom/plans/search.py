"""Queries: ranked search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom.operators import search as O
from codeloom.operators.search_index import SearchIndex
from codeloom.plans.registry import query
from codeloom.plans.sqltext import add_view, base_name, q, sql
from codeloom.session import cut_lineage, ensure_checkpoint_dir
from codeloom.sources import views as V

add_view("search_table", f"""
SELECT 'project_' || CAST(project_id AS VARCHAR) AS key, 'project' AS type, CAST(project_id AS VARCHAR) AS project_id, name, NULL AS path, NULL AS directory,
  NULL AS language, languages, tags, source_url, page_title, source_site, NULL AS content, total_size AS size, created_at, is_favorite,
  lower(concat_ws(' ', name, source_url, page_title, source_site, array_to_string(languages, ' '), array_to_string(tags, ' '))) AS search_text FROM projects
UNION ALL SELECT 'file_' || CAST(file_id AS VARCHAR), 'file', project_id, {base_name('path')}, path, regexp_replace(path, '/?[^/]*$', ''), language,
  CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), NULL, NULL, NULL, content, length(content), ts, false,
  lower(concat_ws(' ', {base_name('path')}, path, regexp_replace(path, '/?[^/]*$', ''), language, content)) FROM files""", ["projects", "files"])
NOW = "2024-03-01"


def table(t):
    return O.search_table(V.projects(t), V.files(t))


def _now():
    return F.to_timestamp(F.lit(NOW + " 00:00:00"))


def _has(x: str, needle: str, points: int) -> str:
    return f"CASE WHEN contains({x}, {q(needle)}) THEN {points} ELSE 0 END"


def _score(text: str) -> str:
    low = text.lower().strip()
    parts = [_has(f"lower({c})", low, n) for c, n in O.FIELD_SCORES] + [f"CASE WHEN lower(name) = {q(low)} THEN 200 ELSE 0 END"]
    parts += [f"60 * len(list_filter(tags, lambda x: contains(lower(x), {q(low)})))", f"40 * len(list_filter(languages, lambda x: contains(lower(x), {q(low)})))"]
    parts.append(_has("lower(content)", low, 20))
    for k in O.tokens(text):
        parts.append(_has("search_text", k, 5))
        parts.append(f"least(2 * coalesce(len(string_split(lower(content), {q(k)})) - 1, 0), 30)")
    base = " + ".join(parts)
    age = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 86400000000.0"
    return f"CASE WHEN {base} > 0 THEN {base} + CASE WHEN is_favorite THEN 10 ELSE 0 END + greatest(0.0, 10.0 - {age} / 30) ELSE 0.0 END"


@query("q1_search_table", sql("SELECT key, type, name, path, directory, language, size, search_text FROM search_table", "search_table"))
def search_table(t):
    return table(t).select("key", "type", "name", "path", "directory", "language", "size", "search_text")


@query("q2_query_tokens", r"""
SELECT event_id, array_to_string(list_filter(regexp_split_to_array(lower(event_type || '-Search_' || props || ' a'), '[\s_-]+'), lambda x: length(x) > 1), '|') AS tokens FROM events""")
def query_tokens(t):
    text = F.concat("event_type", F.lit("-Search_"), "props", F.lit(" a"))
    return t("events").select("event_id", F.array_join(O.token_column(text), "|").alias("tokens"))


@query("q3_relevance", sql(f"SELECT key, round(s, 6) AS score FROM (SELECT key, CAST({_score('Er the_of')} AS DOUBLE) AS s FROM search_table) WHERE s > 0", "search_table"))
def relevance(t):
    return O.matches(table(t), "Er the_of", _now()).select("key", F.round("score", 6).alias("score"))


@query("q3_filtered_search", sql(f"""
SELECT key, round(s, 6) AS score FROM (SELECT key, created_at, CAST({_score('https example')} AS DOUBLE) AS s FROM search_table
  WHERE type = 'project' AND is_favorite AND created_at >= TIMESTAMP '2024-01-01 01:00:00') WHERE s > 0""", "search_table"))
def filtered(t):
    return O.matches(table(t), "https example", _now(), type="project", favorite=True,
                     since=F.to_timestamp(F.lit("2024-01-01 01:00:00"))).select("key", F.round("score", 6).alias("score"))


def _page(order: str) -> str:
    return sql(f"""
SELECT key, name, total FROM (SELECT *, count(*) OVER () AS total FROM (SELECT *, CAST({_score('the')} AS DOUBLE) AS score FROM search_table) WHERE score > 0)
ORDER BY {order}, key LIMIT 50 OFFSET 10""", "search_table")


def _paged(found, sort: str):
    """Total and page from one scan: narrow hits are kept, counted and cut."""
    hits = cut_lineage(found.select("key", "name", "score", "created_at", "size"))
    total = hits.agg(F.count("*").alias("n"))
    return hits.orderBy(*O.SORTS[sort](), "key").offset(10).limit(50).withColumn("total", total.scalar())


def _sorted(t, sort: str):
    return _paged(O.matches(table(t), "the", _now()), sort).select("key", "name", "total")


@query("t1_search_by_relevance", _page("score DESC"))
def by_relevance(t):
    return _sorted(t, "relevance")


@query("t1_search_by_date", _page("created_at DESC"))
def by_date(t):
    return _sorted(t, "date")


@query("t1_search_by_size", _page("size DESC"))
def by_size(t):
    return _sorted(t, "size")


@query("t1_search_by_name", _page("name"))
def by_name(t):
    return _sorted(t, "name")


_FILE = ("CASE WHEN contains(lower(name), 'en') THEN 100 ELSE 0 END + CASE WHEN lower(name) = 'en' THEN 200 ELSE 0 END + CASE WHEN contains(lower(path), 'en') THEN 70 ELSE 0 END"
         " + CASE WHEN contains(lower(directory), 'en') THEN 40 ELSE 0 END + CASE WHEN contains(lower(language), 'en') THEN 50 ELSE 0 END"
         " + CASE WHEN instr(lower(content), 'en') > 0 THEN 30 ELSE 0 END + CASE WHEN instr(lower(content), 'en') BETWEEN 1 AND 100 THEN 20 ELSE 0 END")


@query("q4_file_relevance", sql(f"SELECT key, score FROM (SELECT key, CAST({_FILE} AS BIGINT) AS score FROM search_table WHERE type = 'file') WHERE score > 0", "search_table"))
def file_relevance(t):
    return O.search_files(table(t), "EN ").select("key", "score")


@query("q5_snippets", sql("""
SELECT key, CASE WHEN a < 0 THEN substr(content, 1, 200) ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || substr(content, s + 1, e - s) || CASE WHEN e < length(content) THEN '...' ELSE '' END END AS snippet
FROM (SELECT *, greatest(0, a - 50) AS s, least(length(content), a + 2 + 150) AS e FROM (
  SELECT key, content, instr(lower(content), 'the') - 1 AS a, score FROM (SELECT * , 1 AS score FROM search_table WHERE type = 'file'
    AND (contains(lower(name), 'the') OR contains(lower(path), 'the') OR contains(lower(directory), 'the') OR contains(lower(language), 'the') OR contains(lower(content), 'the')))))""".replace("a + 2 + 150", "a + 3 + 150"), "search_table"))
def snippets(t):
    return O.search_files(table(t), "the").select("key", "snippet")


@query("t3_suggestions", sql("""
SELECT key, type, name AS text, CASE WHEN type = 'project' THEN 'Project' ELSE coalesce(language, 'File') END AS description FROM search_table
WHERE starts_with(lower(name), 'doc') ORDER BY name, key LIMIT 5""", "search_table"))
def suggestions(t):
    return O.suggestions(table(t), "Doc")


@query("p14_tag_and_language_search", sql("""
SELECT 'tag' AS kind, key FROM search_table WHERE type = 'project' AND len(list_filter(tags, lambda x: lower(x) = 'tag-1')) > 0
UNION ALL SELECT 'language', key FROM search_table WHERE type = 'file' AND language = 'fr'""", "search_table"))
def tag_and_language(t):
    s = table(t)
    return O.by_tag(s, "TAG-1").select(F.lit("tag").alias("kind"), "key").unionByName(O.by_language(s, "FR").select(F.lit("language").alias("kind"), "key"))


@query("a14_popular_languages", sql("SELECT language, count(*) AS count FROM search_table WHERE type = 'file' AND language IS NOT NULL GROUP BY language", "search_table"))
def popular(t):
    return O.popular_languages(table(t))


@query("a14_corpus_statistics", sql("""
SELECT count(*) AS total_indexed, count(*) FILTER (type = 'project') AS project_count, count(*) FILTER (type = 'file') AS file_count,
  CAST(sum(size) FILTER (type = 'file') AS BIGINT) AS total_size, count(DISTINCT language) FILTER (type = 'file') AS unique_languages FROM search_table""", "search_table"))
def statistics(t):
    return O.corpus_statistics(table(t))


# --- the stored index: written once a session and table folder, read by every query -----------------
_STORED: dict[tuple[str, str, str], str] = {}


def stored_index(t) -> SearchIndex:
    """The index over all projects and files, written on first use and again where the input files have changed.

    Its first generation has older texts for the files that ``labels`` names; an update brings their present texts and
    takes out projects that are no favourites.
    """
    files = [t(n).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct() for n in ("documents", "pages", "labels")]
    state = files[0].unionByName(files[1]).unionByName(files[2]).agg(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()[0]
    place = (t.spark.sparkContext.applicationId, t.folder, str(state))
    if place not in _STORED:
        folder = f"{ensure_checkpoint_dir(t.spark)}/search-index-{uuid.uuid4().hex}"
        labelled = t("labels").select(F.concat(F.lit("file_"), F.col("doc_id").cast("string")).alias("key")).distinct()
        older = V.files(t).join(t("labels").select(F.col("doc_id").alias("file_id"), F.lit(True).alias("_old")).distinct(), "file_id", "left")
        older = older.withColumn("content", F.when(F.col("_old"), F.concat(F.lit("an older text of "), "path")).otherwise(F.col("content"))).drop("_old")
        index = SearchIndex.create(O.search_table(V.projects(t), older), folder)
        current = table(t)
        index.update(current.join(labelled, "key", "left_semi"), current.where("type = 'project' AND NOT is_favorite"))
        _STORED[place] = folder
    return SearchIndex(t.spark, _STORED[place])


_LIVE = "(SELECT * FROM search_table WHERE type = 'file' OR is_favorite)"


@query("q1_index_relevance", sql(f"SELECT key, round(s, 6) AS score FROM (SELECT key, CAST({_score('Er the_of')} AS DOUBLE) AS s FROM {_LIVE}) WHERE s > 0", "search_table"))
def index_relevance(t):
    return stored_index(t).matches("Er the_of", _now()).select("key", F.round("score", 6).alias("score"))


@query("q1_index_phrase", sql(f"SELECT key, name, round(s, 6) AS score FROM (SELECT key, name, CAST({_score('reading ingtion')} AS DOUBLE) AS s FROM {_LIVE}) WHERE s > 0", "search_table"))
def index_phrase(t):
    return stored_index(t).matches("reading ingtion", _now()).select("key", "name", F.round("score", 6).alias("score"))


@query("q1_index_older_texts", sql(f"SELECT key, round(s, 6) AS score FROM (SELECT key, CAST({_score('an older text of')} AS DOUBLE) AS s FROM {_LIVE}) WHERE s > 0", "search_table"))
def index_older(t):
    """Words of the older texts, which the update has replaced."""
    return stored_index(t).matches("an older text of", _now()).select("key", F.round("score", 6).alias("score"))


@query("q1_index_file_relevance", sql(f"SELECT key, score FROM (SELECT key, CAST({_FILE} AS BIGINT) AS score FROM search_table WHERE type = 'file') WHERE score > 0", "search_table"))
def index_file_relevance(t):
    return stored_index(t).search_files("EN ").select("key", "score")


@query("q1_index_page", sql(f"""
SELECT key, name, total FROM (SELECT *, count(*) OVER () AS total FROM (SELECT *, CAST({_score('the')} AS DOUBLE) AS score FROM {_LIVE}) WHERE score > 0)
ORDER BY score DESC, key LIMIT 50 OFFSET 10""", "search_table"))
def index_page(t):
    return _paged(stored_index(t).matches("the", _now()), "relevance").select("key", "name", "total")
