"""All pages judged by dated URL lists.

A page is fetched when the event with its number happens. Lists are kept by the events: one of a user puts an entry
that the user's page falls under on a list (``error``: block; ``signup``: allow) or takes it off (``purchase``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm.queries.registry import query, table
from codeloom.llm.url_lists import host_of, judged, path_of

CHECK = r"""
WITH p AS (
  SELECT page_id, url, e.ts AS fetched_at, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '') AS host,
    array_to_string(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> ''), '/') AS path
  FROM pages LEFT JOIN events e ON e.event_id = page_id),
log AS (
  SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS list, ts AS since,
    CASE event_id % 3 WHEN 0 THEN host WHEN 1 THEN '*.' || regexp_extract(host, '([^.]*\.[^.]*)$', 1) ELSE host || '/' || string_split(path, '/')[1] END AS entry,
    CASE event_type WHEN 'error' THEN 'block' WHEN 'signup' THEN 'allow' END AS verdict
  FROM events JOIN p ON page_id = user_id WHERE event_type IN ('error', 'signup', 'purchase') AND host IS NOT NULL),
moments AS (SELECT list, entry, since, min(verdict) AS verdict FROM log GROUP BY ALL),
spans AS (SELECT *, lead(since) OVER (PARTITION BY list, entry ORDER BY since) AS valid_to FROM moments),
hits AS (
  SELECT page_id, s.list, s.entry, s.verdict FROM p JOIN spans s
  ON fetched_at >= s.since AND (s.valid_to IS NULL OR fetched_at < s.valid_to) AND s.verdict IS NOT NULL
  AND (s.entry = host OR (s.entry LIKE '*.%' AND (host = s.entry[3:] OR suffix(host, s.entry[2:]))) OR starts_with(host || '/' || path || '/', s.entry || '/') AND contains(s.entry, '/'))),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(entry) DESC, verdict <> 'block', entry, list) AS n, count(*) OVER (PARTITION BY page_id) AS active FROM hits)
SELECT p.page_id, p.url, p.fetched_at, b.verdict, b.entry, b.list, coalesce(b.active, 0) AS active FROM p LEFT JOIN best b ON b.page_id = p.page_id AND b.n = 1
"""


def list_log(pages: DataFrame, events: DataFrame) -> DataFrame:
    """(list, entry, verdict, at) of the events of users whose number is a page's."""
    changes = events.where(F.col("event_type").isin("error", "signup", "purchase"))
    own = changes.join(pages.select(F.col("page_id").alias("user_id"), "url"), "user_id").withColumn("host", host_of(F.col("url")))
    kind = F.col("event_id") % 3
    domain = F.concat(F.lit("*."), F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1))
    entry = F.when(kind == 0, F.col("host")).when(kind == 1, domain).otherwise(F.concat("host", F.lit("/"), F.split(path_of(F.col("url")), "/")[0]))
    verdict = F.when(F.col("event_type") == "error", "block").when(F.col("event_type") == "signup", "allow")
    return own.where("host is not null").select(F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("list"), entry.alias("entry"),
                                                verdict.alias("verdict"), F.col("ts").alias("at"))


@query("op2_temporal_list_join", CHECK)
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, events = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "events")
    fetched = pages.join(events.select(F.col("event_id").alias("page_id"), F.col("ts").alias("fetched_at")), "page_id", "left")
    return judged(fetched, list_log(pages, events)).select("page_id", "url", "fetched_at", "verdict", "entry", "list", "active")
