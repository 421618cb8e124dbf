"""Queries: stream jobs, run to their end over the tables, and the jobs that work on tables too."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import html as H
from codeloom.operators import blocks as B
from codeloom.plans.analytics import change_log
from codeloom.plans.duplicates import UPDATE_TYPE
from codeloom.plans.registry import query
from codeloom.plans.sqltext import add_view, like, q, sql, strip
from codeloom.sources import views as V
from codeloom.streaming import blocks as SB, log as LG, merge as SM, monitors as MO, sinks as SK, tabs as TB

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _documents(t):
    """Documents as a stream of arriving files."""
    t.spark.conf.set(PROVIDER, ROCKS)
    d = SK.read_stream(t.spark, t.folder, "documents.parquet")
    return d.select(F.col("source").alias("project_id"), F.concat(
        F.col("lang"), F.lit("/Doc_"), F.floor(F.col("doc_id") / 200).cast("string"), F.lit(".txt")).alias("path"),
        F.col("doc_id").alias("event_id"), F.timestamp_seconds(F.lit(V.EPOCH) + F.col("doc_id") * 60).alias("ts"), F.col("text").alias("content"))


add_view("arrivals", "SELECT *, row_number() OVER (PARTITION BY project_id, lower(path) ORDER BY ts, file_id) AS n, lower(path) AS path_key FROM files", ["files"])
add_view("live", f"""
SELECT project_id, path_key, n, file_id AS event_id, path, 'added' AS status, CAST(NULL AS VARCHAR) AS update_type, content AS state, content, CAST(NULL AS VARCHAR) AS previous FROM arrivals WHERE n = 1
UNION ALL SELECT project_id, path_key, n, file_id, path, CASE WHEN old = new THEN 'unchanged' WHEN ut = 'UNRELATED' THEN 'conflict' ELSE 'updated' END,
  CASE WHEN old <> new THEN ut END, CASE WHEN old <> new AND ut = 'UNRELATED' THEN old ELSE new END, new, old
FROM (SELECT *, {UPDATE_TYPE} AS ut FROM (SELECT a.project_id, a.path_key, a.n, a.file_id, a.path, l.state AS old, a.content AS new
  FROM live l JOIN arrivals a ON a.project_id = l.project_id AND a.path_key = l.path_key AND a.n = l.n + 1))""", ["arrivals"], recursive=True)


@query("st4_live_merge", sql("SELECT project_id, path_key, event_id, path, status, update_type, content FROM live", "live"))
def live_merge(t):
    return SK.run_to_table(SM.live_merge(_documents(t))).select("project_id", "path_key", "event_id", "path", "status", "update_type", "content")


@query("st6_change_log", sql("""
SELECT event_id, project_id, path, CASE status WHEN 'added' THEN 'file_added' WHEN 'updated' THEN 'file_updated' ELSE 'conflict' END AS type, update_type,
  length(previous) AS old_length, length(content) AS new_length, length(content) - coalesce(length(previous), 0) AS diff_size FROM live WHERE status <> 'unchanged'""", "live"))
def live_changes(t):
    return SM.change_log(SK.run_to_table(SM.live_merge(_documents(t)))).drop("ts")


@query("st11_captured_versions", sql("""
SELECT event_id AS version_id, project_id, path, CASE WHEN status = 'added' THEN 'live_scan_add' ELSE update_type END AS change_type FROM live WHERE status IN ('added', 'updated')""", "live"))
def captured_versions(t):
    return SM.version_rows(SK.run_to_table(SM.live_merge(_documents(t)))).select("version_id", "project_id", "path", "change_type")


@query("st1_new_blocks", f"""
SELECT DISTINCT lang AS page_id, 'el_P_0_' || sha256(text) AS element_id FROM documents WHERE length({strip('text')}) >= 10""")
def new_blocks(t):
    d = _documents(t).select(F.substring_index("path", "/", 1).alias("page_id"), "ts", F.col("content").alias("text")).withColumn(
        "tag", F.lit("p")).withColumn("position", F.lit(0)).withColumn("none", F.lit(""))
    d = d.withColumn("element_id", SB.element_id("none", "none", "none", "position", "tag", "text"))
    return SK.run_to_table(SB.new_blocks(d).select("page_id", "element_id"))


@query("st2_element_ids", sql("""
SELECT page_id, block_index, CASE WHEN block_index % 4 = 0 THEN 'id_' || CAST(size AS VARCHAR) WHEN block_index % 4 = 1 THEN 'data-message-id_' || CAST(lines AS VARCHAR)
  WHEN block_index % 4 = 2 THEN 'parent_' || CAST(page_id AS VARCHAR) || '_idx_' || CAST(block_index AS VARCHAR)
  ELSE 'el_' || upper(tag) || '_' || CAST(block_index AS VARCHAR) || '_' || sha256(code) END AS element_id FROM prose_blocks""", "prose_blocks"))
def element_ids(t):
    b = B.extract_prose_blocks(t.spread("pages"))
    m = F.col("block_index") % 4
    b = b.withColumn("own", F.when(m == 0, F.col("size").cast("string"))).withColumn("message", F.when(m == 1, F.col("lines").cast("string"))).withColumn(
        "parent", F.when(m == 2, F.col("page_id").cast("string")))
    return b.select("page_id", "block_index", SB.element_id("own", "message", "parent", "block_index", "tag", "code").alias("element_id"))


def _session(gap: str, key: str) -> str:
    return f"""
SELECT {key}, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) + INTERVAL {gap}, '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS {{n}} FROM (
  SELECT *, sum(CASE WHEN ts - p < INTERVAL {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS s FROM (
    SELECT *, lag(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS p FROM (SELECT event_type AS page_id, user_id AS source_id, ts, event_id FROM events)))
GROUP BY {key}, s"""


def _beats(t):
    return t("events").select(F.col("event_type").alias("page_id"), F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def _seconds(df):
    return df.withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss")).withColumn("ended", F.date_format("ended", "yyyy-MM-dd HH:mm:ss"))


@query("st3_bursts", _session("30 SECOND", "page_id").format(n="blocks"))
def bursts(t):
    return _seconds(SB.bursts(_beats(t), "30 seconds"))


@query("st8_live_spans", _session("6 SECOND", "source_id").format(n="beats"))
def live_spans(t):
    return _seconds(MO.live_spans(_beats(t)))


def _beat_stream(t):
    t.spark.conf.set(PROVIDER, ROCKS)
    e = SK.read_stream(t.spark, t.folder, "events.parquet")
    return e.select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("type"))


@query("st8_live_spans_stream", "SELECT * FROM (" + _session("6 SECOND", "source_id").format(n="beats") + """)
WHERE CAST(ended AS TIMESTAMP) + INTERVAL 1 SECOND < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def live_spans_stream(t):
    """Spans that the watermark has passed, given by a stream; the last seconds before it are left to the next run."""
    spans = SK.run_to_table(MO.live_spans(_beat_stream(t)))
    last = t("events").select(F.max(F.col("ts").cast("timestamp")).alias("newest"))
    before = (F.date_trunc("second", "ended") + F.expr("INTERVAL 1 SECOND")) < F.col("newest") - F.expr("INTERVAL 10 MINUTES")
    return _seconds(spans.crossJoin(F.broadcast(last)).where(before).drop("newest"))  # one row of one value


@query("st7_latest_by_source_stream", "SELECT user_id AS source_id, arg_max(event_id, (ts, event_id)) AS last_event, count(*) AS updates FROM events GROUP BY 1")
def latest_by_source_stream(t):
    return SK.updates_to_table(MO.latest_by_source(_beat_stream(t)), ["source_id"]).select("source_id", "last_event", "updates")


@query("st10_live_counters_stream", """
SELECT count(*) AS detected, count(*) FILTER (event_type = 'signup') AS added, count(*) FILTER (event_type = 'click') AS updated, count(*) FILTER (event_type = 'error') AS conflicts FROM events""")
def live_counters_stream(t):
    named = F.create_map(*[F.lit(x) for x in ("signup", "file_added", "click", "file_updated", "error", "conflict")])
    return SK.updates_to_table(MO.live_counters(_beat_stream(t).withColumn("type", F.element_at(named, F.col("type")))), [], "complete")


@query("st8_active_sources", """
SELECT user_id AS source_id, TIMESTAMP '2024-01-30 12:00:00' - max(ts) <= INTERVAL 6 SECOND AS is_alive FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1""")
def active_sources(t):
    now = F.to_timestamp(F.lit("2024-01-30 12:00:00"))
    return MO.active_sources(_beats(t).where(F.col("ts") <= now), now).select("source_id", "is_alive")


@query("st7_latest_by_source", "SELECT user_id AS source_id, arg_max(event_id, (ts, event_id)) AS last_event, count(*) AS updates FROM events GROUP BY 1")
def latest_by_source(t):
    return MO.latest_by_source(_beats(t)).select("source_id", "last_event", "updates")


@query("st10_live_counters", """
SELECT count(*) AS detected, count(*) FILTER (event_type = 'signup') AS added, count(*) FILTER (event_type = 'click') AS updated, count(*) FILTER (event_type = 'error') AS conflicts FROM events""")
def live_counters(t):
    return MO.live_counters(change_log(t))


@query("st10_last_log", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def last_log(t):
    return MO.last_log(t("events")).select("event_id", "event_type")


@query("st12_code_like", sql(f"""
SELECT block_id, (language IN ('pre', 'code') OR {' OR '.join(f"contains(label, '{w}')" for w in SB.CODE_CLASSES)})
  OR (contains(code, chr(10)) AND length(code) > 50 AND ({like('code', SB.CODE_LINE)} OR {like('code', SB.CODE_BRACKETS)})) AS code_like FROM code_blocks""", "code_blocks"))
def code_like(t):
    return V.code_blocks(t).select("block_id", SB.looks_like_code("label", "language", "code").alias("code_like"))


@query("st5_complete_blocks", """
SELECT doc_id AS page_id, source AS element_id, sha256(text) AS hash FROM documents
WHERE doc_id * 60000 + 500 <= (SELECT max(doc_id) FROM documents) * 60000 - 600000""")
def complete_blocks(t):
    """Texts that came to rest before the watermark; the last ten minutes are still held."""
    d = _documents(t).select(F.col("event_id").alias("page_id"), F.col("project_id").alias("element_id"), F.col("content").alias("text"), "ts",
                             F.lit(False).alias("busy"))
    return SK.run_to_table(SM.complete_blocks(d)).select("page_id", "element_id", F.sha2("text", 256).alias("hash"))


@query("st10_bounded_logs_stream", """
SELECT user_id AS source_id, event_id, event_type AS type, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS place FROM events) WHERE place < 50""")
def bounded_logs_stream(t):
    logs = SK.updates_to_table(LG.bounded_logs(_beat_stream(t)), ["source_id"])
    return logs.select("source_id", F.posexplode(F.arrays_zip("event_ids", "types")).alias("place", "e")).select(
        "source_id", F.col("e.event_ids").alias("event_id"), F.col("e.types").alias("type"), "place")


@query("u1_merged_tabs_stream", sql("""
SELECT path_key, file_id, project_id, content, copies FROM (
  SELECT *, lower(path) AS path_key, count(*) OVER (PARTITION BY lower(path)) AS copies, row_number() OVER (PARTITION BY lower(path) ORDER BY ts DESC, project_id, file_id) AS rn
  FROM files WHERE project_id NOT IN (SELECT 'src' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 1)) WHERE rn = 1""", "files"))
def merged_tabs_stream(t):
    """Arriving files of all sources as one project; the sources of one region close in the end."""
    came = _documents(t).withColumnRenamed("event_id", "file_id")
    nations = SK.read_stream(t.spark, t.folder, "nation.parquet").where("n_regionkey = 1")
    went = nations.select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("project_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"))
    return SK.updates_to_table(TB.merged_tabs(came, went), ["path_key"]).where("NOT gone").drop("gone")
