"""Dated URL lists: entries become validity intervals, and each capture is judged by the entries active when it was fetched.

DataFrame operations only. A list's log has one row for each dated change of an entry; a capture looks up its host,
the domains above it, and the prefixes of its path. The latest change at or before the fetch decides, per entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.llm.shared import unused, written

#: Segments of a path that make keys, where the lists are not known.
SEGMENTS = 4
#: Captures of a key that are sorted together with its list; a key with more is dealt out, with its list each time.
TOGETHER = 512


def host_of(url: Column) -> Column:
    """Host of an http(s) URL in lower case, without user, port and final dot; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path of a URL without query, fragment and empty segments."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.array_join(F.filter(F.split(path, "/"), lambda p: p != ""), "/")


def keys_of(url: Column, segments: int = SEGMENTS) -> Column:
    """What a list entry may be for a URL to fall under it: host, domains above (``*.domain``), host and path prefixes.

    Prefixes have ``segments`` segments at most: as many as the longest entry has.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("*."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.split(path_of(url), "/")
    deep = F.when(path_of(url) == "", F.lit(0)).otherwise(F.least(F.size(parts), F.lit(segments)))
    below = F.when(deep > 0, F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(F.array(host), above, F.coalesce(below, F.array().cast("array<string>")))))


def intervals(log: DataFrame) -> DataFrame:
    """(list, entry, verdict, valid_from, valid_to) of a log with columns list, entry, verdict, at.

    A row puts the entry on the list with its verdict from ``at`` on; a null verdict takes it off. Of several rows of
    one moment the least verdict holds, a removal only if it stands alone. Repeated states make one interval; an open
    one has a null end. Rows without list, entry or time take no part.
    """
    clean = log.where(F.col("list").isNotNull() & F.col("entry").isNotNull() & F.col("at").isNotNull())
    moments = clean.groupBy("list", "entry", F.date_trunc("day", "at").alias("day"), "at").agg(F.min("verdict").alias("verdict"))
    moments = written(moments, "list-moments")
    # An entry with many changes is sorted day by day; only one row a day meets those of the entry's other days.
    day, key = ["list", "entry", "day"], Window.partitionBy("list", "entry").orderBy("day")
    in_day = Window.partitionBy(*day).orderBy("at")
    state = F.struct("verdict")
    lasts = moments.groupBy(*day).agg(F.max_by(state, "at").alias("last"))
    lasts = written(lasts.select(*day, F.lag("last").over(key).alias("before_day")), "list-days")
    before = F.coalesce(F.lag(state).over(in_day), F.col("before_day"))
    seen = moments.join(lasts, day).withColumn("before", before)
    changed = written(seen.where(F.col("before").isNull() | ~F.col("before.verdict").eqNullSafe(F.col("verdict"))).select(*day, "at", "verdict"), "list-changes")
    firsts = changed.groupBy(*day).agg(F.min("at").alias("first"))
    firsts = written(firsts.select(*day, F.lead("first").over(key).alias("next_day")), "list-days")
    ends = changed.join(firsts, day).withColumn("valid_to", F.coalesce(F.lead("at").over(in_day), F.col("next_day")))
    return ends.where("verdict is not null").select("list", "entry", "verdict", F.col("at").alias("valid_from"), "valid_to")


def _active(captures: DataFrame, spans: DataFrame) -> DataFrame:
    """(rid, list, entry, verdict, valid_from, valid_to): for each key of a capture and each list the interval at its time.

    An as-of join: captures and interval starts of a key are sorted by time, and each capture takes the last start
    of each list. A key with many captures is dealt into parts, each of which gets the key's intervals. ``spans`` is read
    several times, so it is a written table.
    """
    keyed = captures.where(F.col("at").isNotNull()).select("rid", "at", F.explode("keys").alias("entry"))
    keyed = written(keyed.join(spans.select("entry").distinct(), "entry", "left_semi"), "listed-captures")
    sizes = written(keyed.groupBy("entry").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts")), "listed-keys")
    lists = spans.join(sizes, "entry").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    starts = lists.select("entry", "part", F.col("valid_from").alias("at"), F.lit(0).alias("capture"), F.lit(None).cast("long").alias("rid"),
                          "list", F.struct("verdict", "valid_from", "valid_to").alias("span"))
    names = lists.select("entry", "part", "list").distinct()
    dealt = keyed.join(sizes, "entry").select("entry", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part"), "at", "rid")
    asked = dealt.join(names, ["entry", "part"]).select("entry", "part", "at", F.lit(1).alias("capture"), "rid", "list", F.lit(None).cast(starts.schema["span"].dataType).alias("span"))
    in_time = Window.partitionBy("entry", "part", "list").orderBy("at", "capture").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(asked).withColumn("span", F.last("span", ignorenulls=True).over(in_time)).where("capture = 1")
    live = F.col("span.valid_to").isNull() | (F.col("at") < F.col("span.valid_to"))
    return found.where(F.col("span").isNotNull() & live).select("rid", "list", "entry", "span.verdict", "span.valid_from", "span.valid_to")


def judged(captures: DataFrame, log: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``verdict``, ``entry``, ``list``, ``valid_from`` and ``active`` (how many entries were active).

    Of the active entries the longest decides; of equally long ones ``block`` goes before other verdicts, then entry and
    list in order. A capture without URL, host or time, or with no active entry, has null there and 0 active.
    Columns of those names are replaced. Rows may repeat: each is judged for itself.
    """
    added = ["verdict", "entry", "list", "valid_from", "active"]
    own = captures.drop(*added)
    rid, keys = unused("rid", own.columns), unused("keys", own.columns)
    spans = written(intervals(log), "list-intervals")
    deepest = spans.agg(F.max(F.size(F.split("entry", "/")) - 1)).first()[0] or 0
    # Written once, so that the numbers that tell rows apart stay as they are, and keys are made where rows are read.
    rows = written(own.withColumn(rid, F.monotonically_increasing_id()).withColumn(keys, keys_of(F.col(url_col), deepest)), "captures")
    asked = rows.select(F.col(rid).alias("rid"), F.col(time_col).alias("at"), F.col(keys).alias("keys"))
    rank = F.struct((-F.length("entry")).alias("short"), (F.col("verdict") != "block").alias("mild"), "entry", "list", "verdict", "valid_from")
    best = _active(asked, spans).groupBy("rid").agg(F.min(rank).alias("best"), F.count("*").alias("active"))
    best_of, met = unused("_best", rows.columns), unused("_met", rows.columns)
    best = best.select(F.col("rid").alias(met), F.struct("best", "active").alias(best_of))
    found = rows.join(best, F.col(rid) == F.col(met), "left")
    return found.select(*own.columns, *[F.col(f"{best_of}.best.{c}").alias(c) for c in added[:-1]],
                        F.coalesce(F.col(f"{best_of}.active"), F.lit(0)).cast("long").alias("active"))
